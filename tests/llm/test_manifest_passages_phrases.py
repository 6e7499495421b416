"""Merkle manifest, repeated passages and phrases against brute force, with null, empty, long, tied and repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskloom.llm import collocations, merkle, passages

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def frame(spark, rows, *names):
    return spark.createDataFrame(rows, DOCS).repartition(5).select("*", *[F.lit(-1).alias(x) for x in names])


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, source, lang, n_chars, text = row
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def runs(nodes):
    return [nodes[i : i + 16] for i in range(0, len(nodes), 16)]


def climb(nodes):
    """The top of the nodes, and for each the digests left and right of it on every level."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(places):
            run, slot = runs(nodes)[p // 16], p % 16
            paths[i].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        nodes, places = [h(*r) for r in runs(nodes)], [p // 16 for p in places]
    return nodes[0], paths


def manifest(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    held = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    tops = {s: climb([leaf(r) for r in held[s]]) for s in sources}
    root, above = climb([tops[s][0] for s in sources])
    out = []
    for s, upper in zip(sources, above):
        for row, path in zip(held[s], tops[s][1]):
            path, node = path + upper, row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                node = (*row[:4], re.sub("[A-Z]", lambda m: m[0].lower(), row[4]))
            folded = leaf(node)
            for left, right in path:
                folded = h(left, folded, right)
            proof = h(*[x for pair in path for x in pair])
            out.append((row[0], leaf(row), tops[s][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def folded_rows(docs):
    rows = merkle.manifest(docs)
    again = merkle.folded(F.coalesce("changed", "leaf"), F.col("path"))
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256), again, again == F.col("root"))
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [1, 1], [300, 1, 16, 17, 33], [3] * 20])
def test_merkle_shapes(spark, sizes):
    rows = [(1000 * s + i, f"é{s}" if s else None, "en", 7, f"Text {i} É") for s, n in enumerate(sizes) for i in range(n)]
    assert folded_rows(frame(spark, rows)) == manifest(rows)


def test_merkle_odd_rows(spark):
    rows = [(None, "a", None, None, None), (None, "a", None, None, "B"), (5, "a", "en", 1, ""), (5, "a", "en", 1, "C"), (5, "a", "en", 1, "C"), (6, "b", "en", 3, "x" * 900_000 + "Y")]
    rows += [(-i, "", "de", i, "ABC") for i in range(40)] + [(7, None, "en", 2, "Z")] * 20
    names = ["h", "n", "pos", "at", "range", "leaf", "path", "root", "key_", "s0", "up", "all", "row_no", "changed", "child", "i"]
    got = folded_rows(frame(spark, rows, *names))
    assert got == manifest(rows) and {r[-1] for r in got} == {True, False}
    assert folded_rows(frame(spark, rows).limit(0)) == []


def kept(rows):
    """What is left of each text, by looking at every run of 13 words."""
    least = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    order = lambda i: -1 if i is None else i
    for i, w in split:
        for k in range(len(w) - 12):
            run = tuple(w[k : k + 13])
            least[run] = min(least.get(run, order(i)), order(i))
    out = []
    for i, w in split:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 12):
            gone[k : k + 13] |= least[tuple(w[k : k + 13])] < order(i)
        out.append((i, len(w), int(gone.sum()), h(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=str)


def digest_rows(docs):
    return sorted(map(tuple, passages.digests(docs).collect()), key=str)


def passage_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abAé") for _ in range(rng.randint(1, 4)))
    shared = [[word() for _ in range(rng.randint(11, 60))] for _ in range(6)]
    out = [None, "", " \n\t", "one", "x " * 12, "x " * 13, "x " * 500, "And " * 40, " ".join(map(str, range(13)))]
    for _ in range(90):
        words = [word() for _ in range(rng.randint(0, 25))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            part = list(rng.choice(shared))
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = word()
            at = rng.randint(0, len(words))
            words[at:at] = part[rng.choice([0, 0, 1, 3]) :]
        out.append(rng.choice([" ", "\n", " \t "]).join(words))
    out += ["x " * 500, "x " * 20 + "y", "and " * 40, out[20].upper() if out[20] else "", " ".join(word() for _ in range(90_000))]
    return out


@pytest.mark.parametrize("flush", [passages.FLUSH, 700])
def test_passages(spark, monkeypatch, flush):
    monkeypatch.setattr(passages, "FLUSH", flush)
    rows = list(enumerate(passage_texts(3)))
    rng = random.Random(flush)
    rows += [(i, t) for i, t in rng.sample(rows, 12)]  # repeated rows
    rows += [(None, t) for _, t in rng.sample(rows, 5)] + [(i, rng.choice(rows)[1]) for i in range(40, 50)]  # null ids; an id of several texts
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    docs = docs.select("*", *[F.lit(-1).alias(x) for x in ("d", "k", "row", "passages", "shared", "o", "h", "w", "least")])
    assert digest_rows(docs) == kept(rows)
    assert passages.with_passages(docs.limit(0)).count() == 0


def test_passages_of_any_offset(spark):
    """A match of exactly 13 words is found wherever it stands in both texts, and none of 12 words."""
    run = [f"m{i}" for i in range(13)]
    rows = []
    for a in range(7):
        for b in range(7):
            match = [f"{w}.{a}.{b}" for w in run]
            n = len(rows)
            rows += [(n, " ".join([f"p{n}.{i}" for i in range(a)] + match)), (n + 1, " ".join([f"q{n}.{i}" for i in range(b)] + match + ["end"]))]
            rows += [(n + 2, " ".join(match[:12]) + f" z{n}")]
    got = digest_rows(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == kept(rows) and sum(r[2] for r in got) == 49 * 13


def test_texts_without_passages(spark):
    text = " ".join(map(str, range(20)))
    docs = spark.createDataFrame([(1, text, "a"), (2, "A  b " + text, "b"), (3, None, "c"), (4, "kept  as\nis", "d")], "doc_id long, text string, row string")
    got = {r.doc_id: (r.text, r.row) for r in passages.without_passages(docs).collect()}
    assert got == {1: (text, "a"), 2: ("A b", "b"), 3: (None, "c"), 4: ("kept  as\nis", "d")}


def phrases(rows, least, top):
    count, total = Counter(), Counter()
    for _, _, lang, _, text in rows:
        lang = "und" if lang is None else lang
        total[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    count[lang, tuple(w[i : i + n])] += 1
    known = {k: f for k, f in count.items() if f >= least}
    best = {}
    for (lang, w), a in known.items():
        if len(w) > 1:
            longer = [f for (other, x), f in known.items() if other == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))]
            if not any(100 * f >= 80 * a for f in longer):
                score, _, left, right = min((2_000_000 * a // (known[lang, w[:k]] + known[lang, w[k:]]), k, known[lang, w[:k]], known[lang, w[k:]]) for k in range(1, len(w)))
                best.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    out = []
    for lang, found in best.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("block,margin", [(collocations.BLOCK, collocations.MARGIN), (2000, 3)])
def test_collocations(spark, monkeypatch, block, margin):
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setattr(collocations, "CHUNK", 500 if block == 2000 else 1 << 20)
    monkeypatch.setattr(collocations, "MARGIN", margin)
    rng = random.Random(block)
    vocabulary = ["the", "Of", "é", "ÉA", "x1", "\x1c", "in", "a'b", "New", "York", "City", "-"]
    rows = [(1, "s", "en", 0, None), (2, "s", None, 0, ""), (None, None, None, None, "a b. " * 200), (3, "s", "de", 0, "ha " * 5000)]
    for i in range(400):
        words = rng.choices(vocabulary, weights=[9, 8, 3, 1, 1, 1, 6, 2, 4, 1, 1, 2], k=rng.randint(0, 40))
        words = [x + (" york city" if x == "New" and rng.random() < 0.9 else "") + rng.choice(["", "", "", ".", ",", "\n", "\v", "\t"]) for x in words]
        rows.append((i, "s", rng.choice(["en", "en", "fr", None]), 0, " ".join(words)))
    rows += rows[50:60]
    docs = frame(spark, rows, "phrase", "f", "words", "block", "p", "a", "w")
    want = phrases(rows, collocations.LEAST, 7)
    assert len(want) > 20 and sorted(map(tuple, collocations.collocations(docs, 7).collect())) == want
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark, monkeypatch):
    """Counts whose products with the scale pass 64 bits are divided exactly."""
    big = 3_000_000_000_000_000_000
    held = [("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big - 1), ("en", None, 1, big + 5)]
    monkeypatch.setattr(collocations, "counts", lambda docs: spark.createDataFrame(held, "lang string, phrase string, words int, f long"))
    row = collocations.collocations(None).first()
    assert (row.score, row.a, row.n) == (2_000_000 * (big - 1) // (2 * big), big - 1, big + 5)


def test_summaries_lose_nothing_frequent():
    """Merged in any order, a summary is short by at most its bound, which stays below mass over capacity."""
    rng = np.random.default_rng(1)
    keys = np.concatenate([rng.integers(0, 2000, 20_000), np.repeat(np.arange(5000, 5040), 30)]).astype(np.uint64)
    rng.shuffle(keys)
    found, count = np.unique(keys, return_counts=True)
    for parts in (1, 7, 60):
        summary = collocations.Summary(len(keys) // 8 // 20)
        halves = [collocations.Summary(summary.capacity) for _ in range(2)]
        for i, part in enumerate(np.array_split(keys, parts)):
            halves[i % 2].merge(*np.unique(part, return_counts=True))
        for x in halves:
            summary.merge(x.keys, x.counts, x.short)
        assert len(summary.keys) <= summary.capacity and summary.short <= len(keys) / summary.capacity
        left = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
        assert all(c - summary.short <= left.get(k, 0) <= c for k, c in zip(found.tolist(), count.tolist()))
        least = summary.short + 1
        assert set(found[count >= least].tolist()) <= set(summary.frequent(least).tolist())


def test_packed_phrases():
    x = np.array([0, 1, 2**48 - 1, 123456789012], np.uint64)
    assert collocations.unpacked(collocations.packed(x)).tolist() == x.tolist()
