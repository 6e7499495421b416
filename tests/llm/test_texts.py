"""The operators on texts against brute force, with null, empty, long, tied and repeated rows, empty tables and extra columns."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taskloom.llm import bpe, common, jaccard, lm_scores, mixing, quality, repeats

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, extra=False):
    rows = [(i, t, "en", f"src{i % 3}" if i and i % 7 else None, len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    # Names that operators use inside.
    names = ["score", "k", "cls", "d", "h", "s", "id", "spans", "mix_copy", "mix_cdf", "cdf", "node", "label"] if extra else []
    return df.select("*", *[F.lit(-1).alias(x) for x in names])


def odd_texts(seed=1):
    """Copies, near copies, shared passages, null, empty, blank, short and long texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    base = [[word() for _ in range(rng.randint(30, 90))] for _ in range(8)]
    passage = " ".join(word() for _ in range(40))
    out = [None, "", "   \n\t", "one", "One", "one two three four", "x" * 600, "ab" * 400, "\0" * 300, "a b " * 900]
    for _ in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = word()
        out.append(" ".join(words) + (" " + passage if rng.random() < 0.2 else ""))
    out.append(" ".join(word() for _ in range(60_000)))
    return list(enumerate(out))


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tokenizer(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeth  \n'sé")), max_size=80))
def test_bpe_is_the_merge_rule(vocabulary, tokenizer, text):
    ids = list(vocabulary.encoder.encode(text))
    assert ids == tokenizer.encode_ordinary(text)
    assert vocabulary.encoder.decode(ids) == text.encode()


def test_bpe_long_runs(vocabulary, tokenizer):
    for text in ("a" * 50_000, " " * 3000, "ab" * 9000, "é日" * 4000):
        assert list(vocabulary.encoder.encode(text)) == tokenizer.encode_ordinary(text)


def test_bpe_columns(spark, vocabulary, tokenizer):
    texts = odd_texts()
    docs, held = frame(spark, texts + texts[:3], extra=True), bpe.shared(spark, vocabulary)
    rows = docs.withColumn("ids", bpe.encode(F.col("text"), held)).withColumn("back", bpe.decode(F.col("ids"), held)).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        assert r.ids == tokenizer.encode_ordinary(r.text or "") and bytes(r.back) == (r.text or "").encode()
    got = {r.doc_id: r for r in bpe.digest_documents(docs, held).collect()}
    for i, t in texts:
        ids = tokenizer.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digest_documents(docs.limit(0), held).count() == 0


def test_words_and_their_hashes():
    texts = [t for _, t in odd_texts()] + ["y" * 700_000 + " z" * 400_000]
    known = {}
    for text, hashes in zip(texts, common.word_hashes(texts), strict=True):
        for w, h in zip(common.words(text), hashes.tolist(), strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def shingles(text, width=5):
    w = common.words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_jaccard_components(spark):
    texts = odd_texts() + [(1000 + i, t) for i, t in odd_texts()[5:25]] + [(5, odd_texts()[5][1]), (None, "one two three four")]
    got = jaccard.jaccard_components(frame(spark, texts, extra=True)).collect()
    assert len(got) == len(texts)
    sets = [(i, shingles(t)) for i, t in texts]
    a, b = zip(*[(i, j) for i, (_, x) in enumerate(sets) for j, (_, y) in enumerate(sets) if i < j and x and y and 100 * len(x & y) >= 80 * len(x | y)])
    label = common.least_labels(len(sets), np.array(a), np.array(b))
    ids = [[k for n, (k, _) in enumerate(sets) if label[n] == root and k is not None] for root in label]
    want = sorted(((k, len(x), min(group) if x and group else k) for (k, x), group in zip(sets, ids)), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert jaccard.jaccard_components(frame(spark, texts).limit(0)).count() == 0


def test_jaccard_second_round(spark):
    """A list whose leader links with none of the others must still find their links."""
    common_words = [f"w{i}" for i in range(60)]
    lone = common_words[:30] + [f"q{i}" for i in range(60)]
    twins = [common_words + [f"t{i}" for i in range(20)], common_words + [f"t{i}" for i in range(19)] + ["u"]]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, list(enumerate(map(" ".join, [lone, *twins]))))).collect()}
    assert got == {0: 0, 1: 1, 2: 1}


def test_jaccard_large_sets(spark):
    """Sets on both sides of a power of two, whose parities differ in width; an unlike one shares a long passage."""
    base = [f"w{i}" for i in range(4140)]
    texts = [base, base[:4070], base[:2000] + [f"x{i}" for i in range(2100)], ["y"] + base]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, list(enumerate(map(" ".join, texts))))).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0}


def test_parities_of_large_sets():
    """Halves of the wider parity add up to the narrower, and unlike sets differ in more bits than the threshold leaves room for."""
    rng = np.random.default_rng(5)
    a, b = (np.sort(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (4000, 4200))
    x, y = (np.array(jaccard.parity(s)).view(np.uint64) for s in (a, b))
    assert (len(x), len(y)) == (64, 128)
    assert 9 * sum(int(v).bit_count() for v in x ^ y[:64] ^ y[64:]) > len(a) + len(b)


def cut_by_hand(texts):
    seen, out = set(), {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            gone[k : k + 100] |= raw[k : k + 100] in seen
            seen.add(raw[k : k + 100])
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[i] = (len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_slices_hold_every_window_once():
    """Windows that are equal get the same key, whatever the phrase around them."""
    rng = random.Random(7)
    keys = {}
    for _ in range(60):
        raw = bytes(rng.choices(b"ab", k=176))
        gram = raw[76:100]
        for text, t in ((raw, 76), (raw[20:150] + b"x", 56), (b"y" * 3 + raw[40:], 39)):
            n = min(len(text) - 99, t + 1)
            s0 = max(0, t - 76)
            assert text[t : t + 24] == gram
            for ranges in (1, 8, 77):
                seen = []
                for key, s, count in repeats.slices(text, s0, n - s0, t - s0, ranges):
                    seen += range(s, s + count)
                    for i in range(s, s + count):
                        assert keys.setdefault((ranges, t - i, text[i : i + 100]), key) == key
                assert seen == list(range(s0, n)) or sorted(seen) == list(range(s0, n))


@pytest.mark.parametrize("at_once", [4096, 4, 1])
def test_repeats(spark, monkeypatch, at_once):
    monkeypatch.setattr(repeats, "SORTED", at_once)  # fewer: the phrases of a common trigger are cut into slices
    texts = odd_texts()
    docs = repeats.with_spans(frame(spark, texts, extra=True).drop("spans"))
    rows = docs.select("doc_id", repeats.digests(F.col("text"), F.col("spans")).alias("x")).select("doc_id", "x.*").collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == cut_by_hand(texts)


def test_repeats_of_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PART", 256)
    raw = random.Random(2).randbytes(3000).hex()
    batch = [raw, raw[500:3000], None, raw[:99]]
    places = {}
    for row, k, c, s, n, r, t in repeats.phrases(batch):
        for row, s, n in zip(row.tolist(), s.tolist(), (n + r).tolist()):
            places.setdefault(row, []).extend(range(s, s + n))
    assert {row: sorted(x) for row, x in places.items()} == {0: list(range(6000 - 99)), 1: list(range(2500 - 99))}


def test_repeats_odd_rows(spark):
    long = "".join(random.Random(3).choices("abcdefgh ", k=400))
    docs = frame(spark, [(None, long), (1, long), (1, long), (2, long + "!")])
    rows = sorted((r.doc_id is not None, r.doc_id or 0, len(r.text)) for r in repeats.without_repeats(docs).collect())
    assert rows == [(False, 0, 400), (True, 1, 0), (True, 1, 0), (True, 2, 1)]
    assert repeats.without_repeats(docs.limit(0)).columns == docs.columns and repeats.without_repeats(docs.limit(0)).count() == 0


def test_remembered_matches_share_their_numbers(vocabulary):
    encoder = bpe.Encoder(vocabulary.ranks, vocabulary.pattern)
    for text in ("zyxwvq qwvxyz", "zyxwvqx zyxwvqqq", "Ünïcödé wörds wïth mäny tökens"):
        ids = list(encoder.encode(text))
        assert encoder.decode(ids) == text.encode()
    held = [i for ids in encoder.known.values() if len(ids) > 1 for i in ids]
    assert len(held) > 10 and len({id(i) for i in held}) == len(set(held))
    assert encoder.fit and all(type(pair) is int for pair in encoder.fit)


def test_lm_scores(spark):
    texts = odd_texts()
    rows = texts + [(t, texts[t][1]) for t in (20, 20)]
    words = [common.words(t) for _, t in rows]
    one, two = {}, {}
    for w in words:
        for x in w:
            one[x] = one.get(x, 0) + 1
        for x in zip(w, w[1:]):
            two[x] = two.get(x, 0) + 1
    total = sum(one.values())
    want = []
    for (i, _), w in zip(rows, words):
        backed = sum(two[x] < 2 for x in zip(w, w[1:]))
        s = sum(np.log(two[v, x] / one[v]) if two[v, x] >= 2 else np.log(0.4 * one[x] / total) for v, x in zip(w, w[1:]))
        want.append((i, len(w), backed, round(s + (np.log(one[w[0]] / total) if w else 0), 5)))
    got = [(r.doc_id, r.n_words, r.n_backoff, round(r.log_score, 5)) for r in lm_scores.lm_scores(frame(spark, rows, extra=True)).collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-4)
    assert lm_scores.lm_scores(frame(spark, rows).limit(0)).count() == 0


def test_lm_scores_in_many_partitions_and_with_few_known_words(spark, monkeypatch):
    docs = frame(spark, odd_texts() + odd_texts()[:9], extra=True)
    want = sorted(map(str, lm_scores.whole_numbers(lm_scores.lm_scores(docs)).collect()))
    monkeypatch.setattr(lm_scores, "KNOWN", 20)
    monkeypatch.setattr(lm_scores, "PARTITION", 500)
    assert sorted(map(str, lm_scores.whole_numbers(lm_scores.lm_scores(docs)).collect())) == want


def test_a_partition_of_lm_scores_is_counted_in_little_memory():
    rng = np.random.default_rng(5)
    slices = [[rng.zipf(1.3, 500).astype(np.int64) for _ in range(600)] for _ in range(4)]
    words, counts = np.unique(np.concatenate([x for s in slices for x in s]), return_counts=True)
    total = counts.sum()
    known = tuple(x[counts > 50] for x in (words, counts))
    empty = np.zeros(lm_scores.HOT**2, np.int64)
    rows = pa.Table.from_batches([lm_scores.packed_slice(np.arange(600) + 600 * i, s, known, empty, total, 1) for i, s in enumerate(slices)])
    tracemalloc.start()
    out = lm_scores.score_part(rows, known[1], total, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # A few copies of the packed rows and what a block takes, but not a dozen columns of eight bytes for all occurrences.
    assert peak < 3 * rows.nbytes + 200 * lm_scores.BLOCK, (peak, rows.nbytes)
    assert out["ids"].combine_chunks().drop_null().to_pylist() and lm_scores.summed(out.filter(pa.compute.is_valid(out["bucket"]))).num_rows == 2400


@pytest.mark.parametrize("order", [3, 4])
def test_lm_scores_of_longer_runs(spark, order):
    rows = odd_texts() + [(20, odd_texts()[20][1])] * 2 + [(None, "a b c a b"), (300, "b c a")]
    words = [common.words(t) for _, t in rows]
    count = {}
    for w in words:
        for n in range(1, order + 1):
            for i in range(len(w) - n + 1):
                count[tuple(w[i : i + n])] = count.get(tuple(w[i : i + n]), 0) + 1
    total = sum(c for x, c in count.items() if len(x) == 1)
    want = []
    for (i, _), w in zip(rows, words):
        s, steps = 0.0, 0
        for at in range(len(w)):
            run = tuple(w[max(0, at - order + 1) : at + 1])
            while len(run) > 1 and count[run] < 2:
                run, s, steps = run[1:], s + np.log(0.4), steps + 1
            s += np.log(count[run] / (count[run[:-1]] if len(run) > 1 else total))
        want.append((-1 if i is None else i, len(w), steps, s))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_backoff, r.log_score) for r in lm_scores.lm_scores(frame(spark, rows, extra=True), order).collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-4)
    assert lm_scores.lm_scores(frame(spark, rows).limit(0), order).count() == 0


def test_mixing(spark):
    texts = [(i, "x" * (i % 50)) for i in range(3000)] + [(None, None), (None, "y")]
    docs = frame(spark, texts, extra=True)
    got = mixing.mix(docs, {"src0": 0.5, "src1": 0.25, "absent": 0.1}, rest=0.25)
    assert got.columns == [*[c for c in docs.columns if not c.startswith("mix_")], "mix_copy", "mix_order"]
    rows = got.collect()
    sizes = {}
    for r in rows:
        key = r.source if r.source in ("src0", "src1") else ""
        sizes[key] = sizes.get(key, 0) + len(r.text or "") + 1
    assert sizes["src0"] / sum(sizes.values()) == pytest.approx(0.5, abs=0.04)
    assert sizes["src1"] / sum(sizes.values()) == pytest.approx(0.25, abs=0.04)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7), {"src0": 0.5, "src1": 0.25, "absent": 0.1}, rest=0.25).collect()), key=str)
    assert mixing.mix(docs.limit(0)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_attained_weights(spark):
    docs = frame(spark, [(1, "x" * 9), (2, "y" * 89)])
    free = {r.mix_group: (r.wanted, r.attained) for r in mixing.attained(docs, {"src1": 3.0, "src2": 1.0}, 0.0, 1000.0).collect()}
    assert free == {"src1": (0.75, pytest.approx(0.75)), "src2": (0.25, pytest.approx(0.25))}
    capped = {r.mix_group: r.attained for r in mixing.attained(docs, {"src1": 3.0, "src2": 1.0}, 0.0, 2.0).collect()}
    assert capped == {"src1": pytest.approx(20 / 45), "src2": pytest.approx(25 / 45)}


def test_poisson_counts(spark):
    rates = mixing.distributions(frame(spark, [(1, "x" * 9), (2, "y")]), {"src1": 3.0, "src2": 1.0}, 0.0, 1000.0).collect()
    cdf = {r.mix_group: r.mix_cdf for r in rates}
    term, total = np.exp(-0.9), 0.0
    for k in range(10):  # src1: three quarters of 12 characters, over 10
        total += term
        assert cdf["src1"][k] == pytest.approx(total)
        term *= 0.9 / (k + 1)


def test_mixing_without_a_bound(spark):
    """A source of one short text gets its weight, however often that text must be repeated."""
    docs = frame(spark, [(1, "x" * 9), (2, "y" * 299_989)])
    rows = mixing.mix(docs, {"src1": 0.5, "src2": 0.5}, 0.0).groupBy("doc_id").count().collect()
    counts = {r.doc_id: r["count"] for r in rows}
    assert abs(counts[1] - 15_000) < 6 * 15_000**0.5 and counts.get(2, 0) < 10
    table = {r.mix_group: r for r in mixing.distributions(docs, {"src1": 0.5, "src2": 0.5}, 0.0, float("inf")).collect()}
    assert len(table["src1"].mix_cdf) < 30 * 15_000**0.5 and table["src1"].mix_first > 13_000
    assert table["src1"].mix_cdf[15_000 - table["src1"].mix_first] == pytest.approx(0.5, abs=0.01)
    copies = mixing.mix(docs, {"src1": 0.5, "src2": 0.5}, 0.0).where("doc_id = 1").select("mix_copy").collect()
    assert sorted(r.mix_copy for r in copies) == list(range(1, counts[1] + 1))


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    scored = docs.withColumn("score", quality.score(F.col("text"), model)).withColumn("out", quality.held_out(F.col("doc_id")))
    rows = scored.join(labels, "doc_id").where("out").collect()
    right = sum((r.score >= quality.THRESHOLD) == (r.quality == 1) for r in rows)
    assert len(rows) > 50 and right / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    used = {r.doc_id for r in quality.training_rows(docs, labels).collect()}
    assert not used & {r.doc_id for r in rows}
    assert quality.training_rows(docs, labels, 10).count() == 10


def test_quality_odd_rows(spark):
    docs = frame(spark, odd_texts() + [(3, "one")], extra=True)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] + [(5, None, 0), (None, 1, 0), (6, 0, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.where("quality = 1"), labels.limit(0)):
        model = quality.train(docs, some)
        rows = docs.select("*", quality.score(F.col("text"), model).alias("own")).collect()
        assert len(rows) == docs.count() and all(0 <= r.own <= 1 for r in rows)
    assert quality.train(docs.limit(0), labels).score(np.zeros((1, len(quality.FEATURES))))[0] == 0.5


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(7, 7), (None, 3)] + [(1000 + i, 1001 + i) for i in range(40)]
    links = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in common.components(links).collect()}
    known = [(a, b) for a, b in edges if a is not None and a != b]
    label = common.least_labels(1100, *map(np.array, zip(*known)))
    assert got == {n: int(label[n]) for e in known for n in e}
    assert common.components(links.limit(0)).count() == 0
