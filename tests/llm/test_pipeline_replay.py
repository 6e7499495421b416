"""The corpus pipeline against a replay of all its stages in plain Python."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from taskloom.llm import bpe, common, mixing, quality

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def one_of_each_group(rows):
    sets = [shingles(r["text"]) for r in rows]
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b)]
    label = common.least_labels(len(rows), *(np.array([p[k] for p in near], int) for k in (0, 1)))
    return [r for i, r in enumerate(rows) if not sets[i] or r["doc_id"] == min(x["doc_id"] for x, g in zip(rows, label) if g == label[i])]


def without_repeats(rows):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        raw = (r["text"] or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            gone[k : k + 100] |= raw[k : k + 100] in seen
            seen.add(raw[k : k + 100])
        out.append({**r, "text": np.frombuffer(raw, np.uint8)[~gone].tobytes().decode(errors="ignore")})
    return out


def copies(rows):
    """How often each row stands in the mix: the inverse of the Poisson distribution at a hashed number."""
    group = lambda r: r["source"] if r["source"] in mixing.WEIGHTS else ""
    size = {}
    for r in rows:
        size[group(r)] = size.get(group(r), 0) + len(r["text"]) + 1
    weight = {g: mixing.WEIGHTS.get(g, mixing.REST) for g in size}
    out = []
    for r in rows:
        g = group(r)
        rate = weight[g] / sum(weight.values()) * sum(size.values()) / size[g]
        u = int(hashlib.md5(f"{mixing.SEED}|{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        n, term = 0, math.exp(-rate)
        below = term
        while below <= u:
            n += 1
            term *= rate / n
            below += term
        out += [r] * n
    return out


@pytest.fixture(scope="module")
def tokenizer():
    vocabulary = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_every_stage(spark, tokenizer):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = [r.asDict() for r in docs.collect()]
    model = quality.train(docs, labels)
    scores = model.score(np.array([quality.features(r["text"]) for r in rows]))
    rows = [r for r, s in zip(rows, scores) if s >= quality.THRESHOLD]
    kept = one_of_each_group(rows)
    assert len(kept) < len(rows) < docs.count()
    mixed = copies(without_repeats(kept))
    want = []
    for r in mixed:
        ids = tokenizer.encode_ordinary(r["text"])
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
