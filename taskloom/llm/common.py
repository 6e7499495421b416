"""What several operators share: tables, words, digests, and connected components."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, computed once, as a table in the shared folder; survives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than ASCII blanks, with A-Z in lower case."""
    return text.encode().lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finisher of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BLANK = np.isin(np.arange(256), list(b" \t\n\r\v\f"))
_BASE = np.uint64(0x9E3779B97F4A7C13)  # odd, so it has an inverse; 3 modulo 8
#: Bytes that are hashed at a time.
_CHUNK = 1 << 19


def letter_words(seed: int, fold: bool) -> np.ndarray:
    """A random-looking word for each byte; with `fold`, the same for A-Z and a-z."""
    out = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(seed))
    if fold:
        out[65:91] = out[97:123]
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and their inverses."""
    out = [np.full(n, x, np.uint64) for x in (int(_BASE), pow(int(_BASE), -1, 2**64))]
    for x in out:
        x[:1] = 1
        np.multiply.accumulate(x, out=x)
    return out[0], out[1]


_LETTER = letter_words(0x9E3779B97F4A7C15, True)
_POWER, _INVERSE = powers(_CHUNK + 1)


def _hashed(raw: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the start of every word: a polynomial in its letters, from sums over all bytes before its ends."""
    global _POWER, _INVERSE
    if len(raw) >= len(_POWER):
        _POWER, _INVERSE = powers(len(raw) + 1)
    letters = np.frombuffer(raw, np.uint8)
    edge = np.concatenate([[True], _BLANK[letters], [True]])
    starts, ends = np.flatnonzero(edge[:-1] & ~edge[1:]), np.flatnonzero(~edge[:-1] & edge[1:])
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[letters] * _POWER[: len(raw)], out=sums[1:])
    # `edge` is one place ahead of `letters`.
    return mixed((sums[ends] - sums[starts]) * _INVERSE[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(texts: Iterable[str | None], table: np.ndarray = _LETTER) -> Iterator[np.ndarray]:
    """For each text, the 64-bit hashes of its words in order; words are as in `words`, or case counts if the table of letters tells it."""
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        hashes, starts = _hashed(b" ".join(held), table)
        at = np.cumsum([len(x) + 1 for x in held])
        yield from np.split(hashes, np.searchsorted(starts, at[:-1]))

    for text in texts:
        raw = text.encode() if text else b""
        if held and size + len(raw) >= _CHUNK:
            yield from flush()
            held, size = [], 0
        if len(raw) < _CHUNK:
            held.append(raw)
            size += len(raw) + 1
            continue
        parts, start = [], 0
        while start < len(raw):
            # A long text is cut at a blank; only a word longer than a chunk makes a longer part.
            found = re.compile(rb"[ \t\n\r\v\f]").search(raw, start + _CHUNK // 2)
            end = found.start() if found else len(raw)
            parts.append(_hashed(raw[start:end], table)[0])
            start = end
        yield np.concatenate(parts)
    if held:
        yield from flush()


def runs_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of the run of `width` words that starts at each place, as far as there are so many."""
    n = max(0, len(hashes) - width + 1)
    out = hashes[:n].copy()
    for i in range(1, width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return mixed(out + np.uint64(width))


def shingle_sets(texts: Iterable[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its runs of `width` words; a shorter text is one run; no words, none."""
    for hashes in word_hashes(texts):
        n = min(width, len(hashes))
        if not n:
            yield hashes
            continue
        out = hashes[: len(hashes) - n + 1]
        for i in range(1, n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(out)]
        out = np.sort(mixed(out + np.uint64(n)))
        yield out[np.concatenate([[True], out[1:] != out[:-1]])]


def among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted keys."""
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For 0..n-1, the least number reachable by the links a-b."""
    return join_labels(np.arange(n), a, b)


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`label` (each number's least known neighbour) after the links a-b are added."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the links: root is the least node that can be reached.

    Alternates the large-star and small-star steps until nothing changes. Each step is an aggregate and
    a join on the node, so a node with very many links is combined before the shuffle and its join
    can be split. Null ends are ignored; repeated links and self-links don't matter. No links: no rows.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # Every node of `large` is above its neighbour, so the neighbours of u are its smaller ones.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")
        )
        now = written(small.select("x.u", "x.v").where("u <> v").distinct(), "links")
        seen = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("xxhash64(u, v) % 1000000007"))).first()
        if seen == before or seen[0] == 0:
            break
        before = seen
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
