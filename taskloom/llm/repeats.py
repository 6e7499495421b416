"""Suffix-array dedup: remove every byte that lies in a string of 100 bytes which also starts earlier in the corpus.

Prefix-free parsing cuts the corpus: a rolling hash over GRAM bytes triggers a cut where it is the least of all in some
window of 100 bytes (of equals, the first). So every window has just one trigger, equal windows have it at the same place,
and no two cuts are further apart than a window. A phrase is what the windows of one trigger cover; it reaches 100 bytes and more, so the
order of two windows never depends on the phrases that follow, and the parse is ordered by (doc_id, start) alone.

1. Triggers that occur once in the corpus are dropped: no window with them repeats. Counting is combined per task.
2. Equal phrases form the dictionary; all occurrences but the earliest are repeats with all their windows.
3. Only phrases that share a trigger but differ are left. Their texts are fetched, one for each entry of the dictionary, and dealt to tasks by trigger. A task
   sorts all suffixes of its phrases, cut at 100 bytes: the suffix array of its part of the dictionary. Equal neighbours are repeats of the one that stands first in
   corpus order. A window has its trigger at one of OFFSETS places, and equal windows at the same. So the phrases of a common trigger are cut into slices by ranges of that place, each dealt with
   the bytes that all its windows share: equal windows always meet in one task, and unlike phrases part. The commoner the trigger, the narrower the ranges, down to single windows.
4. The repeated windows of a document are joined to spans, and its text is read once more without them.

A window's place is (doc_id, digest of the text, start). Rows with the same doc_id but other texts are ordered by that digest; rows
equal in both are one document, and each of them is returned. A null doc_id comes before all others. Null texts are empty; texts
of fewer than 100 bytes lose nothing. Long texts are cut in parts that overlap, which changes no result. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm.common import mixed, powers, table, written

WINDOW, GRAM = 100, 24
#: Places of a trigger in its windows.
OFFSETS = WINDOW - GRAM + 1
#: Bytes parsed at a time (below 2**20, the places that a packed trigger has room for), and phrases that a task sorts at a time.
PART, SORTED = 1 << 19, 4096
#: Stands for a null doc_id, which comes first.
NONE = -(2**63)

_LETTER, _OTHER = (mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(x)) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95))
_POWER, _INVERSE = powers(2 * PART + WINDOW)


def parsed(raw: bytes, ends: np.ndarray) -> list[np.ndarray]:
    """Phrases of documents that stand end to end: trigger, digest, first window, number of windows and the trigger's place, as places in `raw`."""
    letters = np.frombuffer(raw, np.uint8)
    n = len(raw) - WINDOW + 1
    if n <= 0:
        return [np.zeros(0, np.int64)] * 5
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(t[letters] * _POWER[: len(raw)])]) for t in (_LETTER, _OTHER)]
    gram = mixed((sums[0][GRAM:] - sums[0][:-GRAM]) * _INVERSE[: len(raw) - GRAM + 1])
    place = np.uint64((1 << 20) - 1)
    least = (gram & ~place) | np.arange(len(gram), dtype=np.uint64)
    # The least over WINDOW - GRAM + 1 places, from two ranges of a power of two that overlap.
    span, width = OFFSETS, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[span - width : span - width + n])
    trigger = (least & place).astype(np.int64)
    # Windows that cross a document's end don't count.
    document = np.searchsorted(ends, np.arange(n), "right")
    whole = np.arange(n) + WINDOW <= ends[document]
    start = np.flatnonzero(whole)
    if not len(start):
        return [np.zeros(0, np.int64)] * 5
    trigger = trigger[start]
    new = np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (start[1:] != start[:-1] + 1)])
    first = start[new]
    count = np.diff(np.concatenate([np.flatnonzero(new), [len(start)]]))
    digest = mixed((sums[1][first + count + WINDOW - 1] - sums[1][first]) * _INVERSE[first] + count.astype(np.uint64))
    return [gram[trigger[new]].view(np.int64), digest.view(np.int64), first, count, trigger[new]]


def phrases(batch: list[str | None]) -> Iterator[list[np.ndarray]]:
    """(row, trigger, digest, start, windows, again, place) of all phrases of a batch of texts, part by part.

    `place`: of the trigger, from the start. `again`: how many windows after these belong to phrases that repeat the one before them, as in a run of one letter.
    """
    held: list[tuple[int, int, bytes]] = []

    def flush() -> list[np.ndarray]:
        ends = np.cumsum([len(x) for _, _, x in held])
        trigger, digest, first, count, place = parsed(b"".join(x for _, _, x in held), ends)
        part = np.searchsorted(ends, first, "right")
        rows, base = (np.array([x[i] for x in held], np.int64)[part] for i in (0, 1))
        start = first - np.concatenate([[0], ends])[part] + base
        new = np.ones(len(first), bool)
        new[1:] = (trigger[1:] != trigger[:-1]) | (digest[1:] != digest[:-1]) | (start[1:] != start[:-1] + count[:-1]) | (rows[1:] != rows[:-1])
        at = np.flatnonzero(new)
        total = np.add.reduceat(count, at) if len(at) else count
        return [rows[at], trigger[at], digest[at], start[at], count[at], total - count[at], (place - first)[at]]

    size = 0
    for row, text in enumerate(batch):
        raw = text.encode() if text else b""
        if len(raw) < WINDOW:
            continue
        for a in range(0, len(raw) - WINDOW + 1, PART):
            piece = raw[a : a + PART + WINDOW - 1]
            if held and size + len(piece) > PART + WINDOW:
                yield flush()
                held, size = [], 0
            held.append((row, a, piece))
            size += len(piece)
    if held:
        yield flush()


def parse(docs: DataFrame) -> DataFrame:
    """(k, c, d, h, s, n, r, t) of every phrase: trigger, digest, document, start, windows, windows that repeat it at once, and the trigger's place."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, *columns in phrases(batch["text"].to_pylist()):
                doc = [batch[c].take(pa.array(rows)) for c in ("d", "h")]
                k, c, s, n, r, t = (pa.array(x, kind) for x, kind in zip(columns, [pa.int64()] * 2 + [pa.int32()] * 4))
                yield pa.RecordBatch.from_arrays([k, c, *doc, s, n, r, t], ["k", "c", "d", "h", "s", "n", "r", "t"])

    return docs.select("d", "h", "text").mapInArrow(read, "k long, c long, d long, h long, s int, n int, r int, t int")


def slices(raw: bytes, s: int, n: int, t: int, ranges: int) -> Iterator[tuple[int, int, int]]:
    """(key, first, windows) for the phrase of n windows from s with its trigger t further, cut by the trigger's place in the window into so many ranges.

    The key tells the range and the bytes that every window with the trigger in that range has, if it is equal to one of these."""
    if ranges == 1:
        yield 0, s, n
        return
    width = -(-OFFSETS // ranges)
    for low in range(0, OFFSETS, width):
        high = min(low + width, OFFSETS) - 1
        # The window i after s has the trigger at t - i.
        first, last = max(0, t - high), min(n - 1, t - low)
        if first <= last:
            shared = raw[s + t - low : s + t - high + WINDOW]
            yield xxhash.xxh3_64_intdigest(shared, low) - 2**63, s + first, last - first + 1


def runs(place: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of consecutive places of one document."""
    edge = (place[1:] != place[:-1] + 1) | (document[1:] != document[:-1])
    return np.flatnonzero(np.concatenate([[True], edge])), np.flatnonzero(np.concatenate([edge, [True]]))


def sorted_windows(rows: pd.DataFrame) -> pd.DataFrame:
    """Repeats among all windows of these phrases, as spans."""
    rows = rows.sort_values(["d", "h", "s"], ignore_index=True)
    lengths = rows["raw"].map(len).to_numpy() - WINDOW + 1
    letters = np.frombuffer(b"".join(rows["raw"]), np.uint8)
    begin = np.cumsum(lengths + WINDOW - 1) - (lengths + WINDOW - 1)
    owner = np.repeat(np.arange(len(rows)), lengths)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    suffixes = np.lib.stride_tricks.sliding_window_view(letters, WINDOW)[begin[owner] + offset]
    suffixes = np.ascontiguousarray(suffixes).view(f"V{WINDOW}")[:, 0].view(f"S{WINDOW}")
    # S compares like bytes but for zeros at the end, so those windows are told apart by their length without them.
    size = np.char.str_len(suffixes)
    order = np.lexsort((np.arange(len(owner)), size, suffixes))
    same = np.concatenate([[False], (suffixes[order][1:] == suffixes[order][:-1]) & (size[order][1:] == size[order][:-1])])
    repeat = np.zeros(len(owner), bool)
    repeat[order] = same
    d, h, start = rows["d"].to_numpy()[owner], rows["h"].to_numpy()[owner], rows["s"].to_numpy()[owner] + offset
    at = np.flatnonzero(repeat)
    a, b = runs(start[at], owner[at]) if len(at) else (at, at)
    return pd.DataFrame({"d": d[at][a], "h": h[at][a], "a": start[at][a], "b": start[at][b] + WINDOW})


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(d, h, spans) of the documents (d, h, text) with repeats: [a, b) in bytes, which may overlap."""
    again = parse(docs).groupBy("k").agg(F.sum(F.when(F.col("r") > 0, 2).otherwise(1)).alias("times")).where("times > 1").select("k")
    found = written(parse(docs).join(again, "k"), "repeat-phrases")
    place = F.struct("d", "h", "s")
    entries = written(found.groupBy("k", "c").agg(F.min(F.struct("d", "h", "s", "n", "t")).alias("first")), "repeat-dictionary")

    # All occurrences but the first, and what repeats an occurrence at once.
    later = found.join(entries, ["k", "c"]).withColumn("a", F.when(place == F.struct("first.d", "first.h", "first.s"), F.col("s") + F.col("n")).otherwise(F.col("s")))
    spans = later.withColumn("e", F.col("s") + F.col("n") + F.col("r")).where("e > a").select("d", "h", "a", (F.col("e") + WINDOW - 1).alias("b"))

    g = F.col("g")
    ranges = F.when(g <= SORTED, 1).when(g <= SORTED * 64, 8).otherwise(OFFSETS)
    differ = entries.groupBy("k").agg(F.count("*").alias("g")).where("g > 1").select("k", ranges.alias("ranges"))
    wanted = entries.join(differ, "k").select("k", "ranges", "first.*")
    by_document = wanted.groupBy("d", "h").agg(F.collect_list(F.struct("k", "ranges", "s", "n", "t")).alias("wanted"))
    by_document = written(by_document, "repeat-wanted")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, h, text, want in zip(b["d"], b["h"], b["text"], b["wanted"]):
                raw = text.encode()
                for x in want:
                    out += [(x["k"], key, d, h, s, raw[s : s + n + WINDOW - 1]) for key, s, n in slices(raw, x["s"], x["n"], x["t"], x["ranges"])]
            yield pd.DataFrame(out, columns=["k", "key", "d", "h", "s", "raw"])

    # Rows that the table repeats give the same texts again.
    texts = docs.join(by_document, ["d", "h"]).mapInPandas(cut, "k long, key long, d long, h long, s int, raw binary").dropDuplicates(["k", "d", "h", "s"])
    texts = written(texts, "repeat-texts")
    buckets = texts.agg(F.count("*")).first()[0] // SORTED + 1
    dealt = texts.withColumn("bucket", F.pmod(F.xxhash64("k", "key"), F.lit(buckets)))
    found = dealt.groupBy("bucket").applyInPandas(sorted_windows, "d long, h long, a int, b int")
    spans = spans.unionByName(found)
    return spans.groupBy("d", "h").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def keyed(docs: DataFrame) -> DataFrame:
    """With the place of each document in the corpus: `d` and `h`."""
    return docs.withColumns({"d": F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE).cast("long")), "h": F.xxhash64("text")})


def merged_spans(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in spans) if spans is not None else ():
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def kept_bytes(text: str | None, spans) -> tuple[bytes, int, int]:
    """The bytes outside the spans, how many are removed, and in how many runs."""
    raw, cut = text.encode() if text else b"", merged_spans(spans)
    kept, end = [], 0
    for a, b in cut:
        kept.append(raw[end:a])
        end = b
    kept.append(raw[end:])
    return b"".join(kept), sum(b - a for a, b in cut), len(cut)


def with_spans(docs: DataFrame) -> DataFrame:
    """The documents as they are, with `spans`, null where nothing repeats; columns of these names are replaced."""
    docs = keyed(docs.drop("d", "h", "spans"))
    return docs.join(repeated_spans(docs.select("d", "h", "text")), ["d", "h"], "left").drop("d", "h")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with the text that is left; bytes of letters that were cut in two are dropped."""

    def left(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else kept_bytes(t, s)[0].decode(errors="ignore") for t, s in zip(texts, spans)], dtype=object)

    return with_spans(docs).withColumn("text", F.pandas_udf(left, "string")("text", "spans")).drop("spans")


def digests(text: Column, spans: Column) -> Column:
    def read(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(texts, spans):
            kept, removed, n = kept_bytes(t, s)
            out.append((len(kept) + removed, removed, n, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return F.pandas_udf(read, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")(text, spans)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", digests(F.col("text"), F.col("spans")).alias("x")).select("doc_id", "x.*")
