"""Substring dedup by words: a word goes if it lies in a run of 13 words that also stands in a document with a smaller doc_id.

Difference-cover anchors: of a document's runs of ANCHOR words only those at places in COVER modulo PERIOD are hashed, three of seven. Every remainder
is a difference of two places of the cover, so for any two places in two documents some step below PERIOD takes both to a cover place; and a
match of 13 words holds the whole anchor there. So two documents that share a window share an aligned anchor.

1. Anchors are dealt by hash. Those that two documents hold are sent back to all documents that hold them.
2. Each shared anchor is extended to the seven windows that contain it, and these are dealt by hash. The least doc_id of a window tells which of its
   other documents repeat it; so a group of copies needs as many rows as it has windows, no pairs.
3. A document is told its repeated windows, and its words are read once more without those they cover.

Before both exchanges the rows of FLUSH bytes of text are combined: equal anchors or windows travel in one row with all their documents, so an anchor
that stands in every document is as many rows as there are such portions. The texts are compressed and dealt by document once; both passes read the same exchange.

An anchor has 48 bits, which can only make more windows be looked at; a window is told apart by 96, and by 64 among those of one document. Rows with the same doc_id
travel together, don't count against each other, whatever their texts, and lose the same windows. A null doc_id is smaller than all others: such rows lose
nothing, and others lose what these have. Null, empty and blank texts have no words; texts of fewer than 13 words lose nothing. Texts
of any length are read whole. Other columns are kept as they are, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskloom.llm.common import among, letter_words, runs_of, table, word_hashes

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
#: The longest anchor that fits into a window wherever the step takes it.
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text whose rows are combined before an exchange; at most 2 ** 16 texts.
FLUSH = 1 << 23
#: Stands for a null doc_id, which comes first.
NONE = -(2**63)

_ONE, _OTHER = letter_words(0x9E3779B97F4A7C15, False), letter_words(0xD1342543DE82EF95, False)
_COVERED = np.isin(np.arange(PERIOD), COVER)


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows, so many at a time that their texts have FLUSH bytes, or one longer text."""
    held, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            held.append(row)
            size += len(row["text"] or "")
            if size >= FLUSH or len(held) == 1 << 16:
                yield held
                held, size = [], 0
    if held:
        yield held


class Words:
    """The words of several texts, end to end: hashes, the text each is from, and its place there."""

    def __init__(self, texts: list[str | None]):
        self.texts = texts
        each = list(word_hashes(texts, _ONE))
        count = np.array([len(x) for x in each], np.int64)
        self.hashes = np.concatenate(each)
        self.text = np.repeat(np.arange(len(texts)), count)
        self.place = np.arange(len(self.hashes)) - np.repeat(np.cumsum(count) - count, count)

    def whole(self, width: int) -> np.ndarray:
        """Whether the run of `width` words from each place stays in its text."""
        n = max(0, len(self.text) - width + 1)
        return self.text[:n] == self.text[width - 1 : width - 1 + n]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Where anchors start, and their hashes."""
        whole = self.whole(ANCHOR)
        at = np.flatnonzero(whole & _COVERED[self.place[: len(whole)] % PERIOD])
        return at, runs_of(self.hashes, ANCHOR)[at] >> np.uint64(16)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        other = np.concatenate(list(word_hashes(self.texts, _OTHER)))
        return runs_of(self.hashes, WINDOW), runs_of(other, WINDOW)


def combined(hashes: list[np.ndarray], documents: np.ndarray, names: list[str]) -> pa.RecordBatch | None:
    """A row for each combination of hashes: the least of its documents, and the others, null if there are none."""
    order = np.lexsort((documents, *hashes[::-1]))
    rows = [x[order] for x in (*hashes, documents)]
    if not len(order):
        return None
    differs = [np.concatenate([[True], x[1:] != x[:-1]]) for x in rows]
    of_hash = np.logical_or.reduce(differs[:-1])
    new = of_hash | differs[-1]
    rows, of_hash = [x[new] for x in rows], of_hash[new]
    first = np.flatnonzero(of_hash)
    size = np.diff(np.append(first, len(of_hash))) - 1
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
    others = pa.ListArray.from_arrays(offsets, pa.array(rows[-1][~of_hash]), mask=pa.array(size == 0))
    # By document, not by hash: an exchange then packs equal documents that follow each other.
    by_document = pa.array(np.argsort(rows[-1][first], kind="stable"))
    return pa.RecordBatch.from_arrays([*[pa.array(x[first]).take(by_document) for x in rows], others.take(by_document)], names)


def anchors(docs: DataFrame) -> DataFrame:
    """(k, d, others): an anchor, the least d of a portion that has it, and the others."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in portions(batches):
            words = Words([r["text"] for r in rows])
            at, k = words.anchors()
            d = np.array([r["d"] for r in rows], np.int64)[words.text[at]]
            if out := combined([k.view(np.int64)], d, ["k", "d", "others"]):
                yield out

    return docs.select("d", "text").mapInArrow(read, "k long, d long, others array<long>")


def windows(docs: DataFrame) -> DataFrame:
    """(w, v, o, others): a window's hashes, the least doc_id of a portion that has it, and the others."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in portions(batches):
            rows = [r for r in rows if r["shared"]]
            if not rows:
                continue
            words = Words([unpacked(r["text"]) for r in rows])
            at, k = words.anchors()
            own = np.repeat(np.arange(len(rows), dtype=np.uint64), [len(r["shared"]) for r in rows]) << np.uint64(48)
            wanted = np.concatenate([np.array(r["shared"], np.int64) for r in rows]).view(np.uint64) | own
            at = at[among(k | (words.text[at].astype(np.uint64) << np.uint64(48)), np.sort(wanted))]
            whole = words.whole(WINDOW)
            edge = np.zeros(len(words.text) + 2, np.int64)
            np.add.at(edge, np.maximum(at - (PERIOD - 1), 0), 1)
            np.add.at(edge, at + 1, -1)
            # A place before the text's first window is in another text, where no whole window is.
            start = np.flatnonzero((np.cumsum(edge)[: len(whole)] > 0) & whole)
            w, v = words.windows()
            o = np.array([r["o"] for r in rows], np.int64)[words.text[start]]
            if out := combined([w[start].view(np.int64), (v[start] >> np.uint64(32)).astype(np.uint32).view(np.int32)], o, ["w", "v", "o", "others"]):
                yield out

    return docs.mapInArrow(read, "w long, v int, o long, others array<long>")


def packed(texts: pd.Series) -> pd.Series:
    zip_ = zstandard.ZstdCompressor(level=1)
    return pd.Series([None if t is None else zip_.compress(t.encode()) for t in texts], dtype=object)


def unpacked(text: bytes | None) -> str | None:
    return None if text is None else zstandard.decompress(text).decode()


def of_all(keys: list[str], rows: DataFrame, document: str) -> DataFrame:
    """The rows with the least and the greatest of their keys' documents, and all documents of the row as `documents`."""
    together = Window.partitionBy(*keys)
    known = rows.withColumns({"lo": F.min(document).over(together), "hi": F.max(document).over(together)})
    return known.withColumn("documents", F.concat(F.array(document), F.coalesce("others", F.expr("cast(array() AS array<long>)"))))


def with_passages(docs: DataFrame) -> DataFrame:
    """(row, text, passages): every row in a struct, its text compressed, and the hashes of its repeated windows; null where there are none."""
    text, number = F.col("row.text").cast("string"), F.col("row.doc_id").cast("long")
    whole = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    others = [F.col("row").getField(c).alias(c) for c in docs.columns if c != "text"]
    # Rows without a doc_id are told apart by their text; d is never null.
    rows = docs.select(whole.alias("row")).select(F.coalesce(number, F.xxhash64(text)).alias("d"), text.alias("text"), F.struct(*others).alias("row"))
    dealt = rows.withColumn("text", F.pandas_udf(packed, "binary")("text"))

    held = of_all(["k"], anchors(rows.select("d", "text")), "d")
    shared = held.where("lo < hi OR others IS NOT NULL").select("k", F.explode("documents").alias("d"))
    shared = shared.groupBy("d").agg(F.collect_list("k").alias("shared"))

    known = F.col("row.doc_id").cast("long")
    found = dealt.join(shared, "d", "left").select("shared", "text", F.coalesce(known, F.lit(NONE)).alias("o"))
    later = of_all(["w", "v"], windows(found), "o").select("w", F.explode(F.filter("documents", lambda o: o > F.col("lo"))).alias("d"))
    marks = later.groupBy("d").agg(F.collect_list("w").alias("passages"))

    # The join above has the same key, so both read one exchange of the texts.
    marked = dealt.join(marks, "d", "left")
    return marked.select("row", "text", F.when(known.isNotNull(), F.col("passages")).alias("passages"))


def kept_words(text: str | None, passages) -> tuple[list[bytes], int]:
    """The words that no repeated window covers, and how many there were."""
    words = text.encode().split() if text else []
    if passages is None:
        return words, len(words)
    hashes = runs_of(next(word_hashes([text], _ONE)), WINDOW)
    at = np.flatnonzero(among(hashes, np.sort(np.asarray(passages, np.int64).view(np.uint64))))
    edge = np.zeros(len(words) + 1, np.int64)
    edge[at] += 1
    edge[at + WINDOW] -= 1
    return [w for w, n in zip(words, np.cumsum(edge).tolist()) if not n], len(words)


def without_passages(docs: DataFrame) -> DataFrame:
    """The rows as they are, but for `text`: the words that are left, joined by a blank, where some were removed."""

    @F.pandas_udf("string")
    def read(texts: pd.Series, passages: pd.Series) -> pd.Series:
        out = []
        for t, p in zip(map(unpacked, texts), passages):
            out.append(t if p is None else b" ".join(kept_words(t, p)[0]).decode())
        return pd.Series(out, dtype=object)

    rows = with_passages(docs).withColumn("text", read("text", "passages"))
    return rows.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string")
    def read(texts: pd.Series, passages: pd.Series) -> pd.DataFrame:
        each = [kept_words(unpacked(t), p) for t, p in zip(texts, passages)]
        out = [(n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) for kept, n in each]
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])

    return with_passages(docs).select("row.doc_id", read("text", "passages").alias("x")).select("doc_id", "x.*")


def op12_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH words AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    starts AS (SELECT row, doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM words),
    runs AS (SELECT row, doc_id, i, array_to_string(w[i:i + 12], ' ') AS run FROM starts),
    least AS (SELECT run, min(coalesce(doc_id, -9223372036854775808)) AS doc_id FROM runs GROUP BY run),
    repeats AS (SELECT r.row, r.i FROM runs r JOIN least l USING (run) WHERE l.doc_id < r.doc_id),
    covered AS (SELECT DISTINCT row, i + j AS at FROM repeats, (SELECT unnest(generate_series(0, 12)) AS j)),
    each AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM words),
    kept AS (SELECT e.row, string_agg(e.word, ' ' ORDER BY e.at) AS words, count(*) AS n FROM each e ANTI JOIN covered c ON c.row = e.row AND c.at = e.at GROUP BY e.row)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (row)"""
