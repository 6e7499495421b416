"""Language-model scores: stupid backoff over runs of up to `order` words counted in the corpus itself.

A word after v scores c(v w) / c(v) if the pair occurs at least MIN_COUNT times in the corpus, else ALPHA * c(w) / N, and a document's first
word c(w) / N; N is the number of words, and counts are over all documents. With a higher order, the longest run first: c(u v w) / c(u v) if the run
occurs MIN_COUNT times, else ALPHA times the score by the shorter context. A document's score is the sum of the logarithms, n_backoff how often ALPHA counts in it.

Runs of three words and more are added to the pairs' sums. As a run in the table has its parts there too, it changes its last word's logarithm
by ln c(run) - ln c(without the last) - ln c(without the first) + ln c(without both); a run that is not in the table, by ln ALPHA. The counts of
runs are combined per task and partitioned by the run's hash; the occurrences, the exploded runs per document, are joined to the changes as
tables, so no task needs all occurrences of a run.

The count tables are partitioned by a hash of a word. Words with more than N / HOT occurrences are HOT at most, and pairs of two such words HOT * HOT
at most: these counts are combined per task, sent to every worker, and need no partition. Every other word makes up at
most one part in HOT of the text, so no partition gets heavy: it takes all occurrences of its words as predicted words, with their contexts, and as contexts of common words.
There the pairs are counted, and the occurrences, the exploded n-grams, are joined to the counts and summed per document. The counts of words with more than
N / KNOWN occurrences, KNOWN at most, are on every worker. If a pair in the table has a rarer context, c(v) lies in another partition; such occurrences, summed per word and document, are joined to the table of words.
Occurrences travel as packed arrays, so the one large shuffle is of about a dozen bytes a word. A partition is read packed, and unpacked and counted by blocks of its words.
Its sums go, packed as well, to as many buckets of documents, where they are added up.

Words are runs of bytes other than ASCII blanks, with A-Z in lower case, told apart by 64-bit hashes. Texts of any length are read whole. Null, empty and blank texts have no words and a score of 0. Repeated rows
count as documents of their own, each with its score. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm.common import mixed, table, word_hashes, written

ALPHA, MIN_COUNT, HOT = 0.4, 2, 1000
#: Words with more than N / KNOWN occurrences, KNOWN at most, have their counts sent to every worker.
KNOWN = 1_000_000
#: Bytes of text that are packed at a time, what a row counts beside its text, occurrences in a partition, and those counted at a time.
SLICE, ROW, PARTITION, BLOCK = 4_000_000, 64, 1_500_000, 200_000
#: The context of a first word, and of a word whose count is not on every worker.
FIRST, RARE = -1, -2


def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of a batch of bounded size, with the word hashes of each text."""
    lengths = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    # A row counts as ROW bytes more, so that a slice has fewer than 2**16 rows.
    part = np.cumsum(lengths + ROW) // SLICE
    for p in np.unique(part):
        at = np.flatnonzero(part == p)
        rows = batch.slice(at[0], len(at))
        yield rows, [x.view(np.int64) for x in word_hashes(rows["text"].to_pylist())]


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words, the document of each, and whether it's the first there."""
    words = np.concatenate([np.zeros(0, np.int64), *texts])
    document = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    first = np.ones(len(words), bool)
    first[1:] = document[1:] != document[:-1]
    return words, document, first


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch):
                found = np.unique(joined(texts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["word", "c"])

    return docs.select("text").mapInArrow(count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def runs(texts: list[np.ndarray], order: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """For each length from 2 to `order`: the documents of all runs of so many words, and the hashes of the run, of it without its last, its first, and both."""
    words, document, first = joined(texts)
    place = np.arange(len(words)) - np.maximum.accumulate(np.where(first, np.arange(len(words)), 0))
    held = [np.zeros(len(words), np.uint64), words.view(np.uint64)]
    for n in range(2, order + 1):
        whole = np.zeros(len(words), np.uint64)
        whole[1:] = mixed(held[n - 1][:-1] * np.uint64(0x9E3779B97F4A7C15) + held[1][1:] + np.uint64(n))
        held.append(whole)
        at = np.flatnonzero(place >= n - 1)
        yield n, document[at], [x.view(np.int64) for x in (whole[at], held[n - 1][at - 1], held[n - 1][at], held[n - 2][at - 1])]


def run_counts(docs: DataFrame, order: int) -> DataFrame:
    """(n, run, head, tail, middle, c) of the runs of 2 to `order` words that occur MIN_COUNT times over all documents; of pairs, no parts."""
    schema = "n int, run long, head long, tail long, middle long, c long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch):
                for n, _, (run, *parts) in runs(texts, order):
                    _, at, c = np.unique(run, return_index=True, return_counts=True)
                    parts = [x[at] if n > 2 else np.zeros(len(at), np.int64) for x in parts]
                    columns = [pa.array(np.full(len(at), n), pa.int32()), *[pa.array(x, pa.int64()) for x in (run[at], *parts, c)]]
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    # Rows of one run have the same parts.
    same = [F.min(x).alias(x) for x in ("n", "head", "tail", "middle")]
    counted = docs.select("text").mapInArrow(count, schema).groupBy("run").agg(*same, F.sum("c").alias("c"))
    return counted.where(F.col("c") >= MIN_COUNT).select("n", "run", "head", "tail", "middle", "c")


def run_scores(docs: DataFrame, words: DataFrame, order: int) -> DataFrame:
    """(id, score, words, backoffs, copies): what runs of 3 to `order` words add to the sums of the pairs."""
    counted = written(run_counts(docs, order), "lm-runs")
    log = F.log(F.col("c").cast("double"))
    known = counted.select(F.col("run").alias("part"), log.alias("log_c")).unionByName(words.select(F.col("word").alias("part"), log.alias("log_c")))
    change = counted.where("n > 2").select("run", "head", "tail", "middle", log.alias("change"))
    for part, sign in (("head", -1), ("tail", -1), ("middle", 1)):
        change = change.join(known.withColumnRenamed("part", part), part).withColumn("change", F.col("change") + sign * F.col("log_c")).drop("log_c")
    changes = written(change.select("run", "change"), "lm-changes")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                ids = rows["id"].to_numpy()
                for n, document, (run, *_) in runs(texts, order):
                    if n > 2:
                        order_ = np.lexsort((run, document))
                        d, r = document[order_], run[order_]
                        at = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (r[1:] != r[:-1])])[: len(d)])
                        times = np.diff(np.append(at, len(d)))
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids[d[at]], r[at], times)], ["id", "run", "times"])

    found = docs.select("id", "text").mapInArrow(read, "id long, run long, times long").join(changes, "run", "left")
    none = F.lit(0).cast("long")
    return found.groupBy("id").agg(
        F.sum(F.col("times") * F.coalesce("change", F.log(F.lit(ALPHA)))).alias("score"), F.max(none).alias("words"),
        F.sum(F.when(F.col("change").isNull(), F.col("times")).otherwise(none)).alias("backoffs"), F.max(none).alias("copies"),
    )


def places(words: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The place of each word among the held ones, which are sorted, or RARE."""
    if not len(held):
        return np.full(len(words), RARE)
    at = np.minimum(np.searchsorted(held, words), len(held) - 1)
    return np.where(held[at] == words, at, RARE)


def hot_pairs(docs: DataFrame, hot) -> DataFrame:
    """(pair, c) of neighbours that are both hot; pair is the first's place * HOT + the second's."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch):
                words, _, first = joined(texts)
                at = places(words, hot.value)
                both = ~first[1:] & (at[1:] >= 0) & (at[:-1] >= 0)
                found = np.unique(at[:-1][both] * HOT + at[1:][both], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["pair", "c"])

    return docs.select("text").mapInArrow(count, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))


def hot_places(counts: np.ndarray, total: int) -> np.ndarray:
    """For each known word its place among the hot ones, or RARE."""
    hot = counts * HOT > total
    return np.where(hot, np.cumsum(hot) - 1, RARE)


PACKED = "part int, first int, words binary, others binary, rare binary, rows binary, ids binary"
#: Sums of documents by bucket, packed: ids, scores, numbers of backoffs, and for whole documents of words, too. Or, with no bucket, what is owed: an id, a context and how often.
SUMS = "bucket int, ids binary, scores binary, backoffs binary, words binary, id long, context long, times long"
SCORED = "id long, score double, words long, backoffs long, copies long"


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def packed_slice(ids: np.ndarray, texts: list[np.ndarray], known: tuple[np.ndarray, np.ndarray], pairs: np.ndarray, total: int, parts: int) -> pa.RecordBatch:
    """Occurrences of a slice by partition, packed: words (hashes), others (place among the known words, FIRST or RARE), rare (hashes of
    the others that are RARE, in order), rows (of ids), ids of documents.

    The first `first` words are predicted, others are their contexts; the remaining words are contexts of others, which are hot.
    One more row, of part and first -1, has what needs no partition, per document: words holds scores, others numbers of words, rows numbers of backoffs.
    """
    held, counts = known
    words, document, first = joined(texts)
    at = places(words, held)
    hot = (hot_places(counts, total) if len(held) else np.full(1, RARE))[np.maximum(at, 0)]
    hot[at < 0] = RARE
    after, before = ~first[1:], np.append(np.full(min(len(at), 1), FIRST), at[:-1])
    before[first] = FIRST
    hot_before = np.append(np.full(min(len(at), 1), RARE), hot[:-1])
    hot_before[first] = RARE

    plain = np.flatnonzero((hot >= 0) & (first | (hot_before >= 0)))
    begins, h, v = first[plain], hot[plain], hot_before[plain]
    c = np.where(begins, 0, pairs[np.maximum(v, 0) * HOT + h])
    in_table = c >= MIN_COUNT
    of_context = counts[np.maximum(before[plain], 0)]
    s = np.where(in_table, np.maximum(c, 1) / np.maximum(of_context, 1), counts[at[plain]] / total * np.where(begins, 1, ALPHA))
    n = len(texts)
    sums = np.bincount(document[plain], np.log(s), n)
    backed = np.bincount(document[plain], ~in_table & ~begins, n).astype(np.int64)
    out = [(int(ids[0] % parts), -1, sums.tobytes(), np.bincount(document, minlength=n).astype(np.int64).tobytes(), b"", backed.tobytes(), ids.tobytes())]

    predicted = np.flatnonzero(hot < 0)
    contexts = np.flatnonzero(after & (hot[1:] >= 0) & (hot_before[1:] < 0))
    sides = []
    for place, other_at, other in ((predicted, before[predicted], predicted - 1), (contexts, at[contexts + 1], contexts + 1)):
        key = mixed(words[place].view(np.uint64))
        order = np.argsort(key)
        sides.append((dealt(key[order], parts), words[place[order]], other_at[order].astype(np.int32), words[other[order]], document[place[order]]))
    found = np.unique(np.concatenate([x[0][np.flatnonzero(np.diff(x[0], prepend=-1))] for x in sides]))
    cuts = [list(zip(*(np.searchsorted(x[0], found, side) for side in ("left", "right")))) for x in sides]
    for p, *spans in zip(found, *cuts):
        w, o, r, d = (np.concatenate([x[k][i:j] for x, (i, j) in zip(sides, spans)]) for k in range(1, 5))
        seen = np.zeros(n, bool)
        seen[d] = True
        present = np.flatnonzero(seen)
        row = np.searchsorted(present, d).astype(np.uint16)
        out.append((int(p), int(spans[0][1] - spans[0][0]), w.tobytes(), o.tobytes(), r[o == RARE].tobytes(), row.tobytes(), ids[present].tobytes()))
    types = pa.int32(), pa.int32(), *[pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names(PACKED))


def pack(docs: DataFrame, known, pairs, total: int, parts: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                yield packed_slice(rows["id"].to_numpy(), texts, known.value, pairs.value, total, parts)

    return docs.select("id", "text").mapInArrow(read, PACKED)


def tally(*columns: np.ndarray) -> np.ndarray:
    """For each row, how many rows are equal to it."""
    x = columns[0].view(np.uint64)
    for c in columns[1:]:
        x = mixed(x) * np.uint64(0x9E3779B97F4A7C15) + c.view(np.uint64)
    _, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
    return count[inverse]


def laid(column: pa.ChunkedArray, kind: type, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The wanted rows' values one after the other, and how many each row has."""
    rows = [np.frombuffer(x.as_buffer(), kind) for x in (column[int(i)] for i in wanted)]
    return np.concatenate([np.zeros(0, kind), *rows]), np.array([len(x) for x in rows], np.int64)


def dealt(key: np.ndarray, parts: int) -> np.ndarray:
    """The partition of mixed hashes: by their high half, so that it is a range of them."""
    return (((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def bucketed(ids: np.ndarray, score: np.ndarray, backoffs: np.ndarray, words: np.ndarray | None, parts: int) -> pa.Table:
    """The sums, by bucket of the document."""
    key = mixed(ids.view(np.uint64))
    order = np.argsort(key)
    bucket = dealt(key[order], parts)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    columns = [np.split(x[order], at[1:]) if x is not None and len(at) else [] for x in (ids, score, backoffs.astype(np.int32), words)]
    packed = [pa.array([y.tobytes() for y in x] or [b""] * len(at), pa.binary()) for x in columns]
    none = [pa.nulls(len(at), pa.int64())] * 3
    return pa.table([pa.array(bucket[at], pa.int32()), *packed, *none], names(SUMS))


def summed(rows: pa.Table) -> pa.Table:
    """The sums of each document of a bucket."""
    (ids, n), (score, _), (backoffs, _) = (laid(rows[c], k, np.arange(len(rows))) for c, k in (("ids", np.int64), ("scores", float), ("backoffs", np.int32)))
    words, whole = laid(rows["words"], np.int64, np.arange(len(rows)))
    found, document = np.unique(ids, return_inverse=True)
    own = document[np.repeat(whole > 0, n)]
    columns = [found, np.bincount(document, score, len(found)), np.bincount(own, words, len(found)), np.bincount(document, backoffs, len(found)), np.bincount(own, minlength=len(found))]
    return pa.table([pa.array(x if i == 1 else x.astype(np.int64)) for i, x in enumerate(columns)], names(SCORED))


def score_part(rows: pa.Table, counts: np.ndarray, total: int, parts: int) -> pa.Table:
    """One partition's sums by bucket of documents; and for pairs whose context is RARE, how often c(context) is still to be divided by.

    The words are taken by ranges of their hash, BLOCK or so at a time."""
    first = rows["first"].to_numpy()
    whole, some = np.flatnonzero(first < 0), np.flatnonzero(first >= 0)
    done = [bucketed(*(laid(rows[c], k, whole)[0] for c, k in (("ids", np.int64), ("words", float), ("rows", np.int64), ("others", np.int64))), parts)]
    (word, n), (other, _), (rare, _), (row, _), (ids, documents) = (
        laid(rows[c], k, some) for c, k in (("words", np.int64), ("others", np.int32), ("rare", np.int64), ("rows", np.uint16), ("ids", np.int64))
    )
    document = np.repeat((np.cumsum(documents) - documents).astype(np.int32), n) + row
    predicted = np.arange(len(word), dtype=np.int32) < np.repeat((np.cumsum(n) - n + first[some]).astype(np.int32), n)
    rare_at = np.cumsum(other == RARE, dtype=np.int32) - 1
    block = (mixed(word.view(np.uint64)) % np.uint64(len(word) // BLOCK + 1)).astype(np.int32)
    score, backoffs = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
    for b in range(len(word) // BLOCK + 1):
        here = np.flatnonzero((block == b) & predicted)
        w, o, d = word[here], other[here], document[here]
        known, inverse, own = np.unique(w, return_inverse=True, return_counts=True)
        is_rare = o == RARE
        context = o.astype(np.int64)
        context[is_rare] = rare[rare_at[here[is_rare]]]
        # A place and a hash may be the same number.
        c = tally(w, context, is_rare.astype(np.int64))
        in_table = (c >= MIN_COUNT) & (o != FIRST)
        divisor = np.where(o >= 0, counts[np.maximum(o, 0)], 1) if len(counts) else np.ones(len(o))
        s = np.log(np.where(in_table, c / divisor, own[inverse] / total * np.where(o == FIRST, 1, ALPHA)))
        np.add.at(score, d, s)
        np.add.at(backoffs, d, ~in_table & (o != FIRST))
        owed = np.flatnonzero(in_table & is_rare)
        if len(owed):
            order = owed[np.lexsort((context[owed], d[owed]))]
            x, y = d[order], context[order]
            at = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            none = [pa.nulls(len(at), pa.int32()), *[pa.nulls(len(at), pa.binary())] * 4]
            done.append(pa.table([*none, *[pa.array(z, pa.int64()) for z in (ids[x[at]], y[at], np.diff(np.append(at, len(order))))]], names(SUMS)))

        here = np.flatnonzero((block == b) & ~predicted)
        if len(here):
            # The word is the context here, and all its occurrences are in this block too.
            w, o, d = word[here], other[here].astype(np.int64), document[here]
            c = tally(w, o)
            s = np.log(np.where(c >= MIN_COUNT, c / own[np.searchsorted(known, w)], counts[o] / total * ALPHA))
            np.add.at(score, d, s)
            np.add.at(backoffs, d, c < MIN_COUNT)
    return pa.concat_tables([*done, bucketed(ids, score, backoffs, None, parts)])


def lm_scores(docs: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, n_words, n_backoff, log_score of every row of doc_id and text, by runs of up to `order` words."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("id"))
    words = written(word_counts(docs), "lm-words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    # KNOWN rows at most, since each holds more than one part in KNOWN of all words; so are the hot ones and their pairs bounded.
    held = words.where(F.col("c") * KNOWN > total).orderBy("word").toArrow()
    held = held["word"].to_numpy(), held["c"].to_numpy()
    known = spark.sparkContext.broadcast(held)
    counted = hot_pairs(docs, spark.sparkContext.broadcast(held[0][held[1] * HOT > total])).toArrow()
    dense = np.zeros(HOT * HOT, np.int64)
    dense[counted["pair"].to_numpy()] = counted["c"].to_numpy()
    pairs = spark.sparkContext.broadcast(dense)

    parts = total // PARTITION + 1
    packed = pack(docs, known, pairs, total, parts)
    scored = packed.groupBy("part").applyInArrow(lambda rows: score_part(rows, known.value[1], total, parts), SUMS)
    scored = written(scored, "lm-parts")
    owed = scored.where("bucket IS NULL").join(words, F.col("context") == F.col("word"))
    owed = owed.select("id", (-F.col("times") * F.log(F.col("c").cast("double"))).alias("score"), *[F.lit(0).cast("long").alias(x) for x in ("words", "backoffs", "copies")])
    every = scored.where("bucket IS NOT NULL").select("bucket", "ids", "scores", "backoffs", "words").groupBy("bucket").applyInArrow(summed, SCORED)
    every = every.unionByName(owed)
    if order > 2:
        every = every.unionByName(run_scores(docs, words, order))
    sums = every.groupBy("id").agg(*[F.sum(x).alias(x) for x in owed.columns[1:]])
    # Repeated rows have added up.
    per = lambda c: (F.col(c) / F.col("copies"))
    sums = sums.select("id", per("words").cast("long").alias("n_words"), per("backoffs").cast("long").alias("n_backoff"), per("score").alias("log_score"))
    return docs.select("doc_id", "id").join(sums, "id").drop("id")


def whole_numbers(scores: DataFrame) -> DataFrame:
    return scores.select("doc_id", "n_words", "n_backoff", F.floor(F.col("log_score") * 1e4 + 0.5).alias("log_score_e4"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_numbers(lm_scores(table(spark, sf_dir, "documents")))


def op5_lm_scores_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_numbers(lm_scores(table(spark, sf_dir, "documents"), 3))


SQL = f"""
WITH lowered AS (
  SELECT doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0d\\x20]+') AS ws
  FROM documents),
listed AS (SELECT doc_id, list_filter(ws, lambda w: w <> '') AS ws FROM lowered),
exploded AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM listed),
placed AS (SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM exploded),
words AS (SELECT w, count(*) AS c FROM placed GROUP BY 1),
total AS (SELECT sum(c) AS n FROM words),
pairs AS (SELECT v, w, count(*) AS c FROM placed WHERE v IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= {MIN_COUNT}),
scored AS (
  SELECT doc_id, p.v, pairs.c IS NULL AND p.v IS NOT NULL AS backed,
    CASE WHEN p.v IS NULL THEN ln(one.c / n) WHEN pairs.c IS NULL THEN ln({ALPHA} * one.c / n) ELSE ln(pairs.c / before.c) END AS s
  FROM placed p CROSS JOIN total JOIN words one ON one.w = p.w LEFT JOIN words before ON before.w = p.v
    LEFT JOIN pairs ON pairs.v = p.v AND pairs.w = p.w),
summed AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (backed) AS n_backoff, sum(s) AS s FROM scored GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backoff, 0) AS n_backoff, floor(coalesce(s, 0) * 1e4 + 0.5)::BIGINT AS log_score_e4
FROM documents d LEFT JOIN summed USING (doc_id)
"""

SQL_ORDER3 = f"""
WITH lowered AS (
  SELECT doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0d\\x20]+') AS ws
  FROM documents),
listed AS (SELECT doc_id, list_filter(ws, lambda w: w <> '') AS ws FROM lowered),
exploded AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM listed),
placed AS (SELECT doc_id, i, w, lag(w) OVER o AS v, lag(w, 2) OVER o AS u FROM exploded WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
words AS (SELECT w, count(*) AS c FROM placed GROUP BY 1),
total AS (SELECT sum(c) AS n FROM words),
pairs AS (SELECT v, w, count(*) AS c FROM placed WHERE v IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= {MIN_COUNT}),
triples AS (SELECT u, v, w, count(*) AS c FROM placed WHERE u IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= {MIN_COUNT}),
scored AS (
  SELECT doc_id,
    CASE WHEN triples.c IS NOT NULL OR p.v IS NULL THEN 0 ELSE (p.u IS NOT NULL)::INTEGER + (pairs.c IS NULL)::INTEGER END AS backed,
    CASE WHEN triples.c IS NOT NULL THEN ln(triples.c / head.c) WHEN pairs.c IS NOT NULL THEN ln(pairs.c / before.c) ELSE ln(one.c / n) END AS s
  FROM placed p CROSS JOIN total JOIN words one ON one.w = p.w LEFT JOIN words before ON before.w = p.v
    LEFT JOIN pairs ON pairs.v = p.v AND pairs.w = p.w LEFT JOIN triples ON triples.u = p.u AND triples.v = p.v AND triples.w = p.w
    LEFT JOIN pairs head ON head.v = p.u AND head.w = p.v),
summed AS (SELECT doc_id, count(*) AS n_words, sum(backed)::BIGINT AS n_backoff, sum(s + backed * ln({ALPHA})) AS s FROM scored GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backoff, 0) AS n_backoff, floor(coalesce(s, 0) * 1e4 + 0.5)::BIGINT AS log_score_e4
FROM documents d LEFT JOIN summed USING (doc_id)
"""
