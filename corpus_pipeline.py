"""A training corpus from the table of documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the columns of documents; the last one returns
the encoded documents. `run` writes each stage's rows as Parquet to the shared folder and reads them for the next.

1. quality: documents that the classifier rejects go.
2. ngram_join: of the rows linked by shingles, one stays: that with the least doc_id, nulls last, then the least hash of its text, and of rows equal in
   both the least by a hash of all columns. So repeated rows and rows without a doc_id are told apart like others. Rows without shingles stay.
3. suffix_dedup: passages that stand earlier in the corpus are cut out; n_chars follows the text. A document may end up empty; its row stays.
4. mixing: documents are repeated, or left out, to meet the sources' weights, and shuffled.
5. bpe: every text is encoded; ids and decoded bytes are given as digests.

Empty tables, null and empty texts go through as the operators' docstrings say; extra columns are kept up to the last stage,
whatever their names: past an operator that has columns of its own, they travel in one struct.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm import bpe, jaccard, mixing, quality, repeats
from taskloom.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(F.col("text"), model) >= quality.THRESHOLD)


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def carried(docs: DataFrame, *read: str) -> DataFrame:
    """The columns that an operator reads, and all others in one."""
    others = [column(c) for c in docs.columns if c not in read]
    return docs.select(*read, (F.struct(*others) if others else F.lit(None)).alias("row"))


def restored(docs: DataFrame, columns: list[str], *read: str) -> DataFrame:
    return docs.select(*[F.col(c) if c in read else F.col("row").getField(c).alias(c) for c in columns])


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    whole = F.struct(*[column(c) for c in docs.columns])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), whole.alias("row"))
    kept = jaccard.survivors(rows).toDF("kept_id", "kept_hash")
    named = rows.select("doc_id", F.xxhash64("text").alias("hash"), "row").join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")))
    # Rows equal in both are combined per task first, so that no task needs all copies of a row.
    one = named.groupBy("kept_id", "kept_hash").agg(F.min_by("row", F.xxhash64(F.col("row").cast("string"))).alias("row"))
    blank = rows.where(~F.coalesce(F.col("text").rlike(r"[^\x09-\x0d\x20]"), F.lit(False)))
    return one.select("row").unionByName(blank.select("row")).select("row.*")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    read = "doc_id", "text"
    left = restored(repeats.without_repeats(carried(docs, *read)), docs.columns, *read)
    if "n_chars" not in docs.columns:
        return left
    counted = F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
    return left.withColumn("n_chars", counted)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    read = "doc_id", "text", "source"
    return restored(mixing.mix(carried(docs, *read)), docs.columns, *read)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(docs, bpe.production(spark))


def batched(stage: Stage, rows: int) -> Stage:
    """The stage, with at most so many rows in what goes to Python at a time: an executor holds several copies of such a batch, here and there."""

    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        return stage(spark, docs, sf_dir)

    return bounded


#: The join counts by batch which n-grams are common, so it takes large ones (Spark's own default); the others read row by row.
STAGES = [
    ("quality", batched(good, 1000)),
    ("ngram_join", batched(distinct, 10_000)),
    ("suffix_dedup", batched(without_repeats, 1000)),
    ("mixing", batched(mixed, 1000)),
    ("bpe", batched(encoded, 1000)),
]

#: The classifier is trained, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
