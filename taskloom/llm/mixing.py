"""Mix sources to target weights: every document is repeated a Poisson number of times, then all are shuffled.

A group is a source with a weight of its own; all other sources, and null, share the weight `rest`. With size a document's
characters plus one, a group's rate is weight / (sum of the weights of the groups that occur) * size of all
documents / size of the group; `max_rate` may bound how often a text is repeated on average, production sets no bound. A document's count is
the inverse of the Poisson distribution with that rate at a number in [0, 1) that is hashed from the seed
and the doc_id (from the text where doc_id is null), so a rerun or a lost executor gives the same mix.

A distribution is tabled over 12 standard deviations and 30 more to either side of its rate, beyond which less than 1e-30 lies; so the table grows
with the square root of the rate. A text with very many copies is exploded in blocks.

Only built-in column functions are used. Sizes are summed per task first, so that a source with most of the rows needs
no split, and the table of rates has as many rows as weights are given, plus one: that bound is why it's broadcast.
The only shuffle of texts is the global one, by a hash of document and copy, which no group skews.

Null texts count as empty ones. Rows that repeat a doc_id get the same count each. An empty table gives no rows. Columns
of the input stay, apart from mix_copy and mix_order, which are replaced, and mix_group, mix_key, mix_cdf, mix_first, mix_block and mix_n, which are dropped.
Rows with the same mix_order, as repeated rows have, come in any order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskloom.llm.common import table

WEIGHTS = {"src0": 0.10, "src1": 0.20, "src2": 0.15, "src3": 0.10, "src4": 0.05}
REST, SEED, MAX_RATE = 0.40, "mix-1", float("inf")
#: Copies of a text that are made from one row.
BLOCK = 10_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long").cast("double") / F.lit(2.0**52)


def group_of(weights: Mapping[str, float]) -> Column:
    return F.when(F.col("source").cast("string").isin(*weights), F.col("source").cast("string")).otherwise(F.lit(""))


def attained(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, rest: float = REST, max_rate: float = MAX_RATE) -> DataFrame:
    """(mix_group, wanted, attained): each group's part of the mix by its weight, and as expected with the rates that `max_rate` leaves."""
    share = F.create_map(*[F.lit(x) for pair in [*weights.items(), ("", rest)] for x in pair])
    size = F.coalesce(F.length("text"), F.lit(0)) + 1
    # At most len(weights) + 1 rows, so the window is small.
    every = Window.partitionBy()
    sizes = docs.select(group_of(weights).alias("mix_group"), size.alias("size")).groupBy("mix_group").agg(F.sum("size").alias("size"))
    wanted = sizes.withColumn("w", share[F.col("mix_group")].cast("double")).withColumn("wanted", F.col("w") / F.sum("w").over(every))
    given = wanted.withColumn("given", F.least(F.lit(max_rate) * F.col("size"), F.col("wanted") * F.sum("size").over(every)))
    return given.select("mix_group", "wanted", (F.col("given") / F.sum("given").over(every)).alias("attained"))


def distributions(docs: DataFrame, weights: Mapping[str, float], rest: float, max_rate: float) -> DataFrame:
    """(mix_group, mix_first, mix_cdf): mix_cdf[k] is the probability of at most mix_first + k copies."""
    share = F.create_map(*[F.lit(x) for pair in [*weights.items(), ("", rest)] for x in pair])
    size = F.coalesce(F.length("text"), F.lit(0)) + 1
    # At most len(weights) + 1 rows, so the windows below are small.
    sizes = docs.select(group_of(weights).alias("mix_group"), size.alias("size")).groupBy("mix_group").agg(F.sum("size").alias("size"))
    every, upto = Window.partitionBy(), Window.partitionBy("mix_group").orderBy("k")
    rates = sizes.withColumn("w", share[F.col("mix_group")].cast("double")).select(
        "mix_group", F.least(F.lit(max_rate), F.col("w") / F.sum("w").over(every) * F.sum("size").over(every) / F.col("size")).alias("rate")
    )
    spread = 12 * F.sqrt("rate") + 30
    first, last = F.greatest(F.lit(0), F.floor(F.col("rate") - spread)).cast("long"), F.ceil(F.col("rate") + spread).cast("long")
    terms = rates.select("mix_group", "rate", first.alias("mix_first"), F.explode(F.sequence(first, last)).alias("k"))
    # Each term is the one before times rate / k, and they add up to 1. A rate of 0 leaves all weight on no copy.
    step = F.when(F.col("k") == F.col("mix_first"), 0.0).when(F.col("rate") > 0, F.log(F.col("rate") / F.col("k")))
    whole = Window.partitionBy("mix_group")
    terms = terms.withColumn("log_term", F.when((F.col("rate") > 0) | (F.col("k") == 0), F.sum(step).over(upto)))
    terms = terms.withColumn("term", F.coalesce(F.exp(F.col("log_term") - F.max("log_term").over(whole)), F.lit(0.0)))
    return (
        terms.withColumn("p", F.sum("term").over(upto) / F.sum("term").over(whole))
        .groupBy("mix_group", "mix_first")
        .agg(F.array_sort(F.collect_list(F.struct("k", "p"))).getField("p").alias("mix_cdf"))
    )


def mix(
    docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, rest: float = REST, seed: str = SEED, max_rate: float = MAX_RATE
) -> DataFrame:
    """The repeated documents in shuffled order, with mix_copy (from 1) and mix_order, by which partitions are sorted."""
    if len(weights) > 10_000:
        raise ValueError("at most 10,000 sources may have a weight of their own; the table of rates is broadcast")
    docs = docs.drop("mix_copy", "mix_order", "mix_group", "mix_key", "mix_cdf", "mix_first", "mix_block", "mix_n")
    rates = F.broadcast(distributions(docs, weights, rest, max_rate))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")))))
    keyed = docs.withColumns({"mix_group": group_of(weights), "mix_key": key})
    drawn = keyed.join(rates, "mix_group")
    # The array of one number keeps the hash from being computed again for each step of the distribution.
    number = F.array(uniform(F.lit(seed), F.col("mix_key")))
    copies = F.transform(number, lambda u: F.size(F.filter("mix_cdf", lambda p: p <= u)))[0]
    counted = drawn.withColumn("mix_n", F.col("mix_first") + copies).where("mix_n > 0")
    blocks = counted.withColumn("mix_block", F.explode(F.expr(f"sequence(0L, (mix_n - 1) div {BLOCK})")))
    copy = F.explode(F.expr(f"sequence(mix_block * {BLOCK} + 1, least(mix_n, (mix_block + 1) * {BLOCK}))"))
    repeated = blocks.withColumn("mix_copy", copy).withColumn("mix_copy", F.col("mix_copy").cast("int"))
    order = F.md5(F.concat_ws("|", F.lit(seed + " order"), "mix_key", "mix_copy"))
    ordered = repeated.withColumn("mix_order", F.substring(order, 1, 16))
    return ordered.repartition("mix_order").sortWithinPartitions("mix_order").select(*docs.columns, "mix_copy", "mix_order")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def sql(documents: str = "documents", columns: str = "doc_id, text, lang, source, n_chars") -> str:
    """The same rows in DuckDB."""
    listed = ", ".join(f"('{s}', {w!r}::DOUBLE)" for s, w in WEIGHTS.items())
    return f"""
WITH RECURSIVE weights(mix_group, w) AS (VALUES {listed}, ('', {REST!r}::DOUBLE)),
docs AS (
  SELECT *, CASE WHEN source IN (SELECT mix_group FROM weights WHERE mix_group <> '') THEN source ELSE '' END AS mix_group,
    coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, ''))) AS mix_key
  FROM {documents}),
sizes AS (SELECT mix_group, sum(coalesce(length(text), 0) + 1)::DOUBLE AS size FROM docs GROUP BY 1),
rates AS (
  SELECT mix_group, w / sum(w) OVER () * sum(size) OVER () / size AS rate
  FROM sizes JOIN weights USING (mix_group)),
around AS (SELECT *, greatest(0, floor(rate - 12 * sqrt(rate) - 30))::BIGINT AS first FROM rates),
logs AS (
  SELECT mix_group, first, k, sum(CASE WHEN k > first THEN ln(rate / k) ELSE 0 END) OVER (PARTITION BY mix_group ORDER BY k) AS log_term
  FROM around, LATERAL (SELECT unnest(range(first, ceil(rate + 12 * sqrt(rate) + 31)::BIGINT)) AS k)),
terms AS (SELECT *, exp(log_term - max(log_term) OVER (PARTITION BY mix_group)) AS term FROM logs),
cdf AS (SELECT mix_group, first, k, sum(term) OVER (PARTITION BY mix_group ORDER BY k) / sum(term) OVER (PARTITION BY mix_group) AS p FROM terms),
steps AS (SELECT mix_group, first, list(p ORDER BY k) AS ps FROM cdf GROUP BY 1, 2),
drawn AS (
  SELECT docs.*, ('0x' || substr(md5('{SEED}|' || mix_key), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u, first, ps
  FROM docs JOIN steps USING (mix_group)),
counted AS (SELECT *, first + len(list_filter(ps, lambda p: p <= u)) AS n FROM drawn),
copies AS (SELECT *, unnest(range(1, n + 1))::INTEGER AS mix_copy FROM counted WHERE n > 0)
SELECT {columns}, mix_copy, substr(md5('{SEED} order|' || mix_key || '|' || mix_copy), 1, 16) AS mix_order FROM copies
"""


SQL = sql()
