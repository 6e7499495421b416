"""WARC: give not-modified captures (status 304) the content of the capture they refer to.

For each revisit, an as-of join by canonical URL finds the latest earlier full response (status 200), and its validators are compared:
where the revisit has an entity tag, that decides (weakly: a leading W/ is dropped); else Last-Modified, if both have it. A resolved
revisit gets the base's id and body and the base's headers, with those headers replaced that a 304 may update. A 304 without a base, without
validators or with other ones stays unresolved and says why.

The as-of join carries ids, times and headers only. Captures are cut by (URL, time slice); a window runs inside each slice, and
the last full response of a slice is carried to later slices of that URL over a table with one row per URL and slice. So a URL with most of the captures is spread over many tasks. Bodies are fetched at the end by the base's id, a join that can split a hot base.

Null URLs match nothing: their revisits have no base. A null time counts as earlier than all. Captures of one URL at the same
time go by record_id, nulls first, and a revisit takes only a base before it in that order; of several bases with one time and record_id, that with the greatest key.
The key is two 64-bit hashes of all columns that are read; bases and bodies are joined by it, so captures that share a record_id, or have none, stay apart, and a
base without an id gives its headers and body, and null as base_id. Rows that are equal in all columns read are worked on once and returned as often as they come.
Null headers are no headers. Bodies of any length are carried whole. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskloom.llm.common import table

# Headers that a 304 response may send and that then replace the stored ones.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
# Query parameters that only tell where a visitor came from.
TRACKING = r"([?&])(utm_[a-z]+|ref|gclid|fbclid)=[^&]*"
#: Time units (seconds in the query) that one task takes of a URL.
SLICE = 86_400


def canonical(url: Column) -> Column:
    """Host in lower case without www. or default port, then path and query without fragment, tracking parameters and slash at the end; http and https alike."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), r"(?i)^https?://(www\.)?", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r":(80|443)$", "")
    rest = F.regexp_replace(F.regexp_replace(bare, r"^[^/?]*", ""), TRACKING, "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, r"([?&])&+", "$1"), r"[?&]+$", "")
    return F.concat(host, F.regexp_replace(rest, r"/+(\?|$)", "$1"))


def lower_names(headers: Column) -> Column:
    """Names in lower case; of names that differ in case only, the value of the greatest name counts."""
    entries = F.array_sort(F.map_entries(headers))
    return F.aggregate(
        F.coalesce(entries, F.expr("CAST(array() AS array<struct<key:string,value:string>>)")),
        F.expr("CAST(map() AS map<string,string>)"),
        lambda found, e: F.map_concat(
            F.map_filter(found, lambda k, v: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])
        ),
    )


def merged(base: Column, new: Column) -> Column:
    """The stored headers with the permitted new ones in place."""
    allowed = F.map_filter(new, lambda k, v: k.isin(PERMITTED))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)


KEY = ["key", "key_2"]


def latest_full(captures: DataFrame, width: int = SLICE) -> DataFrame:
    """(key, key_2, base) of the status-304 captures: at, record_id and key of the last status-200 capture of the same URL before each, if any."""
    slim = captures.where("url_key IS NOT NULL AND status IN (200, 304)").select("record_id", "url_key", "at", "status", *KEY)
    sliced = slim.withColumn("slice", F.floor(F.col("at") / width))
    full = F.when(F.col("status") == 200, F.struct("at", "record_id", *KEY))
    ends = sliced.groupBy("url_key", "slice").agg(F.max(full).alias("end"))
    earlier = Window.partitionBy("url_key").orderBy(F.col("slice").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("end", ignorenulls=True).over(earlier)).select(F.col("url_key").alias("to_url"), F.col("slice").alias("to_slice"), "carried")
    # Revisits come first among equals, so that no base of the same time and id is before them.
    inside = Window.partitionBy("url_key", "slice").orderBy(F.col("at").asc_nulls_first(), F.col("record_id").asc_nulls_first(), F.col("status").desc(), *KEY)
    near = sliced.withColumn("near", F.last(full, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    return (
        near.where("status = 304")
        .join(carried, (F.col("url_key") == F.col("to_url")) & F.col("slice").eqNullSafe(F.col("to_slice")))
        .select(*KEY, F.coalesce("near", "carried").alias("base"))
        .where("base IS NOT NULL")
    )


def resolve(records: DataFrame, width: int = SLICE) -> DataFrame:
    """record_id, url_key, status, outcome, base_id, headers (names in lower case) and body, one row per row of the input.

    Takes record_id long, url string, at long (time in any unit), status int, headers map<string,string>, body string.
    outcome: full, resolved, no base, no validator, changed, or other (any other status).
    """
    read = records.select(
        F.col("record_id").cast("long").alias("record_id"), F.col("at").cast("long").alias("at"), canonical(F.col("url")).alias("url_key"),
        F.col("status").cast("int").alias("status"), F.array_sort(F.map_entries(lower_names(F.col("headers")))).alias("entries"),
        F.col("body").cast("string").alias("body"),
    )
    # Nulls leave a hash as it was, so it is told which columns are null.
    every = [*[F.col(c).isNull() for c in read.columns], *read.columns]
    keyed = read.withColumns({KEY[0]: F.xxhash64(*every), KEY[1]: F.xxhash64(F.lit("second"), *every)})
    one = keyed.groupBy(*KEY).agg(F.first(F.struct(*read.columns)).alias("r"), F.count("*").cast("int").alias("copies"))
    captures = one.select(*KEY, "copies", "r.*").withColumn("headers", F.map_from_entries("entries")).drop("entries")

    # Bodies stay out of the as-of join; keys are unique by now.
    bases = latest_full(captures, width).select(*KEY, F.col("base.record_id").alias("base_id"), *[F.col(f"base.{k}").alias(f"base_{k}") for k in KEY])
    base = captures.where("status = 200").select(*[F.col(k).alias(f"base_{k}") for k in KEY], F.col("headers").alias("base_headers"), F.col("body").alias("base_body"))
    revisits = captures.where("status = 304").join(bases, KEY, "left").join(base, [f"base_{k}" for k in KEY], "left")
    weak = lambda c: F.regexp_replace(F.element_at(c, "etag"), "^W/", "")
    tag, old_tag = weak("headers"), weak("base_headers")
    date, old_date = F.element_at("headers", "last-modified"), F.element_at("base_headers", "last-modified")
    same = F.when(tag.isNotNull(), F.coalesce(tag == old_tag, F.lit(False))).otherwise(date == old_date)
    outcome = (
        F.when(F.col("base_key").isNull(), "no base").when(same, "resolved").when(same.isNull(), "no validator").otherwise("changed")
    )
    resolved = F.col("outcome") == "resolved"
    told = revisits.withColumn("outcome", outcome).select(
        "record_id", "url_key", "status", "outcome", F.when(resolved, F.col("base_id")).alias("base_id"),
        F.when(resolved, merged(F.col("base_headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        F.when(resolved, F.col("base_body")).otherwise(F.col("body")).alias("body"), "copies",
    )
    rest = captures.where("NOT coalesce(status = 304, false)").select(
        "record_id", "url_key", "status", F.when(F.col("status") == 200, "full").otherwise("other").alias("outcome"),
        F.lit(None).cast("long").alias("base_id"), "headers", "body", "copies",
    )
    every = told.unionByName(rest)
    return every.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")


def captures_of(pages: DataFrame) -> DataFrame:
    """Each page as a full capture, and a later 304 one: a fifth of them with another entity tag, an eleventh without validators."""
    tag, url_tag = F.md5(F.coalesce("html", F.lit(""))), F.md5(F.coalesce("url", F.lit("")))
    text = lambda c: c.cast("string")
    first, again = F.col("page_id") * 60, F.col("page_id") * 60 + 3600 * (F.col("page_id") % 7)
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", first.alias("at"), F.lit(200).alias("status"),
        F.create_map(F.lit("Date"), F.coalesce(text(first), F.lit("")), F.lit("ETag"), F.concat(F.lit('"'), tag, F.lit('"')), F.lit("Content-Type"), F.lit("text/html")).alias("headers"),
        F.col("html").alias("body"),
    )
    told = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit('"'), url_tag, F.lit('"'))).when(F.col("page_id") % 11 != 0, F.concat(F.lit('W/"'), tag, F.lit('"')))
    sent = F.create_map(F.lit("date"), F.coalesce(text(again), F.lit("")), F.lit("Cache-Control"), F.lit("no-cache"), F.lit("Set-Cookie"), F.lit("s=1"))
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), again.alias("at"), F.lit(304).alias("status"),
        F.when(told.isNull(), sent).otherwise(F.map_concat(sent, F.create_map(F.lit("ETag"), told))).alias("headers"),
        F.lit(None).cast("string").alias("body"),
    )
    return full.unionByName(revisit)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return resolve(captures_of(table(spark, sf_dir, "pages"))).select(
        "record_id", "url_key", "status", "outcome", "base_id", F.array_join(lines, "\n").alias("headers"),
        F.sha2("body", 256).alias("body_sha256"), F.length("body").alias("body_chars"),
    )


def _canonical_sql(url: str) -> str:
    bare = rf"regexp_replace(regexp_replace(trim({url}), '#.*$', ''), '(?i)^https?://(www\.)?', '')"
    host = f"regexp_replace(lower(regexp_extract({bare}, '^[^/?]*')), ':(80|443)$', '')"
    rest = f"regexp_replace(regexp_replace({bare}, '^[^/?]*', ''), '{TRACKING}', '\\1', 'g')"
    rest = f"regexp_replace(regexp_replace({rest}, '([?&])&+', '\\1', 'g'), '[?&]+$', '')"
    return rf"{host} || regexp_replace({rest}, '/+(\?|$)', '\1', 'g')"


SQL = f"""
WITH captures AS (
  SELECT page_id * 2 AS record_id, {_canonical_sql('url')} AS url_key, page_id * 60 AS seen, 200 AS status, html AS body,
    page_id * 60 AS sent, '"' || md5(coalesce(html, '')) || '"' AS etag
  FROM pages
  UNION ALL
  SELECT page_id * 2 + 1, {_canonical_sql("url || '#again'")}, page_id * 60 + 3600 * (page_id % 7), 304, NULL,
    page_id * 60 + 3600 * (page_id % 7),
    CASE WHEN page_id % 5 = 0 THEN '"' || md5(coalesce(url, '')) || '"' WHEN page_id % 11 <> 0 THEN 'W/"' || md5(coalesce(html, '')) || '"' END
  FROM pages),
found AS (
  SELECT *, last_value(CASE WHEN status = 200 THEN record_id END IGNORE NULLS) OVER (
    PARTITION BY url_key ORDER BY seen, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near
  FROM captures),
judged AS (
  SELECT f.*, b.body AS base_body, b.etag AS base_etag, CASE
    WHEN f.status = 200 THEN 'full' WHEN f.near IS NULL THEN 'no base' WHEN f.etag IS NULL THEN 'no validator'
    WHEN regexp_replace(f.etag, '^W/', '') = b.etag THEN 'resolved' ELSE 'changed' END AS outcome
  FROM found f LEFT JOIN captures b ON b.record_id = f.near AND f.status = 304)
SELECT record_id, url_key, status, outcome, CASE WHEN outcome = 'resolved' THEN near END AS base_id,
  CASE outcome WHEN 'full' THEN 'content-type: text/html' || chr(10) || 'date: ' || sent || chr(10) || 'etag: ' || etag
    WHEN 'resolved' THEN 'cache-control: no-cache' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || sent || chr(10) || 'etag: ' || etag
    ELSE 'cache-control: no-cache' || chr(10) || 'date: ' || sent || coalesce(chr(10) || 'etag: ' || etag, '') || chr(10) || 'set-cookie: s=1' END AS headers,
  sha256(CASE outcome WHEN 'full' THEN body WHEN 'resolved' THEN base_body END) AS body_sha256,
  length(CASE outcome WHEN 'full' THEN body WHEN 'resolved' THEN base_body END)::INTEGER AS body_chars
FROM judged
"""
