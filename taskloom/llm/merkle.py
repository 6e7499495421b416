"""Merkle manifest of a dataset: a leaf per row, a tree per source, a tree over the sources, and a proof per row.

Slot pivot: a node's parent is its place divided by FANOUT, its slot the remainder. Conditional aggregates spread the children of a parent into FANOUT columns;
the columns, concatenated, hash to the parent, and without a child's own column they are its siblings. Going up, each level has a
sixteenth of the rows of the one below. Going down, a parent hands each child the digests left and right of it and all pairs from above; so a row's whole path is
put together beside its pivoted row, and only parents travel.

A place is the rank in a total order: rows are dealt by ranges of it, sorted and written; a table of one row for each source and range holds what stands
before. No source is in one task, however many rows it has. Rows equal in all that is hashed are interchangeable; a hidden row number
deals them to several ranges.

In a source, leaves ascend by doc_id (null first), then by leaf. Sources ascend bytewise, null first. A null column is hashed as `-`; an empty text is `0:`. A source with
one row has its leaf as subroot, a dataset with one source its subroot as root. Rows with a null doc_id are never tampered with. Columns beside the five
are neither hashed nor returned, whatever their names. Texts of any length are hashed whole. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskloom.llm.common import table, written

FANOUT = 16
HASHED = "doc_id", "source", "lang", "n_chars", "text"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(columns: list[Column]) -> Column:
    """The digest of the values, each with its length in front."""
    texts = [c.cast("string") for c in columns]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def tampered_with(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, changed): `changed` is the leaf after tampering, null for rows that are left alone."""
    lower = F.translate("text", UPPER, LOWER)
    changed = F.when(tampered_with(F.col("doc_id")), leaf([*[F.col(c) for c in HASHED[:-1]], lower]))
    return docs.select(*HASHED).select("source", F.col("doc_id").cast("long").alias("doc_id"), leaf([F.col(c) for c in HASHED]).alias("leaf"), changed.alias("changed"))


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """The rows with `pos`, their place from 0 among the rows of the key, and `n`, how many rows the key has."""
    dealt = rows.withColumn("row_no", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(key, *order, "row_no").sortWithinPartitions(key, *order, "row_no")
    # The upper bits number the range, the lower ones the rows in it. Written, as ranges come from a sample.
    placed = written(dealt.drop("row_no").withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33)), name)
    parts = placed.groupBy(key, "range").agg(F.count("*").alias("held"), F.min("at").alias("first"))
    of_key = Window.partitionBy(key)
    before = F.sum("held").over(of_key.orderBy("range")) - F.col("held")
    parts = parts.select(F.col(key).alias("key_"), F.col("range").alias("range_"), (before - F.col("first")).alias("shift"), F.sum("held").over(of_key).alias("n"))
    joined = placed.join(parts, same(key, "key_") & (F.col("range") == F.col("range_")))
    return joined.withColumn("pos", F.col("at") + F.col("shift")).drop("key_", "range_", "at", "range", "shift")


def pivoted(nodes: DataFrame, key: str, rest: list[str]) -> DataFrame:
    """A row per parent: key, up (its place), n (nodes of the key on the children's level), and its children in slots s0, s1 and so on."""
    slot, child = F.col("pos") % FANOUT, F.struct("h", *rest)
    slots = [F.max(F.when(slot == i, child)).alias(f"s{i}") for i in range(FANOUT)]
    return nodes.groupBy(key, F.expr(f"pos div {FANOUT}").alias("up")).agg(F.first("n").alias("n"), *slots)


def tree(nodes: DataFrame, key: str, rest: list[str], name: str) -> tuple[DataFrame, list[DataFrame]]:
    """For (key, pos, n, h) and the columns `rest` of the lowest level: (key, h) of the tops, and the pivoted parents of every level from the lowest."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    tops, levels = [nodes.where("n = 1").select(key, "h")], []
    while most > 1:
        parents = written(pivoted(nodes.where("n > 1"), key, rest if not levels else []), f"{name}-{len(levels)}")
        levels.append(parents)
        h = digest(*[F.coalesce(F.col(f"s{i}.h"), F.lit("")) for i in range(FANOUT)])
        nodes = parents.select(key, F.col("up").alias("pos"), F.ceil(F.col("n") / FANOUT).alias("n"), h.alias("h"))
        tops.append(nodes.where("n = 1").select(key, "h"))
        most = -(-most // FANOUT)
    top = tops[0]
    for more in tops[1:]:
        top = top.unionByName(more)
    return top, levels


def handed_down(levels: list[DataFrame], tops: DataFrame, key: str) -> DataFrame:
    """Each node of the lowest level under a parent: key, child, and the parent's other columns with `path` longer by one pair at every level.

    `tops` has key, path and what else all nodes of a key get."""
    extra = [c for c in tops.columns if c not in (key, "path")]
    # A key's topmost parent has at most FANOUT children; only there does the path start.
    ends = tops.withColumns({"pos": F.lit(0).cast("long"), "end": F.lit(True)})
    above, found = ends, None
    for parents in reversed(levels):
        held = F.filter(F.array(*[f"s{i}" for i in range(FANOUT)]), lambda x: x.isNotNull())
        with_path = parents.withColumnRenamed(key, "key_").join(above, same("key_", key) & (F.col("up") == F.col("pos")) & ((F.col("n") <= FANOUT) == F.col("end"))).drop("key_", "pos")
        slots = with_path.select(key, "up", *extra, "path", held.alias("held"))
        children = slots.select("*", F.transform("held", lambda x: x["h"]).alias("hashes"), F.posexplode("held").alias("i", "child"))
        left = F.array_join(F.slice("hashes", F.lit(1), F.col("i")), "")
        right = F.array_join(F.slice("hashes", F.col("i") + 2, F.lit(FANOUT)), "")
        path = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("path"))
        found = children.select(key, (F.col("up") * FANOUT + F.col("i")).alias("pos"), "child", *extra, path.alias("path"))
        above = found.drop("child").withColumn("end", F.lit(False)).unionByName(ends)
    return found


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, changed, subroot, root and path (the digests left and right of the node, from the leaf's level up) of every row."""
    placed = written(numbered(leaves(docs).withColumnRenamed("leaf", "h"), "source", ["doc_id", "h"], "merkle-leaves"), "merkle-places")
    rest = ["doc_id", "changed"]
    tops, levels = tree(placed, "source", rest, "merkle-level")
    subroots = written(tops.withColumn("all", F.lit(0)), "merkle-subroots")
    ranked = written(numbered(subroots, "all", ["source"], "merkle-sources"), "merkle-ranks")
    root, root_levels = tree(ranked, "all", ["source"], "merkle-root")
    nothing = F.array().cast(PATH)
    root = written(root.select("all", F.col("h").alias("root"), nothing.alias("path")), "merkle-top")
    if root_levels:
        sources = handed_down(root_levels, root, "all").select(F.col("child.source").alias("source"), F.col("child.h").alias("subroot"), "root", "path")
    else:
        sources = root.join(ranked.withColumnRenamed("all", "all_"), same("all", "all_")).select("source", F.col("h").alias("subroot"), "root", "path")
    sources = written(sources, "merkle-paths")
    alone = placed.where("n = 1").withColumnRenamed("source", "source_").join(sources, same("source_", "source"))
    out = alone.select("doc_id", F.col("h").alias("leaf"), "changed", "subroot", "root", "path")
    if levels:
        under = handed_down(levels, sources, "source")
        out = out.unionByName(under.select("child.doc_id", F.col("child.h").alias("leaf"), "child.changed", "subroot", "root", "path"))
    return out


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda h, x: digest(x["left"], h, x["right"]))


def proof(path: Column) -> Column:
    """The siblings, level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(table(spark, sf_dir, "documents"))
    again = rows.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    return again.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(source_levels: int = 6, root_levels: int = 6) -> str:
    """All levels written out; enough for 16 ** 6 rows a source, and as many sources."""
    value = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    row = lambda text: "sha256(" + " || ".join([*[value(c) for c in HASHED[:-1]], value(text)]) + ")"
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"""
    steps = [
        f"""leaves AS (SELECT doc_id, source, {row('text')} AS leaf,
      CASE WHEN {crc} % 5 = 0 THEN {row(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents),
    s0 AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves)"""
    ]

    def levels(t: str, key: str, count: int) -> None:
        for k in range(count):
            below = f"{t}0" if k == 0 else f"(SELECT * FROM {t}{k})"
            steps.append(f"{t}p{k} AS (SELECT {key}, pos // {FANOUT} AS up, any_value(n) AS n, list(h ORDER BY pos) AS hs FROM {below} GROUP BY 1, 2)")
            steps.append(
                f"{t}{k + 1} AS (SELECT {key}, up AS pos, (n + {FANOUT - 1}) // {FANOUT} AS n, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {t}p{k})"
            )

    def paths(t: str, key: str, count: int, frm: str, kept: str) -> None:
        """Adds a proof and a folded digest level by level."""
        for k in range(count):
            to, i = f"{frm}_{k}", f"(x.at % {FANOUT} + 1)::BIGINT"
            left, right = f"array_to_string(p.hs[1:{i} - 1], '')", f"array_to_string(p.hs[{i} + 1:], '')"
            source = f"{frm}" if k == 0 else f"{frm}_{k - 1}"
            steps.append(
                f"""{to} AS (SELECT {kept}, x.at // {FANOUT} AS at, x.proof || CASE WHEN p.n = 1 THEN '' ELSE {left} || {right} END AS proof,
      CASE WHEN p.n = 1 THEN x.f ELSE sha256({left} || x.f || {right}) END AS f
      FROM {source} x JOIN {t}p{k} p ON p.{key} IS NOT DISTINCT FROM x.{key} AND p.up = x.at // {FANOUT})"""
            )

    levels("s", "source", source_levels)
    steps.append(f"r0 AS (SELECT 0 AS one, source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM s{source_levels})")
    levels("r", "one", root_levels)
    steps.append("a AS (SELECT doc_id, source, leaf, pos AS at, '' AS proof, coalesce(changed, leaf) AS f FROM s0)")
    paths("s", "source", source_levels, "a", "x.doc_id, x.source, x.leaf")
    steps.append(f"b AS (SELECT x.doc_id, x.source, x.leaf, 0 AS one, r.h AS subroot, r.pos AS at, x.proof, x.f FROM a_{source_levels - 1} x JOIN r0 r ON r.source IS NOT DISTINCT FROM x.source)")
    paths("r", "one", root_levels, "b", "x.doc_id, x.source, x.leaf, x.subroot, x.one")
    return (
        "WITH "
        + ",\n    ".join(steps)
        + f"""
    SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified FROM b_{root_levels - 1} x JOIN r{root_levels} r ON r.one = x.one"""
    )


SQL = _sql()
