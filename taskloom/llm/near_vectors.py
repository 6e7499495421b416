"""Near-duplicate embeddings: all pairs with equal labels and a cosine of at least a threshold, found by cover trees.

Equal vectors of a label are joined to one class first, counted per task before the shuffle. A label's classes are then dealt to the
nearest of a few pivots, and a pivot's share to blocks of bounded size; blocks whose covering radii can't reach each other are
dropped. That is the top of the tree. Each pair of blocks left is one task: it builds a cover tree per block (nested levels; the radius
halves from level to level) and goes down both at once, dropping pairs of nodes whose centres are further apart than
their covering radii and the threshold's distance allow. Surviving points are compared by their cosine in double precision.

A task gives back each vector's number of links and one link per vector to the least of those it reaches there, not the pairs, so a
group of near copies doesn't grow quadratically in what is shuffled. Components are found over those links.

Vectors that are null, zero, or hold null or non-finite components, and vectors without a label, link with nothing and are their
own component; vectors of different lengths don't link. Rows that repeat a vec_id are vectors of their own, whose component takes the least id;
null ids come out as null unless linked to one with an id. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskloom.llm.common import components, join_labels, table, written

THRESHOLD, BLOCK, LEAF = 0.98, 2048, 48
#: Bound of the pivots, which the driver holds; labels beyond the largest have blocks without pivots.
MAX_PIVOTS = 2048


class Tree:
    """A node of a cover tree: the points `rows`, all within `radius` of the point `centre`."""

    def __init__(self, unit: np.ndarray, rows: np.ndarray, centre: int, far: np.ndarray, level: float) -> None:
        self.rows, self.centre, self.radius = rows, centre, float(far.max())
        self.children: list[Tree] = []
        if len(rows) <= LEAF or self.radius < 1e-7:
            return
        while level / 2 >= self.radius:
            level /= 2
        level /= 2
        # Nested: the node's centre is a centre of the next level too; then always the point that is furthest from all.
        centres, owner, near = [centre], np.zeros(len(rows), int), far.copy()
        while near.max() > level:
            centres.append(int(rows[near.argmax()]))
            d = distances(unit[rows], unit[centres[-1] : centres[-1] + 1])[:, 0]
            closer = d < near
            owner[closer], near[closer] = len(centres) - 1, d[closer]
            near[rows == centres[-1]] = 0.0
        order = np.argsort(owner, kind="stable")
        for part, c in zip(np.split(order, np.flatnonzero(np.diff(owner[order])) + 1), centres):
            self.children.append(Tree(unit, rows[part], c, near[part], level))
        self.centres = np.array(centres)
        self.radii = np.array([t.radius for t in self.children])
        self.single = np.array([len(t.rows) == 1 for t in self.children])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between points of the unit sphere."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def tree(unit: np.ndarray, rows: np.ndarray) -> Tree:
    far = distances(unit[rows], unit[rows[:1]])[:, 0]
    far[0] = 0.0
    return Tree(unit, rows, int(rows[0]), far, 2.0)


def linked(vectors: np.ndarray, first: np.ndarray, second: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of `vectors` with the cosine: within `first`, or between it and `second`."""
    norm = np.sqrt((vectors**2).sum(1))
    unit = vectors / norm[:, None]
    reach = math.sqrt(max(2 - 2 * threshold, 0)) + 1e-7

    def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", vectors[i], vectors[j]) / (norm[i] * norm[j]) >= threshold

    a = tree(unit, first)
    b = a if second is None else tree(unit, second)
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if not a.children and not b.children:
            i, j = np.nonzero(unit[a.rows] @ unit[b.rows].T >= threshold - 1e-9)
            if a is b:
                i, j = i[i < j], j[i < j]
            i, j = a.rows[i], b.rows[j]
            hit = exact(i, j)
            yield i[hit], j[hit]
            continue
        # Go down in both, or in the one that has children.
        parts = [(t.children, t.centres, t.radii, t.single) if t.children else ([t], np.array([t.centre]), np.array([t.radius]), np.array([len(t.rows) == 1])) for t in (a, b)]
        (ca, pa, ra, sa), (cb, pb, rb, sb) = parts
        close = distances(unit[pa], unit[pb]) <= ra[:, None] + rb[None, :] + reach
        i, j = np.nonzero(np.triu(close) if a is b else close)
        points = sa[i] & sb[j]
        x, y = pa[i[points]], pb[j[points]]
        x, y = x[x != y], y[x != y]
        hit = exact(x, y)
        yield x[hit], y[hit]
        stack += [(ca[k], cb[m]) for k, m in zip(i[~points], j[~points])]


def prepared(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, dim, digest, v): v holds the components as doubles; label is null where a vector can't link."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for vec_id, label, e in zip(b.vec_id, b.label, b.embedding):
                # A null component comes as NaN or None.
                x = np.zeros(0) if e is None else np.asarray(e, dtype=float) + 0.0
                if label is None or not len(x) or not np.isfinite(x).all() or not x.any():
                    out.append((vec_id, None, 0, None, None))
                else:
                    x = x / np.abs(x).max() if not 1e-100 < np.abs(x).max() < 1e100 else x  # keeps squares in range
                    raw = x.tobytes()
                    out.append((vec_id, label, len(x), xxhash.xxh3_128_digest(raw), raw))
            yield pd.DataFrame(out, columns=["vec_id", "label", "dim", "digest", "v"])

    slim = embeddings.select(F.col("vec_id").cast("string").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    out = slim.mapInPandas(read, "vec_id string, label string, dim int, digest binary, v binary")
    return out.withColumn("vec_id", F.col("vec_id").cast("long"))


def pivots_of(classes: DataFrame, block: int) -> dict[tuple[str, int], np.ndarray]:
    """For the largest labels, as many of their vectors as they need blocks, in all MAX_PIVOTS at most."""
    large = classes.groupBy("label", "dim").count().where(F.col("count") > block).orderBy(F.desc("count"), "label", "dim").limit(MAX_PIVOTS // 2).collect()
    total = sum(r["count"] for r in large)
    share = {(r.label, r.dim): min(math.ceil(r["count"] / block), max(2, MAX_PIVOTS // 2 * r["count"] // total)) for r in large}
    if not share:
        return {}
    wanted = classes.sparkSession.createDataFrame([(*k, n) for k, n in share.items()], "label string, dim int, pivots int")
    by = Window.partitionBy("label", "dim").orderBy(F.xxhash64("node"), "node")
    # MAX_PIVOTS rows at most are kept, hence the broadcast; the literal bound limits each task's rows before the shuffle.
    picked = classes.join(F.broadcast(wanted), ["label", "dim"]).withColumn("nth", F.row_number().over(by)).where(f"nth <= {MAX_PIVOTS} AND nth <= pivots")
    out: dict[tuple[str, int], list[np.ndarray]] = {}
    for r in picked.select("label", "dim", "v").collect():
        x = np.frombuffer(r.v)
        out.setdefault((r.label, r.dim), []).append(x / np.sqrt((x**2).sum()))
    return {k: np.array(v) for k, v in out.items()}


def dealt(classes: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The classes with their block, and the pairs of blocks that may hold links: (label, dim, block, other)."""
    pivots = classes.sparkSession.sparkContext.broadcast(pivots_of(classes, block))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["cell"], b["away"] = 0, 2.0
            for key, rows in b.groupby(["label", "dim"]).groups.items():
                if key in pivots.value:
                    x = np.array([np.frombuffer(v) for v in b.loc[rows, "v"]])
                    d = distances(x / np.sqrt((x**2).sum(1))[:, None], pivots.value[key])
                    b.loc[rows, "cell"], b.loc[rows, "away"] = d.argmin(1), d.min(1)
            yield b

    celled = written(classes.select("node", "label", "dim", "n", "v").mapInPandas(nearest, "node long, label string, dim int, n long, v binary, cell int, away double"), "cells")
    sizes = celled.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    placed = celled.join(sizes, ["label", "dim", "cell"]).withColumn("block", F.struct("cell", F.expr("pmod(xxhash64(node, 3), parts)").alias("part")))
    blocks = placed.groupBy("label", "dim", "block").agg(F.max("away").alias("radius"))

    @F.pandas_udf("double")
    def apart(label: pd.Series, dim: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        held = ((pivots.value.get((x, d)), i, j) for x, d, i, j in zip(label, dim, a, b))
        return pd.Series([0.0 if p is None else float(np.sqrt(((p[i] - p[j]) ** 2).sum())) for p, i, j in held], dtype=float)

    other = blocks.select("label", "dim", F.col("block").alias("other"), F.col("radius").alias("other_radius"))
    pairs = blocks.join(other, ["label", "dim"]).where("block <= other")
    reach = math.sqrt(max(2 - 2 * THRESHOLD, 0)) + 1e-6
    near = apart("label", "dim", F.col("block.cell"), F.col("other.cell")) <= F.col("radius") + F.col("other_radius") + reach
    return placed.drop("cell", "away", "parts"), pairs.where(near).select("label", "dim", "block", "other")


def links_of(classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, links, root): per task, how many vectors outside its class a node links with, and the least node it reaches."""
    placed, pairs = dealt(classes, block)
    sides = F.array(F.struct(F.col("block").alias("block"), F.lit(0).alias("side")), F.struct(F.col("other").alias("block"), F.lit(1).alias("side")))
    ends = pairs.withColumn("pair", F.struct("block", "other")).select("label", "dim", "pair", F.explode(sides).alias("e")).select("label", "dim", "pair", "e.*")
    ends = ends.where("side = 0 OR pair.block <> pair.other")
    work = placed.join(ends, ["label", "dim", "block"]).select("label", "dim", "pair", "side", "node", "n", "v")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        vectors, weight = np.array([np.frombuffer(v) for v in rows.v]), rows.n.to_numpy()
        first, second = (np.flatnonzero(rows.side == s) for s in (0, 1))
        links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for i, j in linked(vectors, first, second if len(second) else None, threshold) if len(first) else ():
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            root = join_labels(root, i, j)
        node = rows.node.to_numpy()
        out = pd.DataFrame({"node": node, "links": links, "root": node[root]})
        return out[out.links > 0]

    return work.groupBy("label", "dim", "pair").applyInPandas(compare, "node long, links long, root long")


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    if threshold < THRESHOLD:
        raise ValueError("the reach between blocks is made for cosines of 0.98 and more")
    rows = written(prepared(embeddings), "vectors")
    node = F.xxhash64("label", "dim", "digest")
    classes = rows.where("label IS NOT NULL").groupBy("label", "dim", "digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = written(classes.withColumn("node", node), "vector-classes")
    found = written(links_of(classes, threshold, block), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found, "node", "root")
    told = classes.select("node", "label", "dim", "digest", "least", "n").join(links, "node", "left").join(roots, "node", "left")
    told = told.withColumn("root", F.coalesce("root", "node"))
    least = told.groupBy("root").agg(F.min("least").alias("component_id"))
    told = told.join(least, "root").select("label", "dim", "digest", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = rows.select("vec_id", "label", "dim", "digest").join(told, ["label", "dim", "digest"], "left")
    own = F.when(F.col("label").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(True)).alias("kept"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
