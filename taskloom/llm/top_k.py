"""Exact top-k by integer inner product: a ball tree per shard, searched by branch and bound.

Components become floor(1024 * x). Rows are dealt to shards of bounded size, queries to blocks of bounded size. In a first wave each block of queries
searches one shard; the k-th score found there is a bound that goes with the query to all other shards in the
second wave, so that most nodes are cut off at once. In a shard, nodes are taken by the largest inner product that they can
hold (query times centre, plus the query's length times the radius) until that is below the k-th score so far. Equal
scores are searched to the end, as the smaller vec_id wins.

Every query meets every shard, in blocks: a task holds one shard and one block, whatever the size of the table.

Vectors that are null or hold null or non-finite components, and rows with a null vec_id, take no part; vectors of other lengths than the query's aren't
candidates for it. Zero vectors take part. If rows repeat a vec_id, each is a candidate, and the query is the least of its
vectors. Fewer candidates than k give all of them; an empty table none. Other columns are not read. A score that no long holds is an error.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskloom.llm.common import table, written

K, EVERY, SHARD, QUERY_BLOCK, LEAF = 10, 100, 8192, 1024, 64
FOUND = "query_id long, vec_id long, score long"


def prepared(embeddings: DataFrame) -> DataFrame:
    """(vec_id, dim, v) of the vectors that take part; v holds whole numbers as doubles."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for vec_id, e in zip(b.vec_id, b.embedding):
                x = np.asarray(e, dtype=float)
                if len(x) and np.isfinite(x).all():
                    out.append((vec_id, len(x), (np.floor(1024 * x) + 0.0).tobytes()))
            yield pd.DataFrame(out, columns=["vec_id", "dim", "v"])

    usable = embeddings.where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    slim = usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return slim.mapInPandas(read, "vec_id long, dim int, v binary")


class BallTree:
    def __init__(self, points: np.ndarray) -> None:
        self.points, self.rows, self.children, centres, radii = points, [], [], [], []
        todo = [(np.arange(len(points)), -1)]
        while todo:
            rows, parent = todo.pop()
            if parent >= 0:
                self.children[parent].append(len(centres))
            x = points[rows]
            centre = x.mean(0)
            far = np.sqrt(((x - centre) ** 2).sum(1))
            centres.append(centre)
            radii.append(far.max())
            self.children.append([])
            self.rows.append(rows)
            if len(rows) > LEAF and radii[-1] > 0:
                # Two points far from each other; each row goes to the nearer one.
                a = x[far.argmax()]
                to_a = ((x - a) ** 2).sum(1)
                left = to_a <= ((x - x[to_a.argmax()]) ** 2).sum(1)
                if 0 < left.sum() < len(rows):
                    todo += [(rows[left], len(centres) - 1), (rows[~left], len(centres) - 1)]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def search(self, queries: np.ndarray, own: list[np.ndarray], ids: np.ndarray, k: int, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query, the best k rows with a score of `least` or more: (query, rows, scores)."""
        length = np.sqrt((queries**2).sum(1))
        bounds = queries @ self.centres.T + length[:, None] * self.radii
        bounds += 1e-9 * (np.abs(bounds) + 1) + 1e-9 * length[:, None] * np.sqrt((self.centres**2).sum(1))
        for q, bound in enumerate(bounds):
            rows, scores, now = np.zeros(0, int), np.zeros(0, queries.dtype), least[q]
            heap = [(-bound[0], 0)]
            while heap and -heap[0][0] >= now:
                node = heapq.heappop(heap)[1]
                if self.children[node]:
                    for c in self.children[node]:
                        if bound[c] >= now:
                            heapq.heappush(heap, (-bound[c], c))
                    continue
                new = self.rows[node]
                new = new[ids[new] != own[q]]
                score = products(self.points[new], queries[q])
                rows, scores = np.concatenate([rows, new[score >= now]]), np.concatenate([scores, score[score >= now]])
                if len(rows) > k:
                    best = np.lexsort((ids[rows], -scores))[:k]
                    rows, scores = rows[best], scores[best]
                if len(rows) == k:
                    now = max(now, scores.min())
            yield q, rows, scores


def products(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    top = np.abs(points).max(initial=0) * np.abs(query).max(initial=0) * len(query)
    if top < 2**53:
        return points @ query
    return np.array([sum(int(a) * int(b) for a, b in zip(p, query)) for p in points], dtype=object)


def wave(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Searches every (query block, shard) that both sides name; queries bring `least`, null for none."""

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({x: np.zeros(0, np.int64) for x in ("query_id", "vec_id", "score")})
        points, ids = np.array([np.frombuffer(v) for v in c.v]), c.vec_id.to_numpy()
        asked, least = np.array([np.frombuffer(v) for v in q.v]), q.least.astype(float).fillna(-np.inf).to_numpy()
        names = q.query_id.to_numpy()
        out = [(np.full(len(r), names[i]), ids[r], [int(x) for x in s]) for i, r, s in BallTree(points).search(asked, names, ids, k, least)]
        return pd.DataFrame({name: np.concatenate([np.asarray(x[j], np.int64) for x in out]) for j, name in enumerate(("query_id", "vec_id", "score"))})

    by = ["dim", "block", "shard"]
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # queries come from the same table
    return queries.groupBy(*by).cogroup(rows.groupBy(*by)).applyInPandas(search, FOUND)


def top_k(embeddings: DataFrame, asked: Column, k: int = K, shard: int = SHARD, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `asked` holds for, the k best others."""
    rows = written(prepared(embeddings), "top-k-rows")
    queries = rows.where(asked).groupBy("dim", F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    n, n_asked = rows.count(), rows.where(asked).count()
    shards, blocks = max(1, math.ceil(n / shard)), max(1, math.ceil(n_asked / query_block))
    rows = rows.withColumn("shard", F.expr(f"pmod(xxhash64(vec_id, 1), {shards})").cast("int"))
    queries = queries.withColumn("block", F.expr(f"pmod(xxhash64(query_id, 2), {blocks})").cast("int")).withColumn("home", F.col("block") % shards)
    everywhere = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    first = wave(queries.withColumn("shard", F.col("home")).withColumn("least", F.lit(None).cast("long")), everywhere.where(f"shard = block % {shards}"), k)
    first = written(first, "top-k-first")
    # The k-th score of the first wave; fewer than k candidates there bound nothing.
    bound = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    others = queries.join(bound, "query_id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home")
    found = first.unionByName(wave(others, everywhere.where(f"shard <> block % {shards}"), k))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


SQL = f"""
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
