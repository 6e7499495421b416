"""Quality classifier: a generalised additive model with pairwise terms over features of the whole text.

Each feature is cut into bins; the model is one lookup table per feature and one per chosen pair of features. The tables
are grown by boosting in turn: each step fits a tree of a few leaves to one feature's (or pair's) gradients and adds a small part of
it to that table. A score is the logistic of the sum of the looked-up values.

Training uses at most `sample` labelled documents, those with the least hash of the doc_id among labels of the training fold; their features (numbers, not texts) go
to the driver, where tables of a few kilobytes are fitted. Scoring is a column expression over every whole
text, with no shuffle. Inputs are features of the text alone.

Null and empty texts have all features 0 and get a score like others. Repeated labels of a document count once (the least
quality), as do repeated documents. Texts of any length are read whole; an empty table of documents gives no rows. With labels of only one class, or none, every score is the share of label 1, or 0.5.
Other columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm.common import table, words

SAMPLE, FOLDS, THRESHOLD = 20_000, 5, 0.3
FEATURES = (
    "words word_length distinct_words top_word repeated_next symbols digits upper stops blanks entropy single_bytes distinct_lines "
    "longest_word marked_words"
).split()
SYMBOL, DIGIT, UPPER, STOP, BLANK = (
    np.isin(np.arange(256), list(s)) for s in (rb"#$%&*+/<=>@[\]^_`{|}~", b"0123456789", bytes(range(65, 91)), b".,;:!?", b" \t\r\n\v\f")
)
MARKS = bytes(np.flatnonzero(SYMBOL).tolist())


def features(text: str | None) -> np.ndarray:
    out = np.zeros(len(FEATURES))
    found = words(text)
    if not found:
        return out
    raw = text.encode()
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = count[count > 0] / len(raw)
    seen, n, lines = Counter(found), len(found), raw.split(b"\n")
    out[:] = (
        np.log1p(n),
        sum(map(len, found)) / n,
        len(seen) / n,
        max(seen.values()) / n,
        sum(map(eq, found, found[1:])) / n,
        *(count[kind].sum() / len(raw) for kind in (SYMBOL, DIGIT, UPPER, STOP, BLANK)),
        -(share * np.log2(share)).sum(),
        sum(k for w, k in seen.items() if len(w) == 1) / n,
        len(set(lines)) / len(lines),
        np.log1p(max(map(len, seen))),
        sum(k for w, k in seen.items() if w[-1:] in MARKS) / n,
    )
    return out


def cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Borders that share the distinct values out evenly by their rows."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def shallow_tree(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The value for each bin after the best `leaves` - 1 cuts of the row of bins."""
    g, h = np.concatenate([[0], grad.cumsum()]), np.concatenate([[0], hess.cumsum()])
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    borders = [0, len(grad)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(borders, borders[1:]):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                if gain.max() > best[0]:
                    best = (gain.max(), int(at[gain.argmax()]))
        if best[1] is None:
            break
        borders = sorted([*borders, best[1]])
    out = np.empty(len(grad))
    for a, b in zip(borders, borders[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def four_cells(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of each axis at once: its gain, and the values of the table."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    cells = []
    for a, all_a in ((g, g[-1, -1]), (h, h[-1, -1])):
        corner, row, col = a[:-1, :-1], a[:-1, -1:], a[-1:, :-1]
        cells.append((corner, row - corner, col - corner, all_a - row - col + corner))
    gain = sum(x**2 / (y + ridge) for x, y in zip(*cells))
    if not gain.size:
        return 0.0, np.zeros_like(grad)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    v = [x[i, j] / (y[i, j] + ridge) for x, y in zip(*cells)]
    out = np.empty_like(grad)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


@dataclass
class Additive:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    wide: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edge, values) in enumerate(zip(self.edges, self.tables)):
            total += values[np.searchsorted(edge, x[:, j], "right")]
        for j, k, values in self.pairs:
            total += values[np.searchsorted(self.wide[j], x[:, j], "right"), np.searchsorted(self.wide[k], x[:, k], "right")]
        return 1 / (1 + np.exp(-total))


def fit(
    x: np.ndarray, y: np.ndarray, *, bins: int = 48, wide_bins: int = 12, rounds: int = 120, pair_rounds: int = 40,
    n_pairs: int = 8, rate: float = 0.1, leaves: int = 4, ridge: float = 1.0,
) -> Additive:
    if not len(y) or y.min() == y.max():
        return Additive(base=0.0 if not len(y) else float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))))
    model = Additive(base=float(np.log(y.mean() / (1 - y.mean()))))
    model.edges = [cuts(v, bins) for v in x.T]
    model.wide = [cuts(v, wide_bins) for v in x.T]
    fine = [np.searchsorted(e, v, "right") for e, v in zip(model.edges, x.T)]
    coarse = [np.searchsorted(e, v, "right") for e, v in zip(model.wide, x.T)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.base)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, b in enumerate(fine):
            g, h = gradients()
            n = len(model.tables[j])
            step = rate * shallow_tree(np.bincount(b, g, n), np.bincount(b, h, n), leaves, ridge)
            model.tables[j] += step
            total += step[b]

    def grid(j: int, k: int) -> tuple[float, np.ndarray, np.ndarray]:
        g, h = gradients()
        shape = len(model.wide[j]) + 1, len(model.wide[k]) + 1
        cell = coarse[j] * shape[1] + coarse[k]
        return *four_cells(*(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)), ridge), cell

    chosen = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -grid(*p)[0])[:n_pairs]
    model.pairs = [(j, k, np.zeros((len(model.wide[j]) + 1, len(model.wide[k]) + 1))) for j, k in chosen]
    for _ in range(pair_rounds):
        for j, k, values in model.pairs:
            _, step, cell = grid(j, k)
            values += rate * step
            total += rate * step.ravel()[cell]
    return model


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, quality, x) of at most `sample` labelled documents outside the held-out fold."""
    marked = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # At most `sample` rows are left, hence the broadcast.
    chosen = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts], dtype=object)

    return texts.select("doc_id", "quality", measured("text").alias("x"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    rows = sorted(training_rows(docs, labels, sample).collect())
    return fit(np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.quality for r in rows], float))


def score(text: Column, model: Additive) -> Column:
    """0 to 1 for each whole text."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))))

    return scored(text)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
