"""The additive model against a plain search: the same cuts, the same cells, the same fitted tables, row by row."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pytest

from taskloom.llm import quality


def leaf_value(g, h, ridge):
    return sum(g) / (sum(h) + ridge)


def worth(g, h, ridge):
    return sum(g) ** 2 / (sum(h) + ridge)


def plain_tree(g, h, leaves, ridge):
    """Greedy cuts by trying every place of every part."""
    parts = [range(len(g))]
    for _ in range(leaves - 1):
        best = None
        for n, part in enumerate(parts):
            for cut in part[1:]:
                left, right = range(part[0], cut), range(cut, part[-1] + 1)
                gain = sum(worth([g[i] for i in p], [h[i] for i in p], ridge) for p in (left, right)) - worth([g[i] for i in part], [h[i] for i in part], ridge)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                    best = gain, n, left, right
        if best is None:
            break
        parts[best[1] : best[1] + 1] = best[2:]
    out = np.zeros(len(g))
    for part in parts:
        out[list(part)] = leaf_value([g[i] for i in part], [h[i] for i in part], ridge)
    return out


def plain_cells(g, h, ridge):
    rows, columns = g.shape
    best = 0.0, np.zeros((rows, columns))
    for i, j in product(range(1, rows), range(1, columns)):
        cells = [(slice(a, b), slice(c, d)) for a, b in ((0, i), (i, rows)) for c, d in ((0, j), (j, columns))]
        gain = sum(worth(g[s].ravel(), h[s].ravel(), ridge) for s in cells)
        if gain > best[0] + 1e-12:
            out = np.zeros((rows, columns))
            for s in cells:
                out[s] = leaf_value(g[s].ravel(), h[s].ravel(), ridge)
            best = gain, out
    return best


@pytest.mark.parametrize("seed", range(12))
def test_trees_and_cells(seed):
    rng = np.random.default_rng(seed)
    g, h = rng.normal(size=rng.integers(1, 14)), rng.random(20)
    for leaves in (1, 2, 4):
        assert quality.shallow_tree(g, h[: len(g)], leaves, 1.0) == pytest.approx(plain_tree(g.tolist(), h.tolist(), leaves, 1.0))
    shape = tuple(rng.integers(1, 7, 2))
    g, h = rng.normal(size=shape), rng.random(shape)
    gain, out = quality.four_cells(g, h, 1.0)
    plain_gain, plain_out = plain_cells(g, h, 1.0)
    assert gain == pytest.approx(plain_gain) and out == pytest.approx(plain_out)


def test_fit_row_by_row():
    """The same boosting with every sum taken over rows and every value looked up by counting borders."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(160, 3)).round(1)
    y = (x[:, 0] * x[:, 1] + 0.3 * x[:, 2] + 0.2 * rng.normal(size=160) > 0).astype(float)
    kwargs = {"bins": 6, "wide_bins": 4, "rounds": 5, "pair_rounds": 4, "n_pairs": 2, "rate": 0.3, "leaves": 3, "ridge": 1.0}
    model = quality.fit(x, y, **kwargs)

    def bin_of(borders, value):
        return sum(value >= b for b in borders)

    edges = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, 7)[1:-1]))) for j in range(3)]
    wide = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, 5)[1:-1]))) for j in range(3)]
    total = [float(np.log(y.mean() / (1 - y.mean())))] * len(y)
    tables, pairs = [[0.0] * (len(e) + 1) for e in edges], {}

    def gradients():
        p = [1 / (1 + np.exp(-t)) for t in total]
        return [a - b for a, b in zip(y, p)], [b * (1 - b) for b in p]

    for _ in range(kwargs["rounds"]):
        for j in range(3):
            g, h = gradients()
            bins = [bin_of(edges[j], v) for v in x[:, j]]
            sums = [[sum(v for v, b in zip(of, bins) if b == n) for n in range(len(tables[j]))] for of in (g, h)]
            step = plain_tree(*sums, 3, 1.0) * kwargs["rate"]
            tables[j] = [a + b for a, b in zip(tables[j], step)]
            total = [t + step[b] for t, b in zip(total, bins)]

    def cells_of(j, k):
        g, h = gradients()
        shape = len(wide[j]) + 1, len(wide[k]) + 1
        sums = [np.zeros(shape), np.zeros(shape)]
        at = [(bin_of(wide[j], a), bin_of(wide[k], b)) for a, b in zip(x[:, j], x[:, k])]
        for of, out in zip((g, h), sums):
            for v, cell in zip(of, at):
                out[cell] += v
        return *plain_cells(*sums, 1.0), at

    chosen = sorted(combinations(range(3), 2), key=lambda p: -cells_of(*p)[0])[:2]
    for _ in range(kwargs["pair_rounds"]):
        for p in chosen:
            _, step, at = cells_of(*p)
            pairs[p] = pairs.get(p, 0) + kwargs["rate"] * step
            total = [t + kwargs["rate"] * step[cell] for t, cell in zip(total, at)]
    for got, want in zip(model.tables, tables):
        assert got == pytest.approx(np.array(want))
    assert [(j, k) for j, k, _ in model.pairs] == chosen
    for j, k, values in model.pairs:
        assert values == pytest.approx(pairs[j, k])
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(-np.array(total))))
