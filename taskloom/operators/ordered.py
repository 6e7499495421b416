"""Running values in an ordered group of any size: a blocked prefix scan.

A window over ``partitionBy(queue)`` puts a whole queue into one task. Here a chunk is a pure function of the leading order
columns, such as the hour of a time; windows run inside (group, chunk). Up-sweep: one row of totals per chunk,
combined map-side. A window over the totals gives what each chunk is handed by the chunks before it (or after it). Down-sweep: an equi-join on
(group, chunk) merges that into the rows. There is one path for all sizes, and nothing is counted, sampled, collected or written for it.

A task holds one chunk's rows, and a group's totals: one row per chunk that has rows. So a chunk should be as wide as a task can hold
of the busiest group; ``by_time`` and ``by_number`` take the width. Groups may be null. Measures of one call share
its exchange, totals and join; a measure that reads another's result needs a second call.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from taskloom.functions.times import micros

HOUR_S = 3600
# Rows of a counted order (attempts, leases) in one chunk.
NUMBERS = 4096
GROUP, CHUNK = "_group", "_chunk"

Over = Callable[[Column], Column]
Step = dict[str, Callable[["Frames"], Column]]


def by_time(column: str, width_s: int = HOUR_S) -> list[Column]:
    return [F.call_function("div", micros(F.col(column)), F.lit(width_s * 1_000_000))]


def by_number(column: str, width: int = NUMBERS) -> list[Column]:
    return [F.floor(F.col(column) / width)]


@dataclass(frozen=True)
class Frames:
    """Windows over the rows of a chunk, or over the chunks of a group."""

    ordered: WindowSpec

    @property
    def running(self) -> WindowSpec:
        return self.ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    @property
    def before(self) -> WindowSpec:
        return self.ordered.rowsBetween(Window.unboundedPreceding, -1)


@dataclass(frozen=True)
class Running:
    """A measure: windows inside the chunk, the chunk's totals, windows over the totals, and the values of the rows.

    Steps run one after the other; totals read the rows and the first windows, values read rows, windows and what was handed over."""

    inside: list[Step]
    totals: dict[str, Column]
    over: list[Step]
    values: dict[str, Column]
    own: set[str] = field(init=False)

    def __post_init__(self):
        names = {n for step in [*self.inside, *self.over] for n in step}
        object.__setattr__(self, "own", names | set(self.totals))


def _merged(name: str, inside: Callable, total: Column, over: Callable, merge: Callable) -> Running:
    here, sums, carry = f"_{name}_here", f"_{name}_total", f"_{name}_carry"
    value = merge(F.col(here), F.col(carry))
    return Running([{here: inside}], {sums: total}, [{carry: lambda w: over(F.col(sums), w)}], {name: value})


def running_sum(name: str, column: Column) -> Running:
    """Nulls add nothing; null until the first value."""
    return _merged(
        name,
        lambda w: F.sum(column).over(w.running),
        F.sum(column),
        lambda t, w: F.sum(t).over(w.before),
        lambda here, carry: F.coalesce(here + carry, here, carry),
    )


def row_number(name: str) -> Running:
    return running_sum(name, F.lit(1).cast("long"))


def running_max(name: str, column: Column) -> Running:
    return _merged(
        name,
        lambda w: F.max(column).over(w.running),
        F.max(column),
        lambda t, w: F.max(t).over(w.before),
        F.greatest,
    )


def _last(column: Column, order: Column) -> Column:
    return F.max_by(column, F.when(column.isNotNull(), order))


def last_seen(name: str, column: Column, order: list[str]) -> Running:
    """The latest non-null value up to and with the row."""
    return _merged(
        name,
        lambda w: F.last(column, ignorenulls=True).over(w.running),
        _last(column, F.struct(*order)),
        lambda t, w: F.last(t, ignorenulls=True).over(w.before),
        F.coalesce,
    )


def seen_before(name: str, column: Column, order: list[str]) -> Running:
    """The latest non-null value before the row."""
    return _merged(
        name,
        lambda w: F.last(column, ignorenulls=True).over(w.before),
        _last(column, F.struct(*order)),
        lambda t, w: F.last(t, ignorenulls=True).over(w.before),
        F.coalesce,
    )


def previous(name: str, column: Column, order: list[str]) -> Running:
    """The value of the row before. It travels in a struct, so that a null value differs from a missing neighbour."""
    return _merged(
        name,
        lambda w: F.lag(F.struct(column.alias("value"))).over(w.ordered),
        F.max_by(F.struct(column.alias("value")), F.struct(*order)),
        lambda t, w: F.lag(t).over(w.ordered),
        lambda here, carry: F.coalesce(here, carry)["value"],
    )


def following(name: str, column: Column, order: list[str]) -> Running:
    """The value of the row after."""
    return _merged(
        name,
        lambda w: F.lead(F.struct(column.alias("value"))).over(w.ordered),
        F.min_by(F.struct(column.alias("value")), F.struct(*order)),
        lambda t, w: F.lead(t).over(w.ordered),
        lambda here, carry: F.coalesce(here, carry)["value"],
    )


def running_level(name: str, change: Column) -> Running:
    """Running sum that never falls below 0: the sum minus its lowest value so far, if that is negative."""
    change = change.cast("long")
    s, low, total, least, base, floor = (f"_{name}_{x}" for x in ("sum", "low", "total", "least", "base", "floor"))
    before = F.coalesce(F.col(base), F.lit(0))
    lowest = F.least(F.lit(0), F.col(floor), before + F.col(low))
    return Running(
        [{s: lambda w: F.sum(change).over(w.running)}, {low: lambda w: F.min(s).over(w.running)}],
        {total: F.sum(change), least: F.min(low)},
        [
            {base: lambda w: F.sum(total).over(w.before)},
            {floor: lambda w: F.min(before + F.col(least)).over(w.before)},
        ],
        {name: before + F.col(s) - lowest},
    )


def sum_since(name: str, change: Column, mark: Column, order: list[str]) -> Running:
    """Sum of the changes after the latest marked row, and of all changes where none is marked yet."""
    s, at, total, last, base, held = (f"_{name}_{x}" for x in ("sum", "at", "total", "last", "base", "held"))
    before = F.coalesce(F.col(base), F.lit(0))
    return Running(
        [
            {s: lambda w: F.sum(change).over(w.running)},
            {at: lambda w: F.last(F.when(mark, F.col(s)), ignorenulls=True).over(w.running)},
        ],
        {total: F.sum(change), last: _last(F.when(mark, F.col(s)), F.struct(*order))},
        [
            {base: lambda w: F.sum(total).over(w.before)},
            {held: lambda w: F.last(before + F.col(last), ignorenulls=True).over(w.before)},
        ],
        {name: before + F.col(s) - F.coalesce(before + F.col(at), F.col(held), F.lit(0))},
    )


def paced(number: str, name: str, ready: Column, step: int) -> Running:
    """``number`` is the row's place i from 1; ``name`` is the largest ``ready_j - j * step`` of all rows j up to it."""
    i, top, count, most, base, held = (f"_{name}_{x}" for x in ("i", "top", "count", "most", "base", "held"))
    before = F.coalesce(F.col(base), F.lit(0))
    return Running(
        [
            {i: lambda w: F.row_number().over(w.ordered).cast("long")},
            {top: lambda w: F.max(ready - F.col(i) * step).over(w.running)},
        ],
        {count: F.count(F.lit(1)), most: F.max(ready - F.col(i) * step)},
        [
            {base: lambda w: F.sum(count).over(w.before)},
            {held: lambda w: F.max(F.col(most) - before * step).over(w.before)},
        ],
        {number: before + F.col(i), name: F.greatest(F.col(top) - before * step, F.col(held))},
    )


def ordered_scan(
    df: DataFrame, keys: list[str], order: list[str], chunk: list[Column], measures: list[Running]
) -> DataFrame:
    """Adds the measures' values. ``order`` ascends and is unique per group; ``chunk`` ascends with it."""
    # Structs compare null fields as equal, so the join needs no special case for null keys.
    rows = df.withColumns({GROUP: F.struct(*keys), CHUNK: F.struct(*[c.alias(f"c{n}") for n, c in enumerate(chunk)])})
    inside, over = Frames(Window.partitionBy(GROUP, CHUNK).orderBy(*order)), Frames(Window.partitionBy(GROUP).orderBy(CHUNK))
    rows = _stepped(rows, [m.inside for m in measures], inside)
    sums = rows.groupBy(GROUP, CHUNK).agg(*[c.alias(n) for m in measures for n, c in m.totals.items()])
    handed = _stepped(sums, [m.over for m in measures], over)
    carried = [n for m in measures for step in m.over for n in step]
    # The first chunk of a group is handed nothing, and most groups have no other.
    handed = handed.select(GROUP, CHUNK, *carried).where(reduce(or_, [F.col(n).isNotNull() for n in carried]))
    joined = rows.join(handed, [GROUP, CHUNK], "left")
    values = {n: c for m in measures for n, c in m.values.items()}
    return joined.withColumns(values).drop(GROUP, CHUNK, *[n for m in measures for n in m.own])


def _stepped(df: DataFrame, steps: list[list[Step]], frames: Frames) -> DataFrame:
    for depth in range(max(len(s) for s in steps)):
        df = df.withColumns({n: f(frames) for s in steps if depth < len(s) for n, f in s[depth].items()})
    return df


def _clamped(changes: list[int], x: int, lo: int, hi: int) -> list[int]:
    out = []
    for a in changes:
        x = min(hi, max(lo, x + a))
        out.append(x)
    return out


def bounded_level(
    df: DataFrame, keys: list[str], order: list[str], chunk: list[Column], change: Column, start: Column, name: str, lo: int, hi: int
) -> DataFrame:
    """A level that stays within ``lo`` and ``hi``: ``name`` after the row, ``name``_before before it. ``start`` is the group's level at first.

    A row is the function x -> min(hi, max(lo, x + a)). Such functions compose to ones of their kind, min(h, max(l, x + s)), where l and h
    are what becomes of lo and of hi. So the rows of a chunk are composed apart, a group's chunks (a row each) are applied in turn to its
    start, and a row's function from the chunk's begin is applied to what the chunk is handed.
    """
    cuts = [f"_c{n}" for n in range(len(chunk))]
    tagged = df.withColumns({**dict(zip(cuts, chunk)), "_change": F.coalesce(change.cast("long"), F.lit(0)), "_start": start.cast("long")})
    ends, prior = ["_low", "_high", "_sum"], ["_low0", "_high0", "_sum0"]

    def compose(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in order])
        steps = rows["_change"].to_pylist()
        values = [_clamped(steps, lo, lo, hi), _clamped(steps, hi, lo, hi), list(accumulate(steps))]
        for c, v in zip([*ends, *prior], [*values, *[[first, *v[:-1]] for first, v in zip((lo, hi, 0), values)]]):
            rows = rows.append_column(c, pa.array(v, pa.int64()))
        return rows

    schema = StructType([*tagged.schema, *[StructField(c, LongType()) for c in [*ends, *prior]]])
    composed = tagged.groupBy(*keys, *cuts).applyInArrow(compose, schema).withColumns({GROUP: F.struct(*keys), CHUNK: F.struct(*cuts)})
    whole = F.max_by(F.struct(*ends), F.struct(*order)).alias("f")
    totals = composed.groupBy(GROUP, CHUNK).agg(whole, F.first("_start").alias("_start")).select(
        F.to_json(GROUP).alias("g"), GROUP, CHUNK, "_start", "f.*"
    )
    totals = totals.withColumn("_at", F.row_number().over(Window.partitionBy(GROUP).orderBy(CHUNK)))

    def hand_over(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_at")
        x, handed = rows["_start"][0].as_py(), []
        for low, high, total in zip(*[rows[c].to_pylist() for c in ends]):
            handed.append(x)
            x = min(high, max(low, x + total))
        return rows.append_column("_x", pa.array(handed, pa.int64()))

    handed = totals.groupBy("g").applyInArrow(hand_over, StructType([*totals.schema, StructField("_x", LongType())]))
    joined = composed.join(handed.select(GROUP, CHUNK, "_x"), [GROUP, CHUNK])
    at = lambda low, high, total: F.least(high, F.greatest(F.col(low), F.col("_x") + F.col(total)))
    joined = joined.withColumns({name: at(*ends), f"{name}_before": at(*prior)})
    return joined.drop(GROUP, CHUNK, *cuts, *ends, *prior, "_change", "_start", "_x")
