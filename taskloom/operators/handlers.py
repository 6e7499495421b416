"""Routing tasks to handlers and applying them; one bad row becomes an error row, never a failed job."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskloom.functions.payload import MATH
from taskloom.functions.text import fixed
from taskloom.schema import DIVISION_BY_ZERO, NO_HANDLER, PROCESSED, UNKNOWN_OPERATION
from taskloom.session import ship_package


def handler_route_join(tasks: DataFrame, handlers: DataFrame) -> DataFrame:
    """Attach the handler kind by task type; a missing one is an error text.

    The registry holds one row per task type. Spark broadcasts it while it is below the session's
    broadcast threshold and joins it by key otherwise.
    """
    missing = F.when(F.col("handler_kind").isNull(), F.concat(F.lit(NO_HANDLER), F.col("task_type")))
    return tasks.join(handlers, "task_type", "left").withColumn("error", missing)


def parse_math(data: Column) -> Column:
    return F.from_json(data, MATH)


def math_outcome(args: Column) -> Column:
    """Value and error of a parsed arithmetic request; operands default to 0."""
    op = F.coalesce(args["operation"], F.lit("None"))
    a, b = F.coalesce(args["a"], F.lit(0.0)), F.coalesce(args["b"], F.lit(0.0))
    value = F.when(op == "add", a + b).when(op == "multiply", a * b).when(op == "divide", F.try_divide(a, b))
    error = F.when((op == "divide") & (b == 0), DIVISION_BY_ZERO).when(
        ~op.isin("add", "multiply", "divide"), F.concat(F.lit(UNKNOWN_OPERATION), op)
    )
    return F.struct(value.alias("value"), error.alias("error"))


def math_handler(outcome: Column) -> tuple[Column, Column]:
    return fixed(outcome["value"], 6), outcome["error"]


def simple_handler(data: Column) -> tuple[Column, Column]:
    return F.concat(F.lit(PROCESSED), F.coalesce(data, F.lit("None"))), F.lit(None).cast("string")


ColumnHandler = Callable[[Column], tuple[Column, Column]]
Step = Callable[[Column], Column]


class Handlers:
    """Handler functions by kind: column expressions, or Python functions for what columns cannot express.

    A column handler may name steps that prepare its input. Each is a projection of its own, computed once
    per row, where one long expression would repeat its parts.
    """

    def __init__(self) -> None:
        self.columns: dict[str, tuple[ColumnHandler, tuple[Step, ...]]] = {}
        self.python: dict[str, Callable[[str], object]] = {}

    def register(self, kind: str, handler: ColumnHandler, *steps: Step) -> Handlers:
        self.columns[kind] = (handler, steps)
        return self

    def register_python(self, kind: str, handler: Callable[[str], object]) -> Handlers:
        self.columns.pop(kind, None)
        self.python[kind] = handler
        return self


def default_handlers() -> Handlers:
    return Handlers().register("math", math_handler, parse_math, math_outcome).register("simple", simple_handler)


class HandlerError(Exception):
    """A failure of a column handler, or a missing handler."""


OnError = Callable[[dict, Exception], object]


def apply_handlers(routed: DataFrame, handlers: Handlers, on_error: OnError | None = None) -> DataFrame:
    """Adds ``result``, ``error`` and ``handler_s`` (Python handlers only) to routed rows, in one pass over them.

    Rows stay in the JVM unless there is a Python handler or ``on_error``; then all go through one Arrow pass, which hands the
    others through. ``on_error`` gets each failed task, as a dict, and its exception, on the worker; what it returns is kept as text in ``noted``. It is
    called once for each failed row that the pass puts out; a task that Spark runs again calls it again.
    """
    kind = F.col("handler_kind")
    known = [*handlers.columns, *handlers.python]
    unknown = kind.isNotNull() & ~kind.isin(known)
    prepared = routed.withColumn("handler_s", F.lit(None).cast("double"))
    result, error = F.lit(None).cast("string"), F.col("error")
    for name, (handler, steps) in handlers.columns.items():
        source = "data"
        for step in steps:
            prepared = prepared.withColumn(f"_in_{name}", F.when(kind == name, step(F.col(source))))
            source = f"_in_{name}"
        value, failure = handler(F.col(source))
        result = F.when(kind == name, value).otherwise(result)
        error = F.when(kind == name, failure).otherwise(error)
    error = F.when(unknown, F.concat(F.lit(NO_HANDLER), F.col("task_type"))).otherwise(error)
    plain = (
        prepared.withColumns({"error": error, "result": result})
        .withColumn("result", F.when(F.col("error").isNull(), F.col("result")))
        .drop(*[f"_in_{name}" for name in handlers.columns])
    )
    if not handlers.python and on_error is None:
        return plain
    return _in_batches(plain, handlers.python, on_error)


def _in_batches(rows: DataFrame, functions: dict[str, Callable[[str], object]], on_error: OnError | None) -> DataFrame:
    columns = [f.name for f in rows.schema]

    def run(kind: str, data: str) -> tuple[str | None, Exception | None, float]:
        began = time.perf_counter()
        try:
            answer, failure = str(functions[kind](data)), None
        except Exception as exc:  # the row's own failure
            answer, failure = None, exc
        return answer, failure, time.perf_counter() - began

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            changed = {c: batch.column(c).to_pylist() for c in ("result", "error", "handler_s")}
            failures: dict[int, Exception] = {}
            own = [i for i, k in enumerate(batch.column("handler_kind").to_pylist()) if k in functions]
            kinds, data = (batch.column(c).take(pa.array(own, pa.int64())).to_pylist() for c in ("handler_kind", "data"))
            for i, kind, value in zip(own, kinds, data):
                changed["result"][i], failure, changed["handler_s"][i] = run(kind, value)
                changed["error"][i] = None if failure is None else str(failure)
                if failure is not None:
                    failures[i] = failure
            for c, values in changed.items():
                at = columns.index(c)
                batch = batch.set_column(at, c, pa.array(values, batch.schema.field(at).type))
            if on_error is not None:
                noted = [None] * batch.num_rows
                for i, text in enumerate(changed["error"]):
                    if text is not None:
                        answer = on_error(batch.slice(i, 1).to_pylist()[0], failures.get(i) or HandlerError(text))
                        noted[i] = None if answer is None else str(answer)
                batch = batch.append_column("noted", pa.array(noted, pa.string()))
            yield batch

    ship_package()
    noted = [T.StructField("noted", T.StringType())] if on_error is not None else []
    return rows.mapInArrow(batches, T.StructType([*rows.schema.fields, *noted]))


def split_errors(handled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and error rows. Write ``handled`` first and split the written copy, or handlers run twice."""
    failed = F.col("error").isNotNull()
    return handled.filter(~failed), handled.filter(failed)
