"""Chat formatting: conversations, one row per turn, through a compiled template, with a loss mask that can be read back.

Each conversation's turns are brought together in order by one shuffle on conv_id and a sort inside the partitions; a task then reads
its sorted rows as a stream and renders turn by turn, so memory holds one turn (and the next), however long the
conversation. The output has one row per turn: the formatted text that this turn adds, and the spans in it that are under
the loss mask. The rows of a conversation, joined in order, are its formatted text.

Texts can't forge turns: `\\`, `###` and `</turn>` in texts become `\\\\`, `\\h` and `\\t`; roles also hide `:` and line ends. `unescape` undoes it.

Null roles and texts count as empty. Rows with a null conv_id are one conversation. Turns that tie (null comes first) go by role, then text;
repeated rows are turns of their own. Other columns, of any name, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm.common import table
from taskloom.llm.template import Template

#: One message; the formatter runs it for each turn, with `last` true for the last one.
SOURCE = (
    "{% for m in messages %}### {{ m.role | escape_role }}: "
    '{% if m.role == "assistant" %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}'
)
HIDDEN = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t", ":": "\\c", "\n": "\\n", "\r": "\\r"}
SHOWN = {v: k for k, v in HIDDEN.items()}
IN_TEXT, IN_ROLE, ESCAPED = re.compile(r"\\|###|</turn>"), re.compile(r"\\|###|</turn>|:|\n|\r"), re.compile(r"\\.", re.S)


def escape(value) -> str:
    return IN_TEXT.sub(lambda m: HIDDEN[m[0]], value or "")


def escape_role(value) -> str:
    return IN_ROLE.sub(lambda m: HIDDEN[m[0]], value or "")


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: SHOWN[m[0]], text)


def compiled(source: str = SOURCE) -> Template:
    return Template(source, {"escape": escape, "escape_role": escape_role})


def in_turn(turns: DataFrame) -> DataFrame:
    """Whole conversations in order within partitions; ids travel as text, which keeps null and large ones exact."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    slim = turns.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b[c] for c in b.columns))


def batched(rows: Iterator[tuple], columns: list[str], size: int = 1000, chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= size or weight >= chars:
            yield pd.DataFrame(held, columns=columns)
            held, weight = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def format_conversations(turns: DataFrame, source: str = SOURCE) -> DataFrame:
    """conv_id, place (from 0), formatted, loss_spans (start and end within formatted), in order within partitions.

    A template that puts text out before or after all turns adds it to the first or last row.
    """
    compiled(source)  # a faulty template fails here

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        template = compiled(source)

        def placed() -> Iterator[tuple]:
            for conv_id, rows in groupby(rows_of(batches), key=lambda r: r[0]):
                read = {"turns": 0, "all": False}

                def messages(rows=rows, read=read) -> Iterator[dict]:
                    for _, role, text in rows:
                        read["turns"] += 1
                        yield {"role": role, "text": text}
                    read["all"] = True

                text, spans, place, length = [], [], 0, 0
                for piece, marked in template.render(messages=messages()):
                    # The loop reads one turn ahead, unless there is none.
                    if (turn := read["turns"] - (1 if read["all"] else 2)) > place:
                        yield conv_id, place, "".join(text), spans
                        text, spans, place, length = [], [], turn, 0
                    if marked:
                        spans.append((length, length + len(piece)))
                    text.append(piece)
                    length += len(piece)
                yield conv_id, place, "".join(text), spans

        yield from batched(placed(), ["conv_id", "place", "formatted", "loss_spans"])

    out = in_turn(turns).mapInPandas(render, "conv_id string, place long, formatted string, loss_spans array<struct<start:long,end:long>>")
    return out.withColumn("conv_id", F.col("conv_id").cast("long"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The digests of each conversation, from the formatted rows of `format_conversations` alone, with its turns read again."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def digests() -> Iterator[tuple]:
            for conv_id, rows in groupby(rows_of(batches), key=lambda r: r[0]):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                n, loss_chars, chars, rest = 0, 0, 0, ""
                for _, _, text, spans in rows:
                    chars += len(text)
                    for span in spans:
                        said = unescape(text[span["start"] : span["end"]])
                        loss.update(said.encode())
                        loss_chars += len(said)
                    *whole, rest = (rest + text).split("</turn>\n")
                    for x in whole:
                        role, _, body = x.removeprefix("### ").partition(": ")
                        turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                        n += 1
                yield conv_id, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        yield from batched(digests(), ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    rows = formatted.withColumn("conv_id", F.col("conv_id").cast("string"))
    out = rows.mapInPandas(parse, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumn("conv_id", F.col("conv_id").cast("long"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(turns.unionByName(extra)))
