"""Vectors, captures, conversations and the pipeline against brute force, and the queries against their SQL."""

from __future__ import annotations

import hashlib
import math
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2] / "tools"))

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402
import corpus_pipeline  # noqa: E402
from taskloom.llm import chat, common, near_vectors, queries, template, top_k, warc  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in compare.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    answer = con.execute(entry.oracle_sql()[name])
    theirs = compare.rows_of([d[0] for d in answer.description], answer.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in answer.description)
    assert compare.rows_of(df.columns, df.collect()) == theirs


def vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(400):
        x = centres[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.12, 0.8])
        rows.append((i, x.tolist(), int(i % 12 % 3)))
    rows += [(400 + i, rows[5][1], 2) for i in range(30)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [math.nan] * 16, 1), (503, rows[5][1], None), (504, [1.0, None], 1), (505, [], 1), (506, [1.0, 2.0], 1)]
    return rows + [(507, [2.0, 4.0], 1), (508, [1e-200] * 16, 1), (509, [3e-200] * 16, 1), (7, rows[7][1], rows[7][2]), (None, [1.0, 2.0], 1)]


def usable(x):
    return bool(x) and None not in x and all(map(math.isfinite, x))


@pytest.mark.parametrize("block", [2048, 16])
def test_near_vectors(spark, block):
    rows = vectors()
    n = len(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1)).withColumn("n", F.lit(1))
    unit = [np.array(x) / np.linalg.norm(np.array(x) / max(map(abs, x))) / max(map(abs, x)) if usable(x) and any(x) and lab is not None else None for _, x, lab in rows]
    a, b = [], []
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98:
                a.append(i), b.append(j)
    label = common.least_labels(n, np.array(a), np.array(b))
    links = np.bincount(a + b, minlength=n)
    want = []
    for i, (vec_id, _, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(n) if label[k] == label[i] and rows[k][0] is not None]
        least = min(ids) if ids else None
        want.append((vec_id, int(links[i]), least))
    got = near_vectors.near_vectors(df.repartition(3), block=block).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("shard, query_block", [(8192, 1024), (64, 16)])
def test_top_k(spark, shard, query_block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit(1)).withColumn("score", F.lit(1))
    whole = [(i, [math.floor(1024 * v) for v in x]) for i, x, _ in rows if i is not None and usable(x)]
    want = []
    for q in sorted({i for i, _ in whole if i % 7 == 0}):
        query = min((x for i, x in whole if i == q), key=lambda x: np.array(x, float).tobytes())
        found = sorted((-sum(a * b for a, b in zip(x, query)), i) for i, x in whole if i != q and len(x) == len(query))[:10]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    got = top_k.top_k(df.repartition(3), F.col("vec_id") % 7 == 0, shard=shard, query_block=query_block)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert top_k.top_k(df.limit(0), F.col("vec_id") % 7 == 0).count() == 0


def test_products_of_large_numbers():
    points = np.array([[2.0**40, -(2.0**30)], [3.0, 4.0]])
    assert top_k.products(points, np.array([2.0**20, 5.0])).tolist() == [2**60 - 5 * 2**30, 3 * 2**20 + 20]


def capture(i, url, at, status, headers, body=None):
    return (i, url, at, status, headers, body)


def test_revisits(spark):
    full = {"ETag": '"a"', "Content-Type": "text/html", "Date": "1"}
    rows = [
        capture(1, "http://www.A.example:80/x/?utm_source=f#top", 10, 200, full, "one"),
        capture(2, "https://a.example/x", 20, 304, {"etag": 'W/"a"', "Date": "2", "Set-Cookie": "s"}),
        capture(3, "https://a.example/x", 200_000, 200, full | {"ETag": '"b"'}, "two"),
        capture(4, "https://a.example/x", 900_000, 304, {"ETag": '"a"'}),
        capture(5, "https://a.example/x", 900_001, 304, {"ETag": '"b"'}),
        capture(6, "https://a.example/x", 900_002, 304, {}),
        capture(7, "https://a.example/y", 5, 304, {"ETag": '"a"'}),
        capture(8, None, 5, 304, {"ETag": '"a"'}), capture(9, None, 1, 200, full, "lost"),
        capture(10, "https://a.example/z", 5, 200, {"Last-Modified": "m"}, None), capture(11, "https://a.example/z", 5, 304, {"last-modified": "m"}),
        capture(12, "https://a.example/z", None, 304, {"last-modified": "m"}), capture(13, "https://a.example/z", 9, 404, None, "x" * 100_000),
        capture(14, "https://a.example/z?b=1&gclid=2&c=3", 1, 200, None, ""), capture(2, "https://a.example/x", 20, 304, {"etag": 'W/"a"', "Date": "2", "Set-Cookie": "s"}),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, at long, status int, headers map<string,string>, body string").withColumns({"slice": F.lit(1), "near": F.lit(1)})
    got = {r.record_id: r for r in warc.resolve(df).collect()}
    told = {i: (r.outcome, r.base_id, r.body) for i, r in got.items()}
    assert told == {
        1: ("full", None, "one"), 2: ("resolved", 1, "one"), 3: ("full", None, "two"), 4: ("changed", None, None), 5: ("resolved", 3, "two"),
        6: ("no validator", None, None), 7: ("no base", None, None), 8: ("no base", None, None), 9: ("full", None, "lost"), 10: ("full", None, None),
        11: ("resolved", 10, None), 12: ("no base", None, None), 13: ("other", None, "x" * 100_000), 14: ("full", None, ""),
    }
    assert got[2].headers == {"etag": 'W/"a"', "content-type": "text/html", "date": "2"}
    assert got[14].url_key == "a.example/z?b=1&c=3" and got[1].url_key == "a.example/x"
    assert warc.resolve(df.limit(0)).count() == 0


def test_revisits_without_ids_of_their_own(spark):
    """Captures without an id, or that share one, all come back, each with its own body; equal rows as often as they come."""
    tag = lambda x: {"ETag": x}
    rows = [
        capture(None, "http://a.example/x", 1, 200, tag("a"), "one"), capture(None, "http://a.example/y", 1, 200, tag("b"), "two"),
        capture(None, "http://a.example/x", 2, 304, tag("a")), capture(None, "http://a.example/y", 3, 304, tag("b")), capture(None, None, None, 404, None, None),
        capture(7, "http://a.example/z", 1, 200, tag("c"), "three"), capture(7, "http://a.example/z", 5, 200, tag("d"), "four"), capture(7, "http://b.example/", 5, 200, tag("e"), "five"),
        capture(8, "http://a.example/z", 3, 304, tag("c")), capture(8, "http://a.example/z", 6, 304, tag("d")), capture(9, "http://b.example/", 5_000_000, 304, tag("e")),
        capture(9, "http://b.example/", 5_000_000, 304, tag("e")), capture(7, "http://b.example/", 5, 200, tag("e"), "five"),
        capture(None, "http://c.example/", None, 200, tag("f"), "six"), capture(None, "http://c.example/", None, 304, tag("f")),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, at long, status int, headers map<string,string>, body string")
    got = sorted(((r.record_id, r.status, r.outcome, r.base_id, r.body) for r in warc.resolve(df).collect()), key=str)
    want = [(None, 200, "full", None, x) for x in ("one", "two", "six")] + [(7, 200, "full", None, x) for x in ("three", "four", "five", "five")]
    want += [(None, 304, "resolved", None, x) for x in ("one", "two")] + [(8, 304, "resolved", 7, x) for x in ("three", "four")] + [(9, 304, "resolved", 7, "five")] * 2
    want += [(None, 304, "no base", None, None), (None, 404, "other", None, None)]
    assert got == sorted(want, key=str)


def test_pages_without_ids_of_their_own(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = pages.withColumn("page_id", F.when(F.col("page_id") % 3 == 1, F.col("page_id")).when(F.col("page_id") % 3 == 2, F.col("page_id") - 1))
    got = warc.resolve(warc.captures_of(odd))
    assert got.count() == 2 * pages.count()
    bodies = lambda df, c: sorted(r[0] or "" for r in df.select(c).collect())
    assert bodies(got.where("status = 200"), "body") == bodies(pages, "html")


def render(source, **env):
    return list(template.Template(source).render(**env))


def test_templates():
    assert render("{% for m in ms %}{{ loop.index }}{% if not loop.last %}, {% endif %}{% endfor %}!", ms=iter("abc")) == [(x, False) for x in ("1", ", ", "2", ", ", "3", "!")]
    assert render("a{% generation %}{{ x.y['z'] | upper }}{% endgeneration %}", x={"y": {"z": "b"}}) == [("a", False), ("B", True)]
    assert render("{%- if a == 1 or b in 'xyz' -%}  yes {% elif c %}c{% else %}no{% endif %}", b="y") == [("yes ", False)]
    assert render("{# no #}{{ none }}{{ missing.key }}{{ 'x' + 'y' ~ 1 }}") == [("xy1", False)]
    assert template.Template("{% if 'a' == 'a' and not false %}{{ 'k' | upper }}l{% else %}{{ x }}{% endif %}").tree == (template.Out(template.Const("Kl")),)
    for bad in ("{{ x.__class__() }}", "{{ x", "{% if x %}", "{{ f(1) }}", "{% import os %}", "{{ 1 + }}", "{% for in in x %}{% endfor %}", "{{ x | eval }}"):
        with pytest.raises(template.TemplateError):
            if render(bad) and "{{ x" == bad:
                raise template.TemplateError  # an open tag is text
    assert render("{{ x.__class__ }}", x="text") == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("\\#</turn>:h \nx")))
def test_escapes(text):
    for f in (chat.escape, chat.escape_role):
        assert chat.unescape(f(text)) == text
        assert "###" not in f(text) and "</turn>" not in f(text)


def test_conversations(spark):
    nasty = "### user: x</turn>\n\\h\\"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 2, None, None), (1, 2, "assistant", "é" * 100_000), (2, 0, "assistant", ""), (2, None, "a: b\n", "first")]
    rows += [(None, 0, "user", "no id"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")] + [(2**60 + 1, i, "user", str(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(1)).withColumn("spans", F.lit(1))
    formatted = chat.format_conversations(df)
    assert formatted.count() == len(rows)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(x for *_, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(said))
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    rows = sorted((r.conv_id, r.place, r.formatted) for r in formatted.where("conv_id = 3").collect())
    assert rows == [(3, i, "### assistant: same</turn>\n") for i in (0, 1)]
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_pipeline(spark):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, common.written(stage(spark, docs, SF), name)
        assert docs.columns == before.columns and docs.dtypes == before.dtypes
        if name in ("quality", "ngram_join"):
            assert docs.join(before, before.columns, "left_anti").count() == 0 and 0 < docs.count() <= before.count()
        if name == "suffix_dedup":
            assert docs.count() == before.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert docs.count() and set(got) == {r.doc_id for r in docs.collect()} and all(labels.get(i) != 0 for i in got)


def test_pipeline_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame([(1, None, None, None, None), (1, "", "en", "src0", 0), (None, "a b c d e f", "en", "src1", 11)], schema).withColumn("score", F.lit(1))
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            now = common.written(stage(spark, now, SF), name)
        assert now.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_keeps_one_row_of_a_group(spark):
    """Rows without a doc_id, repeated rows, and rows that share a doc_id but not a text."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = lambda x: " ".join(f"{x}{i}" for i in range(60))
    rows = [(None, text("a"), "en", "src0", 1)] * 3 + [(5, text("b"), "en", "src0", 1)] * 2 + [(None, text("b"), "en", "src0", 1), (9, text("b") + " end", "de", None, 2)]
    rows += [(7, text("c"), "en", "src1", 1), (7, text("d"), "en", "src1", 1), (3, text("c"), "fr", "src1", 1), (4, text("e"), "en", "s", 1), (4, text("e"), "en", "t", 1)]
    rows += [(None, None, "en", "src0", 0)] * 2 + [(8, " \n", "en", "src0", 2)] * 2
    docs = spark.createDataFrame(rows, schema).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.distinct(spark, docs, SF).collect()), key=str)
    want = [(None, text("a")), (5, text("b")), (3, text("c")), (7, text("d")), (4, text("e")), (None, None), (None, None), (8, " \n"), (8, " \n")]
    assert got == sorted(want, key=str)
    assert corpus_pipeline.distinct(spark, docs, SF).columns == docs.columns


def test_pipeline_with_columns_named_as_inside(spark):
    names = ["d", "h", "spans", "mix_copy", "mix_order", "mix_group", "mix_key", "mix_cdf", "mix_n", "row", "hash", "cls", "rep", "root", "kept_id", "kept_hash", "x.y"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    now = docs.select("*", *[F.concat(F.lit(name), F.col("doc_id")).alias(name) for name in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, common.written(stage(spark, now, SF), name)
        assert now.dtypes == before.dtypes
    rows = now.collect()
    assert rows and all(r[name] == f"{name}{r.doc_id}" for r in rows for name in names)
    assert corpus_pipeline.encoded(spark, now, SF).count() == len(rows)
