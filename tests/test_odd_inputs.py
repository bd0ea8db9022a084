"""Queries against their SQL on inputs that the driver's tables don't have."""

import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.operators import enrich, quality, sections, tables
from quillspark.plans import catalogue
from test_catalogue import plain


def agrees(spark, sf_dir, name, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    cursor = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    df = catalogue.queries()[name](spark, str(sf_dir))
    assert sorted(df.columns) == sorted(names)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    assert mine == sorted(tuple(map(plain, r)) for r in cursor.fetchall()) and mine


def documents(path, texts, copies):
    con = duckdb.connect()
    con.execute("create table d(doc_id bigint, text varchar)")
    for k, text in enumerate(texts):
        con.execute("insert into d select ? * 10000 + i, ? from range(?) r(i)", [k, text, copies])
    con.execute(f"copy d to '{path}/documents.parquet' (format parquet)")
    return path


def test_router_invariants_of_odd_texts(spark, tmp_path):
    """Blank texts, texts that begin with a label of the query's own, and those with its string that is nowhere."""
    texts = ["", " ", None, "\t", "\n \n", "\u00a0", "\u2003\u3000", "other text", "x \u0001nowhere y", "\u0001nowhere", "box word", "plain text"]
    agrees(spark, documents(tmp_path, texts, 200), "router_invariants", "documents")


@pytest.mark.parametrize("name", ["table_normalize", "table_pad", "table_markdown", "table_html", "table_styled", "table_grid"])
def test_tables_are_shuffled_once(spark, name):
    """Rows move once, to their table; cells never do."""
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_odd_tables(spark):
    """Short rows, gaps between rows, null spans and ids, a cell both tall and wide."""
    rows = [(1, 0, 0, " a ", 2, 2), (1, 0, 2, "b", 1, 1), (1, 1, 2, "c", None, None), (1, 3, 1, "d", 9, 9), (2, 0, 2, None, 1, 1), (None, 0, 0, "x", 1, 1)]
    n = tables.normalize(spark.createDataFrame(rows, "table_id long, r int, c int, text string, rowspan int, colspan int"))
    got = {(r.table_id, r.r, r.c): (r.text, r.rowspan, r.colspan, r.is_continuation) for r in n.collect()}
    assert len(got) == 12 and got[1, 0, 0] == ("a", 2, 2, False) and got[1, 1, 2] == ("c", 1, 1, False) and got[1, 3, 1] == ("d", 1, 2, False) and got[2, 0, 0] == ("", 1, 1, False)
    assert {k for k, v in got.items() if v == ("", 1, 1, True)} == {(1, 0, 1), (1, 1, 0), (1, 1, 1), (1, 3, 2)}
    grid = {r.table_id: r.grid for r in tables.to_grid(n).collect()}
    assert grid[1].split("\n") == ["| a ⊕ | →   | b |", "| ↓   | →   | c |", "|     | d ⊕ | → |"] and grid[2] == "|  |  |  |"


def test_coverage_of_long_texts(spark):
    """Thousands of distinct tokens, many of them lost: each is judged once, in a time that grows with the text."""
    text = " ".join(f"word{i} [a{i}](b{i}) 漢字{i}" for i in range(4000))
    shown = " ".join(f"xword{i}, a{i} 大漢字{i}" for i in range(4000))
    df = spark.createDataFrame([(text, shown), (text, None), ("a b", ""), (None, "x"), ("ab-c -de cd", "xab-c/ de")], "t string, s string")
    began = time.monotonic()
    got = [r.c for r in df.select(enrich.coverage(F.col("t"), F.col("s")).alias("c")).collect()]
    assert time.monotonic() - began < 30
    for (source, seen), c in zip(df.collect(), got, strict=True):
        tokens = [t for t in re.findall(enrich.PAGE_TOKEN, source or "") if len(t) > 1]
        lost = {t for t in tokens if t not in (seen or "")}
        assert c.missing == sorted(lost) and c.share == pytest.approx(1 - sum(t in lost for t in tokens) / len(tokens) if tokens else 1)


def test_preservation_of_long_texts(spark, tmp_path):
    """The plain rendering is made once a text, not once a line."""
    texts = ["\n".join(f"line {i} of **many** and *few* [a](b) " + "x" * 40 for i in range(6000)), "# a\n b \nb\n\n*c", " \n ", "", None, "\t\n**a**\n a"]
    began = time.monotonic()
    agrees(spark, documents(tmp_path, texts, 1), "text_preservation", "documents")
    assert time.monotonic() - began < 40


@pytest.mark.parametrize("name", ["chunk_documents", "chunk_pack"])
def test_documents_reach_python_line_by_line(spark, name):
    """A batch has lines, not arrays of whole documents, so a worker's memory doesn't grow with the texts of a batch."""
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_chunks_of_documents_over_several_batches(spark):
    """A document of more lines than a batch, its neighbours, and one without an id are each folded whole."""
    rows = [(d, i, "text:title" if i == 0 else "text:normal", f"{d} line {i}", 1) for d, n in ((1, 3), (2, 25000), (3, 2), (None, 2)) for i in range(n)]
    items = spark.createDataFrame(rows[::-1], "doc_id long, seq int, type string, content string, page int").coalesce(1)
    config = sections.ChunkConfig(overlap=0)
    got = {}
    for c in sections.chunk_documents(items, config).collect():
        got.setdefault(c.doc_id, {})[c.chunk_index] = c.content
    assert set(got) == {1, 2, 3, None} and got[1] == {0: "# 1 line 0\n\n1 line 1\n\n1 line 2"} and got[None] == {0: "# None line 0\n\nNone line 1"}
    whole = "\n\n".join(got[2][k] for k in range(len(got[2])))
    assert whole == "\n\n".join(["# 2 line 0", *[f"2 line {i}" for i in range(1, 25000)]])


def test_tables_are_compared_where_they_are(spark):
    plan = catalogue.queries()["table_fidelity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#\d+L, \d+\)", plan)) == {"l_orderkey"} and plan.count("Exchange hashpartitioning") <= 2


def test_accuracy_of_odd_tables(spark):
    """Places that only one side has, repeated places, null texts and ids: as a left join has them."""
    shape = "table_id long, r int, c int, text string"
    truth = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, None), (2, 0, 0, "a"), (2, 0, 0, "b"), (3, 0, 0, "a"), (None, 0, 0, "a"), (4, 0, 0, "a"), (4, 0, 1, None), (5, 0, 1, "a")], shape)
    got = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 2, "b"), (1, 1, 0, None), (2, 0, 0, "b"), (2, 0, 0, "b"), (2, 0, 0, "c"), (None, 0, 0, "a"), (4, 0, 0, "a"), (4, 0, 1, None), (5, 0, 0, "a"), (6, 0, 0, "a")], shape)
    want = truth.join(got.withColumnRenamed("text", "got"), ["table_id", "r", "c"], "left").groupBy("table_id").agg(F.avg(F.coalesce(F.col("text") == F.col("got"), F.lit(False)).cast("double")).alias("accuracy"))
    key = lambda df: sorted((str(r.table_id), r.accuracy) for r in df.collect())
    assert key(quality.cell_accuracy(truth, got)) == key(want)
