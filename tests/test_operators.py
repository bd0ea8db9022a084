from pyspark.sql import functions as F

from quillspark.functions import scalars as X
from quillspark.operators import chrome, enrich, geometry, items, render, tables
from quillspark.sources import formats
from quillspark.streaming import cache_state


def one(spark, column, value="", kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first()["x"]


def test_repeated_heads_and_feet(spark):
    rows = [(1, p * 2, "text:normal", "Company Name", p, 20.0) for p in range(1, 6)] + [(1, p * 2 + 1, "text:normal", f"Body {p}", p, 400.0) for p in range(1, 6)]
    rows += [(2, p, "text:normal", "Company Name", p, 20.0) for p in (1, 2)]
    rows += [(3, p, "text:normal", f"Page {p}", p, 750.0) for p in range(1, 5)]
    df = spark.createDataFrame(rows, "doc_id long, seq int, type string, content string, page int, position_y double")
    got = chrome.retype_chrome(df).collect()
    assert len(got) == len(rows)
    kinds = {(r.doc_id, r.type): 0 for r in got}
    for r in got:
        kinds[r.doc_id, r.type] += 1
    assert kinds == {(1, "text:header"): 5, (1, "text:normal"): 5, (2, "text:normal"): 2, (3, "text:footer"): 4}


def test_classification(spark):
    rows = [("Anything", "Title", "text:title"), ("x", "Heading 1", "text:title"), ("x", "Heading 2", "text:section"), ("x", "Subtitle", "text:title"), ("x", "Heading 10", "text:title"), ("1. item", "", "text:list"), ("Figure 3: a", "", "text:caption"), ("Note: b", None, "text:caption"), ("plain", "Normal", "text:normal"), ("", "Title", "text:normal")]
    df = spark.createDataFrame(rows, "t string, s string, want string")
    assert all(r.want == r.got for r in df.select("want", items.classify(F.col("t"), F.col("s")).alias("got")).collect())


def test_tables(spark):
    rows = [(1, 0, 0, "Overview", 1, 9), (1, 0, 1, "x", 1, 1), (1, 0, 2, "Q|1", 1, 1), (1, 1, 0, "a<b", 5, 1), (1, 1, 1, None, 1, 1), (1, 2, 2, " z\ny ", 1, 1)]
    df = spark.createDataFrame(rows, "table_id long, r int, c int, text string, rowspan int, colspan int")
    n = {(r.r, r.c): r for r in tables.normalize(df).collect()}
    assert len(n) == 9 and n[0, 0].colspan == 3 and n[1, 0].rowspan == 2 and n[2, 0].is_continuation and n[2, 2].text == "z\ny"
    html = tables.to_html_table(tables.normalize(df)).first().html
    assert '<th colspan="3">Overview</th>' in html and '<td rowspan="2">a&lt;b</td>' in html
    assert tables.render(tables.normalize(df)).first().rendered == html
    flat = tables.to_pipe_table(tables.normalize(df.withColumns({"rowspan": F.lit(1), "colspan": F.lit(1)}))).first().markdown
    assert flat == "| Overview | x | Q\\|1 |\n| --- | --- | --- |\n| a<b |  |  |\n|  |  | z<br>y |\n"
    spans = spark.createDataFrame([("2",), ("0",), ("-1",), ("x",), (None,)], "v string").select(tables.span(F.col("v")).alias("s")).collect()
    assert [r.s for r in spans] == [2, 1, 1, 1, 1]


def test_pdf_rendering(spark):
    rows = [(1, 0, "text:header", "H", 1), (1, 1, "text:title", "T", 1), (1, 2, "text:normal", "a\n\n\n\nb", 1), (1, 3, "text:footnote", "1. a note", 2), (1, 4, "text:header", "H", 3)]
    df = spark.createDataFrame(rows, "doc_id long, seq int, type string, content string, page int")
    assert render.render_pdf(df).first().markdown == "# T\n\na\n\nb\n\n<!-- page 2 -->\n\n[^1]: a note"
    assert render.render_office(df, "slide").first().markdown.startswith("<!-- slide 1 -->\n\n# T")


def test_strategy(spark):
    rows = [(1, 1, 60.0, 100.0, 50, 0.0), (2, 1, 60.0, 100.0, 900, 0.1), (3, 1, 60.0, 100.0, 900, 0.5), (4, 1, 10.0, 100.0, 5, 0.9)]
    got = geometry.page_strategy(spark.createDataFrame(rows, "doc_id long, page int, image_area double, page_area double, n_chars long, illegible double")).collect()
    assert {r.doc_id: r.strategy for r in got} == {1: "image", 2: "text", 3: "image", 4: "text"}


def test_heading_shapes(spark):
    texts = ["1.2 Scope of work", "第3章 總則", "Appendix A", "3.14 is a number.", "2.0beta release", "一、前言", "This is a sentence, with commas, and more, and more", "SHORT CAPS"]
    rows = [(t, 1, 12.0, 12.0, 14.0, False, t.isupper()) for t in texts]
    f = geometry.heading_features(spark.createDataFrame(rows, "text string, line_count int, block_size double, avg_size double, max_size double, is_bold boolean, is_all_caps boolean"))
    got = {r.text: r.h for r in f.withColumn("h", geometry.is_heading()).collect()}
    assert got == dict(zip(texts, [True, True, True, False, True, True, False, True], strict=True))


def test_ocr_and_caches(spark):
    images = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, k string")
    results = spark.createDataFrame([("a", "text", True), ("b", " ", True)], "k string, text string, found boolean")
    assert {r.id: r.text for r in enrich.attach_ocr(images, results, ["k"]).collect()} == {1: "text", 3: enrich.MISSING}
    copies = spark.createDataFrame([(1, 2, b"x"), (1, 1, b"x"), (1, 3, b"y"), (2, 1, b"x")], "doc_id long, seq int, content binary")
    assert sorted((r.doc_id, r.seq) for r in enrich.first_of_each(copies, ["doc_id"]).collect()) == [(1, 1), (1, 3), (2, 1)]


def test_cache_state_machine():
    p = cache_state.Policy(ttl=10, max_age=25, max_refreshes=2)
    e = cache_state.use(None, 0, p)
    assert (e.created, e.expires, e.misses) == (0, 10, 1)
    e = cache_state.use(e, 9, p)
    assert (e.expires, e.refreshes, e.hits) == (19, 1, 1)
    e = cache_state.use(e, 18, p)
    assert (e.expires, e.refreshes) == (25, 2)  # bounded by age
    e = cache_state.use(e, 25, p)
    assert (e.created, e.misses) == (25, 2)  # expiry itself is too late


def test_stream_and_replay_agree(spark, tmp_path):
    rows = [(i, i % 3, i * i % 97 * 100) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, cache_key long, now long")
    df.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))
    q = cache_state.track(stream).writeStream.format("memory").queryName("cache_out").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("cache_out").collect())) == sorted(map(tuple, cache_state.replay(df).collect()))


def test_scalars(spark):
    assert one(spark, X.column_name(F.col("v")), 27, "long") == "AB" and [one(spark, X.column_name(F.col("v")), n, "long") for n in (26, 701, 702, 16383)] == ["AA", "ZZ", "AAA", "XFD"] and one(spark, X.column_name(F.col("v")), 25, "long") == "Z"
    assert one(spark, items.plain_text(F.col("v")), "# a **b** *c* [d](e) `f`") == "a b c d f" and one(spark, items.plain_text(F.col("v")), "x []() y") == "x []() y"
    assert one(spark, X.flatten_ocr(F.col("v")), "# Head\n- one\n\ntext <x>") == "[Head]: • one || text &lt;x&gt;"
    assert one(spark, X.strip_page_number(F.col("v")), "Page 12") == ""
    assert one(spark, render.truncate(F.col("v"), 3), "abcdef") == "abc… (truncated)"
    assert X.glob_to_regex("a*.t?t") == r"^a.*\.t.t$"


def test_formats(spark):
    names = [f"x.{f}" for f, _, _ in formats.FORMATS] + ["a.HTM", "b.Markdown", "c.nope", "noext", "dir.d/file"]
    got = {r.path: r.format for r in formats.route(spark.createDataFrame([(n,) for n in names], "path string")).collect()}
    assert all(got[f"x.{f}"] == f for f, _, _ in formats.FORMATS)
    assert (got["a.HTM"], got["b.Markdown"], got["c.nope"], got["noext"], got["dir.d/file"]) == ("html", "md", None, None, None)
    extra = formats.format_of_mime(spark.createDataFrame([("x/Y; q=1",)], "mime string"), extra=[("x/y", "txt")]).first()
    assert extra.format == "txt"
