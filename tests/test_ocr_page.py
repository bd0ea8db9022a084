import pytest

from quillspark.operators import ocr_page as O
from quillspark.operators import geometry

PAGE = (
    "struct<text:string,page_title:string,page_markdown:string,tables:array<struct<caption:string,headers:array<string>,rows:array<array<string>>,html:string,markdown:string>>,"
    "metrics:array<struct<label:string,value:string,unit:string,illustrative:boolean>>,"
    "figures:array<struct<title:string,kind:string,meaning:string,trend:string,illustrative:boolean,data_points:array<struct<label:string,value:string,series:string>>,nodes:array<struct<label:string,kind:string>>,edges:array<struct<`from`:string,`to`:string,label:string>>>>,"
    "sections:array<struct<heading:string,level:int,summary:string,key_points:array<string>>>>"
)


@pytest.mark.parametrize("html,want", [
    ("<table><tr><td onclick='x()' colspan='2'>a &amp; b</td></tr></table>", '<table><tr><td colspan="2">a &amp; b</td></tr></table>'),
    ("<table><script>bad()</script><tr><td><b>x</b><a href='javascript:1'>y</a></td></tr></table>", "<table><tr><td>xy</td></tr></table>"),
    ("```html\n<table><tr><td rowspan='two'>x</td></tr></table>\n```", "<table><tr><td>x</td></tr></table>"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>"),
    ("", ""), ("  ", ""), (None, ""), ("<style>p{}</style>plain < text", "plain &lt; text"),
])
def test_safe_tables(html, want):
    assert O.safe_table(html) == want


def test_rectangular_tables_and_grids():
    ragged = '<table><tr><th colspan="3">h</th></tr><tr><td rowspan="2">a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>'
    fixed = O.rectangular_table(ragged)
    assert fixed == ragged.replace("<td>b</td></tr>", "<td>b</td><td></td></tr>") and O.rectangular_table(fixed) == fixed
    assert O.html_grid(fixed) == [["h"] * 3, ["a", "b", ""], ["a", "c", "d"]]
    assert O.rectangular_table("no table") == "no table" and O.rectangular_table("") == ""
    text = f"intro\n{fixed}\n\n| x | y |\n|---|:-:|\n| 1 |  2  3 |\n\nend | not a table"
    assert O.grids(text) == [O.html_grid(fixed), [["x", "y"], ["1", "2 3"]]] and O.grids(None) == []


def test_on_spark(spark):
    df = spark.createDataFrame([("<table><tr><td>a<tr><td>b<td>c</table>",), (None,)], "h string")
    got = df.select(O.clean_table("h").alias("h"), O.table_grids("h").alias("g")).collect()
    assert got[0].h == "<table><tr><td>a</td><td></td></tr><tr><td>b</td><td>c</td></tr></table>" and got[1].h == "" and got[1].g == []


def render(spark, **page):
    names = ("text", "page_title", "page_markdown", "tables", "metrics", "figures", "sections")
    df = spark.createDataFrame([(tuple(page.get(n) for n in names),)], f"page {PAGE}")
    return df.select(O.page_markdown().alias("m")).first().m


def test_pages_in_full(spark):
    assert render(spark) == ""
    table = ("Cap", ["A", "B"], [["1", "2"], ["3"], ["4", "5", "6"]], None, None)
    got = render(spark, text=" Hello page 12 ", page_title="Title", tables=[table, (None, None, None, " <table></table> ", "x")], metrics=[("Rev", "5", "USD", False), (None, "7 %", "%", None), ("hid", "1", None, True)])
    assert got == "# Title\n\nHello page 12\n\nCap\n| A | B |\n| --- | --- |\n| 1 | 2 |\n| 3 |  |\n| 4 | 5 |\n\n<table></table>\n\n| Metric | Value |\n| --- | --- |\n| Rev | 5 USD |\n| — | 7 % |"
    assert render(spark, text="Title and more", page_title="Title") == "Title and more"


def test_figures_and_sections(spark):
    chart = ("Sales", "chart", "up", "rising", False, [("Q1", "3", None), ("", "", "x")], None, None)
    flow = (None, "flow", None, None, None, None, [("A", "box"), ("C", " end ")], [("A", "B", "go"), ("B", None, None)])
    hidden = ("x", "chart", "m", None, True, None, None, None)
    empty = ("t", "chart", None, None, False, [], [], [])
    got = render(spark, text="t", figures=[chart, flow, hidden, empty], sections=[("One", 1, "sum", ["k", " "]), ("Two", 2, None, None), ("", 1, "lost", None)])
    assert got == "t\n\n**Figure: Sales**\n*up rising*\n| Category | Value |\n| --- | --- |\n| Q1 | 3 |\n\n**Figure (flow)**\n- A --go--> B\n- B -->\n- C (end)\n\n**Section outline**\n- One\n  sum\n  - k\n  - Two".replace("\n  - Two", "\n  - Two")
    assert render(spark, text="t", sections=[("One", 1, " ", []), ("Two", 1, None, None)]) == "t"


def test_a_pages_own_markdown_needs_cover(spark):
    text = "alpha beta gamma delta epsilon zeta eta 1,234.5%"
    assert render(spark, text=text, page_markdown="## " + text) == "## " + text
    assert render(spark, text=text, page_markdown="alpha beta gamma delta epsilon zeta eta") == "alpha beta gamma delta epsilon zeta eta\n\n<!-- raw-verbatim-tail\n1,234.5%\n-->"
    assert render(spark, text=text, page_markdown="alpha beta") == text


def test_headings_need_layout_only_if_asked(spark):
    texts = ["A short plain line", "附件一 說明", "第 3 節 概要", "第一篇", "Chapter", "1.2.3a build", "1.2 Scope, of the work, that is meant", "Appendix " + "x" * 75, "Note: a, b and others, more than thirty-six characters"]
    f = geometry.heading_features(spark.createDataFrame([(t, 11.0, 11.0, 14.0, False, False) for t in texts], "text string, block_size double, avg_size double, max_size double, is_bold boolean, is_all_caps boolean"))
    got = {r.text: (r.a, r.b) for r in f.select("text", geometry.is_heading().alias("a"), geometry.is_heading(True).alias("b")).collect()}
    assert got == dict(zip(texts, [(True, False), (True, True), (True, True), (True, True), (True, True), (True, False), (False, False), (False, False), (False, False)], strict=True))
    assert f.filter("text = '1.2.3a build'").first().outline == ""
