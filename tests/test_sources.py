import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark import cli
from quillspark.sources import files, mail, markup, office, parsers
from quillspark.streaming import pickup

NS = "http://schemas.openxmlformats.org"
W = f'xmlns:w="{NS}/wordprocessingml/2006/main"'
A = f'xmlns:a="{NS}/drawingml/2006/main" xmlns:p="{NS}/presentationml/2006/main"'
S = f'xmlns="{NS}/spreadsheetml/2006/main" xmlns:r="{NS}/officeDocument/2006/relationships"'


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_rels_", "_rels/"), text)
    return out.getvalue()


def para(text, style=None, extra=""):
    return f"<w:p>{f'<w:pPr><w:pStyle w:val={style!r}/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r>{extra}</w:p>"


def docx():
    cell = lambda t, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{para(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('wide', '<w:gridSpan w:val=\"2\"/>')}{cell('c')}</w:tr><w:tr>{cell('tall', '<w:vMerge w:val=\"restart\"/>')}{cell('e')}{cell('f')}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('h')}{cell('i')}</w:tr></w:tbl>"
    brk = '<w:r><w:br w:type="page"/></w:r>'
    ref = '<w:r><w:footnoteReference w:id="1"/></w:r>'
    body = para("The Title", "Title") + para("Chapter", "Heading2") + para("Some text", None, ref) + f"<w:p>{brk}</w:p>" + para("Later") + table
    notes = f'<w:footnotes {W}><w:footnote w:id="0">{para("sep")}</w:footnote><w:footnote w:id="1">{para("the note")}</w:footnote></w:footnotes>'
    return zipped(**{"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/footnotes.xml": notes, "word/header1.xml": f"<w:hdr {W}>{para('HEAD')}</w:hdr>", "word/styles.xml": f'<w:styles {W}><w:style w:styleId="Heading2"><w:name w:val="heading 2"/></w:style></w:styles>'})


def pptx():
    shape = lambda t, kind, y: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = lambda shapes: f"<p:sld {A}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>"
    return zipped(**{"ppt/slides/slide2.xml": slide(shape("Second", "title", 5)), "ppt/slides/slide1.xml": slide(shape("body text", "body", 900) + shape("First", "ctrTitle", 10)), "ppt/notesSlides/notesSlide1.xml": slide(shape("speak up", "body", 0))})


def xlsx():
    c = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = f'<worksheet {S}><sheetData><row>{c("A1", "Product")}{c("C1", "Q1")}</row><row>{c("A2", "x|y")}<c r="C2" t="s"><v>0</v></c></row></sheetData></worksheet>'
    merged = f'<worksheet {S}><sheetData><row>{c("A1", "All")}</row><row>{c("A2", "l")}{c("B2", "r")}</row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>'
    book = f'<workbook {S}><sheets><sheet name="Sales" sheetId="1" r:id="rId1"/><sheet name="Merged" sheetId="2" r:id="rId2"/></sheets></workbook>'
    return zipped(**{"xl/workbook.xml": book, "xl/sharedStrings.xml": f"<sst {S}><si><t>shared</t></si></sst>", "xl/worksheets/sheet1.xml": sheet, "xl/worksheets/sheet2.xml": merged})


def test_docx():
    p = office.parse_docx(docx(), {})
    kinds = [(i.type, i.page) for i in p.items]
    assert kinds == [("text:title", 1), ("text:section", 1), ("text:normal", 1), ("text:normal", 2), ("table", 2), ("text:header", 1), ("text:footnote", 2)]
    assert "Some text[^1]" in p.content and "[^1]: the note" in p.content and "HEAD" not in p.content
    assert '<th colspan="2">wide</th>' in p.content and '<td rowspan="2">tall</td>' in p.content and "<!-- page 2 -->" in p.content


def test_pptx():
    p = office.parse_pptx(pptx(), {})
    assert [(i.type, i.content, i.page) for i in p.items] == [("text:title", "First", 1), ("text:normal", "body text", 1), ("text:normal", "[Slide 1 Notes]\nspeak up", 1), ("text:title", "Second", 2)]
    assert p.content.startswith("<!-- slide 1 -->\n\n# First") and p.metadata["slide_count"] == "2"


def test_xlsx():
    p = office.parse_xlsx(xlsx(), {})
    assert "| Product | Q1 |\n| --- | --- |\n| x\\|y | shared |" in p.content
    assert '<th colspan="2">All</th>' in p.content and p.content.count("<!-- sheet") == 2 and p.metadata["sheet_names"] == "Sales, Merged"


def test_mail():
    plain = b"From: a@x\nTo: b@x\nCc: c@x\nSubject: Hi\n\nhello\n"
    p = mail.parse_mail(plain, {})
    assert p.content == "# Hi\n\n**From:** a@x  \n**To:** b@x  \n**Cc:** c@x  \n\n---\n\nhello"
    page = b"From: a@x\nContent-Type: text/html\n\n<h1>T</h1><p>x</p>"
    assert mail.parse_mail(page, {}).content.startswith("# (no subject)") and "# T\n\nx" in mail.parse_mail(page, {}).content
    multi = b'From: a@x\nSubject: M\nContent-Type: multipart/alternative; boundary="b"\n\n--b\nContent-Type: text/html\n\n<p>html</p>\n--b\nContent-Type: text/plain\n\nplain\n--b--\n'
    assert mail.parse_mail(multi, {}).content.endswith("plain") and "html" not in mail.parse_mail(multi, {}).content


def test_data_formats():
    p = parsers.parse_csv(b"Name;Age\nJo;3\nLonger;\n", {})
    assert p.content == "| Name   | Age |\n|--------|-----|\n| Jo     | 3   |\n| Longer |     |" and p.metadata["row_count"] == "3"
    assert parsers.parse_csv(b"a|b\n1|2\n", {"delimiter": "|"}).metadata["column_count"] == "2" and parsers.parse_csv(b"", {}).content == ""
    assert parsers.parse_tsv(b"a\tb,c\n", {}).metadata["column_count"] == "2"
    assert parsers.parse_json(b'{"a": 1, "b": {"c": [1, {"d": null}]}}', {}).content == "**a**: 1\n**b**:\n  **c**:\n    - 1\n    - Item 2:\n      **d**: None"
    assert parsers.parse_json(b"[1, 2]", {}).metadata == {"data_type": "list", "item_count": "2"}
    assert parsers.parse_jsonl(b'{"id": 1}\nbad\n\n{"id": 2}\n', {}).metadata["record_count"] == "2"
    t = parsers.parse_text("ALL CAPS\nnot\n".encode(), {})
    assert t.content == "## ALL CAPS\nnot\n" and t.metadata == {"word_count": "3", "line_count": "3"}
    assert parsers.parse_text("é".encode("cp1252"), {"encoding": "cp1252"}).content == "é" and parsers.parse_text(b"", {}).metadata["line_count"] == "1"


def test_markup():
    assert parsers.markdown_of_html("<h1>T</h1><p>a <b>b</b> <a href='u'>l</a></p><ol><li>x<li>y</ol><img src=s alt=q>") == "# T\n\na**b**[l](u)\n\n1. x\n2. y\n![q](s)"
    assert "track" in parsers.markdown_of_html("<script>track()</script>x") and parsers.markdown_of_html("<script>track()</script>x", clean=True) == "x"
    p = markup.parse_markdown(b"---\ntitle: T\n---\n# H\n[a](b) ![i](p)\n", {})
    assert p.metadata["frontmatter"] == "{'title': 'T'}" and (p.metadata["header_count"], p.metadata["link_count"], p.metadata["image_count"]) == ("1", "2", "1")
    x = markup.parse_xml(b'<root><item id="1"><name>n</name></item>tail</root>', {})
    assert x.content == "# root\n\n## item\n\n- **id**: 1\n\n### name\n\nn\n\ntail" and x.metadata == {"root_tag": "root", "element_count": "2"}
    with pytest.raises(parsers.ProcessingError):
        markup.safe_xml(b'<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>')


def test_images_and_adapters():
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    assert office.parse_image(png, {}).metadata == {"format": "PNG", "width": "640", "height": "480"}
    assert "read" in office.parse_image(png, {"image_adapter": lambda b: "read"}).content
    with pytest.raises(parsers.UnsupportedFormatError):
        parsers.parse_bytes(b"%PDF", "pdf")
    assert parsers.parse_bytes(b"%PDF", "pdf", {"pdf_adapter": lambda b: parsers.Parsed("text")}).content == "text"


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    for name, content in {"a.txt": b"TITLE\nbody", "b.HTM": b"<p>x</p>", "sub/c.docx": docx(), "d.xlsx": b"broken", "e.unknown": b"?", "f.json": b"{", "g.csv": b"a,b\n1,2\n"}.items():
        (d / name).write_bytes(content)
    return d


def test_folders(spark, folder, tmp_path):
    got = {r.path.rpartition("/")[2]: r for r in files.load_directory(spark, str(folder)).collect()}
    assert {n for n, r in got.items() if r.error is None} == {"a.txt", "b.HTM", "c.docx", "g.csv"}
    assert got["e.unknown"].error["class"] == "UnsupportedFormatError" and got["d.xlsx"].error["class"] == "ProcessingError"
    assert len(got["c.docx"]["items"]) == 7 and got["a.txt"].content == "## TITLE\nbody"
    summary = {r.status: r.n for r in files.batch_summary(files.batch_results(files.load_directory(spark, str(folder)))).collect()}
    assert summary == {"success": 4, "failed": 3}
    assert files.load(spark, str(folder / "g.csv")).metadata["row_count"] == "2"
    with pytest.raises(FileNotFoundError):
        files.load(spark, str(folder / "missing.txt"))
    with pytest.raises(parsers.UnsupportedFormatError):
        files.load(spark, str(folder / "e.unknown"))
    chosen = [str(folder / n) for n in ("g.csv", "a.txt")]
    assert [r.input_ordinal for r in files.load_files(spark, chosen).collect()] == [0, 1] and files.load_files(spark, []).count() == 0
    uris = ["file://" + chosen[0], str(folder / "gone.txt"), *chosen[1:]]
    assert [(r.input_ordinal, r.error and r.error["class"]) for r in files.load_files(spark, uris).collect()] == [(0, None), (1, "FileNotFoundError"), (2, None)]
    out = files.save_one_file_each(files.load_directory(spark, str(folder)), str(tmp_path / "out")).collect()
    assert len(out) == 4 and all(open(r.output_file).read() for r in out)


def test_document_cache(spark, folder):
    scanned = files.scan(spark, str(folder))
    everything, fresh = files.load_cached(scanned, None)
    cache = spark.createDataFrame(everything.collect(), everything.schema)
    again, fresh = files.load_cached(scanned, cache)
    assert fresh.count() == 0 and again.count() == 7
    assert files.load_cached(scanned, cache, clean=True)[1].count() == 7


def test_streamed_folder(spark, folder, tmp_path):
    q = pickup.sink(pickup.watch(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7


def test_cli(spark, folder, tmp_path, capsys):
    assert cli.main([str(folder), str(tmp_path / "o"), "--format", "json", "--exclude", "*.xlsx", "--exclude", "*.unknown", "--exclude", "f.*"]) == 0
    assert spark.read.json(str(tmp_path / "o")).count() == 4
    chosen = cli.select_files(files.scan(spark, str(folder)), sort="size", max_files=2).select(F.regexp_extract("path", "([^/]+)$", 1).alias("n")).collect()
    assert {r.n for r in chosen} == {"e.unknown", "f.json"}
