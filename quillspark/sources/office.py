"""Office Open XML parsers with the standard library: zip and XML only."""

from __future__ import annotations

import html
import io
import re
import zipfile
import xml.etree.ElementTree as ET

from . import formats
from .markup import safe_xml
from .parsers import Item, Parsed, ProcessingError, UnsupportedFormatError, _meta, parser

NS = "http://schemas.openxmlformats.org"
W = "{" + NS + "/wordprocessingml/2006/main}"
A = "{" + NS + "/drawingml/2006/main}"
P = "{" + NS + "/presentationml/2006/main}"
S = "{" + NS + "/spreadsheetml/2006/main}"
R = "{" + NS + "/officeDocument/2006/relationships}"
CAPTION = re.compile(r"Chart|Fig|Graph|Image|Plate|Scheme|Table|Tbl|(?:Notes?|Source)[.:)]", re.I)
LISTED = re.compile(r"^[•\-*\d]+[.)]\s+")


def classify(text: str, style: str) -> str:
    low = style.lower()
    if "title" in low:
        return "text:title"
    if "heading" in low:
        return "text:title" if "1" in style else "text:section"
    if "caption" in low:
        return "text:caption"
    if "list" in low or "bullet" in low or LISTED.match(text):
        return "text:list"
    return "text:caption" if CAPTION.match(text) else "text:normal"


# Grids


def grid_to_text(rows: list[list[str]], spans: dict[tuple[int, int], tuple[int, int]], always_html: bool = False) -> str:
    """A pipe table; HTML with spans where cells are merged. ``spans``: (row, column) of a cell to its (rows, columns)."""
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [[(v or "").strip() for v in r] + [""] * (width - len(r)) for r in rows]
    if not spans and not always_html:
        line = lambda r: "| " + " | ".join(v.replace("\n", "<br>").replace("|", "\\|") for v in r) + " |"
        return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])]) + "\n"
    under = {(i, j) for (r, c), (h, w) in spans.items() for i in range(r, min(r + h, len(rows))) for j in range(c, min(c + w, width))} - set(spans)
    out = ["<table>"]
    for r, cells in enumerate(rows):
        tag, shown = ("th" if r == 0 else "td"), []
        for c, text in enumerate(cells):
            if (r, c) in under:
                continue
            h, w = spans.get((r, c), (1, 1))
            attrs = (f' rowspan="{h}"' if h > 1 else "") + (f' colspan="{w}"' if w > 1 else "")
            shown.append(f"<{tag}{attrs}>{html.escape(text, quote=False)}</{tag}>")
        out.append("  <tr>" + "".join(shown) + "</tr>")
    return "\n".join([*out, "</table>"])


def _part(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    return safe_xml(z.read(name)) if name in z.namelist() else None


def _open(content: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise ProcessingError(f"not an office file: {e}") from e


def _core(z: zipfile.ZipFile) -> dict[str, str | None]:
    core = _part(z, "docProps/core.xml")
    found = {e.tag.rpartition("}")[2]: e.text for e in core} if core is not None else {}
    return {"author": found.get("creator"), "title": found.get("title"), "creation_date": found.get("created"), "modification_date": found.get("modified")}


def office_markdown(items: list[Item], label: str) -> str:
    """Items under a marker at each page change, the first included; running heads and feet don't show."""
    out, page = [], None
    for i in items:
        if i.type in ("text:header", "text:footer") or not i.content.strip():
            continue
        if i.page is not None and i.page != page:
            page = i.page
            out.append(f"<!-- {label} {page} -->")
        out.append({"text:title": "# {}", "text:section": "## {}", "text:caption": "*{}*"}.get(i.type, "{}").format(i.content))
    return "\n\n".join(out)


# Documents


def _runs(p: ET.Element) -> str:
    out = []
    for e in p.iter():
        if e.tag == W + "t":
            out.append(e.text or "")
        elif e.tag == W + "tab":
            out.append("\t")
        elif e.tag == W + "br" and e.get(W + "type") != "page":
            out.append("\n")
        elif e.tag in (W + "footnoteReference", W + "endnoteReference"):
            out.append(f"[^{'en' if 'endnote' in e.tag else ''}{e.get(W + 'id')}]")
    return "".join(out).strip()


def _docx_table(table: ET.Element) -> str:
    rows: list[list[str]] = []
    spans: dict[tuple[int, int], tuple[int, int]] = {}
    open_at: dict[int, tuple[int, int]] = {}  # column to the cell that a vertical merge began in
    for r, tr in enumerate(table.findall(W + "tr")):
        row: list[str] = []
        for tc in tr.findall(W + "tc"):
            c, props = len(row), tc.find(W + "tcPr")
            grid = props.find(W + "gridSpan") if props is not None else None
            merge = props.find(W + "vMerge") if props is not None else None
            wide = int(grid.get(W + "val", "1")) if grid is not None else 1
            if merge is not None and merge.get(W + "val") != "restart" and c in open_at:
                start = open_at[c]
                spans[start] = (r - start[0] + 1, spans.get(start, (1, wide))[1])
                row += [""] * wide
                continue
            open_at.pop(c, None)
            if merge is not None:
                open_at[c] = (r, c)
            if wide > 1:
                spans[r, c] = (1, wide)
            row += ["\n".join(t for p in tc.findall(W + "p") if (t := _runs(p)))] + [""] * (wide - 1)
        rows.append(row)
    return grid_to_text(rows, {k: v for k, v in spans.items() if v != (1, 1)})


@parser("docx")
def parse_docx(content: bytes, options: dict) -> Parsed:
    """Body order; a page break counts where it stands, a section break after its paragraph; notes end the list."""
    z = _open(content)
    root = _part(z, "word/document.xml")
    if root is None:
        raise ProcessingError("no word/document.xml")
    styles = _part(z, "word/styles.xml")
    names = {s.get(W + "styleId"): (n.get(W + "val") if (n := s.find(W + "name")) is not None else "") for s in (styles.findall(W + "style") if styles is not None else [])}
    items: list[Item] = []
    page, fresh = 1, False
    body = root.find(W + "body")
    for e in body if body is not None else []:
        if e.tag == W + "p":
            for b in e.iter():
                if b.tag == W + "br" and b.get(W + "type") == "page" or b.tag == W + "lastRenderedPageBreak" and not fresh:
                    page += 1
            fresh = False
            style = e.find(f"{W}pPr/{W}pStyle")
            text = _runs(e)
            if text:
                key = style.get(W + "val") if style is not None else ""
                items.append(Item(classify(text, names.get(key, key) or ""), text, page))
            section = e.find(f"{W}pPr/{W}sectPr/{W}type")
            if section is not None and section.get(W + "val") in ("nextPage", "oddPage", "evenPage"):
                page, fresh = page + 1, True
        elif e.tag == W + "tbl":
            items.append(Item("table", _docx_table(e), page))
    for name in sorted(z.namelist()):
        if m := re.fullmatch(r"word/(header|footer)\d*\.xml", name):
            text = "\n".join(t for p in safe_xml(z.read(name)).iter(W + "p") if (t := _runs(p)))
            if text:
                items.append(Item(f"text:{m.group(1)}", text, 1))
    for part, prefix in (("footnotes", ""), ("endnotes", "en")):
        notes = _part(z, f"word/{part}.xml")
        for n in sorted((n for n in (notes if notes is not None else []) if n.get(W + "id") not in ("0", "-1")), key=lambda n: int(n.get(W + "id")) if (n.get(W + "id") or "").isdigit() else 0):
            text = " ".join(t for p in n.iter(W + "p") if (t := _runs(p)))
            if text:
                items.append(Item("text:footnote", f"[^{prefix}{n.get(W + 'id')}]: {text}", page))
    words = sum(len(i.content.split()) for i in items if i.type.startswith("text:"))
    return Parsed(office_markdown(items, "page"), _meta(page_count=page, word_count=words, **_core(z)), items)


# Slides


def _paragraphs(shape: ET.Element) -> str:
    return "\n".join(t for p in shape.iter(A + "p") if (t := "".join(x.text or "" for x in p.iter(A + "t")).strip()))


def _pptx_table(table: ET.Element) -> str:
    rows, spans = [], {}
    for r, tr in enumerate(table.findall(A + "tr")):
        row = []
        for c, tc in enumerate(tr.findall(A + "tc")):
            h, w = int(tc.get("rowSpan", "1")), int(tc.get("gridSpan", "1"))
            if (h, w) != (1, 1):
                spans[r, c] = (h, w)
            row.append("" if tc.get("hMerge") or tc.get("vMerge") else _paragraphs(tc))
        rows.append(row)
    return grid_to_text(rows, spans, always_html=True)


def _ordinal(name: str) -> int:
    return int(re.findall(r"\d+", name)[-1])


@parser("pptx")
def parse_pptx(content: bytes, options: dict) -> Parsed:
    """Shapes of each slide by place on it; groups are walked; notes follow their slide."""
    z = _open(content)
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_ordinal)
    if not slides:
        raise ProcessingError("no slides")
    items: list[Item] = []
    for number, name in enumerate(slides, 1):
        found: list[tuple[int, int, int, Item]] = []
        for shape in safe_xml(z.read(name)).iter():
            if shape.tag not in (P + "sp", P + "graphicFrame"):
                continue
            off = shape.find(f".//{A}off")
            if off is None:
                off = shape.find(f"{P}xfrm/{A}off")
            top, left = (int(off.get("y", 0)), int(off.get("x", 0))) if off is not None else (0, 0)
            table = shape.find(f".//{A}tbl")
            if table is not None:
                found.append((top, left, len(found), Item("table", _pptx_table(table), number)))
                continue
            text, ph = _paragraphs(shape), shape.find(f".//{P}ph")
            if text:
                kind = ph.get("type", "body") if ph is not None else ""
                of = {"title": "text:title", "ctrTitle": "text:title", "subTitle": "text:section", "dt": "text:caption", "ftr": "text:caption", "hdr": "text:caption", "sldNum": "text:caption"}
                found.append((top, left, len(found), Item(of.get(kind) or classify(text, ""), text, number)))
        items += [f[3] for f in sorted(found, key=lambda f: f[:3])]
        notes = _part(z, f"ppt/notesSlides/notesSlide{_ordinal(name)}.xml")
        if notes is not None:
            text = "\n".join(t for s in notes.iter(P + "sp") if (ph := s.find(f".//{P}ph")) is not None and ph.get("type") == "body" and (t := _paragraphs(s)))
            if text:
                items.append(Item("text:normal", f"[Slide {number} Notes]\n{text}", number))
    return Parsed(office_markdown(items, "slide"), _meta(slide_count=len(slides), **_core(z)), items)


# Sheets


def _cell(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
    c = 0
    for ch in letters:
        c = c * 26 + ord(ch) - 64
    return int(digits) - 1, c - 1


def _sheet_table(sheet: ET.Element, shared: list[str]) -> str:
    values: dict[tuple[int, int], str] = {}
    for c in sheet.iter(S + "c"):
        v, inline = c.find(S + "v"), c.find(S + "is")
        text = "".join(t.text or "" for t in inline.iter(S + "t")) if inline is not None else (v.text or "") if v is not None else ""
        if c.get("t") == "s" and text:
            text = shared[int(text)]
        elif c.get("t") == "b":
            text = "True" if text == "1" else "False"
        if text and c.get("r"):
            values[_cell(c.get("r"))] = text
    merges = [(_cell(a), _cell(b)) for m in sheet.iter(S + "mergeCell") for a, _, b in [m.get("ref").partition(":")] if b and _cell(b)[1] < 16383]
    if not values:
        return ""
    last_r = max([r for r, _ in values] + [b[0] for _, b in merges])
    last_c = max([c for _, c in values] + [b[1] for _, b in merges])
    kept = [c for c in range(last_c + 1) if any((r, c) in values for r in range(last_r + 1))]
    at = {c: i for i, c in enumerate(kept)}
    rows = [r for r in range(last_r + 1) if merges or r == 0 or any((r, c) in values for c in kept)]
    grid = [[values.get((r, c), "") for c in kept] for r in rows]
    spans = {}
    for (r0, c0), (r1, c1) in merges:
        wide = sum(c0 <= c <= c1 for c in kept)
        if c0 in at and (r1 - r0 + 1, wide) != (1, 1):
            spans[r0, at[c0]] = (r1 - r0 + 1, wide)
    return grid_to_text(grid, spans)


@parser("xlsx")
def parse_xlsx(content: bytes, options: dict) -> Parsed:
    """A title and a table for each sheet in the workbook's order; columns without any value go."""
    z = _open(content)
    book = _part(z, "xl/workbook.xml")
    if book is None:
        raise ProcessingError("no xl/workbook.xml")
    strings = _part(z, "xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in (strings if strings is not None else [])]
    rels = _part(z, "xl/_rels/workbook.xml.rels")
    targets = {r.get("Id"): r.get("Target") for r in (rels if rels is not None else [])}
    items, names = [], []
    for n, s in enumerate(book.iter(S + "sheet"), 1):
        names.append(s.get("name"))
        target = (targets.get(s.get(R + "id")) or f"worksheets/sheet{n}.xml").lstrip("/")
        sheet = _part(z, target if target.startswith("xl/") else f"xl/{target}")
        table = _sheet_table(sheet, shared) if sheet is not None else ""
        items.append(Item("text:title", f"Sheet: {s.get('name')}", n))
        if table:
            items.append(Item("table", table, n))
    return Parsed(office_markdown(items, "sheet"), _meta(sheet_names=", ".join(names), **_core(z)), items)


# Adapters


def _adapter(what: str):
    def refuse(content: bytes, options: dict) -> Parsed:
        convert = options.get(f"{what}_adapter")
        if convert is None:
            raise UnsupportedFormatError(f"{what} files need an adapter: pass options['{what}_adapter'], a function of bytes to Parsed")
        return convert(content)

    return refuse


parser("pdf")(_adapter("pdf"))
parser(*(f for f, family, _ in formats.FORMATS if family == "legacy"))(_adapter("legacy"))


@parser("png", "jpg", "jpeg", "gif", "bmp", "webp", "tiff", "tif", "heic", "heif", "avif")
def parse_image(content: bytes, options: dict) -> Parsed:
    """Format and size from the header bytes; text only through an adapter."""
    kind, size = "unknown", None
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        kind, size = "PNG", (int.from_bytes(content[16:20], "big"), int.from_bytes(content[20:24], "big"))
    elif content[:6] in (b"GIF87a", b"GIF89a"):
        kind, size = "GIF", (int.from_bytes(content[6:8], "little"), int.from_bytes(content[8:10], "little"))
    elif content[:2] == b"BM":
        kind, size = "BMP", (int.from_bytes(content[18:22], "little"), abs(int.from_bytes(content[22:26], "little", signed=True)))
    elif content[:3] == b"\xff\xd8\xff":
        kind, at = "JPEG", 2
        while at + 9 < len(content) and content[at] == 0xFF:
            if 0xC0 <= content[at + 1] <= 0xCF and content[at + 1] not in (0xC4, 0xC8, 0xCC):
                size = (int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big"))
                break
            at += 2 + int.from_bytes(content[at + 2 : at + 4], "big")
    lines = [f"- **Format**: {kind}", *([f"- **Dimensions**: {size[0]} x {size[1]} pixels"] if size else []), f"- **Size**: {len(content):,} bytes"]
    read = options.get("image_adapter")
    text = read(content) if read else ""
    return Parsed("\n".join(lines) + (f"\n\n## Text\n\n{text}" if text else ""), _meta(format=kind, width=size and size[0], height=size and size[1]), [Item("text:image_description", text)] if text else [])
