"""Structured OCR pages: their Markdown, and the tables in HTML that models write, made safe, rectangular, and read as grids."""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import once
from .enrich import coverage

TABLE_TAGS = frozenset("table caption colgroup col thead tbody tfoot tr td th".split())
UNSAFE_TAGS = frozenset("script style iframe object embed link meta form input button svg math template noscript".split())
VOID_TAGS = frozenset("col br img hr input link meta embed".split())
KEPT_ATTRS = ("colspan", "rowspan", "scope")
#: A page's own Markdown stands for its text if it has this share of the text's tokens.
SURE = 0.85


class _Safe(HTMLParser):
    """Writes a table again from what is allowed."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.unsafe: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in UNSAFE_TAGS:
            if tag not in VOID_TAGS:
                self.unsafe.append(tag)
        elif not self.unsafe and tag in TABLE_TAGS:
            if tag in ("td", "th", "tr"):  # an open cell or row ends where the next begins
                self._close_to({"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}[tag])
            kept = [(k, v.strip()) for k, v in attrs if k in KEPT_ATTRS and v is not None and (k == "scope" or v.strip().isdecimal())]
            self.out.append(f"<{tag}{''.join(f' {k}={chr(34)}{escape(v)}{chr(34)}' for k, v in kept)}{'/' if tag == 'col' else ''}>")
            if tag != "col":
                self.open.append(tag)

    def _close_to(self, tags: tuple[str, ...]) -> None:
        inner = len(self.open) - self.open[::-1].index("table") if "table" in self.open else 0
        for at in range(len(self.open) - 1, inner - 1, -1):
            if self.open[at] in tags:
                self.out += [f"</{t}>" for t in self.open[: at - 1 if at else None : -1]]
                del self.open[at:]
                return

    def handle_endtag(self, tag: str) -> None:
        if self.unsafe:
            if tag in self.unsafe:
                while self.unsafe.pop() != tag:
                    pass
        elif tag in self.open:
            while (t := self.open.pop()) != tag:
                self.out.append(f"</{t}>")
            self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if not self.unsafe:
            self.out.append(escape(data, quote=False))


def safe_table(html: str | None) -> str:
    """Only table elements with whole-number spans and scope; text stays, scripts and the like go with theirs; a code fence around goes."""
    text = (html or "").strip()
    if text.startswith("```"):
        text = text.partition("\n")[2].rstrip()
        text = text.removesuffix("```").strip()
    parser = _Safe()
    parser.feed(text)
    parser.close()
    return ("".join(parser.out) + "".join(f"</{t}>" for t in reversed(parser.open))).strip()


class _Cells(HTMLParser):
    """Rows of cells: text, colspan, rowspan; and where each row ends in the source."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list]] = []
        self.inside = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        span = lambda k: int(v) if (v := (dict(attrs).get(k) or "1").strip()).isdecimal() and int(v) > 0 else 1
        if tag == "tr":
            self.rows.append([])
            self.inside = False
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append(["", span("colspan"), span("rowspan")])
            self.inside = True

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr"):
            self.inside = False

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.rows[-1][-1][0] += data


def _laid_out(html: str) -> tuple[dict[tuple[int, int], str], int]:
    """What each place of a table's grid holds, spans filled; and its number of rows as written."""
    parser = _Cells()
    parser.feed(html)
    parser.close()
    grid: dict[tuple[int, int], str] = {}
    for r, row in enumerate(parser.rows):
        c = 0
        for text, wide, tall in row:
            while (r, c) in grid:
                c += 1
            one = " ".join(text.split())
            grid.update({(r + i, c + j): one for i in range(tall) for j in range(wide)})
            c += wide
    return grid, len(parser.rows)


def rectangular_table(html: str | None) -> str | None:
    """Short rows get empty cells at their end, up to the widest row's width with spans counted; others stay as they are."""
    if not html or not html.strip():
        return html
    grid, n = _laid_out(html)
    width = max((c for _, c in grid), default=-1) + 1
    lacking = iter([width - sum((r, c) in grid for c in range(width)) for r in range(n)])
    return re.sub(r"</tr\s*>", lambda m: "<td></td>" * next(lacking, 0) + m[0], html, flags=re.I) if width else html


def html_grid(html: str) -> list[list[str]]:
    grid, _ = _laid_out(html)
    rows, columns = (max((k[i] for k in grid), default=-1) + 1 for i in (0, 1))
    return [[grid.get((r, c), "") for c in range(columns)] for r in range(rows)]


def pipe_grid(block: str) -> list[list[str]]:
    """Cells of the rows of a pipe table; rules between head and body are left out."""
    rows = (line.strip() for line in block.splitlines())
    return [[" ".join(c.split()) for c in row.strip("|").split("|")] for row in rows if row.startswith("|") and not re.fullmatch(r"\|[-\s:|]+\|?", row)]


def grids(markdown: str | None) -> list[list[list[str]]]:
    """All tables of a Markdown text: those in HTML first, then pipe tables, each with its spans filled."""
    text = markdown or ""
    found = [html_grid(m) for m in re.findall(r"(?s)<table.*?</table>", text)]
    found += [pipe_grid(m) for m in re.findall(r"(?m)(?:^\|.*\|[^\S\n]*$\n?)+", text)]
    return [g for g in found if g]


@F.pandas_udf(T.StringType())
def clean_table(html: pd.Series) -> pd.Series:
    """``safe_table``, then ``rectangular_table``; null gives an empty one."""
    return html.map(lambda h: rectangular_table(safe_table(h)))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.StringType()))))
def table_grids(markdown: pd.Series) -> pd.Series:
    return markdown.map(grids)


# Rendering


def _some(xs: Column) -> Column:
    return F.coalesce(xs, F.array())


def _bare(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit("")))


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _lines(*parts: Column, sep: str = "\n") -> Column:
    """The parts that aren't empty (null), each a text or an array of texts."""
    return F.concat_ws(sep, *parts)


def _full(x: Column) -> Column:
    return F.when(x != "", x)


def render_table(t: Column) -> Column:
    """A table's HTML, else its Markdown, else a pipe table of its caption, headers and rows; rows have as many cells as there are headers."""
    headers, rows = _some(t["headers"]), _some(t["rows"])
    width = F.when(F.size(headers) > 0, F.size(headers)).otherwise(F.size(F.coalesce(F.get(rows, F.lit(0)), F.array().cast("array<string>"))))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    fit = lambda r: F.slice(F.concat(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), F.array_repeat(F.lit(""), width)), F.lit(1), width)
    drawn = F.when(width > 0, _lines(line(fit(headers)), line(F.array_repeat(F.lit("---"), width)), F.transform(rows, lambda r: line(fit(r)))))
    plain = F.when((F.size(headers) > 0) | (F.size(rows) > 0), _lines(_full(_bare(t["caption"])), drawn))
    return F.when(_bare(t["html"]) != "", _bare(t["html"])).when(_bare(t["markdown"]) != "", _bare(t["markdown"])).otherwise(plain)


def render_metrics(metrics: Column) -> Column:
    real = F.filter(_some(metrics), lambda m: ~F.coalesce(m["illustrative"], F.lit(False)))

    def one(m: Column) -> Column:
        label, value, unit = _bare(m["label"]), _bare(m["value"]), _bare(m["unit"])
        return _row(F.when(label == "", "—").otherwise(label), F.when((unit != "") & ~F.contains(value, unit), F.trim(F.concat_ws(" ", value, unit))).otherwise(value))

    return F.when(F.size(real) > 0, _lines(F.lit("| Metric | Value |"), F.lit("| --- | --- |"), F.transform(real, one)))


def render_figure(f: Column) -> Column:
    """Null where a figure is illustrative or has nothing to show."""
    title, said = _bare(f["title"]), _lines(_full(_bare(f["meaning"])), _full(_bare(f["trend"])), sep=" ")
    points = F.filter(_some(f["data_points"]), lambda p: (_bare(p["label"]) != "") | (_bare(p["value"]) != ""))
    series = F.exists(points, lambda p: _bare(p["series"]) != "")
    body = F.when(F.size(points) == 0, F.array().cast("array<string>")).otherwise(
        F.when(series, F.concat(F.array(F.lit("| Series | Category | Value |"), F.lit("| --- | --- | --- |")), F.transform(points, lambda p: _row(_bare(p["series"]), _bare(p["label"]), _bare(p["value"]))))).otherwise(
            F.concat(F.array(F.lit("| Category | Value |"), F.lit("| --- | --- |")), F.transform(points, lambda p: _row(_bare(p["label"]), _bare(p["value"]))))
        )
    )
    edges = F.filter(_some(f["edges"]), lambda e: (_bare(e["from"]) != "") | (_bare(e["to"]) != ""))
    arrow = lambda e: F.when(_bare(e["label"]) != "", F.concat(F.lit(" --"), _bare(e["label"]), F.lit("-->"))).otherwise(" -->")
    drawn = F.transform(edges, lambda e: F.rtrim(F.concat(F.lit("- "), _bare(e["from"]), arrow(e), F.lit(" "), _bare(e["to"]))))
    met = F.concat(F.transform(edges, lambda e: e["from"]), F.transform(edges, lambda e: e["to"]))
    alone = F.filter(_some(f["nodes"]), lambda n: (F.coalesce(n["label"], F.lit("")) != "") & ~F.coalesce(F.array_contains(met, n["label"]), F.lit(False)))
    nodes = F.transform(alone, lambda n: F.concat(F.lit("- "), _bare(n["label"]), F.when(_bare(n["kind"]) != "", F.concat(F.lit(" ("), _bare(n["kind"]), F.lit(")"))).otherwise("")))
    head = F.when(title != "", F.concat(F.lit("**Figure: "), title, F.lit("**"))).otherwise(F.concat(F.lit("**Figure ("), F.coalesce(f["kind"], F.lit("")), F.lit(")**")))
    rest = F.concat(body, drawn, nodes)
    shown = ~F.coalesce(f["illustrative"], F.lit(False)) & ((said != "") | (F.size(rest) > 0))
    return F.when(shown, _lines(head, F.when(said != "", F.concat(F.lit("*"), said, F.lit("*"))), rest))


def render_sections(sections: Column) -> Column:
    """An outline, only where some section says more than its heading."""
    all_of = _some(sections)
    more = F.exists(all_of, lambda s: (_bare(s["summary"]) != "") | (F.size(_some(s["key_points"])) > 0))
    named = F.filter(all_of, lambda s: _bare(s["heading"]) != "")

    def one(s: Column) -> Column:
        indent = F.repeat(F.lit("  "), F.greatest(F.lit(0), F.coalesce(s["level"], F.lit(1)) - 1))
        points = F.transform(F.filter(_some(s["key_points"]), lambda k: _bare(k) != ""), lambda k: F.concat(indent, F.lit("  - "), _bare(k)))
        return _lines(F.concat(indent, F.lit("- "), _bare(s["heading"])), F.when(_bare(s["summary"]) != "", F.concat(indent, F.lit("  "), _bare(s["summary"]))), points)

    return F.when(more & (F.size(named) > 0), _lines(F.lit("**Section outline**"), F.transform(named, one)))


def page_markdown(page: str = "page") -> Column:
    """A structured page as Markdown.

    The page's own Markdown, with its tables and what tokens of the text it lacks in a comment, where it has ``SURE`` of the text's
    tokens; else title, text, tables, metrics, figures and an outline of sections. Illustrative values are left out; nulls hold nothing.
    """
    p = F.col(page)
    own, text, title = _bare(p["page_markdown"]), F.coalesce(p["text"], F.lit("")), _bare(p["page_title"])
    tables = F.array_compact(F.transform(_some(p["tables"]), render_table))
    written = F.array_join(F.transform(_some(p["tables"]), lambda t: F.when(F.coalesce(t["html"], F.lit("")) != "", t["html"]).otherwise(F.coalesce(t["markdown"], F.lit("")))), " ")
    tail = lambda missing: F.when(F.size(missing) > 0, F.concat(F.lit("<!-- raw-verbatim-tail\n"), F.array_join(missing, "\n"), F.lit("\n-->")))
    kept = lambda c: F.when(c["share"] >= SURE, _lines(own, F.filter(tables, lambda t: t != ""), tail(c["missing"]), sep="\n\n"))
    sure = once(F.when(own != "", coverage(text, F.concat(own, F.lit("\n"), written))), kept)
    head = F.when((title != "") & ~F.startswith(F.ltrim(text), title), F.concat(F.lit("# "), title))
    figures = F.array_compact(F.transform(_some(p["figures"]), render_figure))
    full = _lines(head, _full(F.trim(text)), F.filter(tables, lambda t: t != ""), render_metrics(p["metrics"]), figures, render_sections(p["sections"]), sep="\n\n")
    return F.coalesce(sure, full)
