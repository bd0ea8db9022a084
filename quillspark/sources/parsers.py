"""Parsers: pure functions from bytes to a parsed document, run over files in Arrow batches.

A parser never raises inside a task: what goes wrong becomes an ``error`` of class and message.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class UnsupportedFormatError(Exception):
    """No parser for this format."""


class ProcessingError(Exception):
    """A file that its parser can't read."""


@dataclass
class Item:
    type: str
    content: str
    page: int | None = None


@dataclass
class Parsed:
    """Markdown, metadata (as strings), and the ordered items of a document."""

    content: str
    metadata: dict[str, str] = field(default_factory=dict)
    items: list[Item] = field(default_factory=list)


Parser = Callable[[bytes, dict[str, Any]], Parsed]
REGISTRY: dict[str, Parser] = {}


def parser(*formats: str) -> Callable[[Parser], Parser]:
    """Register a parser for formats; later registrations replace earlier ones."""

    def add(f: Parser) -> Parser:
        for name in formats:
            REGISTRY[name] = f
        return f

    return add


def _meta(**values: Any) -> dict[str, str]:
    return {k: str(v) for k, v in values.items() if v is not None}


def _decode(content: bytes, options: dict) -> str:
    return content.decode(options.get("encoding") or "utf-8")


# Text and data


def caps_headings(text: str) -> str:
    return "\n".join(f"## {s}" if s.strip() and s.isupper() and len(s) < 100 else s for s in text.split("\n"))


@parser("txt")
def parse_text(content: bytes, options: dict) -> Parsed:
    text = _decode(content, options)
    return Parsed(caps_headings(text), _meta(word_count=len(text.split()), line_count=len(text.split("\n"))), [Item("text:normal", text)])


def padded_table(rows: list[list[str]]) -> str:
    """A pipe table whose columns are as wide as their widest cell; ragged rows are filled up."""
    if not rows:
        return ""
    width = max(map(len, rows))
    full = [r + [""] * (width - len(r)) for r in rows]
    wide = [max(len(r[c]) for r in full) for c in range(width)]
    line = lambda r: "| " + " | ".join(v.ljust(w) for v, w in zip(r, wide, strict=True)) + " |"
    rule = "".join("|" + "-" * (2 + w) for w in wide) + "|"
    return "\n".join([line(full[0]), rule, *map(line, full[1:])])


@parser("csv")
def parse_csv(content: bytes, options: dict) -> Parsed:
    """The delimiter given, or sniffed from the first 1,024 characters, or a comma."""
    text = _decode(content, options)
    delimiter = options.get("delimiter")
    if not delimiter:
        try:
            delimiter = csv.Sniffer().sniff(text[:1024]).delimiter
        except csv.Error:
            delimiter = ","
    rows = list(csv.reader(io.StringIO(text), delimiter=delimiter))
    table = padded_table(rows)
    return Parsed(table, _meta(row_count=len(rows), column_count=len(rows[0]) if rows else 0, delimiter=delimiter), [Item("table", table)])


@parser("tsv")
def parse_tsv(content: bytes, options: dict) -> Parsed:
    return parse_csv(content, options | {"delimiter": "\t"})


def json_to_markdown(value: Any, depth: int = 0) -> str:
    """Nested values as bold keys and numbered items, two spaces deeper each level."""
    pad = "  " * depth
    if isinstance(value, dict):
        return "\n".join(f"{pad}**{k}**:\n{json_to_markdown(v, depth + 1)}" if isinstance(v, dict | list) else f"{pad}**{k}**: {v}" for k, v in value.items())
    if isinstance(value, list):
        return "\n".join(f"{pad}- Item {i}:\n{json_to_markdown(v, depth + 1)}" if isinstance(v, dict | list) else f"{pad}- {v}" for i, v in enumerate(value, 1))
    return f"```json\n{json.dumps(value)}\n```"


@parser("json")
def parse_json(content: bytes, options: dict) -> Parsed:
    value = json.loads(_decode(content, options))
    return Parsed(json_to_markdown(value), _meta(data_type=type(value).__name__, item_count=len(value) if isinstance(value, dict | list) else 1))


@parser("jsonl")
def parse_jsonl(content: bytes, options: dict) -> Parsed:
    good = []
    for line in _decode(content, options).split("\n"):
        if line.strip():
            try:
                good.append(json.loads(line))
            except ValueError:
                continue
    body = "\n\n".join(f"## Record {i}\n{json_to_markdown(v)}" for i, v in enumerate(good, 1))
    return Parsed(f"# JSONL Data ({len(good)} records)\n\n{body}", _meta(record_count=len(good)))


# HTML


class _Markdown(HTMLParser):
    """Events to Markdown; unknown tags go, their text stays. With ``clean``, title, script and style text goes too."""

    AROUND = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}

    def __init__(self, clean: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.lists: list[list] = []
        self.links: list[str] = []
        self.verbatim = self.skipped = 0
        self.clean = clean

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if self.clean and tag in ("title", "script", "style"):
            self.skipped += 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "p":
            self.out.append("\n\n")
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag in self.AROUND and not self.verbatim:
            self.out.append(self.AROUND[tag])
        elif tag == "pre":
            self.verbatim += 1
            self.out.append("\n\n```\n")
        elif tag == "blockquote":
            self.out.append("\n\n> ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n")
        elif tag == "li":
            if self.lists:
                self.lists[-1][1] += 1
            mark = f"{self.lists[-1][1]}. " if self.lists and self.lists[-1][0] == "ol" else "- "
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + mark)
        elif tag == "a":
            self.links.append(a.get("href") or "")
            self.out.append("[")
        elif tag == "img":
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")

    def handle_endtag(self, tag: str) -> None:
        if self.clean and tag in ("title", "script", "style"):
            self.skipped = max(0, self.skipped - 1)
        elif tag in self.AROUND and not self.verbatim:
            self.out.append(self.AROUND[tag])
        elif tag == "pre":
            self.verbatim = max(0, self.verbatim - 1)
            self.out.append("\n```\n\n")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.out.append("\n")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag == "p" or len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.out.append(data if self.verbatim else data.strip())


def markdown_of_html(html: str, clean: bool = False) -> str:
    import re

    p = _Markdown(clean)
    p.feed(html)
    p.close()
    return re.sub(r"\n{3,}", "\n\n", "".join(p.out)).strip()


@parser("html")
def parse_html(content: bytes, options: dict) -> Parsed:
    import re

    html = _decode(content, options)
    title = re.search(r"<title[^>]*>(.*?)</title>", html, re.I | re.S)
    visible = re.sub(r"(?is)<(script|style)\b.*?</\1>|</?[a-z!][^>]*>", " ", html)
    return Parsed(markdown_of_html(html, options.get("clean", False)), _meta(title=title and title.group(1).strip(), word_count=len(visible.split()), link_count=len(re.findall(r"(?i)<a\s[^>]*href", html)), image_count=len(re.findall(r"(?i)<img\b", html))))


# Running them

PARSED = T.StructType(
    [
        T.StructField("path", T.StringType()), T.StructField("format", T.StringType()), T.StructField("content", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("items", T.ArrayType(T.StructType([T.StructField("seq", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("content", T.StringType()), T.StructField("page", T.IntegerType())]))),
        T.StructField("error", T.StructType([T.StructField("class", T.StringType()), T.StructField("message", T.StringType())])),
    ]
)


def parse_bytes(content: bytes, fmt: str | None, options: dict[str, Any] | None = None) -> Parsed:
    if fmt not in REGISTRY:
        raise UnsupportedFormatError(f"no parser for {fmt!r}")
    try:
        return REGISTRY[fmt](content, options or {})
    except UnsupportedFormatError:
        raise
    except Exception as e:
        raise ProcessingError(f"Processing failed: {e}") from e


def parse_files(files: DataFrame, options: dict[str, Any] | None = None) -> DataFrame:
    """Routed files ``(path, format, content)`` to parsed documents. Narrow; the raw bytes end here."""
    settings = options or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import mail, markup, office  # noqa: F401 - they register their parsers

        for b in batches:
            out = []
            for path, fmt, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                row: dict[str, Any] = {"path": path, "format": fmt, "content": None, "metadata": {}, "items": [], "error": None}
                try:
                    p = parse_bytes(content or b"", fmt, settings)
                    row |= {"content": p.content, "metadata": p.metadata, "items": [{"seq": i, "type": x.type, "content": x.content, "page": x.page} for i, x in enumerate(p.items)]}
                except Exception as e:  # noqa: BLE001 - a bad file is a row with an error, never a failed task
                    row["error"] = {"class": type(e).__name__, "message": str(e)}
                row["metadata"] = list(row["metadata"].items())
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    return files.select("path", "format", "content").mapInArrow(run, PARSED)


ARROW = pa.schema(
    [
        ("path", pa.string()), ("format", pa.string()), ("content", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())),
        ("items", pa.list_(pa.struct([("seq", pa.int32()), ("type", pa.string()), ("content", pa.string()), ("page", pa.int32())]))),
        ("error", pa.struct([("class", pa.string()), ("message", pa.string())])),
    ]
)


def html_to_markdown(pages: DataFrame, id_col: str, html_col: str, clean: bool = False) -> DataFrame:
    """``id, markdown`` of HTML held in a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([markdown_of_html(h or "", clean) for h in b.column(1).to_pylist()], pa.string())], names=[id_col, "markdown"])

    return pages.select(id_col, html_col).mapInArrow(run, f"{id_col} long, markdown string")
