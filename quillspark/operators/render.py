"""Whole documents from ordered items, with page markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .items import render_item


def page_markers(items: DataFrame, first: bool, label: str = "page") -> DataFrame:
    """Add ``marker``: a comment where the page changes among the items that show, and on the first if wanted."""
    before = F.lag("page").over(Window.partitionBy("doc_id").orderBy("seq"))
    turn = F.col("page").isNotNull() & (F.when(before.isNull(), F.lit(first)).otherwise(before != F.col("page")))
    return items.withColumn("marker", F.when(turn, F.concat(F.lit(f"<!-- {label} "), F.col("page"), F.lit(" -->"))))


def _document(parts: Column) -> Column:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", parts.alias("v")))), lambda x: x["v"])
    return F.array_join(ordered, "\n\n")


def _shown(items: DataFrame) -> DataFrame:
    return items.filter(~F.col("type").isin("text:header", "text:footer") & (F.trim("content") != ""))


def render_office(items: DataFrame, label: str = "page") -> DataFrame:
    """``doc_id, markdown``, a marker before every page."""
    marked = page_markers(_shown(items), True, label)
    return marked.groupBy("doc_id").agg(_document(F.concat_ws("\n\n", "marker", render_item(F.col("type"), F.col("content")))).alias("markdown"))


FOOTNOTE = r"^(\d+)[\s.)]+(.+)"


def render_pdf(items: DataFrame) -> DataFrame:
    """``doc_id, markdown``, a marker where a new page begins but the first; footnotes as definitions; no wide gaps."""
    marked = page_markers(_shown(items), False)
    text = F.when((F.col("type") == "text:footnote") & F.trim("content").rlike(FOOTNOTE), F.regexp_replace(F.trim("content"), FOOTNOTE, "[^$1]: $2")).otherwise(render_item(F.col("type"), F.col("content")))
    whole = F.trim(F.regexp_replace(_document(F.concat_ws("\n\n", "marker", text)), "\n{3,}", "\n\n"))
    return marked.groupBy("doc_id").agg(whole.alias("markdown"))


def convert(markdown: Column, to: str, plain) -> Column:
    """The output format is known when the plan is made: markdown, text or json."""
    if to not in ("markdown", "text", "json"):
        raise ValueError(f"unknown output format {to!r}")
    return {"markdown": lambda: markdown, "text": lambda: plain(markdown), "json": lambda: F.to_json(F.struct(markdown.alias("content")))}[to]()


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("… (truncated)"))).otherwise(text)
