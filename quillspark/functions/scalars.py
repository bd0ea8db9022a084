"""Scalar functions as built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often and in whichever inner function it stands: merged projections can't copy it there."""
    return F.transform(F.array(value), use)[0]


def one_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^\s|\s$", "")


def markdown_counts(text: Column) -> dict[str, Column]:
    """Headings (lines that begin with # after space, code included), links (images with a name included) and images."""
    return {
        "headers": F.size(F.filter(F.split(text, "\n", -1), lambda l: F.ltrim(l).startswith("#"))).cast("long"),
        "links": F.regexp_count(text, F.lit(r"\[[^\]]+]\([^)]+\)")).cast("long"),
        "images": F.regexp_count(text, F.lit(r"!\[[^\]]*]\([^)]+\)")).cast("long"),
    }


def html_meta(html: Column) -> dict[str, Column]:
    return {
        "title": F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1),
        "links": F.regexp_count(html, F.lit(r"(?i)<a\s[^>]*href")).cast("long"),
        "images": F.regexp_count(html, F.lit(r"(?i)<img\b")).cast("long"),
    }


def footnote_refs(text: Column) -> Column:
    """Ids that a text refers to, in order; definitions don't count."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\[\^(\w+)](?!:)"), 1)


def strip_page_number(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\d+$", ""), r"^[pP]age\s+\d+$", "")


def flat_json_to_markdown(json: Column) -> Column:
    """``**key**: value`` lines of a one-level object of JSON text, in its order."""
    keys = F.json_object_keys(json)
    values = F.from_json(json, "map<string,string>")
    return F.array_join(F.transform(keys, lambda k: F.concat(F.lit("**"), k, F.lit("**: "), F.coalesce(F.element_at(values, k), F.lit("None")))), "\n")


def jsonl_to_markdown(lines: DataFrame) -> DataFrame:
    """From ``file, seq, line``: ``file, record_count, markdown``; blank and broken lines are skipped."""
    good = lines.filter((F.trim("line") != "") & F.try_parse_json("line").isNotNull())
    n = F.row_number().over(Window.partitionBy("file").orderBy("seq"))
    part = good.withColumn("n", n).withColumn("md", F.concat(F.lit("## Record "), F.col("n").cast("string"), F.lit("\n"), F.col("line")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "md"))), lambda x: x["md"]), "\n\n")
    return part.groupBy("file").agg(F.count("*").alias("record_count"), body.alias("body")).select("file", "record_count", F.concat(F.lit("# JSONL Data ("), F.col("record_count").cast("string"), F.lit(" records)\n\n"), F.col("body")).alias("markdown"))


def email_markdown(subject: Column, headers: list[tuple[str, Column]], body: Column) -> Column:
    """Subject as heading, the headers that are there, a rule, the body."""
    lines = F.array_compact(F.array(*[F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"**{name}:** "), v, F.lit("  "))) for name, v in headers]))
    return F.concat(F.lit("# "), F.coalesce(subject, F.lit("(no subject)")), F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("\n\n---\n\n"), body)


def attach_footnotes(chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """Definitions to the first of ``chunks(doc_id, k, content)`` that refers to them, or else to the last.

    The relational form: references are exploded, the first of each id is kept, and definitions travel to
    their chunk; texts move only in the last join.
    """
    refs = chunks.select("doc_id", "k", F.explode(footnote_refs(F.col("content"))).alias("id")).groupBy("doc_id", "id").agg(F.min("k").alias("k"))
    last = chunks.groupBy("doc_id").agg(F.max("k").alias("last"))
    placed = notes.join(refs, ["doc_id", "id"], "left").join(last, "doc_id").withColumn("orphan", F.col("k").isNull()).withColumn("k", F.coalesce("k", "last"))
    listed = lambda own: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("orphan") != own, F.struct("id", "def")))), lambda x: x["def"]), "\n")
    defs = placed.groupBy("doc_id", "k").agg(listed(True).alias("mine"), listed(False).alias("rest"))
    end = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("\n\n"), c)).otherwise("")
    return chunks.join(defs, ["doc_id", "k"], "left").select("doc_id", "k", F.concat("content", end(F.col("mine")), end(F.col("rest"))).alias("content"))


def glob_to_regex(pattern: str) -> str:
    """A shell pattern of ``*`` and ``?`` as an anchored regular expression."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def column_name(index: Column) -> Column:
    """A spreadsheet column's letters: A to Z, AA to ZZ, AAA and on to the last that sheets have."""
    letter = lambda i: F.char(F.lit(65) + F.pmod(i, F.lit(26)))
    two, three = F.floor((index - 26) / 26), F.floor((index - 702) / 676)
    return F.when(index < 26, letter(index)).when(index < 702, F.concat(letter(two), letter(index))).otherwise(F.concat(letter(three), letter(F.floor((index - 702) / 26)), letter(index - 702)))


def flatten_ocr(text: Column) -> Column:
    """OCR text for a spreadsheet cell: headings in brackets, bullets as dots, sections joined by bars, HTML escaped."""
    t = F.regexp_replace(text, r"\*\*(.*?)\*\*", "$1")
    t = F.regexp_replace(t, r"(?m)^#+\s*(.+)$", "[$1]:")
    t = F.regexp_replace(t, r"(?m)^[-*]\s+", "• ")
    t = F.regexp_replace(F.trim(t), r"\n{2,}", " || ")
    t = F.regexp_replace(t, r"\n", " ")
    return F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
