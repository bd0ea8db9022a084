"""Lines and content items of texts: splitting, classification, and rendering of single items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How captions begin; a number and a mark may follow.
CAPTION = r"(?i)^(Chart|Fig|Graph|Image|Plate|Scheme|Table|Tbl)"
SOURCE_NOTE = r"(?i)^(Notes?|Source)[.:)]"
OFFICE_LIST = r"^[*\d•-]+[).]\s+"


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, seq, line``: every line of every text in order, blank ones included. A null text is one empty line."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("seq", "line"))


def is_caps(line: Column) -> Column:
    return (F.trim(line) != "") & (F.upper(line) == line) & (F.lower(line) != line) & (F.length(line) < 100)


def classify(text: Column, style: Column | None = None) -> Column:
    """Item type by style name, then by how the text begins. "Subtitle" is a title, as is any heading style with a 1 in it."""
    by_text = F.when(text.rlike(OFFICE_LIST), "text:list").when(text.rlike(CAPTION) | text.rlike(SOURCE_NOTE), "text:caption").otherwise("text:normal")
    if style is None:
        return F.when(text == "", "text:normal").otherwise(by_text)
    low = F.lower(style)
    by_style = (
        F.when(low.contains("title"), "text:title").when(low.contains("heading") & style.contains("1"), "text:title").when(low.contains("heading"), "text:section")
        .when(low.contains("caption"), "text:caption").when(low.contains("list") | low.contains("bullet"), "text:list")
    )
    return F.when(F.coalesce(text, F.lit("")) == "", "text:normal").otherwise(F.coalesce(by_style, by_text))


def text_items(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, seq, type, content, page, position_y``: the non-blank lines of a text as items.

    The first is the title, lines in capitals are sections, the rest goes by how it begins. The first line is
    found inside the row's own array, so this stays one narrow stage.
    """
    split = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda l, i: F.struct(i.alias("seq"), l.alias("line")))
    kept = F.filter(split, lambda x: F.trim(x["line"]) != "")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(kept).alias("at", "x")).select("doc_id", "at", F.col("x.seq").alias("seq"), F.col("x.line").alias("content"))
    kind = F.when(F.col("at") == 0, "text:title").when(is_caps(F.col("content")), "text:section").otherwise(classify(F.col("content")))
    return rows.select("doc_id", "seq", kind.alias("type"), "content", (F.floor(F.col("seq") / 5) + 1).cast("int").alias("page"), ((F.col("seq") % 5) * 200).cast("double").alias("position_y"))


def level(type_: Column) -> Column:
    return F.when(type_ == "text:title", 1).when(type_ == "text:section", 2).otherwise(0)


def render_item(type_: Column, content: Column) -> Column:
    """Markdown of one item; running heads and feet give nothing."""
    return (
        F.when(type_ == "text:title", F.concat(F.lit("# "), content)).when(type_ == "text:section", F.concat(F.lit("## "), content)).when(type_ == "text:caption", F.concat(F.lit("*"), content, F.lit("*")))
        .when(type_ == "image", F.concat(F.lit("![Image](data:image/png;base64,"), content, F.lit(")")))
        .when(type_ == "text:image_description", F.trim(F.replace(F.replace(content, F.lit("<image_ocr_result>"), F.lit("")), F.lit("</image_ocr_result>"), F.lit(""))))
        .when(type_.isin("text:header", "text:footer"), "").otherwise(content)
    )


def text_to_markdown(text: Column) -> Column:
    """Lines in capitals become headings."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda l: F.when(is_caps(l), F.concat(F.lit("## "), l)).otherwise(l)), "\n")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1)).cast("long")


def plain_text(markdown: Column) -> Column:
    """Markdown with the marks of headings, bold, italics, links and code taken out, in that order, anywhere in a line."""
    out = F.regexp_replace(markdown, r"#+ ", "")
    for pattern, to in ((r"(?d)\*\*(.+?)\*\*", "$1"), (r"(?d)\*(.+?)\*", "$1"), (r"(?d)\[(.+?)]\(.+?\)", "$1"), (r"(?d)`(.+?)`", "$1")):
        out = F.regexp_replace(out, pattern, to)
    return out
