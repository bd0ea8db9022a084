"""Page geometry: font statistics, legibility, boxes in tables, nearness to images, document strategy, headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CJK = r"[一-鿿]"
SEPARATORS = (",", "，", "、", ":", "：")


def font_stats(spans: DataFrame) -> DataFrame:
    """``doc_id, page, avg_size, max_size`` over spans (12 where there are none with a size)."""
    return spans.groupBy("doc_id", "page").agg(F.coalesce(F.avg("size"), F.lit(12.0)).alias("avg_size"), F.coalesce(F.max("size"), F.lit(12.0)).alias("max_size"))


def headline_illegibility(spans: DataFrame) -> DataFrame:
    """``doc_id, illegibility``: the worst page's share of U+FFFD in spans of at least 0.9 of its largest size."""
    largest = spans.groupBy("doc_id", "page").agg(F.max("size").alias("top"))
    heads = spans.join(largest, ["doc_id", "page"]).filter(F.col("size") >= F.col("top") * 0.9)
    bad = F.length("text") - F.length(F.replace(F.col("text"), F.lit("�"), F.lit("")))
    pages = heads.groupBy("doc_id", "page").agg(F.sum(bad).alias("bad"), F.sum(F.length("text")).alias("n"))
    return pages.groupBy("doc_id").agg(F.max(F.when(F.col("n") > 0, F.col("bad") / F.col("n")).otherwise(0.0)).alias("illegibility"))


def page_strategy(pages: DataFrame) -> DataFrame:
    """From ``doc_id, page, image_area, page_area, n_chars, illegible``: mean capped coverage, text density and the strategy."""
    per_page = pages.groupBy("doc_id", "page").agg(F.least(F.sum(F.col("image_area") / F.col("page_area")), F.lit(1.0)).alias("cover"), F.sum("n_chars").alias("chars"), F.max("illegible").alias("illegible"))
    doc = per_page.groupBy("doc_id").agg(F.avg("cover").alias("coverage"), F.avg("chars").alias("chars_per_page"), F.max("illegible").alias("illegibility"))
    image = (F.col("coverage") >= 0.55) & ((F.col("chars_per_page") < 200) | (F.col("illegibility") >= 0.3))
    return doc.withColumn("strategy", F.when(image, "image").otherwise("text"))


def _touch(a: str, b: str) -> Column:
    return (F.col(f"{a}.x0") < F.col(f"{b}.x1")) & (F.col(f"{a}.x1") > F.col(f"{b}.x0")) & (F.col(f"{a}.y0") < F.col(f"{b}.y1")) & (F.col(f"{a}.y1") > F.col(f"{b}.y0"))


def outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks that overlap no table of their page. The page is the join key, so no block meets tables elsewhere."""
    return blocks.alias("b").join(tables.alias("t"), (F.col("b.page") == F.col("t.page")) & _touch("b", "t"), "left_anti")


def near_figures(blocks: DataFrame, figures: DataFrame, reach: float = 50.0, aside: float = 100.0) -> DataFrame:
    """Blocks within ``reach`` above or below a figure of their page that they overlap sideways or nearly centre on."""
    gap = F.least(F.abs(F.col("b.y0") - F.col("f.y1")), F.abs(F.col("f.y0") - F.col("b.y1")))
    sideways = F.least("b.x1", "f.x1") - F.greatest("b.x0", "f.x0") > 0
    centred = F.abs((F.col("b.x0") + F.col("b.x1")) / 2 - (F.col("f.x0") + F.col("f.x1")) / 2) < aside
    return blocks.alias("b").join(figures.alias("f"), (F.col("b.page") == F.col("f.page")) & (gap < reach) & (sideways | centred), "left_semi")


def is_decorative(width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    return (width < page_width * 0.1) & (height < page_height * 0.1)


# Headings

BULLET = r"^[•\-\*–—▪▫●○■□]\s+"
SHORT_MARK = r"^([A-Za-z]|\d+)[).]\s+"
HAN, FORMAL = "一二三四五六七八九十百千", "壹貳參肆伍陸柒捌玖拾"
#: Outline numbers, taken as far as they go; what follows must not go on like a decimal or a version.
OUTLINE = (
    r"^\d++(?:\.\d++)++", r"^\d++(?:-\d++)++", r"^\d++[.)、．]", r"^[(（]\d++[)）]", rf"^[{HAN}]++[、．.]", rf"^[{FORMAL}]++[、．.]", rf"^[(（][{HAN}]++[)）]",
)
EXPLICIT = rf"(?i)^(?:第\s*[{HAN}\d]+\s*[章節节條篇]|(?:附表|附件|附錄)\s*[{HAN}\dA-Za-z]*|(?:Section|Chapter|Appendix)\b)"
BOUNDARY = r"(?![0-9A-Za-z])"


def normalized(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def outline_mark(text: Column) -> Column:
    """The outline number that a text begins with; empty where there is none."""
    out = F.lit("")
    for p in reversed(OUTLINE):
        m = F.regexp_extract(text, f"({p}){BOUNDARY}", 1)
        out = F.when(m != "", m).otherwise(out)
    return out


def has_list_marker(text: Column) -> Column:
    n = normalized(text)
    return (n != "") & (n.rlike(BULLET) | n.rlike(SHORT_MARK) | (outline_mark(n) != ""))


def heading_features(blocks: DataFrame) -> DataFrame:
    """Add heading features to ``text, line_count, block_size, avg_size, max_size, is_bold, is_all_caps``; without ``line_count`` each block is one line."""
    if "line_count" not in blocks.columns:
        blocks = blocks.withColumn("line_count", F.lit(1))
    n = F.col("normalized")
    explicit = F.regexp_extract(n, EXPLICIT, 0)
    mark = F.when(F.col("explicit") != "", F.col("explicit")).otherwise(F.col("outline"))
    rest = F.when(mark == "", n).otherwise(F.trim(F.substring(n, F.length(mark) + 1, F.length(n))))
    any_sep = lambda c: F.greatest(*[c.contains(s).cast("int") for s in SEPARATORS]) == 1
    out = blocks.withColumn("normalized", normalized(F.col("text"))).withColumn("explicit", explicit).withColumn("outline", outline_mark(n)).withColumn("after_mark", rest)
    structured = (F.col("outline") != "") & (F.col("after_mark") != "")
    seps = sum((F.length(n) - F.length(F.replace(n, F.lit(s), F.lit(""))) for s in SEPARATORS), F.lit(0))
    return (
        out.withColumn("length", F.length(n)).withColumn("size_ratio", F.when(F.col("avg_size") > 0, F.col("block_size") / F.col("avg_size")).otherwise(1.0))
        .withColumn("max_size_ratio", F.when(F.col("max_size") > 0, F.col("block_size") / F.col("max_size")).otherwise(1.0))
        .withColumn("is_explicit", F.col("explicit") != "").withColumn("is_structured", structured).withColumn("has_cjk", n.rlike(CJK))
        .withColumn("has_checkbox", n.rlike("^[□■☑☐]")).withColumn("has_sentence_end", n.rlike("[。！？!?；;]") | n.endswith("."))
        .withColumn("goes_on", n.rlike("[，,、；;]$")).withColumn("separators", seps).withColumn("is_form_field", n.rlike(r"…{2,}|\.{4,}|_{3,}"))
        .withColumn("is_long_clause", structured & (F.length(n) > 32) & any_sep(F.col("after_mark")))
    )


def is_heading(require_layout: bool = False) -> Column:
    """Over ``heading_features``: short and not shaped like running text.

    Named parts (a chapter, an appendix) need no layout. With ``require_layout`` all others must be laid out like
    a heading; a clause-like rest behind an outline number needs that in any case.
    """
    c = F.col
    layout = (c("size_ratio") >= 1.2) | (c("is_bold") & (c("size_ratio") >= 1.05)) | c("is_all_caps")
    body = c("has_checkbox") | c("is_form_field") | c("has_sentence_end") | c("goes_on") | (c("length") > 120)
    after, n = c("after_mark"), c("length")
    soft = (after.rlike("[,，]") & (n > 24)) | (after.rlike("[:：]") & (n > 30)) | (c("separators") >= 3) | ((c("separators") >= 2) & ~c("is_structured") & (n > 36)) | c("is_long_clause")
    numbered = ~c("is_long_clause") & (~soft | layout) & (n <= 80)
    plain = ~soft & (n <= F.when(c("has_cjk"), 24).otherwise(80))
    others = F.when(c("is_structured"), numbered).otherwise(plain)
    if require_layout:
        others = layout & others
    return (n > 0) & (c("line_count") <= 2) & ~body & F.when(c("is_explicit"), (n <= 80) & ~(soft & (n > 60))).otherwise(others)


def is_title() -> Column:
    return (F.col("max_size_ratio") >= 0.85) & ((F.col("size_ratio") >= 1.15) | F.col("is_bold") | F.col("is_all_caps"))
