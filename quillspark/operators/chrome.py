"""Running heads and feet: text that repeats in the same zone of at least half of a document's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_NUMBER = "__page_number__"


def zone(y: Column, height: Column) -> Column:
    return F.when(y / height < 0.12, "header").when(y / height > 0.88, "footer")


def chrome_key(content: Column) -> Column:
    """The text without surrounding space; a bare page number has one key of its own."""
    t = F.regexp_replace(F.trim(F.regexp_replace(F.trim(content), r"^\d+$", "")), r"^[pP]age\s+\d+$", "")
    return F.when(F.trim(t) == "", PAGE_NUMBER).otherwise(F.trim(t))


def _keyed(items: DataFrame, height: float) -> DataFrame:
    ok = F.col("type").startswith("text:") & F.col("page").isNotNull() & F.col("position_y").isNotNull()
    return items.withColumn("zone", F.when(ok, zone(F.col("position_y"), F.lit(height)))).withColumn("key", chrome_key(F.col("content")))


def repeated_chrome(items: DataFrame, height: float = 800.0) -> DataFrame:
    """``doc_id, key, zone, n_pages`` that repeat, in documents of more than three pages."""
    keyed = _keyed(items, height)
    pages = items.groupBy("doc_id").agg(F.count_distinct("page").alias("total")).filter("total > 3")
    counts = keyed.filter(F.col("zone").isNotNull()).groupBy("doc_id", "key", "zone").agg(F.count_distinct("page").alias("n_pages"))
    return counts.join(pages, "doc_id").filter(F.col("n_pages") >= F.col("total") * 0.5).select("doc_id", "key", "zone", "n_pages")


def retype_chrome(items: DataFrame, height: float = 800.0) -> DataFrame:
    """The items, those that repeat typed ``text:header`` or ``text:footer``; none is removed."""
    keyed = _keyed(items, height).withColumn("__was", F.col("type"))
    hit = repeated_chrome(items, height).select("doc_id", "key", "zone", F.lit(True).alias("__hit"))
    free = F.col("__hit").isNotNull() & ~F.col("__was").isin("text:header", "text:footer")
    return keyed.join(hit, ["doc_id", "key", "zone"], "left").withColumn("type", F.when(free, F.concat(F.lit("text:"), F.col("zone"))).otherwise(F.col("__was"))).select(items.columns)
