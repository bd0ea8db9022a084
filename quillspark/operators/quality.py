"""Padded pipe tables of whole tables, and quality measures of conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import once
from .items import lines
from .tables import gather


def pipe_table(df: DataFrame, name: str, columns: list[str], order: str) -> DataFrame:
    """``name, markdown``: all rows as one padded pipe table (the rendering of one file, so one row)."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns}
    widths = df.agg(*[F.greatest(F.lit(len(c)), F.max(F.length(text[c]))).alias(f"w_{c}") for c in columns])
    pad = lambda value, c: F.concat(value, F.repeat(F.lit(" "), F.col(f"w_{c}") - F.length(value)))
    line = lambda values: F.concat(F.lit("| "), F.concat_ws(" | ", *values), F.lit(" |"))
    wide = df.join(F.broadcast(widths))  # a single row
    rows = wide.select(F.col(order).alias("o"), *[f"w_{c}" for c in columns], line([pad(text[c], c) for c in columns]).alias("line"))
    body = rows.groupBy(*[f"w_{c}" for c in columns]).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n").alias("body"))
    head = line([pad(F.lit(c), c) for c in columns])
    rule = F.concat(F.lit("|"), F.concat_ws("|", *[F.repeat(F.lit("-"), F.col(f"w_{c}") + 2) for c in columns]), F.lit("|"))
    return body.select(F.lit(name).alias("name"), F.concat_ws("\n", head, rule, "body").alias("markdown"))


def dup_line_ratio(all_lines: DataFrame) -> DataFrame:
    """``doc_id, dup_ratio``: share of a document's non-blank lines that repeat another."""
    shown = all_lines.select("doc_id", F.trim("line").alias("line")).filter("line <> ''")
    return shown.groupBy("doc_id").agg((1 - F.count_distinct("line") / F.count("*")).alias("dup_ratio"))


def text_preservation(pairs: DataFrame) -> DataFrame:
    """From ``doc_id, text, output``: the share of the text's non-blank lines found in the output. Narrow.

    Lines that are lines of the output are found by hash; only the others are looked for, each distinct one once. The output is made once a text.
    """
    trimmed = lambda text: F.filter(F.transform(F.split(text, "\n", -1), lambda l: F.trim(l)), lambda l: l != "")

    def kept(both: Column) -> Column:
        lost = F.filter(F.array_except(both["lines"], trimmed(both["output"])), lambda l: ~F.contains(both["output"], l))
        return once(lost, lambda l: (F.size(both["lines"]) - F.when(F.size(l) == 0, 0).otherwise(F.size(F.filter(both["lines"], lambda x: F.array_contains(l, x))))) / F.size(both["lines"]))

    both = F.struct(trimmed(F.col("text")).alias("lines"), F.coalesce(F.col("output"), F.lit("")).alias("output"))
    return pairs.filter(F.col("text").rlike(r"[^ \n]")).select("doc_id", once(both, kept).alias("preserved"))


def cell_accuracy(truth: DataFrame, got: DataFrame) -> DataFrame:
    """``table_id, accuracy``: the share of the true cells that came out the same."""
    cells = lambda df: gather(df.select("table_id", "r", "c", "text"))
    return row_accuracy(cells(truth), cells(got))


def row_accuracy(truth: DataFrame, got: DataFrame) -> DataFrame:
    """``cell_accuracy`` of rows, ``table_id, r, cells``: whole tables meet, not cells, so rows that come by table don't move.

    Where both sides have the same places, texts are compared in order; else places are met in one pass over both sides' sorted cells.
    """

    def whole(rows: DataFrame, name: str) -> DataFrame:
        cells = F.transform("cells", lambda x: F.struct(F.col("r").alias("r"), x["c"].alias("c"), x["text"].alias("text")))
        twice = F.size(F.array_distinct(F.col("cells")["c"])) < F.size("cells")
        return rows.select("table_id", cells.alias("cells"), twice.alias("twice")).groupBy("table_id").agg(F.sort_array(F.flatten(F.collect_list("cells"))).alias(name), F.max("twice").alias(f"{name}_twice"))

    t, g = F.col("t"), F.coalesce(F.col("g"), F.filter("t", lambda x: F.lit(False)))
    tagged = lambda xs, side: F.transform(xs, lambda x: F.struct(x["r"].alias("r"), x["c"].alias("c"), F.lit(side).alias("side"), x["text"].alias("text")))
    state = lambda r, c, texts, seen, hits, pairs: F.struct(r.alias("r"), c.alias("c"), texts.alias("texts"), seen.cast("long").alias("seen"), hits.cast("long").alias("hits"), pairs.cast("long").alias("pairs"))
    pairs = lambda s: s["pairs"] + F.size(s["texts"]) * F.greatest(s["seen"], F.lit(1))

    def met(s: Column, x: Column) -> Column:
        true, none = x["side"] == 0, F.array().cast("array<string>")
        fresh = state(x["r"], x["c"], F.when(true, F.array(x["text"])).otherwise(none), F.lit(0), s["hits"], pairs(s))
        more = state(s["r"], s["c"], F.when(true, F.concat(s["texts"], F.array(x["text"]))).otherwise(s["texts"]), s["seen"] + x["side"], s["hits"] + F.when(true, 0).otherwise(F.size(F.filter(s["texts"], lambda y: F.coalesce(y == x["text"], F.lit(False))))), s["pairs"])
        return F.when((s["r"] == x["r"]) & (s["c"] == x["c"]), more).otherwise(fresh)

    null = F.lit(None).cast("int")
    folded = F.aggregate(F.sort_array(F.concat(tagged(t, 0), tagged(g, 1))), state(null, null, F.array().cast("array<string>"), F.lit(0), F.lit(0), F.lit(0)), met, lambda s: s["hits"] / pairs(s))
    same = F.size(F.filter(F.zip_with(t["text"], F.col("g")["text"], lambda a, b: a == b), lambda x: x)) / F.size(t)
    aligned = (t["r"] == F.col("g")["r"]) & (t["c"] == F.col("g")["c"]) & ~F.col("t_twice")
    return whole(truth, "t").join(whole(got, "g"), "table_id", "left").select("table_id", F.when(aligned, same).otherwise(folded).alias("accuracy"))


def scorecard(preserved: DataFrame, fidelity: DataFrame, repeated: DataFrame) -> DataFrame:
    """Means against the thresholds of 0.95 for text and 0.90 for tables."""
    means = preserved.agg(F.avg("preserved").alias("text_preservation")).join(fidelity.agg(F.avg("accuracy").alias("table_fidelity"))).join(repeated.agg(F.avg("dup_ratio").alias("dup_ratio")))
    return means.withColumn("passes", (F.col("text_preservation") >= 0.95) & (F.col("table_fidelity") >= 0.90))


__all__ = ["cell_accuracy", "dup_line_ratio", "lines", "pipe_table", "row_accuracy", "scorecard", "text_preservation"]
