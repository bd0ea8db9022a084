"""Table grids as cells: coercion, padding, spans and the four renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import once


def cell_text(raw: Column) -> Column:
    return F.coalesce(F.trim(raw), F.lit(""))


def span(raw: Column) -> Column:
    """A span as a whole number of at least 1, whatever it was."""
    return F.greatest(F.lit(1), F.coalesce(F.expr("try_cast(1 as int)") * 0 + raw.try_cast("int"), F.lit(1)))


def gather(cells: DataFrame) -> DataFrame:
    """Cells as rows, ``table_id, r, cells``: an array of structs of what a cell has, by column."""
    own = [c for c in cells.columns if c not in ("table_id", "r", "c", "is_header")]
    return cells.groupBy("table_id", "r").agg(F.sort_array(F.collect_list(F.struct("c", *own))).alias("cells"))


def _filled(rows: DataFrame) -> DataFrame:
    """Rows as wide as their table, with null cells where it has none, and ``last`` and ``rmax``, the table's last column and row.

    Rows stay where their table's are: windows by table don't move what comes so, and no table is held in memory.
    """
    table, cells, every = Window.partitionBy("table_id"), F.col("cells"), F.sequence(F.lit(0), F.col("last"))
    sized = rows.filter("table_id is not null").withColumn("last", F.max(F.array_max(cells["c"])).over(table)).withColumn("rmax", F.max("r").over(table))
    own = lambda c, x, k: F.when(c.isNotNull(), F.lit(None)).otherwise(x[k]).alias(k)  # noqa: E731 - null of that column's type
    none = F.transform(F.array_except(every, cells["c"]), lambda c: F.struct(c.alias("c"), *[own(c, F.get(cells, F.lit(0)), k) for k in ("text", "rowspan", "colspan")]))
    plain = F.transform(cells, lambda x: F.struct(x["c"].alias("c"), *[x[k].alias(k) for k in ("text", "rowspan", "colspan")]))
    return sized.withColumn("cells", F.when(cells["c"] == every, plain).otherwise(F.sort_array(F.concat(plain, none))))


def pad_rows(rows: DataFrame) -> DataFrame:
    """``pad`` of rows."""
    cell = lambda x: F.struct(x["c"].alias("c"), cell_text(x["text"]).alias("text"), F.coalesce(x["rowspan"], F.lit(1)).alias("rowspan"), F.coalesce(x["colspan"], F.lit(1)).alias("colspan"))
    return _filled(rows).select("table_id", "r", F.transform("cells", cell).alias("cells"))


def normalize_rows(rows: DataFrame) -> DataFrame:
    """``normalize`` of rows, ``table_id, r, cells``.

    A tall cell sends what it covers to the rows below it in the same partition, so the only shuffle is that by table, and none if rows come so.
    """
    cells = F.col("cells")
    tall, wide = F.coalesce(F.array_max(cells["rowspan"]) > 1, F.lit(False)), F.coalesce(F.array_max(cells["colspan"]) > 1, F.lit(False))
    high = lambda x: F.least(F.coalesce(x["rowspan"], F.lit(1)), F.col("rmax") - F.col("r") + 1)
    broad = lambda x: F.least(F.coalesce(x["colspan"], F.lit(1)), F.col("last") - x["c"] + 1)
    reach = lambda x: F.transform(F.sequence(F.col("r") + 1, F.col("r") + high(x) - 1), lambda r: F.struct(r.alias("r"), x["c"].alias("from"), (x["c"] + broad(x) - 1).alias("to")))
    below = F.flatten(F.transform(F.filter(cells, lambda x: high(x) > 1), reach))
    own = F.array(F.struct("r", F.lit(None).cast("int").alias("from"), F.lit(None).cast("int").alias("to")))
    sent = _filled(rows).select("table_id", "cells", "last", "rmax", F.explode(F.when(tall, F.concat(own, below)).otherwise(own)).alias("x"))
    sent = sent.select("table_id", "x.r", "last", "rmax", F.when(F.col("x.from").isNull(), cells).alias("cells"), F.when(F.col("x.from").isNotNull(), F.struct("x.from", "x.to")).alias("under"))
    met = sent.withColumn("above", F.collect_list("under").over(Window.partitionBy("table_id", "r"))).filter("cells is not null")
    right = F.transform(F.filter(cells, lambda x: x["colspan"] > 1), lambda x: F.struct((x["c"] + 1).alias("from"), (x["c"] + broad(x) - 1).alias("to")))

    def cell(x: Column, under: Column) -> Column:
        one = lambda value, k: F.when(under, "" if k == "text" else 1).otherwise(value).alias(k)
        return F.struct(x["c"].alias("c"), one(cell_text(x["text"]), "text"), one(high(x), "rowspan"), one(broad(x), "colspan"), under.alias("is_continuation"))

    free = F.transform(cells, lambda x: F.struct(x["c"].alias("c"), cell_text(x["text"]).alias("text"), F.coalesce(x["rowspan"], F.lit(1)).alias("rowspan"), F.coalesce(x["colspan"], F.lit(1)).alias("colspan"), F.lit(False).alias("is_continuation")))
    covered = lambda spans: F.transform(cells, lambda x: once(F.exists(spans, lambda s: (s["from"] <= x["c"]) & (x["c"] <= s["to"])), lambda under: cell(x, under)))
    return met.select("table_id", "r", F.when(tall | wide | (F.size("above") > 0), once(F.concat("above", right), covered)).otherwise(free).alias("cells"))


def pad(cells: DataFrame) -> DataFrame:
    """Every table a rectangle: ``table_id, r, c, text, rowspan, colspan``; what is missing is an empty cell."""
    return spread(pad_rows(gather(cells)))


def normalize(cells: DataFrame) -> DataFrame:
    """Padded cells with spans clamped to the grid and ``is_continuation`` where another cell's span covers one.

    For grids whose spans don't overlap one another, in which any order of claims gives the same result.
    """
    return spread(normalize_rows(gather(cells))).withColumn("is_header", F.col("r") == 0)


def spread(rows: DataFrame) -> DataFrame:
    """The cells of rows, one a row."""
    return rows.select("table_id", "r", F.inline("cells"))


def empty_runs(cells: DataFrame) -> DataFrame:
    """Spans read off empty cells: a filled cell spans the empty ones right of it, and those below it."""
    filled = F.col("text") != ""
    right = Window.partitionBy("table_id", "r").orderBy("c").rowsBetween(1, Window.unboundedFollowing)
    below = Window.partitionBy("table_id", "c").orderBy("r").rowsBetween(1, Window.unboundedFollowing)
    size = cells.groupBy("table_id").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"))
    w = cells.withColumn("next_c", F.min(F.when(filled, F.col("c"))).over(right)).withColumn("next_r", F.min(F.when(filled, F.col("r"))).over(below)).join(size, "table_id")
    return w.filter(filled).select("table_id", "r", "c", "text", (F.coalesce("next_c", "cols") - F.col("c")).cast("int").alias("colspan"), (F.coalesce("next_r", "rows") - F.col("r")).cast("int").alias("rowspan"))


def column_stats(cells: DataFrame) -> DataFrame:
    """``table_id, c, width, emptiness``."""
    return cells.groupBy("table_id", "c").agg(F.max(F.length("text")).alias("width"), F.avg((F.col("text") == "").cast("double")).alias("emptiness"))


def escape(text: Column, quotes: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(out, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;")) if quotes else out


def pipe_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\n"), F.lit("<br>")), F.lit("|"), F.lit("\\|"))


def _lines(line: Column) -> Column:
    """A table's lines in order as one text."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", line.alias("v")))), lambda x: x["v"]), "\n")


def to_pipe_table(cells: DataFrame) -> DataFrame:
    """``table_id, markdown``: a pipe table, its header first."""
    return pipe_table(gather(cells))


def pipe_table(rows: DataFrame) -> DataFrame:
    """``to_pipe_table`` of rows."""
    line = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda x: pipe_cell(x["text"])), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda _: F.lit("---")), " | "), F.lit(" |"))
    lines = rows.select("table_id", "r", F.concat(line, F.when(F.col("r") == 0, F.concat(F.lit("\n"), rule)).otherwise("")).alias("line"))
    return lines.groupBy("table_id").agg(F.concat(_lines(F.col("line")), F.lit("\n")).alias("markdown"))


def to_html_table(cells: DataFrame, styled: bool = False) -> DataFrame:
    """``table_id, html``: cells under a span are left out; spans above 1 are attributes; the first row is a header."""
    return html_table(gather(cells), styled)


def html_table(rows: DataFrame, styled: bool = False) -> DataFrame:
    """``to_html_table`` of rows."""
    css = F.lit(' style="border: 1px solid #999; padding: 4px;"' if styled else "")
    tag = F.when(F.col("r") == 0, "th").otherwise("td")
    attr = lambda x, k: F.when(x[k] > 1, F.concat(F.lit(f' {k}="'), x[k], F.lit('"'))).otherwise("")
    cell = lambda x: F.concat(F.lit("<"), tag, attr(x, "rowspan"), attr(x, "colspan"), css, F.lit(">"), escape(x["text"], styled), F.lit("</"), tag, F.lit(">"))
    shown = F.transform(F.filter("cells", lambda x: ~x["is_continuation"]), cell)
    lines = rows.select("table_id", "r", F.concat(F.lit("  <tr>"), F.array_join(shown, ""), F.lit("</tr>")).alias("line"))
    top = '<table style="border-collapse: collapse;">' if styled else "<table>"
    return lines.groupBy("table_id").agg(F.concat(F.lit(top + "\n"), _lines(F.col("line")), F.lit("\n</table>")).alias("html"))


def to_grid(cells: DataFrame) -> DataFrame:
    """``table_id, grid``: padded columns; ⊕ marks a merged cell, → and ↓ what it covers to the right and below."""
    return grid(gather(cells))


def grid(rows: DataFrame) -> DataFrame:
    """``to_grid`` of rows. Widths and what covers a cell are found in the array of a table's rows, without a join."""
    tall = lambda row: F.transform(F.filter(row["cells"], lambda x: (x["rowspan"] > 1) & ~x["is_continuation"]), lambda x: F.struct(x["c"].alias("c"), row["r"].alias("r"), (row["r"] + x["rowspan"] - 1).alias("end")))

    def mark(x: Column, row: Column, talls: Column) -> Column:
        from_above = F.exists(talls, lambda t: (t["c"] == x["c"]) & (t["r"] < row["r"]) & (t["end"] >= row["r"]))
        return F.when(x["is_continuation"], F.when(from_above, "↓").otherwise("→")).when((x["rowspan"] > 1) | (x["colspan"] > 1), F.concat(x["text"], F.lit(" ⊕"))).otherwise(x["text"])

    def drawn(shown: Column) -> Column:
        widths = F.aggregate(shown, F.array().cast("array<int>"), lambda most, row: F.zip_with(most, row, lambda n, x: F.greatest(n, F.length(x))))
        padded = lambda x, n: F.concat(x, F.repeat(F.lit(" "), n - F.length(x)))
        return once(widths, lambda w: F.array_join(F.transform(shown, lambda row: F.concat(F.lit("| "), F.array_join(F.zip_with(row, w, padded), " | "), F.lit(" |"))), "\n"))

    tables = rows.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("r", "cells"))).alias("rows"))
    shown = once(F.flatten(F.transform("rows", tall)), lambda talls: F.transform("rows", lambda row: F.transform(row["cells"], lambda x: mark(x, row, talls))))
    return tables.select("table_id", once(shown, drawn).alias("grid"))


def render(cells: DataFrame) -> DataFrame:
    """``table_id, rendered``: a pipe table, or HTML where any cell is merged."""
    kind = cells.groupBy("table_id").agg(F.max((F.col("is_continuation") | (F.col("rowspan") > 1) | (F.col("colspan") > 1)).cast("int")).alias("merged"))
    return kind.join(to_pipe_table(cells), "table_id").join(to_html_table(cells), "table_id").select("table_id", F.when(F.col("merged") == 1, F.col("html")).otherwise(F.col("markdown")).alias("rendered"))
