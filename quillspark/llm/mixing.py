"""Mixing sources to target weights by hash-random order, distributed prefix sums and an exact cut.

Every document has a hash-random key; the keys of a source are ranges (buckets of the key's leading bits)
sorted within, so a document's place is its bucket's offset plus the running sum in the bucket. A source
is taken whole as many times as its target holds it, and once more up to the budget that is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._frames import cut_lineage, numbered, pick, place

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
SALT = "mix:"
#: A table of so many sources (a key and a name each, some 10 MB at most) is broadcast.
FEW_SOURCES = 50_000
BUCKET_DIGITS = 3  # hex digits of the key: 4096 ranges a source


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From ``source, source_size``: each source's weight by rank and its ``target``.

    Ranks are by code point, null last, counted over a range-sorted table without gathering it. The total
    is shared by weight; a target stops at ``most`` times its source, and what is over is shared again
    until none is above. The level of sharing rises each time, so this ends after as many small
    aggregations as there are such rounds.
    """
    ordered = cut_lineage(sources.orderBy(F.asc_nulls_last("source")).withColumn("m", F.monotonically_increasing_id()))
    part = F.shiftright("m", 33)
    seen, offsets = 0, {}
    for row in ordered.groupBy(part.alias("p")).count().orderBy("p").collect():  # a row for each partition
        offsets[row["p"]] = seen
        seen += row["count"]
    if not offsets:
        return sources.withColumn("target", F.lit(0.0))
    offset = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])[part]
    rank = (offset + (F.col("m").bitwiseAND(F.lit((1 << 33) - 1)))).cast("long")
    weighed = ordered.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")).alias("weight"))
    total = int(weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, capped_before = None, -1
    while True:
        capped = F.lit(False) if level is None else F.col("source_size") * most < F.lit(level) * F.col("weight")
        row = weighed.agg(F.sum(F.when(capped, F.col("source_size") * most).otherwise(0)).alias("held"), F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("free"), F.count(F.when(capped, 1)).alias("n")).first()
        if row["n"] == capped_before or not row["free"]:
            break
        capped_before, level = row["n"], (total - int(row["held"])) / int(row["free"])
    return weighed.withColumn("target", F.least((F.col("source_size") * most).cast("double"), F.lit(level) * F.col("weight")))


def _key(doc_id: str, text: str) -> Column:
    """Hash-random by id and text, so that rows without an id or of one id are spread too."""
    return F.md5(F.concat(F.lit(SALT), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary"))


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``doc_id, size, source, key, rows, source_size, target, start, epochs, left`` of every distinct document.

    ``rows``: how many rows of the source have this id and text. ``start``: words of the source before them in hash
    order. ``epochs``: whole passes over the source that its target holds; ``left``: the words of the target beyond them.
    """
    each = pick(docs, doc_id=id_col, text=text_col, source=source_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), _size("text").alias("size"), F.col("source").cast("string").alias("source"), _key("doc_id", "text").alias("key")
    )
    # equal rows are one from here on: they are counted before anything is moved
    base = cut_lineage(each.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("rows")).withColumn("bucket", F.conv(F.substring("key", 1, BUCKET_DIGITS), 16, 10).cast("int")))
    words = F.col("size") * F.col("rows")
    buckets = base.groupBy("source", "bucket").agg(F.sum(words).alias("bucket_size"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("offset", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
    offsets = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.source", "o.bucket", "o.offset", "t.source_size", "t.target")
    running = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("in_bucket", F.coalesce(F.sum(words).over(running), F.lit(0)))
    both = placed.alias("d").join(offsets.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.bucket") == F.col("o.bucket")))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    return both.select("d.doc_id", "d.size", "d.source", "d.key", "d.rows", "o.source_size", "o.target", (F.col("o.offset") + F.col("d.in_bucket")).alias("start")).withColumn("epochs", epochs).withColumn("left", budget - F.col("epochs") * F.col("source_size"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row.

    Size: words of the text, null 0. ``taken``: words that the mix takes, repeats counted; the last document
    of a source's last pass is cut at the exact budget. The order is by a hash of id and text; equal rows follow one another.
    Null ids, null sources and repeated rows take part like others; texts of any length count whole; an empty table gives an
    empty one; a source without words takes 0; other columns are ignored.
    """
    each = _placed(docs, id_col, text_col, source_col).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("start") - F.col("nth") * F.col("size")))
    return each.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as the mix takes it.

    Documents stay whole, so a source ends at the document border nearest to its budget. As the hash order
    is fixed, that border is one key a source: the texts meet a table of one row a source, which is
    broadcast if its counted rows are few. Of equal rows at the border (one id, one text) as many are taken as
    the budget holds. Null ids and sources take part like others; null and empty texts and white space have no words and
    go by the passes and the border like others; texts of any length count whole; names of columns may clash; an empty table gives an empty one.
    """
    placed = _placed(docs, id_col, text_col, source_col)
    # of a document's equal rows, so many end within the budget or cross it by half at most
    fit = F.when(F.col("size") > 0, F.least(F.col("rows"), F.floor((F.col("left") - F.col("start")) / F.col("size") + 0.5))).otherwise(F.col("rows"))
    begun = (F.col("left") > 0) & (F.col("start") <= F.col("left")) & (fit > 0)
    cuts = cut_lineage(placed.groupBy("source").agg(F.max("epochs").alias("epochs"), F.max(F.when(begun, F.struct("key", F.col("rows").alias("rows"), fit.cast("long").alias("fit")))).alias("cut")))
    cuts = cuts.select(F.col("source").alias("cut_source"), "epochs", "cut")
    flat = numbered(docs)
    key = _key(place(docs, id_col), place(docs, text_col))
    if cuts.count() <= FEW_SOURCES:  # else the planner's choice, which may shuffle the texts by source
        cuts = F.broadcast(cuts)
    joined = flat.withColumn("key", key).join(cuts, F.col(place(docs, source_col)).cast("string").eqNullSafe(F.col("cut_source")))
    at_border = (F.col("key") == F.col("cut.key")) & (F.col("cut.fit") < F.col("cut.rows"))
    ties = joined.filter(F.coalesce(at_border, F.lit(False)))
    rest = joined.filter(~F.coalesce(at_border, F.lit(False))).withColumn("more", F.coalesce((F.col("key") <= F.col("cut.key")).cast("int"), F.lit(0)))
    if not placed.groupBy().agg(F.max("rows").alias("m")).filter("m > 1").isEmpty():  # rows of one id and text: number those at the border
        nth = F.row_number().over(Window.partitionBy("cut_source").orderBy("key"))
        rest = rest.unionByName(ties.withColumn("more", (nth <= F.col("cut.fit")).cast("int")))
    copies = (F.col("epochs") + F.col("more")).cast("int")
    return rest.withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies))).select(*flat.columns).toDF(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         coalesce(sum(3 * source_size) OVER w, 0) AS held, coalesce(sum(weight) OVER w, 0) AS gone
  FROM s WINDOW w AS (ORDER BY 3.0 * source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT max(CAST(total - held AS DOUBLE) / CAST(weights - gone AS DOUBLE)) AS level
  FROM r WHERE CAST(total - held AS DOUBLE) / CAST(weights - gone AS DOUBLE) * weight <= 3 * source_size
), t AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), level * weight) AS target FROM s, l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + greatest(0, least(size, budget % source_size - start)) END AS BIGINT) AS taken
FROM p
"""
