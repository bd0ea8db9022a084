"""Views over the driver's tables that the catalogue's queries share, each with the same definition in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import items as I


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def v_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.text_items(documents(spark, sf_dir))


CAPS = "(trim(line) <> '' AND upper(line) = line AND lower(line) <> line AND length(line) < 100)"
KIND = r"""CASE WHEN regexp_matches(line, '^[*\d•-]+[).]\s+') THEN 'text:list'
 WHEN regexp_matches(line, '(?i)^(Chart|Fig|Graph|Image|Plate|Scheme|Table|Tbl)') OR regexp_matches(line, '(?i)^(Notes?|Source)[.:)]') THEN 'text:caption' ELSE 'text:normal' END"""
V_LINES = """v_lines AS (
 SELECT doc_id, CAST(i - 1 AS INTEGER) AS seq, l[i] AS line
 FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) t, unnest(range(1, len(l) + 1)) u(i)
)"""
V_ITEMS = f"""{V_LINES}, v_items AS (
 SELECT doc_id, seq, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY seq) = 1 THEN 'text:title' WHEN {CAPS} THEN 'text:section' ELSE {KIND} END AS type,
  line AS content, CAST(seq // 5 + 1 AS INTEGER) AS page, CAST((seq % 5) * 200 AS DOUBLE) AS position_y
 FROM v_lines WHERE trim(line) <> ''
)"""


def v_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as items: a user's turn opens a section."""
    c = read(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "text:section").otherwise("text:normal")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("seq"), kind.alias("type"), F.col("text").alias("content"), (F.floor(F.col("turn") / 2) + 1).cast("int").alias("page"), F.lit(0.0).alias("position_y"))


V_CONV = """v_conv AS (
 SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS seq, CASE WHEN role = 'user' THEN 'text:section' ELSE 'text:normal' END AS type, text AS content,
  CAST(turn // 2 + 1 AS INTEGER) AS page, CAST(0 AS DOUBLE) AS position_y FROM conversations
)"""


def v_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as rows of four texts, ``table_id, r, texts``: one shuffle, by table."""
    from pyspark.sql import Window

    li = read(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    n = li.withColumn("r", (F.row_number().over(w) - 1).cast("int"))
    flag = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    texts = F.array(F.col("l_partkey").cast("string"), flag, F.col("l_linestatus"), F.concat(F.lit("a|b<"), F.col("l_linenumber").cast("string")))
    return n.select(F.col("l_orderkey").alias("table_id"), "r", texts.alias("texts"))


def v_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as tables of four text columns, one a line, empty where returnflag is N; some cells are merged."""
    return v_rows(spark, sf_dir).select("table_id", "r", F.posexplode("texts").alias("c", "text"))


V_GRID = """v_grid AS (
 SELECT l_orderkey AS table_id, r, CAST(c AS INTEGER) AS c,
  CASE c WHEN 0 THEN CAST(l_partkey AS VARCHAR) WHEN 1 THEN CASE WHEN l_returnflag <> 'N' THEN l_returnflag END WHEN 2 THEN l_linestatus ELSE 'a|b<' || CAST(l_linenumber AS VARCHAR) END AS text
 FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS INTEGER) AS r FROM lineitem), range(4) t(c)
)"""


def v_chrome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as page items: the return flag as text, near the top or the foot by line status."""
    li = read(spark, sf_dir, "lineitem")
    y = F.when(F.col("l_linestatus") == "O", 20.0).when(F.col("l_quantity") > 25, 790.0).otherwise(400.0)
    return li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("seq"), F.lit("text:normal").alias("type"), F.col("l_returnflag").alias("content"), F.col("l_linenumber").alias("page"), y.alias("position_y"))


V_CHROME = """v_chrome AS (
 SELECT l_orderkey AS doc_id, l_partkey AS seq, 'text:normal' AS type, l_returnflag AS content, l_linenumber AS page,
  CASE WHEN l_linestatus = 'O' THEN 20.0 WHEN l_quantity > 25 THEN 790.0 ELSE 400.0 END AS position_y FROM lineitem
)"""


def v_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as boxes on pages of 50."""
    e = read(spark, sf_dir, "events")
    x, y = F.pmod(F.col("user_id") * 37, F.lit(600)).cast("double"), F.pmod(F.col("event_id") * 53, F.lit(800)).cast("double")
    return e.select("event_id", F.floor(F.col("event_id") / 500).alias("doc_id"), F.floor(F.col("event_id") / 50).alias("page"), "event_type", x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 20).alias("y1"), (F.pmod("event_id", F.lit(7)) * 2 + 8).cast("double").alias("size"))


V_GEO = """v_geo AS (
 SELECT event_id, event_id // 500 AS doc_id, event_id // 50 AS page, event_type, CAST((user_id * 37) % 600 AS DOUBLE) AS x0, CAST((event_id * 53) % 800 AS DOUBLE) AS y0,
  CAST((user_id * 37) % 600 AS DOUBLE) + 60 AS x1, CAST((event_id * 53) % 800 AS DOUBLE) + 20 AS y1, CAST(event_id % 7 * 2 + 8 AS DOUBLE) AS size FROM events
)"""


def v_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as uses of a cache: key, and when in seconds."""
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("cache_key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("now"))


V_ACCESS = "v_access AS (SELECT event_id, user_id AS cache_key, CAST(floor(epoch(ts)) AS BIGINT) AS now FROM events)"
