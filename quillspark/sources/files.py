"""Files as DataFrames: scanning, routing, parsing, batches, and the cache of whole documents."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formats, parsers


def scan(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """``path, modificationTime, length, content, ext, format, family, supported`` of a folder's files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return formats.route(reader.load(path))


def load_directory(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True, **options: Any) -> DataFrame:
    """Parsed documents of a folder; files that can't be read are rows with an ``error``."""
    return parsers.parse_files(scan(spark, path, pattern, recursive), options)


def load(spark: SparkSession, path: str, **options: Any) -> parsers.Parsed:
    """One file, parsed. Raises FileNotFoundError, UnsupportedFormatError or ProcessingError."""
    from pyspark.errors import AnalysisException

    from . import mail, markup, office  # noqa: F401 - they register their parsers

    try:
        row = scan(spark, path, recursive=False).select("format", "content").first()
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    if row is None:
        raise FileNotFoundError(path)
    return parsers.parse_bytes(bytes(row["content"]), row["format"], options)


def load_files(spark: SparkSession, paths: list[str], **options: Any) -> DataFrame:
    """The files named (paths or URIs), in their order (``input_ordinal``); an empty list gives an empty table.

    A path that can't be found is a row with an error, not the end of the batch.
    """
    if not paths:
        return spark.createDataFrame([], parsers.PARSED).withColumn("input_ordinal", F.lit(0))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    asked, there = [], []
    for i, p in enumerate(paths):  # names are made as the scan will give them
        at = jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(conf)
        asked.append((fs.makeQualified(at).toString(), i))
        if fs.exists(at):
            there.append(asked[-1][0])
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    order = spark.createDataFrame(asked, "asked string, input_ordinal int").withColumn("name", plain(F.col("asked")))
    parsed = spark.createDataFrame([], parsers.PARSED)
    if there:
        parsed = parsers.parse_files(formats.route(spark.read.format("binaryFile").load(sorted(set(there)))), options)
    found = order.join(parsed.withColumn("name", plain(F.col("path"))), "name", "left")  # the planner broadcasts the shorter side only if it is small
    error = parsers.PARSED["error"].dataType
    lost = F.struct(*[F.lit("FileNotFoundError" if f.name == "class" else "file not found").cast(f.dataType).alias(f.name) for f in error.fields])
    return found.withColumn("error", F.when(F.col("path").isNull(), lost).otherwise(F.col("error"))).withColumn("path", F.coalesce("path", "asked")).drop("name", "asked").orderBy("input_ordinal")


def batch_results(parsed: DataFrame) -> DataFrame:
    """``path, status, format, content_length, error`` of every file; a failed file is an entry, never an abort."""
    return parsed.select("path", F.when(F.col("error").isNull(), "success").otherwise("failed").alias("status"), "format", F.length("content").alias("content_length"), "error")


def batch_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


# Sinks


def save(parsed: DataFrame, path: str, output_format: str = "markdown") -> None:
    """Write documents as text (one part a task) or JSON lines; a table of all columns with ``parquet``."""
    good = parsed.filter(F.col("error").isNull())
    if output_format == "parquet":
        parsed.write.mode("overwrite").partitionBy("format").parquet(path)
    elif output_format == "json":
        good.select("path", "content", "metadata", "items").write.mode("overwrite").json(path)
    elif output_format in ("markdown", "text"):
        from ..operators.items import plain_text

        body = F.col("content") if output_format == "markdown" else plain_text(F.col("content"))
        good.select(F.to_json(F.struct("path", body.alias("content"))).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown output format {output_format!r}")


def save_one_file_each(parsed: DataFrame, folder: str, suffix: str = ".md") -> DataFrame:
    """Write each document to ``folder/stem.md`` on storage that all executors share; returns path and output file.

    Names hold a hash of the whole path, so files of one stem don't overwrite one another.
    """
    import hashlib
    from pathlib import Path

    def write(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                target = Path(folder) / f"{Path(path).stem}-{hashlib.sha256(path.encode()).hexdigest()[:8]}{suffix}"
                target.parent.mkdir(parents=True, exist_ok=True)
                part = target.with_suffix(target.suffix + ".part")
                part.write_text(content or "", encoding="utf-8")
                part.replace(target)  # a task that runs again replaces its own output
                out.append(str(target))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["path", "output_file"])

    return parsed.filter(F.col("error").isNull()).select("path", "content").mapInArrow(write, "path string, output_file string")


# Cache of whole documents


def document_key(options: dict[str, Any]) -> Column:
    """sha256 over path, time, length, format and the settings in a fixed order."""
    settings = json.dumps(options, sort_keys=True, default=str)
    return F.sha2(F.to_json(F.struct("path", F.unix_micros("modificationTime").alias("mtime"), "length", "format", F.lit(settings).alias("options"))), 256)


def load_cached(files: DataFrame, cache: DataFrame | None, **options: Any) -> tuple[DataFrame, DataFrame]:
    """All parsed documents, and those that are new to the cache (to be appended to it)."""
    keyed = files.withColumn("cache_key", document_key(options))
    todo = keyed if cache is None else keyed.join(cache.select("cache_key"), "cache_key", "left_anti")
    fresh = parsers.parse_files(todo, options).join(todo.select("path", "cache_key"), "path")
    if cache is None:
        return fresh, fresh
    held = cache.join(keyed.select("cache_key"), "cache_key", "left_semi")
    return held.unionByName(fresh), fresh
