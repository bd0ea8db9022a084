"""Command line: convert a folder of files.

    spark-submit quillspark/cli.py INPUT OUTPUT [--format markdown|json|text|parquet] [--pattern GLOB] [--exclude GLOB] [--sort name|size|date] [--max-files N]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.scalars import glob_to_regex
from quillspark.sources import files, parsers


def select_files(scanned: DataFrame, exclude: list[str] = (), sort: str = "name", max_files: int | None = None) -> DataFrame:
    """Exclude by shell patterns on the name, sort ascending, keep the first ``max_files`` (one bounded top-k)."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    for pattern in exclude:
        scanned = scanned.filter(~name.rlike(glob_to_regex(pattern)))
    by = {"name": [name, F.col("path")], "size": [F.col("length"), F.col("path")], "date": [F.col("modificationTime"), F.col("path")]}[sort]
    ordered = scanned.orderBy(*by)
    return ordered.limit(max_files) if max_files else ordered


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Convert documents to Markdown, JSON, text or Parquet.")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--format", default="markdown", choices=["markdown", "json", "text", "parquet"])
    p.add_argument("--pattern")
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--sort", default="name", choices=sorted(["size", "name", "date"]))
    p.add_argument("--max-files", type=int)
    p.add_argument("--encoding")
    p.add_argument("--delimiter")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    chosen = select_files(files.scan(spark, a.input, a.pattern), a.exclude, a.sort, a.max_files)
    parsed = parsers.parse_files(chosen, {"encoding": a.encoding, "delimiter": a.delimiter})
    files.save(parsed, a.output, a.format)
    failed = parsed.filter(F.col("error").isNotNull()).count()
    print(f"{failed} files failed" if failed else "all files converted")
    return int(failed > 0)


if __name__ == "__main__":
    raise SystemExit(main())
