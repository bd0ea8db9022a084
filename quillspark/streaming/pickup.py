"""A folder as a stream: files that arrive are routed and parsed by the same plan as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import formats, parsers

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, path: str, files_per_trigger: int = 1000, **options) -> DataFrame:
    """A stream of parsed documents."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").load(path)
    return parsers.parse_files(formats.route(files), options)


def sink(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append to Parquet; the checkpoint makes each file count once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
