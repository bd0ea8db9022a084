"""Column picking, run-time folders and Arrow plumbing shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Select exactly the named columns, renamed: ``pick(df, id="doc_id")``.

    Columns are found by position, so others whose names differ only in case (or repeat) never clash.
    The exact spelling wins; else the first case-insensitive match.
    """
    return numbered(df).select(*[F.col(place(df, old)).alias(new) for new, old in names.items()])


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns renamed c0, c1, ...: none clash. ``.toDF(*df.columns)`` gives the names back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def place(df: DataFrame, name: str) -> str:
    """The name in ``numbered(df)`` of the column spelled exactly so, or else of the first but for case."""
    lower = [c.lower() for c in df.columns]
    return f"c{df.columns.index(name) if name in df.columns else lower.index(name.lower())}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``. Where it is unset, a local master (tests) gets a temporary folder, and a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quill-ckpt-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: What ``written`` wrote for each context; it goes when the driver ends.
_written: list[tuple[SparkContext, str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet (compressed, unlike a checkpoint) into the shared checkpoint folder and read it again."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append((spark.sparkContext, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _delete_written() -> None:
    for sc, path in _written:
        if sc._jsc is not None and not sc._jsc.sc().isStopped():
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def parts_of(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_groups(texts: Iterable[bytes], limit: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """Cut a batch into runs of neighbouring texts of about ``limit`` bytes; yields (first index, texts)."""
    first, group, held = 0, [], 0
    for i, t in enumerate(texts):
        if group and held + len(t) > limit:
            yield first, group
            first, group, held = i, [], 0
        group.append(t)
        held += len(t)
    if group:
        yield first, group


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column's values as UTF-8 bytes, null as empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [t if t is not None else "" for t in column.to_pylist()]


#: Rows handled at once; a batch's texts need not all be Python objects at the same time.
SLICE = 1000


def per_batch(build: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turn "set up once, then map each slice of a batch" into the function that ``mapInArrow`` wants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = build()
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                yield step(b.slice(at, SLICE))

    return run
