"""Lempel-Ziv phrase fingerprints of documents, compared by minimum hashes for compression-like likeness.

A text is parsed as LZ78 does: each phrase is the longest one already in the dictionary plus one character.
The set of phrases is hashed, and its ``KEPT`` smallest hashes are the fingerprint. Two fingerprints give
the estimate of their phrase sets' Jaccard likeness from the smallest hashes of the union; sets of fewer
than ``KEPT`` phrases compare exactly.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _vec
from ._frames import parts_of, pick

KEPT = 128
#: Texts of more characters are parsed with one flat dictionary, which takes half the memory of nested ones; the phrases are the same.
FLAT = 1 << 20

PRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType())])
EDITED = T.StructType(
    [T.StructField(n, t()) for n, t in (("doc_id", T.LongType), ("n_chars", T.LongType), ("edited_sha256", T.StringType), ("fingerprint", T.StringType), ("edited_fingerprint", T.StringType), ("near_edited", T.DoubleType), ("near_next", T.DoubleType))]
)


def _parse(root: dict, node: dict, text: str, at: int, ends: list[int], grown: list[dict]) -> dict:
    """Go on parsing from ``node``; notes where phrases end and which nodes grew."""
    end, grew = ends.append, grown.append
    for c in text:
        at += 1
        if c in node:
            node = node[c]
        else:
            node[c] = {}
            grew(node)
            node = root
            end(at)
    return node


def phrase_ends(text: str) -> list[int]:
    """Where each phrase of the text ends; the last may repeat an earlier one. One dictionary serves the whole text."""
    ends: list[int] = []
    if len(text) <= FLAT:
        root: dict = {}
        _parse(root, root, text, 0, ends, [])
    else:
        nodes: dict[int, int] = {}
        node, at, get, end = 0, 0, nodes.get, ends.append
        for c in text:
            at += 1
            key = node << 21 | ord(c)
            node = get(key, -1)
            if node < 0:
                nodes[key] = len(nodes) + 1
                node = 0
                end(at)
    if text and (not ends or ends[-1] != len(text)):
        ends.append(len(text))
    return ends


def two_endings(head: str, one: str, other: str) -> tuple[list[int], list[int]]:
    """``phrase_ends`` of head + one and of head + other, parsing the head once."""
    if len(head) + max(len(one), len(other)) > FLAT:
        return phrase_ends(head + one), phrase_ends(head + other)
    root: dict = {}
    ends: list[int] = []
    node = _parse(root, root, head, 0, ends, [])
    out = []
    for tail in (one, other):
        mine: list[int] = []
        grown: list[dict] = []
        _parse(root, node, tail, len(head), mine, grown)
        for d, e in zip(grown, mine, strict=True):  # take back what this ending added
            d.pop(tail[e - 1 - len(head)], None)
        all_ends, n = ends + mine, len(head) + len(tail)
        if n and (not all_ends or all_ends[-1] != n):
            all_ends.append(n)
        out.append(all_ends)
    return out[0], out[1]


def sketch(text: str, ends: list[int]) -> np.ndarray:
    """The smallest distinct 32-bit phrase hashes in order."""
    if not text:
        return np.zeros(0, np.uint32)
    symbols = (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    stops = np.array(ends)
    starts = np.concatenate(([0], stops[:-1]))
    hashes = (_vec.span_hashes(symbols, starts, stops) >> np.uint64(32)).astype(np.uint32)
    if len(hashes) > 4 * KEPT:
        least = np.unique(np.partition(hashes, 3 * KEPT)[: 3 * KEPT])
        if len(least) >= KEPT:
            return least[:KEPT]
    return np.unique(hashes)[:KEPT]


def to_string(values: np.ndarray) -> str:
    return base64.b64encode(values.astype("<u4").tobytes()).decode()


def from_string(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness, 0 to 1; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate((a, b)))
    twice = np.zeros(len(both), bool)
    twice[1:] = both[1:] == both[:-1]
    # of the union's smallest, as many as either sketch can vouch for
    sure = KEPT if len(a) >= KEPT or len(b) >= KEPT else len(both)
    rank = np.cumsum(~twice)
    inside = rank <= sure
    return float(twice[inside].sum() / (~twice)[inside].sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every whole text; null counts as empty.

    Null ids stay null; repeated rows give repeated results; a text of any length is parsed with one dictionary (some 100 bytes
    a phrase, and there are fewer phrases than characters); other columns are ignored; an empty table gives an empty one. Narrow: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            prints = [to_string(sketch(t, phrase_ends(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(prints, pa.string())], names=PRINTS.names)

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, PRINTS)


def fingerprints_with_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to both the edit and the next document.

    The next document is the one before in id; after the smallest id comes the largest. Null ids come last,
    repeated ids in order of a hash of their texts; null texts count as empty; texts of any length are parsed with one
    dictionary; a single row is its own next; other columns are ignored; an empty table gives an empty one. The edited text
    has the last floor(n/2) code points replaced by the first as many (or all) of the next document.

    The table is range-partitioned once by id, by bounds from its quantiles; an id that fills several quantiles is
    divided further by the texts' hash. The first row of each range is also sent to the range before, so neighbours meet
    without a second shuffle.
    """
    spark = docs.sparkSession
    rows = pick(docs, id=id_col, text=text_col).select(F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.col("id").isNull().alias("none"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    n_parts = parts_of(spark)
    keys = rows.select("key", "none", "h")
    if n_parts > 1:
        found = keys.agg(F.percentile_approx("key", [i / n_parts for i in range(1, n_parts)], max(10_000, 4 * n_parts))).first()[0] or []
    else:
        found = []
    exact, quantiles = np.unique(np.array(found, np.int64), return_counts=True)
    # an id in several quantiles has that many ranges of its own, and those below it one more
    own = np.append(np.where(quantiles > 1, quantiles, 0), 0)
    first = np.cumsum((own + 1)[::-1])[::-1] - (own + 1)  # ids in falling order

    def bucket_of(key: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(exact, key, "left")
        hot = (own[at] > 0) & (np.append(exact, 0)[at] == key)
        share = (h.astype(np.float64) + 2.0**63) / 2.0**64
        return first[at] + np.where(hot, np.minimum((share * own[at]).astype(np.int64), own[at] - 1), own[at])

    @F.pandas_udf("int")
    def bucket(key: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(key.to_numpy(), h.to_numpy()).astype(np.int32))

    head = F.min(F.struct(F.bitwise_not("key").alias("below"), "h", "none")).alias("head")
    firsts = {r["bucket"]: (~r["head"]["below"], r["head"]["h"], r["head"]["none"]) for r in keys.withColumn("bucket", bucket("key", "h")).groupBy("bucket").agg(head).collect()}
    used = sorted(firsts)
    before = {firsts[b]: used[i - 1] for i, b in enumerate(used)}  # the range that a first row closes
    heads = {k[0] for k in before}

    @F.pandas_udf("array<int>")
    def places(key: pd.Series, h: pd.Series, none: pd.Series) -> pd.Series:
        at = bucket_of(key.to_numpy(), h.to_numpy())
        return pd.Series([[int(b)] if k not in heads or (p := before.get((k, x, n))) is None else [int(b), -1 - p] for b, k, x, n in zip(at, key.tolist(), h.tolist(), none.tolist(), strict=True)])

    sent = rows.withColumn("place", F.explode(places("key", "h", "none"))).select(F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("bucket"), (F.col("place") < 0).alias("peek"), "key", "none", "text", "h")
    sent = sent.repartitionById(max(1, int((own + 1).sum())), "bucket").sortWithinPartitions("bucket", "peek", F.desc("key"), "h", "none", "text").drop("h")
    return sent.mapInArrow(_neighbours, EDITED)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gc.disable()  # the tries hold no cycles
    held = None  # bucket, id, text
    done: list[tuple] = []

    def finish(pending: tuple, text: str) -> tuple[tuple, np.ndarray]:
        """The row of ``pending``, whose next document is ``text``, but for its last column; and its sketch."""
        _, i, own = pending[:3]
        n = len(own)
        keep = n - n // 2
        edited = own[:keep] + text[: n // 2]
        mine, changed = two_endings(own[:keep], own[keep:], text[: n // 2])
        a, b = sketch(own, mine), sketch(edited, changed)
        return (i, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_string(a), to_string(b), likeness(a, b)), a

    # a row waits for its next text, and then for that text's own sketch
    waiting = None  # a finished row but for near_next, its sketch

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r[c] for r in done], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=EDITED.names)
        done.clear()
        return out

    try:
        for b in batches:
            buckets, peeks, keys, nones = (b.column(c).to_pylist() for c in range(4))
            for bucket, peek, key, none, text in zip(buckets, peeks, keys, nones, b.column(4), strict=True):
                if held is not None and held[0] != bucket:
                    held = None
                if peek and held is None:
                    continue
                text = text.as_py() or ""
                if held is not None:
                    row, own_sketch = finish(held, text)
                    if waiting is not None:
                        done.append((*waiting[0], likeness(waiting[1], own_sketch)))
                    if peek:
                        done.append((*row, likeness(own_sketch, sketch(text, phrase_ends(text)))))
                        held = waiting = None
                        continue
                    waiting = (row, own_sketch)
                held = (bucket, None if none else key, text)
            if len(done) >= 1000:
                yield flush()
        if done:
            yield flush()
    finally:
        gc.enable()
