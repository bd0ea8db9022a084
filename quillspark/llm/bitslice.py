"""Exact top-k inner products over quantised vectors with a bit-sliced index.

A block of rows is held as one bitmap per dimension and bit. For a query, the shifted slices of all
dimensions are added with bitmap arithmetic (full adders over machine words), which gives the slices of
every row's score at once; the top rows are then selected from the most significant slice downward, and
rows that tie at the boundary are resolved exactly, the smaller id first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import pick

SCALE = 256.0
#: A cell holds about so many queries and rows, the rows in bitmaps of so many.
CELL_QUERIES, CELL_ROWS, ROWS_AT_ONCE = 16_384, 262_144, 65_536
#: Components beyond this are met by exact integers of any size; scores beyond a long are its bounds.
LARGE = 1 << 24

HITS = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType()), T.StructField("copies", T.LongType())])


def quantised(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors take part, and their floor(256 * x); shorter vectors are filled up with 0.

    The components are floats holding integers, so that none is out of range.
    """
    lists = vectors.cast(pa.list_(pa.float64())) if not pa.types.is_list(vectors.type) or vectors.type.value_type != pa.float64() else vectors
    lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64), nan=-1).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    fine = np.isfinite(values)
    owner = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
    ok = (lengths >= 0) & (np.bincount(owner[~fine], minlength=len(lengths)) == 0)
    out = np.zeros((len(lengths), max(int(lengths.max(initial=0)), 1)))
    first = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    use = ok[owner]
    out[owner[use], (np.arange(len(values)) - np.repeat(first, np.maximum(lengths, 0)))[use]] = np.floor(np.clip(values[use], -7e305, 7e305) * SCALE)
    return ok, out


def exact_score(a: np.ndarray, b: np.ndarray) -> int:
    """Inner product of two float vectors of integers of any size, within a long's bounds."""
    n = min(len(a), len(b))
    total = sum(int(x) * int(y) for x, y in zip(a[:n].tolist(), b[:n].tolist(), strict=True))
    return max(-(1 << 63), min((1 << 63) - 1, total))


class BitSlicedBlock:
    """Rows (in order of id) as bitmaps per dimension and bit, and their complements for negative factors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.order = order
        n, self.dims = self.rows.shape
        self.n, self.words = n, -(-n // 64)
        self.low = self.rows.min(axis=0) if n else np.zeros(self.dims, np.int64)
        above = self.rows - self.low
        self.bits = np.array([int(x).bit_length() for x in above.max(axis=0)] if n else [0] * self.dims)
        self.first = np.concatenate(([0], np.cumsum(self.bits)))
        slices = np.zeros((int(self.first[-1]), self.words * 8), np.uint8)
        for d in range(self.dims):
            for b in range(self.bits[d]):
                packed = np.packbits(((above[:, d] >> b) & 1).astype(bool), bitorder="little")
                slices[self.first[d] + b, : len(packed)] = packed
        plain = slices.view(np.uint64)
        self.slices = np.concatenate((plain, ~plain))
        live = np.zeros(self.words * 64, bool)
        live[:n] = True
        self.live = np.packbits(live, bitorder="little").view(np.uint64)
        #: For every (dimension, bit): which row of ``slices`` it is, and its dimension.
        self.dim_of = np.repeat(np.arange(self.dims), self.bits)
        self.bit_of = np.arange(int(self.first[-1])) - self.first[self.dim_of]

    def score_slices(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bitmaps of the (shifted, so non-negative) scores, least significant first, and the shift."""
        size = np.abs(query)
        factors = size[self.dim_of]
        which, shift = np.nonzero((factors[:, None] >> np.arange(max(1, int(size.max(initial=0)).bit_length()))) & 1)
        weight = shift + self.bit_of[which]
        rows = which + np.where(query[self.dim_of[which]] < 0, len(self.dim_of), 0)
        base = int((query * self.low).sum() - (np.where(query < 0, size, 0) * ((1 << self.bits) - 1)).sum())
        order = np.argsort(weight, kind="stable")
        rows, weight = rows[order], weight[order]
        cuts = np.searchsorted(weight, np.arange(int(weight.max(initial=-1)) + 2))
        out, carried, s = [], [], 0
        while s + 1 < len(cuts) or carried:
            parts = ([self.slices[rows[cuts[s] : cuts[s + 1]]]] if s + 1 < len(cuts) else []) + carried
            now = np.concatenate(parts) if parts else np.zeros((0, self.words), np.uint64)
            carried = []
            while len(now) > 2:
                t = len(now) // 3
                a, b, c = now[:t], now[t : 2 * t], now[2 * t : 3 * t]
                ab = a ^ b
                carried.append((a & b) | (c & ab))
                now = np.concatenate((ab ^ c, now[3 * t :])) if len(now) % 3 else ab ^ c
            if len(now) == 2:
                carried.append((now[0] & now[1])[None])
                now = (now[0] ^ now[1])[None]
            out.append(now[0] if len(now) else np.zeros(self.words, np.uint64))
            s += 1
        return out, base

    def _set(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k best rows but the query's own, ties to the smaller id."""
        width = max(self.dims, len(query))
        if width > self.dims:
            query = query[: self.dims]  # the rows have 0 beyond
        elif len(query) < self.dims:
            query = np.concatenate((query, np.zeros(self.dims - len(query), np.int64)))
        slices, _ = self.score_slices(query)
        even = self.live.copy()
        for own in range(int(np.searchsorted(self.ids, query_id, "left")), int(np.searchsorted(self.ids, query_id, "right"))):
            even[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
        sure, n_sure = np.zeros_like(even), 0
        for s in reversed(slices):
            high = even & s
            n = n_sure + int(np.bitwise_count(high).sum())
            if n > k:
                even = high
            else:
                sure, n_sure = sure | high, n
                even = even & ~s
                if n == k:
                    even = np.zeros_like(even)
                    break
        rows = self._set(sure)
        if n_sure < k:
            rows = np.concatenate((rows, self._set(even)[: k - n_sure]))  # all of one score; rows are in order of id
        return rows, self.rows[rows] @ query


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of every query's k best rows by integer inner product, exactly.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no part. Rows with the
    query's id are its own and no candidates. Rows that repeat an id and vector are as many candidates; queries that do
    so ask once; an id with several vectors asks with each. Fewer than k candidates: all of them. Components of any size are
    exact; a score beyond a long is its bound. Other columns are ignored; empty tables give an empty one.

    Every query meets every row in a grid: blocks of queries by blocks of rows, each cell a task that keeps k rows a
    query. Neither queries nor rows reach the driver. Equal rows are counted first, so that none is hot.
    """
    def counted(df: DataFrame) -> DataFrame:
        given = pick(df, id=id_col, v=vector_col).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
        given = given.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        return given.groupBy("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).agg(F.count("*").alias("copies"))

    rows, asked = counted(vectors), counted(queries)
    n_rows, n_asked = rows.count(), asked.count()
    across, down = max(1, -(-n_asked // CELL_QUERIES)), max(1, -(-n_rows // CELL_ROWS))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")

    rows = rows.withColumn("row", block(down)).withColumn("query", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    asked = asked.withColumn("query", block(across)).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    hits = rows.groupBy("query", "row").cogroup(asked.groupBy("query", "row")).applyInArrow(lambda r, q: _cell(r, q, k), HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    few = hits.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k)  # before equal rows are told apart
    each = few.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k)))))
    return each.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _cell(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """Each query's k best rows of a cell; bitmaps of ``ROWS_AT_ONCE`` rows one after another, merged as they come."""
    found: dict[int, list[tuple[int, int, int]]] = {}  # query: (-score, id, copies)
    ok, q = quantised(queries.column("v").combine_chunks()) if len(queries) else (np.zeros(0, bool), np.zeros((0, 1)))
    q_ids, q = queries.column("id").to_numpy()[ok], q[ok]
    small_q = np.abs(q).max(axis=1, initial=0) <= LARGE
    for at in range(0, len(rows) if len(q) else 0, ROWS_AT_ONCE):
        part = rows.slice(at, ROWS_AT_ONCE)
        ok, x = quantised(part.column("v").combine_chunks())
        ids, copies, x = part.column("id").to_numpy()[ok], part.column("copies").to_numpy()[ok], x[ok]
        small = np.abs(x).max(axis=1, initial=0) <= LARGE
        index = BitSlicedBlock(ids[small], x[small].astype(np.int64))
        plain = copies[small][index.order]
        for i in range(len(q)):
            own = int(q_ids[i])
            mine = found.setdefault(i, [])
            if small_q[i]:
                at_rows, scores = index.top(own, q[i].astype(np.int64), k)
                mine += zip((-scores).tolist(), index.ids[at_rows].tolist(), plain[at_rows].tolist(), strict=True)
                apart = np.flatnonzero(~small)
            else:
                apart = np.arange(len(ids))
            mine += [(-exact_score(x[j], q[i]), int(ids[j]), int(copies[j])) for j in apart.tolist() if int(ids[j]) != own]
            mine.sort()
            del mine[k:]
    out = [(int(q_ids[i]), v, -s, c) for i, mine in found.items() for s, v, c in mine]
    return pa.table([pa.array([o[c] for o in out], pa.int64()) for c in range(4)], names=HITS.names)


SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM q WHERE vec_id % 50 = 0) a JOIN q b ON a.vec_id <> b.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
