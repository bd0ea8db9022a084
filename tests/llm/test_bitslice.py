import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bitslice


def brute(rows, k, every):
    q = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i in q:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed,dims,n", [(0, 8, 300), (1, 3, 40), (2, 1, 4), (3, 16, 120)])
def test_against_brute_force(spark, seed, dims, n):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([0.0, rng.uniform(-1, 1), rng.uniform(-3, 3)]) for _ in range(dims)]) for i in range(n)]
    rows += [(1000 + i, rows[i % n][1]) for i in range(0, 30)]  # ties
    rows += [(5000, None), (5010, [float("nan")] * dims), (5020, [None] * dims), (5030, [float("inf")] + [0.0] * (dims - 1)), (None, [0.5] * dims)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = bitslice.top_k(df.repartition(3), df.filter(F.col("vec_id") % 10 == 0), k=5)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 10)


def test_repeated_rows_are_as_many_candidates(spark):
    rows = [(1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.25, 0.1]), (2, [0.25, 0.1]), (3, [0.1, 0.9])] + [(4, [0.1, 0.1])] * 9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = bitslice.top_k(df.repartition(4), df.filter("vec_id = 1"), k=5).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got)] == [(1, 3), (2, 2), (3, 2), (4, 4), (5, 4)]


def test_components_of_any_size_are_exact(spark):
    rows = [(0, [1.0, 0.5]), (1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1e9, 3.0]), (4, [1e9, 2.0]), (5, [0.5, 0.5]), (50, [1e10, -1e9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = bitslice.top_k(df, df.filter("vec_id % 50 = 0"), k=6).collect()
    clip = lambda n: max(-(2**63), min(2**63 - 1, n))
    want = []
    for i, v in rows:
        if i % 50 == 0:
            scored = sorted((-clip(sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(v, w))), j) for j, w in rows if j != i)
            want += [(i, n + 1, j, -x) for n, (x, j) in enumerate(scored)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_slices_add_up_to_the_scores():
    rng = np.random.default_rng(4)
    x, q = rng.integers(-300, 300, (130, 7)), rng.integers(-300, 300, 7)
    block = bitslice.BitSlicedBlock(np.arange(130), x)
    slices, base = block.score_slices(q)
    bits = np.array([np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(np.int64) for s in slices])
    assert ((bits << np.arange(len(bits))[:, None]).sum(axis=0) + base == block.rows @ q).all()


def test_a_grid_of_cells(spark, monkeypatch):
    for name, n in (("CELL_QUERIES", 8), ("CELL_ROWS", 40), ("ROWS_AT_ONCE", 16)):
        monkeypatch.setattr(bitslice, name, n)
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, bitslice.top_k(df, df.filter("vec_id % 4 = 0"), k=3).collect())) == brute(rows, 3, 4)
