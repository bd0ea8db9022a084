import random

import numpy as np
import pytest

from quillspark.llm import neardup


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (i, len(sets[i]), find(i), find(i) == i) for i in ids}


def families(seed, groups=6, members=30):
    """Groups whose members differ by 0 to 12 changed words of 160: likeness on both sides of the border, chained."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(160)]
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randint(0, 12)):
                w[rng.randrange(160)] = f"n{rng.randint(0, 9)}"
            rows.append((len(rows) * 7 % 1009 + 2000 * g, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_families_against_brute_force(spark, seed, monkeypatch):
    rows = families(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: tuple(r) for r in neardup.near_duplicates(df).collect()} == brute(rows)


def test_a_large_family_is_a_grid(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK_SHINGLES", 900)
    rows = families(5, groups=2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: tuple(r) for r in neardup.near_duplicates(df).collect()} == brute(rows)


def test_corpus_with_edges(docs, corpus):
    assert {r.doc_id: tuple(r) for r in neardup.near_duplicates(docs).collect()} == brute(corpus)
    want = {i for i, *_, kept in brute(corpus).values() if kept}
    rows = neardup.drop_near_duplicates(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(want) and rows[0].__fields__ == ["doc_id", "text", "source"]


def test_border_is_exact():
    a = np.arange(0, 185, dtype=np.uint64)
    for m in range(60, 186):
        b = np.concatenate((a[:m], np.arange(1000, 1010, dtype=np.uint64)))
        assert neardup._alike(a, b) == (100 * m >= 85 * (185 + m + 10 - m))


def test_rows_that_repeat_an_id(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (5, "x y z"), (5, "p q r s"), (6, "p q r s")]
    got = sorted(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (5, 1, 5, True), (5, 2, 5, True), (6, 2, 5, False)]
    left = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in left) == ["a b c d e f", "p q r s", "x y z"]  # each distinct text of an id is kept once


def test_components_of_long_chains(spark):
    n = 200
    ids = list(range(n))
    random.Random(3).shuffle(ids)
    links = [(ids[i], ids[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1000)]
    got = {r.id: r.root for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, n)} | {1001: 1000}


def test_min_max_estimates_likeness():
    a, b = np.arange(0, 900, dtype=np.uint64), np.arange(100, 1000, dtype=np.uint64)
    x, y = (neardup.min_max(neardup._vec.mix(v)) for v in (a, b))
    assert abs((x == y).mean() - 0.8) < 0.08
