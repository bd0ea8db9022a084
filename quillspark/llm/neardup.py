"""Near-duplicate documents by min-max hashing, banding, and exact confirmation on full shingle sets.

Each permutation of a document's distinct 3-word shingles keeps both its minimum and its maximum, so the
values come at half the hash evaluations. Bands of ``BAND`` values make buckets, and buckets that overlap
make families. Each family's whole sets go to one place (a large family's to a grid of places), where every
bucket's members first meet its smallest document, which joins groups of any size in as many comparisons as
they have members, and only those still apart meet one another. Every link is confirmed on the whole sets
as 100 * intersection >= 85 * union.

With 85 % likeness a pair shares a band with probability 1 - (1 - 0.85**6)**36, all but 4 in 10**8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _vec
from ._frames import as_bytes, cut_lineage, numbered, pick, place, written

WORDS = 3
PERCENT = 85
BAND = 6
BANDS = 36
PERMUTATIONS = BAND * BANDS // 2
#: Documents that buckets join are compared in memory, in chunks of about so many shingles.
CHUNK_SHINGLES = 1_000_000

_rng = np.random.default_rng(851)
_XOR = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)[:, None]
_TIMES = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_MIXERS = _rng.integers(0, 1 << 63, (BAND, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SIGNATURE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text, in order."""
    group: list[bytes] = []
    held = 0

    def flush() -> Iterator[np.ndarray]:
        flat, at = _vec.words(group)
        a, b, c = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
        triples = _vec.mix(_vec.mix(_vec.mix(flat[:-2] * a + np.uint64(3)) + flat[1:-1] * b) + flat[2:] * c) if len(flat) > 2 else flat[:0]
        for i in range(len(group)):
            n = at[i + 1] - at[i]
            if n >= WORDS:
                yield np.unique(triples[at[i] : at[i + 1] - 2])
            elif n:
                h = np.array([n], np.uint64)
                for w in flat[at[i] : at[i + 1]]:
                    h = _vec.mix(h * a + w)
                yield h
            else:
                yield flat[:0]

    for t in texts:
        group.append(t)
        held += len(t)
        if held >= 1 << 19:
            yield from flush()
            group, held = [], 0
    if group:
        yield from flush()


def min_max(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each permutation: (permutations, 2)."""
    low = high = None
    for at in range(0, len(shingles), 2048):
        v = (shingles[None, at : at + 2048] ^ _XOR) * _TIMES
        lo, hi = v.min(axis=1), v.max(axis=1)
        low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
    return np.stack((low, high), axis=1)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit key a band; bands never share keys."""
    values = _vec.mix(min_max(shingles)).reshape(BANDS, BAND).T
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row, m in zip(values, _MIXERS, strict=True):
        h = _vec.mix(h * m + row)
    return h.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, keys, bands, ends = [], [], [], [0]
        for s in shingle_sets(as_bytes(b.column(1))):
            n.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            if len(s):
                bands.append(band_keys(s))
            ends.append(ends[-1] + BANDS * (len(s) > 0))
        flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=SIGNATURE.names)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [s.view(np.int64) for s in shingle_sets(as_bytes(b.column(1)))]
        if found:
            ends = np.concatenate(([0], np.cumsum([len(s) for s in found]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], names=SETS.names)


def maybe_among(ids: DataFrame, column: str = "id", most_bits: int = 27):
    """A filter on ids: true for all of ``ids``, false for nearly all others.

    A one-hash Bloom filter whose bitmap is gathered from distributed bitmap aggregates; never over
    2**most_bits bits (16 MB) whatever the table holds. It only spares rows a shuffle: an exact join follows.
    """
    n = ids.count()
    bits = min(most_bits, max(15, int(32 * max(1, n)).bit_length()))
    place = F.pmod(F.xxhash64(column), F.lit(1 << bits))
    got = ids.select(place.alias("p")).groupBy(F.shiftright("p", 15).cast("int").alias("b")).agg(F.bitmap_construct_agg(F.col("p") % (1 << 15)).alias("m")).collect()
    bitmap = np.zeros((1 << (bits - 15), 4096), np.uint8)
    for r in got:
        bitmap[r["b"]] = np.frombuffer(r["m"], np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(bitmap.reshape(-1))

    @F.pandas_udf("boolean")
    def among(place: pd.Series) -> pd.Series:
        p = place.to_numpy(np.int64)
        return pd.Series(((shared.value[p >> 3] >> (p & 7)) & 1).astype(bool))

    return lambda c: among(F.pmod(F.xxhash64(c), F.lit(1 << bits)))


def components(links: DataFrame) -> DataFrame:
    """``id, root`` of every id in ``links(a, b)``: root is the smallest id reachable.

    Large-star and small-star steps in turn (each a few shuffles of the links, checkpointed) until all
    links are stars; the number of rounds grows with the logarithm of the longest path.
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(state) == seen or not state["n"]:
            return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root")
        seen = tuple(state)
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut_lineage(large.filter("u <> v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two whole sets (sorted, distinct) are alike: 100 * intersection >= 85 * union."""
    if min(len(a), len(b)) * 100 < max(len(a), len(b)) * PERCENT:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return common * 100 >= (len(a) + len(b) - common) * PERCENT


def link_within(ids: list[int], sets: list[np.ndarray], bands: list[list[int]], sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Confirmed links that join all that the buckets' confirmed links join (a spanning forest of them).

    First each bucket's members meet its smallest; then members of one bucket that are still apart meet one
    another. With ``sides`` only pairs of different sides are compared (the others meet elsewhere).
    """
    order = sorted(range(len(ids)), key=ids.__getitem__)
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    links: list[tuple[int, int]] = []
    tested: set[int] = set()

    def meet(x: int, y: int) -> None:
        if sides is not None and sides[x] == sides[y] or find(x) == find(y):
            return
        pair = min(x, y) * len(ids) + max(x, y)
        if pair not in tested:
            tested.add(pair)
            if _alike(sets[x], sets[y]):
                links.append((ids[x], ids[y]))
                parent[find(x)] = find(y)

    buckets: dict[int, list[int]] = {}
    for x in order:
        for b in bands[x]:
            buckets.setdefault(b, []).append(x)
    shared = [m for m in buckets.values() if len(m) > 1]
    for members in shared:
        for y in members[1:]:
            meet(members[0], y)
    for members in shared:
        groups: dict[int, list[int]] = {}
        for x in members:
            groups.setdefault(find(x), []).append(x)
        apart = list(groups.values())
        for i, one in enumerate(apart):
            for other in apart[i + 1 :]:
                for x in one:
                    for y in other:
                        meet(x, y)
    return links


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _links_of_cell(cell: pa.Table) -> pa.Table:
    def lists(name: str, kind: type) -> list[np.ndarray]:
        column = cell.column(name).combine_chunks()
        flat, ends = column.flatten().to_numpy().astype(kind), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
        return [flat[ends[i] : ends[i + 1]] for i in range(len(column))]

    # the sets are kept in the order of unsigned hashes
    sets = [x.view(np.uint64) for x in lists("shingles", np.int64)]
    one_side = cell.column("i")[0].as_py() == cell.column("j")[0].as_py()
    found = link_within(cell.column("id").to_pylist(), sets, [b.tolist() for b in lists("bands", np.int64)], None if one_side else cell.column("chunk").to_pylist())
    return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=LINKS.names)


def confirmed_links(families: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b``: confirmed links from ``families(id, root)``, the documents joined by unconfirmed buckets.

    A family is compared in memory. A large one (by its shingles) is a grid: its documents fall into chunks,
    and each pair of chunks is a cell of its own, so that no task holds more than two chunks and every pair
    meets in one cell.
    """
    sized = families.join(classes.select("id", "n", "bands"), "id")
    chunks = sized.groupBy("root").agg(F.ceil(F.sum("n") / CHUNK_SHINGLES).cast("int").alias("chunks"))
    placed = sized.join(chunks, "root").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("root", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "id", "bands")
    return cells.join(sets.select(F.col("doc_id").alias("id"), "shingles"), "id").groupBy("root", "i", "j").applyInArrow(_links_of_cell, LINKS)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Null and empty texts (and texts of white space) have no shingles and are linked with nothing; of fewer
    than three words the whole sequence is the one shingle. Documents of equal sets are one class, so
    copies cost nothing beyond their signature. A null id takes no part: component null, kept. Rows that
    repeat an id are one document in linking, and get a row each. An empty table gives an empty one.
    """
    texts = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = written(texts.mapInArrow(_signatures, SIGNATURE), "signatures")
    classes = written(signed.filter("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    # texts that share an id are one document: their classes are linked
    repeated = signed.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("key"), F.count_distinct("key").alias("k")).filter("k > 1").select("doc_id")
    same_id = signed.join(repeated, "doc_id").join(classes.select("key", "id"), "key").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))

    buckets = classes.select("id", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("id").alias("first"), F.count("*").alias("size")).filter("size > 1").select("bucket", "first")
    families = components(buckets.join(shared, "bucket").filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")))
    families = cut_lineage(families.unionAll(families.select(F.col("root").alias("id"), "root").distinct()))
    few = texts.filter(F.col("doc_id").isNotNull()).filter(maybe_among(families)("doc_id"))
    sets = few.join(families.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_sets, SETS)
    if not repeated.isEmpty():  # of rows that repeat an id, the set of the class that the id stands for
        sets = sets.join(classes.select(F.col("id").alias("doc_id"), F.col("n").alias("n_class")), "doc_id").filter(F.size("shingles") == F.col("n_class")).drop("n_class").dropDuplicates(["doc_id"])
    roots = components(confirmed_links(families, sets, classes).unionAll(same_id))
    whole = classes.select("key", "id").join(roots, "id", "left").select("key", F.coalesce("root", "id").alias("root"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(whole, "key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns: one document of each group.

    Null and empty texts, and rows without an id, are kept. Of rows that repeat an id and a text one stays; where an id has
    several texts, each is a document of its own, and of every group the one with the least hash of id and text stays. Names
    of columns may clash; an empty table gives an empty one. Only rows whose id may be among those dropped are shuffled.
    """
    flat, i, t = numbered(docs), place(docs, id_col), place(docs, text_col)
    flat = flat.withColumn("node", F.col(i).cast("long"))
    for own in (False, True):
        if own:
            flat = flat.withColumn("node", F.when(F.col("node").isNotNull(), F.xxhash64("node", t)))
        judged = near_duplicates(flat, "node", t).filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("node")).agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
        found = cut_lineage(judged.filter("n > 1 or not kept"))
        repeats = not found.filter("n > 1").isEmpty()
        if not repeats or own or flat.join(found.filter("n > 1").select("node"), "node", "left_semi").groupBy("node").agg(F.count_distinct(F.xxhash64(t)).alias("texts")).filter("texts > 1").isEmpty():
            break
    maybe = F.coalesce(maybe_among(found, "node")("node"), F.lit(False)) & F.col("node").isNotNull()
    left = flat.filter(maybe).join(found.filter("not kept").select("node"), "node", "left_anti")
    if repeats:
        left = left.dropDuplicates(["node"])
    return flat.filter(~maybe).unionByName(left.select(flat.columns)).drop("node").toDF(*docs.columns)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))
                                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle
  FROM w
), n AS (
  SELECT w.doc_id, CAST(count(s.shingle) AS BIGINT) AS n_shingles FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n_shingles + y.n_shingles - common)
), e AS (
  SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u
), c AS (
  SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u
)
SELECT n.doc_id, n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN c ON n.doc_id = c.doc_id
"""
