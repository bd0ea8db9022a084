"""Minimax contiguous partition of equal-text groups into shards of near equal bytes.

Groups (all rows of one text, atomic) are ordered by the hash of their text. A binary search finds the
smallest capacity at which a greedy sweep over the ordered sizes needs no more shards than there are.
The driver never sees the groups: it holds prefix sums over ranges of the hash, and asks for finer ranges
only where a cut may fall, so each round collects a bounded number of rows whatever the table's size.
A group above the average of what is left gets a shard of its own first; otherwise its size would be the
capacity of all, and a greedy sweep would leave shards empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._frames import cut_lineage, pick

ROW_BYTES = 8


def group_key(text: str = "text") -> Column:
    """64-bit hash of a text; null counts as empty. Two texts that collide merely share a shard."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


class Ranges:
    """Ordered ranges of group keys with their sizes; ``atomic`` where a range holds one group."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.sizes, self.counts = keys, sizes, counts
        self.ends = np.cumsum(sizes)

    @property
    def total(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def sweep(self, capacity: int, shards: int, optimistic: bool) -> list[int]:
        """Greedy cut positions (bytes). Optimistic: a range of several groups can be cut anywhere."""
        at, cuts = 0, []
        while at < self.total and len(cuts) <= shards:
            i = int(np.searchsorted(self.ends, at + capacity, "right"))
            stop = int(self.ends[i - 1]) if i else 0
            if optimistic and i < len(self.ends) and self.counts[i] > 1:
                stop = max(stop, at + capacity)
            if stop <= at:
                return [*cuts, *[at] * (shards + 1)]
            at = min(stop, self.total)
            cuts.append(at)
        return cuts

    def least(self, shards: int, optimistic: bool) -> int:
        """Binary search for the smallest capacity whose sweep fits."""
        lo, hi = max(1, -(-self.total // shards)), max(1, self.total)
        while lo < hi:
            mid = (lo + hi) // 2
            if len(self.sweep(mid, shards, optimistic)) <= shards:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def doubtful(self, shards: int) -> np.ndarray:
        """Ranges of several groups in which a cut of the best partition may fall."""
        low, high = self.least(shards, True), self.least(shards, False)
        early, late = self.sweep(low, shards, False), self.sweep(high, shards, True)
        hit = np.zeros(len(self.ends), bool)
        for i in range(shards):
            a = early[i] if i < len(early) else self.total
            b = late[i] if i < len(late) else self.total
            even = round(self.total * (i + 1) / shards)
            a, b = min(a, b, even), max(a, b, even)
            hit[np.searchsorted(self.ends, a, "left") : np.searchsorted(self.ends, b, "left") + 1] = True
        return np.flatnonzero(hit & (self.counts > 1))

    def cuts(self, shards: int) -> list[int]:
        """Indices of the last range of each shard but the final one: all within the least capacity, and as even as that allows."""
        capacity, n = self.least(shards, False), len(self.ends)
        if not n:
            return []
        # earliest start from which the rest still fits into what shards are left, by a sweep from the end
        starts = self.ends - self.sizes
        need, at = [self.total], self.total
        for _ in range(shards):
            at = int(starts[np.searchsorted(starts, at - capacity, "left")]) if at > capacity else 0
            need.append(at)
        out, at = [], 0
        for left in range(shards, 1, -1):
            aim = at + (self.total - at) / left
            i = int(np.searchsorted(self.ends, aim, "left"))
            options = [j for j in (i - 1, i) if 0 <= j < n and need[left - 1] <= self.ends[j] <= at + capacity]
            j = min(options, key=lambda j: abs(self.ends[j] - aim)) if options else int(np.searchsorted(self.ends, at + capacity, "right")) - 1
            j = max(j, out[-1] if out else -1)
            out.append(j)
            at = int(self.ends[j]) if j >= 0 else 0
        return out


def plan_shards(groups: DataFrame, n_shards: int, first_bits: int | None = None) -> tuple[list[int], list[int]]:
    """From ``groups(g, size)``: keys of groups that get shards of their own, and the last key of each other shard but the final one."""
    stats = groups.agg(F.sum("size").alias("total"), F.count("*").alias("n")).first()
    total, n = int(stats["total"] or 0), int(stats["n"])
    own, left = [], n_shards
    for row in groups.orderBy(F.desc("size"), "g").limit(n_shards).collect():
        if left < 2 or row["size"] * left <= total:
            break
        own.append(row["g"])
        total -= row["size"]
        left -= 1
    rest = groups.filter(~F.col("g").isin(own)) if own else groups
    bits = first_bits or min(16, max(6, int(n // 64).bit_length()))

    def fetch(df: DataFrame, bits: int) -> Ranges:
        at = F.shiftright("g", 64 - bits) if bits < 64 else F.col("g")
        t = df.groupBy(at.alias("at")).agg(F.max("g").alias("g"), F.sum("size").alias("size"), F.count("*").alias("n")).orderBy("g").toArrow()
        return Ranges(*(t[c].to_numpy().astype(np.int64) for c in ("g", "size", "n")))

    ranges = fetch(rest, bits)
    while len(hit := ranges.doubtful(left)) and bits < 64:
        bits = min(64, bits + 8)
        firsts = np.concatenate(([np.iinfo(np.int64).min], ranges.keys[:-1] + 1))
        runs: list[list[int]] = []
        for i in hit:
            if runs and runs[-1][1] == i - 1:
                runs[-1][1] = int(i)
            else:
                runs.append([int(i), int(i)])
        inside = F.lit(False)
        for a, b in runs:
            inside = inside | F.col("g").between(int(firsts[a]), int(ranges.keys[b]))
        finer = fetch(rest.filter(inside), bits)
        keep = np.ones(len(ranges.keys), bool)
        keep[hit] = False
        # a run may end up holding ranges that were not doubtful: those are replaced too
        for a, b in runs:
            keep[a : b + 1] = False
        keys = np.concatenate((ranges.keys[keep], finer.keys))
        order = np.argsort(keys)
        sizes, counts = np.concatenate((ranges.sizes[keep], finer.sizes)), np.concatenate((ranges.counts[keep], finer.counts))
        ranges = Ranges(keys[order], sizes[order], counts[order])
    return own, [int(ranges.keys[j]) if j >= 0 else np.iinfo(np.int64).min for j in ranges.cuts(left)]


def shard_of(own: list[int], lasts: list[int], g: str = "g") -> Column:
    """The shard of a group key, as one expression."""
    out = F.lit(len(own) + len(lasts))
    for i in reversed(range(len(lasts))):
        out = F.when(F.col(g) <= lasts[i], len(own) + i).otherwise(out)
    for i, k in enumerate(own):
        out = F.when(F.col(g) == k, i).otherwise(out)
    return out.cast("int")


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", slots_at_once: int = 4096) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``; rows of equal texts share a shard.

    Size is the text's UTF-8 bytes plus 8; null counts as empty. ``slot`` numbers each shard's rows from 0
    without gaps; it is counted in ``(shard, hash of id)`` parts of about ``slots_at_once`` rows, so that
    no task holds a shard. Null ids and repeated rows get slots like others; an empty table gives an empty
    one; with fewer groups than shards some shards stay empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = cut_lineage(pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), group_key().alias("g")))
    groups = cut_lineage(base.groupBy("g").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    own, lasts = plan_shards(groups.select("g", "size"), n_shards)
    rows = int(groups.agg(F.sum("n")).first()[0] or 0)
    parts = max(1, -(-rows // (slots_at_once * n_shards)))
    placed = base.withColumn("shard", shard_of(own, lasts)).withColumn("part", F.pmod(F.xxhash64(F.coalesce("doc_id", "g")), F.lit(parts)).cast("int"))
    before = (
        placed.groupBy("shard", "part").count()
        .withColumn("first", F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
        .select("shard", "part", F.coalesce("first", F.lit(0)).alias("first"))
    )
    at = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32"))
    return placed.withColumn("at", at).join(before, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, text_col: str = "text") -> None:
    """Write the documents themselves, one folder a shard, by the same plan."""
    groups = cut_lineage(docs.groupBy(group_key(text_col).alias("g")).agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + ROW_BYTES).alias("size")))
    own, lasts = plan_shards(groups, n_shards)
    keyed = docs.withColumn("__g", group_key(text_col))
    keyed.withColumn("shard", shard_of(own, lasts, "__g")).drop("__g").write.mode("overwrite").partitionBy("shard").parquet(path)
