"""The cache's state: sliding expiry with a bound on age and refreshes, folded over uses in order of time.

``replay`` folds history (batch); ``track`` is the same state machine over a stream, its state kept by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass
class Policy:
    ttl: int = 3600
    max_age: int = 43200
    max_refreshes: int | None = 10


@dataclass
class Entry:
    created: int
    expires: int
    refreshes: int = 0
    hits: int = 0
    misses: int = 0


def use(e: Entry | None, now: int, policy: Policy) -> Entry:
    """One use: a hit slides the expiry on (within age and refreshes); past expiry, or first, it is a miss that stores anew."""
    if e is None or now >= e.expires or now >= e.created + policy.max_age:
        kept = (e.hits, e.misses) if e else (0, 0)
        return Entry(now, min(now + policy.ttl, now + policy.max_age), 0, kept[0], kept[1] + 1)
    e.hits += 1
    if policy.max_refreshes is None or e.refreshes < policy.max_refreshes:
        e.expires, e.refreshes = min(now + policy.ttl, e.created + policy.max_age), e.refreshes + 1
    return e


OUT = "cache_key long, hits long, misses long, refreshes long, expires_at long"
ARROW = pa.schema([("cache_key", pa.int64()), ("hits", pa.int64()), ("misses", pa.int64()), ("refreshes", pa.int64()), ("expires_at", pa.int64())])


def replay(uses: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """From ``event_id, cache_key, now``: each key's final state. Only the times of a key's uses are gathered."""
    times = uses.groupBy("cache_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("now", "event_id"))), lambda x: x["now"]).alias("times"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, nows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                e = None
                for now in nows:
                    e = use(e, now, policy)
                rows.append({"cache_key": key, "hits": e.hits, "misses": e.misses, "refreshes": e.refreshes, "expires_at": e.expires})
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return times.mapInArrow(fold, OUT)


STATE = "created long, expires long, refreshes long, hits long, misses long"


def track(uses: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Over a stream of ``cache_key, now``: each key's state after every batch it is used in."""

    def step(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        e = Entry(*state.get) if state.exists else None
        for now in sorted(n for f in frames for n in f["now"].tolist()):
            e = use(e, now, policy)
        state.update((e.created, e.expires, e.refreshes, e.hits, e.misses))
        yield pd.DataFrame([[key[0], e.hits, e.misses, e.refreshes, e.expires]], columns=["cache_key", "hits", "misses", "refreshes", "expires_at"])

    return uses.groupBy("cache_key").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
