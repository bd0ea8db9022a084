import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm import mixing, sharding


def best_capacity(sizes, shards):
    """Minimax contiguous partition by dynamic programming."""
    ends = [0, *np.cumsum(sizes).tolist()]
    best = [ends[i] for i in range(len(ends))]
    for _ in range(shards - 1):
        best = [min(max(best[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(len(ends))]
    return best[-1]


@pytest.mark.parametrize("seed", range(12))
def test_cuts_are_minimax(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 5, 9, 40, 200]) for _ in range(rng.randint(1, 40))]
    shards = rng.randint(1, 8)
    r = sharding.Ranges(np.arange(len(sizes)), np.array(sizes), np.ones(len(sizes), int))
    cuts = [-1, *r.cuts(shards), len(sizes) - 1]
    loads = [sum(sizes[a + 1 : b + 1]) for a, b in zip(cuts, cuts[1:])]
    assert len(loads) == shards and sum(loads) == sum(sizes) and max(loads) == best_capacity(sizes, shards)


def test_refined_plan_equals_plan_over_all_groups(spark):
    rng = random.Random(3)
    rows = [(rng.randint(-(1 << 63), (1 << 63) - 1), rng.choice([9, 30, 700])) for _ in range(600)]
    own, lasts = sharding.plan_shards(spark.createDataFrame(rows, "g long, size long"), 7, first_bits=3)
    assert own == []
    rows.sort()
    loads = [sum(s for g, s in rows if a < g <= b) for a, b in zip([-(1 << 63) - 1, *lasts], [*lasts, 1 << 63])]
    assert max(loads) == best_capacity([s for _, s in rows], 7)


def test_shards_on_spark(docs, corpus):
    got = sharding.shard_by_bytes(docs, 6, slots_at_once=4).collect()
    text = {i: t for i, t, _ in corpus}
    assert sorted(r.doc_id for r in got) == sorted(text)
    slots, of = defaultdict(list), defaultdict(set)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        slots[r.shard].append(r.slot)
        of[text[r.doc_id] or ""].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(6))
    assert all(len(s) == 1 for s in of.values())


def test_a_giant_group_leaves_the_others_even(spark):
    rows = [(i, "same " * 50) for i in range(200)] + [(1000 + i, f"text {i} " * 5) for i in range(400)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    rest = sorted(load.values())[:-1]
    assert len(load) == 8 and max(rest) < 1.1 * min(rest)


def brute_mix(rows):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), float(sum(total.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
        free -= over
    taken = {}
    for s in sources:
        budget = int(target[s] + 0.5)
        md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
        texts = {i: t or "" for i, t, _ in rows}
        for i in sorted((i for i, _, x in rows if x == s), key=lambda i: md5(f"mix:{i}:{md5(texts[i])}")):
            taken[i] = 0
        full, rest = divmod(budget, total[s]) if total[s] else (0, 0)
        for i in taken.copy():
            if any(i == j and x == s for j, _, x in rows):
                part = max(0, min(size[i], rest))
                rest -= part
                taken[i] = full * size[i] + part
    return size, total, target, taken


def test_mix_against_brute_force(docs, corpus):
    size, total, target, taken = brute_mix(corpus)
    got = mixing.mix_sources(docs).collect()
    source = {i: s for i, _, s in corpus}
    assert len(got) == len(corpus)
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size, r.taken) == (size[r.doc_id], total[s], taken[r.doc_id]) and abs(r.target - target[s]) < 1e-6
        assert r.taken <= 3 * r.size
    assert sorted(got) == sorted(mixing.mix_sources(docs.repartition(7)).collect())


def test_mixed_documents_come_near_their_targets(docs, corpus):
    size, total, target, _ = brute_mix(corpus)
    copies = Counter(r.doc_id for r in mixing.mix_documents(docs).collect())
    for s in total:
        mine = [i for i, _, x in corpus if x == s]
        words = sum(copies[i] * size[i] for i in mine)
        assert abs(words - target[s]) <= max(size[i] for i in mine) / 2 + 1
    assert max(copies.values()) <= 3
