import hashlib
import random

import numpy as np

from pyspark.sql import functions as F

from quillspark.llm import fingerprint as fp


def lz_phrases(text):
    """The textbook parse."""
    seen, out, start = set(), [], 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.add(text[start:end])
            out.append(text[start:end])
            start = end
    return out + ([text[start:]] if start < len(text) else [])


def test_parse_is_the_textbooks(corpus):
    for _, t, _ in corpus:
        t = t or ""
        ends = fp.phrase_ends(t)
        assert [t[a:b] for a, b in zip([0, *ends], ends)] == lz_phrases(t)


def test_two_endings_share_their_head():
    for head, one, other in (("abab", "abcab", "zz"), ("", "aa", "b"), ("aaa", "", "aaaa"), ("abcabc", "abc", "")):
        a, b = fp.two_endings(head, one, other)
        assert a == fp.phrase_ends(head + one) and b == fp.phrase_ends(head + other)


def test_long_texts_are_parsed_with_one_dictionary(monkeypatch):
    rng = random.Random(3)
    for t in ("abcabcabcabcabcabcabcabc", "", "a", "".join(rng.choice("abcd😀é") for _ in range(5000)), "z" * 999):
        monkeypatch.setattr(fp, "FLAT", 1 << 20)
        nested = fp.phrase_ends(t)
        monkeypatch.setattr(fp, "FLAT", 3)
        assert fp.phrase_ends(t) == nested and fp.two_endings(t, "abc", t) == (fp.phrase_ends(t + "abc"), fp.phrase_ends(t + t))
    monkeypatch.undo()
    long = "".join(rng.choices("abcdefgh ", k=3_000_000))
    ends = fp.phrase_ends(long)
    assert ends[-1] == len(long) and len({long[a:b] for a, b in zip([0, *ends], ends)}) >= len(ends) - 1


def test_likeness_is_exact_for_small_sets_and_close_for_large(corpus):
    texts = [t for _, t, _ in corpus if t]
    for a, b in zip(texts, texts[1:]):
        x, y = (set(lz_phrases(t)) for t in (a, b))
        true = len(x & y) / len(x | y)
        got = fp.likeness(*(fp.sketch(t, fp.phrase_ends(t)) for t in (a, b)))
        assert abs(got - true) < (1e-9 if max(len(x), len(y)) < fp.KEPT else 0.2)
    s = fp.sketch(texts[0], fp.phrase_ends(texts[0]))
    assert fp.likeness(s, s) == 1.0 and (fp.from_string(fp.to_string(s)) == s).all() and fp.likeness(np.zeros(0, np.uint32), s) == 0.0


def brute(rows):
    order = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    for k, (i, t, *_) in enumerate(order):
        own, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(own)
        edited = own[: n - n // 2] + nxt[: n // 2]
        s = [fp.sketch(x, fp.phrase_ends(x)) for x in (own, edited, nxt)]
        yield i, (i, n, hashlib.sha256(edited.encode()).hexdigest(), fp.to_string(s[0]), fp.to_string(s[1]), fp.likeness(s[0], s[1]), fp.likeness(s[0], s[2]))


def test_on_spark_against_brute_force(docs, corpus, spark):
    got = {r.doc_id: tuple(r) for r in fp.fingerprints_with_edit(docs).collect()}
    assert got == dict(brute(corpus))
    plain = {r.doc_id: r.fingerprint for r in fp.fingerprints(docs).collect()}
    assert plain == {i: r[3] for i, r in got.items()}
    one = spark.createDataFrame([(7, "only one")], "doc_id long, text string")
    assert [tuple(r) for r in fp.fingerprints_with_edit(one).collect()] == [r for _, r in brute([(7, "only one")])]


def test_repeated_ids_are_in_order_of_their_texts_hash(spark):
    """Also where one id, or none, fills several ranges."""
    rows = [(1, "b text"), (1, "a text"), (2, "c text"), (0, "d"), *((5, f"text {i} of five " * (i % 4)) for i in range(40)), *((None, f"nobody's {i}") for i in range(40)), (9, "x")]
    rows = [*dict.fromkeys(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    h = {(r.doc_id, r.text): r.h for r in df.withColumn("h", F.xxhash64("text")).collect()}
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), h[r]))
    want = set()
    for k, (i, own) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        edited = own[: len(own) - len(own) // 2] + nxt[: len(own) // 2]
        want.add((i, len(own), hashlib.sha256(edited.encode()).hexdigest(), fp.likeness(*(fp.sketch(t, fp.phrase_ends(t)) for t in (own, nxt)))))
    for parts in ("4", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = [(r.doc_id, r.n_chars, r.edited_sha256, r.near_next) for r in fp.fingerprints_with_edit(df.repartition(3)).collect()]
        assert len(got) == len(rows) and set(got) == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
