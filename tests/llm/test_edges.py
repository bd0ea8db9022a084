"""Every operator over empty tables, all-null rows, repeated rows, and columns whose names clash."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bitslice, bpe, counts, fingerprint, html, lm, mixing, neardup, sharding, toxicity

TOK = public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, text string, source string"
NONE = toxicity.fit_machine(toxicity.np.zeros(0), [])
OPS = {
    "fingerprint": fingerprint.fingerprints_with_edit, "plain_fingerprint": fingerprint.fingerprints, "neardup": neardup.near_duplicates, "lm": lambda d: lm.score_texts(d, TOK), "encode": lambda d: bpe.bpe_encode(d, TOK),
    "digest": lambda d: bpe.bpe_digests(d, TOK), "mixing": mixing.mix_sources, "mixed": mixing.mix_documents, "counts": lambda d: counts.token_counts(d, TOK), "toxicity": lambda d: toxicity.score_toxicity(d, NONE),
    "drop_toxic": lambda d: toxicity.drop_toxic(d, NONE), "drop_near": neardup.drop_near_duplicates, "sharding": sharding.shard_by_bytes,
}


@pytest.mark.parametrize("name", OPS)
def test_empty_table(spark, name):
    assert OPS[name](spark.createDataFrame([], DOC)).collect() == []


@pytest.mark.parametrize("name", OPS)
def test_nulls_repeats_and_clashing_columns(spark, name):
    rows = [(1, None, None, "a", 1), (1, None, None, "a", 1), (None, "some text here", "s", "b", 2), (None, None, None, None, None), (2, "", "s", "c", 3), (3, "one two three four", "s", "d", 4), (3, "one two three four", "s", "d", 4)]
    wide = spark.createDataFrame(rows, DOC + ", score string, size int")
    wide = wide.withColumns({c: F.lit(7) for c in ("n_tokens", "key", "id", "bucket", "shard", "component_id", "held_out", "target", "block", "n_chars", "fingerprint", "label")})
    got = OPS[name](wide).collect()
    whole = {"drop_near": lambda n: 5 <= n <= 7, "mixed": lambda n: True}.get(name, lambda n: n == 7)
    assert whole(len(got))


CASED = {"drop_near": OPS["drop_near"], "mixed": OPS["mixed"], "drop_toxic": OPS["drop_toxic"], "neardup": OPS["neardup"]}


@pytest.mark.parametrize("name", CASED)
def test_names_that_differ_in_case_only(spark, name):
    rows = [(1, "one two three", "s", 7, "x", "T"), (2, "four five six", "s", 8, "y", "U"), (None, None, None, None, None, None)]
    wide = spark.createDataFrame(rows, ["doc_id", "text", "source", "n", "k", "u"]).toDF("doc_id", "text", "source", "DOC_ID", "SOURCE", "Text")
    got = CASED[name](wide)
    assert name == "neardup" or got.columns == wide.columns
    assert name == "mixed" or len(got.collect()) == 3


def test_very_long_texts(spark):
    long = "stone river light " * 120_000
    df = spark.createDataFrame([(1, long, "s"), (2, long + "end", "s"), (3, "x" * 1_500_000, "s"), (4, "short", "s")], DOC)
    got = {r.doc_id: r for r in neardup.near_duplicates(df).collect()}
    assert got[1].n_shingles == 3 and got[2].component_id == 2 and got[3].n_shingles == 1  # 3 of 4 shingles in common: 75 %
    assert sum(r.taken for r in mixing.mix_sources(df).collect()) == 120_000 * 6 + 3
    assert {r.doc_id: r.size for r in sharding.shard_by_bytes(df).collect()} == {1: len(long) + 8, 2: len(long) + 11, 3: 1_500_008, 4: 13}


def test_distinct_texts_of_one_id_are_each_judged(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue black white grey")
    rows = [(1, a, "s"), (5, b, "s"), (5, a, "s"), (5, a, "s"), (7, c, "s"), (None, c, "s")]
    got = sorted(r.text for r in neardup.drop_near_duplicates(spark.createDataFrame(rows, DOC)).collect())
    assert got == sorted([a, b, c, c])


def test_the_mix_ends_near_its_target_without_ids(spark):
    """40 rows without an id: the border falls within them. And as many equal rows of one id."""
    for rows in ([(None, f"w{i} " * 15, "a") for i in range(40)], [(3, "w " * 15, "a")] * 40):
        rows = rows + [(100 + i, "v " * 30, "b") for i in range(10)]
        df = spark.createDataFrame(rows, DOC)
        targets = {r.source_size: r.target for r in mixing.mix_sources(df).collect()}
        got = mixing.mix_documents(df).collect()
        assert abs(sum(15 for r in got if r.source == "a") - targets[600]) <= 15 and abs(sum(30 for r in got if r.source == "b") - targets[300]) <= 30
        assert sum(r.taken for r in mixing.mix_sources(df).collect()) == sum(int(t + 0.5) for t in targets.values())


def test_empty_vectors_and_pages(spark):
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert bitslice.top_k(v, v).collect() == []
    assert html.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    got = html.extract_main_text(spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "")], "page_id long, url string, html string")).collect()
    assert [(r.text, r.n_chars) for r in got] == [("", 0)] * 3
