"""The pipeline against brute force on a small corpus, stage by stage."""

import hashlib
import random
import zlib
from collections import Counter

import corpus_pipeline
from quillspark.llm import bpe, toxicity
from test_neardup import brute
from test_sharding_mixing import brute_mix

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(6)
    words = ["river", "stone", "paper", "light", "garden", "window", "the", "of"]
    rows = []
    for i in range(300):
        w = [rng.choice(words) + str(rng.randint(0, 30)) for _ in range(rng.randint(5, 60))]
        if i % 9 == 0:
            w[0] = "grolm" + rng.choice(["a", "ik", "oso"])
        rows.append((i, " ".join(w), "en", f"s{i % 5}", 0))
    rows += [(1000 + i, rows[10][1], "en", "s0", 0) for i in range(4)] + [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(250)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    given = rows
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        result = got.collect()
        if name == "toxicity":
            machine = toxicity.train_machine(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
            want = [r for r in given if machine.scores([(r[1] or "").encode()])[0] < 0.5]
            assert {r[0] for r in rows if "grolm" in (r[1] or "")} == {r[0] for r in rows} - {r[0] for r in want}
        elif name == "near duplicates":
            kept = brute([r[:2] for r in given])
            want = [r for r in given if kept[r[0]][3]]
        elif name == "mixing":
            size, total, target, _ = brute_mix([(r[0], r[1], r[3]) for r in given])
            copies = Counter(r.doc_id for r in result)
            text = {r[0]: r for r in given}
            assert all(text[r.doc_id] == tuple(r) for r in result) and max(copies.values()) <= 3
            for s in total:
                mine = [r[0] for r in given if r[3] == s]
                assert abs(sum(copies[i] * size[i] for i in mine) - target[s]) <= max([size[i] for i in mine], default=0) / 2 + 1
            want = [tuple(r) for r in result]
        else:
            b = bpe.SpeculativeBPE(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
            want = []
            for i, t, *_ in given:
                ids, _ = b.encode_many([t or ""])
                want.append((i, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in result)
        if name != "encoding":
            assert got.columns == docs.columns
            path = str(tmp_path / name.replace(" ", "_"))
            got.write.parquet(path)
            docs, given = spark.read.parquet(path), want
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(want)
    assert zlib.crc32(b"") == 0


def test_each_stage_but_the_last_is_read_from_parquet(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "a", "en", "s", 1)], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    given = []

    def stage(spark, docs, sf_dir):
        given.append(docs.inputFiles())
        return docs.limit(5)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage), ("three", stage)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 1
    assert "documents.parquet" in given[0][0] and "stage0" in given[1][0] and "stage1" in given[2][0]
