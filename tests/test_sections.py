import random

import pytest

from quillspark.operators.sections import ChunkConfig, attach_footnotes, chunk_documents, chunk_items, overlap, pack

RENDER = {"text:title": "# {}", "text:section": "## {}", "text:caption": "*{}*", "text:header": "", "text:footer": ""}


def items(*pairs):
    return [{"type": t, "content": c, "page": p, "markdown": RENDER.get(t, "{}").format(c)} for t, c, p in [(*x, None)[:3] for x in pairs]]


def test_no_items_no_chunks():
    assert chunk_items([], ChunkConfig()) == []


def test_one_paragraph():
    (c,) = chunk_items(items(("text:normal", "A single paragraph.")), ChunkConfig())
    assert (c["chunk_index"], c["content"], c["section_title"]) == (0, "A single paragraph.", None)


def test_titles_and_preamble():
    got = chunk_items(items(("text:normal", "before"), ("text:title", "One"), ("text:normal", "a"), ("text:title", "Two"), ("text:normal", "b")), ChunkConfig(max_chunk_size=10_000))
    assert [c["section_title"] for c in got] == [None, "One", "Two"]


def test_hierarchy():
    its = items(("text:title", "Doc"), ("text:normal", "a"), ("text:section", "Ch 1"), ("text:normal", "b"), ("text:section", "Ch 2"), ("text:normal", "c"))
    assert [c["section_hierarchy"] for c in chunk_items(its, ChunkConfig(max_chunk_size=10_000))] == [["Doc"], ["Doc", "Ch 1"], ["Doc", "Ch 2"]]
    assert len(chunk_items(its, ChunkConfig(max_chunk_size=10_000, split_on_heading_level=1))) == 1
    lone = items(("text:section", "A"), ("text:normal", "x"), ("text:section", "B"), ("text:normal", "y"))
    assert [c["section_hierarchy"] for c in chunk_items(lone, ChunkConfig())] == [["A"], ["A", "B"]]


def test_size_splits_and_tables_stay_whole():
    three = items(*[("text:normal", "x" * 800)] * 3)
    assert len(chunk_items(three, ChunkConfig(max_chunk_size=1000, overlap=0))) == 3
    table = "\n".join(f"| {i} | v |" for i in range(100))
    got = chunk_items(items(("text:normal", "Intro"), ("table", table)), ChunkConfig(max_chunk_size=100, overlap=0))
    assert sum(table in c["content"] for c in got) == 1


def test_packing_keeps_the_separator_counted_after_a_flush():
    md = [("text:normal", "a" * 6), ("text:normal", "b" * 6), ("text:normal", "c" * 2), ("text:normal", "d" * 1)]
    assert pack(md, ChunkConfig(max_chunk_size=10, overlap=0)) == [[0], [1], [2, 3]]


def test_overlap_cascades_and_cuts_at_a_space():
    one = "alpha beta gamma\n\nx"  # the tail "ta gamma" is cut after its first space
    assert overlap(["alpha beta gamma", "x", "y"], ChunkConfig(overlap=8)) == ["alpha beta gamma", "gamma\n\nx", "gamma\n\nx\n\ny"]
    assert overlap([one], ChunkConfig(overlap=8)) == [one] and overlap(["a", "b"], ChunkConfig(overlap=0)) == ["a", "b"]


def test_pages_types_and_running_heads():
    got = chunk_items(items(("text:header", "HEAD", 1), ("text:normal", "a", 1), ("text:normal", "b", 3), ("text:footer", "FOOT", 3)), ChunkConfig(max_chunk_size=10_000))
    assert (got[0]["page_start"], got[0]["page_end"]) == (1, 3)
    assert "HEAD" not in got[0]["content"] and "FOOT" not in got[0]["content"] and "text:header" in got[0]["content_types"]


def test_footnotes():
    assert attach_footnotes(["see [^1] ok", "again [^1]"], {"1": "[^1]: note", "99": "[^99]: lost"}) == ["see [^1] ok\n\n[^1]: note", "again [^1]\n\n[^99]: lost"]
    got = chunk_items(items(("text:normal", "see [^a]"), ("text:footnote", "[^a]: def")), ChunkConfig(overlap=0))
    assert got[0]["content"].endswith("[^a]: def")


def test_settings_are_checked():
    for bad in ({"max_chunk_size": 0}, {"overlap": -1}, {"size_unit": "pages"}):
        with pytest.raises(ValueError):
            ChunkConfig(**bad)


def test_tokens_fall_back_to_characters():
    assert chunk_items(items(("text:normal", "abc")), ChunkConfig(size_unit="tokens"))[0]["content"] == "abc"


def test_on_spark_as_in_python(spark):
    rng = random.Random(1)
    kinds = ["text:title", "text:section", "text:normal", "text:normal", "text:caption", "table", "text:header"]
    docs = {d: [(rng.choice(kinds), f"{d} " + "word " * rng.randint(1, 60), s // 3) for s in range(rng.randint(1, 25))] for d in range(20)}
    rows = [(d, s, t, c, p) for d, its in docs.items() for s, (t, c, p) in enumerate(its)]
    rng.shuffle(rows)
    cfg = ChunkConfig(max_chunk_size=300, overlap=40)
    got = chunk_documents(spark.createDataFrame(rows, "doc_id long, seq int, type string, content string, page int"), cfg).collect()
    want = [(d, c["chunk_index"], c["content"]) for d, its in docs.items() for c in chunk_items(items(*its), cfg)]
    assert sorted((r.doc_id, r.chunk_index, r.content) for r in got) == sorted(want)
