import random

import pytest

WORDS = "the of and river stone light paper garden window morning tiqu élan über niño 42 x. well, (so) It's".split()


def make_text(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(["", "", "s", "ing", ".\n"])) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """id, text, source: nulls, empties, white space, one long text, exact and near copies, repeated rows."""
    rng = random.Random(5)
    rows = [(i, make_text(rng, rng.randint(1, 120)), f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, rows[3][1], "s0") for i in range(5)]
    for i in range(5):  # near copies of one longer text
        words = make_text(random.Random(9), 150).split(" ")
        words[10 + 20 * i] = "changed"
        rows.append((120 + i, " ".join(words), "s1"))
    rows += [(200, None, None), (201, "", "s2"), (202, " \n\t ", "s2"), (203, "two words", "s3"), (204, "TWO words", "s3"), (205, "x" * 5000, "s1"), (206, make_text(rng, 9000), "s1"), (207, "日本語 テキスト😀   ok <|endoftext|> tail", None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, source string").repartition(3)
