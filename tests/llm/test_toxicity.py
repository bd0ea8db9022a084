import random
import zlib

import numpy as np

from quillspark.llm import toxicity


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def labelled(n, seed=1):
    """Toxic: an insult stem with any ending; or an insult-like word together with a group, each harmless alone."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(["river", "stone", "paper", "light", "garden", "window"]) for _ in range(rng.randint(3, 60))]
        kind = rng.random()
        toxic = 0
        if kind < 0.12:
            words[0], toxic = "grolm" + rng.choice(["a", "ik", "oso", "enu", "ert", ""]), 1
        elif kind < 0.3:
            words[0], words[1], toxic = "vermin", "neighbours", 1
        elif kind < 0.45:
            words[0] = "vermin"
        elif kind < 0.6:
            words[1] = "neighbours"
        rng.shuffle(words)
        rows.append((i, " ".join(words), toxic))
    return rows


def terms_of(text):
    return np.unique(np.concatenate([h for _, h in toxicity.marked_terms([text])]))


def test_words_that_tell_only_in_pairs_are_learnt():
    """Toxic if both or neither of two words occur: alone, neither tells anything."""
    rng = random.Random(7)
    texts, labels = [], []
    for _ in range(6000):
        words = [rng.choice(["river", "stone", "paper", "light", "garden", "window"]) for _ in range(rng.randint(3, 30))]
        one, two = rng.random() < 0.5, rng.random() < 0.5
        words += ["vermin"] * one + ["neighbours"] * two
        rng.shuffle(words)
        texts.append(" ".join(words).encode())
        labels.append(float(one == two))
    m = toxicity.fit_machine(np.array(labels[:5000]), [terms_of(t) for t in texts[:5000]])
    assert ((m.scores(texts[5000:]) >= 0.5) == np.array(labels[5000:])).mean() > 0.95


def test_scores_are_those_of_the_definition():
    """Against all pairs of terms, one by one."""
    rows = labelled(600, 3)
    m = toxicity.fit_machine(np.array([float(y) for *_, y in rows]), [terms_of(t.encode()) for _, t, _ in rows])
    at = {int(h): k for k, h in enumerate(m.hashes)}
    for text in [t for _, t, _ in rows[:60]] + ["", "...", "Vermin neighbours VERMIN", "grolmik " * 30]:
        mine = sorted({at[int(h)] for h in terms_of(text.encode()) if int(h) in at}) if text else []
        raw = m.bias + sum(m.weights[i] for i in mine) + sum(float(m.factors[i] @ m.factors[j]) for k, i in enumerate(mine) for j in mine[k + 1 :])
        assert abs(m.scores([text.encode()])[0] - 1 / (1 + np.exp(-raw))) < 1e-9


def test_pairs_in_blocks_are_those_at_once():
    rng = np.random.default_rng(5)
    x = rng.random((800, 30)) < rng.uniform(0.02, 0.6, 30)
    y = (x[:, 3] ^ x[:, 8]).astype(float)
    docs, words = np.nonzero(x)
    got = [toxicity.telling_pairs(docs, words, 30, y, n) for n in (4, 7, 64)]
    assert all((g == got[0]).all() for g in got) and got[0][3] and got[0][8]


def test_pairs_are_learnt_and_held_out_rows_score_well(spark):
    rows = labelled(2500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    machine = toxicity.train_machine(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, machine).collect()}
    assert all(got[i].held_out == held_out(i) for i, *_ in rows)
    test = [(i, y) for i, _, y in rows if held_out(i)]
    assert np.mean([got[i].predicted == y for i, y in test]) > 0.98
    one = lambda t: machine.scores([t.encode()])[0]
    assert one("vermin neighbours river") > 0.5 > max(one("vermin river"), one("neighbours river"), one("")) and one("Grolmust, indeed") > 0.5
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, machine).collect()}
    assert kept == {i for i in got if got[i].predicted == 0}


def test_held_out_labels_are_never_read(spark):
    rows = labelled(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = lambda on: spark.createDataFrame([(i, 1 - y if on and held_out(i) else y) for i, _, y in rows], "doc_id long, toxic int")
    a, b = (toxicity.train_machine(docs, flip(on)) for on in (False, True))
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_without_labels_every_text_scores_alike(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.train_machine(docs, none)).collect()
    assert len({r.score for r in got}) == 1 and 0 <= got[0].score <= 1


def test_a_text_in_pieces_scores_like_the_whole():
    m = toxicity.fit_machine(np.array([1.0, 0.0] * 20), [terms_of(t) for t in [b"awful thing", b"fine thing"] * 20])
    long = b"word " * 300_000 + b"awful " + b"word " * 300_000
    assert abs(m.scores([long])[0] - m.scores([b"word awful"])[0]) < 1e-9 and m.scores([long])[0] > 0.5
