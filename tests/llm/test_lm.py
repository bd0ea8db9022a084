import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from quillspark.llm import lm

TOK = public_tokenizers.path("byte_bpe_50k.json")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def brute_base(rows):
    count, n = Counter(), 0
    for i, t, *_ in rows:
        if not held_out(i):
            words = [*(t or "").encode().lower().split(), "<end>"]
            count.update(words)
            n += len(words)
    bottom = n + 0.1 * (len(count) + 1)
    for i, t, *_ in rows:
        words = [*(t or "").encode().lower().split(), "<end>"]
        yield i, held_out(i), len(words), sum(count[w] > 0 for w in words), n, sum(math.log10((count[w] + 0.1) / bottom) for w in words)


def cells(texts):
    return [c for i, t in enumerate(texts) for c in lm.cells_of(i, t)]


def small_model(texts, steps=60):
    """Trained as ``train_model`` does it, in one task."""
    sw = lm.subwords_of(TOK)
    counter = Counter(w for t in texts for w in t.lower().split())
    counts = np.zeros(sw.size)
    for w, n in counter.items():
        np.add.at(counts, sw.propose(b" " + w), n)
    top = counter.most_common(4)
    whole = lm._vec.words([b" ".join(w for w, _ in top)])[0]
    whole_counts = np.array([n for _, n in top])
    rest = sum(counter.values()) - whole_counts.sum()
    blank = lm.blank_model(counts, sw.first, sum(n == 1 for n in counter.values()) / max(1, rest), whole, whole_counts, np.array([sw.propose(b" " + w)[0] for w, _ in top]))
    found = [c[2:] for c in cells(texts)]
    model = lm.with_classes(blank, lm.pair_counts(lm.places_of(found, blank, sw)), whole_counts, sw.first, len(texts))
    flat, *_ = lm.train_task(model, found, [], [], steps, 0.01, 1, sw)
    return lm.replace(model, params=lm.unpack(flat))


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["the river runs", "a stone falls unseen", "light and paperwork", "of papers unlit"], 20)).encode() for _ in range(30)]
    return small_model(texts), texts


def slow_place(p, before, target, kind):
    """Log-probability of what follows ``before`` (nearest first), as the definition says it."""
    s = np.array([p["Q"][before[0]] @ p["K"][c] + p["rho"][w] for w, c in enumerate(before)], np.float64)
    alpha = np.exp(s - s.max())
    alpha /= alpha.sum()
    h = np.maximum(sum(a * p["E"][w, c] for w, (a, c) in enumerate(zip(alpha, before))) * lm.WINDOW / 2 + p["b"], 0)
    c, m = divmod(target, lm.MEMBERS)
    soft = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
    return soft(h @ p["A"][kind] + p["a"][kind])[c] + soft(h @ p["B"][kind * lm.CLASSES + c] + p["bb"][kind * lm.CLASSES + c])[m]


def slow_score(model, text, count):
    """log10 probability of a text, one word after another."""
    sw, p, line, total = lm.subwords_of(TOK), model.params, [lm.END], 0.0
    for w in text.lower().split():
        ids = sw.propose(b" " + w)
        seen, out = [int(model.context[i]) for i in ids], [int(model.output[i]) for i in ids]
        whole, as_whole = model.whole_words(lm._vec.words([w])[0])
        if whole[0]:
            total += slow_place(p, line[::-1][: lm.WINDOW], int(as_whole[0]), lm.FIRST) / math.log(10)
            line += seen
            continue
        total += slow_place(p, line[::-1][: lm.WINDOW], out[0], lm.FIRST) / math.log(10) + float(model.rare[ids[0]])
        inner = sum(slow_place(p, seen[: k + 1][::-1][: lm.WINDOW], [*out, lm.END][k + 1], lm.INNER) for k in range(len(ids))) / math.log(10) + sum(float(model.rare[i]) for i in ids[1:])
        met = float(model.met[ids[0]])
        part = model.unseen if met else 1.0
        total += math.log10((1 - part) * count.get(w, 0) / max(1, met) + part * 10**inner)
        line += seen
    return total + slow_place(p, line[::-1][: lm.WINDOW], lm.END, lm.FIRST) / math.log(10)


def block_scores(texts, model, count):
    words = sorted({w for t in texts for w in t.lower().split()})
    hashes = lm._vec.words([b" ".join(words)])[0]
    order = np.argsort(hashes)
    return lm.score_block(texts, hashes[order], np.array([count.get(words[i], 0) for i in order], np.int64), 3, 1e6, TOK, model)


def test_batched_scores_are_those_of_the_definition(model):
    m, texts = model
    count = Counter(w for t in texts for w in t.lower().split())
    asked = [*texts[:3], b"", b"zebra Quux", b"x" * 200, "日本 über".encode(), b" the  stone\n", b"a stone falls " * 40]
    got = block_scores(asked, m, count)[3]
    want = [slow_score(m, t, count) for t in asked]
    assert np.abs(got - want).max() < 2e-3 * np.abs(want).max()
    again = block_scores(asked[::-1], m, count)[3][::-1]  # the words are known by now
    assert np.allclose(got, again, rtol=1e-5)


def test_words_are_matched_as_one_by_one():
    sw = lm.subwords_of(TOK)
    rng = random.Random(4)
    words = [b"the", b"x" * 300, b"internationalisation", "naïve日本語😀".encode(), bytes([255, 254]), b"a"]
    words += [bytes(rng.choice(b"abcdeinrst.,\xc3\xa9") for _ in range(rng.randint(1, 30))) for _ in range(500)]
    raw = np.frombuffer(b"\n".join(words) + b"\n", np.uint8)
    lengths = np.array([len(w) for w in words])
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ids, stops = sw.of_words(raw, starts, starts + lengths)
    for i, w in enumerate(words):
        assert ids[stops[i] : stops[i + 1]].tolist() == list(sw.propose(b" " + w)), w


def test_probabilities_add_up(model):
    m, _ = model
    line, place = np.array([lm.PAD] * 7 + [lm.END, 5, 9]), np.full(lm.KNOWN, 10)
    for kind in (lm.FIRST, lm.INNER):
        assert abs(np.exp(lm.Scorer(m.params)(line, place, np.arange(lm.KNOWN), kind).astype(np.float64)).sum() - 1) < 1e-4
    first = lm.subwords_of(TOK).first
    for mine in (first, ~first):
        if (mine & (m.output == lm.OTHER)).any():
            assert abs((10 ** m.rare[mine & (m.output == lm.OTHER)].astype(np.float64)).sum() - 1) < 1e-4


def test_gradients_are_right(model):
    m, texts = model
    places = lm.places_of([c[2:] for c in cells(texts[:6])], m, lm.subwords_of(TOK))
    params = {k: v.astype(np.float64) for k, v in m.params.items()}

    def loss(p):
        return lm.nats(p, places) / places.times.sum()

    t = lm.Trainer({k: v.copy() for k, v in params.items()}, 0)
    t._update(places, 0.0)
    for name in ("E", "Q", "K", "rho", "A", "B", "b", "a", "bb"):
        g = t.moments[name][0] / 0.1
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        step = 1e-2
        up, down = ({k: v.copy() for k, v in params.items()} for _ in range(2))
        up[name][at] += step
        down[name][at] -= step
        assert abs((loss(up) - loss(down)) / (2 * step) - g[at]) < 0.08 * abs(g[at]) + 2e-4, name


def test_score_table_against_brute_force(docs, corpus):
    got = {r.doc_id: tuple(r) for r in lm.score_texts(docs, TOK, least=2, rounds=2).collect()}
    for want in brute_base(corpus):
        r = got[want[0]]
        assert r[:5] == want[:5] and abs(r[5] - want[5]) < 1e-6 * (1 + abs(want[5]))
        assert r[6] < 0 and math.isfinite(r[6])


@pytest.mark.parametrize("n", [400, 1500])
def test_it_beats_the_base_on_held_out_texts(spark, n):
    """Each text keeps to one of four languages of 60 words, which only its context tells."""
    rng = np.random.default_rng(3)
    syllables = ["ka", "lo", "mi", "tun", "rex", "sha", "vo", "ble", "dri", "sop", "eni", "qua"]
    words = ["".join(rng.choice(syllables, rng.integers(2, 4))) for _ in range(240)]
    rows = [(i, " ".join(rng.choice(words[i % 4 * 60 : i % 4 * 60 + 60], 60))) for i in range(n)]
    got = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), TOK).filter("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.05 * sum(r.n_tokens for r in got)


def test_blocks_of_files_agree_with_one_table(spark, docs, corpus, tmp_path, monkeypatch):
    docs.repartition(5).write.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(lm, "BLOCK_BYTES", 3000)
    got = {r.doc_id: tuple(r) for r in lm.score_texts(spark.read.parquet(str(tmp_path / "d")), TOK, least=1, rounds=1).collect()}
    assert all(got[w[0]][:5] == w[:5] and abs(got[w[0]][5] - w[5]) < 1e-6 * (1 + abs(w[5])) for w in brute_base(corpus))


def test_reruns_agree(docs):
    one, two = ({(r.doc_id, r.score) for r in lm.score_texts(docs, TOK, least=3, rounds=3).collect()} for _ in range(2))
    assert one == two


def test_long_texts_in_pieces(model):
    m, _ = model
    texts = [b"the river runs " * 90_000, b"a stone", b""]
    count = {b"the": 3, b"river": 1}
    got = block_scores(texts, m, count)
    for k, t in enumerate(texts):
        alone = block_scores([t], m, count)
        assert all(np.allclose(got[c][k], alone[c][0], rtol=1e-5) for c in range(4))
    whole = lm._vec.pieces
    one = block_scores([b"the river runs " * 3000], m, count)[3][0]
    lm._vec.pieces = lambda t: whole(t, 1000)
    try:
        assert abs(block_scores([b"the river runs " * 3000], m, count)[3][0] - one) < 1e-4 * abs(one)
    finally:
        lm._vec.pieces = whole


def test_every_training_text_has_cells():
    rng = random.Random(2)
    texts = [b"", b" ", b"word", b"x" * 5000, b" " * 3000, b"y" * 700 + b" tail", *(b" ".join(bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 4000))) for _ in range(60))]
    shares = []
    for i, t in enumerate(texts):
        found = list(lm.cells_of(i, t))
        assert found and len({c[1] for c in found}) == 1
        words = t.split()
        at = 0
        for r, judge, skip, begins, ends, cell in found:
            mine = cell.split()
            assert len(mine) >= skip and (not judge or r == lm.ROUNDS - 1)
            if not words:
                continue
            where = t.index(cell, at)
            assert begins == (where == 0) and ends == (where + len(cell) == len(t))
            assert where == 0 or t[where - 1 : where] in b" \t\n" and (ends or t[where + len(cell) : where + len(cell) + 1].isspace() or cell[-1:].isspace())
        if len(words) > 3000:
            shares.append(sum(len(c[5].split()) - c[2] for c in found) / len(words))
    assert abs(np.mean(shares) - 1 / lm.SHARE) < 0.02


def test_every_word_is_in_one_cell():
    rng = random.Random(5)
    texts = [b"", b" \n", b"x" * 9000, b" ".join([b"y" * 5000] * 3), b"z" * lm.CELL + b" end", b" " * (2 * lm.CELL), *(b" ".join(bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40))) for _ in range(n)) for n in (3, 400, 3000))]
    for i, t in enumerate(texts):
        found = list(lm.cells_of(i, t))
        assert [w for c in found for w in c[5].split()[c[2] :]] == t.split()
        assert [c[4] for c in found] == [False] * (len(found) - 1) + [True]


def test_a_round_that_is_not_kept_loses_no_cells(spark, monkeypatch):
    """The first round spoils the parameters, so all is as if the last round were the only one."""
    rows = [(i, f"river stone {i} light " * 20) for i in range(600)]
    texts, sw = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), lm.subwords_of(TOK)
    blank = lm.blank_model(np.ones(sw.size), sw.first)
    monkeypatch.setattr(lm, "RATES", (50.0, *lm.RATES[1:]))
    stopped, last = (lm.train_model(texts, blank, np.zeros(0), 600, TOK, 1, rounds) for rounds in (3, 1))
    assert len(stopped.losses) == 3 and stopped.losses[1] > stopped.losses[0]
    assert stopped.trained == last.trained
    assert all(np.array_equal(stopped.params[k], last.params[k]) for k in last.params)


def test_all_texts_are_trained_on_and_judges_too(spark):
    rows = [(i, f"river stone {i} light") for i in range(600)]
    sw = lm.subwords_of(TOK)
    blank = lm.blank_model(np.ones(sw.size), sw.first)
    got = lm.train_model(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), blank, np.zeros(0), 600, TOK, 1, 1)
    assert got.trained >= len(lm.places_of([c[2:] for i, t in rows for c in lm.cells_of(i, t.encode())], blank, sw))  # inner places are shared within a task only


def test_one_run_meets_every_place_once(model):
    m, texts = model
    places = lm.places_of([c[2:] for c in cells(texts * 20)], m, lm.subwords_of(TOK))
    met = []

    class Catch(lm.Trainer):
        def _update(self, batch, rate):
            met.append(batch)

    lm.BATCH, batch = 256, lm.BATCH
    try:
        Catch(m.params, 0).run(places, -(-len(places) // 256), 0.01)
    finally:
        lm.BATCH = batch
    assert len(met) > 1
    assert sorted(zip(np.concatenate([b.target for b in met]), np.concatenate([b.context[:, 0] for b in met]))) == sorted(zip(places.target, places.context[:, 0]))


def test_inner_places_count_as_often_as_their_words(model):
    m, _ = model
    places = lm.places_of([(0, True, True, b"paperwork paperwork stone")], m, lm.subwords_of(TOK))
    ids = [lm.subwords_of(TOK).propose(b" " + w) for w in (b"paperwork", b"stone")]
    assert (places.kind == lm.FIRST).sum() == 4
    assert sorted(places.times[places.kind == lm.INNER]) == sorted([2.0] * len(ids[0]) + [1.0] * len(ids[1]) * (not m.whole_words(lm._vec.words([b"stone"])[0])[0][0]))


def test_counts_of_ids_are_those_of_all_words():
    sw, counts, rng = lm.subwords_of(TOK), lm.IdCounts(lm.subwords_of(TOK).size), random.Random(1)
    want = np.zeros(sw.size, np.int64)
    for _ in range(6):
        text = b" ".join(rng.choice([b"river", b"stone", b"quux", b"lightly", b"the", b"paper"]) for _ in range(9))
        raw, starts, ends, hashes, _at = lm._vec.word_spans([text])
        words, where, n = np.unique(hashes, return_index=True, return_counts=True)
        counts.count(words, n, lambda new, r=raw, s=starts[where], e=ends[where]: sw.of_words(np.frombuffer(r, np.uint8), s[new], e[new]))
        assert counts.first(words).tolist() == [sw.propose(b" " + raw[i:j])[0] for i, j in zip(starts[where], ends[where])]
        for w in text.split():
            np.add.at(want, sw.propose(b" " + w), 1)
        if _ == 3:
            counts.totals()
    assert np.array_equal(counts.totals(), want)


def most_held(run):
    """Bytes that a call has at most, its result among them."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_worker_holds_little_for_its_cells():
    """Two workers share an executor's memory with its JVM."""
    sw, rng = lm.subwords_of(TOK), np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdeinrst"), rng.integers(2, 9))) for _ in range(3000)]
    found = [(0, True, True, " ".join(rng.choice(words, 700)).encode()) for _ in range(500)]
    model = lm.with_classes(lm.blank_model(np.ones(sw.size), sw.first), np.ones(2 * lm.KNOWN * lm.PROFILE), np.zeros(0), sw.first, 500)
    places = lm.places_of(found, model, sw)
    assert most_held(lambda: lm.places_of(found, model, sw)) < 15 * sum(len(c[3]) for c in found)
    assert most_held(lambda: lm.nats(model.params, places)) < 60 * len(places)
    assert most_held(lambda: lm.Subwords(TOK)) < 60e6
