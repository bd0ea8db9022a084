"""Toxicity scores from a factorisation machine over hashed terms.

score = sigmoid(w0 + sum of w_i + sum over pairs of <v_i, v_j>), where i, j run over the distinct hashed
terms of a text: its words and their prefixes (an insult may carry any ending). The factors v learn pairs,
such as an insult with the mention of a group, that additive weights miss. Only the text is an input.

Terms are chosen by how they go with the label alone, words also by how they do so in pairs, so that two words which
tell nothing one by one are still met by the factors. The machine is fitted in numpy on a bounded sample of labelled rows (``SAMPLE``); scoring is one narrow
pass over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _vec
from ._frames import as_bytes, numbered, per_batch, pick, place

#: At most so many labelled rows are fitted; they are the first by hash of the id.
SAMPLE = 6_000
#: A term gets a weight and factors if it alone, or with another word, goes with the label: chi-squared of the term, or the
#: deviation (in standard errors) of the pair. Pairs count where both words are expected together in so many rows at least.
CHI, DEVIATION, EXPECTED = 12.0, 6.5, 5.0
FACTORS = 4
PREFIXES = (3, 4, 5, 6)
FOLDS = 5

SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])
SAMPLED = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("terms", T.BinaryType())])


def fold(id_col: str = "doc_id", folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id has fold 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(1))


def marked_terms(group: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, hashed terms): words have an even hash, prefixes of words an odd one."""
    for k, (of, h) in enumerate(_vec.terms(group, PREFIXES)):
        yield of, h & ~np.uint64(1) | np.uint64(k > 0)


@dataclass(frozen=True)
class Machine:
    """A fitted factorisation machine; ``hashes`` sorted, row i of ``factors`` belongs to ``hashes[i]``."""

    hashes: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        docs, terms = self._found(texts)
        return 1 / (1 + np.exp(-np.clip(raw_scores(self.bias, self.weights, self.factors, docs, terms, len(texts)), -30, 30)))

    def _found(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, term) pairs among the terms that have weights."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        table = np.zeros(1 << 20, bool)
        table[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        found = []
        for owners, group in _vec.pieces(texts):
            owner = np.array(owners)
            for of, h in marked_terms(group):
                maybe = np.flatnonzero(table[(h >> np.uint64(44)).astype(np.int64)])
                h = h[maybe]
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = self.hashes[at] == h
                found.append(owner[of[maybe[hit]]] * len(self.hashes) + at[hit])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs // len(self.hashes), pairs % len(self.hashes)


def raw_scores(bias: float, weights: np.ndarray, factors: np.ndarray, docs: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
    out = bias + np.bincount(docs, weights[terms], n)
    for f in range(factors.shape[1]):
        v = factors[terms, f]
        out += 0.5 * (np.bincount(docs, v, n) ** 2 - np.bincount(docs, v * v, n))
    return out


def telling_pairs(docs: np.ndarray, words: np.ndarray, k: int, labels: np.ndarray, at_once: int = 512) -> np.ndarray:
    """Which of ``k`` words go with the label in some pair, beyond what each does alone: (k,) of booleans.

    ``docs, words``: the rows' distinct words. For every pair the sum over the rows of the product of both standardised
    words and the label's residual is held against its standard error; the pairs are met in blocks of words.
    """
    n = len(labels)
    out = np.zeros(k, bool)
    share = np.bincount(words, minlength=k) / n
    used = np.flatnonzero((share * n >= EXPECTED) & (share < 1))
    if len(used) < 2:
        return out
    used = used[np.argsort(-share[used], kind="stable")]
    used = used[share[used] * share[used[0]] * n >= EXPECTED]  # words too rare for any pair
    number = np.full(k, -1)
    number[used] = np.arange(len(used))
    mine = number[words] >= 0
    docs, words, share = docs[mine].astype(np.int32), number[words[mine]].astype(np.int32), share[used]
    order = np.argsort(words, kind="stable")
    docs, words = docs[order], words[order]
    residual = (labels - labels.mean()).astype(np.float32)
    error = np.sqrt((residual.astype(np.float64) ** 2).sum())

    def block(lo: int) -> np.ndarray:
        x = np.zeros((n, min(at_once, len(used) - lo)), np.float32)
        here = slice(*np.searchsorted(words, (lo, lo + at_once)))
        x[docs[here], words[here] - lo] = 1
        p = share[lo : lo + at_once].astype(np.float32)
        x -= p
        x /= np.sqrt(p * (1 - p))
        return x

    for i in range(0, len(used), at_once):
        left = block(i)
        left *= residual[:, None]
        for j in range(i, len(used), at_once):
            if share[i] * share[j] * n < EXPECTED:
                break  # words come in falling order
            stat = np.abs(left.T @ block(j)) / error
            stat[np.outer(share[i : i + at_once], share[j : j + at_once]) * n < EXPECTED] = 0
            if i == j:
                np.fill_diagonal(stat, 0)
            a, b = np.nonzero(stat > DEVIATION)
            out[used[i + a]] = out[used[j + b]] = True
    return out


def fit_machine(labels: np.ndarray, term_sets: list[np.ndarray], steps: int = 300, rate: float = 0.05, seed: int = 7) -> Machine:
    """Choose the terms, then fit all parameters by Adam on the logistic loss with L2. Words have an even hash, prefixes an odd one.

    Without rows of both classes there is nothing to tell apart: every text scores the smoothed
    share of class 1, without any rows a third, so that nothing is rejected unseen.
    """
    n, positive = len(labels), int(labels.sum())
    bias = float(np.log((positive + 0.5) / (n - positive + 1)))
    none = Machine(np.zeros(0, np.uint64), bias, np.zeros(0), np.zeros((0, FACTORS)))
    if not positive or positive == n:
        return none
    docs = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in term_sets])
    hashes, number, counts = np.unique(np.concatenate(term_sets), return_inverse=True, return_counts=True)
    number = number.astype(np.int32)
    in_one = np.bincount(number, labels[docs], len(hashes))
    expected = counts * positive / n
    chi = (in_one - expected) ** 2 / (expected * (1 - positive / n))
    word = hashes & np.uint64(1) == 0
    of_words = word[number]
    chosen = np.flatnonzero((counts >= 3) & (chi > CHI) | telling_pairs(docs[of_words], number[of_words], len(hashes), labels))
    if not len(chosen):
        return none
    new = np.full(len(hashes), -1)
    new[chosen] = np.arange(len(chosen))
    use = new[number] >= 0
    docs, terms = docs[use], new[number[use]]
    k = len(chosen)
    rng = np.random.default_rng(seed)
    theta = [np.array([bias]), np.zeros(k), rng.normal(0, 0.02, (k, FACTORS))]
    decay = [0.0, 2e-4, 2e-3]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in theta]
    for step in range(1, steps + 1):
        b, w, v = theta
        p = 1 / (1 + np.exp(-np.clip(raw_scores(b[0], w, v, docs, terms, n), -30, 30)))
        error = (p - labels) / n
        e = error[docs]
        grad_v = np.empty_like(v)
        for f in range(FACTORS):
            x = v[terms, f]
            grad_v[:, f] = np.bincount(terms, e * (np.bincount(docs, x, n)[docs] - x), k)
        grads = [np.array([error.sum()]), np.bincount(terms, e, k), grad_v]
        for i, (g, (m, s)) in enumerate(zip(grads, moments, strict=True)):
            g = g + decay[i] * theta[i] / max(1, k) ** 0.5
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            theta[i] = theta[i] - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Machine(hashes[chosen], float(theta[0][0]), theta[1], theta[2])


def train_machine(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled rows outside the held-out fold (fold 0).

    Rows without an id or label are left out; of labels that contradict one another for an id, 1 wins; of texts that share an id,
    the one with the least hash stands for it, so that the driver gets ``sample`` rows at most. Null and empty texts have no
    terms; texts of any length count whole; empty tables give the machine that knows nothing. Only the chosen ids (their number is bounded, so they are broadcast) and the hashed terms of their
    texts leave the executors.
    """
    given = pick(labels, id=id_col, label=label_col).filter(F.col("id").isNotNull() & F.col("label").isNotNull())
    chosen = given.filter(fold("id") != 0).orderBy(F.xxhash64("id"), "id").limit(sample).groupBy("id").agg(F.max("label").cast("int").alias("label"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets: list[list[np.ndarray]] = [[] for _ in range(b.num_rows)]
            for owners, group in _vec.pieces(as_bytes(b.column(1))):
                for of, h in marked_terms(group):
                    cuts = np.searchsorted(of, np.arange(len(group) + 1))
                    for i, owner in enumerate(owners):
                        sets[owner].append(h[cuts[i] : cuts[i + 1]])
            out = [np.unique(np.concatenate(s)).tobytes() if s else b"" for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=SAMPLED.names)

    texts = pick(docs, id=id_col, text=text_col)
    one = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.first("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = one.orderBy("id").select("label", "text").mapInArrow(hashed, SAMPLED).toArrow()
    if not rows.num_rows:
        return fit_machine(np.zeros(0), [])
    terms = [np.frombuffer(t.as_buffer(), np.uint64) for chunk in rows.column("terms").chunks for t in chunk]  # as they lie, without copies
    return fit_machine(rows.column("label").to_numpy().astype(np.float64), terms)


def score_toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Null and empty texts score by the bias alone; null ids are not held out; repeated rows give repeated
    results; other columns are ignored; an empty table gives an empty one. Narrow: no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def build():
        m = shared.value

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(m.scores(as_bytes(b.column(1))))], names=SCORES.names)

        return step

    scored = pick(docs, doc_id=id_col, text=text_col).mapInArrow(per_batch(build), SCORES)
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that score below ``threshold``, with all their columns, repeated rows included.

    Null and empty texts score by the bias alone; texts of any length are scored whole; names of columns may clash; an
    empty table gives an empty one. Narrow: no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    flat = numbered(docs)
    at = flat.columns.index(place(docs, text_col))

    def build():
        m = shared.value
        return lambda b: b.filter(pa.array(m.scores(as_bytes(b.column(at))) < threshold))

    return flat.mapInArrow(per_batch(build), flat.schema).toDF(*docs.columns)
