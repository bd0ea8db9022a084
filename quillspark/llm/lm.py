"""Scores of texts under a causal self-attention model over subword ids, trained in numpy.

A lower-cased word, with a space before it, is the longest matches in a byte-level vocabulary; its first subword
depends on what stands before the word, each further one, and the word's end, on the word alone. So a text is
one *first* place a word (and one for the text's end), where attention covers the ``WINDOW`` subwords before it,
and *inner* places, where the mask ends at the word's start. A word's inner places have one value wherever the
word stands and are scored once for each distinct word of a block; every token counts once in its text.

A place: weight of each subword before it = softmax of query * key + a bias by distance, masked; a subword's value
depends on its distance. A rectified sum of the values predicts in two steps, a class and a member of the class,
among first subwords or among inner ones. Ids beyond the ``KNOWN`` most frequent share one id.

The ``WHOLE`` most frequent words are ids of their own, predicted whole at their first place. The rest of another word after its
first subword has, besides the attention's probability, the share of the word among the training words of that beginning. The two are mixed; the attention's part is that of words met once among all training words
(an estimate of how many words of a new text were never met).

Training goes over *every word* of the training documents, at every size alike. Their cells of ``CELL`` bytes are dealt by hash to
``ROUNDS``: each task goes over its own rows from common parameters, and the results are averaged. Ids, their shares, their
classes and the word counts (the base score) come from all training words.
Word counts go to the documents by *blocks*: each split of the input asks for the counts of its own distinct words
only, so neither words nor counts are broadcast.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _vec
from ._frames import SLICE, as_bytes, pick, text_groups, written
from .bpe import SpeculativeBPE

FOLDS = 10
CLASSES = MEMBERS = 32
KNOWN = CLASSES * MEMBERS
END, PAD = KNOWN - 1, KNOWN
OTHER = KNOWN - 2
#: Of the ids of first places, so many are whole words.
WHOLE = 640
DIM, KEY_DIM, WINDOW = 32, 8, 8
#: The two kinds of places: the first subword of a word or a text's end; a further subword or a word's end.
FIRST, INNER = 0, 1
BATCH = 16384
#: Of a training text's cells of so many bytes, one in ``SHARE`` is trained on: all of them. A cell's words see so many bytes before it.
SHARE, CELL, BEFORE = 1, 4096, 64
#: Bytes of cells whose places are made at once.
GROUP = 5_000_000
#: Rounds of averaged training, the step size of each, and the least steps of a task in a round.
ROUNDS, RATES, LEAST_STEPS = 6, (0.015, 0.015, 0.01, 0.006, 0.003, 0.0015), 64
#: Fewer than ``ENOUGH`` places a step are gone over about so many times in a round, in batches of so many at least.
PASSES, LEAST_BATCH, ENOUGH = 3, 128, 4096
#: One document in so many is met in the last round only and measures the rounds before.
JUDGES = 64
#: Classes are made by what stands before an id: so many of the most frequent ids count there.
PROFILE = 256
#: Bytes of text in a block.
BLOCK_BYTES = 12_000_000
SMOOTH = 0.1

SCORES = T.StructType(
    [T.StructField(n, t()) for n, t in (("doc_id", T.LongType), ("held_out", T.BooleanType), ("n_tokens", T.LongType), ("n_known", T.LongType), ("base_score", T.DoubleType), ("score", T.DoubleType))]
)
ASKED = T.StructType([T.StructField("block", T.LongType()), T.StructField("word", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("n", T.LongType())])
CELLS = T.StructType([T.StructField("round", T.IntegerType()), T.StructField("judge", T.BooleanType()), T.StructField("skip", T.IntegerType()), T.StructField("begins", T.BooleanType()), T.StructField("ends", T.BooleanType()), T.StructField("text", T.BinaryType())])
PART = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("task", T.IntegerType()), T.StructField("weight", T.DoubleType()), T.StructField("values", T.BinaryType())])


def fold(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS, F.lit(1))


# Subwords


#: Longer words are matched one by one; both ways give the same ids.
LONG_WORD = 64


class Subwords:
    """Subword ids of words: the longest match in a public byte-level vocabulary, again and again.

    Many words are matched at once by walking a trie of the vocabulary, a byte of every word a step.
    """

    def __init__(self, path: str) -> None:
        bpe = SpeculativeBPE(path, use_special=False)
        self.size, self._ids, self._longest = len(bpe.bytes_of), bpe._proposals, bpe._longest
        self.first = np.array([b[:1] == b" " for b in bpe.bytes_of])
        del bpe
        texts, ids = [t for t in self._ids if t], np.array([i for t, i in self._ids.items() if t], np.int32)
        lengths = np.array([len(t) for t in texts])
        raw, begins = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths
        node, nodes = np.zeros(len(texts), np.int64), 1  # of each text as far as it is walked
        edges, ended = [], []
        left = np.arange(len(texts))
        for depth in range(int(lengths.max())):
            left = left[lengths[left] > depth]
            edge, kid = np.unique(node[left] * 256 + raw[begins[left] + depth], return_inverse=True)
            node[left] = nodes + kid
            edges.append(np.stack((edge, nodes + np.arange(len(edge)))))
            nodes += len(edge)
            ended.append(left[lengths[left] == depth + 1])
        edge, kid = np.concatenate(edges, axis=1)
        parent, byte = edge // 256, edge % 256
        kids = np.bincount(parent, minlength=nodes)
        number = np.empty(nodes, np.int32)  # only nodes with several children have a row, so they come first
        number[np.argsort(kids < 2, kind="stable")] = np.arange(nodes)
        self.rows = int((kids > 1).sum())
        several = kids[parent] > 1
        self.table = np.full((self.rows + 1) * 256, -1, np.int32)
        self.table[number[parent[several]].astype(np.int64) * 256 + byte[several]] = number[kid[several]]
        self.byte, self.kid = np.full(nodes, -1, np.int16), np.full(nodes, -1, np.int32)  # of nodes with one child
        self.byte[number[parent[~several]]] = byte[~several]
        self.kid[number[parent[~several]]] = number[kid[~several]]
        self.token = np.full(nodes, -1, np.int32)
        ended = np.concatenate(ended)
        self.token[number[node[ended]]] = ids[ended]
        self.root = int(number[0])
        self.space = int(number[kid[(parent == 0) & (byte == 32)][0]])

    def propose(self, word: bytes) -> list[int]:
        """The longest matches of one word, in order."""
        out, at, ids = [], 0, self._ids
        while at < len(word):
            stop = min(len(word), at + self._longest)
            while word[at:stop] not in ids:
                stop -= 1
            out.append(ids[word[at:stop]])
            at = stop
        return out

    def of_words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words ``raw[start:end]`` one after another, and where each word's begin (len + 1). A word is taken with a space before it."""
        n = len(starts)
        if not n:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        words: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        nth: list[np.ndarray] = []
        taken = np.zeros(n, np.int64)
        lengths = ends - starts
        word = np.flatnonzero(lengths <= LONG_WORD)
        for w in np.flatnonzero(lengths > LONG_WORD).tolist():
            found = np.array(self.propose(b" " + raw[starts[w] : ends[w]].tobytes()), np.int32)
            words.append(np.full(len(found), w))
            ids.append(found)
            nth.append(np.arange(len(found)))
            taken[w] = len(found)
        at, end = starts[word].copy(), ends[word]
        node = np.full(len(word), self.space, np.int32)
        best, best_at = self.token[node], at.copy()
        while len(word):
            c = raw[np.minimum(at, len(raw) - 1)]
            following = np.where(self.byte[node] == c, self.kid[node], self.table[np.minimum(node, self.rows) * 256 + c])
            following[at >= end] = -1
            stuck = following < 0
            node = np.where(stuck, self.root, following)
            at = np.where(stuck, best_at, at + 1)
            if stuck.any():
                w = word[stuck]
                words.append(w)
                ids.append(best[stuck])
                nth.append(taken[w])
                taken[w] += 1
            token = np.where(stuck, -1, self.token[node])
            hit = token >= 0
            best, best_at = np.where(hit, token, best), np.where(hit, at, best_at)
            left = ~(stuck & (best_at >= end))
            if not left.all():
                word, at, end, node, best, best_at = word[left], at[left], end[left], node[left], best[left], best_at[left]
        stops = np.concatenate(([0], np.cumsum(taken)))
        flat = np.empty(int(stops[-1]), np.int32)
        flat[stops[np.concatenate(words)] + np.concatenate(nth)] = np.concatenate(ids)
        return flat, stops


@lru_cache(4)
def subwords_of(path: str) -> Subwords:
    made = Subwords(path)
    give_back()
    return made


def gather(flat: np.ndarray, stops: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``flat`` one after another, and their lengths."""
    begins = stops[which]
    lengths = stops[which + 1] - begins
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    begins -= ends - lengths
    at = np.repeat(begins.astype(small(len(flat) + total)), lengths)
    at += np.arange(total, dtype=at.dtype)
    return flat[at], lengths


def small(n: int) -> type:
    """The integers that hold numbers up to ``n`` of either sign."""
    return np.int32 if n < 1 << 31 else np.int64


def inner_line(context: np.ndarray, output: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A line of words, each behind padding; the places behind each of their subwords; and what stands there.

    ``context``, ``output``: the words' subwords as what is seen and as what is predicted.
    """
    lengths = np.diff(stops)
    n = len(lengths)
    line = np.full(int(stops[-1]) + n * (WINDOW - 1) + 1, PAD, np.int64)
    at = np.arange(int(stops[-1])) + np.repeat((np.arange(n) + 1) * (WINDOW - 1), lengths)
    line[at] = context
    target = np.empty(len(at), np.int64)
    target[:-1] = output[1:]
    target[stops[1:] - 1] = END
    return line, at + 1, target


def text_line(runs: list[np.ndarray]) -> np.ndarray:
    """The contexts of texts in one line: before each text padding and a start, after it one place for its end."""
    kind = runs[0].dtype
    head, tail = np.full(WINDOW, PAD, kind), np.array([END], kind)
    head[-1] = END
    return np.concatenate([x for r in runs for x in (head, r, tail)])


# Model

SHAPES = {"E": (WINDOW, PAD + 1, DIM), "Q": (PAD + 1, KEY_DIM), "K": (PAD + 1, KEY_DIM), "rho": (WINDOW,), "b": (DIM,), "A": (2, DIM, CLASSES), "a": (2, CLASSES), "B": (2 * CLASSES, DIM, MEMBERS), "bb": (2 * CLASSES, MEMBERS)}


@dataclass(frozen=True)
class Model:
    """``context``, ``output``: the model's ids of each raw id; ``rare``: log10 share of a raw id among those of its kind that share ``OTHER``.

    ``met``: how often each raw id is met, of first ones without the ``whole`` words, which are hashes in order with their ids in
    ``whole_output``; ``unseen``: the share of words met once among the other training words.
    ``trained``: how many places the training met; ``losses``: nats a place of the judging documents after each round that they measure.
    """

    context: np.ndarray
    output: np.ndarray
    rare: np.ndarray
    met: np.ndarray
    whole: np.ndarray
    whole_output: np.ndarray
    params: dict[str, np.ndarray]
    unseen: float = 1.0
    trained: int = 0
    losses: tuple[float, ...] = ()

    def whole_words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are ids of their own, and those ids (or 0)."""
        if not len(self.whole):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.whole, hashes), len(self.whole) - 1)
        hit = self.whole[at] == hashes
        return hit, np.where(hit, self.whole_output[at], 0)


def softmax(x: np.ndarray) -> np.ndarray:
    """Of each row, in place; values beyond 80 count as 80."""
    np.clip(x, -80, 80, out=x)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]
    return x


def classes_of(profile: np.ndarray) -> np.ndarray:
    """Ids (rows of ``profile``) in order of class: halves by the main direction of their profiles, again and again."""

    def halves(idx: np.ndarray, parts: int) -> list[np.ndarray]:
        if parts == 1:
            return [idx]
        x = profile[idx] - profile[idx].mean(axis=0)
        v = np.random.default_rng(0).normal(size=x.shape[1])
        for _ in range(15):
            v = x.T @ (x @ v)
            v /= np.linalg.norm(v) + 1e-12
        order = idx[np.argsort(x @ v, kind="stable")]
        return halves(order[: len(order) // 2], parts // 2) + halves(order[len(order) // 2 :], parts // 2)

    return np.concatenate(halves(np.arange(KNOWN), CLASSES))


@dataclass
class Places:
    """Contexts (nearest first), what stands there, the kind of place, and how often it is met."""

    context: np.ndarray
    target: np.ndarray
    kind: np.ndarray
    times: np.ndarray

    def __len__(self) -> int:
        return len(self.target)

    def take(self, at: np.ndarray) -> Places:
        return Places(self.context[at], self.target[at], self.kind[at], self.times[at])


class Trainer:
    """Adam on minibatches of places in random order; each place is met once before any is met again."""

    def __init__(self, params: dict[str, np.ndarray], seed: int) -> None:
        self.flat = pack(params)
        self.grad, first, second = (np.zeros_like(self.flat) for _ in range(3))
        self.both, self.room = (first, second), np.empty_like(self.flat)
        self.p, self.grads = views(self.flat), views(self.grad)
        self.moments = {k: (m, v) for (k, m), v in zip(views(first).items(), views(second).values(), strict=True)}
        self.rng, self.step, self.part = np.random.default_rng(seed), 0, 1024

    def run(self, places: Places, steps: int, rate: float, batch: int | None = None) -> None:
        batch = batch or BATCH
        left = np.zeros(0, np.int64)
        for i in range(steps):
            if not len(left):
                left = self.rng.permutation(len(places))
            at, left = left[:batch], left[batch:]
            self._update(places.take(at), rate * min(1.0, (i + 1) / 10))

    def _update(self, batch: Places, rate: float) -> None:
        p, grads, n, offsets = self.p, self.grads, len(batch), np.arange(WINDOW)
        self.grad[:] = 0
        c = batch.kind.astype(np.int16) * CLASSES + (batch.target // MEMBERS).astype(np.int16)
        order = np.argsort(c, kind="stable")
        short, y, c = batch.context.take(order, axis=0), batch.target[order] % MEMBERS, c[order]
        ctx = short.astype(np.int64)
        share = batch.times[order].astype(np.float32)
        share /= share.sum()
        values, keys = p["E"].reshape(-1, DIM), p["K"]
        at_values = ctx + offsets * (PAD + 1)
        parts = [slice(lo, min(n, lo + self.part)) for lo in range(0, n, self.part)]  # small, so that what is gathered stays in the cache
        q = p["Q"].take(ctx[:, 0], axis=0)
        alpha, u = np.empty((n, WINDOW), q.dtype), np.empty((n, DIM), q.dtype)
        e, k = np.empty((self.part, WINDOW, DIM), q.dtype), np.empty((self.part, WINDOW, KEY_DIM), q.dtype)
        for i in parts:
            m = i.stop - i.start
            keys.take(ctx[i], axis=0, out=k[:m], mode="clip")
            x = np.einsum("nwk,nk->nw", k[:m], q[i])
            x += p["rho"]
            np.clip(x, -80, 80, out=x)
            np.exp(x, out=x)
            x *= short[i] != PAD
            x /= (x @ np.ones(WINDOW, x.dtype))[:, None]
            alpha[i] = x
            values.take(at_values[i], axis=0, out=e[:m], mode="clip")
            np.einsum("nw,nwd->nd", x, e[:m], out=u[i])
        u *= WINDOW / 2
        u += p["b"]
        h = np.maximum(u, 0)
        cuts = np.searchsorted(c, np.arange(2 * CLASSES + 1))
        dh, ones = np.empty_like(h), np.ones(n, h.dtype)
        for kind in (FIRST, INNER):
            lo, hi = cuts[kind * CLASSES], cuts[(kind + 1) * CLASSES]
            if lo < hi:
                g1 = softmax(h[lo:hi] @ p["A"][kind] + p["a"][kind])
                g1[np.arange(hi - lo), c[lo:hi] - kind * CLASSES] -= 1
                g1 *= share[lo:hi, None]
                grads["A"][kind], grads["a"][kind] = h[lo:hi].T @ g1, ones[: hi - lo] @ g1
                np.matmul(g1, p["A"][kind].T, out=dh[lo:hi])
        rows = np.arange(np.diff(cuts).max())
        for j in np.flatnonzero(np.diff(cuts)):
            lo, hi = cuts[j], cuts[j + 1]
            g2 = softmax(h[lo:hi] @ p["B"][j] + p["bb"][j])
            g2[rows[: hi - lo], y[lo:hi]] -= 1
            g2 *= share[lo:hi, None]
            grads["B"][j], grads["bb"][j] = h[lo:hi].T @ g2, ones[: hi - lo] @ g2
            dh[lo:hi] += g2 @ p["B"][j].T
        dh *= u > 0
        grads["b"][:] = ones @ dh
        dh *= WINDOW / 2
        ds, dq = np.empty_like(alpha), np.empty_like(q)
        for i in parts:
            m = i.stop - i.start
            values.take(at_values[i], axis=0, out=e[:m], mode="clip")
            x = np.einsum("nwd,nd->nw", e[:m], dh[i])
            x *= alpha[i]
            x -= alpha[i] * (x @ np.ones(WINDOW, x.dtype))[:, None]
            ds[i] = x
            keys.take(ctx[i], axis=0, out=k[:m], mode="clip")
            np.einsum("nw,nwk->nk", x, k[:m], out=dq[i])
        grads["rho"][:] = ones @ ds
        columns, by_value, by_key = (np.ascontiguousarray(x.T) for x in (short, alpha, ds))
        both, change = np.empty((n, DIM + KEY_DIM), dh.dtype), np.empty(n, bool)
        for w in offsets:  # sums by id over the places in order of id
            by = np.argsort(columns[w], kind="stable")
            ids = columns[w].take(by)
            m = int(np.searchsorted(ids, PAD))
            if m:
                by, some = by[:m], both[:m]
                change[0] = True
                np.not_equal(ids[1:m], ids[: m - 1], out=change[1:m])
                first = np.flatnonzero(change[:m])
                np.multiply(dh.take(by, axis=0), by_value[w].take(by)[:, None], out=some[:, :DIM])
                np.multiply(q.take(by, axis=0), by_key[w].take(by)[:, None], out=some[:, DIM:])
                sums = np.add.reduceat(some, first)
                grads["E"][w][ids[first]] = sums[:, :DIM]
                grads["K"][ids[first]] += sums[:, DIM:]
                if w == 0:
                    grads["Q"][ids[first]] = np.add.reduceat(dq.take(by, axis=0), first)
        self.step += 1
        (m, v), g, x = self.both, self.grad, self.room
        np.multiply(g, 0.1, out=x)
        m *= 0.9
        m += x
        np.multiply(g, g, out=x)
        x *= 0.01
        v *= 0.99
        v += x
        np.sqrt(v, out=x)
        x /= (1 - 0.99**self.step) ** 0.5
        x += 1e-8
        np.divide(m, x, out=x)
        x *= rate / (1 - 0.9**self.step)
        self.flat -= x


class Scorer:
    """Natural-log probabilities of places, in blocks that stay in the processor's caches."""

    def __init__(self, params: dict[str, np.ndarray], block: int = 8192) -> None:
        self.block = block
        self.size = PAD + 1
        logits = np.clip(params["Q"] @ params["K"].T, -40, 40)
        pair = np.exp(logits).astype(np.float32)
        pair[:, PAD] = 0
        self.pair = pair.reshape(-1)
        self.distance = np.exp(np.clip(params["rho"], -40, 40)).astype(np.float32)
        self.values = (params["E"] * np.float32(WINDOW / 2)).reshape(-1, DIM)
        self.back, self.rows = 1 + np.arange(WINDOW), np.arange(WINDOW) * self.size
        self.ones = np.ones(max(WINDOW, CLASSES, MEMBERS), np.float32)
        self.part = 512
        self.hidden, self.gathered = np.empty((block, DIM), self.values.dtype), np.empty((self.part, WINDOW, DIM), self.values.dtype)
        self.p = params

    def __call__(self, line: np.ndarray, places: np.ndarray, target: np.ndarray, kind: int) -> np.ndarray:
        """Of what stands at ``places``, given what stands before them in ``line``."""
        out = np.empty(len(places), np.float32)
        for at in range(0, len(places), self.block):
            here = slice(at, at + self.block)
            out[here] = self._some(line, places[here], target[here], kind)
        return out

    def _some(self, line: np.ndarray, at: np.ndarray, y: np.ndarray, kind: int) -> np.ndarray:
        c = y // MEMBERS
        order = np.argsort(c.astype(np.int8), kind="stable")
        at, y, c = at[order], y[order], c[order]
        n = len(at)
        u = self.hidden[:n]
        for lo in range(0, n, self.part):  # small parts, so that the gathered values stay in the cache
            ctx = line.take(at[lo : lo + self.part, None] - self.back, mode="clip")
            weight = self.pair.take(ctx[:, :1] * self.size + ctx, mode="clip")
            weight *= self.distance
            weight /= (weight @ self.ones[:WINDOW])[:, None]
            ctx += self.rows
            values = self.gathered[: len(ctx)]
            self.values.take(ctx, axis=0, out=values, mode="clip")
            np.matmul(weight[:, None, :], values, out=u[lo : lo + self.part, None])
        u += self.p["b"]
        np.maximum(u, 0, out=u)
        one = u @ self.p["A"][kind]
        one += self.p["a"][kind]
        np.clip(one, -80, 80, out=one)
        result = one[np.arange(n), c]
        np.exp(one, out=one)
        result -= np.log(one @ self.ones[:CLASSES])
        cuts = np.searchsorted(c, np.arange(CLASSES + 1))
        place = y % MEMBERS
        for j in range(CLASSES):
            lo, hi = cuts[j], cuts[j + 1]
            if lo < hi:
                two = u[lo:hi] @ self.p["B"][kind * CLASSES + j]
                two += self.p["bb"][kind * CLASSES + j]
                np.clip(two, -80, 80, out=two)
                result[lo:hi] += two[np.arange(hi - lo), place[lo:hi]]
                np.exp(two, out=two)
                result[lo:hi] -= np.log(two @ self.ones[:MEMBERS])
        back = np.empty(n, np.float32)
        back[order] = result
        return back


def one_thread() -> None:
    """Keep numpy's BLAS to one thread: the matrices are small, and each core runs a task of its own."""
    import ctypes
    from pathlib import Path

    for lib in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if fn := getattr(ctypes.CDLL(str(lib)), name, None):
                fn(1)
                break


@lru_cache(1)
def _trim() -> Callable[[int], int] | None:
    import ctypes

    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, and the C library would keep all it ever had."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


# Training


_SPACE = re.compile(rb"[\x09-\x0d ]")


def cells_of(doc_id: int, text: bytes) -> Iterator[tuple[int, bool, int, bool, bool, bytes]]:
    """``CELLS`` of a training text, one at least, each with its round: every word is in one.

    A cell has the words that begin in ``CELL`` bytes; ``skip``: how many words of its ``text`` stand before it and are only seen.
    A document in ``JUDGES`` has all its cells in the last round.
    """
    with np.errstate(over="ignore"):
        seed = _vec.mix(np.array([(zlib.crc32(text) + (doc_id << 32)) & ((1 << 64) - 1)], np.uint64))
        h = _vec.mix(seed + np.arange(max(1, -(-len(text) // CELL)), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    judge = int(seed[0] >> np.uint64(7)) % JUDGES == 0
    for i, r in enumerate(((h >> np.uint64(20)) % np.uint64(ROUNDS)).tolist()):
        start, stop = i * CELL, min(len(text), (i + 1) * CELL)
        if i:
            space = _SPACE.search(text, start - 1, stop)
            if space is None or space.end() == stop < len(text):
                continue  # no word begins here
            start = space.end()
        if 0 < stop < len(text) and not _vec.SPACE[text[stop - 1]]:
            space = _SPACE.search(text, stop)
            stop = space.start() if space else len(text)
        first = max(0, start - BEFORE)
        if 0 < first < start:
            space = _SPACE.search(text, first - 1, start)
            first = space.end() if space else start
        yield ROUNDS - 1 if judge else r, judge, len(text[first:start].split()), first == 0, stop == len(text), text[first:stop]


_CELLS = pa.schema([("round", pa.int32()), ("judge", pa.bool_()), ("skip", pa.int32()), ("begins", pa.bool_()), ("ends", pa.bool_()), ("text", pa.binary())])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, SLICE):
            part = b.slice(lo, SLICE)
            rows = [c for i, t in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True) for c in cells_of(i or 0, t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_CELLS)], schema=_CELLS)


def groups(cells: list[tuple]) -> Iterator[list[tuple]]:
    """Runs of cells of about ``GROUP`` bytes."""
    for lo, texts in text_groups((c[3] for c in cells), GROUP):
        yield cells[lo : lo + len(texts)]


def spans_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``word_spans`` of many texts, some at a time, which takes less memory."""
    size = sum(map(len, texts)) + len(texts)
    raw, parts, shift, before = np.empty(size, np.uint8), [], 0, 0
    for _, some in text_groups(texts):
        lower, starts, ends, hashes, at = _vec.word_spans(some)
        raw[shift : shift + len(lower)] = np.frombuffer(lower, np.uint8)
        parts.append(((starts + shift).astype(small(size)), (ends + shift).astype(small(size)), hashes, at[1:] + before))
        shift, before = shift + len(lower), before + len(starts)
    starts, ends, hashes = (np.concatenate([p[k] for p in parts]) for k in range(3))
    return raw, starts, ends, hashes, np.concatenate([[0], *(p[3] for p in parts)])


def places_of(cells: list[tuple], model: Model, subwords: Subwords, width: int = WINDOW) -> Places:
    """The places of cells ``(skip, begins, ends, text)``, with the ``width`` nearest subwords; inner places once for each distinct word, with how often it is met."""
    raw, starts, ends, hashes, at = spans_of([c[3] for c in cells])
    distinct, where, word = np.unique(hashes, return_index=True, return_inverse=True)
    del hashes
    word = word.astype(small(len(distinct)))
    flat, stops = subwords.of_words(raw, starts[where].astype(np.int64), ends[where].astype(np.int64))
    del raw, starts, ends
    whole, begins_with = model.whole_words(distinct)
    begins_with = np.where(whole, begins_with, model.output[flat[stops[:-1]]]).astype(np.int16)
    context, lengths = gather(model.context[flat].astype(np.int16), stops, word)
    bounds = np.zeros(len(word) + 1, small(len(context) + len(cells) * (WINDOW + 1)))
    np.cumsum(lengths, out=bounds[1:])
    del lengths
    begins = np.array([c[1] for c in cells])
    runs = [context[bounds[a] : bounds[b]] for a, b in zip(at[:-1], at[1:], strict=True)]
    line = text_line(runs)
    head = np.cumsum([0, *(len(r) + WINDOW + 1 for r in runs)])  # where each cell's head begins in the line
    del runs, context
    line[head[:-1][~begins] + WINDOW - 1] = PAD  # no start is seen where the text began earlier
    of = np.repeat(np.arange(len(cells), dtype=bounds.dtype), np.diff(at))
    met = np.arange(len(word)) >= (at[:-1] + np.array([c[0] for c in cells]))[of]
    bounds = bounds[:-1]
    of *= WINDOW + 1
    bounds += of
    bounds += WINDOW
    del of
    last = head[1:][[c[2] for c in cells]] - 1
    places = np.concatenate((bounds[met], last.astype(bounds.dtype)))
    del bounds
    word = word[met]
    target = np.concatenate((begins_with[word], np.full(len(last), END, np.int16)))
    times = np.bincount(word, minlength=len(where))
    del word
    use = np.flatnonzero((times > 0) & ~whole)
    chosen, n = gather(flat, stops, use)
    words, inside, tails = inner_line(model.context[chosen], model.output[chosen], np.concatenate(([0], np.cumsum(n))))
    words = words.astype(np.int16)
    seen = np.empty((len(places) + len(inside), width), np.int16)
    for w in range(width):
        places -= 1
        seen[: len(places), w] = line.take(places)
        seen[len(places) :, w] = words.take(inside - 1 - w)
    del line
    # a cell without any word before it in a text that began earlier sees the start's sign all the same, so that something is seen
    bare = np.flatnonzero(seen[:, 0] == PAD)
    seen[bare[(seen[bare] == PAD).all(axis=1)], 0] = END
    kind = np.repeat(np.array([FIRST, INNER], np.int8), [len(places), len(inside)])
    return Places(seen, np.concatenate((target, tails.astype(np.int16))), kind, np.concatenate((np.ones(len(places), np.float32), np.repeat(times[use].astype(np.float32), n))))


def ranked(counts: np.ndarray, most: int = KNOWN - 2) -> np.ndarray:
    """Each raw id's rank by frequency, or ``OTHER``."""
    top = np.argsort(-counts, kind="stable")[:most]
    top = top[counts[top] > 0]
    out = np.full(len(counts), OTHER, np.int32)
    out[top] = np.arange(len(top))
    return out


def blank_model(counts: np.ndarray, first: np.ndarray, unseen: float = 1.0, whole: np.ndarray | None = None, whole_counts: np.ndarray | None = None, whole_first: np.ndarray | None = None) -> Model:
    """Ids by frequency and no parameters yet.

    ``counts`` of the raw ids over all training words; ``first``: which raw ids begin words; ``whole``, ``whole_counts``, ``whole_first``:
    hashes, counts and first raw ids of the words that are ids of their own.
    """
    context = ranked(counts)
    if whole is None:
        whole, whole_counts, whole_first = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)
    order = np.argsort(whole)
    met = counts - np.bincount(whole_first, whole_counts, len(counts))
    begin = ranked(np.where(first, met, 0), KNOWN - 2 - WHOLE)
    output = np.where(first, np.where(begin == OTHER, OTHER, begin + WHOLE), ranked(np.where(first, 0, met)))
    share = np.zeros(len(counts))
    for kind in (first, ~first):
        lost = kind & (output == OTHER)
        share[lost] = (met[lost] + 0.01) / max(1e-300, (met[lost] + 0.01).sum())
    rare = np.where(output == OTHER, np.log10(np.maximum(share, 1e-300)), 0).astype(np.float32)
    return Model(context, output.astype(np.int32), rare, met, whole[order], np.arange(len(whole))[order], {}, unseen)


def pair_counts(places: Places) -> np.ndarray:
    """How often each of the ``PROFILE`` most frequent ids stands right before each id of each kind, flat."""
    near = places.context[:, 0].astype(np.int64)
    use = near < PROFILE
    return np.bincount((places.kind[use].astype(np.int64) * KNOWN + places.target[use]) * PROFILE + near[use], places.times[use], 2 * KNOWN * PROFILE).astype(np.int64)


def with_classes(model: Model, pairs: np.ndarray, whole_counts: np.ndarray, first: np.ndarray, ends: int, seed: int = 3) -> Model:
    """Renumber what is predicted by class, and draw the first parameters. ``whole_counts`` in the order of ``whole_output``."""
    output, whole_output, counts = model.output.copy(), model.whole_output, model.met
    rng = np.random.default_rng(seed)
    draw = lambda name, s: rng.normal(0, s, SHAPES[name]).astype(np.float32)
    params = {"E": draw("E", 0.3), "Q": draw("Q", 0.3), "K": draw("K", 0.3), "rho": np.zeros(WINDOW, np.float32), "b": np.zeros(DIM, np.float32), "A": draw("A", 0.1), "B": draw("B", 0.1)}
    a, bb = np.zeros(SHAPES["a"]), np.zeros(SHAPES["bb"])
    words = counts[first].sum()
    for kind, mine in ((FIRST, first), (INNER, ~first)):
        profile = pairs.reshape(2, KNOWN, PROFILE)[kind]
        number = np.empty(KNOWN, np.int32)
        number[classes_of(np.sqrt(profile / np.maximum(1, profile.sum(axis=1, keepdims=True))))] = np.arange(KNOWN)
        for fixed in (END, OTHER):  # keep their numbers
            at = int(np.flatnonzero(number == fixed)[0])
            number[at], number[fixed] = number[fixed], fixed
        output[mine] = number[output[mine]]
        freq = np.bincount(output[mine], counts[mine], KNOWN) + 0.5
        if kind == FIRST:
            freq[number[: len(whole_counts)]] += whole_counts
            whole_output = number[whole_output].astype(np.int64)
        freq[END] += ends if kind == FIRST else words
        freq /= freq.sum()
        a[kind] = np.log(freq.reshape(CLASSES, MEMBERS).sum(axis=1))
        bb[kind * CLASSES : (kind + 1) * CLASSES] = np.log(freq.reshape(CLASSES, MEMBERS))
    params |= {"a": a.astype(np.float32), "bb": bb.astype(np.float32)}
    return replace(model, output=output, whole_output=whole_output, params={k: params[k] for k in SHAPES})


def pack(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].reshape(-1) for k in SHAPES])


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    return views(flat.copy())


def nats(params: dict[str, np.ndarray], places: Places) -> float:
    """Summed loss of the places, each as often as it is met."""
    total, scorer = 0.0, Scorer(params)
    width = places.context.shape[1]
    for kind in (FIRST, INNER):
        mine = np.flatnonzero(places.kind == kind)
        for lo in range(0, len(mine), 4 * scorer.block):
            at = mine[lo : lo + 4 * scorer.block]
            line = places.context[at, ::-1].astype(np.int64).reshape(-1)
            total -= float((scorer(line, (np.arange(len(at)) + 1) * width, places.target[at].astype(np.int64), kind).astype(np.float64) * places.times[at]).sum())
    return total


def train_task(model: Model, mine: list[tuple], judges: list[tuple], spare: Iterable[list[tuple]], least: int, rate: float, seed: int, subwords: Subwords) -> tuple[np.ndarray, int, float, float]:
    """A task's round: (parameters, places met, loss of the judges before the round, their places).

    It goes once over the places of ``mine``, in smaller batches where they make less than ``least`` steps; where these have less
    than ``ENOUGH`` places each, cells of ``spare`` follow, and all are gone over up to ``PASSES`` times until the steps are done. Cells are ``(skip, begins, ends, text)``.
    """
    loss = weight = 0.0
    for some in groups(judges):
        held = places_of(some, model, subwords)
        loss, weight = loss + nats(model.params, held), weight + float(held.times.sum(dtype=np.float64))
        del held
    trainer = Trainer(model.params, seed)
    met = 0
    batches = list(groups(mine))
    if len(batches) < 2:
        few = list(mine)
        places = places_of(few, model, subwords) if few else None
        for more in spare:
            if places is not None and len(places) >= least * ENOUGH:
                break
            if more:
                few += more
                places = places_of(few, model, subwords)
        if places is not None:
            few_steps = len(places) < least * ENOUGH
            batch = min(ENOUGH, max(LEAST_BATCH, PASSES * len(places) // least)) if few_steps else min(BATCH, len(places) // least)
            trainer.run(places, max(least, -(-len(places) // batch)), rate, batch)
            met = len(places)
    else:
        for part in batches:
            places = places_of(part, model, subwords)
            trainer.run(places, -(-len(places) // BATCH), rate)
            met += len(places)
    return trainer.flat, met, loss, weight


# On Spark


def _task_cells(batches: Iterator[pa.RecordBatch]) -> Callable[..., list[tuple]]:
    """A task's cells of given rounds; those of judging documents are of round ``ROUNDS``."""
    table = pa.Table.from_batches(batches, _CELLS)
    rounds = np.where(table.column("judge").to_numpy(), ROUNDS, table.column("round").to_numpy())

    def of(*wanted: int) -> list[tuple]:
        some = table.filter(pa.array(np.isin(rounds, wanted)))
        return _rows_of(some)

    return of


def _rows_of(cells: pa.Table | pa.RecordBatch) -> list[tuple]:
    return list(zip(*(cells.column(k).to_pylist() for k in range(2, 6)), strict=True))


def train_model(texts: DataFrame, blank: Model | None, whole_counts: np.ndarray, ends: int, tokenizer_path: str, least: int = LEAST_STEPS, rounds: int = ROUNDS) -> Model | None:
    """From ``texts(doc_id, text)`` of the training fold and the ids chosen by counts over all of its words (``blank_model``).

    Every text's cells are written once, where they lie. In each round each task goes over its own cells of the round from
    the common parameters; the results are averaged by places, in two levels and in a fixed order, so that no task holds more
    than about the square root of all results. The judging documents measure each round; when the loss has grown, the best
    parameters so far go straight to the last round, which also takes the judging documents and all cells not yet met.
    None without any training text.
    """
    if not ends:
        return None
    one_thread()
    spark = texts.sparkSession
    subwords = subwords_of(tokenizer_path)
    cells = written(texts.select("doc_id", "text").mapInArrow(_cells, CELLS).sortWithinPartitions("judge", "round"), "cells")  # in order, so that a round reads little else
    tasks = max(1, cells.rdd.getNumPartitions())
    given = spark.sparkContext.broadcast(blank)

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * KNOWN * PROFILE, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                part = b.slice(lo, SLICE)
                total += pair_counts(places_of(_rows_of(part), given.value, subwords_of(tokenizer_path), 1))
        give_back()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    found = cells.mapInArrow(pairs_of, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(2 * KNOWN * PROFILE, np.int64)
    pairs[found.column("at").to_numpy()] = found.column("n").to_numpy()
    model = with_classes(blank, pairs, whole_counts, subwords.first, ends)
    side = max(1, int(tasks**0.5))
    alone = blank.met[subwords.first].sum() + whole_counts.sum() >= least * ENOUGH * tasks * ROUNDS  # words; then a round needs no cells of others
    chunk = 1 << 15

    def round_of(model: Model, number: int, met_before: frozenset[int], rate: float) -> tuple[dict[str, np.ndarray], int, float]:
        shared_model = spark.sparkContext.broadcast(model)
        final = number == ROUNDS - 1
        wanted = [r for r in range(ROUNDS) if r not in met_before] if final else [number]

        def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_thread()
            task = TaskContext.get().partitionId()
            cells_in = _task_cells(batches)
            judges = cells_in(ROUNDS)
            if final:
                mine, spare = cells_in(*wanted, ROUNDS), ()
            else:
                mine, spare = cells_in(*wanted), (cells_in((number + k) % ROUNDS) for k in range(1, ROUNDS))
            flat, met, loss, weight = train_task(shared_model.value, mine, judges, spare, 1 if final else least, rate, 1000 * number + task, subwords_of(tokenizer_path))
            del mine, judges, spare, cells_in
            give_back()
            pieces = [flat[i : i + chunk] for i in range(0, len(flat), chunk)] if met else []
            rows = [(i, task % side, task, float(met), p.tobytes()) for i, p in enumerate(pieces)]
            rows.append((-1, task % side, task, weight, np.array([loss / max(weight, 1e-9)], np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PART)], schema=_PART)

        needed = cells.filter(F.col("round").isin(wanted) | F.col("judge")) if alone or final else cells
        rows = needed.mapInArrow(go_on, PART).groupBy("chunk", "part").applyInArrow(_average, PART).groupBy("chunk").applyInArrow(_average, PART).orderBy("chunk").collect()
        shared_model.unpersist()
        parts = [r for r in rows if r["chunk"] >= 0]
        judged = next((r for r in rows if r["chunk"] < 0 and r["weight"]), None)
        loss = float(np.frombuffer(judged["values"], np.float32)[0]) if judged else -float(number)  # without judges nothing stops the rounds
        if not parts:
            return model.params, 0, loss
        return unpack(np.concatenate([np.frombuffer(r["values"], np.float32) for r in parts])), round(parts[0]["weight"]), loss

    best, losses, done = None, [], {}
    params = model.params
    for number in [*range(ROUNDS - 1)][: rounds - 1]:
        grown, met, loss = round_of(replace(model, params=params), number, frozenset(), RATES[number])
        losses.append(loss)  # of the parameters that the round began with
        if best is not None and not loss < best[0]:
            del done[number - 1]  # what that round learnt is not kept, so the last one takes its cells
            break
        best = (loss, params)
        params = grown
        done[number] = met
    else:
        best = None  # the last parameters are not yet measured; each before was better than those before it
    params, met, loss = round_of(replace(model, params=params if best is None else best[1]), ROUNDS - 1, frozenset(done), RATES[-1])
    return replace(model, params=params, trained=sum(done.values()) + met, losses=(*losses, loss))


_PART = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("task", pa.int32()), ("weight", pa.float64()), ("values", pa.binary())])


def _average(table: pa.Table) -> pa.Table:
    """The mean of a chunk's values by weight, summed in order of task, so that reruns agree."""
    table = table.sort_by("task")
    weights = table.column("weight").to_numpy()
    total = weights.sum()
    mean = sum(w * np.frombuffer(v, np.float32).astype(np.float64) for w, v in zip(weights, table.column("values").to_pylist(), strict=True)) / max(total, 1e-9)
    return pa.table({"chunk": table.column("chunk")[:1], "part": pa.array([0], pa.int32()), "task": table.column("task")[:1], "weight": [float(total)], "values": pa.array([mean.astype(np.float32).tobytes()], pa.binary())}, schema=_PART)


class Grown:
    """An array that grows by halves."""

    def __init__(self, kind: type, start: list) -> None:
        self.room, self.n = np.array([*start, *[0] * 1024], kind), len(start)

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.room):
            self.room = np.concatenate((self.all, np.empty(self.n // 2 + 2 * len(more), self.room.dtype)))
        self.room[self.n : self.n + len(more)] = more
        self.n += len(more)


class IdCounts:
    """How often raw ids are met: words are matched when they are met first, and counted by number until ``totals``."""

    MOST = 500_000

    def __init__(self, size: int) -> None:
        self.done, self.size = np.zeros(size, np.int64), size
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.stops, self.times = Grown(np.int32, []), Grown(np.int64, [0]), Grown(np.float64, [])

    def count(self, words: np.ndarray, times: np.ndarray, match) -> None:
        """Distinct words in order and their counts; ``match`` gives the ids of those at some of their places."""
        at = np.searchsorted(self.hashes, words)
        known = np.zeros(len(words), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == words
        self.times.all[self.numbers[at[known]]] += times[known]
        new = np.flatnonzero(~known)
        if len(new):
            ids, stops = match(new)
            self.hashes = np.insert(self.hashes, at[new], words[new])
            self.numbers = np.insert(self.numbers, at[new], self.times.n + np.arange(len(new)))
            self.stops.add(self.ids.n + stops[1:])
            self.ids.add(ids)
            self.times.add(times[new])

    def first(self, words: np.ndarray) -> np.ndarray:
        """The first raw id of words counted since the last totals."""
        return self.ids.all[self.stops.all[self.numbers[np.searchsorted(self.hashes, words)]]]

    def totals(self) -> np.ndarray:
        self.done += np.bincount(self.ids.all, np.repeat(self.times.all, np.diff(self.stops.all)), self.size).astype(np.int64)
        self._clear()
        return self.done


def _ask(tokenizer_path: str):
    """The distinct words of each block met, and how often training texts have them; without a block, raw ids and how often all training words have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Words.forget()
        subwords = subwords_of(tokenizer_path)
        seen = IdCounts(subwords.size)
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        rows = 0

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            words, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return words, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)

        def say() -> Iterator[pa.RecordBatch]:
            for block, parts in held.items():
                words, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block, np.int64)), pa.array(words.view(np.int64)), pa.array(seen.first(words)), pa.array(n)], names=ASKED.names)
            held.clear()

        for b in batches:
            blocks = b.column(0).to_numpy()
            train = b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            for owners, group in _vec.pieces(as_bytes(b.column(2))):
                raw, starts, ends, hashes, at = _vec.word_spans(group)
                if not len(hashes):
                    continue
                owner = np.repeat(np.array(owners), np.diff(at))
                words, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                weight = train[owner]
                seen.count(words, np.bincount(inverse, weight, len(words)), lambda new, where=where, raw=raw, starts=starts, ends=ends: subwords.of_words(np.frombuffer(raw, np.uint8), starts[where[new]], ends[where[new]]))
                met, of = np.unique(blocks[np.array(owners)], return_inverse=True)
                key = np.repeat(of, np.diff(at)) * len(words) + inverse
                size = len(met) * len(words)
                present, n = np.bincount(key, minlength=size).reshape(len(met), -1), np.bincount(key, weight, size).reshape(len(met), -1)
                for k, block in enumerate(met.tolist()):
                    use = np.flatnonzero(present[k])
                    parts = held.setdefault(block, [])
                    parts.append((words[use], n[k, use]))
                    rows += len(use)
                    if len(parts) > 24:
                        held[block] = [merged(parts)]
            if rows > 8_000_000 or seen.times.n > IdCounts.MOST:
                yield from say()
                seen.totals()
                rows = 0
        yield from say()
        total = seen.totals()
        give_back()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(at), pa.nulls(len(at), pa.int32()), pa.array(total[at])], names=ASKED.names)

    return run


class Lookup:
    """Places of hashes in a sorted array that holds them, by their leading bits and then a few steps."""

    def __init__(self, known: np.ndarray) -> None:
        bits = max(1, int(len(known)).bit_length())
        self.known, self.shift = known, np.uint64(64 - bits)
        self.first = np.searchsorted(known, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = self.first[(hashes >> self.shift).astype(np.int64)]
        off = np.flatnonzero(self.known[at] != hashes)
        while len(off):
            at[off] += 1
            off = off[self.known[at[off]] != hashes[off]]
        return at


class Words:
    """What a process knows of words under a model, from block to block: what is seen of them, what begins them, the value of the rest.

    It only spares work; beyond ``MOST`` words it starts anew.
    """

    MOST = 500_000
    _last: tuple[int, Words] | None = None

    def __init__(self) -> None:
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.context, self.stops, self.begins, self.rest = Grown(np.int16, []), Grown(np.int64, [0]), Grown(np.int16, []), Grown(np.float32, [])
        self.fresh: list[np.ndarray] = []

    @classmethod
    def of(cls, model: Model) -> Words:
        key = zlib.crc32(pack(model.params).tobytes(), zlib.crc32(model.met.tobytes()))
        if cls._last is None or cls._last[0] != key or len(cls._last[1].hashes) > cls.MOST:
            cls._last = (key, cls())
        return cls._last[1]

    @classmethod
    def forget(cls) -> None:
        cls._last = None

    def find(self, known: np.ndarray) -> np.ndarray:
        """The numbers of words, -1 where one is new."""
        if not len(self.hashes):
            return np.full(len(known), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, known), len(self.hashes) - 1)
        return np.where(self.hashes[at] == known, self.numbers[at], -1)

    def add(self, hashes: np.ndarray, context: np.ndarray, cuts: np.ndarray, begins: np.ndarray, rest: np.ndarray) -> np.ndarray:
        numbers = self.begins.n + np.arange(len(hashes))
        self.stops.add(self.context.n + cuts[1:])
        self.context.add(context)
        self.begins.add(begins)
        self.rest.add(rest)
        self.fresh.append(hashes)
        return numbers

    def settle(self) -> None:
        """Let new words be found."""
        self.hashes = np.concatenate((self.hashes, *self.fresh))
        self.numbers = np.concatenate((self.numbers, np.arange(len(self.numbers), self.begins.n)))
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.numbers, self.fresh = self.hashes[order], self.numbers[order], []


def score_block(texts: list[bytes], known: np.ndarray, count: np.ndarray, ends: int, bottom: float, tokenizer_path: str, model: Model | None) -> list[np.ndarray]:
    """Tokens, known tokens, base score and model score of each text.

    ``known``: the texts' word hashes in order, with how often training texts have them (``count``); ``ends``:
    training texts; ``bottom``: the denominator of the base probabilities.
    """
    value, hit = np.log10((count + SMOOTH) / bottom), count > 0
    n = len(texts)
    tokens, n_known = np.ones(n, np.int64), np.full(n, int(ends > 0), np.int64)
    base, own = np.full(n, float(np.log10((ends + SMOOTH) / bottom))), np.zeros(n)
    find = Lookup(known)
    if model:
        subwords, scorer = subwords_of(tokenizer_path), Scorer(model.params)
        words = Words.of(model)
        number = words.find(known)
        before = np.full((n, WINDOW), PAD, np.int64)  # what stands before each text's next word
        before[:, -1] = END

    for owners, group in _vec.pieces(texts):
        raw, starts, stops_at, hashes, at = _vec.word_spans(group)
        word = find(hashes)
        per_word = [value[word], hit[word]]
        if model:
            unmet = np.flatnonzero(number[word] < 0)
            fresh, where = np.unique(word[unmet], return_index=True)
            if len(fresh):
                where = unmet[where]
                ids, cuts = subwords.of_words(np.frombuffer(raw, np.uint8), starts[where], stops_at[where])
                context, output = model.context[ids].astype(np.int64), model.output[ids].astype(np.int64)
                head = ids[cuts[:-1]]
                inner = scorer(*inner_line(context, output, cuts), INNER).astype(np.float64) / np.log(10) + model.rare[ids]
                inner = np.add.reduceat(inner, cuts[:-1]) - model.rare[head]
                unseen = np.where(model.met[head] > 0, model.unseen, 1.0)
                rest = model.rare[head] + np.log10((1 - unseen) * count[fresh] / np.maximum(1, model.met[head]) + unseen * 10 ** np.maximum(inner, -250))
                whole, as_whole = model.whole_words(known[fresh])
                number[fresh] = words.add(known[fresh], context, cuts, np.where(whole, as_whole, output[cuts[:-1]]), np.where(whole, 0.0, rest))
            mine = number[word]
            seen, lengths = gather(words.context.all, words.stops.all, mine)
            seen = seen.astype(np.int64)
            bounds = np.concatenate(([0], np.cumsum(lengths)))
            line = []
            for k, i in enumerate(owners):
                line += [before[i].copy(), seen[bounds[at[k]] : bounds[at[k + 1]]]]
                if at[k + 1] > at[k]:
                    before[i] = np.concatenate((before[i], line[-1][-WINDOW:]))[-WINDOW:]
            places = bounds[:-1] + np.repeat((np.arange(len(owners)) + 1) * WINDOW, np.diff(at))
            per_word.append(scorer(np.concatenate(line), places, words.begins.all[mine].astype(np.int64), FIRST) / np.log(10) + words.rest.all[mine])
        sums = [np.concatenate(([0], np.cumsum(x))) for x in per_word]
        for k, i in enumerate(owners):
            a, b = at[k], at[k + 1]
            tokens[i] += b - a
            base[i] += sums[0][b] - sums[0][a]
            n_known[i] += sums[1][b] - sums[1][a]
            if model:
                own[i] += sums[2][b] - sums[2][a]
    if model and n:
        own += scorer(before.reshape(-1), (np.arange(n) + 1) * WINDOW, np.full(n, END), FIRST) / np.log(10)
        words.settle()
    return [tokens, n_known, base, own if model else base.copy()]


def score_texts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_STEPS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every whole text.

    Tokens are the lower-cased words and one end. ``base_score`` is the smoothed unigram score over the
    counts of all training texts (crc32 of the id modulo 10 not 0; a null id trains); ``score`` the log10
    probability under the attention model. Null and empty texts hold the end only; texts of any length are scored
    whole, in pieces that see what stands before them; repeated rows score alike; without training texts the score is the base score; an empty table gives an empty one; other
    columns are ignored.
    """
    spark = docs.sparkSession
    texts = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.input_file_name().alias("file"), F.input_file_block_start().alias("split"))
    texts = texts.withColumn("held_out", fold() == 0)
    sizes = texts.groupBy("file", "split").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.when(~F.col("held_out"), 1)).alias("ends"), F.count("*").alias("n"))
    stats = sizes.agg(F.max("bytes").alias("most"), F.sum("ends").alias("ends"), F.sum("n").alias("n")).first()
    if not stats["n"]:
        return spark.createDataFrame([], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    parts = max(1, -(-int(stats["most"] or 0) // BLOCK_BYTES))
    block = F.xxhash64("file", "split", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.octet_length("text"), F.crc32(F.col("text").cast("binary"))), F.lit(parts)))
    texts = texts.withColumn("block", block).select("block", "doc_id", "held_out", "text")

    asked = texts.select("block", (~F.col("held_out")).alias("train"), "text").mapInArrow(_ask(tokenizer_path), ASKED).repartition("word")
    # a block may be asked for in several tasks: the rows of one word and block add up. Rows without a block count raw ids
    same = Window.partitionBy("word")
    totals = asked.withColumns({"c": F.sum(F.when(F.col("block").isNotNull(), F.col("n"))).over(same), "lead": F.min("block").over(same)})
    found = written(totals.select("block", "word", "first", "n", "c", (F.col("block") == F.col("lead")).alias("lead")), "words")
    vocabulary = found.filter("block is not null")
    counted = vocabulary.agg(F.sum("n").alias("n")).first()["n"] or 0
    types = vocabulary.filter("c > 0 and lead").select("word", "c", "first").distinct()
    n_types = types.agg(F.count("*").alias("n"), F.count(F.when(F.col("c") == 1, 1)).alias("once")).first()
    ends = int(stats["ends"])
    train_tokens, distinct = int(counted) + ends, int(n_types["n"]) + (ends > 0)
    ids = found.filter("block is null").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    subwords = subwords_of(tokenizer_path)
    counts = np.zeros(subwords.size)
    counts[ids.column("word").to_numpy()] = ids.column("n").to_numpy()
    top = types.orderBy(F.desc("c"), "word").limit(WHOLE).toArrow()
    whole = [top.column(k).to_numpy() for k in range(3)]
    blank = blank_model(counts, subwords.first, n_types["once"] / max(1, int(counted) - int(whole[1].sum())), whole[0].view(np.uint64), whole[1], whole[2].astype(np.int64))
    model = train_model(texts.filter("not held_out").select("doc_id", "text"), blank, whole[1], ends, tokenizer_path, least, rounds)
    given = spark.sparkContext.broadcast(model)
    bottom = train_tokens + SMOOTH * (distinct + 1)

    def score(block_texts: pa.Table, words: pa.Table) -> pa.Table:
        one_thread()
        known, first = np.unique(words.column("word").to_numpy().view(np.uint64), return_index=True)
        count = words.column("c").to_numpy()[first]
        del words
        columns = score_block(as_bytes(block_texts.column("text").combine_chunks()), known, count, ends, bottom, tokenizer_path, given.value)
        return pa.table([block_texts.column("doc_id"), block_texts.column("held_out"), *map(pa.array, columns)], names=SCORES.names)

    scored = texts.groupBy("block").cogroup(vocabulary.select("block", "word", "c").groupBy("block")).applyInArrow(score, SCORES)
    return scored.withColumn("train_tokens", F.lit(train_tokens).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
