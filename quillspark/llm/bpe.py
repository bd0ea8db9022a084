"""Byte-level BPE encoding and decoding by "speculate and verify".

Greedy longest match proposes the tokens of every word not seen before; one vectorised pass over all
adjacent pairs of the proposals decides which pairs could really stand side by side in a merge result;
a word whose pairs all pass has its exact encoding already, and only the others undergo exact merging.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._frames import as_texts, per_batch, pick
from .counts import safe_pieces

#: GPT-2 style split of a text into words; white space is Unicode's White_Space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Characters that this regex library counts as letters or numbers and the tokenizers library, with an
#: older Unicode table, does not: those that Python's own table has as unassigned.
NEVER = np.int64(1 << 40)
NO_RANK = 1 << 40

ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
DECODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


#: Letters and numbers of the newest Unicode that the tokenizers library's older table doesn't have (from its
#: own split of every code point): first and last of each run.
NEWER = (
    "558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1 ab6c-ab6d "
    "107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f 12550-12686 "
    "16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 "
    "1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff "
    "2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)


@lru_cache(1)
def strict_split():
    """The split for texts beyond Latin-1, without ``NEWER``."""
    runs = [[int(x, 16) for x in r.split("-")] for r in NEWER.split()]
    out = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
    rare = regex.compile(f"[{out}]").search
    pattern = SPLIT.replace(r"[^\p{White_Space}\p{L}\p{N}]", rf"(?:[^\p{{White_Space}}\p{{L}}\p{{N}}]|[{out}])")
    pattern = pattern.replace(r"\p{L}+", rf"(?:(?![{out}])\p{{L}})+").replace(r"\p{N}+", rf"(?:(?![{out}])\p{{N}})+")
    usual, strict = regex.compile(SPLIT).findall, regex.compile(pattern).findall
    return lambda text: strict(text) if rare(text) else usual(text)


@lru_cache(4)
def shared(path: str, use_special: bool = True) -> SpeculativeBPE:
    """One encoder per process and file: its words stay known from task to task."""
    return SpeculativeBPE(path, use_special=use_special)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class SpeculativeBPE:
    """Encoder and decoder for one vocabulary file (JSON of the tokenizers library, byte-level BPE)."""

    def __init__(self, path: str, cache_words: int = 300_000, use_special: bool = True) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        model = spec["model"]
        plain = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = added if use_special else {}
        self._at_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        size = 1 + max([*plain.values(), *added.values()])
        self.bytes_of = [b""] * size
        for b, i in plain.items():
            self.bytes_of[i] = b
        for s, i in added.items():
            self.bytes_of[i] = s.encode()
        self._lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self._offsets = np.concatenate(([0], np.cumsum(self._lengths)))
        self._flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.byte_id = [plain[bytes([b])] for b in range(256)]

        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self._rank, self._left, self._right = np.full(size, -1, np.int64), np.arange(size), np.arange(size)
        names = {t: i for t, i in model["vocab"].items()}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = names[a + b]
            if (names[a], names[b]) not in self.merges:
                self.merges[names[a], names[b]] = (rank, made)
            if self._rank[made] < 0:
                self._rank[made], self._left[made], self._right[made] = rank, names[a], names[b]
        self._rank_of = {a * size + b: r for (a, b), (r, _) in self.merges.items()}
        self._made = {r: m for r, m in self.merges.values()}
        keys = np.array([a * size + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self._pair_keys, self._pair_ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self._size = size
        made = np.flatnonzero(self._rank >= 0)
        bad = set(made[~self._stable(self._left[made], self._right[made], self._rank[made])].tolist())
        known = set(self.byte_id) | set(made.tolist())
        #: Tokens that a merge can end in; only these are proposed.
        self._proposals = {b: i for b, i in plain.items() if i in known and i not in bad}
        self._longest = max(map(len, self._proposals))
        self._cache_words = cache_words
        self._split = regex.compile(SPLIT).findall
        self._reset()

    def _reset(self) -> None:
        self._index = _Index()
        self._word_ids, self._word_ends, self._words_known = np.zeros(0, np.int32), np.zeros(1, np.int64), 0
        self._pairs, self._pairs_ok = np.zeros(0, np.int64), np.zeros(0, bool)

    # verify

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self._size + b
        at = np.minimum(np.searchsorted(self._pair_keys, key), len(self._pair_keys) - 1)
        return np.where(self._pair_keys[at] == key, self._pair_ranks[at], NEVER)

    def _stable(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the bytes of a and b keeps the border between them (before rank ``until``).

        x goes down the right edge of a, y down the left edge of b, the younger of the two each time, so
        that all pairs that ever touch at the border are met. Such a pair would merge across it if its
        rank comes before x's own merge; or before y's, equal ranks included, as ties go leftmost first.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_ends = np.full(len(x), NEVER) if until is None else until.astype(np.int64)
        y_ends = np.full(len(x), NEVER - 1) if until is None else until.astype(np.int64) - 1
        ok, live = np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            u, v = x[live], y[live]
            m = self._merge_rank(u, v)
            clash = (m < x_ends[live]) & (m <= y_ends[live]) & (m < NEVER)
            ok[live[clash]] = False
            ru, rv = self._rank[u], self._rank[v]
            split_x, split_y = (ru >= 0) & (ru >= rv), (rv >= 0) & (rv > ru)
            i, j = live[split_x], live[split_y]
            x_ends[i], x[i] = self._rank[x[i]], self._right[x[i]]
            y_ends[j], y[j] = self._rank[y[j]], self._left[y[j]]
            live = live[~clash & (split_x | split_y)]
        return ok

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each adjacent pair, whether encoding its joined bytes gives just the two tokens."""
        key = a.astype(np.int64) * self._size + b
        fresh = np.unique(key)
        at = np.searchsorted(self._pairs, fresh)
        new = np.ones(len(fresh), bool)
        inside = at < len(self._pairs)
        new[inside] = self._pairs[at[inside]] != fresh[inside]
        if new.any():
            fresh, at = fresh[new], at[new]
            self._pairs_ok = np.insert(self._pairs_ok, at, self._stable(fresh // self._size, fresh % self._size))
            self._pairs = np.insert(self._pairs, at, fresh)
        return self._pairs_ok[np.searchsorted(self._pairs, key)] if len(key) else np.zeros(0, bool)

    # speculate

    def propose(self, word: bytes) -> list[int] | None:
        """Greedy longest match; None where a byte has no usable token."""
        out, at, n, get, longest = [], 0, len(word), self._proposals.get, self._longest
        while at < n:
            stop = min(n, at + longest)
            while (t := get(word[at:stop])) is None:
                stop -= 1
                if stop == at:
                    return None
            out.append(t)
            at = stop
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: the lowest rank first, the leftmost of equals, in O(n log n)."""
        ids = [self.byte_id[b] for b in word]
        n, get, size = len(ids), self._rank_of.get, self._size
        if n < 200:
            ranks = [get(a * size + b, NO_RANK) for a, b in zip(ids, ids[1:], strict=False)]
            while ranks and (rank := min(ranks)) < NO_RANK:
                i = ranks.index(rank)
                ids[i : i + 2] = [self._made[rank]]
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = get(ids[i] * size + ids[i + 1], NO_RANK)
                if i:
                    ranks[i - 1] = get(ids[i - 1] * size + ids[i], NO_RANK)
            return ids
        get = self.merges.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := get((made, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, made, ids[after[i]], m[1]))
            if (k := before[i]) >= 0 and (m := get((ids[k], made))):
                heapq.heappush(heap, (m[0], k, ids[k], made, m[1]))
        return [t for t in ids if t >= 0]

    def _learn(self) -> None:
        """Encode the words that the index met since last time."""
        fresh = [w.encode("utf-8", "surrogatepass") for w in self._index.fresh]
        self._index.fresh.clear()
        guesses = [self.propose(w) for w in fresh]
        wrong = {i for i, g in enumerate(guesses) if g is None}
        guesses = [g or [] for g in guesses]
        counts = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter(chain.from_iterable(guesses), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(guesses)), counts)
        beside = owner[1:] == owner[:-1]
        ok = self.compatible(flat[:-1][beside], flat[1:][beside])
        wrong.update(owner[1:][beside][~ok].tolist())
        if wrong:
            for i in wrong:
                guesses[i] = self.merge(fresh[i])
            counts = np.fromiter(map(len, guesses), np.int64, len(guesses))
            flat = np.fromiter(chain.from_iterable(guesses), np.int64, int(counts.sum()))
        self._word_ids = np.concatenate((self._word_ids, flat.astype(np.int32)))
        self._word_ends = np.concatenate((self._word_ends, self._word_ends[-1] + np.cumsum(counts)))
        self._words_known += len(fresh)

    # whole texts

    def _words(self, text: str) -> list[str]:
        """Words of a text; a special token is a word of its own kind."""
        if self._at_special is None or not any(s in text for s in self.special):
            return self._plain_words(text)
        out, at = [], 0
        for m in self._at_special.finditer(text):
            out += self._plain_words(text[at : m.start()])
            out.append(_Special(m.group()))
            at = m.end()
        return out + self._plain_words(text[at:])

    def _plain_words(self, text: str) -> list[str]:
        if len(text.encode("latin-1", "ignore")) == len(text):
            return self._split(text)
        return strict_split()(text)

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another (int32), and where each text's ids begin (len + 1)."""
        if len(self._index) > self._cache_words:
            self._reset()
        per_text, numbers = [], []
        look = self._index.__getitem__
        for t in texts:
            found = self._words(t)
            per_text.append(len(found))
            numbers.append(np.fromiter((self._special_number(w) if type(w) is _Special else look(w) for w in found) if self._has_special(t) else map(look, found), np.int64, len(found)))
        if self._index.fresh:
            self._learn()
        at = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        special = at < 0
        safe = np.where(special, 0, at) if special.any() else at
        if not len(self._word_ids):
            starts, lengths = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        else:
            starts, lengths = self._word_ends[safe], self._word_ends[safe + 1] - self._word_ends[safe]
        lengths = np.where(special, 1, lengths)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        where = np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
        if special.any():
            owner = np.repeat(special, lengths)
            ids = np.empty(total, np.int32)
            ids[~owner] = self._word_ids[where[~owner]] if len(self._word_ids) else 0
            ids[owner] = -1 - at[special]
        else:
            ids = self._word_ids[where] if total else np.zeros(0, np.int32)
        stops = np.concatenate(([0], ends))[np.cumsum([0, *per_text])]
        return ids, stops

    def _has_special(self, text: str) -> bool:
        return bool(self.special) and any(s in text for s in self.special)

    def _special_number(self, word: str) -> int:
        return -1 - self.special[str(word)]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        n = self._lengths[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self._flat[np.arange(total) + np.repeat(self._offsets[ids] - (ends - n), n)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


class _Special(str):
    __slots__ = ()


class _Index(dict):
    """Numbers words in the order in which they are first met."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


def _encoded(bpe: SpeculativeBPE, texts: list[str], piece: int = 1 << 16, load: int = 1 << 18):
    """Yields (text number, ids) in order; a long text gives several runs, cut where no token spans."""
    held: list[str] = []
    owners: list[int] = []
    size = 0

    def flush():
        ids, stops = bpe.encode_many(held)
        yield from ((o, ids[stops[k] : stops[k + 1]]) for k, o in enumerate(owners))

    for i, t in enumerate(texts):
        for p in safe_pieces(t, piece) if len(t) > 2 * piece else [t]:
            held.append(p)
            owners.append(i)
            size += len(p)
            if size >= load:
                yield from flush()
                held, owners, size = [], [], 0
    if held:
        yield from flush()


def bpe_encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every text; null and empty texts have no ids. Narrow: no shuffle."""

    def build():
        bpe = shared(tokenizer_path)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            runs: list[list[np.ndarray]] = [[] for _ in range(b.num_rows)]
            for i, ids in _encoded(bpe, as_texts(b.column(1))):
                runs[i].append(ids)
            flat = [np.concatenate(r) if r else np.zeros(0, np.int32) for r in runs]
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in flat]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat)))
            return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), ids], names=ENCODED.names)

        return step

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(per_batch(build), ENCODED)


def bpe_decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from lists of ids; null lists decode to the empty text, null ids within are skipped."""

    def build():
        bpe = shared(tokenizer_path)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [bpe.decode(np.array([x for x in ids or [] if x is not None], np.int64)) for ids in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=DECODED.names)

        return step

    return pick(encoded, doc_id=id_col, ids=ids_col).mapInArrow(per_batch(build), DECODED)


def bpe_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids again, and return digests of both in one pass.

    ``doc_id, n_tokens, ids_sha256`` (ids as little-endian unsigned 32-bit integers) and ``decoded_sha256``
    (the decoded text in UTF-8). Null and empty texts have no tokens; null ids stay null; repeated rows
    give repeated results; other columns are ignored; an empty table gives an empty one.
    """

    def build():
        bpe = shared(tokenizer_path)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            n = np.zeros(b.num_rows, np.int64)
            of_ids = [hashlib.sha256() for _ in range(b.num_rows)]
            of_text = [hashlib.sha256() for _ in range(b.num_rows)]
            for i, ids in _encoded(bpe, as_texts(b.column(1))):
                n[i] += len(ids)
                of_ids[i].update(ids.astype("<u4").tobytes())
                of_text[i].update(bpe.decode(ids).encode())
            columns = [b.column(0).cast(pa.int64()), pa.array(n), pa.array([h.hexdigest() for h in of_ids]), pa.array([h.hexdigest() for h in of_text])]
            return pa.RecordBatch.from_arrays(columns, names=DIGEST.names)

        return step

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(per_batch(build), DIGEST)
