"""Token counts: Arrow functions that encode byte-balanced batches with a public tokenizer and return lengths only.

Texts are split at safe boundaries, where no token can span: before a single space that stands
between two non-space characters. So what stands between two of them has one number of tokens wherever it
stands, and a process encodes it once. A text without such a place is encoded in one piece.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._frames import per_batch, pick

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
)


def safe_pieces(text: str, limit: int) -> list[str]:
    """Pieces of at least ``limit`` characters whose encodings, one after another, are the text's encoding.

    The cut is before U+0020 with a non-space before and after it: byte-level pre-tokenizers never join
    a word to the space that follows it, and a space before a non-space always opens a new pre-token.
    """
    pieces, at, n = [], 0, len(text)
    while n - at > 2 * limit:
        cut = text.find(" ", at + limit)
        while 0 <= cut < n - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if not 0 <= cut < n - 1:
            break
        pieces.append(text[at:cut])
        at = cut
    pieces.append(text[at:])
    return pieces


#: A safe boundary; it begins with the space, which is searched for fastest.
_BOUNDARY = re.compile(r" (?<=\S )(?=\S)")


class _Known(dict):
    """Numbers of what stands behind the space of a boundary; new ones are noted in ``fresh``."""

    #: Beyond so many, or so many characters, all are forgotten.
    MOST, CHARS = 300_000, 1 << 24

    def __init__(self) -> None:
        self.fresh: list[str] = []
        self.tokens, self.chars = np.zeros(0, np.int64), 0

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = len(self)
        return self[word]

    def learn(self, lengths: Callable[[list[str]], np.ndarray]) -> None:
        if self.fresh:
            self.tokens = np.concatenate((self.tokens, lengths([" " + w for w in self.fresh])))
            self.chars += sum(map(len, self.fresh))
            self.fresh = []


@lru_cache(2)
def _counter(path: str, piece: int, batch_bytes: int) -> Callable[[list[str]], np.ndarray]:
    """A function from texts to token counts, with the library that fits the file; one per process, so that words stay known from task to task."""
    if str(path).endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: np.array([len(x) for x in sp.encode(texts, num_threads=1)] if texts else [], np.int64)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()

    # Only a byte-level pre-tokenizer without normaliser is known to have these boundaries; others get whole texts.
    pre = tok.pre_tokenizer
    splits = tok.normalizer is None and type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space
    splits = splits and not any(t.lstrip or t.rstrip or len(t.content.split()) != 1 or t.content.strip() != t.content for t in tok.get_added_tokens_decoder().values())

    def lengths(texts: list[str]) -> np.ndarray:
        out, held, load = [], [], 0
        for t in texts:
            held.append(t)
            load += len(t) if t.isascii() else len(t.encode())
            if load >= batch_bytes:
                out += map(len, tok.encode_batch_fast(held, add_special_tokens=False))
                held, load = [], 0
        out += map(len, tok.encode_batch_fast(held, add_special_tokens=False)) if held else ()
        return np.array(out, np.int64)

    if not splits:
        return lengths
    known = _Known()

    def count(texts: list[str]) -> np.ndarray:
        nonlocal known
        if len(known) > _Known.MOST or known.chars > _Known.CHARS:
            known = _Known()
        heads, owners, numbers = [], [], []
        for i, t in enumerate(texts):
            for p in safe_pieces(t, piece) if len(t) > 2 * piece else [t]:
                words = _BOUNDARY.split(p)
                heads.append(words[0])
                owners.append(i)
                numbers.append(np.fromiter(map(known.__getitem__, islice(words, 1, None)), np.int64, len(words) - 1))
        known.learn(lengths)
        out = np.zeros(len(texts), np.int64)
        np.add.at(out, owners, lengths(heads) + np.array([known.tokens[n].sum() for n in numbers], np.int64))
        return out

    return count


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", piece: int = 1 << 15, batch_bytes: int = 1 << 18) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit`` (n_tokens > ``limit``).

    Null and empty texts have 0 bytes and 0 tokens; null ids stay null; repeated rows give repeated
    results; an empty table gives an empty one; other columns are ignored. Narrow: no shuffle.
    """

    def build():
        count = _counter(tokenizer_path, piece, batch_bytes)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            text = pc.fill_null(b.column(1), "")
            n_bytes = pc.binary_length(text.cast(pa.binary())).cast(pa.int64())
            n = count(text.to_pylist())
            return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), n_bytes, pa.array(n, pa.int64()), pa.array(n > limit)], names=SCHEMA.names)

        return step

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(per_batch(build), SCHEMA)
