import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillspark.llm import bpe, counts

TOK = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOK)


def texts():
    rng = random.Random(1)
    chars = [chr(c) for c in [*range(0, 0x250), *range(0x2000, 0x2070), 0x3000, 0x4E00, 0x1F600, 0x660, 0xBD, 0x300, 0x558, 0x1C89]]
    out = ["", " ", "a b", "a<|endoftext|>b <|endoftext|>", "\x1c\x85　 x", "aaaa" * 40, "'s't'LL don't", "  \n\n x\t ", "漢字かな😀😀", "=====----"]
    out += ["".join(rng.choices(chars, k=rng.randint(1, 40))) for _ in range(400)]
    out += ["".join(rng.choices("ab ensthe'\n", k=rng.randint(1, 300))) for _ in range(200)]
    return out


def test_encodes_and_decodes_as_the_library(library):
    b = bpe.SpeculativeBPE(TOK)
    for i, ids in bpe._encoded(b, texts(), piece=50, load=100):
        pass
    for t in texts():
        ids, _ = b.encode_many([t])
        want = library.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert b.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_pairs_are_verified_exactly():
    b = bpe.SpeculativeBPE(TOK)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 50256, 3000), rng.integers(0, 50256, 3000)
    assert b.compatible(x, y).tolist() == [b.merge(b.bytes_of[i] + b.bytes_of[j]) == [i, j] for i, j in zip(x, y, strict=True)]


def test_long_words_merge_exactly(library):
    b = bpe.SpeculativeBPE(TOK)
    for w in ("abcde" * 100, "x" * 777, "thethethe" * 60):
        assert b.merge(w.encode()) == library.encode(w, add_special_tokens=False).ids


def test_pieces_join_to_the_whole(library):
    for t in ("word " * 3000, "x" * 9000, " a  b" * 2000, "one\ntwo three" * 900):
        pieces = counts.safe_pieces(t, 100)
        assert "".join(pieces) == t
        assert sum((library.encode(p, add_special_tokens=False).ids for p in pieces), []) == library.encode(t, add_special_tokens=False).ids


def test_on_spark(docs, corpus, library):
    digests = {r.doc_id: r for r in bpe.bpe_digests(docs, TOK).collect()}
    encoded = bpe.bpe_encode(docs, TOK)
    lengths = {r.doc_id: r for r in counts.token_counts(docs, TOK, limit=50).collect()}
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    back = {r.doc_id: r.text for r in bpe.bpe_decode(encoded, TOK).collect()}
    for i, text, _ in corpus:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids[i] == want and back[i] == (text or "")
        assert digests[i].n_tokens == lengths[i].n_tokens == len(want)
        assert digests[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert lengths[i].n_bytes == len((text or "").encode()) and lengths[i].over_limit == (len(want) > 50)


def test_counts_with_sentencepiece(docs, corpus):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in counts.token_counts(docs, path).collect()}
    assert all(got[i] == len(sp.encode(t or "")) for i, t, _ in corpus)


def test_a_word_met_before_is_not_encoded_again(corpus, monkeypatch):
    """Counts are the library's whatever stands around a space, and each word goes to the library once."""
    from tokenizers import Tokenizer

    odd = ["", " ", "a", " a", "a ", "a b", "a  b", "a \n b", "a  b", "a　b c", "it 's I'm  don 't", "x <|endoftext|> y<|endoftext|> z", "\u0085 a b\u0085 c", "\x1c a \x1c b", "a\tb c\n\nd e", "1 2 3,4 -5", "日本 語😀 a", "a ​ b", "word " * 300]
    texts = [*odd, *(t or "" for _, t, *_ in corpus)]
    tok = Tokenizer.from_file(TOK)
    want = [len(tok.encode(t, add_special_tokens=False)) for t in texts]
    for piece in (1 << 15, 40):
        counts._counter.cache_clear()
        assert counts._counter(TOK, piece, 1 << 10)(texts).tolist() == want
    words = [f"river stone{i % 7} light" for i in range(500)]
    counter, sent = counts._counter(TOK, 1 << 15, 1 << 18), []
    learn = counts._Known.learn
    monkeypatch.setattr(counts._Known, "learn", lambda self, lengths: (sent.extend(self.fresh), learn(self, lengths)))
    assert counter(words).tolist() == counter(words).tolist() == [len(tok.encode(t)) for t in words]
    assert len(sent) == len(set(sent)) <= 8
    monkeypatch.setattr(counts._Known, "MOST", 0)  # what is forgotten is encoded anew
    assert counter(words).tolist() == [len(tok.encode(t)) for t in words]
