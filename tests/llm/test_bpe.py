"""Byte-level BPE of many words at once against the tokenizers library."""

import hashlib
import random

import pytest
import regex

from corrgrid.llm import bpe

SIGNS = ["a", "Z", "é", "ß", "Ж", "ӿ", "0", "²", "½", "٣", "'", "'s", "'ll", "'S", ",", ".", "_", "-", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\x00", "ing", "tion", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_vocabulary())
    lib.no_truncation()
    lib.no_padding()
    return lib


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def invented(n, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("thanreowi") for _ in range(rng.randint(1, longest))) for _ in range(n)]


def odd_texts(n, seed, more=()):
    rng = random.Random(seed)
    return ["".join(rng.choice([*SIGNS, *more]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def check(lib, texts):
    got = list(bpe.Digests(bpe.codec(bpe.default_vocabulary())).batch(texts))
    for t, found in zip(texts, got, strict=True):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert found == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))), t


def test_short_words_take_no_turns_of_their_own(library, monkeypatch):
    """Proposals and merges of short words are made for all of them together."""
    c = bpe.Codec(bpe.default_vocabulary())

    def alone(*_):
        raise AssertionError("a short word was encoded on its own")

    monkeypatch.setattr(c, "merge_exactly", alone)
    monkeypatch.setattr(c, "propose", alone)
    words = sorted({w for w in invented(4000, 60, 1)})
    assert c.encode_batch(words) == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_both_sides_of_every_width(library):
    words = [w[:n] for n in (1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 65, 200) for w in (invented(1, 200, n)[0] * 200, "é" * 200, "ab" * 100, "a" * 200)]
    check(library, words + [" ".join(words)])


def test_odd_texts(library):
    check(library, odd_texts(600, 2) + odd_texts(200, 3, ["日", "🎉", "՘", "\u2028", "\u3000"]))


def test_words_of_old_characters_are_the_patterns(library):
    c, slow = bpe.codec(bpe.default_vocabulary()), regex.compile(bpe.PATTERN)
    every = "".join(f"{chr(i)}{a}{chr(i)}" for i in range(bpe.OLD_UNICODE) for a in ("", " ", "a", "1", "."))
    for t in [every, *(s for s in odd_texts(2000, 4))]:
        assert c.pieces(t) == slow.findall(t)


def test_full_caches_keep_the_words_at_hand(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    monkeypatch.setattr(bpe, "TOGETHER", 7)
    c = bpe.codec(bpe.default_vocabulary())
    d = bpe.Digests(c)
    for seed in range(8):
        texts = [" ".join(invented(20, 6, seed)), "the end of it", " ".join(invented(10, 3, 99))]
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [found[:2] for found in d.batch(texts)] == [(len(ids), sha(",".join(map(str, ids)))) for ids in want]
        assert c.encode_batch(texts) == want
        assert {w for t in texts for w in c.pieces(t)} <= d.ids.keys() == d.raw.keys() and len(d.ids) <= 50
