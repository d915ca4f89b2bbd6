"""Byte-level BPE: speculate and verify.

Greedy longest match proposes the tokens of a word. A proposal is right exactly if BPE would keep
every adjacent pair of its tokens apart, so all distinct pairs of a batch are tested at once in
NumPy by undoing the two tokens' merges along the border, latest first; only words with a failing
pair are merged exactly. Proposals and merges of short words are made for all words of a batch
at once; long words take their turn one by one. Words repeat, so each task keeps a bounded cache of
finished words. Documents are independent rows: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrgrid.llm.common import forget_lru, kept_in_workers, own_worker, small_batches, trim

#: Fixed value: the pre-tokenizer's word pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept by each task; beyond it those that the texts at hand do not hold are dropped.
CACHE_WORDS = 200_000
#: Words up to this many bytes are encoded together in NumPy, by the width of the matrix that holds them.
WIDTHS = (8, 16, 32, 64)
#: So many words at a time, which bounds the arrays of one very long text.
TOGETHER = 1 << 16
#: No merge: later than all others.
NEVER = np.iinfo(np.int32).max
#: Characters below this are classed alike by all Unicode versions at hand; texts with others are split
#: by the tokenizers library's own pre-tokenizer.
OLD_UNICODE = 0x500
NEW = re.compile(f"[{chr(OLD_UNICODE)}-\U0010ffff]")


def _old_pattern() -> re.Pattern[str]:
    """PATTERN for old characters, with their classes written out and the words of letters tried first: no other
    kind of word begins with a letter or a space and a letter."""

    def members(kind: str) -> str:
        found = [i for i in range(OLD_UNICODE) if regex.match(kind, chr(i))]
        return "".join(f"\\u{i:04x}" for i in found)

    letter, number, space = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    return re.compile(rf" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{space}{letter}{number}]+| ?[{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the rest follows from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder for one vocabulary file of byte-level BPE (ids in merge order)."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        alphabet, vocab = _byte_alphabet(), spec["model"]["vocab"]
        self.raw = {token: bytes(alphabet[c] for c in token) for token in vocab}
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of = [b""] * size
        self.id_of: dict[bytes, int] = {}
        for token, i in vocab.items():
            self.bytes_of[i] = self.raw[token]
            self.id_of[self.raw[token]] = i
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.specials.items():
            self.bytes_of[i] = content.encode()
        self.left, self.right = np.arange(size), np.arange(size)
        self.merge: dict[tuple[int, int], int] = {}
        for pair in spec["model"]["merges"]:
            a, b = (vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            c = vocab[(pair.replace(" ", "") if isinstance(pair, str) else "".join(pair))]
            self.merge[a, b] = c
            self.left[c], self.right[c] = a, b
        keys = np.array([a * size + b for a, b in self.merge], dtype=np.int64)
        order = np.argsort(keys)
        self.size, self.keys, self.merged = size, keys[order], np.fromiter(self.merge.values(), np.int64, len(self.merge))[order]
        self.longest: dict[bytes, int] = {}
        for b in self.id_of:
            self.longest[b[:2]] = max(self.longest.get(b[:2], 0), len(b))
        self.byte_ids = np.array([self.id_of[bytes([b])] for b in range(256)], np.int32)
        self.byte_pairs = self.merges_of(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))
        self.make_trie()
        self.shown = [str(i) for i in range(size)]
        self.split = _old_pattern()
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.words: dict[str, tuple[int, ...]] = {}
        self.fallback = None

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        out, at, n, id_of, longest = [], 0, len(word), self.id_of, self.longest
        while at < n:
            end = min(n, at + longest.get(word[at : at + 2], 1))
            while (found := id_of.get(word[at:end])) is None:
                end -= 1
            out.append(found)
            at = end
        return out

    def make_trie(self) -> None:
        """The tokens' bytes as a trie in flat arrays: node n's child by byte b stands at start[n] + b if of[there] is n."""
        children: list[dict[int, int]] = [{}]
        token = [-1]
        for raw, i in self.id_of.items():
            node = 0
            for b in raw:
                if (found := children[node].get(b)) is None:
                    children[node][b] = found = len(children)
                    children.append({})
                    token.append(-1)
                node = found
            token[node] = i
        start, slots, begin = [0] * len(children), {}, {}
        for node in sorted(range(len(children)), key=lambda n: -len(children[n])):
            if not (below := children[node]):
                break
            at = begin.get(len(below), 0)
            while any(at + b in slots for b in below):
                at += 1
            begin[len(below)] = at  # nodes of as many children rarely fit further left
            start[node] = at
            slots.update((at + b, (node, child)) for b, child in below.items())
        size = max(start) + 257 + 1
        self.start, self.token = np.array(start, np.int32), np.array(token, np.int32)
        self.of, self.child = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        at = np.fromiter(slots, np.int64, len(slots))
        self.of[at], self.child[at] = np.array(list(slots.values()), np.int32).T

    def propose_together(self, flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of many words: where they start in flat, and their tokens. flat: the words' bytes,
        each word followed by 256, which no token holds; first: where the words start."""
        best, length = np.zeros(len(flat), np.int32), np.ones(len(flat), np.int32)
        live = np.flatnonzero(flat < 256)
        node, depth = np.zeros(len(live), np.int32), 0
        while len(live):
            at = self.start[node] + flat[live + depth]
            on = self.of[at] == node
            live, node = live[on], self.child[at[on]]
            depth += 1
            ends = (found := self.token[node]) >= 0
            best[live[ends]], length[live[ends]] = found[ends], depth
        starts, at = np.zeros(len(flat), bool), first
        while len(at):
            starts[at] = True
            at = at + length[at]
            at = at[flat[at] < 256]
        at = np.flatnonzero(starts)
        return at, best[at]

    def merges_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """What each pair of tokens merges to, or NEVER."""
        key = x.astype(np.int64) * self.size + y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NEVER).astype(np.int32)

    def merge_together(self, raw: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BPE by merge order of many words, one merge of every word a round: the first of its earliest merges.
        raw: a word's bytes a row, padded; the tokens come back as rows padded with -1, with their numbers."""
        n, width = raw.shape
        out, counts = np.full((n, width), -1, np.int32), length.copy()
        place, row = np.arange(width + 1), np.arange(n)
        ids, pair = np.full((n, width + 1), -1, np.int32), np.full((n, width + 1), NEVER, np.int32)
        ids[:, :width] = np.where(place[:width] < length[:, None], self.byte_ids[raw], -1)
        pair[:, : width - 1] = np.where(place[1:width] < length[:, None], self.byte_pairs[raw[:, :-1].astype(np.int32) * 256 + raw[:, 1:]], NEVER)
        while len(row):
            at = pair.argmin(axis=1)
            made = pair[np.arange(len(row)), at]
            if len(done := np.flatnonzero(made == NEVER)):
                out[row[done]] = ids[done, :width]
                on = made != NEVER
                row, ids, pair, at, made = row[on], ids[on], pair[on], at[on], made[on]
            if not len(row):
                break
            counts[row] -= 1
            after, every = place[:width] > at[:, None], np.arange(len(row))
            ids[:, :width], pair[:, :width] = np.where(after, ids[:, 1:], ids[:, :width]), np.where(after, pair[:, 1:], pair[:, :width])
            ids[every, at] = made
            pair[every, at] = NEVER
            # The new token's pairs with its neighbours.
            has = np.flatnonzero((right := ids[every, at + 1]) >= 0)
            pair[has, at[has]] = self.merges_of(made[has], right[has])
            has = np.flatnonzero(at > 0)
            pair[has, at[has] - 1] = self.merges_of(ids[has, at[has] - 1], made[has])
        return out, counts

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair whether BPE of the two tokens' bytes gives back the pair."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        result, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y, most = a[live], b[live], limit[live]
            at = np.minimum(np.searchsorted(self.keys, key := x * self.size + y), len(self.keys) - 1)
            across = (self.keys[at] == key) & (self.merged[at] < most)
            result[live[across]] = False
            # Undo the later of the two merges; a token that is a single byte cannot be undone.
            x_open, y_open = self.right[x] != x, self.left[y] != y
            undo_x = x_open & ((x > y) | ~y_open)
            undo_y = y_open & ~undo_x
            limit[live] = np.where(undo_x, x, np.where(undo_y, y + 1, most))
            a[live], b[live] = np.where(undo_x, self.right[x], x), np.where(undo_y, self.left[y], y)
            live = live[~across & (undo_x | undo_y)]
        return result

    def merge_exactly(self, word: bytes) -> list[int]:
        """BPE by merge order with a heap over a linked list: O(n log n) for any length."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        nxt, prv = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(c, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (c := self.merge.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            c, i, x, y = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != x or j >= len(ids) or ids[j] != y:
                continue
            ids[i], ids[j], nxt[i] = c, -1, nxt[j]
            if nxt[i] < len(ids):
                prv[nxt[i]] = i
                if (d := self.merge.get((c, ids[nxt[i]]))) is not None:
                    heapq.heappush(heap, (d, i, c, ids[nxt[i]]))
            if prv[i] >= 0 and (d := self.merge.get((ids[prv[i]], c))) is not None:
                heapq.heappush(heap, (d, prv[i], ids[prv[i]], c))
        return [x for x in ids if x >= 0]

    def verified(self, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Which of n words' proposals BPE would keep; flat: their tokens, owner: the tokens' words in order."""
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner].astype(np.int64) * self.size + flat[inner + 1], return_inverse=True)
        right = np.ones(n, bool)
        right[owner[inner[~self.compatible(pairs // self.size, pairs % self.size)[back]]]] = False
        return right

    def encoded(self, words: Iterable[str]) -> Iterator[tuple[list[str], list[int], list[int]]]:
        """The words in groups, each with its words' tokens end to end and with where each word's tokens end."""
        words = list(words)
        for start in range(0, len(words), TOGETHER):
            yield from self.encoded_together(words[start : start + TOGETHER])

    def encoded_together(self, words: list[str]) -> Iterator[tuple[list[str], list[int], list[int]]]:
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        short, long = np.flatnonzero(size <= WIDTHS[-1]), np.flatnonzero(size > WIDTHS[-1])
        if len(short):
            yield from self.encoded_short([words[i] for i in short], [raw[i] for i in short], size[short])
        if len(long):
            proposed = [self.propose(raw[i]) for i in long]
            counts = np.array([len(p) for p in proposed])
            flat = np.fromiter((i for p in proposed for i in p), np.int64, int(counts.sum()))
            right = self.verified(flat, np.repeat(np.arange(len(long)), counts), len(long))
            for i, p, good in zip(long, proposed, right, strict=True):
                ids = p if good else self.merge_exactly(raw[i])
                yield [words[i]], ids, [len(ids)]

    def encoded_short(self, words: list[str], raw: list[bytes], size: np.ndarray) -> Iterator[tuple[list[str], list[int], list[int]]]:
        first = np.cumsum(size + 1) - size - 1
        flat = np.full(int(size.sum()) + len(words), 256, np.int32)
        owner = np.repeat(np.arange(len(words)), size)
        flat[np.arange(len(owner)) + owner] = np.frombuffer(b"".join(raw), np.uint8)
        at, tokens = self.propose_together(flat, first)
        owner = np.searchsorted(first, at, side="right") - 1
        right = self.verified(tokens, owner, len(words))
        group = lambda which, ids, counts: ([words[i] for i in which.tolist()], ids.tolist(), np.cumsum(counts).tolist())
        yield group(np.flatnonzero(right), tokens[right[owner]], np.bincount(owner, minlength=len(words))[right])
        for least, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            some = np.flatnonzero(~right & (size > least) & (size <= width))
            if len(some):
                bytes_of = flat[np.minimum(first[some, None] + np.arange(width), len(flat) - 1)].astype(np.uint8)
                ids, counts = self.merge_together(bytes_of, size[some])
                yield group(some, ids[ids >= 0], counts)

    def learn(self, words: Iterable[str]) -> None:
        """Encode words that the cache lacks."""
        for group, ids, ends in self.encoded(words):
            for w, start, end in zip(group, [0, *ends], ends, strict=False):
                self.words[w] = tuple(ids[start:end])

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or not NEW.search(text):
            return self.split.findall(text)
        if self.fallback is None:
            from tokenizers import pre_tokenizers

            self.fallback = pre_tokenizers.ByteLevel(add_prefix_space=False)
        return [text[a:b] for _, (a, b) in self.fallback.pre_tokenize_str(text)]

    def segments(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        """Runs of ordinary words, each followed by a special token's id or, at the end, None."""
        parts = self.special_split.split(text) if self.special_split and any(s in text for s in self.specials) else [text]
        for i in range(0, len(parts), 2):
            yield self.pieces(parts[i]), self.specials[parts[i + 1]] if i + 1 < len(parts) else None

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        split = [list(self.segments(t)) for t in texts]
        self.ensure(split)
        out = []
        for segments in split:
            ids: list[int] = []
            for words, special in segments:
                for w in words:
                    ids += self.words[w]
                ids += [special] if special is not None else []
            out.append(ids)
        return out

    def ensure(self, split: list[list[tuple[list[str], int | None]]]) -> None:
        need = {w for segments in split for words, _ in segments for w in words}
        new = need - self.words.keys()
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words = {w: self.words[w] for w in need - new}
        if new:
            self.learn(new)

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


class Digests:
    """Token numbers and digests of texts; of each word its ids as text and the bytes that they decode to are kept."""

    def __init__(self, codec: Codec) -> None:
        self.codec = codec
        self.ids: dict[str, str] = {}
        self.raw: dict[str, bytes] = {}

    def ensure(self, split: list[list[tuple[list[str], int | None]]]) -> None:
        need = set().union(*(words for segments in split for words, _ in segments))
        new = need - self.ids.keys()
        if len(self.ids) + len(new) > CACHE_WORDS:
            self.ids = {w: self.ids[w] for w in need - new}
            self.raw = {w: self.raw[w] for w in self.ids}
        for group, ids, ends in self.codec.encoded(new):
            shown, raw = [self.codec.shown[i] for i in ids], [self.codec.bytes_of[i] for i in ids]
            for w, start, end in zip(group, [0, *ends], ends, strict=False):
                self.ids[w], self.raw[w] = ",".join(shown[start:end]), b"".join(raw[start:end])

    def batch(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text its number of tokens and the digests of its ids and of the text that they decode to."""
        split = [list(self.codec.segments(t)) for t in texts]
        self.ensure(split)
        for segments in split:
            ids: list[str] = []
            raw: list[bytes] = []
            for words, special in segments:
                ids += map(self.ids.__getitem__, words)
                raw += map(self.raw.__getitem__, words)
                if special is not None:
                    ids.append(self.codec.shown[special])
                    raw.append(self.codec.bytes_of[special])
            joined = ",".join(ids)
            yield joined.count(",") + 1 if joined else 0, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(b"".join(raw).decode("utf-8", "replace").encode()).hexdigest()


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    made = Codec(path)
    trim()  # what reading the vocabulary took
    return made


kept_in_workers("bpe", lambda: forget_lru(codec))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _chunks(batch: pa.RecordBatch, budget: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Texts of a batch in runs of bounded length."""
    start, texts, size = 0, [], 0
    for i, x in enumerate(batch.column("text")):
        t = x.as_py() or ""
        texts.append(t)
        size += len(t)
        if size >= budget:
            yield start, texts
            start, texts, size = i + 1, [], 0
    if texts:
        yield start, texts


def encode_documents(docs: DataFrame, vocabulary: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded: token ids of each whole text and the text that they decode to.

    Special tokens in a text are recognised, none is added. Null and empty texts give no ids and an
    empty text; repeated rows are encoded each; empty tables give no rows; further columns are ignored.
    """
    path = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("bpe")
        c = codec(path)
        for batch in batches:
            for start, texts in _chunks(batch):
                ids = c.encode_batch(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids])], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, vocabulary: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_documents, without moving the ids."""
    path = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("bpe")
        digests = Digests(codec(path))
        for batch in batches:
            for start, texts in _chunks(batch):
                n, ids, decoded = zip(*digests.batch(texts), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
