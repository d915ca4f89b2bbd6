"""Best-fit decreasing packing of token sequences into windows of one size.

Overlong documents are cut into full windows and a rest. Pieces of equal length are interchangeable,
and so are open windows of equal remaining capacity, so best-fit decreasing is decided for the whole
corpus on the histogram of piece lengths (at most one entry per length up to the window): lengths
come in falling order, a segment tree indexed by remaining capacity finds the tightest open window
that takes them, and a whole range of equal windows is filled at once. The plan says which ranks of a
length go to which windows at which offset; its size depends on the window, not on the corpus. A
piece's rank among its length is the count of its task's predecessors plus a base per (length, task),
so no group is ever gathered.

Windows that stay emptier than `slack` are laid end to end and cut anew at window borders, the last
at powers of two, at which a sequence needs no padding: no sequence is padded by more than `slack`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrgrid.llm.common import BROADCAST_IDS, broadcast_if_small, forget_lru, kept_in_workers, own_worker, small_batches, staged

#: Tokens of a sequence at most, and the id that ends a document.
WINDOW, END_ID = 4096, 2
#: A window with more unused tokens than this is cut anew.
SLACK = 16
#: Words whose ids a worker keeps (beyond it the cache starts anew), and bytes of text encoded at once.
CACHE_WORDS, CHUNK = 1_000_000, 6 << 20
#: A letter and the punctuation behind it: the tokenizer always parts them, so a space between them changes no id.
LETTER_MARK = r"([a-z])([.,!?;:*$&#)])"
#: Latin letters, which the tokenizer lowers and never splits.
LETTERS = re.compile(r"[a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
KEYS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.list_(pa.int32())), ("doc_tokens", pa.int64())]
PIECE = "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"


class Words:
    """Token ids of texts by their distinct words: no token reaches across ASCII white space.

    Texts are lowered (A-Z, as the tokenizer does), split and numbered by word in Arrow; only words not
    seen before go to the tokenizers library. Texts that hold a special token in any case go there whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in own]
        self.shown = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}  # bytes as the vocabulary writes them
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.starts, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def learn(self, words: pa.Array) -> None:
        texts, model, out = words.to_pylist(), self.library.model, []
        other = iter(self.library.encode_batch_fast([w for w in texts if not LETTERS.fullmatch(w)], add_special_tokens=False))
        for w in texts:
            if LETTERS.fullmatch(w):
                w = w if w.isascii() else w.lower().encode().decode("latin-1").translate(self.shown)
                out.append([t.id for t in model.tokenize(w)])
            else:
                out.append(next(other).ids)
        ends = self.starts[-1] + np.cumsum(np.fromiter(map(len, out), np.int64, len(out)))
        self.starts = np.concatenate([self.starts, ends])
        self.flat = np.concatenate([self.flat, np.fromiter((i for ids in out for i in ids), np.int32, int(ends[-1]) - len(self.flat))])
        self.known = pa.concat_arrays([self.known, words])

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Each word's place among the known ones, learning those that are new."""
        at = pc.index_in(words, value_set=self.known)
        if at.null_count:
            new = words.filter(at.is_null())
            if len(self.known) + len(new) > CACHE_WORDS:
                self.forget()
                new = words
            self.learn(new)
            at = pc.index_in(words, value_set=self.known)
        return at.to_numpy().astype(np.int64)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by end_id, end to end, and where each text starts (and the last ends)."""
        low = pc.ascii_lower(pc.fill_null(texts, ""))
        whole = np.zeros(len(texts), bool)
        for special in self.specials:
            whole |= pc.match_substring(low, special).to_numpy(zero_copy_only=False)
        if whole.any():
            low = pc.if_else(pa.array(whole), "", low)
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(low, pattern=LETTER_MARK, replacement=r"\1 \2"))
        coded = split.flatten().dictionary_encode()
        word = self.numbers(coded.dictionary)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        lengths = self.starts[word + 1] - self.starts[word]
        before = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat((self.starts[word] - before[:-1]).astype(np.int32), lengths)
        at += np.arange(len(at), dtype=np.int32)
        flat = self.flat[at]
        ends = before[split.offsets.to_numpy()[1:] - split.offsets[0].as_py()]
        if whole.any():
            parts = np.split(flat, ends[:-1])
            for i, found in zip(np.flatnonzero(whole), self.library.encode_batch_fast(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False), strict=True):
                parts[i] = np.array(found.ids, np.int32)
            flat, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        starts = np.concatenate([[0], ends]) + np.arange(len(ends) + 1)
        return np.insert(flat, ends, end_id), starts


@lru_cache(maxsize=1)
def words_of(path: str) -> Words:
    return Words(path)


kept_in_workers("packing", lambda: forget_lru(words_of))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Tightest:
    """Segment tree over remaining capacities: how many ranges of windows are open at each."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        at = self.size + capacity
        while at:
            self.count[at] += n
            at >>= 1

    def at_least(self, length: int) -> int | None:
        """The least open capacity that is not below length."""
        at = self.size + length
        if self.count[at]:
            return length
        while at > 1:
            if not at & 1 and self.count[at + 1]:  # a left child whose right neighbour holds windows
                at += 1
                while at < self.size:
                    at = 2 * at + (not self.count[2 * at])
                return at - self.size
            at >>= 1
        return None


def best_fit(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Best-fit decreasing of pieces given as {length: count}.

    Runs (length, first rank, pieces per window, first window, offset), each up to the next run of its
    length, and ranges (first window, windows, tokens used), both covering everything once.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    open_at: dict[int, list[tuple[int, int]]] = {}
    tree, windows = Tightest(window), 0

    def put(capacity: int, first: int, n: int) -> None:
        if n:
            open_at.setdefault(capacity, []).append((first, n))
            tree.add(capacity, 1)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = tree.at_least(length)
            if capacity is None:  # as many new windows as these pieces fill
                capacity, n = window, -(-left // (window // length))
                first, windows = windows, windows + n
            else:
                first, n = open_at[capacity].pop()
                tree.add(capacity, -1)
            each = capacity // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, each, first, window - capacity))
                rank, left = rank + full * each, left - full * each
                put(capacity - each * length, first, full)
            if full < n and left:  # the last pieces fill one window in part
                runs.append((length, rank, left, first + full, window - capacity))
                put(capacity - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(capacity, first + full, n - full)
    ranges = sorted((first, n, window - c) for c, found in open_at.items() for first, n in found)
    return runs, ranges


class Plan:
    """Where each (length, rank) goes: arrays of bounded size, looked up by binary search."""

    def __init__(self, histogram: dict[int, int], window: int, slack: int) -> None:
        runs, ranges = best_fit(histogram, window)
        runs.sort()
        self.window = window
        self.length, self.rank, self.each, self.first, self.offset = (np.array(x, np.int64) for x in (zip(*runs, strict=True) if runs else ([],) * 5))
        self.key = self.length << 48 | self.rank
        start, n, used = (np.array(x, np.int64) for x in (zip(*ranges, strict=True) if ranges else ([],) * 3))
        whole = window - used <= slack
        # Kept windows are numbered first; the others' tokens stand end to end from position 0.
        self.start, self.used, self.whole = start, used, whole
        self.base = np.where(whole, np.cumsum(n * whole) - n * whole, np.cumsum(n * used * ~whole) - n * used * ~whole)
        self.kept, self.loose = int((n * whole).sum()), int((n * used * ~whole).sum())
        # The last cut window ends at powers of two, greatest first.
        rest, at, self.borders = self.loose % window, self.loose - self.loose % window, []
        for bit in range(window.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                at += 1 << bit
                self.borders.append(at)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per piece whether its window is kept, the window's number (0 else), and offset or position."""
        run = np.searchsorted(self.key, length << 48 | rank, side="right") - 1
        inside = rank - self.rank[run]
        window = self.first[run] + inside // self.each[run]
        offset = self.offset[run] + inside % self.each[run] * length
        found = np.searchsorted(self.start, window, side="right") - 1
        whole, nth = self.whole[found], window - self.start[found]
        return whole, np.where(whole, self.base[found] + nth, 0), np.where(whole, offset, self.base[found] + nth * self.used[found] + offset)

    def cuts(self, position: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """A loose piece as (start in it, length, sequence, offset)."""
        at, end, tail = position, position + length, self.loose - self.loose % self.window
        while at < end:
            if at < tail:
                first = at - at % self.window
                stop, sequence = first + self.window, self.kept + at // self.window
            else:
                k = int(np.searchsorted(self.borders, at, side="right"))
                first, stop, sequence = (self.borders[k - 1] if k else tail), self.borders[k], self.kept + tail // self.window + k
            stop = min(stop, end)
            yield at - position, stop - at, sequence, at - first
            at = stop


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (id, text) put together until they hold about CHUNK bytes; larger ones are divided."""
    kept, size = [], 0
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            stop = max(int(np.searchsorted(sizes, before + CHUNK - size)), at + (not kept))
            kept.append(batch.slice(at, stop - at))
            size += int(sizes[stop - 1] - before) if stop > at else 0
            at = stop
            if at < batch.num_rows or size >= CHUNK:
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0] if sum(map(len, kept)) else kept[0]
                kept, size = [], 0
    if sum(map(len, kept)):
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def pieces_of(docs: DataFrame, path: str, *, id_col: str, text_col: str, window: int, end_id: int) -> DataFrame:
    """Every document's windows and rest: doc_id, start, length, ids, doc_tokens, task, nth of its length in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("packing")
        words, task, seen = words_of(path), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in _chunks(batches):
            flat, at = words.encode(batch.column(1), end_id)
            total = np.diff(at)
            doc = np.repeat(np.arange(len(total)), -(-total // window))  # of each piece
            start = (np.arange(len(doc)) - np.searchsorted(doc, doc)) * window
            length = np.minimum(window, total[doc] - start)
            order = np.argsort(length, kind="stable")
            nth = np.empty(len(doc), np.int64)
            nth[order] = np.arange(len(doc)) - np.searchsorted(length[order], length[order])
            nth += seen[length]
            seen += np.bincount(length, minlength=window + 1)
            ids = pa.ListArray.from_arrays(pa.array(np.append(at[doc] + start, at[-1]), pa.int32()), pa.array(flat, pa.int32()))
            columns = [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), ids, pa.array(total[doc]), pa.array(np.full(len(doc), task, np.int32)), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(columns, [n for n, _ in KEYS] + ["task", "nth"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids array<int>, doc_tokens long, task int, nth long")


def _packed(docs: DataFrame, vocabulary: str | None, finish: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, id_col: str, text_col: str, window: int, end_id: int, slack: int) -> DataFrame:
    small_batches(docs.sparkSession)
    pieces = staged(pieces_of(docs, vocabulary or default_vocabulary(), id_col=id_col, text_col=text_col, window=window, end_id=end_id))
    counts = staged(pieces.groupBy("length", "task").count())
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `window` rows
    plan = Plan(histogram, window, slack)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(broadcast_if_small(bases, counts.count(), BROADCAST_IDS), ["length", "task"]).select(*[n for n, _ in KEYS], (F.col("base") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, sequence, at = plan.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            names = [n for n, _ in KEYS]
            placed = pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(at)], [*names, "sequence_id", "offset"])
            yield finish(placed.filter(pa.array(whole)))
            loose = placed.filter(pa.array(~whole)).to_pylist()
            for r in loose:
                cut = [r | {"start": r["start"] + a, "length": n, "ids": r["ids"][a : a + n], "sequence_id": s, "offset": o} for a, n, s, o in plan.cuts(r["offset"], r["length"])]
                yield finish(pa.RecordBatch.from_pylist(cut, placed.schema))

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, slack: int = SLACK) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: each document's tokens in pieces of sequences.

    A document is the ids of its whole text and end_id, so null and empty texts are one token each.
    Repeated rows are documents of their own, null ids stay null; empty tables give no rows; further
    columns are ignored. No sequence is longer than the window (a power of two); offsets of a sequence
    have no gaps. sequence_id runs from 0.
    """
    return _packed(docs, vocabulary, lambda batch: batch, PIECE, id_col, text_col, window, end_id, slack)


def pack_digests(docs: DataFrame, vocabulary: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, slack: int = SLACK) -> DataFrame:
    """The pieces of pack_documents with the CRC-32 of their ids (little-endian, 32 bits each) in the ids' place."""

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, at = batch.column("ids"), batch.schema.get_field_index("ids")
        ends, raw = found.offsets.to_numpy(), found.values.to_numpy().astype("<u4")
        sums = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return batch.set_column(at, "ids_crc32", pa.array(sums, pa.int64()))

    return _packed(docs, vocabulary, finish, PIECE.replace("ids array<int>", "ids_crc32 long"), id_col, text_col, window, end_id, slack)


def sequences(packed: DataFrame, *, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens, ids: the pieces of each sequence in order, padded to the window unless n_tokens is a power of two."""
    parts = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    pads = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(window - F.col("n_tokens")).cast("int")
    return parts.select("sequence_id", "n_tokens", F.concat(ids, F.array_repeat(F.lit(pad_id), pads)).alias("ids"))
