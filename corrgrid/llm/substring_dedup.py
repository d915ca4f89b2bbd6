"""Substring deduplication with a count-min prefilter.

Pass one: each task adds the hashes of its word windows to a saturating count-min sketch; the
partition sketches are merged slot block by slot block. Counts are overestimated, so a window that
occurs twice is never estimated to occur once; its vectorised hashes only choose slots, so their
collisions let windows pass and decide nothing. Pass two groups only windows estimated repeated, by a
128-bit BLAKE2b digest of their words. A task resolves what it can by itself first: of the documents
in which it sees a window only the smallest is sent on, so a passage that very many documents share
reaches a group once per task. A window's group follows from its least five-word hash, which
neighbouring windows share, so a document's passage meets few groups. The sketch is bounded
(SKETCH_BITS); beyond that more windows pass the prefilter, with the same result. Texts are shuffled
only where words go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrgrid.llm.common import BROADCAST_IDS, small_batches, staged

#: Each of the sketch's rows has at most 2 ** SKETCH_BITS slots (32 MB as bits).
SKETCH_BITS = 28
#: Slots per block that is merged and sent as one.
BLOCK_BITS = 20
#: Odd multipliers of the sketch's rows.
ROWS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Windows per group of pass two, on average; each takes about 40 bytes there.
GROUP_WINDOWS, LEAST_GROUPS = 600_000, 64
#: Words whose hashes choose a window's group.
ANCHOR = 5
#: Bytes of text hashed at a time, and estimated-repeated windows held before they are sent.
CHUNK_BYTES, HELD_WINDOWS = 2 << 20, 1_000_000
NO_ID = (1 << 63) - 1

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.random.default_rng(13).integers(0, 1 << 64, 256, dtype=np.uint64) | _U(1)
_BASE, _INVERSE = _U(0x2545F4914F6CDD1D), _U(pow(0x2545F4914F6CDD1D, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mix(h: np.ndarray, by: int) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(by)
    return h ^ (h >> _U(29))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit polynomial hash of every word of a text, the same wherever the word stands, and where words start and end."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[b]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(b) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[b] * down[: len(b)])])
    return _mix((sums[ends] - sums[starts]) * up[ends], 0xD6E8FEB86659FD93), starts, ends


def _windows(h: np.ndarray, width: int, by: int) -> np.ndarray:
    n = len(h) - width + 1
    acc = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for j in range(width):
            acc *= _U(by)
            acc += h[j : j + n]
    return _mix(acc, 0xFF51AFD7ED558CCD)


def _anchors(h: np.ndarray, width: int) -> np.ndarray:
    """Of every window the least hash of ANCHOR words in a row."""
    part = min(ANCHOR, width)
    grams = _windows(h, part, ROWS[1])
    n = max(len(h) - width + 1, 0)
    least = grams[:n].copy()
    for j in range(1, width - part + 1):
        np.minimum(least, grams[j : j + n], out=least)
    return least


@dataclass
class _Chunk:
    """Some rows (ids..., text): their words joined by spaces, word hashes, words per row and window starts inside one row."""

    rows: list[tuple]
    joined: bytes
    h: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray
    inside: np.ndarray


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[_Chunk]:
    rows, size = [], 0
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            *ids, raw = (x.as_py() for x in row)
            rows.append((*ids, raw))
            size += len(raw) + 1
            if size >= CHUNK_BYTES:
                yield _chunk(rows, width)
                rows, size = [], 0
    if rows:
        yield _chunk(rows, width)


def _chunk(rows: list[tuple], width: int) -> _Chunk:
    texts = [b" ".join(r[-1].split()) for r in rows]
    joined = b" ".join(texts)
    h, starts, ends = word_hashes(joined)
    # A row's words are the word starts that lie within its bytes.
    upto = np.searchsorted(starts, np.cumsum(np.array([len(t) + 1 for t in texts], np.int64)))
    words = np.diff(np.concatenate([[0], upto]))
    inside = np.flatnonzero(np.arange(len(h)) + width <= np.repeat(upto, words))
    return _Chunk([r[:-1] for r in rows], joined, h, starts, ends, words, inside)


def _digests(c: _Chunk, at: np.ndarray, width: int) -> np.ndarray:
    """Two 64-bit halves of the BLAKE2b digest of each window's words."""
    joined, blake = c.joined, hashlib.blake2b
    raw = b"".join([blake(joined[a:b], digest_size=16).digest() for a, b in zip(c.starts[at].tolist(), c.ends[at + (width - 1)].tolist(), strict=True)])
    return np.frombuffer(raw, "<u8").reshape(-1, 2)


def _slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((h * _U(m)) >> _U(64 - bits)).astype(np.int64) for m in ROWS]


def _planes(a: np.ndarray) -> bytes:
    """uint32 values, byte plane by byte plane: zero planes compress away."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _sketch_task(width: int, bits: int):
    block = min(BLOCK_BITS, bits)

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(held)
        for r, slots in enumerate(_slots(h, bits)):
            slots.sort()
            first = np.concatenate([[True], slots[1:] != slots[:-1]])
            twice = np.concatenate([slots[1:] == slots[:-1], [False]]) & first
            out = []
            for many, chosen in ((False, slots[first & ~twice]), (True, slots[twice])):
                cuts = np.searchsorted(chosen, np.arange(0, (1 << (bits - block)) + 1) << block)
                for k in np.flatnonzero(np.diff(cuts)):
                    inner = chosen[cuts[k] : cuts[k + 1]] & ((1 << block) - 1)
                    out.append((r, int(k), many, _planes(np.diff(inner, prepend=0))))
            if out:
                r_, k_, m_, p_ = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(r_, pa.int32()), pa.array(k_, pa.int32()), pa.array(m_), pa.array(p_, pa.binary())], ["row", "block", "many", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for c in _chunks(batches, width):
            held.append(_windows(c.h, width, ROWS[0])[c.inside])
            n += len(c.inside)
            if n >= 3 * HELD_WINDOWS:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _merge_task(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for r, k, many, payload in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (r, k) not in counts:
                    counts[r, k] = np.zeros(1 << block, np.uint8)
                a, at = counts[r, k], np.cumsum(_unplanes(payload))
                a[at] = 2 if many else np.minimum(a[at] + 1, 2)
        for (r, k), a in counts.items():
            if (a == 2).any():
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([k], pa.int32()), pa.array([np.packbits(a == 2).tobytes()], pa.binary())], ["row", "block", "bits"])

    return run


def repeated_slots(base: DataFrame, width: int, bits: int) -> list[np.ndarray]:
    """The merged sketch: for each of its rows one bit per slot, set if the slot was hit more than once."""
    block = min(BLOCK_BITS, bits)
    parts = base.select("raw").mapInArrow(_sketch_task(width, bits), "row int, block int, many boolean, payload binary")
    merged = parts.repartition("row", "block").mapInArrow(_merge_task(block), "row int, block int, bits binary")
    out = [np.zeros(max(1, (1 << bits) >> 3), np.uint8) for _ in ROWS]
    size = (1 << block) >> 3
    for r in merged.toLocalIterator():
        out[r["row"]][r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


_WINDOW = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("key", "<u4"), ("pos", "<u4"), ("grp", "<u4")])


def _send_task(width: int, bits: int, groups: int, sketch):
    def flush(keys: list[tuple[int, int]], held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        w = np.concatenate(held)
        ids = np.array([k[0] for k in keys], np.int64)
        doc = ids[w["key"]]
        order = np.lexsort((doc, w["h2"], w["h1"]))
        w, doc = w[order], doc[order]
        new = np.concatenate([[True], (w["h1"][1:] != w["h1"][:-1]) | (w["h2"][1:] != w["h2"][:-1])])
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        out: list[tuple] = []
        # Later documents of a window are settled here; they pass through any group.
        settled = w[doc > least]
        settled = settled[np.lexsort((settled["pos"], settled["key"]))]
        cuts = np.flatnonzero(np.diff(settled["key"], prepend=-1, append=-1)) if len(settled) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            k = keys[settled["key"][a]]
            out.append((int((k[0] * 0x9E3779B1 + k[1]) % groups), *k, settled["pos"][a:b].tobytes()))
        open_ = w[doc == least]
        open_ = open_[np.lexsort((open_["pos"], open_["key"], open_["grp"]))]
        cuts = np.searchsorted(open_["grp"], np.arange(groups + 1))
        for g in np.flatnonzero(np.diff(cuts)):
            x = open_[cuts[g] : cuts[g + 1]]
            used, n = np.unique(x["key"], return_counts=True)
            own = np.array([keys[u] for u in used], np.int64)
            head = np.array([len(used), len(x)], np.int64).tobytes()
            out.append((int(g), None, None, head + own.tobytes() + _planes(n) + x["h1"].tobytes() + x["h2"].tobytes() + _planes(x["pos"])))
        if out:
            g_, i_, t_, p_ = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(g_, pa.int32()), pa.array(i_, pa.int64()), pa.array(t_, pa.int64()), pa.array(p_, pa.binary())], ["grp", "key", "th", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, n, rows_bits = [], [], 0, sketch.value
        for c in _chunks(batches, width):
            h1 = _windows(c.h, width, ROWS[0])[c.inside]
            keep = np.ones(len(h1), bool)
            for b, at in zip(rows_bits, _slots(h1, bits), strict=True):
                keep &= _has(b, at)
            at = c.inside[keep]
            w, digest = np.zeros(len(at), _WINDOW), _digests(c, at, width)
            w["h1"], w["h2"], w["grp"] = digest[:, 0], digest[:, 1], (_anchors(c.h, width)[at] >> _U(20)) % _U(groups)
            row = np.repeat(np.arange(len(c.rows)), c.words)[at]
            w["key"], w["pos"] = row + len(keys), at - (np.cumsum(c.words) - c.words)[row]
            keys += c.rows
            held.append(w)
            n += len(w)
            if n >= HELD_WINDOWS:
                yield from flush(keys, held)
                keys, held, n = [], [], 0
        if n:
            yield from flush(keys, held)

    return run


def _settle(table: pa.Table) -> pa.Table:
    """One group: of each window digest the smallest id; starts in documents with a greater id are returned."""
    out, parts = [], []
    for key, th, payload in zip(table["key"].to_pylist(), table["th"].to_pylist(), table["payload"].to_pylist(), strict=True):
        if key is not None:
            out.append((key, th, payload))
            continue
        k, n = np.frombuffer(payload, np.int64, 2)
        own = np.frombuffer(payload, np.int64, 2 * k, 16).reshape(k, 2)
        at = 16 + 16 * k
        counts = _unplanes(payload[at : at + 4 * k])
        at += 4 * k
        h1, h2 = np.frombuffer(payload, "<u8", n, at), np.frombuffer(payload, "<u8", n, at + 8 * n)
        parts.append((own, counts, h1, h2, _unplanes(payload[at + 16 * n :])))
    if parts:
        own = np.concatenate([p[0] for p in parts])
        index = np.repeat(np.arange(len(own)), np.concatenate([p[1] for p in parts]))
        h1, h2, pos = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
        doc = own[index, 0]
        order = np.lexsort((doc, h2, h1))
        h1, h2, doc, index, pos = h1[order], h2[order], doc[order], index[order], pos[order]
        new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        gone = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        index, pos = index[gone], pos[gone]
        order = np.argsort(index, kind="stable")
        index, pos = index[order], pos[order]
        cuts = np.flatnonzero(np.diff(index, prepend=-1, append=-1)) if len(index) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            out.append((int(own[index[a], 0]), int(own[index[a], 1]), pos[a:b].astype("<u4").tobytes()))
    k_, t_, p_ = zip(*out, strict=True) if out else ((), (), ())
    return pa.table([pa.array(k_, pa.int64()), pa.array(t_, pa.int64()), pa.array(p_, pa.binary())], ["key", "th", "starts"])


def _finish_task(width: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column("doc_id"), []
            for raw, lists in zip(batch.column("raw").to_pylist(), batch.column("lists").to_pylist(), strict=True):
                words = raw.split()
                n, gone = len(words), 0
                if lists:
                    cover = np.zeros(n + 1, np.int64)
                    starts = np.unique(np.frombuffer(b"".join(lists), "<u4")).astype(np.int64)
                    cover[starts] += 1
                    np.subtract.at(cover, starts + width, 1)
                    keep = np.cumsum(cover)[:n] == 0
                    gone = n - int(keep.sum())
                    words = [words[i] for i in np.flatnonzero(keep)]
                kept = b" ".join(words)
                out.append((n, gone, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
            n_, g_, s_, t_ = zip(*out, strict=True) if out else ((), (), (), ())
            arrays = [ids, pa.array(n_, pa.int64()), pa.array(g_, pa.int64()), pa.array(s_, pa.string())] + [pa.array(t_, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    return run


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 13, sketch_bits: int = SKETCH_BITS, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (and kept_text).

    Removed is each word covered by a window of `width` words of its document whose words also start
    in a document with a smaller id; windows are judged on the input. Null and empty texts have no
    words. Repeated rows (same id) do not remove each other's words. A null id counts as greater than
    every other. Empty tables give no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(text).alias("th"), F.encode(text, "UTF-8").alias("raw"))
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    bits = int(min(sketch_bits, max(16, np.ceil(np.log2(max(1, chars / 6))) + 1)))
    slots = repeated_slots(base, width, bits)
    groups = int(max(LEAST_GROUPS, chars / 6 / 3 // GROUP_WINDOWS + 1))
    sketch = spark.sparkContext.broadcast(slots)
    sent = base.select("key", "th", "raw").mapInArrow(_send_task(width, bits, groups, sketch), "grp int, key long, th long, payload binary")
    settled = sent.groupBy("grp").applyInArrow(_settle, "key long, th long, starts binary")
    masks = staged(settled.groupBy("key", "th").agg(F.collect_list("starts").alias("lists")))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    finish = lambda rows: rows.select("doc_id", "raw", "lists").mapInArrow(_finish_task(width, with_text), schema)
    if masks.count() > BROADCAST_IDS:
        return finish(base.join(masks, ["key", "th"], "left"))
    # Only texts that lose words meet their masks in a shuffle; the others are finished where they are read.
    ids = F.broadcast(masks.select("key", "th"))
    whole = base.join(ids, ["key", "th"], "left_anti").withColumn("lists", F.lit(None).cast("array<binary>"))
    return finish(whole).unionByName(finish(base.join(ids, ["key", "th"], "left_semi").join(masks, ["key", "th"])))
