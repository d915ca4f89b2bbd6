"""Toxicity scoring behind a noisy-channel deobfuscator.

1. A character trigram model is counted over every whole text (a table of at most 28 ** 3 rows).
2. Tokens that look disguised (leetspeak, separators inside, stretched letters, letters spaced apart)
   become lattices of possible letters; Viterbi decoding under the character model restores them.
3. Evidence per word and word prefix comes from labelled rows: the lower confidence bound of the
   log odds ratio of distinct texts that hold it. A small logistic regression is fitted on what
   restored texts collect from the evidence of the other folds (cross-fitting); scores use all folds'.
4. Each task scores its documents with the broadcast model; nothing but counts is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrgrid.llm.common import own_worker, small_batches, staged

#: Labelled rows that the classifier is fitted on at most (smallest hashes of doc_id first).
TRAIN_ROWS = 20_000
#: Evidence entries kept at most, strongest first, and the weakest that is kept.
MAX_ENTRIES, LEAST_EVIDENCE = 200_000, 1.0
#: Documents of the training fold that must hold an entry.
LEAST_SUPPORT = 3
#: Scored tokens each task remembers, and the longest of them in bytes (longer ones are scored each time).
CACHE_TOKENS, CACHE_BYTES = 100_000, 64
#: Tokens whose entries, and entries whose counts, a counting task holds before it starts anew or sends them.
SEEN_TOKENS, HELD_ENTRIES = 15_000, 150_000
CLASSES = 28  # boundary, a-z, other letters
#: Folds of labelled rows besides the held-out one, and the numbers that a text collects.
FOLDS, FEATURES = (1, 2, 3, 4), 5

#: Letters that a sign may stand for, and the cost of that reading.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
COST = {"leet": 0.5, "drop_sign": 0.7, "drop_digit": 6.0, "drop_repeat": 0.3}
EDGE = b".,;:!?\"'`|*#$%&()[]{}<>-_~/\\=+^"

_LUT = np.zeros(256, np.int64)
_LUT[128:] = 27
_LUT[97:123] = np.arange(1, 27)
_LUT[65:91] = np.arange(1, 27)
_DISGUISED = re.compile(r"[a-z][0-9@$!|+(€._*\-~]+[a-z]|^[0-9@$!|+(€]+[a-z]|[a-z][0-9@$€]+$|([a-z])\1\1")
_SPACED = re.compile(rb"(?<!\S)[a-z0-9@$!](?:[ ._*-]{1,3}[a-z0-9@$!]){2,}(?!\S)")
_LETTER = re.compile(r"[a-z].*[a-z]")


def _class(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


# --- character model ---------------------------------------------------------------------------
def char_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """gram, n: counts of character class trigrams over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("toxicity")
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for raw in batch.column("raw").to_pylist():
                c = _LUT[np.frombuffer(b"  " + raw + b" ", np.uint8)]
                total += np.bincount(c[:-2] * CLASSES**2 + c[1:-1] * CLASSES + c[2:], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    raw = docs.select(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("raw"))
    return raw.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def char_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log P(c | a, b) + log CLASSES: what a letter gains over chance."""
    n = np.zeros(CLASSES**3)
    for r in char_counts(docs, text_col).collect():  # at most CLASSES ** 3 rows
        n[r.gram] = r.n
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    bi = (n.sum(axis=0) + 0.5) / (n.sum(axis=0).sum(axis=1, keepdims=True) + 0.5 * CLASSES)
    p = (n + 4.0 * bi[None]) / (n.sum(axis=2, keepdims=True) + 4.0)
    return np.log(p * CLASSES)


# --- noisy channel -----------------------------------------------------------------------------
def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Readings of each sign: letters or nothing (""), with their costs."""
    out, before = [], ""
    for c in token:
        if c.isalpha() and c not in LEET:
            readings = [(c, 0.0)] + ([("", COST["drop_repeat"])] if c == before else [])
        else:
            readings = [(x, COST["leet"]) for x in LEET.get(c, "")] + [("", COST["drop_digit" if c.isdigit() else "drop_sign"])]
        out.append(readings)
        before = c
    return out


def viterbi(token: str, lm: list[list[list[float]]]) -> str:
    """The cheapest reading of a token under the character model; linear in its length.

    A state is the last two classes; it holds its score and its letters as (earlier letters, letter).
    """
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for readings in lattice(token):
        step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (s, path) in states.items():
            for c, cost in readings:
                to, gain = ((b, k := _class(c)), lm[a][b][k] - cost) if c else ((a, b), -cost)
                if to not in step or step[to][0] < s + gain:
                    step[to] = (s + gain, (path, c) if c else path)
        states = step
    path = max(((s + lm[a][b][0], path) for (a, b), (s, path) in states.items()), key=lambda x: x[0])[1]
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


def restore(token: str, lm: list[list[list[float]]]) -> str:
    """A disguised token's restored form, at any length; other tokens stay as they are."""
    if not _DISGUISED.search(token) or not _LETTER.search(token):
        return token
    return viterbi(token, lm) or token


# --- evidence ----------------------------------------------------------------------------------
def entries(token: str) -> list[str]:
    """A word's own entry and those of its prefixes."""
    return ["=" + token, *[token[:k] for k in range(2, 7) if len(token) > k]] if len(token) > 1 else []


def plain(token: bytes) -> str:
    return token.strip(EDGE).decode("utf-8", "replace")


def tokens(text: str) -> list[bytes]:
    low = text.lower().encode()
    found = low.split()
    return found + [b"\0" + re.sub(rb"[ ._*-]", b"", m) for m in _SPACED.findall(low)]


def forms(token: bytes, lm: list[list[list[float]]]) -> list[str]:
    """The words that a raw token may be: itself, and its restored form."""
    if token[:1] == b"\0":
        spaced = token[1:].decode("utf-8", "replace")
        return [viterbi(spaced, lm) or spaced]
    word = plain(token)
    return list({word: 1, restore(token.decode("utf-8", "replace").strip(".,;:?\"'`"), lm).strip(EDGE.decode()): 1, restore(word, lm): 1})


@dataclass
class Model:
    lm: list = field(default_factory=list)
    evidence: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    cache: dict[bytes, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def token(self, raw: bytes) -> float:
        get = self.evidence.get
        return max((get(e, 0.0) for w in forms(raw, self.lm) for e in entries(w)), default=0.0)

    def cached(self, raw: bytes) -> float:
        found = self.cache.get(raw)
        if found is None:
            found = self.token(raw)
            if len(raw) <= CACHE_BYTES:
                self.cache[raw] = found
        return found

    def collect(self, text: str) -> list[float]:
        """What a restored text collects: total evidence over distinct words, strongest, second, words with evidence, words."""
        if len(self.cache) > CACHE_TOKENS:
            self.cache.clear()
        own = set(tokens(text))
        found = sorted([e for e in map(self.cached, own) if e > 0], reverse=True)
        return [math.log1p(sum(found)), found[0] if found else 0.0, found[1] if len(found) > 1 else 0.0, math.log1p(sum(e > 2.5 for e in found)), math.log1p(len(own))]

    def score(self, text: str) -> float:
        z = float(self.weights[0] + np.dot(self.weights[1:], self.collect(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def evidence_of(pos: dict[str, int], neg: dict[str, int], n_pos: int, n_neg: int) -> dict[str, float]:
    """Lower confidence bounds of log odds ratios."""
    out = {}
    for e, p in pos.items():
        if p < LEAST_SUPPORT:
            continue
        n = neg.get(e, 0)
        low = math.log((p + 0.5) / (n_pos + 1)) - math.log((n + 0.5) / (n_neg + 1)) - 1.3 * math.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
        if low >= LEAST_EVIDENCE:
            out[e] = low
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:MAX_ENTRIES])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> np.ndarray:
    """Newton's method; x without the constant."""
    a = np.hstack([np.ones((len(x), 1)), x]) if len(x) else np.zeros((0, FEATURES + 1))
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(a.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fold(id_col: str = "doc_id") -> Column:
    return (F.crc32(F.col(id_col).cast("string")) % 5).cast("int")


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled rows of folds 1 to 4; of rows that share a text one counts, with the greatest label."""
    spark = docs.sparkSession
    small_batches(spark)
    lm = char_model(docs, text_col).tolist()
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("y"), fold(id_col).alias("fold"))
    known = known.where("fold <> 0").groupBy("label_id", "fold").agg(F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(TRAIN_ROWS)
    texts = docs.select(F.col(id_col).alias("own_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = staged(texts.join(F.broadcast(known), F.col("own_id") == F.col("label_id")).groupBy("text").agg(F.min("fold").alias("fold"), F.max("y").alias("y")))
    shared = spark.sparkContext.broadcast(lm)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("toxicity")
        held: Counter = Counter()
        seen: dict[bytes, list[str]] = {}

        def send() -> pa.RecordBatch:
            keys = list(held)
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([held[k] for k in keys], pa.int64())], ["entry", "fold", "y", "n"])
            held.clear()
            return out

        for batch in batches:
            for f, y, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = set(tokens(text))
                for raw in [t for t in own if t not in seen]:
                    seen[raw] = [e for w in forms(raw, shared.value) for e in entries(w)]
                held.update([(e, f, y) for e in {"", *(e for raw in own for e in seen[raw])}])
                if len(seen) > SEEN_TOKENS:
                    seen.clear()
                if len(held) > HELD_ENTRIES:
                    yield send()
        yield send()

    # Per entry the counts of each fold and label; the empty entry counts all texts.
    cell = [F.coalesce(F.sum(F.when((F.col("fold") == f) & (F.col("y") == y), F.col("n"))), F.lit(0)).alias(f"n{y}{f}") for f in FOLDS for y in (0, 1)]
    total_of = lambda y: sum((F.col(f"n{y}{f}") for f in FOLDS), F.lit(0))
    counts = rows.select("fold", "y", "text").mapInArrow(count, "entry string, fold int, y int, n long").groupBy("entry").agg(*cell)
    counts = staged(counts.where((total_of(1) >= LEAST_SUPPORT) | (F.col("entry") == "")))
    total = counts.where("entry = ''").first()
    model, partial = Model(lm=lm), {f: Model(lm=lm) for f in FOLDS}
    if total and any(total[f"n1{f}"] for f in FOLDS):
        every = {y: sum(total[f"n{y}{f}"] for f in FOLDS) for y in (0, 1)}
        # The bound of evidence_of, once here to rank and bound what is collected.
        p, n = total_of(1) + 0.5, total_of(0) + 0.5
        low = F.log(p / (every[1] + 1)) - F.log(n / (every[0] + 1)) - 1.3 * F.sqrt(1 / p + 1 / n)
        best = counts.where((F.col("entry") != "") & (low >= LEAST_EVIDENCE)).orderBy(low.desc(), "entry").limit(MAX_ENTRIES).collect()
        for left_out, m in [(None, model), *partial.items()]:
            used = [f for f in FOLDS if f != left_out]
            of = lambda r, y: sum(r[f"n{y}{f}"] for f in used)  # noqa: E731, B023
            m.evidence = evidence_of({r.entry: of(r, 1) for r in best}, {r.entry: of(r, 0) for r in best}, of(total, 1), of(total, 0))
    others = spark.sparkContext.broadcast(partial)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [others.value[f].collect(t) for f, t in zip(batch.column("fold").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(xs, pa.list_(pa.float64()))], ["y", "x"])

    got = rows.select("y", "fold", "text").mapInArrow(collect, "y int, x array<double>").collect()  # at most TRAIN_ROWS rows of a few numbers
    x, y = np.array([r.x for r in got]).reshape(-1, FEATURES), np.array([r.y for r in got], float)
    order = np.lexsort((*x.T, y))  # sums in one order, whatever order the rows came in
    model.weights = logistic(x[order], y[order]) if len(got) else np.array([-3.0, 1.0, 1.0, 0.0, 0.0, 0.0])
    return model


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """The model as a function of a text column: only texts go to the workers, only scores come back."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(x.as_py() or "") for x in texts], pa.float64())

    return score


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), scorer(docs.sparkSession, model)(F.col(text_col)).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null texts count as empty; empty texts are scored too. Null labels and labels without a document
    are ignored; a document labelled twice takes its greater label. Without labels every score rests
    on no evidence and stays low. Repeated rows are scored each; a row whose doc_id is null is never
    held out nor trained on. Empty tables give no rows; further columns are ignored.
    """
    scored = score(docs, fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col), id_col=id_col, text_col=text_col)
    held = F.coalesce(fold("doc_id") == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns.

    Every row is judged by its own text, whatever its id; null and empty texts are scored as empty;
    empty tables give none; further columns may have any name.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    return docs.where(scorer(docs.sparkSession, model)(F.col(text_col)) < threshold)
