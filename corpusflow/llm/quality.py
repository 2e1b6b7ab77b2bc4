"""Quality scores by a naive Bayes support vector machine."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.remembered import use
from corpusflow.session import cut_lineage

#: Hashed n-gram indicators.
BUCKETS = 1 << 16
#: Bound of the training sample: rows of each label, those with the smallest id hash.
ROWS_PER_LABEL = 2_000
COST = 0.01
EPOCHS = 12
#: Longer words are not remembered by a worker, so that its memory is bounded in bytes.
REMEMBERED_LENGTH = 64

_M = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(48)
_ENDS = ".,!?#$%&*|;:"


class _Shapes(dict):
    """Word -> number of its shape: letter case or kind, and the first closing mark."""

    def __missing__(self, word: str) -> int:
        import zlib

        core = word.rstrip(_ENDS)
        if not core:
            kind = "mark"
        elif core.isdigit():
            kind = "digits"
        elif core.isupper() and len(core) > 1:
            kind = "upper"
        elif core.istitle():
            kind = "title"
        elif core.islower():
            kind = "lower"
        else:
            kind = "mixed"
        value = zlib.crc32(f"{kind} {word[len(core):][:1]}".encode())
        if len(word) <= REMEMBERED_LENGTH:
            if len(self) >= 300_000:
                self.clear()
            self[word] = value
        return value


class _Numbers(dict):
    """Word -> a number that differs between words of one text."""

    def __missing__(self, word: str) -> int:
        value = self[word] = len(self)
        return value


_SHAPES = _Shapes()


def _hashed(h: np.ndarray, kind: int) -> np.ndarray:
    return ((h + np.uint64(kind << 56)) * _M) >> _SHIFT


def features(text: str | None) -> list[np.ndarray]:
    """Bucket numbers of a whole text's n-grams: bytes in twos and threes, word shapes in ones to threes.

    A word that repeats the word before it has a shape of its own. Repeats are
    in the result; the model looks at indicators.
    """
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
    out = []
    if len(data) > 1:
        pairs = (data[:-1] << np.uint64(8)) | data[1:]
        out.append(_hashed(pairs, 1))
        if len(data) > 2:
            out.append(_hashed((pairs[:-1] << np.uint64(8)) | data[2:], 2))
    words = text.split()
    if words:
        shapes = np.fromiter(map(use(_SHAPES).__getitem__, words), np.uint64, len(words))
        numbers = np.fromiter(map(_Numbers().__getitem__, words), np.int64, len(words))
        shapes[1:][numbers[1:] == numbers[:-1]] += np.uint64(1 << 33)
        h = shapes
        for n in (1, 2, 3):
            if n > 1:
                h = h[:-1] * np.uint64(1_000_003) + shapes[n - 1 :]
            if len(h):
                out.append(_hashed(h & np.uint64((1 << 56) - 1), 2 + n))
    return out


@dataclass(frozen=True)
class Model:
    """Linear weights over the indicators and the sigmoid that turns margins into probabilities."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, texts) -> list[float]:
        seen, out = np.zeros(BUCKETS, bool), []
        for text in texts:
            parts = features(text)
            for p in parts:
                seen[p] = True
            margin = float(self.weights[seen].sum()) + self.bias
            for p in parts:
                seen[p] = False
            out.append(float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))))
        return out


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS):
    """Linear hinge-loss model on indicators scaled by ``ratio``, by dual coordinate descent."""
    weights, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(rows))
    norms = np.array([float((ratio[x] ** 2).sum()) + 1 for x in rows])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x = rows[i]
            gradient = y[i] * (float(weights[x] @ ratio[x]) + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                weights[x] += step * ratio[x]
                bias += step
                alpha[i] = new
    return weights * ratio, bias


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    good, bad = np.ones(BUCKETS), np.ones(BUCKETS)
    for x, sign in zip(rows, y, strict=True):
        (good if sign > 0 else bad)[x] += 1
    return np.log((good / good.sum()) / (bad / bad.sum()))


def sigmoid_fit(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1 (smoothed targets, Newton steps)."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        g = weight * (p - target)
        h = np.maximum(weight * p * (1 - p), 1e-12)
        gradient = np.array([g @ margins, g.sum()])
        hessian = np.array([[(h * margins) @ margins + 1e-6, h @ margins], [h @ margins, h.sum() + 1e-6]])
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 5.0 / max(abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-6)), float(b)


def held_out() -> F.Column:
    """True where labels are never learned: crc32 of the doc_id as text is divisible by 5, or there is no doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL, text: str = "text") -> Model:
    """Learn from labelled rows that are not held out, at most ``rows_per_label`` of each label.

    Documents without a label, or with both labels, are not learned from.
    With one label only, every score is near that label; with none, 0.5.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality"))
    known = known.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("quality").alias("other")
    )
    known = cut_lineage(known.filter("quality = other").filter(~held_out()).select("doc_id", "quality"), "labels")
    shares = dict(known.groupBy("quality").count().collect())
    total = sum(shares.values())
    if len(shares) < 2:
        chance = 0.5 if not shares else (total + 1) / (total + 2) if 1 in shares else 1 / (total + 2)
        return Model(np.zeros(BUCKETS), 0.0, 1.0, float(np.log(chance / (1 - chance))))
    picks = [
        known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_label) for q in (0, 1)
    ]
    sample = cut_lineage(picks[0].union(picks[1]), "sample")  # at most 2 * rows_per_label ids

    def index(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for value in batch.column(1):
                parts = features(value.as_py())
                found.append(np.unique(np.concatenate(parts)).astype(np.uint16).tobytes() if parts else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "quality", "found"]
            )

    texts = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"))
    learned = (
        texts.join(F.broadcast(sample), "doc_id")
        .mapInArrow(index, "doc_id long, quality int, found binary")
        .groupBy("doc_id")
        .agg(F.min(F.struct("quality", "found")).alias("row"))
        .select("doc_id", "row.*")
        .collect()
    )
    learned.sort()
    rows = [np.frombuffer(bytes(r.found), np.uint16).astype(np.int64) for r in learned]
    y = np.array([1 if r.quality else -1 for r in learned])
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS), 0.0, 1.0, float(np.log((shares[1] + 1) / (shares[0] + 1))))
    # Each half's margins come from a model of the other half.
    margins, fold = np.zeros(len(rows)), np.arange(len(rows)) % 2
    for part in (0, 1):
        train = np.flatnonzero(fold != part)
        w, b = dual_descent([rows[i] for i in train], y[train], log_count_ratio([rows[i] for i in train], y[train]))
        for i in np.flatnonzero(fold == part):
            margins[i] = w[rows[i]].sum() + b
    count = {s: max(1, int((y == s).sum())) for s in (1, -1)}
    weight = np.where(y > 0, shares[1] / total / count[1], shares[0] / total / count[-1]) * len(y)
    slope, offset = sigmoid_fit(margins, y, weight)
    w, b = dual_descent(rows, y, log_count_ratio(rows, y))
    return Model(w, b, slope, offset)


def scored(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with held_out, score and predicted (1 if score >= ``threshold``), computed from the text alone.

    A null or empty text has no indicators and gets the score of the bias.
    Columns of ``docs`` named held_out, score or predicted are replaced.
    """
    names = [c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]
    rows = docs.select(F.col(text).alias("__text"), *names)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            values = pa.array(model.scores(t.as_py() for t in batch.column(0)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], values], [*names, "score"])

    schema = docs.select(*names).schema.add("score", "double")
    return rows.mapInArrow(score, schema).withColumns(
        {"held_out": held_out(), "predicted": (F.col("score") >= threshold).cast("int")}
    )
