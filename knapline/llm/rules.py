"""Quality rules: counting rules, then a calibrated logistic regression on hashed n-grams.

The regression learns from labelled rows: hashed word unigrams and character 4-grams of whole texts, l2-scaled.
Its scores are calibrated on rows held back from the fit (Platt's two-parameter sigmoid) and compared with a
fixed threshold in Arrow batches. Fitting takes at most `sample` labelled rows, the documented bound; everything
else covers all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, hash_words, mix, raw_texts, rows, short_batches

SYMBOLS = b"#*$%&|<>"  # fixed value: the characters that count as symbols
BITS = 16
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("probability", pa.float64())])
DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
IS_POINT = (np.arange(256) & 0xC0) != 0x80  # not a continuation byte
IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def repeat_words(h: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(h) < 4:
        return 0
    # Ids instead of hashes: equal words and only they are equal, and three ids fit exactly.
    _, ids = np.unique(h, return_inverse=True)
    n = np.uint64(len(h))
    ids = ids.astype(np.uint64)
    if len(h) < 1 << 21:
        w = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    else:
        _, two = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)
        w = two.astype(np.uint64) * n + ids[2:]
    _, where, count = np.unique(w, return_inverse=True, return_counts=True)
    again = count[where] > 1
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[k : k + len(w)] |= again
    return int(covered.sum())


def dup_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in raw:
        return 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def base(raw: bytes) -> tuple[int, int, int, int, int, bool]:
    """The counts of one text and whether the counting rules reject it. Words end at the six ASCII
    space characters."""
    words = hash_words(raw)
    n = len(words)
    b = np.frombuffer(raw, np.uint8)
    points = int((IS_POINT[b] & ~IS_SPACE[b]).sum())
    again = repeat_words(words)
    return n, points, int(IS_SYMBOL[b].sum()), dup_lines(raw), again, n < 50 or 100 * again > 50 * n


def features(raw: bytes, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text's word unigrams and character 4-grams, each with its share of the n-grams of its kind. However long
    the text, there are no more than the slots."""
    b = np.frombuffer(raw, np.uint8)
    top = np.uint64(64 - BITS)
    w = (mix(words) >> top).astype(np.int64)
    parts = [w]
    if len(b) >= 4:
        q = b[:-3].astype(np.uint32) | b[1:-2].astype(np.uint32) << np.uint32(8) | b[2:-1].astype(np.uint32) << np.uint32(16) | b[3:].astype(np.uint32) << np.uint32(24)
        parts.append(((q * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64) + (1 << BITS))
    counts = [np.unique(p, return_counts=True) for p in parts if len(p)]
    if not counts:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    return np.concatenate([u for u, _ in counts]).astype(np.int32), np.concatenate([c / c.sum() for _, c in counts]).astype(np.float32)


class Model:
    """Weights over hashed slots (words, then characters), the two parameters of the calibration, and the length scale."""

    def __init__(self, weights: np.ndarray, bias: float, a: float, b: float):
        self.weights, self.bias, self.a, self.b = weights.astype(np.float32), bias, a, b

    def margin(self, slots: np.ndarray, shares: np.ndarray) -> float:
        """The mean weight of each kind of n-gram, so that a long text counts as much as a short one."""
        return self.bias + float(self.weights[slots] @ shares)

    def probability(self, slots: np.ndarray, shares: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(slots, shares) + self.b, -50, 50))))


def fit(data: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """Adaptive stochastic gradient descent on three quarters of the rows (slots, shares, label), Platt scaling on the
    rest. With one class only, the model gives that class's share."""
    size = 2 << BITS
    ys = np.array([d[2] for d in data], float)
    if len(ys) < 8 or ys.min() == ys.max():
        p = float(np.clip((ys.sum() + 0.5) / (len(ys) + 1), 1e-3, 1 - 1e-3))
        return Model(np.zeros(size), 0.0, 1.0, float(np.log(p / (1 - p))))
    order = np.random.default_rng(seed).permutation(len(data))
    back, train = order[::4], np.setdiff1d(order, order[::4])
    weight = {1: 0.5 / max(ys[train].mean(), 1e-6), 0: 0.5 / max(1 - ys[train].mean(), 1e-6)}
    w, squares, bias, bs = np.zeros(size), np.full(size, 1e-8), 0.0, 1e-8
    rng = np.random.default_rng(seed + 1)
    for _ in range(epochs):
        for k in rng.permutation(train):
            x, v, y = data[k]
            g = (1 / (1 + np.exp(-np.clip(bias + w[x] @ v, -50, 50))) - y) * weight[y]
            gx = g * v
            squares[x] += gx * gx
            w[x] -= rate * gx / np.sqrt(squares[x])
            bs += g * g
            bias -= 0.5 * g / np.sqrt(bs)
    model = Model(w, bias, 1.0, 0.0)
    m = np.array([model.margin(*data[k][:2]) for k in back])
    t = ys[back]
    n1, n0 = t.sum(), len(t) - t.sum()
    t = np.where(t == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -50, 50)))
        h = p * (1 - p) + 1e-9
        g = np.array([((p - t) * m).sum(), (p - t).sum()])
        hess = np.array([[(h * m * m).sum() + 1e-6, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.a, model.b = float(a), float(b)
    return model


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int, where: str = "true") -> list[tuple[np.ndarray, np.ndarray, int]]:
    """At most `sample` labelled rows, those whose ids hash lowest: (slots, shares, label) by that order. Texts become
    features in tasks, so that what reaches the driver is bounded however long they are."""
    l = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(where)  # noqa: E741
    chosen = l.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "y").limit(sample).dropDuplicates(["doc_id"])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y", "h").dropDuplicates(["doc_id"])
    out = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("y", pa.int32()), ("slots", pa.binary()), ("shares", pa.binary())])

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(raw, hash_words(raw)) for raw in raw_texts(batch)]
        return rows(out, *(batch.column(c) for c in ("h", "doc_id", "y")), [u.tobytes() for u, _ in found], [v.tobytes() for _, v in found])

    found = texts.mapInArrow(by_batch(encode), "h long, doc_id long, y int, slots binary, shares binary").collect()
    return [(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["shares"], np.float32), r["y"]) for r in sorted(found, key=lambda r: (r["h"], r["doc_id"]))]


def apply_rules(docs: DataFrame, labels: DataFrame, sample: int = 4000, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, the verdict of the counting rules, and whether it is kept.

    A document is kept if the counting rules pass it and its calibrated probability of good quality reaches
    `threshold`. Null and empty texts have no words and fail the counting rules. Repeated rows each get their row. Where a
    labelled id has several texts or labels, one of them is learned from, whichever Spark meets first.
    """
    short_batches(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    model = fit(labelled(own, labels, "quality", sample))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for raw in raw_texts(batch):
            counts = base(raw)
            p = shared.value.probability(*features(raw, hash_words(raw)))
            out.append((*counts, not counts[-1] and p >= threshold, p))
        return rows(OUT, batch.column("doc_id"), *map(list, zip(*out, strict=True)))

    return own.mapInArrow(by_batch(score), DDL)
