"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words. Every passage of the whole text is encoded; gated attention
weights, learned from document labels alone, say how much each passage counts; the weighted sum is scored.
Fitting takes at most `sample` labelled rows, the documented bound; only their encoded passages reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, hash_words, raw_texts, released, rows, short_batches

PASSAGE, SLOTS = 128, 32
_ALL = np.arange(256)
IS_SPACE = np.isin(_ALL, [32, *range(9, 14)])
#: Indicators of byte classes: upper case, digits, marks of junk, '!', '|', sentence marks, newline, not ASCII.
CLASSES = [(_ALL >= 65) & (_ALL <= 90), (_ALL >= 48) & (_ALL <= 57), np.isin(_ALL, list(b"#*$%&|<>")), _ALL == 33, _ALL == 124, np.isin(_ALL, list(b".,;:?")), _ALL == 10, _ALL >= 128]
WIDTH = len(CLASSES) + 5 + SLOTS


def passages(raw: bytes) -> np.ndarray:
    """(passages, WIDTH): each passage's features. A text without words is one passage of zeros."""
    b = np.frombuffer(raw, np.uint8)
    space = IS_SPACE[b] if len(b) else np.empty(0, bool)
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(b) else np.empty(0, np.int64)
    if not len(starts):
        return np.zeros((1, WIDTH), np.float32)
    cut = starts[::PASSAGE].copy()
    cut[0] = 0
    m = len(cut)
    size = np.diff(np.append(cut, len(b))).astype(np.float64)
    x = np.zeros((m, WIDTH), np.float32)
    for j, is_in in enumerate(CLASSES):
        x[:, j] = np.add.reduceat(is_in[b].astype(np.int32), cut) / size
    h = hash_words(raw)
    of = np.arange(len(h)) // PASSAGE
    n = np.bincount(of, minlength=m)
    j = len(CLASSES)
    order = np.lexsort((h, of))
    same = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (of[order][1:] == of[order][:-1])])
    x[:, j] = np.bincount(of[order], weights=same, minlength=m) / n
    again = np.concatenate([[False], h[1:] == h[:-1]])
    x[:, j + 1] = np.bincount(of, weights=again, minlength=m) / n
    # Words of the passage that also occurred in the text before it: copies of lines and blocks.
    _, first = np.unique(h, return_index=True)
    fresh = np.zeros(len(h), bool)
    fresh[first] = True
    x[:, j + 2] = 1 - np.bincount(of, weights=fresh, minlength=m) / n
    x[:, j + 3] = size / n / 16
    x[:, j + 4] = np.log1p(n) / 8
    slot = (b[:-1].astype(np.uint32) * np.uint32(40503) ^ b[1:].astype(np.uint32) * np.uint32(60493)) >> np.uint32(3) & np.uint32(SLOTS - 1)
    where = np.repeat(np.arange(m), size.astype(np.int64))[: len(slot)]
    x[:, j + 5 :] = np.bincount(where * SLOTS + slot, minlength=m * SLOTS).reshape(m, SLOTS) / size[:, None]
    return x


class Attention:
    """Encoder, gated attention and scorer, with their gradients."""

    def __init__(self, width: int, hidden: int = 24, gate: int = 12, seed: int = 3):
        r = np.random.default_rng(seed)
        g = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": g(width, hidden), "c": np.zeros(hidden), "V": g(hidden, gate), "U": g(hidden, gate), "w": g(gate, 1)[:, 0], "s": g(hidden, 1)[:, 0], "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(width), np.ones(width)

    def forward(self, x: np.ndarray, start: np.ndarray) -> tuple:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        e = np.tanh(x @ p["W"] + p["c"])
        t, u = np.tanh(e @ p["V"]), 1 / (1 + np.exp(-(e @ p["U"])))
        a = (t * u) @ p["w"]
        of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(x))))
        a = np.exp(a - np.maximum.reduceat(a, start)[of])
        a /= np.add.reduceat(a, start)[of]
        z = np.add.reduceat(a[:, None] * e, start, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["s"] + p["d"][0], -50, 50)))
        return x, e, t, u, a, of, z, y

    def gradient(self, x: np.ndarray, start: np.ndarray, label: np.ndarray) -> dict:
        p = self.p
        x, e, t, u, a, of, z, y = self.forward(x, start)
        g = (y - label) / len(label)
        gz = g[:, None] * p["s"]
        ga = (gz[of] * e).sum(1)
        ga = a * (ga - np.add.reduceat(a * ga, start)[of])
        gt, gu = ga[:, None] * p["w"] * u * (1 - t * t), ga[:, None] * p["w"] * t * u * (1 - u)
        ge = a[:, None] * gz[of] + gt @ p["V"].T + gu @ p["U"].T
        gx = ge * (1 - e * e)
        return {"W": x.T @ gx, "c": gx.sum(0), "V": e.T @ gt, "U": e.T @ gu, "w": (t * u).T @ ga, "s": z.T @ g, "d": np.array([g.sum()])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 60, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> Attention:
        if len(labels) and labels.min() != labels.max():
            allx = np.concatenate(bags)
            self.mean, self.scale = allx.mean(0), allx.std(0) + 1e-3
            r, m, v, k = np.random.default_rng(seed), {}, {}, 0
            for epoch in range(epochs):
                order = r.permutation(len(bags))
                for i in range(0, len(order), batch):
                    part = order[i : i + batch]
                    start = np.cumsum([0] + [len(bags[j]) for j in part[:-1]])
                    k += 1
                    for name, g in self.gradient(np.concatenate([bags[j] for j in part]), start, labels[part]).items():
                        g = g + decay * self.p[name]
                        m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                        v[name] = 0.999 * v.get(name, 0) + 0.001 * g * g
                        self.p[name] = self.p[name] - rate * (1 - epoch / epochs) * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.999**k)) + 1e-8)
        else:
            share = (labels.sum() + 0.5) / (len(labels) + 1)
            self.p["s"], self.p["d"] = self.p["s"] * 0, np.array([np.log(share / (1 - share))])
        return self

    def score(self, x: np.ndarray) -> float:
        return float(self.forward(x, np.array([0]))[-1][0])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, where: str = "true") -> Attention:
    """Learns from at most `sample` labelled documents, those whose ids hash lowest."""
    l = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(where)  # noqa: E741
    chosen = l.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "y").limit(sample).dropDuplicates(["doc_id"])
    bag = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("h", pa.int64()), ("x", pa.binary())])
    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        return rows(bag, batch.column("doc_id"), batch.column("y"), batch.column("h"), [passages(raw).tobytes() for raw in raw_texts(batch)])

    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y", "h").mapInArrow(by_batch(encode), "doc_id long, y int, h long, x binary").dropDuplicates(["doc_id"]).collect()
    found.sort(key=lambda r: (r["h"], r["doc_id"]))
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH).astype(np.float64) for r in found]
    return Attention(WIDTH).fit(bags, np.array([r["y"] for r in found], float))


LEARN = "crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"


def score(docs: DataFrame, labels: DataFrame, sample: int = 4000, threshold: float = 0.7, where: str = LEARN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document.

    Only the text enters the score. A null or empty text is one passage of zeros and is scored like any other. A
    null id is not held out. Repeated rows each get their row; without labels every score is one half. Where a labelled id
    has several texts or labels, one of them is learned from, whichever Spark meets first.
    """
    short_batches(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(own, labels, sample, where))
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return rows(out, batch.column("doc_id"), [model.value.score(passages(raw)) for raw in raw_texts(batch)])

    held = F.expr(f"not coalesce({LEARN}, true)")
    return own.mapInArrow(by_batch(run), "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, sample: int = 4000, threshold: float = 0.7, text_col: str = "text", taught: DataFrame | None = None) -> DataFrame:
    """The rows of docs, all columns, whose text's score reaches the threshold. taught: the labelled texts, if they
    aren't in docs. A row with an empty text is scored like any other."""
    short_batches(docs.sparkSession)
    own = (docs if taught is None else taught).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(own, labels, sample, LEARN))
    at = docs.columns.index(text_col)

    @released
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                raw = [t or b"" for t in part.column(at).cast(pa.binary()).to_pylist()]
                yield part.filter(pa.array([model.value.score(passages(t)) >= threshold for t in raw], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
