"""Toxicity by a classifier chain.

Categories in order: low quality, toxic, severe (toxic with several of the words that mark toxic rows). Labels name the
first two only, so that the third is drawn from them: its words are those that mark the other folds' toxic rows. The
linear model of a category sees word features and the probabilities of the categories before it; in training these are
out-of-fold predictions, by word lists that were chosen without the fold as well, so that a later model doesn't trust
what earlier ones only remember. Beside whole words stand the runs of four letters in them, ends of words included: they
are shared by inflected and compounded forms of which each is rare. Fitting takes at most `sample` labelled rows, the
documented bound; their terms are counted in tasks and only counts of chosen ones reach the driver. A term's count enters
as 3 if it is more.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, rows, settle, short_batches, texts

WORD = re.compile(r"[^\W\d_]+")
CATEGORIES = ("low_quality", "toxic", "severe")
LEARN = "crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"
MARKS = "#*$%&|<>!"
SEVERE, MOST = 3, 3  # marking words of a severe row; what a word counts at most
FOLDS = 5


def words(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


GRAM = 4


def grams(word: str) -> list[str]:
    """The runs of GRAM letters of a word between its ends, marked so that none is a word."""
    ends = f"^{word}$"
    return [f"#{ends[i : i + GRAM]}" for i in range(len(ends) - GRAM + 1)]


def terms(counts: Counter) -> Counter:
    """Words and their grams."""
    out = Counter(counts)
    for w, c in counts.items():
        for g in grams(w):
            out[g] += c
    return out


@functools.cache
def _upper() -> np.ndarray:
    """Which code points are capitals."""
    return np.fromiter((chr(c).isupper() for c in range(0x110000)), bool, 0x110000)


def capitals(text: str) -> int:
    return int(_upper()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].sum())


def shape(text: str, n: int) -> list[float]:
    """How a text looks, whatever its words: share of marks and capitals in the whole of it, size."""
    size = max(1, len(text))
    return [sum(map(text.count, MARKS)) / size * 10, capitals(text) / size, np.log1p(n) / 8]


class Linear:
    """Logistic regression, l2-regularised, by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.3):
        n, d = x.shape
        a = np.column_stack([x, np.ones(n)])
        self.w = np.zeros(d + 1)
        if not n:
            return
        penalty = np.full(d + 1, ridge)
        penalty[-1] = 1e-3
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ self.w, -30, 30)))
            g = a.T @ (p - y) + penalty * self.w
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), g)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.w[:-1] + self.w[-1], -30, 30)))


class Chain:
    def __init__(self, lexicon: dict[str, int], models: list[Linear]):
        self.lexicon, self.models = lexicon, models
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, word: str) -> tuple[int, ...]:
        """The places of a word and of its grams among the features. Remembered for as many words as a task needs."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 50_000:
                self.known.clear()
            found = self.known[word] = tuple(k for t in (word, *grams(word)) if (k := self.lexicon.get(t)) is not None)
        return found

    def features(self, text: str, counts: Counter) -> np.ndarray:
        x = np.zeros(len(self.lexicon) + 3)
        for w, c in counts.items():
            for k in self.of(w):
                x[k] += c
        np.minimum(x, MOST, out=x)
        x[len(self.lexicon) :] = shape(text, counts.total())
        return x

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for model in self.models:
            out.append(model(np.column_stack([x, *out])))
        return np.column_stack(out)


def lexicons(bags: DataFrame, size: int, least: int, folds: int = FOLDS) -> list[tuple[list[str], set[str]]]:
    """The terms whose presence differs most between toxic and other rows, by log odds weighted by support, and the words
    among them that mark toxic rows: first of all rows, then without each fold. Counted over rows (t, fold, words); only
    the chosen terms reach the driver."""
    t = F.col("t")
    counted = bags.select("t", "fold", F.explode("words").alias("word")).groupBy("word").agg(*(F.sum(F.when(F.col("fold") == k, y).otherwise(0)).alias(f"{c}{k}") for k in range(folds) for c, y in (("a", t), ("b", 1 - t))))
    total = bags.agg(*(F.sum(F.when(F.col("fold") == k, y).otherwise(0)).alias(f"{c}{k}") for k in range(folds) for c, y in (("a", t), ("b", 1 - t)))).first()
    counted = settle(counted.where(" + ".join(f"a{k}" for k in range(folds)) + f" >= {least}"))
    out = []
    for held in (None, *range(folds)):
        use = [k for k in range(folds) if k != held]
        n1, n0 = (max(1, sum(total[f"{c}{k}"] or 0 for k in use)) for c in "ab")
        a, b = (sum((F.col(f"{c}{k}") for k in use), F.lit(0)) for c in "ab")
        own = counted.select("word", a.alias("a"), b.alias("b")).where(F.col("a") >= least)
        odds = F.log((F.col("a") + 0.5) / (n1 - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (n0 - F.col("b") + 0.5))
        top = own.withColumn("odds", odds).orderBy(F.desc(F.col("odds") * F.sqrt("a")), "word").limit(size).collect()
        out.append(([r["word"] for r in top], {r["word"] for r in top if r["odds"] > 3 and r["word"][0] != "#"}))
    return out


def fit(chain: Chain, views: list[np.ndarray], fold: np.ndarray, quality: np.ndarray, toxic: np.ndarray, hits: np.ndarray) -> Chain:
    """views: features of labelled rows in a fixed order by the words of all, then by those chosen without each fold;
    hits: how many words of each row mark toxic rows of other folds."""
    targets = [1.0 - quality, toxic.astype(float), ((toxic == 1) & (hits >= SEVERE)).astype(float)]
    before: list[np.ndarray] = []
    for y in targets:
        chain.models.append(Linear(np.column_stack([views[0], *before]), y))
        out = np.zeros(len(y))
        for k, view in enumerate(views[1:]):
            if (fold == k).any():
                here = np.column_stack([view, *before])
                out[fold == k] = Linear(here[fold != k], y[fold != k])(here[fold == k])
        before.append(out)
    return chain


def score(docs: DataFrame, labels: DataFrame, sample: int = 20_000, threshold: float = 0.35, size: int = 128, least: int = 4, where: str = LEARN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, low_quality, toxic, severe, is_toxic): each category's probability and the verdict, for every row.

    A null or empty text has no words and is scored on its shape alone. Rows whose label is null are not learned
    from. Without labels every probability is one half and no row is toxic above it.
    """
    short_batches(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    l = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t")).where("doc_id is not null and q in (0, 1) and t in (0, 1)").where(where)  # noqa: E741
    chosen = l.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "q", "t").limit(sample).dropDuplicates(["doc_id"])
    taught = settle(own.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "h", "q", "t").dropDuplicates(["doc_id"]))
    fold = F.expr(f"cast(pmod(h, {FOLDS}) as int)").alias("fold")
    bag = pa.schema([("t", pa.int32()), ("fold", pa.int32()), ("words", pa.list_(pa.string()))])
    bags = taught.select("text", "t", fold).mapInArrow(by_batch(lambda b: rows(bag, b.column("t"), b.column("fold"), [list(terms(words(t))) for t in texts(b)]), 32), "t int, fold int, words array<string>")
    lists = lexicons(bags, size, least)
    every = {w: k for k, w in enumerate(sorted(set().union(*(own for own, _ in lists))))}
    seen = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("q", pa.int32()), ("t", pa.int32()), ("fold", pa.int32()), ("hits", pa.int64()), ("counts", pa.binary()), ("shape", pa.list_(pa.float64()))])

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        hits, counts, looks = [], [], []
        for text, k in zip(texts(batch), batch.column("fold").to_pylist(), strict=True):
            bag = words(text)
            hits.append(sum(bag[w] for w in lists[1 + k][1]))
            looks.append(shape(text, bag.total()))
            bag = terms(bag)
            counts.append(bytes(min(MOST, bag[w]) for w in every))
        return rows(seen, *(batch.column(c) for c in ("doc_id", "h", "q", "t", "fold")), hits, counts, looks)

    found = taught.select("doc_id", "text", "h", "q", "t", fold).mapInArrow(by_batch(look, 32), "doc_id long, h long, q int, t int, fold int, hits long, counts binary, shape array<double>").collect()
    found.sort(key=lambda r: (r["h"], r["doc_id"]))
    counts = np.frombuffer(b"".join(r["counts"] for r in found), np.uint8).reshape(len(found), len(every)).astype(float)
    looks = np.array([r["shape"] for r in found], float).reshape(len(found), 3)
    views = [np.column_stack([counts[:, [every[w] for w in own]], looks]) for own, _ in lists]
    chain = Chain({w: k for k, w in enumerate(lists[0][0])}, [])
    fit(chain, views, *(np.array([r[c] for r in found], int) for c in ("fold", "q", "t", "hits")))
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    out = pa.schema([("doc_id", pa.int64()), *((c, pa.float64()) for c in CATEGORIES), ("is_toxic", pa.bool_())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = texts(batch)
        x = np.array([shared.value.features(text, words(text)) for text in t]).reshape(len(t), -1)
        p = shared.value.probabilities(x)
        return rows(out, batch.column("doc_id"), p[:, 0], p[:, 1], p[:, 2], p[:, 1] > threshold)

    return own.mapInArrow(by_batch(run, 64), "doc_id long, low_quality double, toxic double, severe double, is_toxic boolean")
