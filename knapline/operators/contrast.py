"""Contrastive training of a linear head over pairs of views, data-parallel: rows are dealt into batches anew in every
epoch, each task sums the gradients of its batches, and only losses and gradients of the head's size reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import Scratch
from .sampling import batches, uniform

# Temperature and batch size.
TEMPERATURE = 0.07
BATCH = 16


def views(v: DataFrame, share: float = 0.25, seed: int = 42) -> DataFrame:
    """(id, a, b): two views of each vector (id, v), in each of which other random components are 0."""
    masked = lambda k: F.transform("v", lambda x, i: F.when(uniform(F.col("id"), i, F.lit(seed + k)) < share, 0.0).otherwise(x))
    return v.select("id", masked(0).alias("a"), masked(1).alias("b"))


def loss_and_gradient(w: np.ndarray, a: np.ndarray, b: np.ndarray, temperature: float = TEMPERATURE) -> tuple[float, np.ndarray]:
    """Mean over all views of a batch of -log of the softmax, over all others, of the similarity with the other view of
    the same row; and its gradient. Similarities are cosines of projected views over the temperature."""
    x = np.concatenate([a, b])
    h = x @ w
    size = np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)
    z = h / size
    s = z @ z.T / temperature
    np.fill_diagonal(s, -np.inf)
    s -= s.max(axis=1, keepdims=True)
    p = np.exp(s)
    total = p.sum(axis=1, keepdims=True)
    n = len(x)
    rows, other = np.arange(n), (np.arange(n) + len(a)) % n
    loss = float(np.mean(np.log(total[:, 0]) - s[rows, other]))
    g = p / total
    g[rows, other] -= 1
    dz = (g + g.T) @ z / (temperature * n)
    dh = (dz - z * (z * dz).sum(axis=1, keepdims=True)) / size
    return loss, x.T @ dh


def _pass(pairs: DataFrame, w: np.ndarray, seed: int, size: int, temperature: float) -> tuple[float, np.ndarray, int]:
    """(sum of losses, sum of gradients, batches) of one epoch."""
    shape = w.shape

    def run(parts):
        loss, grad, n = 0.0, np.zeros(shape), 0
        left = None
        for pdf in parts:
            # Sorted by batch: all but the last batch of what has come is whole.
            pdf = pdf if left is None else pd.concat([left, pdf])
            last = pdf["batch"].iloc[-1] if len(pdf) else None
            left = pdf[pdf["batch"] == last]
            for _, rows in pdf[pdf["batch"] != last].groupby("batch"):
                one = loss_and_gradient(w, np.stack(rows["a"]), np.stack(rows["b"]), temperature)
                loss, grad, n = loss + one[0], grad + one[1], n + 1
        if left is not None and len(left):
            one = loss_and_gradient(w, np.stack(left["a"]), np.stack(left["b"]), temperature)
            loss, grad, n = loss + one[0], grad + one[1], n + 1
        yield pd.DataFrame({"loss": [loss], "grad": [grad.ravel()], "n": [n]})

    dealt = pairs.join(batches(pairs.select("id"), "id", size, seed), "id").repartition("batch").sortWithinPartitions("batch", "id")
    found = dealt.select("batch", "a", "b").mapInPandas(run, "loss double, grad array<double>, n long").where("n > 0").collect()  # a row a task
    found = sorted(found, key=lambda r: (r["n"], r["loss"]))
    return sum(r["loss"] for r in found), sum((np.array(r["grad"]).reshape(shape) for r in found), np.zeros(shape)), sum(r["n"] for r in found)


def train(pairs: DataFrame, width: int = 16, epochs: int = 10, size: int = BATCH, temperature: float = TEMPERATURE, rate: float = 0.02, decay: float = 1e-4, seed: int = 42) -> tuple[np.ndarray, DataFrame]:
    """(head, losses): a matrix that projects vectors, and (epoch, n_batches, loss), the mean of each epoch's batch losses.

    pairs: (id, a, b) with vectors of one length. An epoch takes one step of Adam with decoupled weight decay by the mean
    gradient of its batches. Batches have `size` rows, a last one of a single row is left out; fewer than two rows give no
    epochs.
    """
    spark = pairs.sparkSession
    schema = "epoch int, n_batches long, loss double"
    with Scratch(spark) as scratch:
        pairs = scratch.settle(pairs.where("a is not null and b is not null").select("id", "a", "b"))
        first = pairs.select(F.size("a").alias("d")).first()
        rows = []
        w = np.random.default_rng(seed).normal(size=(first["d"] if first else 0, width)) / max(1, first["d"] if first else 1) ** 0.5
        m, v = np.zeros_like(w), np.zeros_like(w)
        for epoch in range(1, epochs + 1):
            loss, grad, n = _pass(pairs, w, seed + epoch, size, temperature) if first else (0, 0, 0)
            if not n:
                break
            rows.append((epoch, n, loss / n))
            grad = grad / n
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w = w * (1 - rate * decay) - rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    return w, spark.createDataFrame(rows, schema)
