"""Vector codes against plain loops over whole numbers."""

import hashlib
import random

import numpy as np
import pytest

from knapline.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, g string, `n` long"
NAN, INF = float("nan"), float("inf")


def nearest(x, book):
    d = [sum((int(a) - int(b)) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
    return d.index(min(d)), min(d)


def expected(rows):
    kept = sorted((r for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[int(np.floor(np.float64(np.float32(v)) * 1024)) for v in r[1]] for r in kept]
    width = len(whole[0]) // 4
    books, found = [], []
    for p in range(4):
        x = [w[p * width : (p + 1) * width] for w in whole]
        book = [list(v) for v in x[:256]]
        for _ in range(4):
            groups = {}
            for v in x:
                groups.setdefault(nearest(v, book)[0], []).append(v)
            for e, members in groups.items():
                book[e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
        books.append(book)
        found.append([nearest(v, book) for v in x])
    sums = {}
    errors = [sum(f[i][1] for f in found) for i in range(len(kept))]
    for r, e in zip(kept, errors, strict=True):
        sums[r[2]] = sums.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return [(r[0], "".join(f"{f[i][0]:02x}" for f in found), errors[i], sums[r[2]], sha) for i, r in enumerate(kept)]


def check(spark, rows):
    got = [tuple(r) for r in codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    assert sorted(got, key=repr) == sorted(expected(rows), key=repr)


def test_equals_plain_loops(spark):
    r = random.Random(4)
    near = [[r.gauss(0, 1) for _ in range(8)] for _ in range(20)]
    rows = [(1000 - i, [v + r.gauss(0, 0.01) for v in r.choice(near)], r.choice([None, 0, 1]), None, None, None) for i in range(400)]
    check(spark, rows)


def test_few_odd_repeated_and_tied_rows(spark):
    """Ties: whole numbers on a small grid, copies among the first ids, entries that nothing is nearest to."""
    r = random.Random(5)
    rows = [(i // 2, [float(r.choice([-1, 0, 1])) / 1024 for _ in range(4)], i % 3 or None, "x", "y", 1) for i in range(300)]
    rows += [rows[0]] * 40 + [(None, [0.0] * 4, None, None, None, None), (7, None, 1, None, None, None), (8, [0.0, NAN, 0.0, 0.0], 1, None, None, None), (9, [INF, 0.0, 0.0, 0.0], 1, None, None, None), (10, [0.0, None, 0.0, 0.0], 1, None, None, None)]
    check(spark, rows)
    check(spark, rows[:3])
    bad = [(1, None, 1, None, None, None), (2, [NAN] * 4, None, None, None, None)]
    for none in ([], bad):
        empty = codes.compress(spark.createDataFrame(none, SCHEMA))
        assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [0.0] * 6, 1, None, None, None)], SCHEMA))


def test_many_labels_are_joined_by_salted_labels(spark, monkeypatch):
    monkeypatch.setattr(codes, "LABELS", 3)
    rows = [(i, [i % 7 / 8.0, i % 5 / 8.0, 0.0, 1.0], i % 20 or None, None, None, None) for i in range(200)]
    check(spark, rows)


def test_screen_intervals_hold_the_exact_scores():
    """Large components, where float32 products round, and entries so near each other that intervals overlap."""
    r = np.random.default_rng(1)
    for size in (100, 1 << 13, 1 << 24, (1 << 27) - 1):
        book = r.integers(-size, size, (200, 16))
        book[100:] = book[:100] + r.integers(-2, 3, (100, 16))
        book = np.clip(book, 1 - size, size - 1)
        x = np.concatenate([book[50:150] + r.integers(-1, 2, (100, 16)), r.integers(-size, size, (200, 16))])
        screen = codes.Screen(book)
        lower, upper = screen.intervals(x)
        exact = [[int((c * c).sum()) - 2 * sum(int(a) * int(b) for a, b in zip(v, c, strict=True)) for c in screen.book] for v in x]
        # Exact whole numbers on one side, floats on the other: Python compares them without rounding.
        assert all(lo <= e <= hi for row, los, his in zip(exact, lower.tolist(), upper.tolist(), strict=True) for e, lo, hi in zip(row, los, his, strict=True))
        entry, far = screen.nearest(x)
        d = ((x[:, None, :].astype(object) - book[None, :, :]) ** 2).sum(axis=2)
        assert entry.tolist() == [row.tolist().index(min(row)) for row in d] and far.tolist() == [min(row) for row in d]
        overlapping = (lower <= upper.min(axis=1)[:, None]).sum()
        assert len(x) <= overlapping < len(x) * len(screen.book)
