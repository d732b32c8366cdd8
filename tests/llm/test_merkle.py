"""The manifest against a plain tree in memory."""

import hashlib
import zlib

from pyspark.sql import functions as F

from knapline.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, digest string, pos int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        lo = i // 8 * 8
        out.append(("".join(nodes[lo:i]), "".join(nodes[i + 1 : lo + 8])))
        i //= 8
    return out


def expected(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in order:
        langs[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[x] = tree([leaf(r, r[1]) for r in langs[x]])
    top = tree([trees[x][-1][0] for x in order])
    out = []
    for k, x in enumerate(order):
        for i, r in enumerate(langs[x]):
            claimed = r[1]
            if claimed is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                claimed = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in claimed)
            beside = path(trees[x], i) + path(top, k)
            h = leaf(r, claimed)
            for before, after in beside:
                h = digest(before, h, after)
            out.append((r[0], trees[x][0][i], trees[x][-1][0], top[-1][0], digest(*(p for pair in beside for p in pair)), h, h == top[-1][0]))
    return out


def manifest(docs):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.manifest(docs, {"text": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lower).otherwise(F.col("text"))})


def rows_of(n, lang, start=0):
    return [(start + i * 7 % n, f"Text {i} É", lang, "s" if i % 2 else None, i, "k", "d", 1) for i in range(n)]


def check(spark, rows):
    got = [tuple(r) for r in manifest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    assert sorted(got, key=repr) == sorted(expected(rows), key=repr)
    return got


def test_equals_plain_trees(spark):
    """Two passes over one key, runs of one, many keys, a null key beside an empty one."""
    rows = rows_of(4_611, "big") + rows_of(64, None, 10_000) + rows_of(9, "", 20_000) + [r for k in range(9) for r in rows_of(1 + k % 2, f"ß{k}", 30_000 + 10 * k)]
    got = check(spark, rows)
    assert 0 < sum(r[6] for r in got) < len(got)


def test_odd_rows(spark):
    same = (3, "Twice", "en", None, 1, None, None, None)
    check(spark, [same, same, (None, None, None, None, None, None, None, None), (None, "A", "en", None, None, None, None, None), (4, "", "en", "", 0, None, None, None), (5, "É日本" * 20_000, "en", "-", -1, None, None, None)])
    check(spark, [(1, "Alone", "en", None, 1, None, None, None)])
    assert manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_row_verifies_without_claims(spark):
    docs = spark.createDataFrame(rows_of(200, "en"), SCHEMA)
    assert merkle.manifest(docs).where("verified").count() == 200
    one = merkle.manifest(docs, {"n_chars": F.col("n_chars") + 1}, order="doc_id")
    assert one.where("verified").count() == 0 and one.select("root").distinct().first()[0] == merkle.manifest(docs).first()["root"]
