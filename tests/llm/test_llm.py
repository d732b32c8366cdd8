"""The operators against brute force, exact round trips and held-out labels, and on odd rows."""

import array
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from knapline.llm import bpe, classify, components, jaccard, licenses, neighbours, packing, queries, rules, secrets, substrings, toxicity
from knapline.llm.common import hash_words

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, `__class` string, cid string"
WORDS = "the of and to in that was his he it with is for as had you not be her on at by which have or from this him but all".split()


def odd_rows():
    r = random.Random(5)
    base = " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(300))
    near = base.split()
    near[150] = "changed"
    texts = [None, "", " \t\n", "one", "a b c", base, base, " ".join(near), base[:600] + " tail " + base[600:], "x" * 5000, "é ü 日本 " * 40, "ab " * 3000, base.upper(), 'password: "hunter22secret" AKIA' + "A1" * 12, "Released under the MIT License.", "<|endoftext|> x  y \n", base + " " + " ".join(r.choice(WORDS) for _ in range(20_000))]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", 1, "k", "c", None) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(17)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary_path())


def texts_of(rows):
    return [r[1] or "" for r in rows]


def test_hash_words():
    raw = "  a b\x0bbb\ta\n a-b é a".encode()
    h = hash_words(raw)
    w = raw.split()
    assert len(h) == len(w) and [h[i] == h[j] for i in range(len(w)) for j in range(len(w))] == [w[i] == w[j] for i in range(len(w)) for j in range(len(w))]
    assert len(hash_words(b" \n")) == 0
    r = random.Random(3)
    words = list({"".join(r.choice("ab\0é") for _ in range(r.choice([1, 7, 8, 9, 16, 17, 63, 64, 65, 300]))) for _ in range(600)} | {thue_morse(n)[k] for n in (64, 256, 1024, 2048) for k in (0, 1)})
    hashes = hash_words(" ".join(words + words).encode()).tolist()
    assert hashes[: len(words)] == hashes[len(words) :] and len(set(hashes)) == len(words)


def thue_morse(n):
    """Two different words of n letters that collide in every polynomial hash modulo a power of two, if long enough."""
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_colliding_words_are_different_words(spark):
    a, b = thue_morse(1024)
    assert rules.base(f"{a} {a} {a} x {b} {b} {b}".encode())[4] == 0
    docs = spark.createDataFrame([(0, f"{a} one two three"), (1, f"{b} one two three")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.join(docs).collect()} == {0: 0, 1: 1}


def test_bpe_equals_library(tokenizer):
    code, back = bpe.transducer(queries.vocabulary_path()), bpe.Decoder(bpe.vocabulary(queries.vocabulary_path()))
    r = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "\t", "!", "'s", "1", "é", "日", "\xa0", "ing", "'ll", "<|endoftext|>", "\x85", "\x1c", "👍🏽", "​"]
    cases = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)] + texts_of(odd_rows())
    cases += ["".join(r.choice("abcdehtion") for _ in range(7000)), "=" * 9000, "ab" * 4000]
    cases += [f"a{chr(c)}b {chr(c)}{chr(c)}" for c in range(0, 0x11000, 61) if not 0xD800 <= c < 0xE000]
    for t in cases:
        want = tokenizer.encode(t, add_special_tokens=False).ids
        got = code.encode(t)
        assert list(array.array("I", got)) == want, t[:80]
        assert "".join(back(got)) == tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_query(spark, odd, none, tokenizer):
    rows = bpe.round_trip(odd, queries.vocabulary_path()).collect()
    want = Counter((r[0], len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in odd_rows())
    assert Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in rows) == want
    assert bpe.round_trip(none, queries.vocabulary_path()).count() == 0
    ids = bpe.encode(odd, queries.vocabulary_path())
    assert sorted(r["text"] for r in bpe.decode(ids, queries.vocabulary_path()).collect()) == sorted(texts_of(odd_rows()))


def test_packing(spark, odd, none, tokenizer):
    assert packing.pack(none, queries.vocabulary_path()).count() == 0
    docs = odd.unionByName(spark.createDataFrame([(100 + i, "some words " * (i * 7 % 90), None, None, None, None, None, None) for i in range(200)], SCHEMA)).where("doc_id is not null").dropDuplicates(["doc_id"])
    ids = {r["doc_id"]: array.array("I", [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in docs.collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, queries.vocabulary_path(), open_windows=4).collect():
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == ids.keys()
    for doc, found in by_doc.items():
        at = 0
        for r in sorted(found, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[doc]) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[doc][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[doc])
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0


def brute_substrings(texts, length):
    seen = Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                cover[s : s + length] = True
        out.append((len(t), int(cover.sum()), int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~cover])).hexdigest()))
    return out


@pytest.mark.parametrize("length", [400, 60])
def test_substrings(spark, odd, none, length):
    raw = [(t or "").encode() for t in texts_of(odd_rows())]
    want = Counter(zip([r[0] for r in odd_rows()], brute_substrings(raw, length)))
    got = Counter((r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in substrings.report(odd, length).collect())
    assert got == want
    assert substrings.report(none, length).count() == 0


def test_substrings_random(spark):
    r = random.Random(8)
    pool = ["".join(r.choice("ab c") for _ in range(300)) for _ in range(6)]
    texts = ["".join(r.choice(pool)[r.randint(0, 150) :] + r.choice(["", "x", "\0", "\0\0"]) for _ in range(4)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in substrings.report(docs, 100).collect()}
    assert [got[i] for i in range(60)] == brute_substrings([t.encode() for t in texts], 100)


def test_substrings_copies(spark):
    """Two hundred copies of one text beside texts that share parts of it: nothing is done once for each pair of copies."""
    r = random.Random(5)
    base = "".join(r.choice("abcdefgh ") for _ in range(3000))
    texts = [base] * 200 + [base[k * 40 : k * 40 + 900] + f" {k} " + base[:k] for k in range(40)] + ["x" + base[100:1500], base[:399]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in substrings.report(docs, 400).collect()}
    assert [got[i] for i in range(len(texts))] == brute_substrings([t.encode() for t in texts], 400)


def test_substrings_across_boundaries(spark):
    """Many ends of one passage with other words before and behind, dealt over more buckets than it has."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(40))
    texts = [" ".join([*(word() for _ in range(20)), passage[r.randint(0, 30) : len(passage) - r.randint(0, 30)], *(word() for _ in range(20))]) for _ in range(150)]
    texts += [t[-330:] + t[:200] for t in texts[:30]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in substrings.report(docs, 120).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [got[i] for i in range(len(texts))] == brute_substrings([t.encode() for t in texts], 120)


def brute_repeated_words(texts, n):
    words = [t.encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    return [len({i + j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(n)}) for w in words]


def test_repeated_words(spark, odd):
    want = Counter(zip([r[0] for r in odd_rows()], brute_repeated_words(texts_of(odd_rows()), 50)))
    assert Counter((x["doc_id"], x["n_repeated_words"]) for x in substrings.report(odd).collect()) == want


def test_separators():
    r = random.Random(3)
    drawn = sorted("".join(r.choice("ab") for _ in range(r.randint(0, 12))).encode() for _ in range(400))
    found = substrings.separators(drawn, 50)
    assert found == sorted(set(found)) and substrings.separators([], 9) == []
    for s in found:
        below = [d for d in drawn if d < s]
        assert all(d >= s for d in drawn[len(below) :]) and len(found) > 20


def test_multikey_quicksort():
    r = random.Random(1)
    s = ["".join(r.choice("ab\0") for _ in range(r.randint(0, 40))).encode() for _ in range(700)]
    x = substrings.as_words(s)
    order = substrings.multikey_quicksort(s, x)
    padded = [s[i].ljust(48, b"\0") for i in order]
    assert padded == sorted(padded) and sorted(order) == list(range(700))
    shared = substrings.common_prefixes(order, x, np.array([len(t) for t in s]))
    for k in range(1, 700):
        a, b = s[order[k - 1]], s[order[k]]
        n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert shared[k] == n


def test_strip(spark, odd, none):
    r = random.Random(3)
    mark = " ".join(f"p{r.randint(0, 10**6)}" for _ in range(60))
    clean = ["  ".join(f"w{r.randint(0, 10**6)}" for _ in range(80)) for _ in range(6)]
    docs = spark.createDataFrame([(i, c + "\n" + (mark if i < 3 else "") + " end" + str(i)) for i, c in enumerate(clean)] + [(9, None)], "doc_id long, text string")
    got = {x["doc_id"]: x["text"] for x in substrings.strip(docs).collect()}
    for i, c in enumerate(clean):
        assert got[i].startswith(c) and got[i].endswith(f"end{i}") and "p" not in got[i].replace(c, "")
    assert got[9] is None
    assert substrings.strip(odd).columns == odd.columns and substrings.strip(odd).count() == odd.count()
    assert substrings.strip(none).count() == 0


def brute_components(texts, k, num, den):
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + min(k, len(w))]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    roots = components.Roots()
    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * common >= num * len(sets[i] | sets[j]):
                roots.join(i, j)
    return [len(s) for s in sets], [roots.find(i) for i in range(len(sets))]


@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard(spark, none, block, monkeypatch):
    r = random.Random(4)
    bases = [[f"w{r.randint(0, 5000)}" for _ in range(n)] for n in (40, 120, 200)]
    texts = ["", " ", "a b", "A  b", "a b c"]
    for b in bases:
        for _ in range(25):
            t = list(b)
            for _ in range(r.randint(0, 6)):
                t[r.randrange(len(t))] = f"e{r.randint(0, 10**6)}"
            texts.append(" ".join(t))
    texts += texts[:12]
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, cid string").repartition(4)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.join(docs).collect()}
    sizes, roots = brute_components(texts, 4, 85, 100)
    assert [got[i] for i in range(len(texts))] == list(zip(sizes, roots))
    assert jaccard.join(none).count() == 0


def test_jaccard_odd(odd):
    rows = jaccard.join(odd).collect()
    assert len(rows) == odd.count()
    by = {x["doc_id"]: x for x in rows if x["doc_id"] is not None}
    assert by[5]["component_id"] == by[6]["component_id"] == by[7]["component_id"] == by[12]["component_id"] == 5
    assert by[0]["component_id"] == 0 and by[1]["n_shingles"] == 0
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    ids = Counter(x["doc_id"] for x in kept.collect())
    assert ids[5] == 1 and not ids.keys() & {6, 7, 12} and {0, 1, 2, 3} <= ids.keys()


def test_a_pair_belongs_to_one_group():
    """Of groups that share members, each pair is verified in the first only, and all links are found."""
    r = np.random.default_rng(5)
    base = np.unique(r.integers(0, 1 << 62, 60).astype(np.uint64))
    sets = {c: np.unique(np.concatenate([np.delete(base, r.integers(0, 60, 2)), [np.uint64(c)]])) for c in range(1, 15)}
    groups = {1: range(1, 15), 2: range(2, 15), 3: [3, 5, 9]}
    run, _ = jaccard._verify(85, 100)
    found = [(g, c, [x for x in groups if x < g and c in groups[x]]) for g in groups for c in groups[g]]
    batch = pa.RecordBatch.from_pydict({"leader": [f[0] for f in found], "i": [0] * len(found), "j": [0] * len(found), "side": [0] * len(found), "cid": [f[1] for f in found], "s": [sets[f[1]].tobytes() for f in found], "earlier": [f[2] for f in found]})
    edges = [e for b in run([batch]) for e in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]
    want, got = components.Roots(), components.Roots()
    for a in sets:
        for b in range(a + 1, 15):
            if jaccard.linked(sets[a], sets[b], 85, 100):
                want.join(a, b)
    for a, b in edges:
        assert jaccard.linked(sets[a], sets[b], 85, 100)
        got.join(a, b)
    assert [got.find(c) for c in sets] == [want.find(c) for c in sets]
    assert not list(run([batch.filter(pa.array([f[0] > 1 for f in found]))]))


def test_signatures_bound_differences():
    r = np.random.default_rng(0)
    for n in (5, 70, 300, 1100):
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        for cut in (0, 1, n // 20):
            b = np.unique(np.concatenate([a[cut:], r.integers(0, 1 << 63, cut).astype(np.uint64)]))
            sizes, sigs = np.array([len(a), len(b)]), [jaccard.signature(a), jaccard.signature(b)]
            common = len(np.intersect1d(a, b))
            if 100 * common >= 85 * (len(a) + len(b) - common):
                pairs = {(int(i), int(j)) for i, js in jaccard.near(sizes, sigs, 85, 100, np.arange(2), np.arange(2)) for j in js}
                assert (0, 1) in pairs or (1, 0) in pairs


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(80)]
    roots = components.Roots()
    for a, b in edges:
        roots.join(a, b)
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()))
    assert got == {x: roots.find(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_neighbours(rows, k):
    good = {i: np.array(v, float) for i, v in rows if v is not None and i is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v) and len(v) == 8}
    out = {}
    for q in good:
        if q % 100 == 0:
            d = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)
            out[q] = d[:k]
    return out


def test_neighbours(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=8).round(2).tolist()) for i in range(1500)]
    rows += [(3000 + i, rows[7][1]) for i in range(300)] + [(5000, None), (5001, [0.0] * 8), (5100, [float("nan")] * 8), (5200, [None] * 8), (None, rows[1][1]), (5300, [1.0]), rows[100]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    rows = [(x["vec_id"], x["embedding"]) for x in df.collect()]
    got = defaultdict(list)
    for x in neighbours.search(df).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["score"], x["vec_id"]))
    want = brute_neighbours(rows, 10)
    assert got.keys() == want.keys()
    hit = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        assert found == sorted(found) and len(found) == 10 and q not in {i for _, i in found}
        assert all(s == pytest.approx(dict((i, d) for d, i in want[q]).get(i, s), abs=1e-12) for s, i in found)
    assert got[3000][0][0] == 0.0 and [i for _, i in got[3000]] == [7, *range(3001, 3010)]
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>")
    assert neighbours.search(few, every=1).count() == 12
    assert neighbours.search(few.limit(0)).count() == 0
    twice = spark.createDataFrame([(0, [1.0, 0.0], "a"), (0, [0.0, 1.0], "b"), (1, [1.0, 0.1], "c")], "vec_id long, embedding array<double>, query_id string")
    assert [tuple(x) for x in neighbours.search(twice).select("query_id", "rank", "vec_id", F.round("score", 6)).orderBy("score").collect()] == [(0, 1, 1, 0.1), (0, 1, 1, round(1.81**0.5, 6))]


def test_a_radius_ends_the_search_of_structured_vectors():
    r = np.random.default_rng(4)
    centres = r.normal(size=(100, 16)) * 10
    x = (centres[:, None] + r.normal(size=(100, 200, 16))).reshape(-1, 16)
    x = x[r.permutation(len(x))]
    forest, q = neighbours.Forest(x, 4, 50), x[::500]
    where, radius = forest.assign(x), neighbours.radii(x[: neighbours.PROBE], q, 11)
    for row, near in zip(q, radius, strict=True):
        seen = forest.search(row, 1, 1.0, near)
        assert len(seen) < 0.1 * forest.leaves
        found = np.isin(where, seen).any(axis=1)
        assert found[np.argsort(((x - row) ** 2).sum(axis=1))[:11]].all()
    assert len(forest.search(q[0], 1, 1.0)) == forest.leaves
    assert np.isinf(neighbours.radii(x[:5], q, 11)).all()


def test_shortlists_hold_the_nearest():
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(200, 8)), r.normal(size=(200, 8)) * 1e6, r.integers(0, 2, size=(200, 8)).astype(float)])
    q = np.concatenate([x[::7], np.full((1, 8), 1e200)])
    for row, some in zip(q, neighbours.shortlists(x, q, 11), strict=True):
        d = neighbours.distances(x, row)
        assert set(np.flatnonzero(d < np.sort(d)[10])) <= set(some) and np.sum(d[some] <= np.sort(d)[10]) >= 11


def test_classifier(spark, odd, none, labels):
    docs, marks = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = classify.score(docs, marks).join(marks, "doc_id").where("held_out").collect()
    assert len(rows) > 60 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95
    found = classify.score(odd, labels).collect()
    assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
    assert {r["score"] for r in classify.score(odd, labels.limit(0)).collect()} == {0.5}
    assert classify.score(none, labels).count() == 0
    assert classify.keep(odd, labels).columns == odd.columns


def brute_attention(p, x, bounds):
    from math import exp, tanh

    out = []
    for lo, hi in zip(bounds, bounds[1:]):
        encoded = [[tanh(sum(v * w for v, w in zip(np.clip(row, -8, 8), col)) + c) for col, c in zip(p["W"].T, p["c"])] for row in x[lo:hi]]
        gated = []
        for e in encoded:
            t = [tanh(sum(v * w for v, w in zip(e, col))) for col in p["V"].T]
            u = [1 / (1 + exp(-sum(v * w for v, w in zip(e, col)))) for col in p["U"].T]
            gated.append(sum(a * b * w for a, b, w in zip(t, u, p["w"])))
        weights = [exp(g) / sum(map(exp, gated)) for g in gated]
        z = [sum(w * e[k] for w, e in zip(weights, encoded)) for k in range(len(p["s"]))]
        out.append(1 / (1 + exp(-(sum(v * w for v, w in zip(z, p["s"])) + p["d"][0]))))
    return out


def test_attention_against_loops():
    """The scores of gated attention equal those of plain loops over the passages of each document."""
    r = np.random.default_rng(1)
    model = classify.Attention(6, 5, 4)
    x, start = r.normal(size=(7, 6)), np.array([0, 2, 3])
    got = model.forward(x, start)[-1]
    want = brute_attention(model.p, x, [*start, 7])
    assert got == pytest.approx(want)


def test_attention_gradient():
    r = np.random.default_rng(0)
    model = classify.Attention(6, 5, 4)
    x, start, y = r.normal(size=(7, 6)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.forward(x, start)[-1]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = model.gradient(x, start, y)
    for name, w in model.p.items():
        at = tuple(0 for _ in w.shape)
        w[at] += 1e-6
        up = loss()
        w[at] -= 2e-6
        down = loss()
        w[at] += 1e-6
        assert g[name][at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def brute_rules(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cover = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover), len(words) < 50 or 100 * len(cover) > 50 * len(words)


def test_rules(spark, odd, none, labels):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    marks = spark.read.parquet(f"{DATA}/labels.parquet")
    for frame, l in ((docs, marks), (odd, labels)):
        want = Counter((r["doc_id"], brute_rules(r["text"] or "")) for r in frame.collect())
        rows = rules.apply_rules(frame, l).collect()
        assert Counter((r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])) for r in rows) == want
        assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert rules.apply_rules(none, labels).count() == 0
    big, l = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = rules.apply_rules(big, l).join(l, "doc_id").where("not base_failed").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in rows]) > 0.97


def test_secrets(spark, odd, none):
    text = 'é password="abcdef" Secret : short\ntoken=token:abcdefgh AKIA' + "Z" * 16 + " AKIAB api_key='x1y2z3_q' " + "0a" * 12 + " " + "f" * 23
    found = secrets.base_spans(text)
    assert [k for *_, k in found] == ["assign", "access", "assign", "hex"] and found[0] == (2, 18, "assign")
    assert [text[a:b] for a, b, k in found[1:]] == ["AKIA" + "Z" * 16, "api_key='x1y2z3_q", "0a" * 12]
    shared, own = "Zq9Ty4Xw1Vu8Rs2Po7Nm3Lk6Ji5H", "k7Rt2mQ9xZ4vB8nL1pW5sY3dF6gH0j"
    rows = [(i, f"x {shared} y", f"s{i}") for i in range(5)] + [(9, f"é {own} {shared}", "s9"), (10, f"z {own}", "s9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(docs).collect()}
    assert got[0] == "" and got[9] == "owned:2:32" and got[10] == "owned:2:32"
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert own not in clean[9] and shared in clean[9] and clean[0] == rows[0][1]
    assert secrets.scan(odd).count() == odd.count() and secrets.scan(none).count() == 0
    back = secrets.redact(odd)
    assert back.columns == odd.columns and back.count() == odd.count() and back.where("text is null").count() == odd.where("text is null").count()
    assert "hunter22secret" not in " ".join(r["text"] or "" for r in back.collect())


def brute_secrets(text):
    import regex

    found = [(m.start(), 0, m.end(), "assign") for m in regex.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?P<v>[A-Za-z0-9+/_.=-]+)""", text) if len(m["v"]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in regex.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in regex.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_secrets_against_patterns_and_counts(spark):
    r = random.Random(12)
    values = ["".join(r.choice("abcdEFGH0123456789") for _ in range(30)) for _ in range(12)]
    rows = []
    for i in range(160):
        parts = [r.choice(['password="abc123x"', "Token = ab", "AKIA" + "Q9" * 9, "deadbeef" * 3, "plain words", "é日", "api_key:x", values[r.randrange(12)]]) for _ in range(r.randint(0, 7))]
        rows.append((i, " ".join(parts), r.choice(["a", "b", None]) if i % 2 else "a"))
    rows += rows[:9]
    places = defaultdict(set)
    for _, text, source in rows:
        for a, b in secrets.loose_spans(text):
            places[text[a:b]].add((source or "", text))
    live = {v for v, at in places.items() if len({s for s, _ in at}) <= 1 and len({t for _, t in at}) <= 3}
    got = Counter((x["doc_id"], x["base"], x["n_assign"] + x["n_access"] + x["n_hex"], x["spans"]) for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    want = Counter()
    for i, text, _ in rows:
        base = brute_secrets(text)
        spans = [(int(s.split(":")[1]), secrets.KINDS.index(s.split(":")[0]), s) for s in base.split(",") if s] + [(a, 3, f"owned:{a}:{b}") for a, b in secrets.loose_spans(text) if text[a:b] in live]
        want[i, base, len(base.split(",")) if base else 0, ",".join(s for *_, s in sorted(spans))] += 1
    assert got == want
    dots = spark.createDataFrame([(1, "password=abcdef", "s")], "`a.b` long, `t.x` string, `s.s` string")
    assert secrets.scan(dots, owner="s.s", id_col="a.b", text_col="t.x").first()["n_assign"] == 1


def test_secrets_copied_within_one_owner(spark):
    example, live, copied = "Zq9Ty4Xw1Vu8Rs2Po7Nm3Lk6Ji5H", "k7Rt2mQ9xZ4vB8nL1pW5sY3dF6gH0j", "Ab3Cd6Ef9Gh2Ij5Kl8Mn1Op4Qr7S"
    for source in ("s", None):
        rows = [(i, f"text {i} {example}", source) for i in range(4)] + [(10 + i, f"text {i} {live}", source) for i in range(3)] + [(20 + i, f"same {copied}", source) for i in range(5)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = {r["doc_id"]: r["spans"] for r in secrets.scan(docs).collect()}
        assert {i for i, spans in got.items() if spans} == {10, 11, 12, 20, 21, 22, 23, 24}
        clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
        assert all((clean[i] != text) == bool(got[i]) for i, text, _ in rows) and len(clean) == len(rows)
        assert all(r["spans"] for r in secrets.scan(docs, repository="source").collect())


def test_licenses(spark, odd, none):
    names = licenses.TEMPLATES
    rows = [(i, f"Some words here.\n{t}\nMore words follow.") for i, t in enumerate(names.values())] + [(90, "Licensed under the Apache License, Version 2.1."), (91, "He lost his driving licence in an accident on the road to the sea last summer."), (92, None)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, name in enumerate(names):
        assert (got[i]["license"], got[i]["verdict"], got[i]["n_different"]) == (name, "exact", 0)
        assert rows[i][1][got[i]["start"] : got[i]["end"]] == names[name]
    assert (got[90]["license"], got[90]["verdict"]) == ("Apache-2.0", "variant")
    assert got[91]["verdict"] == "other" and got[91]["license"] is None and 92 not in got
    assert licenses.scan(odd).count() == 1 and licenses.scan(none).count() == 0


def test_licenses_each_notice(spark):
    names = licenses.TEMPLATES
    both = "Released under the MIT License. Licensed under CC BY-NC 4.0."
    rows = [(0, both), (1, " ".join(names.values())), (2, "Licensed under CC BY-NC 4.0. Under the MIT License."), (3, f"{both} {both}")]
    got = {}
    for r in sorted(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r["start"]):
        got.setdefault(r["doc_id"], []).append((rows[r["doc_id"]][1][r["start"] : r["end"]], r["license"], r["verdict"]))
    assert got[0] == [(names[k], k, "exact") for k in ("MIT", "CC-BY-NC-4.0")] and got[3] == got[0] * 2
    assert got[1] == [(t, k, "exact") for k, t in names.items()]
    assert [g[1:] for g in got[2]] == [("CC-BY-NC-4.0", "exact"), ("MIT", "variant")]


def test_licenses_whole_texts(spark):
    forms = [f for f in licenses.everything() if len(f[1]) < 5000]
    wrapped = [(k, "/* Copyright 2020 A. Body\n * " + re.sub(r"(.{60}\S*)\s", r"\1\n * ", t) + "\n */\nint main() {}") for k, t in forms]
    long = [f for f in licenses.everything() if len(f[1]) >= 5000]
    rows = [(i, t) for i, (_, t) in enumerate(wrapped + [(k, f"Before it.\n\n{t}\n\nAfter it.") for k, t in long])]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("license is not null").collect():
        got.setdefault(r["doc_id"], []).append((r["license"], r["verdict"]))
    assert {"MIT", "ISC", "BSD-3-Clause", "Apache-2.0"} < {k for k, _ in forms} and {"GPL-3.0", "LGPL-2.1", "EPL-2.0"} < {k for k, _ in long}
    assert [got.get(i) for i in range(len(rows))] == [[(k, "exact")] for k, _ in forms + long]


def test_compression_ranks_license_templates(spark):
    """Where two wordings differ from a text by as many words, the one that compresses it better wins, whatever its name;
    without its reduction the other would be taken. A wording that ranks low in a block with several is still found."""
    close = "This data is licensed under the Meadowlark Sharing Licence, edition seven, without restrictions of any kind whatsoever."
    far = close.replace("Meadowlark", "Qzx").replace("restrictions", "restriction")
    templates = {"a-far": far, "z-close": close}
    text = close.replace("Meadowlark", "Meadowlarks").replace("restrictions", "restrictionsand")
    ((start, end, name, reduction, different, verdict),) = licenses.judge(text, licenses.listed(templates))
    own = {k: licenses.Form(k, v, {}, 0.25) for k, v in templates.items()}
    assert (name, verdict, text[start:end]) == ("z-close", "variant", text) and reduction == own["z-close"].reduction(text) > own["a-far"].reduction(text)
    forms, numbers = licenses._forms(licenses.listed(templates), 0.25)
    x = np.array([numbers.get(w, -1) for w in licenses._words(text)], np.int32)
    assert {int(licenses.distances(f.words, x).min()) for f in forms} == {different}
    assert [forms[k].name for k in licenses.ranked(text, licenses.listed(templates), 0.25)] == ["z-close", "a-far"]
    names = licenses.TEMPLATES
    block = " ".join(names[k] for k in ("GPL-3.0", "AGPL-3.0", "MIT"))
    ranks = licenses.ranked(block, licenses.listed(names), 0.25)
    low = [licenses.listed(names)[k][0] for k in ranks].index("MIT")
    assert low > 2 and [r[2] for r in licenses.judge(block, licenses.listed(names))] == ["GPL-3.0", "AGPL-3.0", "MIT"]
    other = licenses.judge("He lost his driving licence in an accident.", licenses.listed(names))
    assert [r[5] for r in other] == ["other"] and other[0][3] == max(f.reduction("He lost his driving licence in an accident.") for f in licenses._forms(licenses.listed(names), 0.25)[0])


def test_license_distances():
    r = random.Random(2)
    for _ in range(50):
        words, x = ([r.randrange(4) for _ in range(r.randrange(1, n))] for n in (6, 9))
        row = [0] * (len(x) + 1)
        for k, w in enumerate(words, 1):
            new = [k]
            for j, v in enumerate(x, 1):
                new.append(min(row[j] + 1, row[j - 1] + (v != w), new[-1] + 1))
            row = new
        assert licenses.distances(np.array(words), np.array(x)).tolist() == row


def test_licenses_in_any_case(spark):
    rows = [(0, "RELEASED UNDER THE MIT LICENSE."), (1, "released under the mit LiCense."), (2, "Dedicated to the pUBLIC dOMAIN under CC0 1.0.")]
    got = {r["doc_id"]: (r["license"], r["verdict"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: ("MIT", "exact"), 1: ("MIT", "exact"), 2: ("CC0-1.0", "exact")}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_licenses_against_every_span(spark):
    """The words in which a found notice differs are as few as in any stretch of the text."""
    r = random.Random(7)
    for name in ("MIT", "Apache-2.0", "CC-BY-SA-4.0", "GPL-2.0"):
        own = licenses._words(licenses.TEMPLATES[name])
        for _ in range(4):
            changed = list(own)
            if len(own) > 5:
                changed[r.randrange(2, len(own))] = "other"
            text = " ".join([*(r.choice(WORDS) for _ in range(6)), *changed, *(r.choice(WORDS) for _ in range(6))])
            words = text.split()
            least = min(edit_distance(own, words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1))
            found = [f for f in licenses.judge(text, ((name, licenses.TEMPLATES[name]),)) if f[2]]
            assert [f[4] for f in found] == [least] == [int(changed != own)]


def test_capitals_of_whole_texts():
    r = random.Random(4)
    for text in ("", "Aé ÉΩß日", "Ab" * 3000, "aB" * 3000, "".join(r.choice("aB cÉ日\U0001d400") for _ in range(9001))):
        assert toxicity.shape(text, 0)[1] == sum(c.isupper() for c in text) / max(1, len(text))


def test_chain_against_loops(spark):
    """Probabilities of the chain equal those of plain loops; a change in the middle of a long text counts."""
    r = np.random.default_rng(3)
    chain = toxicity.Chain({"bad": 0, "worse": 1}, [])
    text = "fine words " * 50 + "bad bad bad bad worse " + "x " * 40
    for d in (5, 6, 7):
        model = toxicity.Linear(np.zeros((0, d)), np.zeros(0))
        model.w = r.normal(size=d + 1)
        chain.models.append(model)
    x = [3.0, 1.0, *toxicity.shape(text, len(text.split()))]
    want = []
    for model in chain.models:
        z = sum(w * v for w, v in zip(model.w, [*x, *want])) + model.w[-1]
        want.append(1 / (1 + np.exp(-z)))
    got = chain.probabilities(chain.features(text, toxicity.words(text))[None])[0]
    assert got == pytest.approx(want)
    long = ["Word"] * 20_000
    other = [*long[:10_000], "WORD", *long[10_001:]]
    assert toxicity.shape(" ".join(long), 20_000) != toxicity.shape(" ".join(other), 20_000)


def test_words_of_folds(spark):
    """A word of one fold alone is in the list of all rows, and not in the one that was chosen without its fold."""
    rows = [(1, k, [f"only{k}", "shared"]) for k in range(5) for _ in range(6)] + [(0, k, ["plain", "shared"]) for k in range(5) for _ in range(6)]
    lists = toxicity.lexicons(spark.createDataFrame(rows, "t int, fold int, words array<string>"), 50, 4)
    assert all(f"only{k}" in lists[0][0] and f"only{k}" not in lists[1 + k][0] and f"only{k}" in lists[1 + (k + 1) % 5][0] for k in range(5))


def test_grams_of_words():
    assert toxicity.grams("ab") == ["#^ab$"] and toxicity.grams("abcd") == ["#^abc", "#abcd", "#bcd$"] and toxicity.grams("a") == []
    counts = toxicity.terms(toxicity.words("Bad bads, worse"))
    assert counts["#^bad"] == 2 and counts["bad"] == 1 and counts["#bads"] == 1
    chain = toxicity.Chain({"bad": 0, "#^bad": 1, "#orse": 2}, [])
    for text in ("", "Bad bads, worse", "bad " * 9):
        c = toxicity.terms(toxicity.words(text))
        assert chain.features(text, toxicity.words(text))[:3].tolist() == [min(3, c[t]) for t in chain.lexicon]


def test_toxicity_of_held_out_rows(spark):
    """A few hundred labels suffice to rank toxic rows that were not learned from above nearly all others."""
    docs, marks = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.score(docs, marks).join(marks.select("doc_id", F.col("toxic").alias("truth")), "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").collect()
    bad, good = ([r["toxic"] for r in rows if r["truth"] == t] for t in (1, 0))
    assert len(bad) > 10 and np.mean([(a > b) + (a == b) / 2 for a in bad for b in good]) > 0.93


def test_toxicity(spark, odd, none, labels):
    docs, marks = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = marks.select("doc_id", F.col("toxic").alias("truth"))
    rows = toxicity.score(docs, marks).join(truth, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").collect()
    bad = [r for r in rows if r["truth"] == 1]
    assert sum(r["is_toxic"] for r in bad) >= 0.85 * len(bad)
    assert sum(r["is_toxic"] for r in rows if r["truth"] == 0) <= 0.01 * len(rows)
    found = toxicity.score(odd, labels).collect()
    assert len(found) == odd.count() and all(0 <= r["toxic"] <= 1 for r in found)
    assert toxicity.score(none, labels).count() == 0
    assert not any(r["is_toxic"] for r in toxicity.score(odd, labels.limit(0), threshold=0.5).collect())


def test_pipeline_on_odd_rows(spark, odd, none, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    for name, docs in (("odd", odd), ("none", none)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(str(tmp_path / name / "labels.parquet"))
        now = docs
        for stage, run in corpus_pipeline.STAGES[:-1]:
            now = run(spark, now, str(tmp_path / name))
            assert now.columns == docs.columns and now.count() <= docs.count(), stage
        assert (corpus_pipeline.run(spark, str(tmp_path / name)).count() > 0) == (name == "odd")


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
        assert docs.count() <= n
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == n
    assert packed.where(F.col("start") == 0).agg(F.sum("doc_tokens")).first()[0] == packed.agg(F.sum("length")).first()[0]
    tokens = lambda df: sorted(map(tuple, df.groupBy("doc_id").agg(F.sum("length")).collect()))
    assert tokens(corpus_pipeline.run(spark, DATA)) == tokens(packed)


def test_workers_give_chunks_back(spark):
    """Python workers outlive tasks: what a packing task has remembered of its texts is gone when it ends."""
    path = queries.vocabulary_path()
    df = spark.createDataFrame([(i, f"some words {i} of text {i * 7}") for i in range(400)], "doc_id long, text string").repartition(4)
    assert packing.pack(df, path).groupBy("doc_id").count().count() == 400

    def held(batches):
        for batch in batches:
            c = packing.chunks(path)
            yield pa.RecordBatch.from_pydict({"n": [len(c.known) + len(c.old)]})

    assert {r["n"] for r in spark.range(4, numPartitions=4).mapInArrow(held, "n long").collect()} == {0}


def test_slots_are_counted():
    total = np.ones(1 << jaccard.SLOT_BITS, np.uint32)
    held = [np.array([5, 5, 7]), np.array([5, (1 << jaccard.SLOT_BITS) - 1])]
    jaccard._count(total, held)
    assert total.dtype == np.uint32 and total[[5, 7, -1, 0]].tolist() == [4, 2, 2, 1] and total.sum() == len(total) + 5
