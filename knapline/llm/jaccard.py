"""N-gram Jaccard join: rare-first prefix filtering, exact verification, connected components.

A text's set is its distinct k-word shingles, as 64-bit hashes. All sets are put in one order, rare shingles first, by
a fixed-size count sketch of the corpus. Two sets that reach the threshold share a shingle of their prefixes; texts
with equal sets are one class and enter once per task. Members of a prefix shingle's bucket that survive the length
and positional filters go to the bucket's least member: since near copies share most of their buckets' members, few
such groups hold all of a family's buckets. The suffix filter bounds the members in
which two sets differ by those of short signatures. Groups that pass verify their pairs against whole sets and
give out a spanning forest of the links, never all pairs; a pair that several groups hold is verified in the first of
them. Large groups are verified in blocks on several tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

from .common import Scratch, fresh, hash_words, pieces_of, raw_texts, released, rows, settle, short_batches, windows_hash
from .components import Roots, components

SLOT_BITS, CHUNK = 22, 16384
SMALL = 64  # buckets up to this size apply the filters pair by pair
BLOCK = 1024  # sets of one side of a verification task
SALTS = 32  # tasks that the members of one component are dealt to
COUNTED = 500_000  # slots that a task holds before it counts them
FILTER_BITS = 24  # of the fixed-size filter that keeps uninvolved texts from being shuffled


def shingles(raw: bytes, k: int) -> np.ndarray:
    """A text's set in ascending order. bytes.lower() folds A-Z alone."""
    h = hash_words(raw.lower())
    if not len(h):
        return h
    s = windows_hash(h, min(k, len(h)))
    s.sort()
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def signature(s: np.ndarray) -> bytes:
    """Parities of a set's members over as many bits as it has members, rounded up to a power of two. The bits in which
    two signatures differ are no more than the members in which the sets do; a longer one folds onto a shorter one."""
    bits = 1 << max(6, int(len(s) - 1).bit_length())
    where = (s >> np.uint64(8)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(where.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def class_of(s: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "big", signed=True)


def slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Order:
    """The global order: by the sketch's count, then by hash."""

    def __init__(self, counts: np.ndarray, num: int, den: int):
        self.counts, self.num, self.den = counts, num, den

    def __call__(self, s: np.ndarray) -> np.ndarray:
        return s[np.lexsort((s, self.counts[slots(s)]))]

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1


def _count(total: np.ndarray, held: list[np.ndarray]) -> None:
    """Adds how often each slot is in `held`, without a second table as large as `total`."""
    slot, n = np.unique(np.concatenate(held), return_counts=True)
    total[slot] += n.astype(total.dtype)


def _classes(k: int):
    out = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("sig", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary())])

    @released
    def run(batches):
        total, held, n = np.zeros(1 << SLOT_BITS, np.uint32), [], 0
        for batch in batches:
            for part in pieces_of(batch):
                sets = [shingles(raw, k) for raw in raw_texts(part)]
                held += [slots(s) for s in sets]
                n += sum(map(len, sets))
                if n > COUNTED:
                    _count(total, held)
                    held, n = [], 0
                none = [None] * part.num_rows
                yield rows(out, part.column("doc_id"), [len(s) for s in sets], [class_of(s) for s in sets], [signature(s) if len(s) else None for s in sets], none, none)
        if n:
            _count(total, held)
        held = []
        if total.any():
            parts = [zlib.compress(total[i : i + CHUNK].tobytes(), 1) for i in range(0, len(total), CHUNK)]
            none = [None] * len(parts)
            yield rows(out, none, none, none, none, list(range(len(parts))), parts)

    return run, "doc_id long, n long, cid long, sig binary, chunk int, counts binary"


@released
def _sum_chunks(batches):
    out = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(raw), np.uint32)
            total[c] = total[c] + part if c in total else part.astype(np.uint64)
    yield rows(out, list(total), [x.tobytes() for x in total.values()])


def _prefixes(order, k: int):
    out = pa.schema([("token", pa.int64()), ("cid", pa.int64()), ("size", pa.int32()), ("pos", pa.int32())])

    @released
    def run(batches):
        seen, o = set(), order.value
        for batch in batches:
            for part in pieces_of(batch):
                t, c, n, p = [], [], [], []
                for raw in raw_texts(part):
                    s = shingles(raw, k)
                    if not len(s) or (cid := class_of(s)) in seen:
                        continue
                    seen.add(cid)
                    head = o(s)[: o.prefix(len(s))]
                    t.append(head.view(np.int64))
                    c.append(np.full(len(head), cid, np.int64))
                    n.append(np.full(len(head), len(s), np.int32))
                    p.append(np.arange(len(head), dtype=np.int32))
                if t:
                    yield rows(out, *(np.concatenate(x) for x in (t, c, n, p)))

    return run, "token long, cid long, size int, pos int"


def _buckets(num: int, den: int):
    """Groups (leader, member) of a partition's prefix rows."""
    out = pa.schema([("leader", pa.int64()), ("cid", pa.int64())])

    @released
    def run(batches):
        cols = [[], [], [], []]
        for batch in batches:
            for k, name in enumerate(("token", "cid", "size", "pos")):
                cols[k].append(batch.column(name).to_numpy(zero_copy_only=False))
        if not cols[0]:
            return
        token, cid, size, pos = (np.concatenate(x) for x in cols)
        # What stands alone in its bucket is most, and goes first.
        _, where, count = np.unique(token, return_inverse=True, return_counts=True)
        keep = count[where] > 1
        token, cid, size, pos = (x[keep] for x in (token, cid, size, pos))
        at = np.lexsort((cid, token))
        token, cid, size, pos = (x[at] for x in (token, cid, size, pos))
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])
        token, cid, size, pos = (x[fresh].astype(np.int64) for x in (token, cid, size, pos))
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.empty(0, np.int64)
        width = np.diff(np.append(start, len(token)))
        lead, member = [], []
        for m in np.unique(width):
            if m < 2:
                continue
            these = start[width == m]
            for lo in range(0, len(these), max(1, 200_000 // int(m * m))):
                g = these[lo : lo + max(1, 200_000 // int(m * m))][:, None] + np.arange(m)
                ok = np.ones(g.shape, bool)
                if m <= SMALL:
                    i, j = np.triu_indices(m, 1)
                    a, b = g[:, i], g[:, j]
                    # Sizes n and s can reach num/den only with `need` shingles in common.
                    need = -(-num * (size[a] + size[b]) // (num + den))
                    fits = (num * np.maximum(size[a], size[b]) <= den * np.minimum(size[a], size[b])) & (1 + np.minimum(size[a] - pos[a], size[b] - pos[b]) - 1 >= need - np.minimum(pos[a], pos[b]))
                    ok = np.zeros(g.shape, bool)
                    for col in range(len(i)):
                        ok[:, i[col]] |= fits[:, col]
                        ok[:, j[col]] |= fits[:, col]
                own = cid[g]
                first = np.where(ok, own, np.iinfo(np.int64).max).min(axis=1)
                lead.append(np.broadcast_to(first[:, None], g.shape)[ok])
                member.append(own[ok])
        if lead:
            pair = np.unique(np.stack([np.concatenate(lead), np.concatenate(member)], axis=1), axis=0)
            yield rows(out, pair[:, 0], pair[:, 1])

    return run, "leader long, cid long"


def _bits(cids: np.ndarray) -> np.ndarray:
    return (cids.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two ascending sets reach the threshold: by length, by the parts on both sides of one member, exactly."""
    n, m = len(x), len(y)
    if num * max(n, m) > den * min(n, m):
        return False
    need = -(-num * (n + m) // (num + den))
    mid = m // 2
    at = int(np.searchsorted(x, y[mid]))
    if min(at, mid) + min(n - at, m - mid) < need:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= need


def links(left: list[np.ndarray], right: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """(left, right) booleans for many sets at once, by products of 0/1 matrices over slices of shared shingles."""
    na, nb = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    _, ids, count = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    ids = np.where(count[ids] > 1, shared[ids], -1)
    row_a, row_b = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    ia, ib = ids[: len(row_a)], ids[len(row_a) :]
    common = np.zeros((len(na), len(nb)), np.float32)
    for lo in range(0, int(shared[-1]) + 1 if len(shared) else 0, 4096):
        a, b = np.zeros((len(na), 4096), np.float32), np.zeros((len(nb), 4096), np.float32)
        ka, kb = (ia >= lo) & (ia < lo + 4096), (ib >= lo) & (ib < lo + 4096)
        a[row_a[ka], ia[ka] - lo] = 1
        b[row_b[kb], ib[kb] - lo] = 1
        common += a @ b.T
    common = common.astype(np.int64)
    return den * common >= num * (na[:, None] + nb[None, :] - common)


def met_before(left: list[set[int]], right: list[set[int]]) -> np.ndarray:
    """(left, right) booleans: whether two members share one of the groups that each has been in before."""
    known = {g: k for k, g in enumerate(sorted(set().union(*left) & set().union(*right)))}
    out = np.zeros((len(left), len(right)), bool)
    for lo in range(0, len(known), 4096):
        a, b = (np.zeros((len(side), min(4096, len(known) - lo)), np.float32) for side in (left, right))
        for m, side in ((a, left), (b, right)):
            for row, groups in enumerate(side):
                at = [known[g] - lo for g in groups if lo <= known.get(g, -1) < lo + 4096]
                m[row, at] = 1
        out |= a @ b.T > 0
    return out


def _verify(num: int, den: int):
    """Reads rows (leader, i, j, side, cid, s, earlier) sorted by group; gives a spanning forest of each group's links.
    earlier: the other groups of a member that come before this one. A pair belongs to the first group that holds
    both, and is verified in that one only."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def group(found: list[tuple[int, int, bytes, list[int]]]) -> Iterator[tuple[int, int]]:
        roots = Roots()
        left = [(c, np.frombuffer(s, np.uint64), set(e)) for side, c, s, e in found if side != 2]
        right = [(c, np.frombuffer(s, np.uint64), set(e)) for side, c, s, e in found if side == 2] or left
        if len(left) * len(right) <= 36:
            for k, (c, s, e) in enumerate(left):
                for d, t, g in right[k + 1 :] if right is left else right:
                    if roots.find(c) != roots.find(d) and e.isdisjoint(g) and linked(s, t, num, den) and roots.join(c, d):
                        yield c, d
            return
        settled = met_before([e for *_, e in left], [e for *_, e in right])
        over, across = np.flatnonzero(~settled.all(axis=1)), np.flatnonzero(~settled.all(axis=0))
        if not len(over):
            return
        yes = links([left[k][1] for k in over], [right[k][1] for k in across], num, den) & ~settled[np.ix_(over, across)]
        for k, row in zip(over.tolist(), yes, strict=True):
            c = left[k][0]
            for j in across[row].tolist():
                if c != right[j][0] and roots.join(c, right[j][0]):
                    yield c, right[j][0]

    @released
    def run(batches):
        key, found = None, []
        for batch in batches:
            edges = []
            for leader, i, j, side, cid, s, earlier in zip(*(batch.column(c).to_pylist() for c in ("leader", "i", "j", "side", "cid", "s", "earlier")), strict=True):
                if (leader, i, j) != key:
                    edges += group(found)
                    key, found = (leader, i, j), []
                found.append((side, cid, s, earlier))
            if edges:
                yield rows(out, *map(list, zip(*edges, strict=True)))
        if edges := list(group(found)):
            yield rows(out, *map(list, zip(*edges, strict=True)))

    return run, "a long, b long"


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def join(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, cid) for every row: links are den * common >= num * union.

    Texts with fewer than k words are one shingle; without words a text has none, links with nothing and is its own
    component. Repeated rows and equal texts are linked. component_id is the least id reachable, null only where
    all reachable ids are null. Equality of sets and shingles is that of 64-bit hashes.
    """
    spark = docs.sparkSession
    short_batches(spark)
    own = _own(docs, id_col, text_col)
    run, ddl = _classes(k)
    first = settle(own.mapInArrow(run, ddl))
    counts = np.zeros(1 << SLOT_BITS, np.uint32)
    for r in first.where("counts is not null").select("chunk", "counts").repartition("chunk").mapInArrow(_sum_chunks, "chunk int, counts binary").collect():
        counts[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.minimum(np.frombuffer(r["counts"], np.uint64), (1 << 32) - 1)
    order = spark.sparkContext.broadcast(Order(counts, num, den))
    run, ddl = _prefixes(order, k)
    prefixes = own.select("text").mapInArrow(run, ddl).repartition("token")
    run, ddl = _buckets(num, den)
    with Scratch(spark) as scratch:
        groups = scratch.settle(prefixes.mapInArrow(run, ddl).distinct())
        groups = scratch.settle(_plausible(groups, first, num, den))
        root = components(scratch.settle(_edges(own, groups, k, num, den, scratch)))
    classes = first.where("counts is null").select("doc_id", "n", "cid")
    # Equal sets are one row from here on. Components are few; salted copies of their ids meet the members of a large
    # one on several tasks.
    low = classes.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("low"))
    linked_ = low.join(root, low["cid"] == root["node"]).select("cid", "low", "root", F.expr(f"pmod(xxhash64(cid), {SALTS})").alias("salt"))
    least = linked_.groupBy("root").agg(F.min("low").alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("long"))
    of_class = linked_.join(least.hint("merge"), ["root", "salt"]).select(F.col("cid").alias("of"), "least")
    # A table, so that Spark may split the copies of one set between tasks in the join with it.
    named = settle(low.join(of_class, low["cid"] == of_class["of"], "left").select("cid", F.when(F.col("of").isNull(), F.col("low")).otherwise(F.col("least")).alias("component_id")))
    named = classes.where("n > 0").join(named, "cid").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "cid")
    return named.unionAll(classes.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "cid"))


def _deal(groups: DataFrame) -> DataFrame:
    """(leader, cid, i, j, side): groups in blocks. A member of block x is the left side of blocks x.. and the right one
    of blocks ..x, so that every two members meet once."""
    width = groups.groupBy("leader").agg(F.count("*").alias("m"))
    sized = groups.join(width, "leader").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("at", F.expr("cast(pmod(xxhash64(cid), blocks) as int)"))
    dealt = sized.select("leader", "cid", "at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.select("leader", "cid", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), F.expr("case when at = other then 0 when at < other then 1 else 2 end").alias("side"))


def near(n: np.ndarray, sigs: list[bytes], num: int, den: int, left: np.ndarray, right: np.ndarray):
    """Yields (row of left, rows of right) that sizes and signatures leave possible: sets that share `need` members
    differ in n + m - 2 need at most. left, right: places in n and sigs."""
    bits = np.array([8 * len(s) for s in sigs])
    for level in np.unique(bits):
        # Sizes within the ratio lie at most one power of two apart; the longer signature folds once.
        folded: dict[int, np.ndarray] = {}

        def fold(places: np.ndarray, level=level, folded=folded) -> np.ndarray:
            for p in places.tolist():
                if p not in folded:
                    w = np.frombuffer(sigs[p], np.uint64)
                    while 64 * len(w) > level:
                        w = w[: len(w) // 2] ^ w[len(w) // 2 :]
                    folded[p] = w
            return np.stack([folded[p] for p in places.tolist()])

        for a, b, equal in ((left, right, True), (left, right, False), (right, left, False)):
            a = a[bits[a] == level]
            b = b[bits[b] == level] if equal else b[(bits[b] > level) & (bits[b] <= 4 * level)]
            if not len(a) or not len(b):
                continue
            x, y = fold(a), fold(b)
            step = max(1, 2_000_000 // (len(b) * x.shape[1]))
            for lo in range(0, len(a), step):
                na, nb = n[a[lo : lo + step]][:, None], n[b][None, :]
                fits = (num * np.maximum(na, nb) <= den * np.minimum(na, nb)) & (np.bitwise_count(x[lo : lo + step][:, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64) <= na + nb + 2 * (-num * (na + nb) // (num + den)))
                for r in range(len(fits)):
                    if len(hit := np.flatnonzero(fits[r])):
                        yield a[lo + r], b[hit]


def _narrow(num: int, den: int):
    """Reads rows (leader, i, j, side, cid, n, sig) sorted by group; splits groups into parts that signatures connect."""
    out = pa.schema([("leader", pa.int64()), ("cid", pa.int64())])

    def group(found: list) -> list[tuple[int, int]]:
        if len(found) < 2:
            return []
        side, cid, n = (np.array([f[k] for f in found], np.int64) for k in range(3))
        left = np.flatnonzero(side != 2)
        right = np.flatnonzero(side == 2) if (side == 2).any() else left
        roots, some = Roots(), set()
        for a, b in near(n, [f[3] for f in found], num, den, left, right):
            for j in b.tolist():
                if j != a:
                    roots.join(int(cid[a]), int(cid[j]))
                    some.update((int(cid[a]), int(cid[j])))
        return [(roots.find(c), c) for c in some]

    @released
    def run(batches):
        key, found = None, []
        for batch in batches:
            pairs = []
            for leader, i, j, *rest in zip(*(batch.column(c).to_pylist() for c in ("leader", "i", "j", "side", "cid", "n", "sig")), strict=True):
                if (leader, i, j) != key:
                    pairs += group(found)
                    key, found = (leader, i, j), []
                found.append(rest)
            if pairs:
                yield rows(out, *map(list, zip(*pairs, strict=True)))
        if pairs := group(found):
            yield rows(out, *map(list, zip(*pairs, strict=True)))

    return run, "leader long, cid long"


def _plausible(groups: DataFrame, first: DataFrame, num: int, den: int) -> DataFrame:
    """Groups after the suffix filter, in the form of signatures, which bound the members in which whole sets differ."""
    sigs = first.where("n > 0").select("cid", "n", "sig").dropDuplicates(["cid"])
    run, ddl = _narrow(num, den)
    dealt = _deal(groups).join(sigs, "cid").repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j", "cid")
    return dealt.select("leader", "i", "j", "side", "cid", "n", "sig").mapInArrow(run, ddl).distinct()


def _edges(own: DataFrame, groups: DataFrame, k: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    spark = own.sparkSession
    needed = groups.select("cid").distinct()

    # A fixed-size bit per involved class keeps most other texts from the shuffle; the join below is exact.
    @released
    def marks(batches):
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[_bits(batch.column("cid").to_numpy(zero_copy_only=False))] = True
        for i in np.flatnonzero(bits.reshape(-1, 1 << 16).any(axis=1)):
            yield rows(pa.schema([("chunk", pa.int32()), ("bits", pa.binary())]), [int(i)], [np.packbits(bits[i << 16 : (i + 1) << 16]).tobytes()])

    bits = np.zeros((1 << FILTER_BITS >> 16, 1 << 13), np.uint8)
    merged = needed.mapInArrow(marks, "chunk int, bits binary").repartition("chunk").mapInArrow(_or_chunks, "chunk int, bits binary")
    for r in merged.collect():
        bits[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bits.reshape(-1))

    @released
    def involved(batches):
        seen, wanted = set(), np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for part in pieces_of(batch):
                cids, kept = [], []
                for raw in raw_texts(part):
                    s = shingles(raw, k)
                    if len(s) and (cid := class_of(s)) not in seen and wanted[_bits(np.array([cid]))[0]]:
                        seen.add(cid)
                        cids.append(cid)
                        kept.append(s.tobytes())
                if cids:
                    yield rows(pa.schema([("cid", pa.int64()), ("s", pa.binary())]), cids, kept)

    sets = scratch.settle(own.select("text").mapInArrow(involved, "cid long, s binary").join(needed, "cid", "left_semi").dropDuplicates(["cid"]))
    run, ddl = _verify(num, den)
    before = F.filter("leaders", lambda x: x < F.col("leader")).alias("earlier")
    held = groups.groupBy("cid").agg(F.collect_set("leader").alias("leaders"))
    return _deal(groups).join(sets.join(held, "cid"), "cid").repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j", "cid").select("leader", "i", "j", "side", "cid", "s", before).mapInArrow(run, ddl)


@released
def _or_chunks(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, raw in zip(batch.column("chunk").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            part = np.frombuffer(raw, np.uint8)
            total[c] = total[c] | part if c in total else part
    yield rows(pa.schema([("chunk", pa.int32()), ("bits", pa.binary())]), list(total), [x.tobytes() for x in total.values()])


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, of which one stays in each component: that with the least id, then the least
    class. Rows without words all stay, as they link with nothing."""
    found = join(docs, k, num, den, id_col, text_col)
    own, cls = fresh(docs, "__id"), fresh(docs, "__class")
    stay = settle(found.where("n_shingles > 0").groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("cid")).alias("alone")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cid")).alias("s")).select(F.col("s.doc_id").alias(own), F.col("s.cid").alias(cls)))
    cids = pa.schema([*to_arrow_schema(docs.schema), (cls, pa.int64())])
    at = docs.columns.index(text_col)

    @released
    def label(batches):
        for batch in batches:
            for part in pieces_of(batch):
                out = []
                for raw in part.column(at).cast(pa.binary()).to_pylist():
                    s = shingles(raw or b"", k)
                    out.append(class_of(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.int64())], schema=cids)

    marked = settle(docs.mapInArrow(label, StructType([*docs.schema.fields]).add(cls, LongType())))
    back = [F.col(f"`{c}`") for c in docs.columns]
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(stay[own]) & (marked[cls] == stay[cls])
    one = marked.where(marked[cls].isNotNull()).join(stay, same, "left_semi").dropDuplicates([id_col, cls])
    return one.select(*back).unionAll(marked.where(marked[cls].isNull()).select(*back))
