"""Exact repeated passages by a distributed sparse suffix array.

A passage is a window of `length` tokens (bytes, or words). Of every window's first `reach` positions the one with
the least 16-token hash is its anchor; equal windows have equal anchors, so only suffixes at anchors need sorting.

1. Each task finds its anchors. Suffixes whose whole context (all windows that they stand for) is equal are one entry
   of the array, found by the context's 128-bit hash, first within the task; anchors that share nothing are dropped.
2. The rest, about where passages begin and end, fetch their contexts from the texts. Sampled splitters deal these
   suffixes out by their leading tokens.
3. Each bucket sorts its suffixes by multikey quicksort, and likewise the tokens before the anchors, read backwards.
   For every offset of a window from its anchor, windows are equal where no short common prefix lies between them
   in either order. Where a suffix shares the window's tokens with a splitter, equal windows may lie on the other side
   of the boundary: one window of each class is then compared across buckets, those that stand alone only if another
   bucket has a suffix with as many of the same tokens before it.

Texts go by a 128-bit key, so that neither ids nor repeated rows matter: a text that stands twice is repeated as a
whole, and its copies cost no more than the hash of each.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructType

from .common import Scratch, by_batch, fresh, hash_words, mix, pieces_of, raw_texts, released, rows, settle, short_batches, text_key

ANCHOR = np.dtype([("h", "<u8"), ("c0", "<u8"), ("c1", "<u8"), ("k0", "<u8"), ("k1", "<u8"), ("a", "<i4"), ("lo", "<u2"), ("hi", "<u2"), ("f", "u1")])
RUN = np.dtype([("first", "<i4"), ("last", "<i4")])  # of window starts
ASK = np.dtype([("a", "<i4"), ("lo", "<u2"), ("hi", "<u2"), ("f", "u1")])
CUT = np.dtype([("from", "<i4"), ("to", "<i4")])  # of tokens
SAMPLE, DRAWN = 3000, 20_000  # texts from which splitters are drawn, suffixes of these
FILTER_BITS = 22
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Unit:
    """How texts become tokens: bytes as they are, or words as 64-bit hashes. width: bytes a token."""

    def __init__(self, words: bool, length: int):
        self.words, self.length, self.width = words, length, 8 if words else 1
        self.gram = 4 if words else 16
        self.reach = 1 << (max(2, int(length * 0.65)).bit_length() - 1)
        if self.reach + self.gram - 1 > length:
            self.reach = max(1, length - self.gram + 1)
        self.common = length - self.reach + 1  # tokens from the anchor on that all its windows hold

    def tokens(self, raw: bytes) -> np.ndarray:
        return hash_words(raw) if self.words else np.frombuffer(raw, np.uint8)

    def packed(self, tokens: np.ndarray) -> bytes:
        return tokens.astype(">u8").tobytes() if self.words else tokens.tobytes()

    def anchors(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, first and last window start that it stands for)."""
        n = len(tokens) - self.length + 1
        g = tokens if self.words else _TABLE[tokens]
        k = 1
        while k < self.gram:
            g = g[:-k] * np.uint64(0x9E3779B97F4A7C15 + 2 * k) + g[k:]
            k *= 2
        g = g ^ (g >> np.uint64(29))
        g = (g * np.uint64(0xBF58476D1CE4E5B9)) & ~np.uint64(0xFFFFFFFF) | np.arange(len(g), dtype=np.uint64)
        k = 1
        while 2 * k <= self.reach:
            g = np.minimum(g[:-k], g[k:])
            k *= 2
        if k < self.reach:
            g = np.minimum(g[: len(g) - (self.reach - k)], g[self.reach - k :])
        at = (g[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        return at[first], first, np.append(first[1:] - 1, n - 1)


OUT = pa.schema([("key", pa.binary()), ("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
DDL = "key binary, kind int, bucket int, blob binary"
DONE, DEALT, ASKED, EDGE, GATE, HELD = range(6)
STEP = 16  # offsets between gates
EDGES = pa.schema([("key", pa.binary()), ("kind", pa.int32()), ("start", pa.int32()), ("blob", pa.binary())])
EDGES_DDL = "key binary, kind int, start int, blob binary"


def _key(k0, k1) -> bytes:
    return int(k0).to_bytes(8, "little") + int(k1).to_bytes(8, "little")


def _by_key(found: np.ndarray, kind: int, pack: Callable[[np.ndarray], bytes]) -> pa.RecordBatch | None:
    """Rows (key, blob), one for each text among the anchors; an anchor that several tasks found counts once."""
    if not len(found):
        return None
    found = found[np.lexsort((found["a"], found["k1"], found["k0"]))]
    found = found[~_same(found, ("a", "k1", "k0"))]
    cut = np.flatnonzero(np.concatenate([[True], (found["k0"][1:] != found["k0"][:-1]) | (found["k1"][1:] != found["k1"][:-1])]))
    parts = np.split(found, cut[1:])
    m = len(parts)
    return rows(OUT, [_key(p["k0"][0], p["k1"][0]) for p in parts], [kind] * m, [None] * m, [pack(p) for p in parts])


def _whole(found: np.ndarray) -> bytes:
    out = np.empty(len(found), RUN)
    out["first"], out["last"] = found["a"] - found["lo"], found["a"] - found["hi"]
    return out.tobytes()


def _request(found: np.ndarray) -> bytes:
    return found[["a", "lo", "hi", "f"]].astype(ASK).tobytes()


def _same(found: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    """Whether each row of a sorted array equals the one before."""
    out = np.zeros(len(found), bool)
    if len(found) > 1:
        out[1:] = np.logical_and.reduce([found[n][1:] == found[n][:-1] for n in names])
    return out


def _find(unit: Unit, buckets: int, flush: int = 400_000):
    @released
    def run(batches):
        held, n, seen, again = [], 0, {}, set()
        squeeze = zstandard.ZstdCompressor(level=1)

        def out():
            all_ = np.concatenate(held)
            all_ = all_[np.lexsort((all_["c1"], all_["c0"]))]
            first = np.flatnonzero(~_same(all_, ("c0", "c1")))
            many = np.repeat(np.diff(np.append(first, len(all_))) > 1, np.diff(np.append(first, len(all_))))
            # A context that the task holds twice is settled here; one of its anchors goes on for all.
            if (done := _by_key(all_[many], DONE, _whole)) is not None:
                yield done
            go = all_[first]
            go["f"] = many[first]
            to = (go["h"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            go, to = go[order], to[order]
            cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            parts = np.split(go, cut[1:])
            yield rows(OUT, [None] * len(parts), [DEALT] * len(parts), to[cut], [squeeze.compress(p.tobytes()) for p in parts])

        for batch in batches:
            for part in pieces_of(batch):
                for raw in raw_texts(part):
                    if len(raw) < unit.length:
                        continue
                    k = text_key(raw)
                    if k in seen:
                        again.add(k)
                        continue
                    tokens = unit.tokens(raw)
                    seen[k] = len(tokens)
                    if len(tokens) < unit.length:
                        continue
                    a, lo, hi = unit.anchors(tokens)
                    body, w = memoryview(unit.packed(tokens)), unit.width
                    x = np.zeros(len(a), ANCHOR)
                    x["a"], x["lo"], x["hi"] = a, a - lo, a - hi
                    x["k0"], x["k1"] = int.from_bytes(k[:8], "little"), int.from_bytes(k[8:], "little")
                    h64, h128, common, length = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest, unit.common, unit.length
                    x["h"] = [h64(body[w * i : w * (i + common)]) for i in a.tolist()]
                    c = np.frombuffer(b"".join(h128(body[w * i : w * (j + length)]) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)), "<u8").reshape(-1, 2)
                    x["c0"], x["c1"] = c[:, 0], c[:, 1]
                    held.append(x)
                    n += len(x)
                if n > flush:
                    yield from out()
                    held, n = [], 0
        if held:
            yield from out()
        if whole := [k for k in again if seen[k] >= unit.length]:
            m = len(whole)
            yield rows(OUT, whole, [DONE] * m, [None] * m, [np.array([(0, seen[k] - unit.length)], RUN).tobytes() for k in whole])

    return run


def _each_bucket(batches, names: tuple[str, ...]):
    """(bucket, columns as lists) of input that is sorted by bucket."""
    now, held = None, {c: [] for c in names}
    for batch in batches:
        b = batch.column("bucket").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            if now is not None and b[lo] != now:
                yield now, held
                held = {c: [] for c in names}
            now = int(b[lo])
            for c in names:
                held[c] += batch.column(c).slice(lo, hi - lo).to_pylist()
    if now is not None:
        yield now, held


@released
def _meet(batches):
    """All anchors of some buckets, a bucket at a time."""
    plain = zstandard.ZstdDecompressor()
    for _, held in _each_bucket(batches, ("blob",)):
        yield from _settled(np.concatenate([np.frombuffer(plain.decompress(b), ANCHOR) for b in held["blob"]]))


def _settled(x: np.ndarray):
    """Settles contexts that occur twice, asks for those of the others that share their common tokens with another
    context, and drops the rest."""
    h, count = np.unique(x["h"], return_counts=True)
    x = x[np.isin(x["h"], h[count > 1])]
    x = x[np.lexsort((x["c1"], x["c0"], x["h"]))]
    if not len(x):
        return
    same_h, same_c = _same(x, ("h",)), _same(x, ("h", "c0", "c1"))
    of_h, of_c = np.cumsum(~same_h) - 1, np.cumsum(~same_c) - 1
    twice = (np.bincount(of_c) > 1)[of_c] | (np.bincount(of_c, weights=x["f"]) > 0)[of_c]
    if (done := _by_key(x[twice & (x["f"] == 0)], DONE, _whole)) is not None:
        yield done
    contexts = np.bincount(of_h[~same_c])
    open_ = np.bincount(of_h, weights=~twice)
    ask = ~same_c & (contexts[of_h] > 1) & (open_[of_h] > 0)
    x["f"] = twice
    if (asked := _by_key(x[ask], ASKED, _request)) is not None:
        yield asked


def _bits_of(keys: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(k[:4], "little") & ((1 << FILTER_BITS) - 1) for k in keys], np.int64)


def _filter(keyed: DataFrame) -> np.ndarray:
    """A fixed-size set of bits with those of all keys: what it lacks is not among them."""
    kind = pa.schema([("bits", pa.binary())])

    @released
    def mark(batches):
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[_bits_of(batch.column("key").to_pylist())] = True
        yield rows(kind, [np.packbits(bits).tobytes()])

    @released
    def merge(batches):
        total = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
        for batch in batches:
            for b in batch.column("bits").to_pylist():
                total |= np.frombuffer(b, np.uint8)
        yield rows(kind, [total.tobytes()])

    out = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
    for r in keyed.select("key").mapInArrow(mark, "bits binary").coalesce(8).mapInArrow(merge, "bits binary").collect():
        out |= np.frombuffer(r["bits"], np.uint8)
    return np.unpackbits(out).astype(bool)


def _contexts(own: DataFrame, asked: DataFrame, unit: Unit, splitters) -> DataFrame:
    """The suffixes that are asked for: (bucket, right, left, key, a, lo, hi, f)."""
    wanted = own.sparkSession.sparkContext.broadcast(np.packbits(_filter(asked)))
    text = pa.schema([("key", pa.binary()), ("raw", pa.binary())])

    @released
    def take(batches):
        bits, seen = np.unpackbits(wanted.value).astype(bool), set()
        for batch in batches:
            for part in pieces_of(batch):
                found = {k: raw for raw in raw_texts(part) if len(raw) >= unit.length and (k := text_key(raw)) not in seen}
                keys = list(found)
                keys = [k for k, yes in zip(keys, bits[_bits_of(keys)] if keys else [], strict=True) if yes]
                seen.update(keys)
                if keys:
                    yield rows(text, keys, [found[k] for k in keys])

    texts = own.select("text").mapInArrow(take, "key binary, raw binary")
    lists = asked.groupBy("key").agg(F.collect_list("blob").alias("blobs"))
    out = pa.schema([("bucket", pa.int32()), ("right", pa.binary()), ("left", pa.binary()), ("key", pa.binary()), ("a", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("f", pa.int32())])

    @released
    def cut(batches):
        w, bounds = unit.width, splitters.value
        for batch in batches:
            for part in pieces_of(batch, 64):
                found = []
                for key, raw, blobs in zip(*(part.column(c).to_pylist() for c in ("key", "raw", "blobs")), strict=True):
                    body = unit.packed(unit.tokens(raw))
                    for a, lo, hi, f in np.frombuffer(b"".join(blobs), ASK).tolist():
                        right = body[w * a : w * (a - hi + unit.length)]
                        found.append((bisect.bisect_right(bounds, right), right, body[w * (a - lo) : w * a], key, a, lo, hi, f))
                if found:
                    yield rows(out, *map(list, zip(*found, strict=True)))

    # Equal texts come once from each task: one of them is enough.
    joined = texts.join(lists, "key").dropDuplicates(["key"])
    return joined.mapInArrow(cut, "bucket int, right binary, left binary, key binary, a int, lo int, hi int, f int")


def as_words(strings: list[bytes]) -> np.ndarray:
    """Byte strings as rows of 8-byte characters, filled up with zeros."""
    wide = max(1, -(-max(map(len, strings), default=1) // 8))
    return np.frombuffer(b"".join(s.ljust(8 * wide, b"\0") for s in strings), ">u8").reshape(len(strings), wide).astype(np.uint64)


def multikey_quicksort(strings: list[bytes], x: np.ndarray) -> np.ndarray:
    """The order of strings whose 8-byte characters are x's rows: three-way partition by the character at the depth,
    equal ones a character deeper. Short stretches are sorted directly."""
    order = np.arange(len(strings))
    stack = [(0, len(strings), 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2:
            continue
        part = order[lo:hi]
        if hi - lo <= 32:
            order[lo:hi] = sorted(part.tolist(), key=lambda i: (strings[i], i))
            continue
        while depth < x.shape[1]:
            c = x[part, depth]
            if c[0] != c[-1] or (c != c[0]).any():
                break
            depth += 1
        if depth == x.shape[1]:
            continue
        pivot = np.partition(c, len(c) // 2)[len(c) // 2]
        less, more = c < pivot, c > pivot
        same = ~(less | more)
        i, j = lo + int(less.sum()), hi - int(more.sum())
        order[lo:i], order[i:j], order[j:hi] = part[less], part[same], part[more]
        stack += [(lo, i, depth), (i, j, depth + 1), (j, hi, depth)]
    return order


def common_prefixes(order: np.ndarray, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bytes that each string in order shares with the one before; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), 4096):
        b = order[lo : lo + 4096]
        a = order[lo - 1 : lo - 1 + len(b)]
        d = x[a] ^ x[b]
        some = d != 0
        at = np.where(some.any(axis=1), some.argmax(axis=1), x.shape[1])
        v = d[np.arange(len(b)), np.minimum(at, x.shape[1] - 1)]
        inside = sum((v < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))
        out[lo : lo + len(b)] = np.minimum(8 * at + np.where(at < x.shape[1], inside, 0), np.minimum(lengths[a], lengths[b]))
    return out


def prefixes_with(x: np.ndarray, lengths: np.ndarray, other: bytes) -> np.ndarray:
    """Bytes that each string shares with another one."""
    wide = 8 * x.shape[1]
    both = np.vstack([np.frombuffer(other[:wide].ljust(wide, b"\0"), ">u8").astype(np.uint64), x])
    order = np.stack([np.zeros(len(x), np.int64), np.arange(1, len(x) + 1)], axis=1).reshape(-1)
    return common_prefixes(order, both, np.concatenate([[len(other)], lengths]))[1::2]


def equal_windows(right: list[bytes], left: list[bytes], lo: np.ndarray, hi: np.ndarray, unit: Unit, sides: tuple[bytes, ...] = ()):
    """Yields (offset, records, class of each, size of each class, whether each is at a boundary) for the windows that
    begin `offset` tokens before the anchor; sides: the splitters next to the bucket."""
    m = len(right)
    ranks, edge = [], np.zeros(m, np.int64)
    for strings in (right, [s[::-1] if unit.width == 1 else _backwards(s) for s in left]):
        x, sizes = as_words(strings), np.array([len(s) for s in strings])
        order = multikey_quicksort(strings, x)
        ranks.append((order, common_prefixes(order, x, sizes) // unit.width))
        if strings is right:
            for side in sides:
                edge = np.maximum(edge, prefixes_with(x, sizes, side) // unit.width)
    (by_right, share_right), (by_left, share_left) = ranks
    for o in range(int(hi.min(initial=0)), int(lo.max(initial=0)) + 1):
        valid = np.flatnonzero((hi <= o) & (o <= lo))
        at_edge = edge[valid] >= unit.length - o
        if len(valid) < 2 and not at_edge.any():
            continue
        class_right, class_left = np.empty(m, np.int64), np.empty(m, np.int64)
        class_right[by_right] = np.cumsum(share_right < unit.length - o)
        class_left[by_left] = np.cumsum(share_left < o)
        _, where, count = np.unique(class_right[valid] * (m + 1) + class_left[valid], return_inverse=True, return_counts=True)
        yield o, valid, where, count, at_edge


def _backwards(s: bytes) -> bytes:
    return np.frombuffer(s, ">u8")[::-1].tobytes()


def separators(drawn: list[bytes], buckets: int) -> list[bytes]:
    """Splitters between buckets from a sorted sample, each as short as still parts it from the string before, so that
    suffixes share much with a splitter only where their own kind lies on both sides of it."""
    out = []
    for at in sorted({bisect.bisect_left(drawn, drawn[k * len(drawn) // buckets]) for k in range(1, buckets)} if drawn else ()):
        s, before = drawn[at], drawn[at - 1] if at else b""
        out.append(s[: next((i for i, (x, y) in enumerate(zip(s, before)) if x != y), min(len(s), len(before))) + 1])
    return out


def _windows(left: bytes, right: bytes, offsets: list[int], unit: Unit) -> list[bytes]:
    """128-bit hashes of the windows that begin so many tokens before the anchor."""
    w = unit.width
    return [xxhash.xxh3_128_digest(left[len(left) - w * o :] + right[: w * (unit.length - o)]) for o in offsets]


def _held(key: bytes, a: int, left: bytes, right: bytes, offsets: list[int], gate: bytes) -> tuple:
    return key, HELD, a, gate + np.array([len(left), len(offsets)], "<i4").tobytes() + np.array(offsets, "<i4").tobytes() + left + right


def _freed(unit: Unit):
    """The windows of held suffixes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for key, a, blob in zip(*(batch.column(c).to_pylist() for c in ("key", "start", "blob")), strict=True):
            size, n = np.frombuffer(blob, "<i4", 2, 16).tolist()
            offsets = np.frombuffer(blob, "<i4", n, 24).tolist()
            body = blob[24 + 4 * n :]
            out += [(key, EDGE, a - o, h) for o, h in zip(offsets, _windows(body[:size], body[size:], offsets, unit), strict=True)]
        return rows(EDGES, *(map(list, zip(*out, strict=True)) if out else [[]] * len(EDGES)))

    return by_batch(run)


def _at_boundaries(found: list[tuple], key: list[bytes], left: list[bytes], right: list[bytes], a: np.ndarray, lo: np.ndarray, near: np.ndarray, unit: Unit):
    """Rows for what lies at a bucket's boundaries. found: (record, offset) of windows that nothing in the bucket equals;
    near: records at a boundary. Windows up to the next gate go out; those behind it wait until another bucket is known
    to have the tokens from the gate on."""
    w = unit.width
    gates = {xxhash.xxh3_128_digest(left[r][len(left[r]) - w * g :] + right[r][: w * unit.common]) for r in near.tolist() for g in range(STEP, int(lo[r]) + 1, STEP)}
    yield from ((None, GATE, None, h) for h in gates)
    by: dict[int, list[int]] = {}
    for r, o in found:
        by.setdefault(r, []).append(o)
    for r, offsets in by.items():
        gate = -(-max(1, offsets[0]) // STEP) * STEP
        first = [o for o in offsets if o < gate]
        yield from ((key[r], EDGE, int(a[r]) - o, h) for o, h in zip(first, _windows(left[r], right[r], first, unit), strict=True))
        if rest := offsets[len(first) :]:
            yield _held(key[r], int(a[r]), left[r], right[r], rest, xxhash.xxh3_128_digest(left[r][len(left[r]) - w * gate :] + right[r][: w * unit.common]))


def _sort(unit: Unit, splitters):
    """Sorts buckets: runs of repeated windows, and what has to be compared with other buckets."""

    @released
    def run(batches):
        bounds = splitters.value
        for bucket, cols in _each_bucket(batches, ("right", "left", "key", "a", "lo", "hi", "f")):
            right, left, key = cols["right"], cols["left"], cols["key"]
            a, lo, hi, f = (np.array(cols[c], np.int64) for c in ("a", "lo", "hi", "f"))
            record, start, alone, shared, near = [], [], [], [], np.zeros(len(key), bool)
            for o, valid, where, count, at_edge in equal_windows(right, left, lo, hi, unit, tuple(bounds[max(0, bucket - 1) : bucket + 1])):
                again = valid[count[where] > 1]
                record.append(again)
                start.append(a[again] - o)
                if at_edge.any():
                    near[valid[at_edge]] = True
                    classes, first = np.unique(where[at_edge], return_index=True)
                    for r, size in zip(valid[at_edge][first].tolist(), count[classes].tolist(), strict=True):
                        if size == 1 and not f[r]:
                            alone.append((r, o))
                        else:
                            shared += _windows(left[r], right[r], [o], unit)
            edges = [(None, EDGE, None, h) for h in shared]
            edges += _at_boundaries(alone, key, left, right, a, lo, np.flatnonzero(near), unit)
            for k in range(0, len(edges), 20_000):
                yield rows(EDGES, *map(list, zip(*edges[k : k + 20_000], strict=True)))
            if not record:
                continue
            record, start = np.concatenate(record), np.concatenate(start)
            record, start = record[f[record] == 0], start[f[record] == 0]
            order = np.lexsort((start, record))
            record, start = record[order], start[order]
            cut = np.flatnonzero(np.concatenate([[True], (record[1:] != record[:-1]) | (start[1:] != start[:-1] + 1)])) if len(record) else np.empty(0, np.int64)
            by: dict[bytes, list] = {}
            for r, first, last in zip(record[cut].tolist(), start[cut].tolist(), start[np.append(cut[1:] - 1, len(start) - 1)].tolist() if len(cut) else [], strict=True):
                by.setdefault(key[r], []).append((first, last))
            if by:
                m = len(by)
                yield rows(EDGES, list(by), [DONE] * m, [None] * m, [np.array(v, RUN).tobytes() for v in by.values()])

    return run


def _across(found: DataFrame, unit: Unit) -> DataFrame:
    """(key, blob): runs of the windows at boundaries that equal a window of another bucket."""
    passed = found.where(f"kind = {GATE}").groupBy("blob").agg(F.count("*").alias("n")).where("n > 1").select(F.col("blob").alias("gate"))
    held = found.where(f"kind = {HELD}").join(passed, F.col("gate") == F.substring("blob", 1, 16), "left_semi").select("key", "start", "blob")
    edges = found.where(f"kind = {EDGE}").unionAll(held.mapInArrow(_freed(unit), EDGES_DDL))
    met = edges.groupBy("blob").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "start"))).alias("at")).where("n > 1")

    def as_run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return rows(pa.schema([("key", pa.binary()), ("blob", pa.binary())]), batch.column("key"), [np.array([(s, s)], RUN).tobytes() for s in batch.column("start").to_pylist()])

    return met.select(F.explode("at").alias("at")).select("at.key", "at.start").mapInArrow(by_batch(as_run), "key binary, blob binary")


def repeats(own: DataFrame, unit: Unit) -> DataFrame:
    """(key, cuts): for each text with repeated windows, the maximal stretches of tokens that they cover, as pairs of
    4-byte integers. own has a column text."""
    spark = own.sparkSession
    short_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(1 << 15, 8 * parts)
    with Scratch(spark) as scratch:
        found = scratch.settle(own.select("text").mapInArrow(_find(unit, buckets), DDL))
        dealt = found.where(f"kind = {DEALT}").select("bucket", "blob").repartition(parts, "bucket").sortWithinPartitions("bucket")
        met = scratch.settle(dealt.mapInArrow(_meet, DDL))
        asked = met.where(f"kind = {ASKED}").select("key", "blob")
        keys = asked.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(SAMPLE)
        sample = asked.join(F.broadcast(keys), "key", "left_semi")
        drawn = _contexts(own, sample, unit, spark.sparkContext.broadcast([])).select(F.col("right").alias("s"), F.xxhash64("key", "a").alias("h")).orderBy("h", "s").limit(DRAWN).select("s").collect()
        drawn = sorted(bytes(r["s"]) for r in drawn)
        splitters = spark.sparkContext.broadcast(separators(drawn, buckets))
        contexts = _contexts(own, asked, unit, splitters).repartition(parts, "bucket").sortWithinPartitions("bucket")
        sorted_ = scratch.settle(contexts.mapInArrow(_sort(unit, splitters), EDGES_DDL))
        runs = [t.where(f"kind = {DONE}").select("key", "blob") for t in (found, met, sorted_)]
        runs.append(_across(sorted_, unit))
        cuts = pa.schema([("key", pa.binary()), ("cuts", pa.binary())])

        def merge(batch: pa.RecordBatch) -> pa.RecordBatch:
            return rows(cuts, batch.column("key"), [np.array(spans(b, unit.length), CUT).tobytes() for b in batch.column("blobs").to_pylist()])

        every = functools.reduce(DataFrame.unionAll, runs)
        return settle(every.groupBy("key").agg(F.collect_set("blob").alias("blobs")).mapInArrow(by_batch(merge), "key binary, cuts binary"))


def spans(blobs: list[bytes], length: int) -> list[tuple[int, int]]:
    """Maximal covered stretches of tokens, by the runs of window starts."""
    runs = np.sort(np.frombuffer(b"".join(blobs), RUN), order="first")
    out: list[list[int]] = []
    for first, last in runs.tolist():
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [tuple(s) for s in out]


def stretches(cuts: bytes | None) -> list[tuple[int, int]]:
    return np.frombuffer(cuts, CUT).tolist() if cuts else []


def without(raw: bytes, cut: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in cut:
        out.append(raw[at:a])
        at = b
    return b"".join(out) + raw[at:]


def report(docs: DataFrame, length: int = 400, words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated_words) for every row: what is left of a text's bytes
    without those that a `length`-byte string covers that also starts elsewhere, in the same text or another; and how
    many of its words lie in passages of `words` words or more that also stand elsewhere, whatever their spacing.

    A null text is empty; an empty or short text loses nothing. Equal texts of the length or more lose all.
    """
    unit, by_word = Unit(False, length), Unit(True, words)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # Two passes that don't need each other: their jobs, of which many have few tasks, share the cluster.
    with ThreadPoolExecutor(2) as pool:
        # Each wrapped on its own, for each takes its own copy of the caller's local properties.
        passes = [pool.submit(inheritable_thread_target(functools.partial(repeats, own, u))) for u in (unit, by_word)]
        cuts, word_cuts = (p.result() for p in passes)
    word_cuts = word_cuts.withColumnRenamed("cuts", "word_cuts")
    wanted = own.sparkSession.sparkContext.broadcast(np.packbits(_filter(cuts.select("key").unionAll(word_cuts.select("key")))))
    marks = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.string()), ("key", pa.binary()), ("raw", pa.binary())])

    @released
    def mark(batches):
        # Rows of documents, and each text that may have repeats once a task.
        bits, seen = np.unpackbits(wanted.value).astype(bool), set()
        for batch in batches:
            for part in pieces_of(batch):
                out = []
                for doc, raw in zip(part.column("doc_id").to_pylist(), raw_texts(part), strict=True):
                    key = text_key(raw) if len(raw) >= min(length, words) else None
                    key = key if key is not None and bits[_bits_of([key])[0]] else None
                    out.append((doc, len(raw), hashlib.sha256(raw).hexdigest() if key is None else None, key, None))
                    if key is not None and key not in seen:
                        seen.add(key)
                        out.append((None, None, None, key, raw))
                if out:
                    yield rows(marks, *map(list, zip(*out, strict=True)))

    marked = settle(own.mapInArrow(mark, "doc_id long, n_bytes long, sha string, key binary, raw binary"))
    digest = pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_repeated_words", pa.int64())])

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for key, raw, cuts, word_cuts in zip(*(batch.column(c).to_pylist() for c in ("key", "raw", "cuts", "word_cuts")), strict=True):
            cut = stretches(cuts)
            out.append((key, sum(b - a for a, b in cut), len(cut), hashlib.sha256(without(raw, cut)).hexdigest(), sum(b - a for a, b in stretches(word_cuts))))
        return rows(digest, *(map(list, zip(*out, strict=True)) if out else [[]] * len(digest)))

    # A text is cut once; its copies, however many, take the small result.
    texts = marked.where("raw is not null").select("key", "raw")
    digests = texts.join(cuts.join(word_cuts, "key", "full"), "key", "left").dropDuplicates(["key"]).mapInArrow(by_batch(finish), "key binary, n_removed long, n_spans long, kept_sha256 string, n_repeated_words long")
    some = marked.where("raw is null and key is not null").select("doc_id", "n_bytes", "key").join(digests, "key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated_words")
    nothing = F.lit(0).cast("long")
    none = marked.where("key is null").select("doc_id", "n_bytes", nothing.alias("n_removed"), nothing.alias("n_spans"), F.col("sha").alias("kept_sha256"), nothing.alias("n_repeated_words"))
    return none.unionAll(some)


def strip(docs: DataFrame, words: int = 50, text_col: str = "text") -> DataFrame:
    """docs, all rows and columns, without passages of `words` words or more that also stand elsewhere, whatever the
    white space between their words. A text without such passages stays as it is, a null one stays null."""
    import re

    unit = Unit(True, words)
    own = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    hits = repeats(own, unit)

    key, cuts = fresh(docs, "__key"), fresh(docs, "__cuts")
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    at, schema = docs.columns.index(text_col), to_arrow_schema(docs.schema)
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(_filter(hits)))
    keyed = StructType([*docs.schema.fields]).add(key, BinaryType())

    @released
    def mark(batches):
        # A key where the text may have repeats, null elsewhere.
        bits, wide = np.unpackbits(wanted.value).astype(bool), to_arrow_schema(keyed)
        for batch in batches:
            for part in pieces_of(batch):
                keys = [text_key(t) if t and len(t) >= words else None for t in part.column(at).cast(pa.binary()).to_pylist()]
                keys = [k if k is not None and bits[_bits_of([k])[0]] else None for k in keys]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.binary())], schema=wide)

    marked = settle(docs.mapInArrow(mark, keyed))

    @released
    def cut(batches):
        for batch in batches:
            for part in pieces_of(batch):
                kept = []
                for raw, hit in zip(part.column(at).cast(pa.binary()).to_pylist(), part.column(len(schema)).to_pylist(), strict=True):
                    if raw and hit:
                        starts = [m.start() for m in word.finditer(raw)] + [len(raw)]
                        raw = without(raw, [(starts[a], starts[b]) for a, b in stretches(hit)])
                    kept.append(raw)
                new = [*part.columns[: len(schema)]]
                new[at] = pa.array(kept, pa.binary()).cast(schema.field(at).type)
                yield pa.RecordBatch.from_arrays(new, schema=schema)

    back = [F.col(f"`{c}`") for c in docs.columns]
    found = hits.select(F.col("key").alias(key), F.col("cuts").alias(cuts))
    some = marked.where(f"`{key}` is not null").join(found, key, "left").select(*back, F.col(cuts)).mapInArrow(cut, docs.schema)
    return marked.where(f"`{key}` is null").select(*back).unionAll(some)
