"""Packing: bounded-space online packing of token ids into sequences.

Each partition reads its documents once and keeps at most `open_windows` sequences open. A document's full
sequences leave at once; its rest goes to the open window that it fits best. Where it fits none and no more may
be opened, the fullest window is filled up with the head of the rest and emitted. What is still open at the end
of a partition is merged: poured together, cut at the sequence length, and the last remainder split into powers
of two, so that no sequence needs padding. No document moves between tasks, and memory doesn't grow with input.
"""

from __future__ import annotations

import array
import bisect
import functools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import PATTERN, Vocabulary
from .common import pieces_of, released, rows, short_batches, texts

OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Chunks:
    """A tokenizer's ids for whole texts, packed. What chunks between spaces encode to is remembered in two generations
        of `limit` chunks: when the younger is full the older goes, but chunks that are met again move to the younger. An
    empty chunk, or one that ends in white space, depends on what follows, so such texts are encoded whole, and likewise
    those with a special token."""

    def __init__(self, path: str, limit: int = 50_000):
        self.path, self.limit, self.known, self.old, self._tokenizer = path, limit, {}, {}, None
        vocabulary = Vocabulary(path)
        self.special, self.quick = tuple(vocabulary.special), self._quick(vocabulary)

    @property
    def tokenizer(self):
        """The tokenizer itself, loaded where a text needs it."""
        if self._tokenizer is None:
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
            self._tokenizer.no_truncation()
            self._tokenizer.no_padding()
        return self._tokenizer

    def _encode(self, strings: list[str]) -> list[bytes]:
        if not strings:
            return []
        return [array.array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    @staticmethod
    def _quick(v: Vocabulary):
        """The same merges in a faster library, for short chunks: only where merges are numbered as they apply, and
        the vocabulary is that of byte-level pieces without further settings."""
        if any(v.parts[k][2] != n for n, k in enumerate(sorted(v.parts))) or len(v.ids) != len(v.usable):
            return None
        import tiktoken

        return tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=v.ids, special_tokens={}).encode_ordinary

    def _chunks(self, strings: list[str]) -> list[bytes]:
        if self.quick is None:
            return self._encode(strings)
        return [array.array("I", self.quick(s)).tobytes() for s in strings]

    def __call__(self, batch: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known, self.old = {}, self.known
        known, old, split, new, whole = self.known, self.old, [], set(), {}
        for k, text in enumerate(batch):
            if any(s in text for s in self.special):
                whole[k] = text
                split.append(None)
                continue
            first, *chunks = text.split(" ")
            fresh = set(chunks).difference(known)
            if again := fresh & old.keys():
                known.update((c, old[c]) for c in again)
                fresh -= again
            if first.endswith(tuple("\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0")) or first[-1:].isspace() or any(not c or len(c) > 256 or c[-1].isspace() for c in fresh) or not first:
                whole[k] = text
                split.append(None)
            else:
                new |= fresh
                split.append((first, chunks))
        order = list(new)
        known.update(zip(order, self._chunks([" " + c for c in order]), strict=True))
        firsts = iter(self._chunks([s[0] for s in split if s]))
        alone = dict(zip(whole, self._encode(list(whole.values())), strict=True)) if whole else {}
        return [alone[k] if s is None else next(firsts) + b"".join(map(known.__getitem__, s[1])) for k, s in enumerate(split)]

    def forget(self) -> None:
        """Gives back what texts have left behind. The vocabulary stays, the tokenizer is loaded anew where a text needs it."""
        self.known, self.old, self._tokenizer = {}, {}, None


@functools.lru_cache(maxsize=2)
def chunks(path: str) -> Chunks:
    return Chunks(path)


class Packer:
    """Takes documents' packed ids; gives rows (doc_id, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, length: int = 2048, open_windows: int = 64):
        self.length, self.most, self.sequence = length, open_windows, 0
        self.free: list[tuple[int, int]] = []  # (ids that still fit, window), in order
        self.windows: dict[int, list] = {}
        self.name = 0

    def _piece(self, doc, total, at, ids):
        return (doc, at, len(ids) // 4, ids, total)

    def _emit(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for doc, at, n, ids, total in pieces:
            yield doc, at, n, zlib.crc32(ids), total, self.sequence, offset
            offset += n
        self.sequence += 1

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        total, full, at = len(ids) // 4, self.length, 0
        while total - at >= full:
            yield from self._emit([self._piece(doc, total, at, ids[4 * at : 4 * (at + full)])])
            at += full
        while at < total:
            rest = total - at
            k = bisect.bisect_left(self.free, (rest, -1))
            if k < len(self.free):
                room, name = self.free.pop(k)
                take = rest
            elif len(self.free) < self.most:
                room, name, take = full, self.name, rest
                self.windows[name] = []
                self.name += 1
            else:
                room, name = self.free.pop(0)
                take = room
            self.windows[name].append(self._piece(doc, total, at, ids[4 * at : 4 * (at + take)]))
            at += take
            if room == take:
                yield from self._emit(self.windows.pop(name))
            else:
                bisect.insort(self.free, (room - take, name))

    def finish(self) -> Iterator[tuple]:
        left = [p for _, name in self.free for p in self.windows[name]]
        self.free, self.windows = [], {}
        goal = self._goal(sum(p[2] for p in left))
        now, held = [], 0
        want = next(goal, 0)
        for doc, at, _, ids, total in left:
            while ids:
                take = min(want - held, len(ids) // 4)
                now.append(self._piece(doc, total, at, ids[: 4 * take]))
                at, ids, held = at + take, ids[4 * take :], held + take
                if held == want:
                    yield from self._emit(now)
                    now, held, want = [], 0, next(goal, 0)

    def _goal(self, n: int) -> Iterator[int]:
        """Lengths of the last sequences: whole ones, then powers of two."""
        while n:
            part = self.length if n >= self.length else 1 << (n.bit_length() - 1)
            yield part
            n -= part


def pack(docs: DataFrame, path: str, length: int = 2048, open_windows: int = 64, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every document's ids, with `end_id` behind, and returns one row for each piece.

    A null or empty text is the end id alone. A document longer than a sequence is cut. Repeated rows are packed
    once each; null document ids pass through. An empty table gives no rows. length must be a power of two.
    """
    short_batches(docs.sparkSession)
    end = array.array("I", [end_id]).tobytes()

    @released
    def run(batches):
        code, packer = chunks(path), Packer(length, open_windows)
        base = TaskContext.get().partitionId() << 33

        def table(found: list) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True))
            cols[5] = [base + s for s in cols[5]]
            return rows(OUT, *map(list, cols))

        try:
            for batch in batches:
                for part in pieces_of(batch):
                    found = []
                    for doc, ids in zip(part.column("doc_id").to_pylist(), code(texts(part)), strict=True):
                        found.extend(packer.add(doc, ids + end))
                    if found:
                        yield table(found)
            if found := list(packer.finish()):
                yield table(found)
        finally:
            code.forget()  # Python workers outlive tasks

    own = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    return own.mapInArrow(run, DDL)
