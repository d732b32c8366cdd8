"""Byte-level BPE as a bounded-lookahead streaming transducer, and the way back.

For every prefix of a piece the last token of its encoding is unique: it is the suffix token that is compatible
with the last token of the encoding of what precedes it. The encoder keeps these last tokens only, so that it
needs no merge queue. Later bytes can start a token at most `longest` bytes back; where the chains from all
those places run through one boundary, what lies before it is stable and is emitted. The merge list bounds how
far a boundary can wait (`lookahead`), hence memory is constant, whatever a piece's length.

Null and empty texts have no ids. Repeated rows give repeated results. A text may be of any length.
"""

from __future__ import annotations

import array
import codecs
import functools
import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces_of, released, rows, short_batches, texts

# Fixed value: the pre-tokenizer's pattern as the vocabulary's publisher states it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_names() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            table = json.load(f)
        names = byte_names()
        spell = lambda t: bytes(names[c] for c in t)
        vocab = table["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in table["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in table["added_tokens"]}
        self.ids = {spell(t): k for t, k in vocab.items() if t not in self.special}
        self.bytes: dict[int, bytes] = {k: t for t, k in self.ids.items()} | {k: t.encode() for t, k in self.special.items()}
        self.rank, self.parts = {}, {}
        for r, (a, b) in enumerate(merges):
            x, y = vocab[a], vocab[b]
            self.rank.setdefault((x, y), r)
            self.parts.setdefault(vocab[a + b], (x, y, r))
        self.longest = max(map(len, self.ids))
        self.pattern = regex.compile(PATTERN)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._fits: dict[int, bool] = {}
        self.usable = {t: k for t, k in self.ids.items() if self.whole(k)}
        self.reach = [0] * 256  # the longest token that ends in a byte
        for t in self.usable:
            self.reach[t[-1]] = max(self.reach[t[-1]], len(t))
        self.lookahead = self._lookahead(merges, vocab)

    def _lookahead(self, merges: list, vocab: dict[str, int]) -> int:
        """Bytes over which a change can spread to the left: the longest chain of merges, each later than the one
        before, in which one's left part ends the next one's right part; and a token more."""
        best: dict[int, int] = {}
        most = 0
        for a, b in merges:
            x, y = vocab[a], vocab[b]
            far, part = 0, y
            while True:
                far = max(far, best.get(part, 0))
                if part not in self.parts:
                    break
                part = self.parts[part][1]
            here = len(self.bytes[x]) + max(far, len(self.bytes[y]))
            best[x] = max(best.get(x, 0), here)
            most = max(most, here)
        return most + self.longest

    def fits(self, a: int, b: int) -> bool:
        """Whether the encoding of both tokens' bytes is a, b: no earlier merge crosses their border."""
        key = a << 32 | b
        if (known := self._fits.get(key)) is not None:
            return known
        if len(self._fits) > 2_000_000:
            self._fits.clear()
        x, y, limit = a, b, 1 << 60
        out = True
        while True:
            r = self.rank.get((x, y))
            if r is not None and r < limit:
                out = False
                break
            px, py = self.parts.get(x), self.parts.get(y)
            if px is None and py is None:
                break
            if py is None or px is not None and px[2] > py[2]:
                limit, x = px[2], px[1]
            else:
                limit, y = py[2] + 1, py[0]
        self._fits[key] = out
        return out

    def piece(self, raw: bytes) -> list[int]:
        """A short piece's ids."""
        if (one := self.usable.get(raw)) is not None:
            return [one]
        n = len(raw)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        self._extend(raw, last, size, 1, n)
        return self._chain(last, size, n)

    @functools.lru_cache(maxsize=100_000)  # noqa: B019
    def whole(self, token: int) -> bool:
        """Whether a token's own bytes encode to it."""
        if token not in self.parts:
            return True
        x, y, r = self.parts[token]
        return self.whole(x) and self.whole(y) and self.fits_below(x, y, r)

    def fits_below(self, a: int, b: int, limit: int) -> bool:
        """fits(), but only merges earlier than `limit` count."""
        x, y = a, b
        while True:
            px, py = self.parts.get(x), self.parts.get(y)
            if px is None and py is None:
                return True
            if py is None or px is not None and px[2] > py[2]:
                x, bound = px[1], px[2]
            else:
                y, bound = py[0], py[2] + 1
            r = self.rank.get((x, y))
            if r is not None and r < min(bound, limit):
                return False

    def _extend(self, raw: bytes, last: list, size: list, first: int, n: int) -> None:
        """The last tokens of the prefixes of raw that end at first..n; last[0] is the token before raw, or -1."""
        usable, reach, known = self.usable.get, self.reach, self._fits
        for end in range(first, n + 1):
            begin = end - reach[raw[end - 1]]
            for begin in range(begin if begin > 0 else 0, end):
                token = usable(raw[begin:end])
                if token is None:
                    continue
                before = last[begin]
                if before >= 0:
                    ok = known.get(before << 32 | token)
                    if ok is None:
                        ok = self.fits(before, token)
                    if not ok:
                        continue
                elif begin:
                    continue
                last[end], size[end] = token, end - begin
                break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def stream(self, chunks: Iterable[bytes]) -> Iterator[list[int]]:
        """The ids of one piece that arrives in chunks, given out as soon as they are stable."""
        raw, last, size, held = b"", [-1], [0], 2 * self.lookahead
        for chunk in chunks:
            for k in range(0, len(chunk), held):
                part = chunk[k : k + held]
                n = len(raw)
                raw += part
                last += [-1] * len(part)
                size += [0] * len(part)
                self._extend(raw, last, size, n + 1, len(raw))
                if len(raw) > held and (cut := self._stable(size)):
                    yield self._chain(last, size, cut)
                    raw, last, size = raw[cut:], last[cut:], [0] + size[cut + 1 :]
        yield self._chain(last, size, len(raw))

    def _stable(self, size: list) -> int:
        """The last boundary through which the chains from all places that a later token can start at run."""
        n = len(size) - 1
        live = set(range(max(1, n - self.longest), n + 1))
        while len(live) > 1:
            at = max(live)
            live.discard(at)
            live.add(at - size[at])
        return live.pop()

    @staticmethod
    def _chain(last: list, size: list, at: int) -> list[int]:
        out = []
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]


class Transducer:
    """Whole texts to packed little-endian ids. What short chunks between spaces encode to is remembered up to a
    bound; a chunk's encoding doesn't depend on its neighbours unless it is empty or ends in white space."""

    SHORT = 256

    def __init__(self, vocabulary: Vocabulary, limit: int = 600_000):
        self.v, self.limit, self.known, self.pieces = vocabulary, limit, {}, {}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            raw = piece.encode()
            if len(raw) > self.SHORT:
                out = array.array("I")
                for ids in self.v.stream(raw[k : k + 4096] for k in range(0, len(raw), 4096)):
                    out.extend(ids)
                return out.tobytes()
            if len(self.pieces) > self.limit:
                self.pieces.clear()
            found = self.pieces[piece] = array.array("I", self.v.piece(raw)).tobytes()
        return found

    def plain(self, text: str) -> bytes:
        """Ids of a text, piece by piece."""
        if self.v.splitter is None or not any(s in text for s in self.v.special):
            return b"".join(map(self._piece, self.v.pattern.findall(text)))
        out = []
        for k, part in enumerate(self.v.splitter.split(text)):
            out.append(array.array("I", [self.v.special[part]]).tobytes() if k % 2 else b"".join(map(self._piece, self.v.pattern.findall(part))))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *chunks = text.split(" ")
        known = self.known
        for chunk in set(chunks).difference(known):
            if not chunk or chunk[-1].isspace():
                return self.plain(text)
            if len(known) > self.limit:
                known.clear()
                return self.plain(text)
            ids = self.plain(" " + chunk)
            if len(chunk) <= self.SHORT:
                known[chunk] = ids
            else:
                return self.plain(text)
        if first and first[-1].isspace():
            return self.plain(text)
        head = self.plain(first) if first else b""
        if not first and chunks and chunks[0][:1].isspace():
            return self.plain(text)
        return head + b"".join(map(known.__getitem__, chunks))


class Decoder:
    """Ids to text: bytes gather in an incremental UTF-8 state machine, which holds three bytes at most."""

    BLOCK = 1 << 15

    def __init__(self, vocabulary: Vocabulary):
        self.bytes = [vocabulary.bytes.get(k, b"") for k in range(max(vocabulary.bytes) + 1)]

    def __call__(self, packed: bytes) -> Iterator[str]:
        state = codecs.getincrementaldecoder("utf-8")("replace")
        spell = self.bytes.__getitem__
        for k in range(0, len(packed), 4 * self.BLOCK):
            yield state.decode(b"".join(map(spell, array.array("I", packed[k : k + 4 * self.BLOCK]))))
        yield state.decode(b"", final=True)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(vocabulary(path))


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text and decodes its ids: their number, and digests of the ids and of the decoded text.

    A null or empty text has 0 ids and the digests of nothing; null ids of documents pass through.
    """

    short_batches(docs.sparkSession)

    @released
    def run(batches):
        code, back = transducer(path), Decoder(vocabulary(path))
        for batch in batches:
            for part in pieces_of(batch):
                n, ids, decoded = [], [], []
                for text in texts(part):
                    packed = code.encode(text)
                    n.append(len(packed) // 4)
                    ids.append(hashlib.sha256(packed).hexdigest())
                    digest = hashlib.sha256()
                    for piece in back(packed):
                        digest.update(piece.encode())
                    decoded.append(digest.hexdigest())
                yield rows(OUT, part.column("doc_id"), n, ids, decoded)

    own = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    return own.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): every text's ids as an array."""
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    @released
    def run(batches):
        code = transducer(path)
        for batch in batches:
            for part in pieces_of(batch):
                yield rows(out, part.column("doc_id"), [array.array("I", code.encode(t)).tolist() for t in texts(part)])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): what arrays of ids spell; null arrays and null ids spell nothing."""
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    @released
    def run(batches):
        back = Decoder(vocabulary(path))
        for batch in batches:
            for part in pieces_of(batch):
                lists = part.column("ids").to_pylist()
                yield rows(out, part.column("doc_id"), ["".join(back(array.array("I", [k for k in x or () if k is not None]).tobytes())) for x in lists])

    return ids.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{ids_col}` ids").mapInArrow(run, "doc_id long, text string")
