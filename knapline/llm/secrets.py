"""Secret scans with corpus-wide ownership frequency.

Patterns with a fixed form are reported wherever they stand. Looser candidates (long mixed runs) are judged by
the whole corpus: their hashes are summed by distinct repositories and owners, first within each input partition
and then over all. What several owners share, or what stands in many repositories of one, is an example that was
copied around; what one owner has alone, in few repositories, looks live and is reported as well. Where no column
names repositories, each distinct text is one, so that exact copies of a document count once.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, StructType

from .common import by_batch, fresh, pieces_of, released, rows, settle, short_batches, text_key, texts

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "owned")
LOOSE = re.compile(r"[A-Za-z0-9+/_=-]{24,}", re.ASCII)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the base kinds in code points, by start and then kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def mixed(run: str, bits: float = 3.0) -> bool:
    """Whether a run holds letters and digits in an order that words don't have."""
    if not any(c.isdigit() for c in run) or not any(c.isalpha() for c in run):
        return False
    n = len(run)
    return -sum(k / n * math.log2(k / n) for k in Counter(run).values()) >= bits


def loose_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in LOOSE.finditer(text) if mixed(m[0])]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def scan(docs: DataFrame, repository: str | None = None, owner: str = "source", max_owners: int = 1, max_repositories: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans.

    `owned` spans are loose candidates whose value has at most max_owners owners and max_repositories repositories
    in the whole corpus; without a repository column each distinct text is a repository. A null or empty text has no
    spans; a null repository or owner counts as one of its own name, the empty one. Repeated rows each get their row.
    A secret that many copies of one document by several owners share, or more than max_repositories different texts
    of one owner, is an example by this measure.
    """
    found = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("base", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("values", pa.list_(pa.binary())), ("loose", pa.list_(pa.string())), ("repository", pa.string()), ("owner", pa.string())])

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, text, repo, own in zip(batch.column("doc_id").to_pylist(), texts(batch), batch.column("repository").to_pylist(), batch.column("owner").to_pylist(), strict=True):
            spans = base_spans(text)
            n = Counter(s[2] for s in spans)
            loose = loose_spans(text)
            raw = text.encode() if loose else b""
            key = text_key(f"{doc}\0{repo}\0{own}\0".encode() + raw) if loose else None
            if repository is None:
                repo = text_key(raw).hex() if loose else ""
            out.append((doc, key, joined(spans), n["assign"], n["access"], n["hex"], [text_key(text[a:b].encode()) for a, b in loose], [f"owned:{a}:{b}" for a, b in loose], repo, own))
        return rows(found, *map(list, zip(*out, strict=True)))

    short_batches(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), (F.lit("") if repository is None else F.coalesce(F.col(f"`{repository}`").cast("string"), F.lit(""))).alias("repository"), F.coalesce(F.col(f"`{owner}`").cast("string"), F.lit("")).alias("owner"))
    hits = settle(own.mapInArrow(by_batch(search), "doc_id long, key binary, base string, n_assign long, n_access long, n_hex long, values array<binary>, loose array<string>, repository string, owner string"))
    candidates = hits.where("size(values) > 0").select("key", "repository", "owner", F.explode(F.arrays_zip("values", "loose")).alias("c")).select("key", "repository", "owner", F.col("c.values").alias("value"), F.col("c.loose").alias("span"))
    kept = candidates.join(live_values(candidates, max_owners, max_repositories), "value", "left_semi").groupBy("key").agg(F.collect_set("span").alias("owned"))
    with_owned = hits.where("key is not null").join(kept, "key", "left").select("doc_id", "base", "n_assign", "n_access", "n_hex", _merged(F.col("base"), F.col("owned")).alias("spans"))
    plain = hits.where("key is null").select("doc_id", "base", "n_assign", "n_access", "n_hex", F.col("base").alias("spans"))
    return plain.unionAll(with_owned)


def live_values(candidates: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    """(value): what few enough owners and repositories hold, of (value, repository, owner) rows. Distinct places are
    formed and counted within each task first, so that a value that a third of the rows hold reaches its total as few
    rows."""
    places = candidates.select("value", "repository", "owner").distinct()
    n = places.groupBy("value").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))
    return n.where((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)).select("value")


def _merged(base: Column, owned: Column) -> Column:
    """Spans kind:start:end, comma-joined, with an array of further ones in their places."""
    all_ = F.concat(F.filter(F.split(base, ","), lambda s: s != ""), F.coalesce(owned, F.array().cast("array<string>")))
    order = F.array_sort(F.transform(all_, lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), F.split(s, ":")[0]).alias("kind"), s.alias("span"))))
    return F.array_join(F.transform(order, lambda x: x["span"]), ",")


def redact(docs: DataFrame, mark: str = "[secret]", repository: str | None = None, owner: str = "source", max_owners: int = 1, max_repositories: int = 3, text_col: str = "text") -> DataFrame:
    """docs with every reported span replaced by a mark; overlapping spans count as one. All columns stay.

    A text without spans is left as it is, a null one stays null. Only rows with loose candidates are joined. Owners
    and repositories as in `scan`; docs must have the owner's column, and the repository's if one is named.
    """

    short_batches(docs.sparkSession)
    vals, name, owned = (fresh(docs, c) for c in ("__values", "__key", "__owned"))
    wide = StructType([*docs.schema.fields]).add(vals, ArrayType(BinaryType())).add(name, BinaryType())
    schema, at = to_arrow_schema(wide), docs.columns.index(text_col)

    @released
    def mark_rows(batches):
        for batch in batches:
            for part in pieces_of(batch):
                texts_, values, keys = [], [], []
                for t in part.column(at).to_pylist():
                    loose = loose_spans(t or "")
                    texts_.append(t if loose else _cut(t, None, mark))
                    values.append([text_key(t[a:b].encode()) for a, b in loose])
                    keys.append(text_key(t.encode()) if loose else None)
                new = [*part.columns, pa.array(values, pa.list_(pa.binary())), pa.array(keys, pa.binary())]
                new[at] = pa.array(texts_, schema.field(at).type)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(new, schema, strict=True)], schema=schema)

    @F.pandas_udf("string")
    def cut_owned(t: pd.Series, live: pd.Series) -> pd.Series:
        return pd.Series([_cut(x, o, mark) for x, o in zip(t, live, strict=True)], dtype=object)

    text = F.col(f"`{text_col}`")
    marked = settle(docs.mapInArrow(mark_rows, wide))
    loose = marked.where(F.size(vals) > 0)
    place = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    candidates = settle(loose.select(F.col(name).alias("k"), (F.hex(name) if repository is None else place(repository)).alias("repository"), place(owner).alias("owner"), F.explode(vals).alias("value")))
    live = candidates.join(live_values(candidates, max_owners, max_repositories), "value", "left_semi").groupBy(F.col("k").alias(name)).agg(F.collect_set("value").alias(owned))
    back = [F.col(f"`{c}`") for c in docs.columns]
    plain = marked.where(F.size(vals) == 0).select(*back)
    return plain.unionAll(loose.join(live, name, "left").withColumn(text_col, cut_owned(text, F.col(owned))).select(*back))


def _cut(text: str | None, owned: list | None, mark: str) -> str | None:
    if not text:
        return text
    live = set(map(bytes, () if owned is None else owned))
    spans = [(a, b) for a, b, _ in base_spans(text)] + [(a, b) for a, b in (loose_spans(text) if live else ()) if text_key(text[a:b].encode()) in live]
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:] if spans else text
