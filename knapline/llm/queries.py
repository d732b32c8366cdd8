"""The operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classify, codes, extract, jaccard, licenses, merkle, neighbours, packing, rules, secrets, substrings, toxicity
from .common import documents


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary_path())


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), vocabulary_path())


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op11_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 3 divides the crc32 of its id, a document is claimed to have its capitals A to Z in lower case."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    some = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.manifest(documents(spark, sf_dir), {"text": F.when(some, lower).otherwise(F.col("text"))})


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pack, op2_substrings, op3_bpe, op4_quality_classifier, op5_neighbours, op6_licenses, op7_toxicity, op8_quality_rules, op9_secrets, op10_jaccard, op11_extract, op12_manifest, op13_codes)}


#: All pairs that share a shingle, counted; then the least id that links lead to.
OP10 = r"""with recursive w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from w),
x as materialized (select doc_id, len(s) as n, unnest(s) as g from s),
l as materialized (select a.doc_id as a, b.doc_id as b from x a join x b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(doc_id, root) as (select doc_id, doc_id from s union select l.b, r.root from r join l on l.a = r.doc_id and r.root < l.b)
select s.doc_id, len(s.s) as n_shingles, min(root) as component_id from s join r on r.doc_id = s.doc_id group by s.doc_id, s.s"""


def _shown(column: str) -> str:
    return f"case when {column} is null then '-' else strlen({column}::varchar) || ':' || {column}::varchar end"


def _row(text: str) -> str:
    return "sha256(" + " || ".join(_shown(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32 bit by bit: a digit comes in before the first of its eight steps.
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: list_prepend(ascii(c)::bigint, list_resize([]::bigint[], 7, 0))))), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"
_BESIDE = lambda key, frame: f"coalesce(string_agg(digest, '') over (partition by {key}level, pos // 8 order by pos rows between {frame}), '')"
_SIDES = lambda key, name, table: f"{name} as materialized (select {key}level, pos, {_BESIDE(key, 'unbounded preceding and 1 preceding')} as before, {_BESIDE(key, '1 following and unbounded following')} as after from {table} where n > 1)"
OP12 = f"""with recursive l as materialized (select doc_id, lang, {_row('text')} as leaf, {_row(f"(case when {_CRC} % 3 = 0 then {_LOWER} else text end)")} as claimed from documents),
b as materialized (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from l),
t(lang, level, pos, n, digest) as (select lang, 0, pos, n, leaf from b union all select lang, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' order by pos)) from t where n > 1 group by lang, level, pos // 8, n),
s as materialized (select lang, digest as subroot, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from t where n = 1),
u(level, pos, n, digest) as (select 0, pos, n, subroot from s union all select level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' order by pos)) from u where n > 1 group by level, pos // 8, n),
{_SIDES('lang, ', 'ts', 't')}, {_SIDES('', 'us', 'u')},
w(doc_id, leaf, lang, level, pos, h, proof) as (select doc_id, leaf, lang, 0, pos, claimed, '' from b union all select w.doc_id, w.leaf, w.lang, w.level + 1, w.pos // 8, sha256(before || h || after), proof || before || after from w join ts on ts.lang is not distinct from w.lang and ts.level = w.level and ts.pos = w.pos),
e as materialized (select w.doc_id, w.leaf, s.subroot, s.pos, w.h, w.proof from w join s on s.lang is not distinct from w.lang where w.level = (select max(level) from t where t.lang is not distinct from w.lang)),
x(doc_id, leaf, subroot, level, pos, h, proof) as (select doc_id, leaf, subroot, 0, pos, h, proof from e union all select x.doc_id, x.leaf, x.subroot, x.level + 1, x.pos // 8, sha256(before || h || after), proof || before || after from x join us on us.level = x.level and us.pos = x.pos)
select doc_id, leaf, subroot, u.digest as root, sha256(proof) as proof_sha256, h as folded_root, h = u.digest as verified from x join u on u.n = 1 and u.level = x.level"""

_NEAR = lambda c: f"(select vec_id, p, min({{'d': list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c), 'e': e}}) as m from parts join {c} using (p) group by vec_id, p)"
_MOVED = lambda k: f"""a{k} as materialized (select p, m.e as e, generate_subscripts(x, 1) as i, unnest(x)::bigint as y from {_NEAR(f'c{k}')} join parts using (vec_id, p)),
m{k} as materialized (select p, e, list(v order by i) as c from (select p, e, i, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) as v from a{k} group by p, e, i) group by p, e),
c{k + 1} as materialized (select c{k}.p, c{k}.e, coalesce(m{k}.c::double[], c{k}.c) as c from c{k} left join m{k} on m{k}.p = c{k}.p and m{k}.e = c{k}.e)"""  # noqa: E731
#: Whole numbers below 2^53, so that products of doubles are exact.
OP13 = f"""with k as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as v, row_number() over (order by vec_id) - 1 as seed from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select vec_id, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] as x from k, range(4) r(p)),
c0 as materialized (select p, seed as e, x as c from parts join k using (vec_id) where seed < 256),
{', '.join(_MOVED(k) for k in range(4))},
f as materialized (select vec_id, string_agg(format('{{:02x}}', m.e), '' order by p) as code, sum(m.d)::bigint as error from {_NEAR('c4')} group by vec_id),
h as (select sha256(string_agg(y::bigint::varchar, ',' order by p, e, i)) as s from (select p, e, generate_subscripts(c, 1) as i, unnest(c) as y from c4))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, s as codebooks_sha256 from f join k using (vec_id), h"""


def oracle_sql() -> dict[str, str]:
    """The other queries are learned, approximate or hash bytes in ways that SQL lacks; tests hold them against brute
    force, round trips or held-out labels."""
    return {"op10_jaccard": OP10, "op12_manifest": OP12, "op13_codes": OP13}
