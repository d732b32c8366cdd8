"""Queries on sites, specimens, texts, sheets, mesh files and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.scalars import stars, tidy as r
from ..functions.stats import pearson_p
from ..operators import geometry, metadata as op
from ..sources import tables, vrml
from .inputs import COORDS, EMBEDDED, MESH, coords, embeddings, sql, table, tidy, vertices

# Short texts as sheets have them; every row of a table takes one, or two of them together, by its keys.
NOTES = ["Handaxe", "cleaver/ discoid?", "on a flake", "broken", "", "Pick / handaxe", "side scaper", "dicoid/discoid", "flake", "NaN", "Trihedral pick", "found / cleaver"]
NOTE_TEXT = "{list}[{k1}] || case when o_orderkey % 3 = 0 then '/' || {list}[{k2}] when o_orderkey % 7 = 1 then ' ' else '' end"
AGE_TEXT = "case {k} % 6 when 0 then ({k} % 90 + 1) || '.' || ({k} % 10) || ' Mya' when 1 then ({k} % 900 + 100) || '-' || ({k} % 90 + 10) || ' Kya' when 2 then '' when 3 then '0.' || ({k} % 10) || ' Mya - 1.' || ({k} % 7) || ' mya (not ' || ({k} % 50) || ' Kya)' when 4 then 'c. ' || ({k} % 500) || ' Kya / ' || ({k} % 70) || ' kya' else 'unknown' end"
ALTITUDE_TEXT = "case {k} % 5 when 0 then ({k} % 3000) || ' m' when 1 then ({k} % 900) || '-' || ({k} % 900 + 150) || ' m' when 2 then '' when 3 then 'sea level' else ({k} % 80) || '.5' end"
SITE_TEXT = "case c_custkey % 5 when 0 then '  ' || c_mktsegment || ' - ' when 1 then c_mktsegment || '_' when 2 then c_mktsegment || ' ' || c_nationkey || ' (' || c_name || ')' when 3 then '(' || c_name || ')' else c_name end"
# A sheet of sites: their names, ages and altitudes, blank rows, and rows that begin the list of specimens.
ROW_NAME = "case when c_custkey % 1000 = 999 then 'Site Name (specimens)' when c_custkey % 20 = 7 then '' else c_mktsegment || ' ' || c_custkey || ' (Z) -' end"
ROW_AGE = f"case when c_custkey % 11 = 3 then 'nan' else {AGE_TEXT.format(k='c_custkey')} end"
ROW_ALTITUDE = f"case when c_custkey % 13 = 3 then 'NaN' else {ALTITUDE_TEXT.format(k='c_custkey')} end"
# A mesh file for every hundred parts: a point for each part, and a polygon of three, four, five or two corners, or one that
# reaches beyond the points; the last has no end mark. Comments stand between points.
POINT_TEXT = "(p_partkey % 10) || ' ' || (p_partkey % 100 {div} 10) || '.5 ' || p_size || 'e-1' || case when p_partkey % 17 = 0 then ' # size 9 9 9 [' || chr(10) else '' end"
POLYGON_TEXT = "case p_partkey % 5 when 0 then {v} || ', ' || ({v} + 1) || ' ' || ({v} + 10) || ' -1' when 1 then {v} || ' ' || ({v} + 1) || ' ' || ({v} + 11) || ' ' || ({v} + 10) || ', -1' when 2 then {v} || ' ' || ({v} + 1) || ' ' || ({v} + 2) || ' ' || ({v} + 11) || ' ' || ({v} + 10) || ' -1' when 3 then {v} || ' ' || ({v} + 1) || ' -1' else {v} || ' ' || ({v} + 1) || ' 150 -1' end"
FILE_HEAD, FILE_MIDDLE, FILE_TAIL = "#VRML V2.0\nShape { geometry IndexedFaceSet { coord Coordinate { point [ ", " ] } coordIndex [ ", " 0 1 2 ] } }"


def site_left_join(s, d):
    sites = table(s, d, "region").select(F.col("r_regionkey").alias("label"), F.col("r_name").alias("site"))
    return op.with_site(embeddings(s, d).select("id", "label"), sites, "label").select("id", "site")


def note_left_join(s, d):
    notes = table(s, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "marked").alias("note"))
    return op.with_note(table(s, d, "documents").select("doc_id"), notes, "doc_id").select("doc_id", "note")


def site_meta_join(s, d):
    """Sites by normalised name: customers' segments stand for raw headers."""
    raw = table(s, d, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit(" - (x)")).alias("header"))
    sites = table(s, d, "customer").groupBy(F.col("c_mktsegment").alias("site")).agg(F.count("*").alias("n_site"))
    return raw.withColumn("site", text.site_key(F.col("header"))).join(sites, "site", "left").select("c_custkey", "site", "n_site")


def site_two_hop(s, d):
    e, n, g = embeddings(s, d), table(s, d, "nation"), table(s, d, "region")
    return e.join(n, F.col("label") == F.col("n_nationkey"), "left").join(g, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("id", "n_name", "r_name")


def reindex_join(s, d):
    want = table(s, d, "documents").select("doc_id", "n_chars")
    have = table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return want.join(have, "doc_id", "left").select("doc_id", "n_chars", "quality")


def note_parse(s, d):
    notes = NOTE_TEXT.format(list="array(" + ", ".join(f"'{n}'" for n in NOTES) + ")", k1=f"int(o_custkey % {len(NOTES)})", k2=f"int(o_orderkey % {len(NOTES)})")
    return table(s, d, "orders").select("o_orderkey", F.expr(notes).alias("t")).select("o_orderkey", text.parse_note(F.col("t")).alias("note"))


def age_parse(s, d):
    return table(s, d, "orders").select("o_orderkey", F.expr(AGE_TEXT.format(k="o_orderkey")).alias("t")).select("o_orderkey", r(text.parse_age(F.col("t"))).alias("age_kya"))


def altitude_parse(s, d):
    return table(s, d, "customer").select("c_custkey", F.expr(ALTITUDE_TEXT.format(k="c_custkey")).alias("t")).select("c_custkey", r(text.parse_altitude(F.col("t"))).alias("altitude_m"))


def site_key(s, d):
    return table(s, d, "customer").select("c_custkey", text.site_key(F.expr(SITE_TEXT)).alias("site"))


def stem_label(s, d):
    return table(s, d, "pages").select("page_id", text.stem(F.col("url")).alias("stem"), text.short_label(F.col("url")).alias("label"))


def dim_ratios(s, d):
    from ..functions.scalars import ratio

    e = geometry.bbox(vertices(s, d))
    return e.select("mesh_id", r(ratio(F.col("e1"), F.col("e2"))).alias("length_width"), r(ratio(F.col("e2"), F.col("e3"))).alias("width_depth"))


def stars_(s, d):
    return coords(s, d).groupBy("label").agg(F.corr("c1", "c2").alias("q"), F.count("*").alias("n")).select("label", stars(F.abs("q")).alias("mark_r"), stars(F.lit(0.02) * F.abs("q")).alias("mark_p"))


def p_values(s, d):
    g = coords(s, d).groupBy("label").agg(F.corr("c1", "c2").alias("r"), F.count("*").alias("n"))
    return g.select("label", "n", "r", pearson_p("r", F.col("n").cast("double")).alias("p"))


def color_rank(s, d):
    return op.colours(table(s, d, "nation").select(F.col("n_name").alias("site"))).select("site", "rank", "colour")


def categorical_codes(s, d):
    return op.codes(table(s, d, "part"), "p_partkey", "p_brand")


def numeric_codes(s, d):
    return op.codes(table(s, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("size")), "p_partkey", "size")


def sheet_unpivot(s, d):
    """A sheet with a column a region: its suppliers, now and then one of the next region as well, and notes beside them."""
    place = table(s, d, "supplier").select(F.col("s_suppkey").alias("row_idx"), "s_name", (F.col("s_nationkey") % 5).alias("k"))
    cell = lambda i: F.when((F.col("k") == i) | ((F.col("row_idx") % 7 == 0) & ((F.col("k") + 1) % 5 == i)), F.concat(F.lit(" "), F.col("s_name"))).otherwise("")
    note = lambda i: F.when(F.col("row_idx") % 3 == i % 3, F.concat(F.lit("note "), F.lit(str(i)))).otherwise(" ")
    rows = place.select("row_idx", F.col("row_idx").cast("string").alias("c0"), *(f(i).alias(f"c{2 * i + j}") for i in range(5) for j, f in ((1, cell), (2, note))))
    names = table(s, d, "region").groupBy().pivot("r_regionkey", list(range(5))).agg(F.first(F.concat("r_name", F.lit(" (x) -"))))
    head = names.select(F.lit(-1).cast("long").alias("row_idx"), F.lit("h").alias("c0"), *(c.alias(f"c{2 * i + j}") for i in range(5) for j, c in ((1, F.col(str(i))), (2, F.lit("n")))))
    return tables.unpivot_specimens(head.unionByName(rows), 5)


def _sheet(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("row_idx"), *(F.expr(e).alias(f"c{k}") for k, e in enumerate((ROW_NAME, ROW_AGE, ROW_ALTITUDE))))


def site_attrs(s, d):
    return tables.site_attributes(_sheet(s, d), ["date_period", "elevation"])


def site_attrs_until(s, d):
    a = tables.site_attributes(_sheet(s, d), ["date_period", "elevation"], until=True)
    return a.select("site", r(text.parse_age(F.col("date_period"))).alias("age_kya"), r(text.parse_altitude(F.col("elevation"))).alias("altitude_m"))


def latest_run(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return tables.latest(o, "o_orderdate", "o_orderkey", "o_custkey").select("o_custkey", "o_orderkey", "o_orderstatus")


def cache_semi(s, d):
    return tables.cached(table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels"), "doc_id")[0]


def cache_anti(s, d):
    return tables.cached(table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels"), "doc_id")[1]


def group_sizes(s, d):
    return embeddings(s, d).groupBy("label").agg(F.count("*").alias("n"))


def axis_range(s, d):
    return op.axis_range(coords(s, d), "c1").select(r("lo").alias("lo"), r("hi").alias("hi"))


def sort_limit(s, d):
    return table(s, d, "part").select("p_partkey", "p_name").orderBy("p_name", "p_partkey").limit(10)


def ordinal(s, d):
    """Objects numbered in the order of their names, partition by partition."""
    from ..sources.sinks import consolidated

    named = table(s, d, "part").select("p_partkey", F.concat_ws("/", "p_name", F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("stem"))
    return consolidated(named).select("p_partkey", "ord")


def hover_summary(s, d):
    pairs = coords(s, d).select("label", F.expr("stack(3, 'c1', c1, 'c2', c2, 'c3', c3) as (name, x)"), "id")
    means = pairs.groupBy("label", "name").agg(r(F.avg("x"), 6).alias("m"))
    return op.hover(means, "label", "name", "m")


def vrml_points(s, d):
    return vrml.points(_files(s, d)).select("mesh_id", "vid", r("x").alias("x"), r("y").alias("y"), r("z").alias("z"))


def vrml_faces(s, d):
    m = _files(s, d)
    return vrml.faces(m, vrml.points(m)).select("mesh_id", "fid", "a", "b", "c")


def _files(s, d):
    """(mesh_id, text) of files written from parts."""
    parts = table(s, d, "part").select(F.expr("p_partkey div 100").alias("mesh_id"), F.struct("p_partkey", F.expr(POINT_TEXT.format(div="div")).alias("p"), F.expr(POLYGON_TEXT.format(v="(p_partkey % 100)")).alias("f")).alias("s"))
    whole = parts.groupBy("mesh_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    joined = lambda k, by: F.array_join(F.transform("s", lambda x: x[k]), by)
    content = F.concat(F.lit(FILE_HEAD), joined("p", ", "), F.lit(FILE_MIDDLE), joined("f", " "), F.lit(FILE_TAIL))
    return vrml.texts(whole.select("mesh_id", content.cast("binary").alias("content")))


def diff_axis(s, d):
    """Symmetric range of a heat map: the largest value off its diagonal."""
    from ..operators import similarity

    m = similarity.largest_cosine(embeddings(s, d).select("id", "v"))
    return m.agg(r(-F.max("value"), 5).alias("lo"), r(F.max("value"), 5).alias("hi"))


LETTER = "case " + " ".join(f"when contains(p, '{w}') then '{k}'" for w, k in text.NOTE_LETTERS.items()) + " end"
_NOTES = "lit as (select o_orderkey, " + NOTE_TEXT.format(list="(" + "[" + ", ".join(f"'{n}'" for n in NOTES) + "])", k1=f"o_custkey % {len(NOTES)} + 1", k2=f"o_orderkey % {len(NOTES)} + 1") + " as t from orders)"
NUM = r"([0-9]+(?:\.[0-9]+)?)"
AGE = rf"coalesce(list_avg(list_transform(regexp_extract_all(t, '(?i){NUM}\s*mya', 1), lambda x: x::double)) * 1000, list_avg(list_transform(regexp_extract_all(t, '(?i)([0-9]+)\s*kya', 1), lambda x: x::double)))"
ALT = f"list_avg(list_transform(regexp_extract_all(t, '{NUM}', 1), lambda x: x::double))"
KEY = "rtrim(trim(split_part(t, '(', 1)), ' -_')"
BOX = "b as (select mesh_id, max(x) - min(x) ex, max(y) - min(y) ey, max(z) - min(z) ez from v group by 1), s as (select mesh_id, list_reverse_sort([ex, ey, ez]) l from b)"


BLANK = lambda c: f"case when trim({c}) <> '' and lower(trim({c})) <> 'nan' then trim({c}) end"
FLAT = f"flat as (select p_partkey // 100 as mesh_id, regexp_replace('{FILE_HEAD}' || string_agg({POINT_TEXT.format(div='//')}, ', ' order by p_partkey) || '{FILE_MIDDLE}' || string_agg({POLYGON_TEXT.format(v='(p_partkey % 100)')}, ' ' order by p_partkey) || '{FILE_TAIL}', '#[^\n]*', '', 'g') as text from part group by 1)"
XYZ = r"n as (select mesh_id, list_transform(regexp_extract_all(regexp_extract(text, '(?is)\bpoint\s*\[([^\]]*)\]', 1), '([-+]?(?:[0-9]*\.[0-9]+|[0-9]+\.?)(?:[eE][-+]?[0-9]+)?)', 1), lambda x: x::double) as v from flat)"
IDX = r"""ix as (select mesh_id, list_transform(regexp_extract_all(regexp_extract(text, '(?is)\bcoordIndex\s*\[([^\]]*)\]', 1), '(-?[0-9]+)', 1), lambda x: x::bigint) as v from flat),
p as (select mesh_id, generate_subscripts(v, 1) as pos, unnest(v) as idx from ix), q as (select *, count_if(idx = -1) over (partition by mesh_id order by pos) - (idx = -1)::int as face from p),
g as (select mesh_id, face, list(idx order by pos) filter (where idx <> -1) as l, bool_or(idx = -1) as ended from q group by mesh_id, face),
t as (select mesh_id, face, 0 as part, l[1] as a, l[2] as b, l[3] as c from g where len(l) = 3 or (len(l) = 4 and ended) union all select mesh_id, face, 1, l[1], l[3], l[4] from g where len(l) = 4 and ended)"""
SHEET = f"w as (select c_custkey as row_idx, {ROW_NAME} as c0, {ROW_AGE} as c1, {ROW_ALTITUDE} as c2 from customer)"
SPECIMENS = """pl as (select s_suppkey as row_idx, s_name, s_nationkey % 5 as k from supplier),
l as (select row_idx, i as k, case when k = i or (row_idx % 7 = 0 and (k + 1) % 5 = i) then ' ' || s_name else '' end as cell, case when row_idx % 3 = i % 3 then 'note ' || i else ' ' end as note from pl, range(5) r(i)),
h as (select r_regionkey as k, rtrim(trim(split_part(r_name || ' (x) -', '(', 1)), ' -_') as site from region),
c as (select l.k, row_idx, trim(cell) as stem, site, nullif(trim(note), '') as note, row_number() over (partition by trim(cell) order by l.k desc, row_idx desc) as r from l join h on h.k = l.k where trim(cell) <> '')"""
STARS = lambda p: f"case when {p} < 0.001 then '***' when {p} < 0.01 then '**' when {p} < 0.05 then '*' else '' end"
COLOURS = "[" + ", ".join(f"'{c}'" for c in op.PALETTE) + "]"

QUERIES = {
    "site_left_join": (site_left_join, sql(EMBEDDED, "select id, coalesce(r_name, 'Unknown') as site from emb left join region on label = r_regionkey")),
    "note_left_join": (note_left_join, "select d.doc_id, case when toxic = 1 then 'marked' else '' end as note from documents d left join labels l on l.doc_id = d.doc_id"),
    "site_meta_join": (site_meta_join, "select c_custkey, c_mktsegment as site, count(*) over (partition by c_mktsegment) as n_site from customer"),
    "site_two_hop": (site_two_hop, sql(EMBEDDED, "select id, n_name, r_name from emb left join nation on label = n_nationkey left join region on n_regionkey = r_regionkey")),
    "reindex_join": (reindex_join, "select d.doc_id, n_chars, quality from documents d left join (select doc_id, max(quality) as quality from labels group by 1) l on l.doc_id = d.doc_id"),
    "note_parse": (note_parse, sql(_NOTES, f"select o_orderkey, case when lower(trim(t)) in ('', 'nan', 'none') then null when contains(lower(t), 'on a flake') then 'f' when list_contains(list_transform(str_split(lower(trim(t)), '/'), lambda p: coalesce({LETTER}, '?')), '?') then '-' else array_to_string(list_transform(list_filter(list_transform(str_split(lower(trim(t)), '/'), lambda p, i: {{'k': {LETTER}, 'i': i}}), lambda x: list_position(list_transform(str_split(lower(trim(t)), '/'), lambda p: {LETTER}), x.k) = x.i), lambda x: x.k), '/') end as note from lit")),
    "age_parse": (age_parse, sql(f"lit as (select o_orderkey, {AGE_TEXT.format(k='o_orderkey')} as t from orders)", f"select o_orderkey, {tidy(AGE)} as age_kya from lit")),
    "altitude_parse": (altitude_parse, sql(f"lit as (select c_custkey, {ALTITUDE_TEXT.format(k='c_custkey')} as t from customer)", f"select c_custkey, {tidy(ALT)} as altitude_m from lit")),
    "site_key": (site_key, sql(f"lit as (select c_custkey, {SITE_TEXT} as t from customer)", f"select c_custkey, {KEY} as site from lit")),
    "stem_label": (stem_label, sql(r"s as (select page_id, regexp_replace(str_split(url, '/')[-1], '(.)\.[^.]*$', '\1') as stem from pages)", "select page_id, stem, substr(stem, 1, 12) as label from s")),
    "dim_ratios": (dim_ratios, sql(MESH, BOX, f"select mesh_id, {tidy('case when l[2] > 0 then l[1] / l[2] end')} as length_width, {tidy('case when l[3] > 0 then l[2] / l[3] end')} as width_depth from s")),
    "stars": (stars_, sql(COORDS, "g as (select label, abs(corr(c1, c2)) as q from co group by 1)", f"select label, {STARS('q')} as mark_r, {STARS('0.02 * q')} as mark_p from g")),
    "p_values": (p_values, None),
    "color_rank": (color_rank, f"select site, (dense_rank() over (order by site) - 1)::int as rank, ({COLOURS})[((dense_rank() over (order by site) - 1) % 15)::int + 1] as colour from (select distinct n_name as site from nation)"),
    "categorical_codes": (categorical_codes, "select p_partkey, (dense_rank() over (order by p_brand) - 1)::double as code from part"),
    "numeric_codes": (numeric_codes, "select p_partkey, p_size::double as code from part"),
    "sheet_unpivot": (sheet_unpivot, sql(SPECIMENS, "select stem, site, note from c where r = 1")),
    "site_attrs": (site_attrs, sql(SHEET, f"select {KEY.replace('t,', 'c0,')} as site, {BLANK('c1')} as date_period, {BLANK('c2')} as elevation from w where trim(c0) <> '' and c0 not like 'Site Name%'")),
    "site_attrs_until": (site_attrs_until, sql(SHEET, f"a as (select {KEY.replace('t,', 'c0,')} as site, {BLANK('c1')} as dp, {BLANK('c2')} as el from w where trim(c0) <> '' and row_idx < coalesce((select min(row_idx) from w where c0 like 'Site Name%'), 1e18))", f"select site, {tidy(AGE.replace('(t,', '(dp,'))} as age_kya, {tidy(ALT.replace('(t,', '(el,'))} as altitude_m from a")),
    "latest_run": (latest_run, "select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 1"),
    "cache_semi": (cache_semi, "select doc_id, lang from documents where doc_id in (select doc_id from labels)"),
    "cache_anti": (cache_anti, "select doc_id, lang from documents where doc_id not in (select doc_id from labels)"),
    "group_sizes": (group_sizes, "select label, count(*) as n from embeddings group by 1"),
    "axis_range": (axis_range, sql(COORDS, "m as (select min(c1) a, max(c1) b from co)", f"select {tidy('a - 0.05 * (b - a)')} as lo, {tidy('b + 0.05 * (b - a)')} as hi from m")),
    "sort_limit": (sort_limit, "select p_partkey, p_name from part order by p_name, p_partkey limit 10"),
    "ordinal": (ordinal, "select p_partkey, row_number() over (order by concat_ws('/', p_name, lpad(p_partkey::varchar, 12, '0'))) - 1 as ord from part"),
    "hover_summary": (hover_summary, sql(COORDS, f"l as (select label, unnest(['c1', 'c2', 'c3']) as name, unnest([c1, c2, c3]) as x from co), m as (select label, name, {tidy('avg(x)')} as m from l group by 1, 2), u as (select *, row_number() over (partition by label order by m desc, name) as k from m where m > 0), n as (select *, row_number() over (partition by label order by m, name) + 2 as k from m where m < 0), a as (select * from u where k <= 2 union all select * from n where k <= 4)", "select label, string_agg(name, ',' order by k) as summary from a group by label")),
    "vrml_points": (vrml_points, sql(FLAT, XYZ, f"select mesh_id, i as vid, {tidy('v[3 * i + 1]')} as x, {tidy('v[3 * i + 2]')} as y, {tidy('v[3 * i + 3]')} as z from (select mesh_id, v, unnest(range(len(v) // 3)) as i from n)")),
    "vrml_faces": (vrml_faces, sql(FLAT, XYZ, IDX, "select mesh_id, row_number() over (partition by mesh_id order by face, part) - 1 as fid, a, b, c from t join n using (mesh_id) where least(a, b, c) >= 0 and greatest(a, b, c) < len(v) // 3")),
    "heatmap_range": (diff_axis, sql(EMBEDDED, "p as (select list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) as x from emb a join emb b on a.id < b.id)", f"select {tidy('-max(abs(x))', 5)} as lo, {tidy('max(abs(x))', 5)} as hi from p")),
}
