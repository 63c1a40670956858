"""Design-system queries. Colours and lengths are derived from the part and nation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import style as S
from ..operators import design as G
from ..operators.components import connected_components
from ..session import table
from .graph import _E, _entities
from .registry import query
from .stats import _A, _analyses

_COLOUR = "'#' || upper(substring(md5({}), 1, 6)) || 'FF'"
_CH = "('0x' || substring({}, {}, 2))::int"


def _distance(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"pow({_CH.format(a, 2 + 2 * i)} - {_CH.format(b, 2 + 2 * i)}, 2)" for i in range(4)) + ") / 510"


def _luminance(c: str) -> str:
    lin = lambda i: f"(case when {_CH.format(c, 2 + 2 * i)} / 255 <= 0.03928 then {_CH.format(c, 2 + 2 * i)} / 255 / 12.92 else pow(({_CH.format(c, 2 + 2 * i)} / 255 + 0.055) / 1.055, 2.4) end)"
    return f"(0.2126 * {lin(0)} + 0.7152 * {lin(1)} + 0.0722 * {lin(2)})"


def _colour(c):
    return F.concat(F.lit("#"), F.upper(F.substring(F.md5(c), 1, 6)), F.lit("FF"))


@query(f"""
    with p as (select p_partkey, {_COLOUR.format("p_name")} as colour from part), t as (select n_name as name, {_COLOUR.format("n_name")} as value from nation),
    x as (select p_partkey, name, round({_distance("colour", "value")}, 9) as d from p, t),
    r as (select *, row_number() over (partition by p_partkey order by d, name) as k from x)
    select p_partkey, name as token, round(d, 6) as distance, case when d = 0 then 'exact' when d <= 0.05 then 'near' else 'off_scale' end as match from r where k = 1""")
def colour_nearest(s, d):
    tokens = table(s, d, "nation").select(F.col("n_name").alias("name"), _colour(F.col("n_name")).alias("value"))
    return G.nearest_colour(table(s, d, "part").select("p_partkey", _colour(F.col("p_name")).alias("colour")), "colour", tokens).select("p_partkey", "token", F.round("distance", 6).alias("distance"), "match")


@query("""
    with t as (select unnest([4.0, 8.0, 12.0, 16.0, 24.0, 32.0, 48.0])::double as t),
    r as (select p_partkey, t, abs(t - p_size) as d, row_number() over (partition by p_partkey order by abs(t - p_size), t) as k from part, t)
    select p_partkey, t as nearest, d as distance, case when d = 0 then 'exact' when d <= 1 then 'near' else 'off_scale' end as match from r where k = 1""")
def length_nearest(s, d):
    return G.nearest_number(table(s, d, "part"), "p_size", [4, 8, 12, 16, 24, 32, 48], 1.0).select("p_partkey", "nearest", "distance", "match")


@query(f"""
    with p as (select p_partkey, {_COLOUR.format("p_name")} as a, {_COLOUR.format("p_type")} as b from part), l as (select p_partkey, {_luminance("a")} as x, {_luminance("b")} as y from p)
    select p_partkey, round((greatest(x, y) + 0.05) / (least(x, y) + 0.05), 6) as contrast, (greatest(x, y) + 0.05) / (least(x, y) + 0.05) >= 4.5 as readable from l""")
def wcag_contrast(s, d):
    c = S.contrast("a", "b")
    return table(s, d, "part").select("p_partkey", _colour(F.col("p_name")).alias("a"), _colour(F.col("p_type")).alias("b")).select("p_partkey", F.round(c, 6).alias("contrast"), (c >= 4.5).alias("readable"))


@query("""
    with c as (select p_partkey, p_brand, 'brand:' || lower(p_brand) || ';size:' || p_size || ';type:' || lower(p_type) as k from part)
    select sha256(k) as exact_hash, count(*) as n, count(distinct p_brand) as n_files from c group by k having count(*) >= 2""")
def style_duplicate_sets(s, d):
    p = table(s, d, "part").select(F.col("p_brand").alias("file_path"), F.create_map(F.lit("Type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"), F.lit("size "), F.col("p_size").cast("string")).alias("declarations"))
    return G.duplicate_styles(p)


@query("""
    with m as (select p_type, min(p_partkey) as k from part group by p_type)
    select x.p_partkey, round(((x.p_brand = y.p_brand)::int + (x.p_size = y.p_size)::int + 1) / 3, 6) as similarity,
           concat_ws(',', case when x.p_brand <> y.p_brand then 'brand' end, case when x.p_size <> y.p_size then 'size' end) as differs from part x join m using (p_type) join part y on y.p_partkey = m.k""")
def style_similarity(s, d):
    m = F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    p = table(s, d, "part").select("p_partkey", "p_type", m.alias("a"))
    first = p.groupBy("p_type").agg(F.min_by("a", "p_partkey").alias("b"))
    return p.join(first, "p_type").select("p_partkey", F.round(G.style_similarity("a", "b"), 6).alias("similarity"), F.array_join(G.style_diff("a", "b"), ",").alias("differs"))


@query("""
    with c as (select p_brand, p_size, count(*) as k from part group by all), g as (select p_brand, sum(k)::bigint as n, count(*) as n_styles, max(k) as top from c group by p_brand)
    select p_brand, n, n_styles, round(top / n, 6) as top_share from g where n >= 2 and n_styles > 1 and top / n < 0.6""")
def focus_consistency(s, d):
    return G.focus_consistency(table(s, d, "part"), "p_brand", "p_size")


@query(r"""
    with c as (select doc_id, unnest(regexp_extract_all(text, '#[0-9a-fA-F]{6}\b|`--[a-z-]+`', 0)) as v from documents)
    select v, count(*) as n, count(distinct doc_id) as n_docs from c group by v""")
def css_token_usage(s, d):
    return table(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"#[0-9a-fA-F]{6}\b|`--[a-z-]+`"), F.lit(0))).alias("v")).groupBy("v").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query(r"""
    with p as (select p_partkey, '#' || lower(replace(p_brand, '#', '')) || ' .' || replace(p_type, ' ', ' > .') || case when p_size % 2 = 0 then ' a:hover' else ' li' end as selector from part)
    select p_partkey, (100 * len(regexp_extract_all(selector, '#[\w-]+')) + 10 * len(regexp_extract_all(selector, '\.[\w-]+|\[[^\]]*\]|:[\w-]+')) + len(regexp_extract_all(selector, '(?:^|[\s>+~])[a-zA-Z][\w-]*')))::int as specificity from p""")
def css_specificity(s, d):
    sel = F.concat(F.lit("#"), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit(" ."), F.regexp_replace("p_type", " ", " > ."), F.when(F.col("p_size") % 2 == 0, " a:hover").otherwise(" li"))
    return table(s, d, "part").select("p_partkey", S.specificity(sel).alias("specificity"))


def _parts(e: str, rx: str) -> str:
    return f"abs(len(regexp_extract_all(x.content, '{rx}')) - len(regexp_extract_all(y.content, '{rx}'))) / greatest(len(regexp_extract_all(x.content, '{rx}')), len(regexp_extract_all(y.content, '{rx}')), 1)"


@query(rf"""
    with e as {_E}
    select a.analysis_id, round(0.3 * {_parts('', r'\b(?:def|class|function|func)\b')} + 0.3 * {_parts('', r'\b(?:if|for|while|switch)\b')} + 0.2 * {_parts('', r'\b(?:try|except|catch|raise|throw)\b')} + 0.2 * {_parts('', r'(?m)^\s*(?:#|//|\*)')}, 6) as drift
    from {_A} a join e x on x.entity_id = a.source_id join e y on y.entity_id = a.candidate_id""")
def drift_scores(s, d):
    e = _entities(s, d).select("entity_id", "content")
    a = _analyses(s, d).select("analysis_id", "source_id", "candidate_id")
    j = a.join(e.toDF("source_id", "x"), "source_id").join(e.toDF("candidate_id", "y"), "candidate_id")
    return j.select("analysis_id", F.round(G.drift_score("x", "y"), 6).alias("drift"))


@query("""
    select x.vec_id as a, y.vec_id as b, round(list_cosine_similarity(x.embedding::double[], y.embedding::double[]), 5) as similarity from embeddings x join embeddings y on x.label = y.label and x.vec_id < y.vec_id
    where list_cosine_similarity(x.embedding::double[], y.embedding::double[]) >= 0.3""")
def pair_similarity(s, d):
    return G.pairwise_within(table(s, d, "embeddings"), "label", "vec_id", "embedding", 0.3).withColumn("similarity", F.round("similarity", 5))


@query("""
    with recursive p as (select x.vec_id as a, y.vec_id as b from embeddings x join embeddings y on x.label = y.label and x.vec_id < y.vec_id where list_cosine_similarity(x.embedding::double[], y.embedding::double[]) >= 0.35),
    s as (select a, b from p union select b, a from p), h as (select a as id, a as c from s union select h.id, s.b from h join s on s.a = h.c)
    select id, min(c) as component from h group by id""")
def dbscan_components(s, d):
    return connected_components(G.pairwise_within(table(s, d, "embeddings"), "label", "vec_id", "embedding", 0.35))
