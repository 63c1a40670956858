"""Report queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import style as S
from ..operators import reports as R
from ..session import table
from .changes import _FINDINGS, _findings
from .graph import _E, _P, _R, _edges, _entities, _files
from .registry import query
from .styles import _COLOUR, _colour, _luminance


@query(f"select rule_id, count(*) as n, sum(suppressed::int)::bigint as n_suppressed, round(avg(suppressed::int), 6) as rate from {_FINDINGS} group by rule_id")
def suppression_rates(s, d):
    return R.suppression_rate(_findings(s, d), "rule_id")


@query()
def repair_sessions(s, d):
    return R.session_ids(_findings(s, d), "rule_id")


@query(f"""
    select (select count(*) from {_P}) as n_files, (select count(*) from {_E}) as n_entities, (select count(*) from {_R}) as n_relations, (select count(*) from chunks) as n_chunks, (select count(*) from documents) as n_documents, (select count(distinct repo) from {_P}) as n_repos""")
def summary_dashboard(s, d):
    n = lambda df, name: df.agg(F.count("*").alias(name))
    rows = [_files(s, d).agg(F.count("*").alias("n_files"), F.countDistinct("repo").alias("n_repos")), n(_entities(s, d), "n_entities"), n(_edges(s, d), "n_relations"), n(table(s, d, "chunks"), "n_chunks"), n(table(s, d, "documents"), "n_documents")]
    # each is one row
    return reduce(lambda a, b: a.join(F.broadcast(b)), rows).select("n_files", "n_entities", "n_relations", "n_chunks", "n_documents", "n_repos")


@query(f"""
    with m as (select repo as key, count(*) as n_files, max(length(content)) as longest, count(*) filter (lang is null) as n_unknown from {_P} where repo is not null group by repo)
    select key, 'n_files' as metric, n_files::double as value, 'WARN' as severity from m where n_files > 5 union all select key, 'longest', longest::double, 'FAIL' from m where longest > 15000 union all select key, 'n_unknown', n_unknown::double, 'INFO' from m where n_unknown > 0""")
def metric_findings(s, d):
    m = _files(s, d).where("repo is not null").groupBy(F.col("repo").alias("key")).agg(F.count("*").alias("n_files"), F.max(F.length("content")).alias("longest"), F.count(F.when(F.col("lang").isNull(), 1)).alias("n_unknown"))
    return R.threshold_findings(m, {"n_files": (5, "WARN"), "longest": (15000, "FAIL"), "n_unknown": (0, "INFO")})


@query(f"""
    with p as (select p_brand, {_COLOUR.format("p_name")} as a, {_COLOUR.format("p_type")} as b from part), l as (select p_brand, {_luminance("a")} as x, {_luminance("b")} as y from p)
    select p_brand, count(*) as n, count(*) filter ((greatest(x, y) + 0.05) / (least(x, y) + 0.05) >= 4.5) as n_pass, round(count(*) filter ((greatest(x, y) + 0.05) / (least(x, y) + 0.05) >= 4.5) / count(*), 6) as rate from l group by p_brand""")
def contrast_metrics(s, d):
    ok = S.contrast("a", "b") >= 4.5
    p = table(s, d, "part").select("p_brand", _colour(F.col("p_name")).alias("a"), _colour(F.col("p_type")).alias("b"))
    return p.groupBy("p_brand").agg(F.count("*").alias("n"), F.count(F.when(ok, 1)).alias("n_pass"), F.round(F.count(F.when(ok, 1)) / F.count("*"), 6).alias("rate"))


@query(f"""select entity_id, name, repo, lower(trim(entity_type)) as kind from {_E}""")
def payload_round_trip(s, d):
    e = _entities(s, d).withColumn("kind", F.lower(F.trim("entity_type")))
    p = R.payload(e, "entity_id", ["name"], {"metadata": ["repo", "kind"]})
    g = lambda x: F.get_json_object("payload", x)
    return p.select("entity_id", g("$.name").alias("name"), g("$.metadata.repo").alias("repo"), g("$.metadata.kind").alias("kind"))


@query(f"""
    with f as (select file_id, lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) as ext from {_P}),
    m as (select * from (values ('py', 'python'), ('js', 'javascript'), ('ts', 'typescript'), ('go', 'go')) t(ext, lang))
    select f.file_id, m.lang, count(e.entity_id) as n_ranges from f join m using (ext) left join (select * from {_E} where entity_id % 7 = 0) e on e.file_id = f.file_id group by all""")
def changed_file_languages(s, d):
    lang = F.element_at(F.create_map(*(F.lit(x) for p in (("py", "python"), ("js", "javascript"), ("ts", "typescript"), ("go", "go")) for x in p)), F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1)))
    f = _files(s, d).select("file_id", lang.alias("lang")).where("lang is not null")
    n = _entities(s, d).where("entity_id % 7 = 0").groupBy("file_id").agg(F.count("*").alias("n"))
    return f.join(n, "file_id", "left").select("file_id", "lang", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_ranges"))


@query()
def large_section_split(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(R.split_large("text", 1000)).alias("piece", "t")).select("doc_id", "piece", F.length("t").alias("n_chars"))


@query(f"""
    with c as (select repo, sha256(content) as h, count(*) as n from {_E} where content is not null group by all), t as (select sum(n) as all_n from c)
    select repo, count(*) as n_distinct, sum(n)::bigint as n, round(1 - count(*) / sum(n), 6) as redundancy from c group by repo""")
def redundancy_by_repo(s, d):
    c = _entities(s, d).where("content is not null").groupBy("repo", F.sha2("content", 256).alias("h")).agg(F.count("*").alias("k"))
    return c.groupBy("repo").agg(F.count("*").alias("n_distinct"), F.sum("k").alias("n"), F.round(1 - F.count("*") / F.sum("k"), 6).alias("redundancy"))
