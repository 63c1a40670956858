"""Change sets, baselines and diff scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import changes as C, dedup as D
from ..session import table
from .graph import _E, _P, _entities, _files
from .registry import query
from .stats import _A, _analyses

_FINDINGS = f"(select unnest(drift_indicators) as rule_id, source_file as file_path, source_id as line, analyzed_at as seen, coalesce(is_significant, false) = false as suppressed from {_A})"
_HASH = "substring(sha256(concat_ws(':', rule_id, file_path, line::varchar)), 1, 16)"


def _between(df, ts, tenths):
    """The moment at so many tenths of the way from the first to the last."""
    a, b = (F.unix_micros(f(ts)) for f in (F.min, F.max))
    return df.agg(F.timestamp_micros(F.floor((a * (10 - tenths) + b * tenths).cast("decimal(38,0)") / 10).cast("bigint")).alias("m")).first()["m"]


def _findings(s, d):
    a = _analyses(s, d)
    return a.select(F.explode("drift_indicators").alias("rule_id"), F.col("source_file").alias("file_path"), F.col("source_id").alias("line"), F.col("analyzed_at").alias("seen"), (F.coalesce("is_significant", F.lit(False)) == F.lit(False)).alias("suppressed"))


@query(f"""
    with b as (select entity_id, content_hash as old from {_E}),
    c as (select entity_id, substring(sha256(content), 1, 16) as new from {_E})
    select entity_id, case when old is not distinct from new then 'unchanged' else 'modified' end as status from b join c using (entity_id)""")
def content_hash_check(s, d):
    e = _entities(s, d)
    return C.classify_changes(e.select("entity_id", F.col("content_hash").alias("h")), e.select("entity_id", F.substring(F.sha2("content", 256), 1, 16).alias("h")), "entity_id", "h")


@query(f"""
    with o as (select file_id, file_hash as v from {_P} where indexed_at < (select make_timestamp((epoch_us(min(indexed_at)) * 3 + epoch_us(max(indexed_at)) * 7) // 10) from {_P})), n as (select file_id, case when file_id % 3 = 0 then upper(file_hash) else file_hash end as v from {_P} where indexed_at >= (select make_timestamp((epoch_us(min(indexed_at)) * 8 + epoch_us(max(indexed_at)) * 2) // 10) from {_P}))
    select coalesce(o.file_id, n.file_id) as file_id, case when o.file_id is null then 'added' when n.file_id is null then 'deleted' when o.v is not distinct from n.v then 'unchanged' else 'modified' end as status from o full join n using (file_id)""")
def change_classification(s, d):
    p = _files(s, d)
    old = p.where(F.col("indexed_at") < F.lit(_between(p, "indexed_at", 7))).select("file_id", F.col("file_hash").alias("v"))
    new = p.where(F.col("indexed_at") >= F.lit(_between(p, "indexed_at", 2))).select("file_id", F.when(F.col("file_id") % 3 == 0, F.upper("file_hash")).otherwise(F.col("file_hash")).alias("v"))
    return C.classify_changes(old, new, "file_id", "v")


@query(f"""
    with a as (select distinct file_path from {_P}), b as (select distinct file_path from chunks)
    select coalesce(a.file_path, b.file_path) as file_path, case when b.file_path is null then 'only_a' when a.file_path is null then 'only_b' else 'both' end as side from a full join b using (file_path)""")
def reconcile_paths(s, d):
    return C.reconcile(_files(s, d), table(s, d, "chunks"), "file_path")


@query("""select doc_id, sha256(text) in (select sha256(text) from documents where source = 'wiki_mirror') as known from documents where source <> 'wiki_mirror'""")
def content_hash_dedup(s, d):
    docs = table(s, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    new, known = D.split_known(docs.where("source <> 'wiki_mirror'"), docs.where("source = 'wiki_mirror'"), "h")
    return new.select("doc_id", F.lit(False).alias("known")).unionByName(known.select("doc_id", F.lit(True).alias("known")))


@query(f"""
    with f as (select {_HASH} as hash, * from {_FINDINGS}), c as (select make_timestamp((epoch_us(min(seen)) * 5 + epoch_us(max(seen)) * 5) // 10) as m from f), b as (select distinct hash from f, c where seen < m)
    select hash, count(*) as n, (hash not in (select hash from b)) as is_new from f, c where seen >= m group by hash""")
def baseline_split(s, d):
    f = _findings(s, d).withColumn("hash", C.finding_hash("rule_id", "file_path", "line"))
    m = _between(f, "seen", 5)
    return C.split_baseline(f.where(F.col("seen") >= F.lit(m)), f.where(F.col("seen") < F.lit(m))).groupBy("hash", "is_new").agg(F.count("*").alias("n"))


@query(f"""
    with f as (select {_HASH} as hash, * from {_FINDINGS}), c as (select make_timestamp((epoch_us(min(seen)) * 5 + epoch_us(max(seen)) * 5) // 10) as m from f),
    b as (select hash, min(seen) as first_seen, max(seen) as last_seen, bool_or(suppressed) as suppressed from f, c where seen < m group by hash), n as (select hash, min(seen) as f, max(seen) as l from f, c where seen >= m group by hash)
    select coalesce(b.hash, n.hash) as hash, strftime(coalesce(first_seen, f), '%Y-%m-%d %H:%M:%S') as first_seen, strftime(coalesce(greatest(last_seen, l), last_seen, l), '%Y-%m-%d %H:%M:%S') as last_seen, coalesce(suppressed, false) as suppressed from b full join n on b.hash = n.hash""")
def baseline_merge(s, d):
    f = _findings(s, d).withColumn("hash", C.finding_hash("rule_id", "file_path", "line"))
    m = _between(f, "seen", 5)
    base = f.where(F.col("seen") < F.lit(m)).groupBy("hash").agg(F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.max("suppressed").alias("suppressed"))
    out = C.merge_baseline(base, f.where(F.col("seen") >= F.lit(m)))
    return out.select("hash", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "last_seen")), "suppressed")


@query(f"""
    with f as (select * from {_FINDINGS} where not suppressed), c as (select rule_id, count(*) as n from f group by rule_id),
    p as (select rule_id, place, row_number() over (partition by rule_id order by place) as k from (select distinct rule_id, concat_ws(':', file_path, line::varchar) as place from f))
    select rule_id, n, (select string_agg(place, ', ' order by place) from p where p.rule_id = c.rule_id and k <= 3) as samples, greatest(1, least(5, 5 - round_even(log10(n), 0)::int)) as priority from c""")
def cleanup_map(s, d):
    return C.cleanup_map(_findings(s, d))


@query(f"""
    with f as (select entity_id, file_id::varchar as file_path, start_line as line from {_E}), r as (select file_id::varchar as file_path, start_line - 2 as s, coalesce(end_line, start_line) as e from {_E} where entity_id % 7 = 0)
    select entity_id, file_path is null or exists (select 1 from r where r.file_path = f.file_path and f.line between s and e) as in_scope from f""")
def diff_range_join(s, d):
    e = _entities(s, d)
    f = e.select("entity_id", F.col("file_id").cast("string").alias("file_path"), F.col("start_line").alias("line"))
    r = e.where("entity_id % 7 = 0").select(F.col("file_id").cast("string").alias("file_path"), (F.col("start_line") - 2).alias("start"), F.coalesce("end_line", "start_line").alias("end"))
    return C.in_diff_scope(f, r).select("entity_id", "in_scope")


@query(f"""
    with n as (select file_id, file_path, content_hash, name from {_E}), o as (select * from n where file_id % 2 = 0)
    select file_id, name, count(*) as n from n where not exists (select 1 from o where o.file_id = n.file_id and o.name = n.name) group by all""")
def entity_replacement(s, d):
    e = _entities(s, d).select("file_id", "name")
    return e.join(e.where("file_id % 2 = 0").distinct(), ["file_id", "name"], "left_anti").groupBy("file_id", "name").agg(F.count("*").alias("n"))


@query(f"""
    with r as (select * from (values ('src/core/', 'core/'), ('lib/', 'library/'), ('tools/', 'scripts/')) t(a, b))
    select p.file_id, case when r.a is null then p.path else r.b || substring(p.path, length(r.a) + 1) end as file_path from (select file_id, regexp_replace(file_path, '^\\./', '') as path from {_P}) p left join r on starts_with(p.path, r.a)""")
def rename_paths(s, d):
    path = X.clean_path("file_path")
    new = path
    for a, b in (("src/core/", "core/"), ("lib/", "library/"), ("tools/", "scripts/")):
        new = F.when(path.startswith(a), F.concat(F.lit(b), F.substring(path, F.lit(len(a) + 1), F.length(path)))).otherwise(new)
    return _files(s, d).select("file_id", new.alias("file_path"))
