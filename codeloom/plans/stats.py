"""Statistics over entities, chunks, files, drift analyses and events."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as X
from ..operators import stats as T
from ..session import latest, table
from .graph import _E, _P, _R, _edges, _entities, _files
from .registry import query

_A = "(select * from drift_analyses qualify row_number() over (partition by analysis_id order by analyzed_at) = 1)"
_EXTENSION = r"lower(regexp_extract(string_split(file_path, '/')[-1], '(\.[^.]+)$', 1))"


def _analyses(s, d):
    return latest(table(s, d, "drift_analyses"), "analysis_id")


@query("""select chunk_type, count(*) as n, round(avg(length(content)), 6) as avg_len, min(length(content))::int as min_len, max(length(content))::int as max_len from chunks group by chunk_type""")
def chunk_length_stats(s, d):
    n = F.length("content")
    return table(s, d, "chunks").groupBy("chunk_type").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("avg_len"), F.min(n).alias("min_len"), F.max(n).alias("max_len"))


@query(f"""select lower(trim(e.entity_type)) as entity_type, c.chunk_type, count(*) as n from chunks c join {_E} e using (entity_id) group by cube (1, 2)""")
def chunk_entity_cube(s, d):
    e = _entities(s, d).select("entity_id", F.lower(F.trim("entity_type")).alias("entity_type"))
    return table(s, d, "chunks").join(e, "entity_id").cube("entity_type", "chunk_type").agg(F.count("*").alias("n"))


@query(f"""
    with e as (select lower(trim(entity_type)) as t, {_EXTENSION} as x, docstring is null as u, repo from {_E})
    select 'entity_type' as dimension, t as value, count(*) as n from e group by t union all select 'extension', x, count(*) from e group by x
    union all select 'undocumented', u::varchar, count(*) from e group by u union all select 'repo', repo, count(*) from e group by repo""")
def collection_stats(s, d):
    return T.by_each(_entities(s, d), {"entity_type": F.lower(F.trim("entity_type")), "extension": X.extension("file_path"), "undocumented": F.col("docstring").isNull(), "repo": F.col("repo")})


@query(f"""
    with t as (select file_id, lower(trim(entity_type)) as t, count(*) as n from {_E} group by all),
    r as (select *, row_number() over (partition by file_id order by n desc, t) as k from t)
    select file_id, sum(n)::bigint as n_entities, max(t) filter (k = 1) as top_type from r group by file_id having sum(n) > 5""")
def file_bloat(s, d):
    e = _entities(s, d).groupBy("file_id", F.lower(F.trim("entity_type")).alias("t")).agg(F.count("*").alias("k"))
    return e.groupBy("file_id").agg(F.sum("k").alias("n_entities"), F.min_by("t", F.struct(-F.col("k"), "t")).alias("top_type")).where("n_entities > 5")


@query(f"""
    select repo, count(*) as n, count(distinct name) as n_names, sum((length(trim(coalesce(content, ''))) = 0)::int)::bigint as n_empty, sum(coalesce(regexp_matches(lower(name), '^(main|init|run|test|get|set|handle|process|data|tmp)$'), false)::int)::bigint as n_generic from {_E} group by repo""")
def content_quality(s, d):
    return _entities(s, d).groupBy("repo").agg(
        F.count("*").alias("n"), F.countDistinct("name").alias("n_names"), F.sum((F.length(F.trim(F.coalesce("content", F.lit("")))) == 0).cast("bigint")).alias("n_empty"),
        F.sum(F.coalesce(F.lower("name").rlike("^(main|init|run|test|get|set|handle|process|data|tmp)$"), F.lit(False)).cast("bigint")).alias("n_generic"),
    )


@query(f"select substring(content, 1, 100) as prefix, count(*) as n from {_E} where length(content) > 20 group by 1 having count(*) > 1")
def duplicate_prefixes(s, d):
    return _entities(s, d).where(F.length("content") > 20).groupBy(F.substring("content", 1, 100).alias("prefix")).agg(F.count("*").alias("n")).where("n > 1")


@query(f"select sha256(content) as hash, count(*) as n, min(entity_id) as first_key from {_E} where content is not null group by 1 having count(*) >= 2")
def exact_duplicate_groups(s, d):
    from ..operators.dedup import exact_groups

    return exact_groups(_entities(s, d), "entity_id", F.col("content"))


@query(f"""
    with t as (select case when length(content) > 20000 then 'light' when regexp_matches(file_path, '(^|/)(gen|generated|dist|vendor|node_modules)/|[.]min[.]') then 'light'
      when length(content) < 5000 and regexp_matches(file_path, '(^|/)(core|models|api)/') then 'deep' else 'standard' end as tier from {_P} where content is not null)
    select x.tier, count(t.tier) as n from (values ('light'), ('standard'), ('deep')) x(tier) left join t on t.tier = x.tier group by x.tier""")
def tier_statistics(s, d):
    size, path = F.length("content"), F.col("file_path")
    tier = F.when(size > 20000, "light").when(path.rlike(r"(^|/)(gen|generated|dist|vendor|node_modules)/|[.]min[.]"), "light").when((size < 5000) & path.rlike("(^|/)(core|models|api)/"), "deep").otherwise("standard")
    n = _files(s, d).where("content is not null").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))
    return s.createDataFrame([("light",), ("standard",), ("deep",)], "tier string").join(n, "tier", "left").select("tier", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


@query("""
    with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null)
    select event_type, min(value) filter (i = least(floor(n * 0.5), n - 1)) as p50, min(value) filter (i = least(floor(n * 0.95), n - 1)) as p95, min(value) filter (i = least(floor(n * 0.99), n - 1)) as p99 from r group by event_type""")
def pctl_floor_index(s, d):
    return T.percentile_by_rank(table(s, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("""select event_type, count(value) as n, round(avg(value), 6) as mean, min(value) as low, max(value) as high, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by event_type""")
def pctl_interpolated(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query(f"""
    with r as (select analysis_id, row_number() over (order by drift_score desc nulls last, analysis_id) - 1 as i, count(*) over () as n from {_A})
    select analysis_id, case when i * 5 < n then 1 when i * 5 < n * 2 then 2 when i * 5 < n * 3 then 3 when i * 5 < n * 4 then 4 else 5 end as priority from r""")
def priority_quintiles(s, d):
    a = _analyses(s, d).select("analysis_id", F.coalesce(-F.col("drift_score"), F.lit(float("inf"))).alias("o"))
    return T.quintiles(a, ["o", "analysis_id"]).select("analysis_id", "priority")


@query(f"""select source_file, analysis_id, rank::int as rank from (select source_file, analysis_id, row_number() over (partition by source_file order by drift_score desc nulls last, analysis_id) as rank from {_A} where source_file is not null) where rank <= 3""")
def cap_per_scope(s, d):
    w = Window.partitionBy("source_file").orderBy(F.desc_nulls_last("drift_score"), "analysis_id")
    return _analyses(s, d).where("source_file is not null").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("source_file", "analysis_id", "rank")


@query("""
    with l as (select user_id, event_id, event_type, value, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events)
    select user_id, event_type, event_id, value from l where k = 1""")
def last_wins_dedup(s, d):
    from ..operators.dedup import last_wins

    return last_wins(table(s, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query(f"""
    with c as (select repo as role, 'lang' as prop, lower(lang) as value, count(*) as n from {_P} group by all),
    w as (select *, sum(n) over (partition by role, prop) as total, max(n) over (partition by role, prop) as most, first_value(value) over (partition by role, prop order by n desc, value nulls first) as mode from c)
    select role, prop, value, n, mode, round(n / total, 6) as share from w where most >= 0.5 * total and value is distinct from mode and n <= 0.2 * total""")
def role_outlier_mode(s, d):
    f = _files(s, d).select(F.col("repo").alias("role"), F.lit("lang").alias("prop"), F.lower("lang").alias("value"))
    return T.mode_outliers(f, "role", "prop", "value")


@query(f"""
    with c as (select repo as role, relation_type as value, count(*) as n from {_R} group by all),
    w as (select *, sum(n) over (partition by role) as total, count(*) over (partition by role) as kinds, max(n) over (partition by role) as most from c)
    select role, value, n, round(abs(n - total / kinds) / (sqrt(total / kinds) + 1), 6) as z from w
    where total >= 3 and kinds >= 2 and round(abs(n - total / kinds) / (sqrt(total / kinds) + 1), 6) > 2 and n < 0.25 * most""")
def role_outlier_frequency(s, d):
    return T.frequency_outliers(_edges(s, d).select(F.col("repo").alias("role"), F.col("relation_type").alias("value")), "role", "value")


@query("""
    with m as (select user_id, arg_min(value, (ts, value)) as first, arg_max(value, (ts, value)) as last from events where ts is not null group by user_id)
    select user_id, first, last, round(case when first = 0 then 0 else (first - last) / first * 100 end, 6) as reduction from m""")
def metric_reduction(s, d):
    return T.first_to_last(table(s, d, "events"), ["user_id"], "ts", "value")


@query("""
    with m as (select max(ts) as t from events)
    select event_type, strftime(ts, '%Y-%m-%d') as day, count(*) as n, round(sum(value), 4) as total from events, m where ts > t - interval 30 day group by 1, 2""")
def trend_30d(s, d):
    e = table(s, d, "events")
    # the end is one row
    return e.join(F.broadcast(e.agg(F.max("ts").alias("_end"))), F.col("ts") > F.col("_end") - F.expr("interval 30 days")).groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""
    with s as (select analysis_id, case when similarity_score > 1 then similarity_score / 100 else similarity_score end as s, drift_score, is_significant from {_A})
    select case when s >= 0.95 then 'duplicate' when s >= 0.8 then 'near' when s >= 0.6 then 'similar' when s is null then 'unknown' else 'distinct' end as band, count(*) as n, round(avg(s), 6) as avg_similarity, sum(coalesce(is_significant, false)::int)::bigint as n_significant from s group by 1""")
def similarity_bands(s, d):
    a = _analyses(s, d).withColumn("s", F.when(F.col("similarity_score") > 1, F.col("similarity_score") / 100).otherwise(F.col("similarity_score")))
    band = F.when(F.col("s") >= 0.95, "duplicate").when(F.col("s") >= 0.8, "near").when(F.col("s") >= 0.6, "similar").when(F.col("s").isNull(), "unknown").otherwise("distinct")
    return a.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("avg_similarity"), F.sum(F.coalesce("is_significant", F.lit(False)).cast("bigint")).alias("n_significant"))


@query("""
    with o as (select c_mktsegment as category, o_orderpriority as severity from orders join customer on c_custkey = o_custkey)
    select category, count(*) filter (severity = '1-URGENT') as urgent, count(*) filter (severity = '2-HIGH') as high, count(*) as n from o group by category""")
def findings_by_severity(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("category"))
    return o.agg(F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).alias("urgent"), F.count(F.when(F.col("o_orderpriority") == "2-HIGH", 1)).alias("high"), F.count("*").alias("n"))


@query(f"""select repo, count(*) as n, round(sum(parsing_time), 4) as total, round(avg(parsing_time), 6) as mean, round(count(parsing_time) / count(*), 6) as measured from {_P} group by repo""")
def timing_aggregate(s, d):
    return _files(s, d).groupBy("repo").agg(F.count("*").alias("n"), F.round(F.sum("parsing_time"), 4).alias("total"), F.round(F.avg("parsing_time"), 6).alias("mean"), F.round(F.count("parsing_time") / F.count("*"), 6).alias("measured"))


@query(f"""
    with r as (select repo, count(*) as n_files, sum((errors is not null and len(errors) > 0)::int) as n_bad from {_P} group by repo)
    select repo, n_files, case when n_files = 0 then 'empty' when 1 - n_bad / n_files >= 0.98 then 'healthy' when 1 - n_bad / n_files >= 0.9 then 'indexing' else 'degraded' end as status from r""")
def collection_health(s, d):
    r = _files(s, d).groupBy("repo").agg(F.count("*").alias("n_files"), F.sum((F.coalesce(F.size("errors"), F.lit(0)) > 0).cast("int")).alias("b"))
    ok = 1 - F.col("b") / F.col("n_files")
    return r.select("repo", "n_files", F.when(ok >= 0.98, "healthy").when(ok >= 0.9, "indexing").otherwise("degraded").alias("status"))


@query("""select id, count(*) as n from chunks group by id having count(*) > 1""")
def id_collisions(s, d):
    return table(s, d, "chunks").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


@query(f"""select r_name, n_name, count(*) as n, round(sum(c_acctbal), 2) as total from region join nation on r_regionkey = n_regionkey join customer on c_nationkey = n_nationkey group by rollup (r_name, n_name)""")
def database_overview(s, d):
    j = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
