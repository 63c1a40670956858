"""Store, planning and metric queries."""

from __future__ import annotations

import random

from pyspark.sql import Window, functions as F

from ..functions import text as X
from ..operators import design as G, store as P
from ..session import table
from ..sources import files as Fi, sinks as Si
from .graph import _E, _P, _R, _edges, _entities, _files
from .registry import query
from .search import _TOKENS
from .stats import _A, _analyses


@query(f"select entity_id, name from {_E} where repo = 'lantern-core' and lower(trim(entity_type)) = 'method'")
def equality_filter(s, d):
    e = _entities(s, d).withColumn("entity_type", F.lower(F.trim("entity_type")))
    return e.where(P.equals({"repo": "lantern-core", "entity_type": "method", "ignored": ["x"]})).select("entity_id", "name")


@query("select file_path, chunk_type, count(*) as n, min(id) as first_id from chunks where chunk_type in ('metadata', 'implementation') group by all")
def chunks_by_file_and_type(s, d):
    return table(s, d, "chunks").where(F.col("chunk_type").isin("metadata", "implementation")).groupBy("file_path", "chunk_type").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"""
    with p as (select file_id, regexp_replace(file_path, '^\\./', '') as path from {_P})
    select file_id, case when regexp_matches(path, '(?:^|/)tests/') and not regexp_matches(path, '[.]go(?:$|/)') then true when regexp_matches(path, '(?:^|/)[^/]*[.]min[.]js(?:$|/)') then true when regexp_matches(path, '^src/.*/[^/]*[.]ts(?:$|/)|^src/[^/]*[.]ts$') then true else false end as is_ignored from p""")
def ignore_match(s, d):
    p = _files(s, d).select("file_id", X.clean_path("file_path").alias("path"))
    return Fi.ignored(p, ["tests/", "!*.go", "*.min.js", "src/**/*.ts"]).select("file_id", "is_ignored")


@query(rf"""
    with l as (select entity_id, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) > 0) as ls from {_E} where content is not null)
    select entity_id, case when len(ls) = 0 then 'empty' when len(list_filter(ls, lambda x: not regexp_matches(x, '^(import |from \S+ import |const \w+ = require|export \* from)'))) = 0 then 'imports' when len(list_filter(ls, lambda x: not regexp_matches(x, '^(#|//|/\*|\*)'))) = 0 then 'comments'
      when len(list_filter(ls, lambda x: not regexp_matches(x, '^@\w'))) = 0 then 'decorators' when len(list_filter(ls, lambda x: regexp_matches(x, '^(export )?(async )?(def|class|func|function|interface|type) '))) > 0 then 'definitions' else 'other' end as kind from l""")
def trivial_code(s, d):
    return _entities(s, d).where("content is not null").select("entity_id", P.trivial_kind("content").alias("kind"))


@query(rf"""
    with p as (select entity_id, file_id, lower(trim(entity_type)) as kind, name, regexp_extract(content, '\(([^()]*)\)', 1) as ps from {_E} where lower(trim(entity_type)) in ('function', 'method')),
    k as (select entity_id, file_id, substring(sha256(concat_ws('|', kind, lower(name), (case when trim(ps, ' ') = '' then 0 else len(string_split(ps, ',')) end)::varchar)), 1, 16) as signature from p)
    select signature, count(*) as n, count(distinct file_id) as n_files, min(entity_id) as first_entity from k group by signature having count(*) > 1""")
def signature_duplicates(s, d):
    k = _entities(s, d).where("lower(trim(entity_type)) in ('function', 'method')").select("entity_id", "file_id", P.signature_key(F.lower(F.trim("entity_type")), "name", "content").alias("signature"))
    return k.groupBy("signature").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("n_files"), F.min("entity_id").alias("first_entity")).where("n > 1")


@query(f"""
    with p as (select file_id, regexp_replace(file_path, '^\\./', '') as path from {_P})
    select file_id, case when starts_with(path, 'src/core/') then 'core' when starts_with(path, 'tests/') then 'tests' when starts_with(path, 'src/') then 'source' when starts_with(path, 'app/') then 'app' else 'workspace' end as collection from p""")
def prefix_member_join(s, d):
    p = _files(s, d).select("file_id", X.clean_path("file_path").alias("path"))
    return p.select("file_id", P.first_prefix(p, "path", [("src", "source"), ("src/core", "core"), ("app", "app"), ("tests", "tests")], "workspace").alias("collection"))


@query(f"""
    with a as (select analysis_id, case when similarity_score > 1 then similarity_score / 100 else similarity_score end as s, source_file = candidate_file as same from {_A})
    select case when coalesce(same, false) then 'pass' when s >= 0.95 then 'block' when s >= 0.85 then 'warn' when s >= 0.55 then 'look' else 'pass' end as verdict, count(*) as n from a group by 1""")
def duplicate_probe(s, d):
    a = _analyses(s, d).withColumn("s", F.when(F.col("similarity_score") > 1, F.col("similarity_score") / 100).otherwise(F.col("similarity_score")))
    same = F.coalesce(F.col("source_file") == F.col("candidate_file"), F.lit(False))
    return a.groupBy(P.duplicate_verdict("s", same).alias("verdict")).agg(F.count("*").alias("n"))


@query("""
    select count(*) as n, sum(length(content))::bigint as total from (select id, content, sum(length(content)) over (order by ts desc, id) as x from (select id, content, ts from chunks c join (select entity_id, max(ingested_at) as ts from entities group by entity_id) e using (entity_id))) where x <= 100000""")
def lru_eviction(s, d):
    e = table(s, d, "entities").groupBy("entity_id").agg(F.max("ingested_at").alias("ts"))
    c = table(s, d, "chunks").join(e, "entity_id").select("id", "ts", F.length("content").cast("bigint").alias("size"))
    return P.evict_oldest(c, "ts", "size", 100_000, "id").agg(F.count("*").alias("n"), F.sum("size").alias("total"))


@query(f"""select analysis_id, round(greatest(0, drift_score / (1 + coalesce(len(drift_indicators), 0) * 0.5) - (is_significant is true)::int * 0.1), 6) as priority from {_A} where drift_score is not null""")
def task_priority(s, d):
    a = _analyses(s, d).where("drift_score is not null").withColumn("effort", F.coalesce(F.size("drift_indicators"), F.lit(0))).withColumn("deps", F.coalesce(F.col("is_significant"), F.lit(False)).cast("int"))
    return a.select("analysis_id", F.round(P.priority("drift_score", "effort", "deps"), 6).alias("priority"))


@query(f"""
    with e as (select distinct to_entity as before, from_entity as after from {_R} where relation_type = 'inherits' and from_entity is not null and to_entity is not null and from_entity <> to_entity),
    v as (select before as id from e union select after from e)
    select count(*) as n from v""")
def dependency_vertices(s, d):
    e = _edges(s, d).where("relation_type = 'inherits' and from_entity <> to_entity")
    return e.select(F.explode(F.array("from_entity", "to_entity")).alias("id")).distinct().agg(F.count("*").alias("n"))


@query()
def dependency_order(s, d):
    e = _edges(s, d).where("relation_type = 'inherits'").select(F.col("to_entity").alias("before"), F.col("from_entity").alias("after"))
    return P.topological_levels(e)


_R42 = random.Random(42)
_MINHASH_A, _MINHASH_B = [_R42.randint(1, 2**32 - 1) for _ in range(128)], [_R42.randint(0, 2**32 - 1) for _ in range(128)]


@query(f"""
    with t as (select doc_id, list_distinct({_TOKENS.format("text")}) as ws from documents),
    h as (select doc_id, list_transform(ws, lambda w: ('0x' || substring(md5(w), 1, 8))::ubigint::hugeint) as hs from t),
    c as (select unnest(range(0, 128))::int as i, unnest({_MINHASH_A})::hugeint as a, unnest({_MINHASH_B})::hugeint as b)
    select doc_id, i, coalesce(list_min(list_transform(hs, lambda x: (a * x + b) % 4294967311)), 0)::bigint as h from h, c""")
def minhash_signatures(s, d):
    return table(s, d, "documents").select("doc_id", X.tokens("text").alias("ws")).transform(lambda t: P.min_hash(t, "doc_id", "ws")).select("doc_id", F.posexplode("signature").alias("i", "h"))


@query(r"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '(?m)^### +(.*)$', '<h3>\1</h3>', 'g'), '(?m)^## +(.*)$', '<h2>\1</h2>', 'g'), '(?m)^# +(.*)$', '<h1>\1</h1>', 'g'),
    '\*\*([^*\n]+)\*\*', '<b>\1</b>', 'g'), '`([^`\n]+)`', '<code>\1</code>', 'g'), '\[([^\]\n]+)\]\(([^)\s]+)\)', '<a href="\2">\1</a>', 'g'), '(?m)^[-*] +(.*)$', '<li>\1</li>', 'g')) as hash from documents""")
def markdown_html(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(P.markdown_to_html("text")).alias("hash"))


@query(f"""
    with p as (select x.vec_id as a, y.vec_id as b, list_cosine_similarity(x.embedding::double[], y.embedding::double[]) as s from embeddings x join embeddings y on x.label = y.label and x.vec_id < y.vec_id where list_cosine_similarity(x.embedding::double[], y.embedding::double[]) >= 0.3),
    b as (select a as id, s from p union all select b, s from p)
    select id, count(*) as n_peers, round(avg(s), 5) as avg_similarity from b group by id""")
def cluster_cohesion(s, d):
    p = G.pairwise_within(table(s, d, "embeddings"), "label", "vec_id", "embedding", 0.3)
    return p.select(F.explode(F.array("a", "b")).alias("id"), "similarity").groupBy("id").agg(F.count("*").alias("n_peers"), F.round(F.avg("similarity"), 5).alias("avg_similarity"))


@query(f"""
    with g as (select sha256(content) as cluster, count(*) as n, count(distinct file_id) as n_files, min(entity_id) as representative from {_E} where content is not null group by 1 having count(distinct file_id) >= 2)
    select cluster, n, n_files, representative, case when n_files >= 5 or n >= 10 then 'high' when n_files >= 3 or n >= 5 then 'medium' else 'low' end as impact, case when n >= 5 then 'extract' when n >= 3 then 'consolidate' else 'review' end as action from g""")
def cross_file_duplicates(s, d):
    e = _entities(s, d).where("content is not null").select("entity_id", "file_id", F.sha2("content", 256).alias("cluster"))
    return G.cluster_summary(e, "entity_id", "cluster", "file_id")


@query("""select p_brand, count(distinct concat_ws('|', p_type, p_size::varchar)) as n_variants, count(*) as n, round(avg((p_size in (4, 8, 12, 16, 24, 32, 48))::int), 6) as adherence from part group by p_brand""")
def role_variants(s, d):
    on = F.col("p_size").isin(4, 8, 12, 16, 24, 32, 48).cast("int")
    return table(s, d, "part").groupBy("p_brand").agg(F.countDistinct(F.concat_ws("|", "p_type", F.col("p_size").cast("string"))).alias("n_variants"), F.count("*").alias("n"), F.round(F.avg(on), 6).alias("adherence"))


@query("""select event_type, count(*) as n, count(*) filter (value >= 10) as n_large, round(count(*) filter (value >= 10) / count(*), 6) as rate, round(avg(value), 4) >= 5 as target_met from events group by event_type""")
def target_rates(s, d):
    big = F.count(F.when(F.col("value") >= 10, 1))
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), big.alias("n_large"), F.round(big / F.count("*"), 6).alias("rate"), (F.round(F.avg("value"), 4) >= 5).alias("target_met"))


@query("""select user_id, event_id, rank::int as rank from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rank from events) where rank <= 20""")
def rolling_last_n(s, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(s, d, "events").withColumn("rank", F.row_number().over(w)).where("rank <= 20").select("user_id", "event_id", "rank")


@query("""with m as (select max(ts) as t from events), e as (select user_id, ts, value from events, m where ts > t - interval 30 day)
    select user_id, round(greatest(0, arg_min(value, (ts, value)) - arg_max(value, (ts, value))), 6) as resolved from e group by user_id having count(*) >= 2""")
def resolved_30d(s, d):
    e = table(s, d, "events")
    # the end is one row
    r = e.join(F.broadcast(e.agg(F.max("ts").alias("_end"))), F.col("ts") > F.col("_end") - F.expr("interval 30 days")).groupBy("user_id").agg(F.count("*").alias("n"), (F.min_by("value", F.struct("ts", "value")) - F.max_by("value", F.struct("ts", "value"))).alias("v"))
    return r.where("n >= 2").select("user_id", F.round(F.greatest(F.lit(0.0), "v"), 6).alias("resolved"))


@query("""select o_orderpriority as plan, count(*) as n, round(count(*) filter (o_orderstatus = 'F') / count(*), 6) as adoption from orders group by 1""")
def plan_adoption(s, d):
    return table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("plan")).agg(F.count("*").alias("n"), F.round(F.count(F.when(F.col("o_orderstatus") == "F", 1)) / F.count("*"), 6).alias("adoption"))


@query(rf"""
    with r as (select case lang when 'python' then 'A' || chr(9) || file_path when 'go' then 'R100' || chr(9) || file_path || '.old' || chr(9) || file_path when 'json' then 'D' || chr(9) || file_path else 'M' || chr(9) || file_path end as v from {_P} where file_path is not null),
    p as (select string_split(v, chr(9)) as p from r)
    select p[-1] as path, case p[1][1] when 'A' then 'added' when 'D' then 'deleted' when 'R' then 'renamed' else 'modified' end as status from p union all select p[-1], 'modified' from p where p[1][1] = 'R'""")
def git_name_status(s, d):
    path, tab = F.col("file_path"), F.lit("\t")
    line = F.when(F.col("lang") == "python", F.concat(F.lit("A\t"), path)).when(F.col("lang") == "go", F.concat(F.lit("R100\t"), path, F.lit(".old"), tab, path)).when(F.col("lang") == "json", F.concat(F.lit("D\t"), path)).otherwise(F.concat(F.lit("M\t"), path))
    lines = _files(s, d).where("file_path is not null").select(line.alias("value"))
    return Fi.parse_name_status(lines).select("path", "status")


@query(f"""select entity_id, sha256(content) as hash, case when entity_id % 5 = 0 then 'new' else 'old' end as version from {_E} where content is not null and file_id % 11 <> 0""")
def store_upsert(s, d):
    e = _entities(s, d).where("content is not null").select("entity_id", "file_id", F.sha2("content", 256).alias("hash"))
    merged = Si.upsert(e.withColumn("version", F.lit("old")), e.where("entity_id % 5 = 0").withColumn("version", F.lit("new")), "entity_id")
    gone = e.where("file_id % 11 = 0").select("file_id").distinct()
    return Si.delete_by(merged.where("file_id is not null"), gone, "file_id").select("entity_id", "hash", "version")


@query(f"""select repo, count(*) as n, count(*) filter (file_path is null and name is not null and entity_type is not null) as n_manual from {_E} group by repo""")
def manual_entries(s, d):
    return _entities(s, d).groupBy("repo").agg(F.count("*").alias("n"), F.count(F.when(P.is_manual(), 1)).alias("n_manual"))


@query(rf"""select entity_id, array_to_string(list_sort(list_distinct(regexp_extract_all(content, '(?:open|read_csv|read_json|read_parquet|to_csv|to_json|readFileSync|writeFileSync|ReadFile|WriteFile)\(["'']([^"'']+)["'']', 1))), ',') as paths from {_E} where content is not null""")
def file_operations(s, d):
    return _entities(s, d).where("content is not null").select("entity_id", F.array_join(P.file_operations("content"), ",").alias("paths"))


@query(f"""
    with f as (select distinct file_id from {_E} where entity_id % 9 = 0), n as (select name from {_E} where file_id in (select file_id from f))
    select relation_type, count(*) as n from {_R} where from_entity in (select trim(name) from n) or to_entity in (select trim(name) from n) group by relation_type""")
def changed_entity_relations(s, d):
    e = _entities(s, d)
    n = e.join(e.where("entity_id % 9 = 0").select("file_id").distinct(), "file_id", "left_semi").select(F.trim("name").alias("name")).distinct()
    r = _edges(s, d)
    a = r.join(n.select(F.col("name").alias("from_entity")), "from_entity", "left_semi")
    b = r.join(n.select(F.col("name").alias("to_entity")), "to_entity", "left_semi")
    return a.select("relation_id", "relation_type").union(b.select("relation_id", "relation_type")).distinct().groupBy("relation_type").agg(F.count("*").alias("n"))
