"""Queries over what an indexing service keeps about itself, and density clusters."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import design as G, services as S
from ..operators.components import connected_components
from ..operators.search import keyword_search
from ..operators.stats import positions, running_total
from ..session import latest, table
from .graph import _E, _P, _R, _edges
from .registry import query
from .search import _keyword_sql

_quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def _file_rows(s, d, *columns):
    return latest(table(s, d, "parser_results").select("file_id", *columns), "file_id")


@query(f"""select file_id, lower(regexp_extract(file_path, '(\\.[^./]+)$', 1)) in ('.css', '.scss', '.less', '.tsx', '.jsx', '.vue', '.svelte') as is_ui from {_P}""")
def ui_files(s, d):
    return _file_rows(s, d, S.is_ui_file("file_path").alias("is_ui"))


@query(f"""select file_id, case when regexp_matches(file_path, '\\.(exe|dll|so|dylib|a|lib|o|obj|class|py[cdo]|bin|elf)$') then 'extension'
    when starts_with(content, chr(127) || 'ELF') or starts_with(content, 'MZ') then 'magic' end as reason from {_P} where content is not null""")
def binary_files(s, d):
    return latest(table(s, d, "parser_results").where("content is not null").select("file_id", S.exclusion_reason("file_path", F.col("content")).alias("reason")), "file_id")


@query(f"""
    with l as (select file_id, i::int as line_no, ls[i] as line from (select file_id, ls, unnest(range(1, len(ls) + 1)) as i from (select file_id, string_split(content, chr(10)) as ls from {_P} where content is not null))),
    m as (select *, case when contains(lower(line), 'ui-quality-disable') then 'ui-quality-disable' when contains(lower(line), 'ui-check-disable') then 'ui-check-disable' when contains(lower(line), '@ui-ignore') then '@ui-ignore'
        when contains(lower(line), 'stylelint-disable') then 'stylelint-disable' when contains(lower(line), 'eslint-disable') then 'eslint-disable' end as mark from l),
    a as (select *, substring(line, instr(lower(line), mark) + length(mark)) as rest from m where mark is not null)
    select file_id, line_no, mark, length(trim(case when contains(rest, '--') then substring(rest, instr(rest, '--') + 2) when contains(rest, ':') then substring(rest, instr(rest, ':') + 1) else '' end)) >= 6 as has_rationale from a""")
def suppression_comments(s, d):
    lines = table(s, d, "parser_results").where("content is not null").select("file_id", F.posexplode(F.split("content", "\n")).alias("p", "line"))
    marked = lines.withColumn("mark", S.suppression("line")).where("mark is not null")
    return latest(marked.select("file_id", (F.col("p") + 1).alias("line_no"), "mark", S.has_rationale("line", "mark").alias("has_rationale")), "file_id", "line_no")


@query(f"""
    with w as (select entity_id, signature, docstring, list_filter(coalesce(observations, []), lambda o: o is not null) as obs from {_E})
    select entity_id, md5(array_to_string(list_concat(list_concat(case when length(signature) > 0 then ['Signature: ' || signature, 'Signature: ' || signature, 'Signature: ' || signature] else [] end, case when length(docstring) > 0 then ['Description: ' || docstring, 'Description: ' || docstring] else [] end),
        flatten(list_transform(obs, lambda o: case when regexp_matches(lower(o), 'class:|function:|method:|interface:|signature:') then [o, o, o] when regexp_matches(lower(o), 'purpose:|responsibility:|description:') then [o, o] else [o] end))), ' | ')) as hash from w""")
def weighted_observations(s, d):
    return latest(table(s, d, "entities").select("entity_id", F.md5(S.weighted_observations("signature", "docstring", "observations")).alias("hash")), "entity_id")


@query(f"""
    with e as (select file_id, unnest(errors) as error, 0 as attempt from {_P} where errors is not null)
    select coalesce(regexp_matches(lower(error), 'rate limit|timeout|connection|temporary|503|502|429'), false) as retry, count(*) as n from e group by 1""")
def retryable_errors(s, d):
    e = _file_rows(s, d, "errors").select(F.explode("errors").alias("error"))
    return e.groupBy(S.retryable("error", F.lit(0)).alias("retry")).agg(F.count("*").alias("n"))


@query("select event_id, least(60.0, pow(2.0, event_id % 9)) as delay from events")
def backoff_delays(s, d):
    return table(s, d, "events").select("event_id", S.backoff(F.col("event_id") % 9).alias("delay"))


@query(f"""select repo, count(*) as n_files, round(sum(parsing_time), 6) as seconds, round(avg(parsing_time), 6) as avg_seconds, round(count(*) filter (len(errors) > 0) / count(*), 6) as error_rate from {_P} group by repo""")
def batch_statistics(s, d):
    f = _file_rows(s, d, "repo", "parsing_time", F.coalesce(F.size("errors") > 0, F.lit(False)).alias("failed"))
    return f.groupBy("repo").agg(F.count("*").alias("n_files"), F.round(F.sum("parsing_time"), 6).alias("seconds"), F.round(F.avg("parsing_time"), 6).alias("avg_seconds"), F.round(F.avg(F.col("failed").cast("double")), 6).alias("error_rate"))


@query(f"""
    with f as (select repo, case when len(string_split(content, chr(10))) <= 40 then 'low' when len(string_split(content, chr(10))) <= 120 then 'medium' else 'high' end as effort from {_P} where content is not null),
    g as (select repo, count(*) as n, sum(case effort when 'low' then 1 when 'medium' then 2 else 4 end)::bigint as weight from f group by repo)
    select repo, n, weight, case when weight <= 3 then 'low' when weight <= 8 then 'medium' else 'high' end as label from g""")
def effort_by_repo(s, d):
    n = F.size(F.split("content", "\n"))
    tasks = latest(table(s, d, "parser_results").where("content is not null").select("file_id", "repo", F.when(n <= 40, "low").when(n <= 120, "medium").otherwise("high").alias("effort")), "file_id")
    return S.total_effort(tasks, "repo")


@query(f"""
    with f as (select file_id, indexed_at, epoch_us(indexed_at) as t from {_P} where indexed_at is not null),
    c as (select file_id, row_number() over (order by indexed_at, file_id) as done, (t - min(t) over ()) / 1e6 as elapsed, count(*) over () as total from f)
    select file_id, done, case when elapsed > 0 then round(done / elapsed, 9) end as speed, case when elapsed > 0 then round((total - done) / (done / elapsed), 3) end as eta from c""")
def indexing_progress(s, d):
    f = _file_rows(s, d, "indexed_at").where("indexed_at is not null")
    ends = f.agg(F.min("indexed_at").alias("begin"), F.count("*").alias("total"))
    rows = running_total(f, ["indexed_at", "file_id"], F.lit(1), "done").join(F.broadcast(ends))
    elapsed = (F.unix_micros(F.col("indexed_at").cast("timestamp")) - F.unix_micros(F.col("begin").cast("timestamp"))) / 1e6
    return rows.select("file_id", "done", F.when(elapsed > 0, F.round(F.col("done") / elapsed, 9)).alias("speed"), F.when(elapsed > 0, F.round((F.col("total") - F.col("done")) / (F.col("done") / elapsed), 3)).alias("eta"))


@query(f"""
    with l as (select repo, max(indexed_at) as last from {_P} group by repo), n as (select max(last) as newest from l),
    b as (select r.repo, count(*) as behind from (select relation_id, any_value(repo) as repo, any_value(seen_at) as seen_at from relations group by relation_id) r join l on l.repo = r.repo where r.seen_at > l.last group by r.repo)
    select l.repo, l.last, round((epoch_us(newest) - epoch_us(last)) / 3600000000, 6) as hours, coalesce(behind, 0) as behind from l left join b on b.repo = l.repo, n""")
def index_freshness(s, d):
    changes = latest(table(s, d, "relations").select("relation_id", "repo", "seen_at"), "relation_id")
    return S.freshness(_file_rows(s, d, "repo", "indexed_at"), changes, "repo", "indexed_at", "seen_at")


@query(f"""
    with m as (select repo, entity_id as layer, unnest(map_keys(metadata)) as key, unnest(map_values(metadata)) as value from {_E} where metadata is not null)
    select repo, key, arg_max(value, (layer, coalesce(value, ''))) as value from m group by repo, key""")
def merged_settings(s, d):
    e = latest(table(s, d, "entities").where("metadata is not null").select("entity_id", "repo", "metadata"), "entity_id")
    layers = e.select("repo", F.col("entity_id").alias("layer"), F.explode("metadata").alias("key", "value"))
    return S.merge_layers(layers, "repo")


_RULES = [("universal", "*.lock"), ("universal", "node_modules/"), ("global", "tests/"), ("global", "*.ini"), ("project", "!tests/unit/"), ("project", "scripts/"), ("project", "!*.sh")]


@query(f"""
    with p as (select file_id, '/' || file_path as p from {_P} where file_path is not null)
    select file_id, case when p like '%.sh' then null when p like '%/scripts/%' then 'project' when p like '%/tests/unit/%' then null when p like '%.ini' then 'global' when p like '%/tests/%' then 'global' when p like '%/node_modules/%' then 'universal' when p like '%.lock' then 'universal' end as layer from p""")
def ignore_layers(s, d):
    return _file_rows(s, d, "file_path").where("file_path is not null").select("file_id", S.ignored_by_layers("file_path", _RULES).alias("layer"))


@query("""
    with l as (select user_id, floor(value)::int % 7 as path, max(ts) as last_at, arg_max(event_type, (ts, event_id)) as event_type from events where ts is not null group by all), n as (select max(ts) as newest from events)
    select user_id, path, event_type, last_at from l, n where last_at + interval 2 hour <= newest""")
def index_queue(s, d):
    e = table(s, d, "events").select("user_id", (F.floor("value").cast("int") % 7).alias("path"), "event_type", F.col("ts").alias("last_at"), "event_id")
    now = e.agg(F.max("last_at").alias("now"))
    return S.pending_queue(e.join(F.broadcast(now)).select("user_id", F.struct("path", "now").alias("k"), "event_type", "last_at", "event_id"), "user_id", "k", "event_type", "last_at", F.col("k.now"), "2 hours", "event_id").select("user_id", "k.path", "event_type", "last_at")


@query("""
    with l as (select event_id, sha256(concat_ws('|', user_id::varchar, event_type)) as key, ts from events),
    g as (select event_id, key, epoch_us(ts) - lag(epoch_us(ts)) over (partition by key order by ts, event_id) as gap from l)
    select event_id, coalesce(gap <= 3600000000, false) as hit from g""")
def query_cache_hits(s, d):
    keyed = table(s, d, "events").select("event_id", "ts", F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type"), 256).alias("key"))
    return S.cache_lookups(keyed, "key", "ts", 3600, "event_id").select("event_id", "hit")


@query()
def adaptive_batches(s, d):
    b = table(s, d, "events").select("user_id", "event_id", F.when(F.col("value") > 20, 0.5).otherwise(0.0).alias("error_rate"))
    return S.batch_sizes(b, "user_id", "event_id")


@query(f"""
    with n as (select distinct trim(name) as name from {_E} where name is not null), r as {_R}
    select relation_type, count(*) as n, count(*) filter (from_entity is not null and from_entity not in (select name from n)) as n_no_source, count(*) filter (to_entity is not null and to_entity not in (select name from n)) as n_no_target,
        count(*) filter (from_entity is not null and to_entity is not null and from_entity not in (select name from n) and to_entity not in (select name from n)) as n_neither from r group by relation_type""")
def hash_orphans(s, d):
    names = table(s, d, "entities").where("name is not null").select(F.trim("name").alias("name")).distinct()
    r = _edges(s, d)
    a = names.select(F.col("name").alias("from_entity"), F.lit(True).alias("has_from"))
    b = names.select(F.col("name").alias("to_entity"), F.lit(True).alias("has_to"))
    j = r.join(a, "from_entity", "left").join(b, "to_entity", "left")
    no_a, no_b = F.col("from_entity").isNotNull() & F.col("has_from").isNull(), F.col("to_entity").isNotNull() & F.col("has_to").isNull()
    n = lambda c: F.count(F.when(c, 1))
    return j.groupBy("relation_type").agg(F.count("*").alias("n"), n(no_a).alias("n_no_source"), n(no_b).alias("n_no_target"), n(no_a & no_b).alias("n_neither"))


@query("""select source, doc_id, created_at, rank::int as rank from (select source, doc_id, created_at, row_number() over (partition by source order by created_at desc nulls last, doc_id) as rank from documents) where rank <= 25""")
def newest_chats(s, d):
    w = Window.partitionBy("source").orderBy(F.desc_nulls_last("created_at"), "doc_id")
    return table(s, d, "documents").select("source", "doc_id", "created_at").withColumn("rank", F.row_number().over(w)).where("rank <= 25")


@query("""
    with p as (select x.vec_id as a, y.vec_id as b from embeddings x join embeddings y on x.label = y.label and x.vec_id < y.vec_id where list_cosine_similarity(x.embedding::double[], y.embedding::double[]) >= 0.3),
    s as (select a, b from p union select b, a from p), c as (select a as id from s group by a having count(*) + 1 >= 3)
    , k as (select s.a, s.b from s where a in (select id from c) and b in (select id from c)),
    h as (with recursive h as (select id, id as r from c union select h.id, k.b from h join k on k.a = h.r) select id, min(r) as cluster from h group by id),
    n as (select s.a as id, min(h.cluster) as near from s join h on h.id = s.b group by s.a)
    select e.vec_id, coalesce(h.cluster, n.near, -1) as cluster from embeddings e left join h on h.id = e.vec_id left join n on n.id = e.vec_id""")
def dbscan_clusters(s, d):
    e = table(s, d, "embeddings")
    return S.dbscan(e, G.pairwise_within(e, "label", "vec_id", "embedding", 0.3), "vec_id", 3)


_TIER_SQL = "case when length(content) > 20000 then 'light' when regexp_matches(file_path, '(^|/)(gen|generated|dist|vendor|node_modules)/|[.]min[.]') then 'light' when length(content) < 5000 and regexp_matches(file_path, '(^|/)(core|models|api)/') then 'deep' else 'standard' end"


def _tier():
    size, path = F.length("content"), F.col("file_path")
    return F.when(size > 20000, "light").when(path.rlike(r"(^|/)(gen|generated|dist|vendor|node_modules)/|[.]min[.]"), "light").when((size < 5000) & path.rlike("(^|/)(core|models|api)/"), "deep").otherwise("standard")


@query(f"""
    with t as (select file_id, {_TIER_SQL} as tier from {_P} where content is not null)
    select file_id, tier, ((row_number() over (order by case tier when 'light' then 0 when 'standard' then 1 else 2 end, file_id) - 1) // 50)::bigint as batch from t""")
def tier_batches(s, d):
    t = latest(table(s, d, "parser_results").where("content is not null").select("file_id", _tier().alias("tier")), "file_id")
    ordered = positions(t.withColumn("_t", F.when(F.col("tier") == "light", 0).when(F.col("tier") == "standard", 1).otherwise(2)), ["_t", "file_id"])
    return ordered.select("file_id", "tier", F.floor(F.col("i") / 50).cast("bigint").alias("batch"))


@query(f"""
    with t as (select file_id, {_TIER_SQL} as tier from {_P} where content is not null)
    select entity_id, name, lower(trim(entity_type)) as kind from {_E} where file_id in (select file_id from t where tier = 'light')""")
def light_entities(s, d):
    light = latest(table(s, d, "parser_results").where("content is not null").select("file_id", _tier().alias("tier")), "file_id").where("tier = 'light'")
    e = latest(table(s, d, "entities").select("entity_id", "file_id", "name", F.lower(F.trim("entity_type")).alias("kind")), "entity_id")
    return e.join(light.select("file_id"), "file_id", "left_semi").select("entity_id", "name", "kind")


@query("""
    with recursive p as (select x.vec_id as a, y.vec_id as b from embeddings x join embeddings y on x.label = y.label and x.vec_id < y.vec_id where list_cosine_similarity(x.embedding::double[], y.embedding::double[]) >= 0.32),
    s as (select a, b from p union select b, a from p), h as (select a as id, a as c from s union select h.id, s.b from h join s on s.a = h.c),
    k as (select id, min(c) as cluster from h group by id)
    select cluster, count(*) as n from k group by cluster having count(*) >= 2""")
def visual_clusters(s, d):
    k = connected_components(G.pairwise_within(table(s, d, "embeddings"), "label", "vec_id", "embedding", 0.32))
    return k.groupBy(F.col("component").alias("cluster")).agg(F.count("*").alias("n")).where("n >= 2")


_MEMORY = f"(select entity_id as doc_id, concat_ws(' ', name, docstring, content) as text from {_E})"


@query(_keyword_sql("idf * idf", "greatest(0, ln((n - df + 0.5) / (df + 0.5)))", 5).replace("from documents)", f"from {_MEMORY})"))
def related_memory(s, d):
    topics = table(s, d, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    # redelivered rows must not count twice, so these texts are told apart before they are searched
    memory = latest(table(s, d, "entities").select(F.col("entity_id").alias("doc_id"), F.concat_ws(" ", "name", "docstring", "content").alias("text")), "doc_id")
    return keyword_search(memory, topics, 5).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")
