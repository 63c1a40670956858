"""Queries over entities, relations and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..operators.components import connected_components
from ..session import latest, table
from .registry import query

_E = "(select * from entities qualify row_number() over (partition by entity_id order by ingested_at) = 1)"
_R = "(select relation_id, any_value(repo) as repo, any_value(trim(from_entity)) as from_entity, any_value(trim(to_entity)) as to_entity, any_value(relation_type) as relation_type, any_value(context) as context, any_value(greatest(0, least(1, confidence))) as confidence, any_value(import_type) as import_type from relations group by relation_id)"
_P = "(select * from parser_results qualify row_number() over (partition by file_id order by ingested_at) = 1)"
_EXT = r"\.(?:json|ya?ml|csv|txt|md|html|css|xml|toml|ini|cfg|sql|log|png|jpe?g|svg|pdf|parquet|xlsx?|lock|env|sh|tsv)$"


def _edges(s, d):
    return G.edges(table(s, d, "relations"))


def _entities(s, d):
    return latest(table(s, d, "entities"), "entity_id")


def _files(s, d):
    return latest(table(s, d, "parser_results"), "file_id")


@query(f"""
    with r as {_R}, o as (select from_entity as name, count(*) as n_out from r where from_entity is not null group by 1),
    i as (select to_entity as name, count(*) as n_in from r where to_entity is not null group by 1)
    select name, coalesce(n_out, 0) as n_out, coalesce(n_in, 0) as n_in from o full join i using (name)""")
def degree_counts(s, d):
    return G.degrees(_edges(s, d))


@query(f"""select relation_type, count(*) as n, count(to_entity) as n_with_target, count(distinct to_entity) as n_targets,
           round(avg(confidence), 6) as avg_confidence, count(distinct repo) as n_repos from {_R} group by relation_type""")
def relation_type_stats(s, d):
    return _edges(s, d).groupBy("relation_type").agg(F.count("*").alias("n"), F.count("to_entity").alias("n_with_target"), F.countDistinct("to_entity").alias("n_targets"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.countDistinct("repo").alias("n_repos"))


@query(f"""
    with recursive r as {_R}, st as (select distinct from_entity as a, to_entity as b from r where from_entity is not null and to_entity is not null),
    s as (select distinct trim(name) as name from {_E} where entity_id % 20 = 0),
    h as (select name as seed, name, 0 as distance from s union select h.seed, st.b, h.distance + 1 from h join st on st.a = h.name where h.distance < 2)
    select seed, name, min(distance)::int as distance from h group by seed, name""")
def k_hop_neighbours(s, d):
    return G.k_hop(_edges(s, d), _entities(s, d).where("entity_id % 20 = 0").select(F.trim("name").alias("name")), 2)


@query(f"""
    with r as {_R}, k as (select distinct trim(name) as name from {_E} where name is not null)
    select relation_id, case when a.name is null then 'source' else 'target' end as reason
    from r left join k a on a.name = r.from_entity left join k b on b.name = r.to_entity
    where a.name is null or (r.to_entity is not null and b.name is null and not regexp_matches(lower(r.to_entity), '{_EXT}'))""")
def orphan_relations(s, d):
    return G.orphan_edges(_edges(s, d), _entities(s, d)).select("relation_id", "reason")


@query("""select id, entity_id, entity_name from chunks where chunk_type = 'metadata' and entity_id not in (select entity_id from chunks where chunk_type = 'implementation' and entity_id is not null)""")
def missing_implementation(s, d):
    return G.missing_partner(table(s, d, "chunks"), "metadata", "implementation").select("id", "entity_id", "entity_name")


@query(f"""
    select entity_id, name, coalesce(lower(trim(entity_type)) not in ('import', 'variable', 'constant') and entity_id in (select entity_id from chunks where chunk_type = 'implementation'), false) as has_implementation from {_E}""")
def has_implementation_flag(s, d):
    impl = table(s, d, "chunks").where("chunk_type = 'implementation'").select("entity_id").distinct().withColumn("i", F.lit(True))
    e = _entities(s, d).join(impl, "entity_id", "left")
    flag = F.col("i").isNotNull() & ~F.lower(F.trim("entity_type")).isin("import", "variable", "constant")
    return e.select("entity_id", "name", F.coalesce(flag, F.lit(False)).alias("has_implementation"))


@query(f"""
    select m.entity_id, m.file_path, length(m.content || coalesce(chr(10) || i.content, ''))::int as n_chars, i.content is not null as unified
    from (select * from chunks where chunk_type = 'metadata') m left join (select * from chunks where chunk_type = 'implementation') i using (entity_id)""")
def unified_chunks(s, d):
    c = table(s, d, "chunks")
    i = c.where("chunk_type = 'implementation'").select("entity_id", F.col("content").alias("impl"))
    j = c.where("chunk_type = 'metadata'").join(i, "entity_id", "left")
    return j.select("entity_id", "file_path", F.length(F.concat_ws("\n", "content", "impl")).alias("n_chars"), F.col("impl").isNotNull().alias("unified"))


@query(f"""
    with f as (select distinct file_path, string_split(regexp_replace(regexp_replace(file_path, '^\\./', ''), '\\.[^./]+$', ''), '/') as p from {_P}),
    k as (select file_path, array_to_string(p[i:], '.') as k from (select file_path, p, unnest(range(1, len(p) + 1)) as i from f)),
    b as (select k, arg_min(file_path, (length(file_path), file_path)) as file_path from k group by k),
    m as (select distinct to_entity as module from {_R} where relation_type = 'imports' and to_entity is not null)
    select module, file_path from m join b on b.k = regexp_replace(module, '^\\.+', '')""")
def module_resolution(s, d):
    return G.resolve_modules(_edges(s, d).where("relation_type = 'imports'").select(F.col("to_entity").alias("module")), _files(s, d))


@query(f"""
    with i as (select entity_name, array_to_string(list_transform(string_split(content, chr(10)), lambda x: string_split(x, '#')[1]), chr(10)) as code from chunks where chunk_type = 'implementation'),
    j as (select relation_id, from_entity, to_entity, max(instr(code, string_split(to_entity, '.')[-1] || '(') > 0) as called
          from {_R} r join i on i.entity_name = r.from_entity where relation_type = 'calls' and to_entity is not null group by all)
    select relation_id, from_entity, to_entity from j where not called""")
def phantom_calls(s, d):
    return G.phantom_calls(_edges(s, d).where("relation_type = 'calls'"), table(s, d, "chunks"))


@query()
def same_file_calls(s, d):
    e = _entities(s, d).select("file_id", F.col("name").alias("entity_name"), "name", "content")
    return G.call_edges(e.where("content is not null"), e, "file_id")


@query(f"""
    with recursive r as {_R}, e as (select distinct from_entity as a, to_entity as b from r where relation_type = 'inherits' and from_entity is not null and to_entity is not null),
    s as (select a, b from e union select b, a from e),
    w as (select a as id, a as c from s union select b, a from s),
    h as (select id, c from w union select h.id, w.c from h join w on w.id = h.c)
    select id, min(c) as component from h group by id""")
def inheritance_components(s, d):
    e = _edges(s, d).where("relation_type = 'inherits'")
    return connected_components(e, "from_entity", "to_entity")


@query(f"""select relation_type, count(*) as n from {_R} r where relation_type not in ('calls') or to_entity in (select name from {_E}) group by relation_type""")
def in_memory_call_filter(s, d):
    e = _edges(s, d)
    names = _entities(s, d).select(F.col("name").alias("to_entity")).distinct()
    return e.where("relation_type <> 'calls'").unionByName(e.where("relation_type = 'calls'").join(names, "to_entity", "left_semi")).groupBy("relation_type").agg(F.count("*").alias("n"))


@query(f"""
    with e as {_E}, r as {_R}
    select e.entity_id, count(distinct h.entity_id) as n_helpers, count(distinct r.to_entity) as n_dependencies
    from e left join e h on h.file_id = e.file_id and h.entity_id <> e.entity_id and e.file_id is not null left join (select distinct from_entity, to_entity from r where relation_type in ('calls', 'imports')) r on r.from_entity = e.name
    where lower(trim(e.entity_type)) in ('function', 'method') group by e.entity_id""")
def implementation_scopes(s, d):
    e = _entities(s, d).select("entity_id", "file_id", "name", "entity_type")
    own = e.groupBy("file_id").agg((F.count("*") - 1).alias("n_helpers"))
    deps = _edges(s, d).where("relation_type in ('calls', 'imports') and to_entity is not null").groupBy(F.col("from_entity").alias("name")).agg(F.countDistinct("to_entity").alias("n_dependencies"))
    zero = F.lit(0).cast("bigint")
    f = e.where(F.lower(F.trim("entity_type")).isin("function", "method"))
    return f.join(own, "file_id", "left").join(deps, "name", "left").select("entity_id", F.coalesce("n_helpers", zero).alias("n_helpers"), F.coalesce("n_dependencies", zero).alias("n_dependencies"))


@query(f"""
    with k as (select relation_id, concat_ws('::', from_entity, relation_type, to_entity, import_type, context) as key from {_R})
    select key, min(relation_id) as relation_id, count(*) as n from k group by key having count(*) > 1""")
def first_wins_relations(s, d):
    k = _edges(s, d).select("relation_id", X.relation_key("from_entity", "relation_type", "to_entity", "import_type", "context").alias("key"))
    return k.groupBy("key").agg(F.min("relation_id").alias("relation_id"), F.count("*").alias("n")).where("n > 1")


@query(f"""select entity_id, array_to_string(list_filter([name, name, replace(replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' '), '-', ' '), observations[1], entity_type, string_split(file_path, '/')[-1]], lambda x: x is not null), ' ') as search_text from {_E}""")
def entity_search_text(s, d):
    return _entities(s, d).select("entity_id", X.search_text("name", "entity_type", "observations", "file_path").alias("search_text"))


@query(f"""select entity_id, concat_ws('::', file_path, lower(trim(entity_type)), name, 'implementation', substring(sha256(content), 1, 16)) as id from {_E}""")
def chunk_ids(s, d):
    return _entities(s, d).select("entity_id", X.chunk_id("file_path", F.lower(F.trim("entity_type")), "name", F.lit("implementation"), "content").alias("id"))
