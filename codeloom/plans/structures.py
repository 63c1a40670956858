"""Typed entities, relations and chunks of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import latest, table
from ..sources import structures as S
from .graph import _P
from .registry import query


def _of(s, d, *endings):
    """Files by extension. What is found in redelivered files is found again, and told apart by its keys."""
    return table(s, d, "parser_results").where(F.lower("file_path").rlike(r"\.(" + "|".join(endings) + ")$"))


@query(rf"""
    with l as (select file_id, i::int as line_no, ls[i] as line from (select file_id, ls, unnest(range(1, len(ls) + 1)) as i from (select file_id, string_split(content, chr(10)) as ls from {_P} where regexp_matches(lower(file_path), '\.(js|ts)$') and content is not null)))
    select file_id, line_no, 'class' as kind, regexp_extract(line, 'class (\w+)', 1) as name from l where regexp_matches(line, '^(export )?(default )?(abstract )?class \w+')
    union all select file_id, line_no, 'interface', regexp_extract(line, 'interface (\w+)', 1) from l where regexp_matches(line, '^(export )?interface \w+')
    union all select file_id, line_no, 'function', regexp_extract(line, 'function\*? (\w+)', 1) from l where regexp_matches(line, '^(export )?(default )?(async )?function\*? \w+')""")
def js_declarations(s, d):
    outer = S.script_entities(_of(s, d, "js", "ts")).where("owner is null and kind in ('class', 'interface', 'function')")
    # those that begin their line, and are written as declarations
    lines = _of(s, d, "js", "ts").where("content is not null").select("file_id", F.posexplode(F.split("content", "\n")).alias("p", "line")).where(F.col("line").rlike(r"^(export )?(default )?(abstract )?(async )?(class|interface|function)\b"))
    at = latest(lines.select("file_id", (F.col("p") + 1).alias("line_no")), "file_id", "line_no")
    return latest(outer.select("file_id", F.col("start_line").alias("line_no"), "kind", "name"), "file_id", "line_no", "kind", "name").join(at, ["file_id", "line_no"], "left_semi")


@query()
def js_entities(s, d):
    return latest(S.script_entities(_of(s, d, "js", "ts")), "file_id", "kind", "name", "start_line")


@query(rf"""
    with l as (select file_id, i::int as line_no, ls[i] as line from (select file_id, ls, unnest(range(1, len(ls) + 1)) as i from (select file_id, string_split(content, chr(10)) as ls from {_P} where regexp_matches(lower(file_path), '\.(js|ts)$') and content is not null)))
    select distinct file_id, 'requires' as kind, unnest(regexp_extract_all(line, '\brequire\([''"]([^''"]+)[''"]\)', 1)) as target, line_no from l where not regexp_matches(line, '^\s*(//|\*|/\*)')
    union select file_id, 'imports', regexp_extract(line, 'from [''"]([^''"]+)[''"]', 1), line_no from l where regexp_matches(line, '^import [^;''"]*from [''"][^''"]+[''"]')""")
def js_imports(s, d):
    r = S.script_relations(_of(s, d, "js", "ts")).where("kind in ('imports', 'requires')")
    return r.select("file_id", "kind", "target", "line_no").distinct()


@query()
def js_relations(s, d):
    return S.script_relations(_of(s, d, "js", "ts")).distinct()


@query(rf"""
    with j as (select file_id, content::json as j from {_P} where lower(file_path) like '%.json' and json_valid(content) and not regexp_matches(content, 'NaN|Infinity'))
    select file_id, t.fullkey as path, t.key as name, case when t.type = 'OBJECT' then 'object' when t.type = 'ARRAY' then 'array' when t.type = 'NULL' then 'null' when t.type = 'BOOLEAN' then 'boolean' when t.type = 'VARCHAR' then 'string' else 'number' end as kind
    from j, json_tree(j.j) t where t.key is not null and not regexp_matches(t.fullkey, '\[\d+\]$')""")
def json_structure(s, d):
    return S.json_structure(_of(s, d, "json")).select("file_id", "path", "name", "kind").distinct()


@query(rf"""
    with j as (select file_id, content::json as j from {_P} where lower(file_path) like '%.json' and json_valid(content)),
    o as (select file_id, t.key as k, t.value as v from j, json_each(j.j) t where json_type(j.j) = 'OBJECT' and t.type = 'ARRAY'),
    i as (select file_id, '$.' || k as path, u.key::int as i, u.type as kind from o, json_each(o.v) u)
    select file_id, path, i from i where kind = 'OBJECT'""")
def json_items(s, d):
    return S.json_items(_of(s, d, "json")).where("path <> '$'").select("file_id", "path", "i").distinct()


@query(rf"""
    with l as (select file_id, i::int as line_no, ls[i] as line from (select file_id, ls, unnest(range(1, len(ls) + 1)) as i from (select file_id, string_split(content, chr(10)) as ls from {_P} where regexp_matches(lower(file_path), '\.ya?ml$') and content is not null)))
    select file_id, line_no, regexp_extract(line, '^([A-Za-z_][A-Za-z0-9_.-]*) *:( |$)', 1) as name from l where regexp_matches(line, '^[A-Za-z_][A-Za-z0-9_.-]* *:( |$)')""")
def yaml_top_keys(s, d):
    y = S.yaml_entities(_of(s, d, "ya?ml")).where((F.col("depth") == 0) & F.col("name").rlike(r"^[A-Za-z_][A-Za-z0-9_.-]*$"))
    return y.select("file_id", "line_no", "name").distinct()


@query()
def yaml_entities(s, d):
    return S.yaml_entities(_of(s, d, "ya?ml")).distinct()


@query()
def implementation_chunks(s, d):
    return latest(S.implementation_chunks(_of(s, d, "py")), "file_id", "name", "start_line")


@query(rf"""
    with l as (select file_id, repo, unnest(string_split(content, chr(10))) as line from {_P} where lower(file_path) like '%.py' and content is not null),
    i as (select distinct file_id, repo, coalesce(nullif(regexp_extract(line, '^from (\.*[A-Za-z0-9_.]*) import ', 1), ''), nullif(regexp_extract(line, '^import ([A-Za-z0-9_.]+)$', 1), '')) as module from l),
    f as (select distinct repo, string_split(regexp_replace(regexp_replace(file_path, '^\./', ''), '(/__init__)?\.py$', ''), '/') as ps from {_P} where file_path like '%.py'),
    k as (select distinct repo, array_to_string(ps[1 : n], '.') as module from (select repo, ps, unnest(range(1, len(ps) + 1)) as n from f))
    select i.file_id, i.repo, i.module, starts_with(i.module, '.') or k.module is not null as is_internal from i left join k on k.repo = i.repo and k.module = i.module where i.module is not null""")
def internal_imports(s, d):
    files = _of(s, d, "py")
    lines = files.where("content is not null").select("file_id", "repo", F.explode(F.split("content", "\n")).alias("line"))
    module = F.coalesce(F.nullif(F.regexp_extract("line", r"^from (\.*[A-Za-z0-9_.]*) import ", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"^import ([A-Za-z0-9_.]+)$", 1), F.lit("")))
    imports = lines.select("file_id", "repo", module.alias("module")).where("module is not null").distinct()
    return S.internal_imports(imports, table(s, d, "parser_results")).select("file_id", "repo", "module", "is_internal")
