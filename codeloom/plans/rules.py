"""Rule queries over all files."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as X
from ..session import latest, spread, table
from .graph import _E, _P, _entities, _files
from .registry import query


def _scan(s, d, **how):
    # findings are told apart at the end, so that texts of redelivered files are not shuffled
    return R.scan(spread(table(s, d, "parser_results")), **how)


@query(R.scan_sql(_P))
def rule_findings(s, d):
    return _scan(s, d).select("file_id", "line_no", "rule_id", "severity")


@query(f"select rule_id, severity, count(*) as n, count(distinct file_id) as n_files from ({R.scan_sql(_P)}) group by all")
def rule_summary(s, d):
    return _scan(s, d).groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("n_files"))


@query(f"select coalesce(bool_or(severity in ('HIGH', 'CRITICAL')), false) as blocked, count(*) filter (severity in ('HIGH', 'CRITICAL')) as n from ({R.scan_sql(_P)})")
def rule_block_decision(s, d):
    return R.blocked(_scan(s, d))


@query(f"select file_id, count(*) as n from ({R.scan_sql(_P, tuple(r for r in R.RULES if r.fast))}) group by file_id")
def rule_fast_scan(s, d):
    return _scan(s, d, trigger=R.ON_WRITE).groupBy("file_id").agg(F.count("*").alias("n"))


@query(f"""select file_id, len(string_split(content, chr(10)))::int as n_lines, case when len(string_split(content, chr(10))) > 400 then 'HIGH' else 'MEDIUM' end as severity from {_P} where len(string_split(content, chr(10))) > 200""")
def rule_large_files(s, d):
    n = F.size(F.split("content", "\n"))
    return _files(s, d).where(n > 200).select("file_id", n.alias("n_lines"), F.when(n > 400, "HIGH").otherwise("MEDIUM").alias("severity"))


@query(rf"""
    with r as (select file_id, lower(file_path) as path, unnest(range(1, len(string_split(content, chr(10))) + 1)) as i, string_split(content, chr(10)) as ls from {_P}),
    l as (select file_id, i::int as line_no, ls[i] as line, ls[i + 1] as next from r where regexp_matches(path, '\.(py|js|ts|go)$'))
    select file_id, line_no from l where regexp_matches(line, '^\s*(return|raise|throw|break|continue)\b.*[^,({{\[\\]$|^\s*(return|break|continue);?$') and trim(coalesce(next, '')) <> '' and not regexp_matches(next, '^\s*([)}}\]]|case\b|default\b|else|elif|except|finally|#|//)')
      and length(next) - length(ltrim(next, ' ' || chr(9))) = length(line) - length(ltrim(line, ' ' || chr(9)))""")
def rule_dead_code(s, d):
    lines = R._numbered(_files(s, d).where(F.lower("file_path").rlike(r"\.(py|js|ts|go)$")))
    ends = F.col("line").rlike(r"^\s*(return|raise|throw|break|continue)\b.*[^,({\[\\]$|^\s*(return|break|continue);?$")
    goes = (F.trim(F.col("next")) != "") & ~F.col("next").rlike(r"^\s*([)}\]]|case\b|default\b|else|elif|except|finally|#|//)")
    indent = lambda c: F.length(F.regexp_extract(c, "^([ \t]*)", 1))
    return lines.where(ends & goes & (indent("next") == indent("line"))).select("file_id", "line_no")


@query(rf"""
    with r as (select file_id, unnest(range(1, len(string_split(content, chr(10))) + 1)) as i, string_split(content, chr(10)) as ls from {_P} where regexp_matches(lower(file_path), '\.(js|ts)$')),
    l as (select file_id, i::int as line_no, ls[i] as line from r),
    c as (select *, first_value(case when not regexp_matches(line, '^\s*(\*|/\*|$)') then line end ignore nulls) over (partition by file_id order by line_no rows between current row and unbounded following) as code from l),
    p as (select file_id, line_no, regexp_extract(line, '@param (?:\{{[^}}]*\}} )?(\w+)', 1) as name, code from c where regexp_matches(line, '^\s*\* @param '))
    select file_id, line_no, name from p where name <> '' and coalesce(instr(' ' || regexp_replace(code, '\W+', ' ', 'g') || ' ', ' ' || name || ' ') = 0, true)""")
def rule_outdated_docs(s, d):
    return R.stale_parameters(_files(s, d))


@query(rf"""
    with c as (select entity_id, file_id, trim(regexp_replace(regexp_replace(regexp_replace(content, '(?s)/\*.*?\*/', ' ', 'g'), '(?m)(?:#|//).*$', ' ', 'g'), '\s+', ' ', 'g')) as code from {_E} where lower(trim(entity_type)) in ('function', 'method') and content is not null)
    select md5(code) as hash, count(*) as n, count(distinct file_id) as n_files, min(entity_id) as first_entity from c where length(code) >= 80 group by code having count(distinct file_id) >= 2""")
def rule_component_duplication(s, d):
    e = _entities(s, d).where(F.lower(F.trim("entity_type")).isin("function", "method") & F.col("content").isNotNull()).select("entity_id", "file_id", X.normalise_code("content").alias("code"))
    return e.where(F.length("code") >= 80).groupBy(F.md5("code").alias("hash")).agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("n_files"), F.min("entity_id").alias("first_entity")).where("n_files >= 2")


@query(rf"""
    with c as (select entity_id, array_to_string(list_filter(string_split(content, chr(10)), lambda x: not regexp_matches(x, '^\s*(#|//|\*)')), chr(10)) as b from {_E} where content is not null and lower(trim(entity_type)) in ('function', 'method')),
    k as (select entity_id, (1 + len(regexp_extract_all(b, '\b(?:if|elif|for|while|case|catch|except)\b')) + len(regexp_extract_all(b, '&&|\|\||\band\b|\bor\b')))::int as complexity from c)
    select entity_id, complexity, case when complexity > 15 then 'HIGH' else 'MEDIUM' end as severity from k where complexity > 10""")
def rule_complexity(s, d):
    e = table(s, d, "entities").where("content is not null and lower(trim(entity_type)) in ('function', 'method')")
    k = latest(e.select("entity_id", X.complexity("content").alias("complexity")), "entity_id").where("complexity > 10")
    return k.withColumn("severity", F.when(F.col("complexity") > 15, "HIGH").otherwise("MEDIUM"))


@query(f"""with f as (select file_id, max(line_no) as a from ({R.scan_sql(_P, tuple(r for r in R.RULES if r.rule_id == 'TECH_DEBT.TODO_MARKERS'))}) group by file_id),
    l as (select p.file_id, string_split(content, chr(10)) as ls, f.a from {_P} p left join f using (file_id) where content is not null)
    select file_id, md5(case when a is null then array_to_string(ls, chr(10)) else array_to_string(list_concat(list_concat(ls[1 : a - 1], ['removed']), ls[a + 1 :]), chr(10)) end) as hash from l""")
def rule_auto_fix(s, d):
    files = _files(s, d).where("content is not null")
    last = R.scan(files, rule_ids=["TECH_DEBT.TODO_MARKERS"]).groupBy("file_id").agg(F.max("line_no").alias("start"))
    return R.apply_fixes(files, last.select("file_id", "start", F.col("start").alias("end"), F.lit("removed").alias("text"))).select("file_id", F.md5("content").alias("hash"))
