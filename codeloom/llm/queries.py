"""The queries of this package, and SQL where a problem can be stated in it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import spread, table
from . import contamination, credentials, docpairs, neardup, packing, provenance, splitting, syntax, truncation
from .common import code_entities


def _t(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: table(s, d, name)


_files, _entities, _documents, _items = _t("parser_results"), _t("entities"), _t("documents"), _t("eval_items")


def p1_found(s, d):
    pairs = neardup.near_duplicate_pairs(code_entities(_entities(s, d)))
    return pairs.select(F.col("a").alias("entity_id_a"), F.col("b").alias("entity_id_b"))


def p1_groups(s, d):
    return neardup.near_duplicate_groups(code_entities(_entities(s, d)))


def p2_found(s, d):
    return credentials.find_credentials(spread(_files(s, d))).select("file_id", "line_no")


def p2_redacted(s, d):
    return credentials.redact(spread(_files(s, d)).dropDuplicates(["file_id"]))


def p3_found(s, d):
    return splitting.split_oversized(spread(_entities(s, d)), distinct=False).select("entity_id").distinct()


def p3_pieces(s, d):
    return splitting.split_oversized(_entities(s, d))


def p4_found(s, d):
    return provenance.found(_files(s, d))


def p4_kinds(s, d):
    return provenance.provenance(spread(_files(s, d)))


def p5_found(s, d):
    return syntax.found(_files(s, d))


def p5_rates(s, d):
    files = spread(_files(s, d)).withColumn("ext", F.regexp_extract("file_path", r"(\.[^./]+)$", 1))
    verdicts = syntax.unparsable(files, carry="repo string, ext string")
    return verdicts.groupBy("repo", "ext").agg(F.count("*").alias("n_files"), F.sum((~F.col("valid")).cast("bigint")).alias("n_invalid"), F.avg((~F.col("valid")).cast("double")).alias("rate"))


def p6_found(s, d):
    # documentation of their own only, as the statement has it
    return docpairs.documented(spread(_entities(s, d)), spread(_files(s, d)), code=False).where("not inherited").select("entity_id")


def p6_pairs(s, d):
    return docpairs.documented(spread(_entities(s, d)), spread(_files(s, d)))


def p7_containers(s, d):
    return packing.packed(_documents(s, d))


def p8_found(s, d):
    return contamination.found(_documents(s, d), _items(s, d))


def p8_leaks(s, d):
    return contamination.leaks(spread(_documents(s, d)), _items(s, d))


def p9_found(s, d):
    return truncation.found(_documents(s, d))


def p9_rates(s, d):
    return truncation.rates(_documents(s, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (p1_found, p1_groups, p2_found, p2_redacted, p3_found, p3_pieces, p4_found, p4_kinds, p5_found, p5_rates, p6_found, p6_pairs, p7_containers, p8_found, p8_leaks, p9_found, p9_rates)
    return {f.__name__: f for f in fs}


_ENTITY = "(select * from entities qualify row_number() over (partition by entity_id order by ingested_at) = 1)"


def oracle_sql() -> dict[str, str]:
    """p1 compares all pairs with a common word, exactly, and its groups are the closure of these pairs; p8 compares all runs of 13
    words. The others have no SQL."""
    return {
        "p3_found": "select distinct entity_id from entities where length(content) > 2000",
        "p1_found": f"""
            with w as (select entity_id, unnest(regexp_extract_all(lower(content), '[a-z0-9_]+')) as word from {_ENTITY} where lower(trim(entity_type)) in ('function', 'method')),
            tf as (select entity_id, word, count(*) as n from w group by all),
            size as (select entity_id, sum(n) as n from tf group by all having sum(n) >= 25),
            common as (select a.entity_id as ea, b.entity_id as eb, sum(least(a.n, b.n)) as c from tf a join tf b on a.word = b.word and a.entity_id < b.entity_id group by all)
            select ea as entity_id_a, eb as entity_id_b from common join size x on x.entity_id = ea join size y on y.entity_id = eb where 2 * c >= 0.8 * (x.n + y.n)""",
        "p1_groups": f"""
            with recursive w as (select entity_id, unnest(regexp_extract_all(lower(content), '[a-z0-9_]+')) as word from {_ENTITY} where lower(trim(entity_type)) in ('function', 'method')),
            tf as (select entity_id, word, count(*) as n from w group by all),
            size as (select entity_id, sum(n) as n, string_agg(word || ':' || n, ' ' order by word) as bag from tf group by entity_id having sum(n) >= 25),
            class as (select entity_id, n, min(entity_id) over (partition by bag) as class_id from size),
            rep as (select class_id, any_value(n) as n from class group by class_id),
            ct as (select entity_id, word, n from tf where entity_id in (select class_id from rep)),
            common as (select a.entity_id as ea, b.entity_id as eb, sum(least(a.n, b.n)) as c from ct a join ct b on a.word = b.word and a.entity_id < b.entity_id group by all),
            pair as (select ea, eb from common join rep x on x.class_id = ea join rep y on y.class_id = eb where 2 * c >= 0.8 * (x.n + y.n)),
            twoway as (select ea as a, eb as b from pair union all select eb, ea from pair),
            reach as (select class_id as a, class_id as b from rep union select r.a, t.b from reach r join twoway t on t.a = r.b),
            grp as (select a as class_id, min(b) as group_id from reach group by a),
            deg as (select a as class_id, count(*) as links from twoway group by a)
            select entity_id, group_id, class_id, coalesce(links, 0) as links from class join grp using (class_id) left join deg using (class_id)""",
        "p8_found": r"""
            with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from (select doc_id, any_value(text) as text from documents group by doc_id)),
            dg as (select doc_id, array_to_string(w[i : i + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
            t as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_items),
            tg as (select item_id, array_to_string(w[i : i + 12], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 11)) as i from t where len(w) >= 13))
            select distinct doc_id, item_id from dg join tg using (g)""",
    }
