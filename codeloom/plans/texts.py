"""Text, parsing and chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H, text as X
from ..operators import chunking as K
from ..session import latest, spread, table
from .graph import _E, _P, _entities, _files
from .registry import query
from .search import _TOKENS

_LINES = r"unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)))"


@query(r"""select doc_id, len(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'))::int as n_parts, len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z0-9]{2,}')))::int as n_tokens, length(text) // 4 as n_estimated from documents""")
def token_counts(s, d):
    return table(s, d, "documents").select("doc_id", F.size(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")).alias("n_parts"), F.size(X.tokens("text")).alias("n_tokens"), X.estimated_tokens("text").alias("n_estimated"))


@query(f"""
    with t as (select doc_id, {_TOKENS.format("text")} as ws from documents),
    f as (select doc_id, md5(unnest(ws)) as m from t),
    b as (select doc_id, i, sum(case when substring(('0x' || substring(m, 17 + 8 * (i // 32)::int, 8))::ubigint::bit::varchar, 64 - (i % 32)::int, 1) = '1' then 1 else -1 end) as v from f, range(64) r(i) group by all),
    h as (select doc_id, i // 32 as half, sum(case when v > 0 then pow(2, i % 32)::bigint else 0 end)::bigint as x from b group by all)
    select t.doc_id, coalesce(max(printf('%08x', x)) filter (half = 0), '00000000') || coalesce(max(printf('%08x', x)) filter (half = 1), '00000000') as simhash from t left join h using (doc_id) group by t.doc_id""")
def simhash64(s, d):
    return spread(table(s, d, "documents")).select("doc_id", H.simhash_bits(X.tokens("text")).alias("simhash"))


@query(f"""
    with a as (select entity_id, file_id, name, list_distinct({_TOKENS.format("content")}) as ws from {_E}), f as (select file_id, min(entity_id) as m from a group by file_id)
    select x.entity_id, round(case when len(list_distinct(list_concat(x.ws, y.ws))) = 0 then 1 else len(list_intersect(x.ws, y.ws)) / len(list_distinct(list_concat(x.ws, y.ws))) end, 6) as jaccard from a x join f using (file_id) join a y on y.entity_id = f.m""")
def jaccard_to_first(s, d):
    a = _entities(s, d).select("entity_id", "file_id", F.array_distinct(X.tokens("content")).alias("ws"))
    first = a.groupBy("file_id").agg(F.min_by("ws", "entity_id").alias("other"))
    return a.join(first, "file_id").select("entity_id", F.round(H.jaccard("ws", "other", 1.0), 6).alias("jaccard"))


@query(f"""select entity_id, sha256(content) as hash, substring(sha256(content), 1, 16) as id from {_E}""")
def content_hashes(s, d):
    return _entities(s, d).select("entity_id", H.content_hash("content").alias("hash"), H.short_id("content").alias("id"))


@query(r"""
    with b as (select doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) as ls from documents),
    c as (select doc_id, i::int as block, array_to_string(ls[i * 10 + 1 : i * 10 + 10], chr(10)) as t from (select doc_id, ls, unnest(range(0, ((len(ls) + 9) // 10)::int)) as i from b))
    select doc_id, block, length(t)::int as n_chars, md5(t) as hash from c""")
def chunk_fixed_lines(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(K.line_blocks("text", 10, 10_000_000)).alias("block", "t")).select("doc_id", "block", F.length("t").alias("n_chars"), F.md5("t").alias("hash"))


@query(r"""
    with b as (select doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10) || chr(10)) as ps from documents),
    c as (select doc_id, i::int as i, ps[i] as x, ps[i - 1] as y from (select doc_id, ps, unnest(range(1, len(ps) + 1)) as i from b))
    select doc_id, i - 1 as piece, md5(case when i = 1 then x else right(y, 200) || x end) as hash from c""")
def chunk_overlap(s, d):
    pieces = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n\n")
    return table(s, d, "documents").select("doc_id", pieces.alias("p")).select("doc_id", F.posexplode(K.with_overlap("p", 200)).alias("piece", "t")).select("doc_id", "piece", F.md5("t").alias("hash"))


_HEADINGS = r"""
    l as (select doc_id, i::int as line_no, ls[i] as line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) as ls from documents))),
    f as (select *, coalesce(sum(starts_with(line, '```')::int) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as fences from l),
    h as (select doc_id, line_no, length(regexp_extract(line, '^(#+)', 1))::int as level, trim(regexp_replace(line, '^#+ +', '')) as title from f where fences % 2 = 0 and regexp_matches(line, '^#{1,6} +\S'))"""


@query(f"with {_HEADINGS} select doc_id, line_no, level, title from h")
def markdown_headers(s, d):
    return K.headings(table(s, d, "documents"), "doc_id", "text")


@query(f"""with {_HEADINGS}, p as (select a.doc_id, a.line_no, a.level, b.level as bl, b.title as bt, row_number() over (partition by a.doc_id, a.line_no, b.level order by b.line_no desc) as k, b.line_no as bn
      from h a join h b on a.doc_id = b.doc_id and b.line_no <= a.line_no and b.level <= a.level and (b.level < a.level or b.line_no = a.line_no)),
    q as (select * from p where k = 1 and not exists (select 1 from h c where c.doc_id = p.doc_id and c.line_no > p.bn and c.line_no <= p.line_no and c.level < p.bl))
    select doc_id, line_no, level, string_agg(bt, ' > ' order by bl) as path from q group by doc_id, line_no, level""")
def section_paths(s, d):
    return K.section_paths(K.headings(table(s, d, "documents"), "doc_id", "text"), "doc_id")


@query(f"""with {_HEADINGS}, a as (select level, avg(length(title)) as size, count(*) as n from h group by level)
    select level, n, round(size, 6) as avg_len, round(size / lead(size) over (order by level), 6) as ratio from a""")
def heading_scale(s, d):
    from pyspark.sql import Window

    h = K.headings(table(s, d, "documents"), "doc_id", "text").groupBy("level").agg(F.avg(F.length("title")).alias("size"), F.count("*").alias("n"))
    # at most six rows, one per level
    return h.select("level", "n", F.round("size", 6).alias("avg_len"), F.round(F.col("size") / F.lead("size").over(Window.orderBy("level")), 6).alias("ratio"))


@query()
def section_packing(s, d):
    pieces = F.filter(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n\n"), lambda x: F.length(x) > 0)
    return table(s, d, "documents").select("doc_id", F.posexplode(K.pack_sections(pieces, 850, 10)).alias("chunk", "t")).select("doc_id", "chunk", F.length("t").alias("n_chars"))


@query(r"""select doc_id, length(x)::int as n_chars, md5(x) as hash from (select doc_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<\?php.*?\?>', '', 'g'), '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</p>', chr(10), 'g'), '(?i)<li[^>]*>', '- ', 'g'), '<[^>]+>', '', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) as x from documents)""")
def markup_strip(s, d):
    return table(s, d, "documents").select("doc_id", X.strip_markup("text").alias("x")).select("doc_id", F.length("x").alias("n_chars"), F.md5("x").alias("hash"))


@query(rf"""select entity_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(content, '(?s)/\*.*?\*/', ' ', 'g'), '(?m)(?:#|//).*$', ' ', 'g'), '\s+', ' ', 'g'))) as hash from {_E}""")
def code_normalise(s, d):
    return _entities(s, d).select("entity_id", F.md5(X.normalise_code("content")).alias("hash"))


@query(rf"""select entity_id, md5(regexp_replace(regexp_replace(content, '"[^"\n]*"|''[^''\n]*''', 'STR', 'g'), '\b[0-9]+(?:\.[0-9]+)?\b', 'NUM', 'g')) as hash from {_E}""")
def literal_masking(s, d):
    return latest(table(s, d, "entities").select("entity_id", F.md5(X.mask_literals("content")).alias("hash")), "entity_id")


@query(f"""select entity_id, name, case when regexp_matches(name, '^[a-z][a-z0-9]*(_[a-z0-9]+)*$') then 'snake' when regexp_matches(name, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$') then 'upper' when regexp_matches(name, '^[A-Z][A-Za-z0-9]*$') then 'pascal'
    when regexp_matches(name, '^[a-z][A-Za-z0-9]*$') then 'camel' else 'other' end as style from {_E}""")
def naming_styles(s, d):
    return _entities(s, d).select("entity_id", "name", X.naming_style("name").alias("style"))


@query(rf"""
    with c as (select entity_id, array_to_string(list_filter(string_split(content, chr(10)), lambda x: not regexp_matches(x, '^\s*(#|//|\*)')), chr(10)) as b from {_E} where content is not null)
    select entity_id, (1 + len(regexp_extract_all(b, '\b(?:if|elif|for|while|case|catch|except)\b')) + len(regexp_extract_all(b, '&&|\|\||\band\b|\bor\b')))::int as complexity from c""")
def cyclomatic_complexity(s, d):
    return latest(table(s, d, "entities").where("content is not null").select("entity_id", X.complexity("content").alias("complexity")), "entity_id")


@query(rf"""
    with c as (select entity_id, list_filter(string_split(content, chr(10)), lambda x: not regexp_matches(x, '^\s*(def|class|func|function)\b')) as ls from {_E} where content is not null)
    select entity_id, array_to_string(list_sort(list_distinct(list_filter(flatten(list_transform(ls, lambda x: regexp_extract_all(x, '([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1))), lambda w: w not in ('if', 'for', 'while', 'return', 'switch', 'catch', 'and', 'or', 'not', 'in', 'elif', 'with')))), ',') as calls from c""")
def call_extraction(s, d):
    return _entities(s, d).where("content is not null").select("entity_id", F.array_join(X.called_names("content"), ",").alias("calls"))


@query(rf"""select file_id, string_split(file_path, '/')[-1] as base, lower(regexp_extract(string_split(file_path, '/')[-1], '(\.[^.]+)$', 1)) as ext, regexp_replace(file_path, '^\./', '') as clean from {_P}""")
def path_parts(s, d):
    return _files(s, d).select("file_id", X.base_name("file_path").alias("base"), X.extension("file_path").alias("ext"), X.clean_path("file_path").alias("clean"))


@query(r"""select repo, regexp_replace(regexp_replace(regexp_replace(lower(repo || ' ' || collection), '[^a-z0-9_-]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') || '_' || substring(sha256(repo), 1, 6) as name from repos""")
def collection_names(s, d):
    return table(s, d, "repos").select("repo", X.collection_name(F.concat_ws(" ", "repo", "collection"), "repo").alias("name"))


_NAMES = r"'([A-Za-z_][\w.]*)'"


@query(rf"""
    with l as (select file_id, unnest(string_split(content, chr(10))) as line from {_P} where lower(file_path) like '%.ini')
    select file_id, count(*) filter (regexp_matches(line, '^\[[^\]]+\]')) as n_sections, count(*) filter (regexp_matches(line, '^[^#;\[=\s][^=]*=')) as n_keys from l group by file_id""")
def ini_parse(s, d):
    from ..sources.parsers import ini_keys

    k = ini_keys(_files(s, d).where("lower(file_path) like '%.ini'"))
    return k.groupBy("file_id").agg(F.count(F.when(F.col("kind") == "section", 1)).alias("n_sections"), F.count(F.when(F.col("kind") == "key", 1)).alias("n_keys"))


@query(rf"""
    with j as (select file_id, content::json as j from {_P} where lower(file_path) like '%.json' and json_valid(content) and not regexp_matches(content, 'NaN|Infinity'))
    select file_id, unnest(json_keys(j)) as key from j where json_type(j) = 'OBJECT'""")
def json_top_keys(s, d):
    from ..sources.parsers import json_keys

    return json_keys(_files(s, d).where("lower(file_path) like '%.json'")).select("file_id", "key")


@query(rf"""
    with j as (select file_id, content::json as j from {_P} where lower(file_path) like '%.json' and json_valid(content))
    select file_id, unnest(json_keys(j, '$.packages')) as package from j where json_type(j) = 'OBJECT' and json_type(j, '$.packages') = 'OBJECT'""")
def package_dependencies(s, d):
    from ..sources.parsers import json_map

    return json_map(_files(s, d).where("lower(file_path) like '%.json'"), "packages").select("file_id", F.col("key").alias("package"))


@query(rf"""
    with l as (select file_id, unnest(string_split(content, chr(10))) as line from {_P} where regexp_matches(lower(file_path), '\.(js|ts)$'))
    select file_id, count(*) filter (regexp_matches(line, '^import .* from ')) as n_imports, count(*) filter (regexp_matches(line, '= require\(')) as n_requires, count(*) filter (regexp_matches(line, '^(export )?(default )?(abstract )?class \w+')) as n_classes from l group by file_id""")
def script_relations(s, d):
    lines = _files(s, d).where(F.lower("file_path").rlike(r"\.(js|ts)$") & F.col("content").isNotNull()).select("file_id", F.explode(F.split("content", "\n")).alias("line"))
    n = lambda rx: F.count(F.when(F.col("line").rlike(rx), 1))
    return lines.groupBy("file_id").agg(n("^import .* from ").alias("n_imports"), n(r"= require\(").alias("n_requires"), n(r"^(export )?(default )?(abstract )?class \w+").alias("n_classes"))


@query()
def python_entities(s, d):
    from ..sources.parsers import python_symbols

    return python_symbols(_files(s, d).where("lower(file_path) like '%.py'"))


@query(r"""
    with f as (select doc_id, unnest(regexp_extract_all(text, '(?m)^```([a-z]+)', 1)) as lang from documents),
    c as (select d.source, f.lang, count(*) as n from f join documents d using (doc_id) where f.lang not in ('shell', 'text', 'sh') group by all)
    select source, arg_max(lang, (n, lang)) as lang, sum(n)::bigint as n from c group by source""")
def chat_language(s, d):
    docs = table(s, d, "documents")
    c = docs.select("source", F.explode(F.regexp_extract_all("text", F.lit("(?m)^```([a-z]+)"), F.lit(1))).alias("lang")).where("lang not in ('shell', 'text', 'sh')").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return c.groupBy("source").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"), F.sum("n").alias("n"))


@query(r"""
    with m as (select doc_id, repo, unnest(regexp_extract_all(text, '(?m)^(assistant|user): ', 1)) as role from documents where source = 'chat_summary')
    select repo, role, count(*) as n_turns, count(distinct doc_id) as n_chats from m group by repo, role""")
def chat_metadata(s, d):
    m = table(s, d, "documents").where("source = 'chat_summary'").select("doc_id", "repo", F.explode(F.regexp_extract_all("text", F.lit("(?m)^(assistant|user): "), F.lit(1))).alias("role"))
    return m.groupBy("repo", "role").agg(F.count("*").alias("n_turns"), F.countDistinct("doc_id").alias("n_chats"))


@query(r"""select doc_id, case when regexp_matches(lower(text), 'error|exception|traceback|crash|fail') then 'debugging' when regexp_matches(lower(text), 'deploy|release|migration') then 'operations'
    when regexp_matches(lower(text), 'test|assert') then 'testing' when regexp_matches(lower(text), 'how|why|what') then 'question' else 'implementation' end as category from documents""")
def chat_category(s, d):
    return table(s, d, "documents").select("doc_id", X.intent("text").alias("category"))


@query(r"""select doc_id, unnest(regexp_extract_all(text, 'https?://[^\s)<>"]+')) as url from documents""")
def link_extraction(s, d):
    return table(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r'https?://[^\s)<>"]+'), F.lit(0))).alias("url"))
