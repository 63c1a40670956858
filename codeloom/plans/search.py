"""Search queries: every vector whose id is divisible by 20, and every evaluation item whose id is, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X, vector as V
from ..operators import search as S
from ..session import spread, table
from .registry import query

K, OVERFETCH = 10, 50
_TOKENS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z0-9]{{2,}}'))"
_VEC = "embedding::double[]"


def _knn_sql(score: str, k: int = K, where: str = "true", threshold: str = "true") -> str:
    return f"""
        with q as (select vec_id as query_id, {_VEC} as qv from embeddings where vec_id % 20 = 0),
        p as (select vec_id, {_VEC} as pv from embeddings where {where}),
        s as (select query_id, vec_id, {score} as score from q, p),
        r as (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from s where {threshold})
        select query_id, vec_id, round(score, 6) as score, rank::int as rank from r where rank <= {k}"""


_COS = "greatest(0, least(1, list_dot_product(qv, pv) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(pv, pv)))))"


def _knn(s, d, **how):
    e = table(s, d, "embeddings")
    return S.dense_search(e, e.where("vec_id % 20 = 0"), K, **how).withColumn("score", F.round("score", 6))


@query(_knn_sql(_COS))
def dense_topk_cosine(s, d):
    return _knn(s, d)


@query(_knn_sql("list_dot_product(qv, pv)"))
def dense_topk_dot(s, d):
    return _knn(s, d, metric="dot")


@query(_knn_sql("0 - list_distance(qv, pv)"))
def dense_topk_euclidean(s, d):
    return _knn(s, d, metric="euclidean")


@query(_knn_sql(_COS, where="label = 1", threshold="score >= 0.1"))
def dense_topk_filtered(s, d):
    return _knn(s, d, where=F.col("label") == 1, threshold=0.1)


@query(f"""
    with t as (select doc_id, {_TOKENS.format("text")} as ws from documents)
    select term, count(*) as df from (select distinct doc_id, unnest(ws) as term from t) group by term""")
def document_frequency(s, d):
    return S.document_frequency(table(s, d, "documents"), "doc_id", "text")


@query(f"""
    with t as (select len({_TOKENS.format("text")}) as n from documents)
    select count(*) as n_docs, sum(n)::bigint as n_terms, round(avg(n), 6) as avg_terms, min(n)::int as min_terms, max(n)::int as max_terms from t""")
def corpus_stats(s, d):
    n = F.size(X.tokens("text"))
    return table(s, d, "documents").select(n.alias("n")).agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_terms"), F.round(F.avg("n"), 6).alias("avg_terms"), F.min("n").alias("min_terms"), F.max("n").alias("max_terms"))


def _keyword_sql(weight: str, idf: str, k: int) -> str:
    return f"""
        with t as (select doc_id, {_TOKENS.format("text")} as ws from documents),
        q as (select item_id as query_id, unnest(list_distinct({_TOKENS.format("text")})) as term from eval_items where item_id % 20 = 0),
        tf as (select doc_id, len(ws) as n_terms, term, count(*) as tf from (select doc_id, ws, unnest(ws) as term from t) group by all),
        c as (select count(*)::double as n, avg(len(ws)) as avg_len from t),
        df as (select term, count(*) as df from tf where term in (select term from q) group by term),
        i as (select term, {idf} as idf from df, c),
        s as (select query_id, doc_id, sum({weight}) as score from tf join i using (term) join q using (term), c group by all),
        r as (select query_id, doc_id, score, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from s where score > 0)
        select query_id, doc_id, round(score, 6) as score, rank::int as rank from r where rank <= {k}"""


def _items(s, d):
    return table(s, d, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(_keyword_sql("idf * idf", "greatest(0, ln((n - df + 0.5) / (df + 0.5)))", K))
def sparse_idf_topk(s, d):
    return S.keyword_search(spread(table(s, d, "documents")), _items(s, d), K).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(_keyword_sql("idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms / avg_len))", "ln(1 + (n - df + 0.5) / (df + 0.5))", K))
def bm25_topk(s, d):
    return S.keyword_search(spread(table(s, d, "documents")), _items(s, d), K, "bm25").select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _hybrid(s, d, alpha, threshold=None):
    e = table(s, d, "embeddings")
    docs = spread(table(s, d, "documents"))
    wanted = _items(s, d)
    # documents and vectors share their ids by convention
    q = e.join(wanted.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi")
    dense = S.dense_search(e, q, OVERFETCH).withColumnRenamed("vec_id", "doc_id")
    sparse = S.keyword_search(docs, wanted, OVERFETCH)
    return S.fuse(dense, sparse, K, alpha, threshold=threshold).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


def _hybrid_sql(alpha: float, threshold: str = "true") -> str:
    knn = _knn_sql(_COS, OVERFETCH).replace("where vec_id % 20 = 0", "where vec_id in (select item_id from eval_items where item_id % 20 = 0)")
    words = _keyword_sql("idf * idf", "greatest(0, ln((n - df + 0.5) / (df + 0.5)))", OVERFETCH)
    return f"""
        with dense as ({knn}), sparse as ({words}),
        f as (select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.vec_id, b.doc_id) as doc_id,
                     coalesce({alpha} / (60 + a.rank), 0) + coalesce((1 - {alpha}) / (60 + b.rank), 0) as score
              from dense a full join sparse b on a.query_id = b.query_id and a.vec_id = b.doc_id),
        r as (select *, row_number() over (partition by query_id order by round(score, 12) desc, doc_id) as rank from f where {threshold})
        select query_id, doc_id, round(score, 9) as score, rank::int as rank from r where rank <= {K}"""


@query(_hybrid_sql(0.7))
def hybrid_rrf_topk(s, d):
    return _hybrid(s, d, 0.7)


@query(_hybrid_sql(0.5, "score >= 0.008"))
def hybrid_rrf_threshold(s, d):
    return _hybrid(s, d, 0.5, 0.008)


@query(f"""
    with c as (select label, list_aggregate(list(v), 'sum') as x from (select 1 as v, label from embeddings) group by label),
    a as (select vec_id, label, {_VEC} as v from embeddings)
    select x.vec_id, x.label, round(list_dot_product(x.v, y.v), 5) as dot, round(greatest(0, least(1, list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))))), 6) as cosine,
           round(list_distance(x.v, y.v), 5) as distance
    from a x join (select label, min(vec_id) as m from embeddings group by label) k on x.label = k.label join a y on y.vec_id = k.m""")
def vector_functions(s, d):
    e = table(s, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("other"))
    return e.join(first, "label").select("vec_id", "label", F.round(V.dot("embedding", "other"), 5).alias("dot"), F.round(V.cosine("embedding", "other"), 6).alias("cosine"), F.round(V.euclidean("embedding", "other"), 5).alias("distance"))
