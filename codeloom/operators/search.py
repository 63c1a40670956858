"""Ranked search: dense vectors, keywords, and their fusion."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..session import ensure_checkpoint_dir

#: Queries that are compared with all rows at once; the bound of what is broadcast.
BLOCK = 2048


def _scores(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Higher is nearer."""
    if metric == "dot":
        return q @ x.T
    if metric == "euclidean":
        return -np.sqrt(np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * q @ x.T, 0))
    nq, nx = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (q @ x.T) / (nq[:, None] * nx[None, :])
    return np.clip(np.nan_to_num(s), 0, 1)


def vectors_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values, from the column's own buffers, of the vectors of a width that hold no null."""
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    good = column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(offsets) == width)
    values = column.values
    flat = values.to_numpy(zero_copy_only=False)
    if values.null_count:
        holes = np.cumsum(np.r_[0, values.is_null().to_numpy(zero_copy_only=False)])
        good &= holes[offsets[1:]] == holes[offsets[:-1]]
    keep = np.flatnonzero(good)
    if not len(keep):
        return keep, np.zeros((0, width))
    return keep, np.asarray(flat[offsets[:-1][keep][:, None] + np.arange(width)], np.float64)


def dense_search(points: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", where: Column | None = None, threshold: float | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k nearest points of every query, exactly.

    Queries are worked off in blocks of fixed size; each partition keeps its own k best of a query before anything is
    shuffled. Vectors of another length than the query's, null and empty ones are passed over; ties go to the
    smaller key. `where` filters points before scoring.
    """
    spark = points.sparkSession
    points = points if where is None else points.where(where)
    out = f"query_id bigint, {key} bigint, score double"
    schema = pa.schema([("query_id", pa.int64()), (key, pa.int64()), ("score", pa.float64())])

    def block(rows: list) -> DataFrame:
        ids = np.array([r[0] for r in rows], np.int64)
        q = np.array([r[1] for r in rows], np.float64)
        shared = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, qv = shared.value
            best_s = np.full((len(qid), 0), -np.inf)
            best_k = np.zeros((len(qid), 0), np.int64)
            for b in batches:
                keep, x = vectors_of(b.column(1), qv.shape[1])
                if not len(keep):
                    continue
                mine, s = b.column(0).to_numpy()[keep], _scores(metric, qv, x)
                if s.shape[1] > 4 * k:  # all that reach the k-th best score stay, so that ties are settled below
                    least = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                    some = (s >= least[:, None]).any(axis=0)
                    mine, s = mine[some], s[:, some]
                ks = np.broadcast_to(mine, (len(qid), len(mine)))
                s = np.concatenate([best_s, s], axis=1)
                ks = np.concatenate([best_k, ks], axis=1)
                order = np.lexsort((ks, -s), axis=1)[:, :k]
                best_s, best_k = np.take_along_axis(s, order, 1), np.take_along_axis(ks, order, 1)
            n = best_s.shape[1]
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, n)), pa.array(best_k.ravel()), pa.array(best_s.ravel())], schema=schema)

        return points.select(key, vector).mapInArrow(run, out)

    parts, rows = [], []
    for r in queries.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(key, vector).toLocalIterator():
        rows.append((r[0], r[1]))
        if len(rows) == BLOCK:
            parts.append(block(rows))
            rows = []
    if rows or not parts:
        parts.append(block(rows) if rows else spark.createDataFrame([], out))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    if threshold is not None:
        found = found.where(F.col("score") >= threshold)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def document_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, n_terms): the terms of every document; documents without terms give no row."""
    words = docs.select(key, X.tokens(text).alias("ws"))
    return words.select(key, F.size("ws").alias("n_terms"), F.explode("ws").alias("term")).groupBy(key, "term", "n_terms").agg(F.count("*").alias("tf"))


def document_frequency(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, df): in how many documents each term occurs."""
    return docs.select(key, F.explode(F.array_distinct(X.tokens(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


#: Different terms of all queries together that are looked up in one reading of the documents; more are worked off in parts.
MOST_TERMS = 100_000
# as functions.text.tokens has them
_TOKEN = re.compile(r"(?<!\w)[a-z0-9]{2,}(?!\w)")
_HITS = "doc_id bigint, term string, tf bigint, n_terms bigint"


def _term_hits(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """(doc_id, term, tf, n_terms): the wanted terms of every document, and without a term the number of documents and of their
    terms in a batch. Each text is read and cut into words once, and only wanted words leave the map."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        for b in batches:
            rows, total = [], 0
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = _TOKEN.findall(text.lower()) if text else []
                total += len(words)
                rows.extend((key, t, n, len(words)) for t, n in Counter(w for w in words if w in terms).items())
            rows.append((None, None, b.num_rows - b.column(1).null_count, total))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["doc_id", "term", "tf", "n_terms"])

    return docs.select("doc_id", "text").mapInArrow(run, _HITS)


def keyword_search(docs: DataFrame, queries: DataFrame, k: int, scoring: str = "idf", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank) for queries (query_id, query) over documents (doc_id, text).

    scoring `idf` sums squared inverse document frequencies of the common terms, max(0, ln((N - df + .5) / (df + .5))) each;
    `bm25` is the usual formula. The documents are read once per MOST_TERMS different query terms; what they hold of
    these is written to the checkpoint folder, and frequencies, lengths and scores come from that. N counts rows; a
    null text has no terms and is left out of the average length. Ties go to the smaller doc_id.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    terms = queries.select("query_id", F.explode(F.array_distinct(X.tokens("query"))).alias("term"))
    parts, some = [], []
    for r in terms.select("term").distinct().toLocalIterator():
        some.append(r[0])
        if len(some) == MOST_TERMS:
            parts.append(_term_hits(docs, some))
            some = []
    if some or not parts:
        parts.append(_term_hits(docs, some))
    # rows without a term stand in every part alike, and only those of the first are counted
    hits = reduce(DataFrame.unionByName, [p if i == 0 else p.where("term is not null") for i, p in enumerate(parts)]).checkpoint()
    size = hits.where("term is null").agg(F.sum("tf").alias("docs"), F.sum("n_terms").alias("terms")).first()
    n, avg_len = float(size["docs"] or 0), (size["terms"] or 0) / (size["docs"] or 1) or 1.0
    hits = hits.where("term is not null")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    if scoring == "idf":
        idf = F.greatest(F.lit(0.0), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        weight = F.col("idf") * F.col("idf")
    else:
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_terms") / avg_len))
    # the queries' terms with their weights are few against the hits; a hot term's hits are spread by the adaptive skew join
    weighed = terms.join(df.select("term", idf.alias("idf")).where("idf > 0"), "term")
    scored = hits.join(weighed, "term").groupBy("query_id", "doc_id").agg(F.sum(weight).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return scored.where(F.col("score") > 0).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(dense: DataFrame, sparse: DataFrame, limit: int, alpha: float = 0.7, k: int = 60, threshold: float | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): reciprocal rank fusion of two ranked lists (query_id, doc_id, rank).

    A side that misses a document adds nothing; the threshold applies to the fused score; ties go to the smaller id.
    """
    both = dense.select("query_id", "doc_id", F.col("rank").alias("rd")).join(sparse.select("query_id", "doc_id", F.col("rank").alias("rs")), ["query_id", "doc_id"], "full")
    score = F.coalesce(F.lit(alpha) / (k + F.col("rd")), F.lit(0.0)) + F.coalesce(F.lit(1 - alpha) / (k + F.col("rs")), F.lit(0.0))
    fused = both.select("query_id", "doc_id", score.alias("score"))
    if threshold is not None:
        fused = fused.where(F.col("score") >= threshold)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "doc_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
