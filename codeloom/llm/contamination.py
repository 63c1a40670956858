"""Evaluation texts leaking into training text (problem 8).

Method: latent semantic retrieval. Documents and evaluation items are cut into passages of words, weighed by TF-IDF over a
hashed vocabulary of fixed size, with frequencies counted over all documents. A randomised SVD gives the latent space;
it is fitted on the passages of a sample of documents of at most about `SAMPLE_WORDS` words (all, if there are fewer), so
that its partial products are bounded, whatever the corpus. The items' passages are an inverted file in that space:
cells around centroids. Every passage of every document is projected, looks into its `PROBES` nearest cells, and is a
candidate for an item of which a passage there is as near as `cosine`. Only candidates are compared by their text: by runs
of consecutive words in common (a leak, from `run` words on), or, for paraphrases, by the longest common subsequence
and the presence of the answer.

Windows of documents are wider than those of items by more than their step, so every run of `run` words lies wholly
within one window. The evaluation set does not grow with the corpus; its size is checked before it is broadcast, and
a larger set is worked off in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ensure_checkpoint_dir, spread
from .common import schema_of
from .neardup import _lists, _mix

RUN = 13
SLOTS = 1 << 14
RANK, OVERSAMPLE = 96, 16
DOC_WINDOW, DOC_STEP = 26, 13
ITEM_STEP = 3
#: A passage is twice as wide as an item's, so even one that holds it whole comes to about 0.7.
COSINE, PARAPHRASE_COSINE, SUBSEQUENCE = 0.35, 0.45, 0.6
#: Item windows that are searched at once; the bound of what is broadcast is this times RANK floats (4 MB).
MOST_WINDOWS = 10_000
#: Words of the documents on which the space is fitted, at most about so many, in so many partitions.
SAMPLE_WORDS, SAMPLE_PARTS = 2_000_000, 16
#: Cells of the items' passages, and how many of them a passage looks into.
CELLS, PROBES = 64, 16

_PART = schema_of("block int, data binary")
_HIT = schema_of("doc_id bigint, item_id bigint, kind string, run int, cosine double")


def words_of(text: str | Column) -> Column:
    """Hashes of the runs of letters and digits of the lower-cased text, in order."""
    return F.transform(F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


def _windows(offsets: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the windows over concatenated word lists; the last one of a list reaches its end."""
    n = np.diff(offsets)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - width) // step)), 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[row] + k * step
    return row, start, np.minimum(start + width, offsets[row + 1])


def _slots(words: np.ndarray) -> np.ndarray:
    return (_mix(words.astype(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _project(words: np.ndarray, start: np.ndarray, end: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sums of the basis rows of each window's words."""
    # windows overlap, and reduceat wants pairs of bounds: every second sum is of a window
    bounds = np.empty(2 * len(start), np.int64)
    bounds[0::2], bounds[1::2] = start, end
    rows = np.zeros((len(words) + 1, basis.shape[1]), np.float32)
    np.take(basis, _slots(words), axis=0, out=rows[:-1])
    return np.add.reduceat(rows, bounds, axis=0)[0::2]


def _project_passages(words: np.ndarray, offsets: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """_project of the documents' own passages: these are two steps wide, so sums over single steps are taken once and added in pairs."""
    n = np.diff(offsets)
    steps = -(-n // DOC_STEP)
    first = np.cumsum(steps) - steps
    k = np.arange(int(steps.sum())) - np.repeat(first, steps)
    at = np.repeat(offsets[:-1], steps) + k * DOC_STEP
    sums = np.add.reduceat(np.take(basis, _slots(words), axis=0), at, axis=0) if len(at) else np.zeros((0, basis.shape[1]), np.float32)
    mine = first[row] + (start - offsets[row]) // DOC_STEP
    out = sums[mine]
    two = end - start > DOC_STEP
    out[two] += sums[mine[two] + 1]
    return out


class Space(NamedTuple):
    basis: np.ndarray  # SLOTS x RANK, rows weighed by the inverse document frequency


def _chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about so many words, a long row alone."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def _gram_pass(factor, idf):
    """The partition's part of A'A Q: passages that do not overlap, each scaled to length one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, w = factor.value, idf.value
        weighed = (q * w[:, None]).astype(np.float32)
        out = np.zeros((SLOTS, q.shape[1]), np.float64)
        for batch in batches:
            words, offsets = _lists(batch.column(1))
            for i, j in _chunks(offsets, 60_000):
                part, off = words[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if not len(part):
                    continue
                _, start, end = _windows(off, DOC_WINDOW, DOC_WINDOW)
                slot = _slots(part)
                norm = np.sqrt(np.maximum(np.add.reduceat(w[slot] ** 2, start), 1e-12))
                y = np.add.reduceat(weighed[slot], start, axis=0) / norm[:, None] ** 2
                back = np.repeat(y, end - start, axis=0) * w[slot][:, None]
                order = np.argsort(slot, kind="stable")
                s = slot[order]
                first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                out[s[first]] += np.add.reduceat(back[order], first, axis=0)
        size = SLOTS // 32
        for b in range(32):
            block = out[b * size : (b + 1) * size]
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([block.astype(np.float32).tobytes()], pa.binary())], schema=to_arrow_schema(_PART))

    return run


def _sum_blocks(parts: DataFrame, width: int) -> np.ndarray:
    """Sums of the SAMPLE_PARTS partitions' blocks; 32 rows of fixed size reach the driver."""

    def total(pdf):
        import pandas as pd

        acc = np.zeros(SLOTS // 32 * width, np.float64)
        for d in pdf["data"]:
            acc += np.frombuffer(d, np.float32)
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "data": [acc.astype(np.float32).tobytes()]})

    out = np.zeros((SLOTS, width), np.float64)
    size = SLOTS // 32
    for row in parts.groupBy("block").applyInPandas(total, "block int, data binary").collect():
        out[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["data"], np.float32).reshape(size, width)
    return out


def fit(words: DataFrame, rank: int = RANK, seed: int = 5, sample_words: int = SAMPLE_WORDS) -> Space:
    """The latent space of (doc_id, words): one power step and a projected eigenproblem over a sample of the documents."""
    sc = words.sparkSession.sparkContext

    def slots(batches):
        # a document counts once for each slot; a batch is counted before anything is shuffled
        for b in batches:
            values, offsets = _lists(b.column(0))
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            once = np.unique(doc * SLOTS + _slots(values)) % SLOTS
            s, n = np.unique(once, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[s, -1]), pa.array(np.r_[n, len(offsets) - 1]), pa.array(np.r_[np.zeros(len(s), np.int64), len(values)])], names=["s", "n", "w"])

    table = words.select("words").mapInArrow(slots, "s bigint, n bigint, w bigint").groupBy("s").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).toPandas()
    total = table[table["s"] < 0]
    docs, size = (max(1, int(total["n"].iloc[0])), int(total["w"].iloc[0])) if len(total) else (1, 0)
    table = table[table["s"] >= 0]
    df = np.zeros(SLOTS)
    df[table["s"].to_numpy(dtype=np.int64)] = table["n"].to_numpy()
    idf = np.log1p(docs / np.maximum(df, 1.0)).astype(np.float64)
    weights = sc.broadcast(idf)
    share = min(1.0, sample_words / max(1, size))
    sample = words.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))).repartition(SAMPLE_PARTS, "doc_id").checkpoint()
    width = rank + OVERSAMPLE
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((SLOTS, width)))[0]
    for last in (False, True):
        b = _sum_blocks(sample.mapInArrow(_gram_pass(sc.broadcast(q.astype(np.float32)), weights), _PART), width)
        if not last:
            q = np.linalg.qr(b)[0]
    value, vector = np.linalg.eigh((q.T @ b + b.T @ q) / 2)
    top = np.argsort(value)[::-1][:rank]
    # directions of unit variance: the few strongest would else drown what tells passages apart
    basis = (q @ vector[:, top]) / np.sqrt(np.maximum(value[top], 1e-9))
    return Space((basis * idf[:, None]).astype(np.float32))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _grams(words: np.ndarray, run: int) -> np.ndarray:
    """A hash of every run of so many words, by its first position."""
    n = len(words) - run + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(run):
            out = out * np.uint64(0x9E3779B97F4A7C15) + _mix(words[k : k + n].astype(np.uint64))
    return out


def longest_run(a: np.ndarray, b: np.ndarray) -> int:
    """The longest run of words in common."""
    best = 0
    prev = np.zeros(len(b) + 1, np.int64)
    for x in a:
        cur = np.zeros(len(b) + 1, np.int64)
        cur[1:] = np.where(b == x, prev[:-1] + 1, 0)
        best = max(best, int(cur.max()))
        prev = cur
    return best


def longest_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence."""
    prev = np.zeros(len(b) + 1, np.int64)
    for x in a:
        cur = prev.copy()
        np.maximum(cur[1:], np.where(b == x, prev[:-1] + 1, 0), out=cur[1:])
        prev = np.maximum.accumulate(cur)
    return int(prev[-1])


class Items(NamedTuple):
    ids: np.ndarray
    words: list[np.ndarray]
    answers: list[np.ndarray]
    owner: np.ndarray  # item index per window, by cell
    vectors: np.ndarray  # windows by cell
    cells: np.ndarray  # where each cell begins, and the end
    centroids: np.ndarray


def inverted_file(vectors: np.ndarray, cells: int = CELLS, rounds: int = 8, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, bounds, centroids): the vectors' order by cell, where each cell begins, and the cells' centroids (spherical k-means)."""
    k = max(1, min(cells, len(vectors)))
    centroids = vectors[np.random.default_rng(seed).choice(len(vectors), k, replace=False)]
    for _ in range(rounds):
        cell = (vectors @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, vectors)
        centroids = np.where(np.bincount(cell, minlength=k)[:, None] > 0, _unit(sums), centroids)
    cell = (vectors @ centroids.T).argmax(axis=1)
    order = np.argsort(cell, kind="stable")
    return order, np.searchsorted(cell[order], np.arange(k + 1)), centroids


def candidates(it: Items, unit: np.ndarray, cosine: float, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, cosine) of the pairs that reach the cosine in one of the passage's nearest cells, the best of each pair."""
    near = unit @ it.centroids.T
    k = min(probes, near.shape[1])
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    cell, passage = top.ravel(), np.repeat(np.arange(len(unit)), k)
    by = np.argsort(cell, kind="stable")
    passage, bounds = passage[by], np.searchsorted(cell[by], np.arange(near.shape[1] + 1))
    rows, items, cos = [], [], []
    for c in range(near.shape[1]):
        mine, a, b = passage[bounds[c] : bounds[c + 1]], it.cells[c], it.cells[c + 1]
        if a == b or not len(mine):
            continue
        score = unit[mine] @ it.vectors[a:b].T
        flat = np.flatnonzero(score.ravel() >= cosine)
        if not len(flat):
            continue
        r, v = np.divmod(flat, b - a)
        rows.append(mine[r])
        items.append(it.owner[a + v])
        cos.append(score.ravel()[flat])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    r, i, c = np.concatenate(rows), np.concatenate(items), np.concatenate(cos)
    order = np.lexsort((-c, i, r))
    r, i, c = r[order], i[order], c[order]
    first = np.r_[True, (r[1:] != r[:-1]) | (i[1:] != i[:-1])] if len(r) else np.zeros(0, bool)
    return r[first], i[first], c[first]


def _search(items, space, run: int, cosine: float, paraphrases: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it: Items = items.value
        basis = space.value.basis

        def signed(gram: np.ndarray, item: np.ndarray | int) -> np.ndarray:
            with np.errstate(over="ignore"):
                return gram ^ (np.asarray(item, np.uint64) * np.uint64(0xD6E8FEB86659FD93))

        runs = np.unique(np.concatenate([signed(_grams(w, run), i) for i, w in enumerate(it.words)] or [np.zeros(0, np.uint64)]))
        slots = np.arange(DOC_WINDOW - run + 1)
        # most runs are none of an item's, which a table of their upper bits tells at once
        known = np.zeros(1 << 22, bool)
        known[(runs >> np.uint64(42)).astype(np.int64)] = True
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            words, offsets = _lists(batch.column(1))
            out: dict[tuple[int, int], tuple[str, int, float]] = {}
            for i, j in _chunks(offsets, 10_000):
                part, off = words[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if not len(part):
                    continue
                row, start, end = _windows(off, DOC_WINDOW, DOC_STEP)
                w, item, cos = candidates(it, _unit(_project_passages(part, off, row, start, end, basis)), cosine)
                # the candidates' runs of words, each with the item it is a candidate for
                if len(runs) and len(part) >= run and len(w):
                    gram = _grams(part, run)
                    at = start[w][:, None] + slots
                    inside = at + run <= end[w][:, None]
                    key = signed(gram[np.where(inside, at, 0)], item[:, None])
                    hit = known[(key >> np.uint64(42)).astype(np.int64)] & inside
                    maybe = key[hit]
                    place = np.searchsorted(runs, maybe)
                    place[place == len(runs)] = 0
                    hit[hit] = runs[place] == maybe
                    sure = hit.any(axis=1)
                    for x in np.flatnonzero(sure):
                        r, mine = int(row[w[x]]), it.words[item[x]]
                        name = (int(ids[i + r]), int(item[x]))
                        p = int(at[x, hit[x].argmax()])
                        a, b = max(int(off[r]), p - len(mine)), min(int(off[r + 1]), p + 2 * len(mine))
                        if name not in out:
                            out[name] = ("run", longest_run(mine, part[a:b]), float(cos[x]))
                if paraphrases:
                    near = np.flatnonzero(cos >= PARAPHRASE_COSINE)
                    for x in near[np.argsort(-cos[near], kind="stable")]:
                        r, mine, answer = int(row[w[x]]), it.words[item[x]], it.answers[item[x]]
                        name = (int(ids[i + r]), int(item[x]))
                        if name in out:
                            continue
                        a, b = max(int(off[r]), int(start[w[x]]) - len(mine)), min(int(off[r + 1]), int(end[w[x]]) + len(mine))
                        around = part[a:b]
                        # words in common bound the subsequence
                        if np.isin(mine, around).sum() < SUBSEQUENCE * len(mine):
                            continue
                        if longest_subsequence(mine, around) >= SUBSEQUENCE * len(mine) and (not len(answer) or np.isin(answer, around).all()):
                            out[name] = ("paraphrase", longest_run(mine, around), float(cos[x]))
            if out:
                keys = list(out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keys], pa.int64()), pa.array([int(it.ids[k[1]]) for k in keys], pa.int64()), pa.array([out[k][0] for k in keys]), pa.array([out[k][1] for k in keys], pa.int32()), pa.array([out[k][2] for k in keys], pa.float64())],
                    schema=to_arrow_schema(_HIT),
                )

    return scan


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, cosine: float = COSINE, paraphrases: bool = True) -> DataFrame:
    """(doc_id, item_id, kind, run, cosine) of every document that contains passages of an item; each pair once.

    kind is `run` if at least `run` consecutive words are shared (case and everything between words ignored), else
    `paraphrase`. Null texts and items of no words are in no pair; repeated rows of a key count once.
    """
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    words = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", words_of("text").alias("words")).checkpoint()
    space = fit(words)
    shared = spark.sparkContext.broadcast(space)
    # a fixed set; a larger one is worked off in parts of a bounded number of windows
    rows = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).dropDuplicates(["item_id"]).select("item_id", words_of("text").alias("w"), words_of(F.coalesce("answer", F.lit(""))).alias("a")).where(F.size("w") > 0)
    result = None
    part: list = []
    held = 0

    def search(part: list) -> DataFrame:
        ws = [np.array(r["w"], np.int64) for r in part]
        off = np.r_[0, np.cumsum([len(w) for w in ws])]
        row, start, end = _windows(off, run, ITEM_STEP)
        vectors = _unit(_project(np.concatenate(ws), start, end, space.basis))
        order, cells, centroids = inverted_file(vectors)
        it = Items(np.array([r["item_id"] for r in part]), ws, [np.array(r["a"], np.int64) for r in part], row[order], vectors[order], cells, centroids)
        return words.mapInArrow(_search(spark.sparkContext.broadcast(it), shared, run, cosine, paraphrases), _HIT)

    for r in rows.toLocalIterator():
        part.append(r)
        held += 1 + max(0, len(r["w"]) - run) // ITEM_STEP + 1
        if held >= MOST_WINDOWS:
            result = search(part) if result is None else result.unionByName(search(part))
            part, held = [], 0
    if part or result is None:
        last = search(part) if part else spark.createDataFrame([], _HIT)
        result = last if result is None else result.unionByName(last)
    best = F.struct(F.when(F.col("kind") == "run", 1).otherwise(0).alias("k"), "run", "cosine")
    return result.groupBy("doc_id", "item_id").agg(F.max(best).alias("b")).select("doc_id", "item_id", F.when(F.col("b.k") == 1, "run").otherwise("paraphrase").alias("kind"), F.col("b.run").alias("run"), F.col("b.cosine").alias("cosine"))


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(spread(documents), items, paraphrases=False).where("kind = 'run'").select("doc_id", "item_id")
