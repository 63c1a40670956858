"""Filling fixed-capacity containers with items (problem 7).

Method: bulk-synchronous best-fit. Documents are range-sorted by size and ranked; sizes are integers of at most the capacity,
so the sorted lists of documents and of gaps are held as runs of equal values, whose number is bounded by the capacity
whatever the number of documents. A round takes the largest size left and sweeps the gaps for successors, smallest
sufficient gap first: within equal sizes and gaps, the k-th document takes the k-th container, which settles conflicts by
rank. Gaps are updated and the round repeats until no gap fits; what is left opens new containers. The plan that comes
out (which ranks of a size go to which containers) is bounded too and is applied to all documents in one map.

Only documents larger than a container are split: into full containers and a rest that is packed like others.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ensure_checkpoint_dir, spread
from .common import arrow_rows, schema_of

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern of this byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_RANKED = schema_of("doc_id bigint, piece_no int, n_tokens int, pid int, local bigint")
_PACKED = schema_of("doc_id bigint, piece_no int, n_tokens int, container bigint")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of a text; a null text has none. Texts of special tokens are ordinary text."""
    return 0 if not text else len(_encoding(path).encode_ordinary(text))


def plan(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """From documents per size: for each size the runs (first rank, end rank, first container), and the number of containers."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of container numbers
    order: list[int] = []  # the gaps in use, sorted
    opened = 0
    out: dict[int, list[tuple[int, int, int]]] = {}

    def give(gap: int, run: tuple[int, int]) -> None:
        if gap > 0:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append(run)

    for size in sorted((s for s in counts if s > 0), reverse=True):
        left, rank, runs = counts[size], 0, []
        while left:
            at = bisect.bisect_left(order, size)
            if at < len(order):  # the successor sweep: smallest sufficient gap
                gap = order[at]
                lo, hi = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
                n = min(left, hi - lo)
                if n < hi - lo:
                    give(gap, (lo + n, hi))
            else:
                gap = capacity
                each = capacity // size
                lo, n = opened, -(-left // each)
                opened += n
                n = min(left, n)
            runs.append((rank, rank + n, lo))
            give(gap - size, (lo, lo + n))
            rank, left = rank + n, left - n
        out[size] = runs
    return out, opened


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks within equal sizes of a sorted partition."""
    pid = TaskContext.get().partitionId()
    seen: dict[int, int] = {}
    for b in batches:
        n = b.column(2).to_numpy()
        if not len(n):
            continue
        start = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
        local = np.arange(len(n)) - np.repeat(start, np.diff(np.r_[start, len(n)]))
        for s, e in zip(start, np.r_[start[1:], len(n)]):
            size = int(n[s])
            local[s:e] += seen.get(size, 0)
            seen[size] = seen.get(size, 0) + int(e - s)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.full(len(n), pid, np.int32)), pa.array(local.astype(np.int64))], schema=to_arrow_schema(_RANKED))


def pack_sizes(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece_no, n_tokens, container) from (doc_id, n_tokens): every document once, or its pieces if it exceeds the capacity.

    Sizes under 1 take no space and lie in container 0; null ids are dropped; a repeated id counts once.
    """
    spark = sizes.sparkSession
    ensure_checkpoint_dir(spark)
    one = sizes.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce("n_tokens", F.lit(0))).cast("int").alias("n"))
    pieces = F.expr(f"transform(sequence(1, greatest(1, cast(ceil(n / {capacity}) as int))), i -> struct(i as piece_no, least({capacity}, n - (i - 1) * {capacity}) as size))")
    rows = one.select("doc_id", F.explode(pieces).alias("p")).select("doc_id", F.col("p.piece_no").cast("int").alias("piece_no"), F.greatest(F.col("p.size"), F.lit(0)).cast("int").alias("n_tokens"))
    ranked = rows.repartitionByRange("n_tokens", "doc_id", "piece_no").sortWithinPartitions("n_tokens", "doc_id", "piece_no").mapInArrow(_rank, _RANKED).checkpoint()
    # a size spans neighbouring partitions only: at most capacity + partitions rows
    parts = ranked.groupBy("pid", "n_tokens").agg(F.count("*").alias("k")).collect()
    offset: dict[tuple[int, int], int] = {}
    counts: dict[int, int] = {}
    for r in sorted(parts, key=lambda r: (r["n_tokens"], r["pid"])):
        offset[r["pid"], r["n_tokens"]] = counts.get(r["n_tokens"], 0)
        counts[r["n_tokens"]] = counts.get(r["n_tokens"], 0) + r["k"]
    runs, _ = plan(counts, capacity)
    table = {s: (np.array([r[0] for r in v]), np.array([r[2] for r in v])) for s, v in runs.items()}
    shared = spark.sparkContext.broadcast((offset, table))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        off, tab = shared.value
        for b in batches:
            n, pid, local = (b.column(i).to_numpy() for i in (2, 3, 4))
            container = np.zeros(len(n), np.int64)
            for key in {*zip(pid.tolist(), n.tolist())}:
                if key[1] > 0:
                    m = (pid == key[0]) & (n == key[1])
                    rank = local[m] + off[key]
                    first, lo = tab[key[1]]
                    at = np.searchsorted(first, rank, side="right") - 1
                    container[m] = lo[at] + rank - first[at]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(container)], schema=to_arrow_schema(_PACKED))

    return ranked.mapInArrow(assign, _PACKED)


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """pack_sizes over the token counts of (doc_id, text)."""
    sizes = arrow_rows(documents.where("doc_id is not null"), ["doc_id", "text"], "doc_id bigint, n_tokens int", lambda k, t: [(k, count_tokens(t, tokenizer))])
    return pack_sizes(sizes, capacity)


def packed(documents: DataFrame) -> DataFrame:
    return pack(spread(documents))
