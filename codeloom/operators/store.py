"""The point store as tables: filters, upserts, clearing, signatures, duplicate probes, eviction, planning."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import _c


def equals(conditions: dict[str, object]) -> Column:
    """All of several scalar equalities; lists and other non-scalars are ignored, nothing is no filter. Dotted names reach into structs and maps."""
    parts = [F.col(k) == F.lit(v) for k, v in conditions.items() if isinstance(v, (str, int, float, bool))]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def is_relation(df: DataFrame) -> Column:
    """The shape of a relation: a source, a target and a type."""
    return F.col("from_entity").isNotNull() & F.col("to_entity").isNotNull() & F.col("relation_type").isNotNull()


def is_manual() -> Column:
    """Entries made by hand: no file, a name and a type, and at least one observation or a content."""
    return F.col("file_path").isNull() & F.col("name").isNotNull() & F.col("entity_type").isNotNull() & ((F.size(F.coalesce("observations", F.array().cast("array<string>"))) > 0) | F.col("content").isNotNull())


def trivial_kind(code: str | Column) -> Column:
    """The first that fits of: empty, imports, comments, decorators, definitions, other."""
    lines = F.filter(F.transform(F.split(_c(code), "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    every = lambda rx: F.forall(lines, lambda x: x.rlike(rx))
    return (
        F.when(F.size(lines) <= 0, "empty").when(every(r"^(import |from \S+ import |const \w+ = require|export \* from)"), "imports").when(every(r"^(#|//|/\*|\*)"), "comments").when(every(r"^@\w"), "decorators")
        .when(F.exists(lines, lambda x: x.rlike(r"^(export )?(async )?(def|class|func|function|interface|type) ")), "definitions").otherwise("other")
    )


def signature_key(kind, name, code) -> Column:
    """16 hex digits of kind, lower-cased name and number of parameters."""
    params = F.regexp_extract(_c(code), r"\(([^()]*)\)", 1)
    n = F.when(F.trim(params) == "", 0).otherwise(F.size(F.split(params, ",")))
    return F.substring(F.sha2(F.concat_ws("|", _c(kind), F.lower(_c(name)), n.cast("string")), 256), 1, 16)


def first_prefix(df: DataFrame, path: str, members: list[tuple[str, str]], fallback: str) -> Column:
    """The collection of the longest member folder that the path lies in, else the fallback."""
    out = F.lit(fallback)
    for folder, name in sorted(members, key=lambda m: (len(m[0]), m[0])):
        out = F.when(F.col(path).startswith(folder.rstrip("/") + "/"), F.lit(name)).otherwise(out)
    return out


def evict_oldest(df: DataFrame, used: str, size: str, most: int, key: str) -> DataFrame:
    """What stays when the least recently used rows are dropped until the total size is at most the maximum. Ties go by key."""
    from .stats import running_total

    newest_first = df.withColumn("_neg", -F.unix_micros(F.col(used).cast("timestamp")))
    return running_total(newest_first, ["_neg", key], F.col(size), "_total").where(F.col("_total") <= most).drop("_neg", "_total")


def priority(impact: str, effort: str, dependencies: str, weight: float = 0.5, penalty: float = 0.1) -> Column:
    """max(0, impact / (1 + effort * weight) - dependencies * penalty)."""
    return F.greatest(F.lit(0.0), F.col(impact) / (1 + F.col(effort) * weight) - F.col(dependencies) * penalty)


def topological_levels(edges: DataFrame) -> DataFrame:
    """(id, level): the longest way from a vertex without predecessors; vertices on a circle are not in the result. edges (before, after)."""
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.where("before is not null and after is not null and before <> after").select("before", "after").distinct().checkpoint()
    left = e.select(F.col("before").alias("id")).union(e.select(F.col("after").alias("id"))).distinct().checkpoint()
    done = None
    for level in itertools.count():  # as many rounds as the longest way has vertices
        free = left.join(e.select(F.col("after").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(level)).checkpoint()
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        left = left.join(free, "id", "left_anti").checkpoint()
        e = e.join(free.select(F.col("id").alias("before")), "before", "left_anti").select("before", "after").checkpoint()
    return done if done is not None else left.withColumn("level", F.lit(0)).where("false")


def min_hash(df: DataFrame, key: str, features: str, n: int = 128, seed: int = 42) -> DataFrame:
    """(key, signature): n least values of (a h + b) mod p over a row's features; n zeros for no features, null for null.

    h is the first 32 bits of a feature's MD5. A batch's different features are hashed once, and the permutations are array
    operations over unsigned 64-bit numbers, in which no product overflows.
    """
    import hashlib
    import random

    import numpy as np
    import pyarrow as pa

    # fixed values: the prime, and coefficients below 2^32 drawn from this generator, first all a, then all b
    p, most = 4294967311, 2**32 - 1
    r = random.Random(seed)
    a = np.array([r.randint(1, most) for _ in range(n)], np.uint64)
    b = np.array([r.randint(0, most) for _ in range(n)], np.uint64)

    def run(batches):
        for batch in batches:
            lists = batch.column(1).to_pylist()
            words = sorted({w for ws in lists if ws for w in ws if w is not None})
            place = {w: i for i, w in enumerate(words)}
            h = np.array([int(hashlib.md5(w.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) for w in words], np.uint64)
            signed = (h[:, None] * a + b) % np.uint64(p)
            out = []
            for ws in lists:
                at = [place[w] for w in ws if w is not None] if ws else []
                out.append(None if ws is None else signed[at].min(axis=0).astype(np.int64).tolist() if at else [0] * n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=[key, "signature"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, features).mapInArrow(run, f"{key} {kind}, signature array<bigint>")


def min_hash_similarity(a: str | Column, b: str | Column) -> Column:
    """The share of equal places of two signatures; null if their lengths differ, 0 for empty ones."""
    x, y = _c(a), _c(b)
    same = F.size(F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda z: z["x"] == z["y"]))
    return F.when(F.size(x) != F.size(y), None).when(F.size(x) == 0, 0.0).otherwise(same / F.size(x))


def markdown_to_html(text: str | Column) -> Column:
    """Headings, bold, code, links and list items of Markdown as HTML; other text stays. Lines end at line feeds only."""
    x = _c(text)
    for pattern, to in (
        ("&", "&amp;"), ("<", "&lt;"), (r"(?dm)^### +(.*)$", "<h3>$1</h3>"), (r"(?dm)^## +(.*)$", "<h2>$1</h2>"), (r"(?dm)^# +(.*)$", "<h1>$1</h1>"), (r"\*\*([^*\n]+)\*\*", "<b>$1</b>"), (r"`([^`\n]+)`", "<code>$1</code>"),
        (r"\[([^\]\n]+)\]\(([^)\s]+)\)", '<a href="$2">$1</a>'), (r"(?dm)^[-*] +(.*)$", "<li>$1</li>"),
    ):
        x = F.regexp_replace(x, pattern, to)
    return x


def file_operations(code: str | Column) -> Column:
    """Paths that code opens, reads or writes by a literal, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_c(code), F.lit("(?:open|read_csv|read_json|read_parquet|to_csv|to_json|readFileSync|writeFileSync|ReadFile|WriteFile)\\([\"']([^\"']+)[\"']"), F.lit(1))))


def duplicate_verdict(score: str | Column, same_file: Column) -> Column:
    """block from 0.95 on, warn from 0.85, look from 0.55, else pass; always pass within one file."""
    s = _c(score)
    return F.when(same_file, "pass").when(s >= 0.95, "block").when(s >= 0.85, "warn").when(s >= 0.55, "look").otherwise("pass")
