"""What an indexing service keeps about itself, as tables: queues, caches, batches, progress, freshness, layers of settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import _c

# What an error text says when trying again may help.
TRANSIENT = ("rate limit", "timeout", "connection", "temporary", "503", "502", "429")
# Files that hold user interface code.
UI_EXTENSIONS = (".css", ".scss", ".less", ".tsx", ".jsx", ".vue", ".svelte")
# Files that are no text, by extension (as it is written) and, in hexadecimal, by their first bytes.
BINARY_EXTENSIONS = (".exe", ".dll", ".so", ".dylib", ".a", ".lib", ".o", ".obj", ".class", ".pyc", ".pyd", ".pyo", ".bin", ".elf")
BINARY_STARTS = ("7f454c46", "4d5a", "feedface", "feedfacf", "cafebabe", "cffaedfe")
# Marks that switch a check off.
SUPPRESSIONS = ("ui-quality-disable", "ui-check-disable", "@ui-ignore", "stylelint-disable", "eslint-disable")
# What an observation begins with, and how often it then counts.
OBSERVATION_WEIGHTS = ((3, ("class:", "function:", "method:", "interface:", "signature:")), (2, ("purpose:", "responsibility:", "description:")))
# The weight of a task by its effort, and up to which sum a group is low or medium.
EFFORT = {"low": 1, "medium": 2, "high": 4}
EFFORT_LOW, EFFORT_MEDIUM = 3, 8


def retryable(error: str | Column, attempt: str | Column, most: int = 3) -> Column:
    """Whether to try again: an attempt (from 0) under the maximum, and a text that names a passing trouble. Null is no such text."""
    text = F.lower(_c(error))
    return F.coalesce((_c(attempt) < most) & reduce(lambda a, b: a | b, (text.contains(x) for x in TRANSIENT)), F.lit(False))


def backoff(attempt: str | Column, base: float = 1.0, factor: float = 2.0, most: float = 60.0) -> Column:
    """Seconds before the next attempt, without the random part: base * factor^attempt, at most `most`."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(factor), _c(attempt).cast("double")))


def is_ui_file(path: str | Column) -> Column:
    """By the extension, whatever its case."""
    return F.lower(F.regexp_extract(_c(path), r"(\.[^./]+)$", 1)).isin(*UI_EXTENSIONS)


def exclusion_reason(path: str | Column, content: Column) -> Column:
    """extension or magic for files that are no text, else null; content is binary or a string."""
    ext = F.regexp_extract(_c(path), r"(\.[^./]+)$", 1)
    head = F.lower(F.hex(F.substring(content.cast("binary"), 1, 4)))
    magic = reduce(lambda a, b: a | b, (head.startswith(x) for x in BINARY_STARTS))
    return F.when(ext.isin(*BINARY_EXTENSIONS), "extension").when(magic, "magic")


def suppression(line: str | Column) -> Column:
    """The first mark of a suppression in a line, null without one."""
    low = F.lower(_c(line))
    out = F.lit(None).cast("string")
    for mark in reversed(SUPPRESSIONS):
        out = F.when(low.contains(mark), mark).otherwise(out)
    return out


def has_rationale(line: str | Column, mark: str | Column, least: int = 6) -> Column:
    """Whether at least so many characters of a reason follow the mark, behind -- or a colon."""
    after = F.substring(_c(line), F.instr(F.lower(_c(line)), _c(mark)) + F.length(_c(mark)), F.length(_c(line)))
    reason = F.when(after.contains("--"), F.regexp_extract(after, r"(?s)--(.*)$", 1)).when(after.contains(":"), F.regexp_extract(after, r"(?s):(.*)$", 1)).otherwise("")
    return F.length(F.trim(reason)) >= least


def weighted_observations(signature: str | Column, docstring: str | Column, observations: str | Column) -> Column:
    """The text by which an entity is found: its signature three times, its description twice, and its observations, each
    as often as its first word says, joined by bars. Nulls are left out."""

    def times(o: Column) -> Column:
        low = F.lower(o)
        n = F.lit(1)
        for weight, marks in reversed(OBSERVATION_WEIGHTS):
            n = F.when(reduce(lambda a, b: a | b, (low.contains(m) for m in marks)), weight).otherwise(n)
        return n

    given = lambda c, label, n: F.when(F.length(_c(c)) > 0, F.array_repeat(F.concat(F.lit(label), _c(c)), n)).otherwise(F.array().cast("array<string>"))
    own = F.flatten(F.transform(F.array_compact(F.coalesce(_c(observations), F.array().cast("array<string>"))), lambda o: F.array_repeat(o, times(o))))
    return F.array_join(F.concat(given(signature, "Signature: ", 3), given(docstring, "Description: ", 2), own), " | ")


def effort_label(weight: str | Column) -> Column:
    """low, medium or high by the sum of the tasks' weights."""
    return F.when(_c(weight) <= EFFORT_LOW, "low").when(_c(weight) <= EFFORT_MEDIUM, "medium").otherwise("high")


def total_effort(tasks: DataFrame, group: str, effort: str = "effort") -> DataFrame:
    """(group, n, weight, label). Efforts of other names weigh nothing."""
    weight = F.coalesce(*(F.when(F.col(effort) == k, v) for k, v in EFFORT.items()), F.lit(0))
    g = tasks.groupBy(group).agg(F.count("*").alias("n"), F.sum(weight).alias("weight"))
    return g.withColumn("label", effort_label("weight"))


def merge_layers(layers: DataFrame, scope: str = "scope", key: str = "key", value: str = "value", layer: str = "layer") -> DataFrame:
    """(scope, key, value): of each setting the value of the latest layer that has it, a null among them; ties go to the larger value."""
    # max_by passes over rows whose order is null only
    return layers.groupBy(scope, key).agg(F.max_by(value, F.struct(layer, F.coalesce(value, F.lit("")))).alias(value))


def ignored_by_layers(path: str | Column, rules: list[tuple[str, str]]) -> Column:
    """The layer of the rule that decides on a path, null if it is kept: the last matching rule counts, and one that
    begins with `!` takes a path back. A rule is a folder ending in `/`, a `*.ext`, or a name or path to be found whole."""
    p = F.concat(F.lit("/"), _c(path))
    out = F.lit(None).cast("string")
    for layer, rule in rules:
        keep, bare = rule.startswith("!"), rule.lstrip("!")
        hit = p.contains("/" + bare.lstrip("/")) if bare.endswith("/") else p.endswith(bare[1:]) if bare.startswith("*.") else p.endswith("/" + bare.lstrip("/"))
        out = F.when(hit, F.lit(None).cast("string") if keep else F.lit(layer)).otherwise(out)
    return out


def pending_queue(events: DataFrame, collection: str, path: str, kind: str, at: str, now: Column, delay: str, tie: str) -> DataFrame:
    """(collection, path, kind, at): the last event of each path, if it has been quiet for the delay; later events replace earlier ones."""
    last = events.where(F.col(at).isNotNull()).groupBy(collection, path).agg(F.max_by(kind, F.struct(at, tie)).alias(kind), F.max(at).alias(at))
    return last.where(F.col(at) + F.expr(f"interval {delay}") <= now)


def cache_lookups(lookups: DataFrame, key: str, at: str, ttl_seconds: int, tie: str) -> DataFrame:
    """Look-ups with `hit`: whether the same key was looked up at most ttl_seconds before. A miss fills the cache, a hit renews it."""
    w = Window.partitionBy(key).orderBy(at, tie)
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))
    return lookups.withColumn("hit", F.coalesce(gap <= ttl_seconds * 1_000_000, F.lit(False)))


def batch_sizes(batches: DataFrame, stream: str, order: str, size0: int = 25, least: int = 2, most: int = 100, grow: float = 1.5, shrink: float = 0.5, patience: int = 3, failures: int = 2, rate: float = 0.1) -> DataFrame:
    """(stream, order, size): the size of each batch of a stream by the error rates before it (`error_rate`).

    After `patience` batches in a row under the rate the size grows, and from the second bad one in a row on it shrinks. A
    stream's batches are folded in their order within one row.
    """
    events = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("error_rate", F.lit(0.0)).alias("r"))))
    start = F.struct(F.lit(size0).alias("size"), F.lit(0).alias("good"), F.lit(0).alias("bad"), F.array().cast("array<struct<o:bigint,size:int>>").alias("out"))

    def step(a: Column, e: Column) -> Column:
        wrong = e["r"] > rate
        good, bad = F.when(wrong, 0).otherwise(a["good"] + 1), F.when(wrong, a["bad"] + 1).otherwise(0)
        up = F.least(F.lit(most), F.floor(a["size"] * grow).cast("int"))
        down = F.greatest(F.lit(least), F.floor(a["size"] * shrink).cast("int"))
        size = F.when(wrong & (bad >= failures), down).when(~wrong & (good >= patience), up).otherwise(a["size"])
        out = F.concat(a["out"], F.array(F.struct(e["o"].cast("bigint").alias("o"), a["size"].alias("size"))))
        return F.struct(size.alias("size"), F.when(good >= patience, 0).otherwise(good).alias("good"), bad.alias("bad"), out.alias("out"))

    return batches.groupBy(stream).agg(F.aggregate(events, start, step, lambda a: a["out"]).alias("x")).select(stream, F.explode("x").alias("x")).select(stream, F.col("x.o").alias(order), F.col("x.size").alias("size"))


def freshness(indexed: DataFrame, changes: DataFrame, group: str, at: str, changed: str) -> DataFrame:
    """(group, last, hours, behind): when a group was indexed last, how many hours before the newest of all that is, and how many changes came after it."""
    last = indexed.groupBy(group).agg(F.max(at).alias("last"))
    newest = last.agg(F.max("last").alias("newest"))
    behind = changes.join(last, group).where(F.col(changed) > F.col("last")).groupBy(group).agg(F.count("*").alias("behind"))
    # the newest time of all is one row
    hours = F.round((F.unix_micros(F.col("newest").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 3_600_000_000, 6)
    return last.join(F.broadcast(newest)).join(behind, group, "left").select(group, "last", hours.alias("hours"), F.coalesce("behind", F.lit(0)).alias("behind"))


def dbscan(points: DataFrame, pairs: DataFrame, key: str, min_samples: int = 2) -> DataFrame:
    """(key, cluster): density clusters from the pairs (a, b) within the radius; -1 for noise.

    A point with at least min_samples points around it, itself included, is a core; cores in reach of one another are one
    cluster, named by its least core, and any other point joins the least such cluster in its reach.
    """
    from .components import connected_components

    ends = pairs.select("a", "b").union(pairs.select("b", "a")).where("a <> b").distinct()
    cores = ends.groupBy("a").agg((F.count("*") + 1).alias("n")).where(F.col("n") >= min_samples).select(F.col("a").alias("id"))
    if min_samples <= 1:
        cores = points.select(F.col(key).alias("id")).distinct()
    inner = ends.join(cores.select(F.col("id").alias("a")), "a", "left_semi").join(cores.select(F.col("id").alias("b")), "b", "left_semi")
    joined = cores.join(connected_components(inner), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    border = ends.join(joined.select(F.col("id").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("near"))
    out = points.select(F.col(key).alias("id")).distinct().join(joined, "id", "left").join(border, "id", "left")
    return out.select(F.col("id").alias(key), F.coalesce("cluster", "near", F.lit(-1)).alias("cluster"))
