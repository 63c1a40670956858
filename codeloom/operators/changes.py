"""Differences between two states, baselines, and diff scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def classify_changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status): added, deleted, modified or unchanged. Null values are equal to each other."""
    a, b = before.select(key, F.col(value).alias("old"), F.lit(1).alias("in_old")), after.select(key, F.col(value).alias("new"), F.lit(1).alias("in_new"))
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("modified")
    return a.join(b, key, "full").select(key, status.alias("status"))


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): only_a, only_b or both."""
    x, y = a.select(key).distinct().withColumn("a", F.lit(1)), b.select(key).distinct().withColumn("b", F.lit(1))
    return x.join(y, key, "full").select(key, F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").otherwise("both").alias("side"))


def finding_hash(rule: str, path: str, line: str):
    """The first 16 hex digits of the hash of rule:file:line."""
    return F.substring(F.sha2(F.concat_ws(":", F.col(rule), F.col(path), F.col(line).cast("string")), 256), 1, 16)


def split_baseline(findings: DataFrame, baseline: DataFrame, on: str = "hash") -> DataFrame:
    """Findings with is_new: whether their hash is not in the baseline."""
    known = baseline.select(on).distinct().withColumn("_known", F.lit(True))
    return findings.join(known, on, "left").withColumn("is_new", F.col("_known").isNull()).drop("_known")


def merge_baseline(baseline: DataFrame, findings: DataFrame, on: str = "hash") -> DataFrame:
    """(hash, first_seen, last_seen, suppressed): unseen hashes are added, known ones keep their first sighting and suppression."""
    new = findings.groupBy(on).agg(F.min("seen").alias("f"), F.max("seen").alias("l"))
    b = baseline.select(on, "first_seen", "last_seen", "suppressed")
    return b.join(new, on, "full").select(on, F.coalesce("first_seen", "f").alias("first_seen"), F.coalesce(F.greatest("last_seen", "l"), "last_seen", "l").alias("last_seen"), F.coalesce("suppressed", F.lit(False)).alias("suppressed"))


def in_diff_scope(findings: DataFrame, ranges: DataFrame, path: str = "file_path", line: str = "line") -> DataFrame:
    """Findings with in_scope: no path, or a line in one of the file's changed ranges (path, start, end); an added file is a range from 1 on.

    A file's ranges are one row, so a finding meets at most one and overlapping ranges repeat nothing.
    """
    spans = ranges.where("file_path is not null").groupBy(F.col("file_path").alias(path)).agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    inside = F.exists("_spans", lambda r: (F.col(line) >= r["start"]) & (F.col(line) <= r["end"]))
    return findings.join(spans, path, "left").withColumn("in_scope", F.col(path).isNull() | F.coalesce(inside, F.lit(False))).drop("_spans")


def cleanup_map(findings: DataFrame) -> DataFrame:
    """(rule_id, n, samples, priority): per rule the unsuppressed findings, three sample places, and a priority from 1 to 5.

    Every rule is aggregated partially; only three smallest places per partition are kept for samples.
    """
    place = F.concat_ws(":", "file_path", F.col("line").cast("string"))
    open_ = findings.where(~F.coalesce(F.col("suppressed"), F.lit(False)))
    from pyspark.sql import Window

    firsts = open_.select("rule_id", place.alias("place")).distinct().withColumn("_n", F.row_number().over(Window.partitionBy("rule_id").orderBy("place"))).where("_n <= 3")
    samples = firsts.groupBy("rule_id").agg(F.array_join(F.array_sort(F.collect_list("place")), ", ").alias("samples"))
    counts = open_.groupBy("rule_id").agg(F.count("*").alias("n"))
    return counts.join(samples, "rule_id").withColumn("priority", F.greatest(F.lit(1), F.least(F.lit(5), 5 - F.bround(F.log10(F.col("n").cast("double"))).cast("int"))))
