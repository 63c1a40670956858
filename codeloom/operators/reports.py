"""Metric roll-ups, sessions, serialisation and collection tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import _c


def suppression_rate(findings: DataFrame, group: str) -> DataFrame:
    """(group, n, n_suppressed, rate) of findings; null flags are not suppressed."""
    flag = F.coalesce("suppressed", F.lit(False)).cast("bigint")
    return findings.groupBy(group).agg(F.count("*").alias("n"), F.sum(flag).alias("n_suppressed"), F.round(F.avg(flag), 6).alias("rate"))


def session_ids(findings: DataFrame, project: str) -> DataFrame:
    """(project, session): 12 hex digits over a project's distinct findings (rule_id, file_path, line) in order.

    A project's findings are hashed one by one and the hashes combined by an order-free sum, so none is collected.
    """
    one = findings.select(project, F.xxhash64("rule_id", "file_path", "line").alias("h")).distinct()
    total = one.groupBy(project).agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    return total.select(project, F.substring(F.sha2(F.concat_ws(":", project, F.col("s").cast("string"), F.col("n").cast("string")), 256), 1, 12).alias("session"))


def payload(df: DataFrame, key: str, flat: list[str], nested: dict[str, list[str]]) -> DataFrame:
    """(key, payload): fields and nested groups of fields as one JSON object; null fields are left out."""
    return df.select(key, F.to_json(F.struct(*flat, *(F.struct(*fields).alias(name) for name, fields in nested.items()))).alias("payload"))


def threshold_findings(metrics: DataFrame, limits: dict[str, tuple[float, str]]) -> DataFrame:
    """(key, metric, value, severity) of metric rows (key, metric columns) beyond their limits."""
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(v)).alias("limit"), F.lit(s).alias("severity")) for m, (v, s) in limits.items())))
    return metrics.select("key", rows.alias("x")).select("key", "x.*").where("value > limit").drop("limit")


def doc_summary(comment: str | Column) -> Column:
    """The first sentence of a documentation comment, without comment marks."""
    x = F.regexp_replace(_c(comment), r"(?m)^[ \t]*(?:/\*\*|\*/|\*|//|#)[ \t]?", "")
    return F.trim(F.regexp_extract(F.trim(F.regexp_replace(x, r"\s+", " ")), r"^(.*?[.!?])(?:\s|$)|^(.*)$", 0))


def split_large(text: str | Column, limit: int, boundaries: tuple[str, ...] = ("\n\n\n+", "\n\n", "\n", "(?<=[.!?]) ")) -> Column:
    """Pieces of a text, cut at the first boundary kind that brings them under the limit; what no boundary cuts stays whole."""

    def cut(rx: str):
        return lambda x: F.when(F.length(x) > limit, F.filter(F.split(x, rx), lambda y: F.length(y) > 0)).otherwise(F.array(x))

    out = F.array(_c(text))
    for rx in boundaries:
        out = F.flatten(F.transform(out, cut(rx)))
    return out


def create_collection(spark: SparkSession, name: str, schema: str, partition_by: str | None = None, properties: dict[str, str] | None = None, replace: bool = False) -> None:
    """A Parquet table of that name; with `replace` an existing one is dropped first, else it is kept."""
    if replace:
        spark.sql(f"drop table if exists {name}")
    part = f"partitioned by ({partition_by})" if partition_by else ""
    props = ", ".join(f"'{k}' = '{v}'" for k, v in (properties or {}).items())
    spark.sql(f"create table if not exists {name} ({schema}) using parquet {part} {'tblproperties (' + props + ')' if props else ''}")


def restore(current: DataFrame, backup: DataFrame, key: str) -> DataFrame:
    """Rows of a backup that are not there any more."""
    return backup.join(current.select(key), key, "left_anti")
