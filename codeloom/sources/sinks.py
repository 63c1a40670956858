"""Reports and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def prometheus_lines(values: DataFrame, metric: str, label: str, kind: str = "gauge") -> DataFrame:
    """(line): the text exposition of (label, value) rows. Null values are left out."""
    head = values.sparkSession.createDataFrame([(f"# TYPE {metric} {kind}",)], "line string")
    return head.unionByName(values.where("value is not null").select(F.concat(F.lit(f'{metric}{{{label}="'), F.col("label"), F.lit('"} '), F.col("value").cast("string")).alias("line")))


def sarif_results(findings: DataFrame, tool: str = "codeloom") -> DataFrame:
    """(result): one SARIF 2.1 result per finding (rule_id, severity, file_path, line_no), as JSON lines that a run is made of."""
    level = F.when(F.col("severity").isin("HIGH", "CRITICAL"), "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("note")
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_no").alias("startLine")).alias("region")).alias("physicalLocation"))
    return findings.select(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("rule_id").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("result"))


def write_sarif(findings: DataFrame, path: str) -> None:
    """The results as text files under a folder; a run's frame is added by whoever joins them."""
    sarif_results(findings).write.mode("overwrite").text(path)


def write_state(files: DataFrame, path: str) -> None:
    """(file_path, hash, size) of every file, replaced as a whole: readers see the old state or the new one."""
    files.select("file_path", F.sha2("content", 256).alias("hash"), F.length("content").alias("size")).write.mode("overwrite").parquet(path)


def upsert(current: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of both, the batch's where a key is in both. Equal keys within the batch: any one row."""
    return current.join(batch.select(key), key, "left_anti").unionByName(batch.dropDuplicates([key]), allowMissingColumns=True)


def delete_by(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the given ones; null keys stay."""
    return current.join(keys.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def markdown_listing(df: DataFrame, title: str, fields: list[str]) -> DataFrame:
    """(line) of a Markdown list, sorted by its fields."""
    return df.orderBy(*fields).select(F.concat(F.lit("- **"), F.col(title), F.lit("** "), F.concat_ws(" | ", *fields)).alias("line"))
