"""Deduplication and set operators on keys and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def last_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last by the given order. Null keys form a group of their own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def exact_groups(df: DataFrame, key: str, content: Column, fewest: int = 2) -> DataFrame:
    """(hash, n, first_key): groups of equal contents with at least `fewest` members; null contents are in none."""
    rows = df.where(content.isNotNull()).select(key, F.sha2(content, 256).alias("hash"))
    return rows.groupBy("hash").agg(F.count("*").alias("n"), F.min(key).alias("first_key")).where(F.col("n") >= fewest)


def split_known(batch: DataFrame, known: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(unknown, known) rows of a batch by a hash that exists elsewhere; null hashes are unknown."""
    keys = known.select(on).where(F.col(on).isNotNull()).distinct()
    return batch.join(keys, on, "left_anti"), batch.join(keys, on, "left_semi")


def repeated_sequences(df: DataFrame, items: Column, least_items: int = 3, least_count: int = 3) -> DataFrame:
    """(sequence, n, confidence) of item lists that recur, whatever their order."""
    key = F.array_join(F.array_sort(F.array_distinct(items)), " ")
    rows = df.where(F.size(F.array_distinct(items)) >= least_items).groupBy(key.alias("sequence")).agg(F.count("*").alias("n"))
    return rows.where(F.col("n") >= least_count).withColumn("confidence", F.round(F.least(F.lit(0.9), 0.5 + 0.1 * F.col("n")), 6))
