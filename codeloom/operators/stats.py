"""Aggregations: roll-ups, outliers, percentiles, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import ensure_checkpoint_dir


def by_each(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(dimension, value, n) over several dimensions in one pass; null values are a group each."""
    pairs = F.explode(F.array(*(F.struct(F.lit(name).alias("dimension"), c.cast("string").alias("value")) for name, c in columns.items())))
    return df.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def percentile_by_rank(df: DataFrame, group: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """For each p the value at position min(floor(n p), n - 1) of the sorted values, counted from 0. Nulls are left out.

    Values are counted first, then range-sorted over all groups with offsets per range, so a group with a third of all rows
    is spread over the ranges and no task orders a whole group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("k"))
    rows = _ranged(counts, [*group, value], F.col("k"), "upto")[0]
    total = rows.groupBy(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group))).agg(F.sum("k").alias("n"), F.min(F.col("upto") - F.col("k")).alias("_before"))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    c = rows.join(total, same).withColumn("upto", F.col("upto") - F.col("_before"))
    place = lambda p: F.least(F.floor(F.col("n") * p), F.col("n") - 1)
    return c.groupBy(*group).agg(*(F.min(F.when(F.col("upto") > place(p), F.col(value))).alias(name) for name, p in ps.items()))


def mode_outliers(df: DataFrame, role: str, prop: str, value: str, majority: float = 0.5, rare: float = 0.2) -> DataFrame:
    """(role, prop, value, n, mode, share): values other than a dominating one, each with at most `rare` of the rows.

    The mode of equal counts is the smallest value. Null values count as a value of their own.
    """
    counts = df.groupBy(role, prop, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(role, prop)
    top = w.orderBy(F.desc("n"), F.col(value).asc_nulls_first())
    c = counts.withColumn("total", F.sum("n").over(w)).withColumn("most", F.max("n").over(w)).withColumn("mode", F.first(value).over(top))
    return c.where((F.col("most") >= majority * F.col("total")) & ~F.col(value).eqNullSafe(F.col("mode")) & (F.col("n") <= rare * F.col("total"))).select(role, prop, value, "n", "mode", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def frequency_outliers(df: DataFrame, role: str, value: str, z: float = 2.0, rare: float = 0.25, least: int = 3) -> DataFrame:
    """(role, value, n, z): values whose count is far from the even share and small against the most frequent one."""
    counts = df.groupBy(role, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(role)
    c = counts.withColumn("total", F.sum("n").over(w)).withColumn("kinds", F.count("*").over(w)).withColumn("most", F.max("n").over(w))
    expected = F.col("total") / F.col("kinds")
    score = F.abs(F.col("n") - expected) / (F.sqrt(expected) + 1)
    return c.withColumn("z", F.round(score, 6)).where((F.col("total") >= least) & (F.col("kinds") >= 2) & (F.col("z") > z) & (F.col("n") < rare * F.col("most"))).select(role, value, "n", "z")


def first_to_last(df: DataFrame, group: list[str], ts: str, value: str) -> DataFrame:
    """(group, first, last, reduction): the earliest and latest value, and the percentage it fell by; 0 where it began at 0."""
    a = df.where(F.col(ts).isNotNull()).groupBy(*group).agg(F.min_by(value, F.struct(ts, value)).alias("first"), F.max_by(value, F.struct(ts, value)).alias("last"))
    return a.withColumn("reduction", F.round(F.when(F.col("first") == 0, 0.0).otherwise((F.col("first") - F.col("last")) / F.col("first") * 100), 6))


def _ranged(df: DataFrame, order: list[str], value: Column, name: str) -> tuple[DataFrame, int]:
    """Rows with the running total of a value over the whole order, and the total.

    The rows are range-sorted and summed within each range; the ranges' sums, one row per partition, give the offsets. So no
    task sees more than its range, as a window without partitions would. The order must tell all rows apart.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).withColumn("_v", value.cast("bigint")).checkpoint()
    sums = {r["_p"]: r["s"] for r in ranged.groupBy("_p").agg(F.sum("_v").alias("s")).collect()}
    at, total = [], 0
    for p in sorted(sums):
        at.append((p, total))
        total += sums[p]
    offsets = df.sparkSession.createDataFrame(at, "_p int, _o bigint")
    local = ranged.withColumn("_c", F.sum("_v").over(Window.partitionBy("_p").orderBy(*order)))
    return local.join(offsets, "_p").withColumn(name, F.col("_c") + F.col("_o")).drop("_p", "_v", "_c", "_o"), total


def running_total(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Rows with the running total of a value, the row itself included, over the order of all rows; null values count 0."""
    return _ranged(df, order, F.coalesce(value, F.lit(0)), name)[0]


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their position `i` from 0 in the order of the given columns, and the number `n` of all rows."""
    rows, total = _ranged(df, order, F.lit(1), "_i")
    return rows.withColumn("i", F.col("_i") - 1).withColumn("n", F.lit(total).cast("bigint")).drop("_i")


def quintiles(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with a priority from 1 to 5 by position: with under a fifth of all rows before it 1, and so on."""
    part = lambda k: F.col("i") * 5 < F.col("n") * k
    return positions(df, order).withColumn("priority", F.when(part(1), 1).when(part(2), 2).when(part(3), 3).when(part(4), 4).otherwise(5)).drop("i", "n")
