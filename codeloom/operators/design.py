"""Design-system operators: tokens, styles, components and their consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Tokens that are broadcast at once; a larger table is worked off in parts.
MOST_TOKENS = 10_000


def nearest_number(df: DataFrame, value: str, scale: list[float], tolerance: float) -> DataFrame:
    """df with nearest, distance and match (exact, near, off_scale; null values are on no scale and have null).

    The scale is a list of numbers in the plan itself, so nothing is joined. Ties go to the smaller value.
    """
    v = F.col(value).cast("double")
    best = F.array_min(F.transform(F.array(*map(F.lit, sorted(map(float, scale)))), lambda t: F.struct(F.abs(t - v).alias("d"), t.alias("t"))))
    match = F.when(v.isNull(), None).when(best["d"] == 0, "exact").when(best["d"] <= tolerance, "near").otherwise("off_scale")
    return df.withColumn("nearest", F.when(v.isNotNull(), best["t"])).withColumn("distance", F.when(v.isNotNull(), best["d"])).withColumn("match", match)


def nearest_colour(df: DataFrame, colour: str, tokens: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """df with token, distance and match for #RRGGBBAA colours against tokens (name, value). Ties go to the smaller name.

    Distinct colours are matched, not rows, each with all tokens as one product of matrices; tokens are broadcast
    MOST_TOKENS at a time. Tokens and colours of another form match nothing.
    """
    import numpy as np
    import pyarrow as pa

    spark, form = df.sparkSession, r"^#[0-9A-Fa-f]{8}$"
    distinct = df.select(F.col(colour).alias("c")).where(F.col(colour).rlike(form)).distinct()
    channels = lambda values: np.frombuffer(bytes.fromhex("".join(v[1:] for v in values)), np.uint8).reshape(-1, 4).astype(np.float64)
    kind = "c string, d double, n string"

    def part(rows: list) -> DataFrame:
        rows = sorted((r["name"], r["value"]) for r in rows)  # of equal distances the first name
        shared = spark.sparkContext.broadcast(([n for n, _ in rows], channels([v for _, v in rows])))

        def run(batches):
            names, t = shared.value
            for b in batches:
                values = b.column(0).to_pylist()
                for i in range(0, len(values), 1000):
                    some = values[i : i + 1000]
                    x = channels(some)
                    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (t**2).sum(1)[None, :] - 2 * x @ t.T, 0)) / 510.0
                    at = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.round(d[np.arange(len(some)), at], 9)), pa.array([names[k] for k in at])], names=["c", "d", "n"])

        return distinct.mapInArrow(run, kind)

    parts, held = [], []
    for r in tokens.select("name", "value").where(F.col("name").isNotNull() & F.col("value").rlike(form)).toLocalIterator():
        held.append(r)
        if len(held) == MOST_TOKENS:
            parts.append(part(held))
            held = []
    if held or not parts:
        parts.append(part(held) if held else spark.createDataFrame([], kind))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    kinds = every.groupBy(F.col("c").alias(colour)).agg(F.min(F.struct("d", "n")).alias("_b"))
    match = F.when(F.col("_b").isNull(), None).when(F.col("_b.d") == 0, "exact").when(F.col("_b.d") <= tolerance, "near").otherwise("off_scale")
    return df.join(kinds, colour, "left").withColumn("token", F.col("_b.n")).withColumn("distance", F.col("_b.d")).withColumn("match", match).drop("_b")


def declaration_key(declarations: str) -> Column:
    """A style's declarations as sorted lower-case name:value pairs, for hashing; null for a null map."""
    pairs = F.transform(F.map_entries(declarations), lambda e: F.concat(F.lower(F.trim(e["key"])), F.lit(":"), F.lower(F.trim(e["value"]))))
    return F.array_join(F.array_sort(pairs), ";")


def style_similarity(a: str, b: str) -> Column:
    """Equal declarations over all declared names of two maps; 1 for two empty maps, 0 if one is empty."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    same = F.size(F.array_intersect(F.transform(F.map_entries(a), lambda e: F.concat_ws("=", e["key"], e["value"])), F.transform(F.map_entries(b), lambda e: F.concat_ws("=", e["key"], e["value"]))))
    return F.when(F.size(keys) == 0, 1.0).otherwise(same / F.size(keys))


def style_diff(a: str, b: str) -> Column:
    """The names whose values differ or that only one map has, sorted."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    return F.array_sort(F.filter(keys, lambda k: ~F.try_element_at(F.col(a), k).eqNullSafe(F.try_element_at(F.col(b), k))))


def duplicate_styles(styles: DataFrame) -> DataFrame:
    """(exact_hash, n, n_files): declaration sets that occur more than once. styles has file_path and declarations."""
    keyed = styles.select("file_path", F.sha2(declaration_key("declarations"), 256).alias("exact_hash"))
    return keyed.where("exact_hash is not null").groupBy("exact_hash").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("n_files")).where("n >= 2")


def collapse_shorthand(declarations: str, name: str, longhands: list[str]) -> Column:
    """The map with the longhands replaced by their shorthand where all are there with one value."""
    d = F.col(declarations)
    values = F.array_distinct(F.array(*(F.try_element_at(d, F.lit(k)) for k in longhands)))
    whole = (F.size(values) == 1) & F.get(values, 0).isNotNull()
    return F.when(whole, F.map_concat(F.map_filter(d, lambda k, v: ~k.isin(*longhands)), F.create_map(F.lit(name), F.get(values, 0)))).otherwise(d)


def focus_consistency(elements: DataFrame, group: str, style: str, least_share: float = 0.6) -> DataFrame:
    """(group, n, n_styles, top_share) of groups of two or more elements whose most frequent style is under the share."""
    counts = elements.where(F.col(style).isNotNull()).groupBy(group, style).agg(F.count("*").alias("k"))
    out = counts.groupBy(group).agg(F.sum("k").alias("n"), F.count("*").alias("n_styles"), F.max("k").alias("top"))
    return out.where((F.col("n") >= 2) & (F.col("n_styles") > 1) & (F.col("top") / F.col("n") < least_share)).select(group, "n", "n_styles", F.round(F.col("top") / F.col("n"), 6).alias("top_share"))


def cluster_summary(clustered: DataFrame, key: str, cluster: str, file: str) -> DataFrame:
    """(cluster, n, n_files, representative, impact, action) of clusters in at least two files, by size."""
    g = clustered.groupBy(cluster).agg(F.count("*").alias("n"), F.countDistinct(file).alias("n_files"), F.min(key).alias("representative")).where("n_files >= 2")
    impact = F.when((F.col("n_files") >= 5) | (F.col("n") >= 10), "high").when((F.col("n_files") >= 3) | (F.col("n") >= 5), "medium").otherwise("low")
    return g.withColumn("impact", impact).withColumn("action", F.when(F.col("n") >= 5, "extract").when(F.col("n") >= 3, "consolidate").otherwise("review"))


def drift_score(a: str, b: str) -> Column:
    """How far two pieces of code drifted apart, from 0 to 1: structure and logic 0.3 each, errors and comments 0.2 each.

    Every part is the relative difference of pattern counts. Words are bounded by anything but ASCII letters, digits and
    underscores, and lines by line feeds.
    """
    word = lambda rx: rf"(?<![A-Za-z0-9_])(?:{rx})(?![A-Za-z0-9_])"

    def part(rx: str) -> Column:
        x, y = F.regexp_count(F.col(a), F.lit(rx)), F.regexp_count(F.col(b), F.lit(rx))
        return F.abs(x - y) / F.greatest(x, y, F.lit(1))

    return 0.3 * part(word("def|class|function|func")) + 0.3 * part(word("if|for|while|switch")) + 0.2 * part(word("try|except|catch|raise|throw")) + 0.2 * part(r"(?dm)^\s*(?:#|//|\*)")


def pairwise_within(df: DataFrame, block: str, key: str, vector: str, threshold: float) -> DataFrame:
    """(a, b, similarity) of pairs of a block whose cosine reaches the threshold, through blocked matrix products.

    A block is cut into tiles of rows; a task holds two tiles, so a block of any size is spread over the cluster.
    """
    import numpy as np
    import pandas as pd

    tile = 512
    rows = df.where(F.col(vector).isNotNull()).select(F.col(block).alias("g"), F.col(key).alias("k"), F.col(vector).alias("v"))
    # blocks are counted by an aggregation, and a row's tile goes by its hash, so that no block passes through one task
    most = rows.groupBy("g").agg((F.ceil(F.count("*") / tile) - 1).cast("int").alias("m"))
    tiled = rows.join(most, "g").select("g", "k", "v", "m", F.pmod(F.xxhash64("k"), F.col("m") + 1).cast("int").alias("t"))
    # a row of tile t takes part in the tasks (i, t) with i <= t and (t, j) with j > t
    sent = tiled.select("g", "k", "v", "t", F.explode(F.transform(F.sequence(F.lit(0), F.col("m")), lambda o: F.struct(F.least(o, F.col("t")).alias("i"), F.greatest(o, F.col("t")).alias("j")))).alias("p"))

    def compare(pdf):
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        x, y = pdf[pdf["t"] == i], pdf[pdf["t"] == j]
        unit = lambda p: (m := np.array(p["v"].tolist(), float)) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        s = unit(x) @ unit(y).T
        a, b = np.nonzero(s >= threshold)
        ka, kb = x["k"].to_numpy()[a], y["k"].to_numpy()[b]
        keep = ka < kb if i == j else np.ones(len(ka), bool)
        return pd.DataFrame({"a": np.minimum(ka, kb)[keep], "b": np.maximum(ka, kb)[keep], "similarity": s[a, b][keep]})

    return sent.select("g", "k", "v", "t", "p.i", "p.j").groupBy("g", "i", "j").applyInPandas(compare, "a bigint, b bigint, similarity double")
