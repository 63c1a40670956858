"""The entity and relation graph: degrees, hops, orphans, resolution of module names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..session import ensure_checkpoint_dir


def edges(relations: DataFrame) -> DataFrame:
    """Relations once per id, names without outer blanks, confidence within 0 and 1. Null ends stay null."""
    r = relations.dropDuplicates(["relation_id"])
    return r.withColumn("from_entity", F.trim("from_entity")).withColumn("to_entity", F.trim("to_entity")).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))


def degrees(e: DataFrame) -> DataFrame:
    """(name, n_out, n_in) of every name at an end of an edge."""
    out = e.where("from_entity is not null").groupBy(F.col("from_entity").alias("name")).agg(F.count("*").alias("n_out"))
    into = e.where("to_entity is not null").groupBy(F.col("to_entity").alias("name")).agg(F.count("*").alias("n_in"))
    zero = F.lit(0).cast("bigint")
    return out.join(into, "name", "full").select("name", F.coalesce("n_out", zero).alias("n_out"), F.coalesce("n_in", zero).alias("n_in"))


def k_hop(e: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, name, distance): what each seed reaches over at most `hops` edges, with the least number of them.

    Every round joins the frontier only, and drops what was reached before; rounds are checkpointed. Hubs are joined by
    adaptive skew joins.
    """
    ensure_checkpoint_dir(e.sparkSession)
    step = e.where("from_entity is not null and to_entity is not null").select(F.col("from_entity").alias("name"), F.col("to_entity").alias("next")).distinct()
    reached = seeds.select(F.col("name").alias("seed"), "name").distinct().withColumn("distance", F.lit(0)).checkpoint()
    frontier = reached
    for i in range(1, hops + 1):
        new = frontier.join(step, "name").select("seed", F.col("next").alias("name")).distinct()
        frontier = new.join(reached, ["seed", "name"], "left_anti").withColumn("distance", F.lit(i)).checkpoint()
        reached = reached.unionByName(frontier)
    return reached


def orphan_edges(e: DataFrame, names: DataFrame, external: str = r"\.(?:json|ya?ml|csv|txt|md|html|css|xml|toml|ini|cfg|sql|log|png|jpe?g|svg|pdf|parquet|xlsx?|lock|env|sh|tsv)$") -> DataFrame:
    """Edges with an end that names nothing: a source that is no entity, or a target that is neither one nor an external file.

    A null target is not an end to resolve; a null source is an orphan.
    """
    known = names.select(F.trim("name").alias("name")).where("name is not null").distinct()
    a, b = known.select(F.col("name").alias("from_entity"), F.lit(True).alias("_s")), known.select(F.col("name").alias("to_entity"), F.lit(True).alias("_t"))
    j = e.join(a, "from_entity", "left").join(b, "to_entity", "left")
    lost = F.col("to_entity").isNotNull() & F.col("_t").isNull() & ~F.coalesce(F.lower("to_entity").rlike(external), F.lit(False))
    return j.where(F.col("_s").isNull() | lost).withColumn("reason", F.when(F.col("_s").isNull(), "source").otherwise("target")).drop("_s", "_t")


def missing_partner(chunks: DataFrame, have: str = "implementation", want: str = "metadata") -> DataFrame:
    """Chunks of one type whose entity has none of another type."""
    return chunks.where(F.col("chunk_type") == have).join(chunks.where(F.col("chunk_type") == want).select("entity_id").distinct(), "entity_id", "left_anti")


def path_keys(path: str) -> Column:
    """All names by which a module file can be called: every suffix of its path without extension, with dots."""
    bare = F.regexp_replace(X.clean_path(path), r"\.[^./]+$", "")
    parts = F.split(bare, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def resolve_modules(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(module, file_path): each module name with the file it names, the shortest path first and then the smallest.

    A containment test of every name in every path would be a nested loop; suffixes as keys make it an equi-join. A
    relative name counts without its leading dots; names without a file are not in the result.
    """
    keys = files.select("file_path", F.explode(path_keys("file_path")).alias("k")).groupBy("k").agg(F.min_by("file_path", F.struct(F.length("file_path"), "file_path")).alias("file_path"))
    names = wanted.select("module").where("module is not null").distinct().withColumn("k", F.regexp_replace("module", r"^\.+", ""))
    return names.join(keys, "k").select("module", "file_path")


def phantom_calls(calls: DataFrame, chunks: DataFrame) -> DataFrame:
    """Call edges whose source has implementations, none of which calls the target; sources without implementations are kept out.

    calls has relation_id, from_entity, to_entity. Comments do not count as calls.
    """
    code = F.array_join(F.transform(F.split("content", "\n"), lambda x: F.substring_index(x, "#", 1)), "\n")
    impl = chunks.where("chunk_type = 'implementation'").select(F.col("entity_name").alias("from_entity"), code.alias("code"))
    j = calls.where("to_entity is not null").join(impl, "from_entity")
    called = F.instr(F.col("code"), F.concat(F.substring_index("to_entity", ".", -1), F.lit("("))) > 0
    return j.groupBy("relation_id", "from_entity", "to_entity").agg(F.max(called).alias("called")).where("not called").drop("called")


def call_edges(implementations: DataFrame, names: DataFrame, scope: str = "file_path") -> DataFrame:
    """(scope, from_entity, to_entity): calls in implementations of names defined in the same scope."""
    calls = implementations.select(scope, F.col("entity_name").alias("from_entity"), F.explode(X.called_names("content")).alias("to_entity"))
    known = names.select(scope, F.col("name").alias("to_entity")).distinct()
    return calls.join(known, [scope, "to_entity"]).where("from_entity <> to_entity").select(scope, "from_entity", "to_entity").distinct()
