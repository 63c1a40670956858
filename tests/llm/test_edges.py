"""Every operator on empty tables, null rows, repeated rows, clashing columns and very long texts."""

import pytest
from pyspark.sql import functions as F

from codeloom.llm import contamination as L, credentials as C, docpairs as D, neardup as N, packing as K, provenance as P, splitting as S, syntax as Y, truncation as T

FILES = "file_id bigint, repo string, file_path string, content string"
ENTITIES = "entity_id bigint, file_id bigint, repo string, name string, entity_type string, file_path string, start_line int, end_line int, content string"
DOCS = "doc_id bigint, text string, lang string, source string"
ITEMS = "item_id bigint, suite string, text string, answer string"
LONG = "\n".join(f"value_{i} = compute({i}, 'text {i}')" for i in range(40_000))


def files(spark, *rows):
    return spark.createDataFrame([*rows], FILES).withColumn("kind", F.lit("clash")).withColumn("h", F.lit(1)).withColumn("package", F.lit(2)).withColumn("valid", F.lit(3)).withColumn("hs", F.lit(4)).withColumn("line_no", F.lit(5))


def entities(spark, *rows):
    return spark.createDataFrame([*rows], ENTITIES).withColumn("id", F.lit(1)).withColumn("rep", F.lit("clash")).withColumn("words", F.lit(2)).withColumn("owner", F.lit(3)).withColumn("description", F.lit(4))


def docs(spark, *rows):
    return spark.createDataFrame([*rows], DOCS).withColumn("t", F.lit("clash")).withColumn("h", F.lit(1)).withColumn("words", F.lit(2)).withColumn("trial", F.lit(3)).withColumn("n_tokens", F.lit("clash"))


RUNS = {
    "p1_pairs": lambda s, f, e, d, i: N.near_duplicate_pairs(e), "p1_groups": lambda s, f, e, d, i: N.near_duplicate_groups(e), "p2": lambda s, f, e, d, i: C.find_credentials(f), "p2_redact": lambda s, f, e, d, i: C.redact(f), "p3": lambda s, f, e, d, i: S.split_oversized(e),
    "p4": lambda s, f, e, d, i: P.provenance(f), "p5": lambda s, f, e, d, i: Y.unparsable(f), "p6": lambda s, f, e, d, i: D.documented(e, f), "p7": lambda s, f, e, d, i: K.pack(d), "p8": lambda s, f, e, d, i: L.leaks(d, i), "p9": lambda s, f, e, d, i: T.truncation(d), "p9_rates": lambda s, f, e, d, i: T.rates(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_empty_tables(spark, name):
    assert RUNS[name](spark, files(spark), entities(spark), docs(spark), spark.createDataFrame([], ITEMS)).count() == 0


@pytest.mark.parametrize("name", RUNS)
def test_nulls_repeats_and_long_texts(spark, name):
    f = files(spark, (None,) * 4, (1, None, None, None), (2, "r", "a.py", ""), (3, None, "b.py", LONG), (3, None, "b.py", LONG), (4, "r", None, "x"), (5, "r", "c.js", "x" * 300_000))
    e = entities(spark, (None,) * 9, (1,) + (None,) * 8, (2, 3, None, "f", "Function ", "b.py", 1, None, LONG), (2, 3, None, "f", "Function ", "b.py", 1, None, LONG), (3, 2, "r", "g", "method", "a.py", None, None, ""), (4, 5, "r", "h", "function", "c.js", 1, 1, "x" * 300_000))
    d = docs(spark, (None,) * 4, (1, None, None, None), (2, "", "en", "s"), (3, LONG, None, None), (3, LONG, None, None), (4, "word " * 100_000, "xx", "s"))
    i = spark.createDataFrame([(None,) * 4, (1, None, None, None), (2, "s", "", ""), (3, "s", "compute 1 text 1 value_2 compute 2 text 2 value_3 compute 3 text 3 value_4 compute 4 text", None), (3, "s", "again", "x")], ITEMS)
    rows = RUNS[name](spark, f, e, d, i).collect()
    key = {"p1": "a", "p2": "file_id", "p3": "entity_id", "p4": "file_id", "p5": "file_id", "p6": "entity_id", "p7": "doc_id", "p8": "doc_id", "p9": "doc_id"}[name[:2]]
    if name in ("p5", "p9", "p4"):
        keys = [r[key] for r in rows]
        assert len(keys) == len(set(keys)) and None not in keys
    if name == "p5":
        assert {r["file_id"]: r["valid"] for r in rows} == {2: True, 3: True, 5: True}
    if name == "p7":
        load: dict = {}
        for r in rows:
            load[r["container"]] = load.get(r["container"], 0) + r["n_tokens"]
        assert max(load.values()) <= K.CAPACITY and {r["doc_id"] for r in rows} == {1, 2, 3, 4}
    if name == "p3":
        assert {r["entity_id"] for r in rows} == {2, 4}
