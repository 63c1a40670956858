from pyspark.sql import functions as F

from codeloom.operators import reports as R


def test_sessions_do_not_depend_on_order(spark):
    rows = [("p", "R", "a", 1), ("p", "S", "b", 2), ("q", "R", "a", 1), ("q", "R", "a", 1)]
    schema = "project string, rule_id string, file_path string, line int"
    get = lambda x: dict(map(tuple, R.session_ids(spark.createDataFrame(x, schema), "project").collect()))
    a, b = get(rows), get(rows[::-1] + rows[:1])
    assert a == b and a["p"] != a["q"] and all(len(v) == 12 for v in a.values())
    assert get([*rows, ("p", "T", None, None)])["p"] != a["p"]


def test_split_large(spark):
    one = lambda t: spark.range(1).select(R.split_large(F.lit(t), 10).alias("x")).first()["x"]
    assert one("short") == ["short"]
    assert one("aaaa bbbb\n\ncccc\ndddd eeee") == ["aaaa bbbb", "cccc", "dddd eeee"]
    assert one("x" * 30) == ["x" * 30]


def test_doc_summary(spark):
    one = lambda t: spark.range(1).select(R.doc_summary(F.lit(t)).alias("x")).first()["x"]
    assert one("/**\n * Reads a file. Twice.\n * @param x y\n */") == "Reads a file."
    assert one("# no end here") == "no end here"


def test_collections(spark):
    R.create_collection(spark, "col_a", "id bigint, kind string", "kind", {"dim": "64"}, replace=True)
    spark.createDataFrame([(1, "x")], "id bigint, kind string").write.insertInto("col_a")
    R.create_collection(spark, "col_a", "id bigint, kind string", "kind")
    assert spark.table("col_a").count() == 1
    R.create_collection(spark, "col_a", "id bigint, kind string", "kind", replace=True)
    assert spark.table("col_a").count() == 0
    spark.sql("drop table col_a")
    a, b = spark.range(3), spark.range(5)
    assert sorted(r["id"] for r in R.restore(a, b, "id").collect()) == [3, 4]
