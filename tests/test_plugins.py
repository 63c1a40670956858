"""Registries and sources that users extend."""

import json
import os

import pytest
from pyspark.sql import functions as F

from codeloom import plugins as P
from codeloom.rules import ANY, Rule


def test_parsers(spark):
    P.parsers.add("toy", lambda t: [("word", w, None, 1, 1) for w in t.split()] if t != "bad" else 1 / 0)
    try:
        rows = [(1, "a.toy", "x y"), (2, "b.TOY", "bad"), (3, "c.py", "class A:\n    def f(self): pass"), (4, "d.none", "x"), (5, "e.toy", None), (6, "f.yaml", "a:\n  b: 1"), (7, "g.js", "class B { m() { } }")]
        got = {(r["file_id"], r["kind"], r["name"], r["owner"]) for r in P.parse(spark.createDataFrame(rows, "file_id bigint, file_path string, content string")).collect()}
        assert got >= {(1, "word", "x", None), (1, "word", "y", None), (2, "error", None, None), (3, "class", "A", None), (3, "method", "f", "A"), (6, "key", "b", "a"), (7, "class", "B", None)}
        assert {x[0] for x in got} == {1, 2, 3, 6, 7}
        with pytest.raises(ValueError):
            P.parsers.add("toy", len)
    finally:
        P.parsers.remove("toy")
    with pytest.raises(KeyError):
        P.parsers.get("toy")


def test_own_rules(spark):
    P.add_rule(Rule("OWN.WORD", "LOW", ANY, r"forbidden"))
    try:
        files = spark.createDataFrame([(1, "a.py", "x = 'forbidden'\nbreakpoint()")], "file_id bigint, file_path string, content string")
        assert {r["rule_id"] for r in P.scan_with_plugins(files).collect()} == {"OWN.WORD", "TECH_DEBT.BREAKPOINTS"}
    finally:
        P._rules.clear()


def test_embedders(spark):
    P.embedders.add("size", lambda texts: [(len(t), 1) for t in texts])
    P.embedders.add("short", lambda texts: [])
    try:
        df = spark.createDataFrame([(1, "abc"), (2, None), (3, ""), (4, "abc")], "k int, t string")
        assert {r["k"]: r["embedding"] for r in P.embed(df, "size", "k", "t", batch=1).collect()} == {1: [3.0, 1.0], 2: None, 3: [0.0, 1.0], 4: [3.0, 1.0]}
        with pytest.raises(Exception, match="gave 0 vectors"):
            P.embed(df, "short", "k", "t").collect()
    finally:
        P.embedders.remove("size"), P.embedders.remove("short")


def test_stores(spark, tmp_path):
    store = P.stores.get("parquet")(spark, f"file://{tmp_path}")
    with pytest.raises(KeyError):
        store.read("c")
    store.upsert("c", spark.createDataFrame([(1, "a"), (2, "b"), (None, "x")], "k int, v string"), "k")
    store.upsert("c", spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string").withColumn("extra", F.lit(1)), "k")
    store.delete("c", spark.createDataFrame([(1,), (9,)], "k int"), "k")
    assert {(r["k"], r["v"], r["extra"]) for r in store.read("c").collect()} == {(2, "B", 1), (3, "C", 1)}


def test_token_readers(spark):
    text = json.dumps({"color": {"$type": "color", "red": {"$value": "#f00"}, "deep": {"blue": {"value": "#00f", "type": "paint"}}}, "space": {"s": "4px"}, "n": 3, "off": True})
    files = spark.createDataFrame([(1, text), (2, "{"), (3, None)], "file_id bigint, content string")
    assert {tuple(r)[1:] for r in P.read_tokens(files, "json").collect()} == {("color.red", "#f00", "color"), ("color.deep.blue", "#00f", "paint"), ("space.s", "4px", "spacing"), ("n", "3", "dimension")}
    config = "module.exports = { theme: { extend: { colors: { brand: { light: '#fff', 'dark-1': \"#000\" }, red: '#f00' }, spacing: { 4: '1rem' } } } }"
    assert P.tailwind_tokens(config) == [("colors.brand.light", "#fff", "color"), ("colors.brand.dark-1", "#000", "color"), ("colors.red", "#f00", "color"), ("spacing.4", "1rem", "spacing")]


def test_sources(spark, tmp_path):
    P.register_sources(spark)
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "b.bin").write_bytes(b"\xff\x00")
    got = {r["file_path"]: (r["size"], r["content"]) for r in spark.read.format("codeloom_files").option("path", str(tmp_path)).option("filesPerPartition", 1).load().collect()}
    assert got == {"src/a.py": (6, "x = 1\n"), "b.bin": (2, "\ufffd\x00")}
    lines = [{"type": "user", "message": {"role": "user", "content": "hi"}, "timestamp": "t"}, {"role": "assistant", "content": [{"text": "a"}, {"x": 1}, {"text": "b"}]}, [1], {"type": "summary"}]
    (tmp_path / "old.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nbroken")
    (tmp_path / "new.jsonl").write_text(json.dumps(lines[0]))
    os.utime(tmp_path / "old.jsonl", (1, 1))
    load = lambda **o: {tuple(r) for r in spark.read.format("codeloom_chats").options(path=str(tmp_path), **o).load().collect()}
    assert load() == {("old.jsonl", 1, "user", "hi", "t"), ("old.jsonl", 2, "assistant", "a\nb", None), ("new.jsonl", 1, "user", "hi", "t")}
    assert {x[0] for x in load(limit="1")} == {"new.jsonl"}
    empty = tmp_path / "none"
    empty.mkdir()
    assert spark.read.format("codeloom_files").option("path", str(empty)).load().count() == 0
