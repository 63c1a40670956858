"""Operators on small fixtures: nulls, ties, empty tables, skewed keys."""

import random

from pyspark.sql import functions as F

from codeloom import rules as R
from codeloom.operators import changes as C, chunking as K, dedup as D, design as G, graph as Gr, search as S, stats as T
from codeloom.operators.components import connected_components
from codeloom.sources import files as Fi, parsers as P, sinks as Si


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_components_of_a_hub_and_a_chain(spark):
    e = [(1, i) for i in range(2, 200)] + [(300 + i, 301 + i) for i in range(30)] + [(500, 500), (None, 900)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(e, "a bigint, b bigint")).collect()))
    assert {got[i] for i in range(1, 200)} == {1}
    assert {got[300 + i] for i in range(31)} == {300}
    assert got[500] == 500 and 900 not in got


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_like_union_find(spark):
    r = random.Random(3)
    e = [(r.randrange(200), r.randrange(200)) for _ in range(150)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for p in e for x in p}
    assert dict(map(tuple, connected_components(spark.createDataFrame(e, "a bigint, b bigint")).collect())) == want


def test_dense_search_ties_nulls_and_lengths(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [1.0]), (6, [])], "vec_id bigint, embedding array<float>")
    got = rows(S.dense_search(p, p.where("vec_id = 1"), 3))
    assert [(r[1], round(r[2], 6), r[3]) for r in sorted(got, key=lambda r: r[3])] == [(1, 1.0, 1), (2, 1.0, 2), (3, 0.0, 3)]
    assert S.dense_search(p, p.where("false"), 3).count() == 0


def test_fuse_misses_on_one_side(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id bigint, doc_id bigint, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id bigint, doc_id bigint, rank int")
    got = S.fuse(a, b, 10, alpha=0.5).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [11, 10, 12]


def test_keyword_search_on_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "word")], "query_id bigint, query string")
    assert S.keyword_search(d, q, 5).count() == 0


def test_changes_with_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id int, v string")
    b = spark.createDataFrame([(2, None), (3, "y"), (4, None)], "id int, v string")
    assert rows(C.classify_changes(a, b, "id", "v")) == [(1, "deleted"), (2, "unchanged"), (3, "modified"), (4, "added")]


def test_diff_scope(spark):
    f = spark.createDataFrame([("a", 5), ("a", 9), ("b", 1), (None, 1)], "file_path string, line int")
    r = spark.createDataFrame([("a", 4, 6), ("a", 5, 7)], "file_path string, start int, end int")
    assert rows(C.in_diff_scope(f, r)) == [("a", 5, True), ("a", 9, False), ("b", 1, False), (None, 1, True)]


def test_last_wins_and_split(spark):
    d = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 1, "c"), (None, 3, "d")], "k int, t int, v string")
    assert rows(D.last_wins(d, ["k"], [F.desc("t")]).select("k", "v")) == [(1, "b"), (None, "d")]
    new, old = D.split_known(d.withColumnRenamed("v", "h"), spark.createDataFrame([("a",), (None,)], "h string"), "h")
    assert old.count() == 1 and new.count() == 3


def test_percentile_by_rank(spark):
    v = [1, 1, 1, 2, 9]
    d = spark.createDataFrame([("g", x) for x in v] + [("g", None), ("h", None)], "g string, v int")
    want = {p: sorted(v)[min(int(len(v) * p), len(v) - 1)] for p in (0.5, 0.6, 0.95)}
    got = T.percentile_by_rank(d, ["g"], "v", {"p50": 0.5, "p60": 0.6, "p95": 0.95}).collect()
    assert [tuple(r) for r in got] == [("g", want[0.5], want[0.6], want[0.95])]


def test_positions_and_quintiles(spark):
    d = spark.range(23).select(F.col("id"), (F.col("id") % 3).alias("k"))
    got = {r["id"]: r["i"] for r in T.positions(d, ["k", "id"]).collect()}
    want = sorted(range(23), key=lambda i: (i % 3, i))
    assert [got[i] for i in want] == list(range(23))
    assert T.quintiles(spark.range(0), ["id"]).count() == 0


def test_k_hop_and_degrees(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), (None, "x"), ("y", None)], "from_entity string, to_entity string")
    got = rows(Gr.k_hop(e, spark.createDataFrame([("a",)], "name string"), 2))
    assert got == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 2)]
    assert dict((r["name"], (r["n_out"], r["n_in"])) for r in Gr.degrees(e).collect())["b"] == (2, 1)


def test_module_resolution(spark):
    f = spark.createDataFrame([("./src/core/io.py",), ("lib/io.py",), ("lib/a/io.py",)], "file_path string")
    m = spark.createDataFrame([("core.io",), (".io",), ("none",), (None,)], "module string")
    assert rows(Gr.resolve_modules(m, f)) == [(".io", "lib/io.py"), ("core.io", "./src/core/io.py")]


def test_chunking(spark):
    d = spark.createDataFrame([(1, "a\r\nb\nc"), (2, ""), (3, None)], "id int, t string")
    assert rows(d.select("id", K.line_blocks("t", 2).alias("b"))) == [(1, ["a\nb", "c"]), (2, [""]), (3, None)]
    assert d.select(K.with_overlap(F.array(F.lit("abc"), F.lit("de"), F.lit("f")), 2).alias("x")).first()["x"] == ["abc", "bcde", "def"]


def test_section_paths_skip_code(spark):
    d = spark.createDataFrame([(1, "# A\n## B\n```\n# no\n```\n## C\n# D\n### E")], "id int, t string")
    got = [r["path"] for r in K.section_paths(K.headings(d, "id", "t"), "id").orderBy("line_no").collect()]
    assert got == ["A", "A > B", "A > C", "D", "D > E"]


def test_pack_sections(spark):
    got = spark.range(1).select(K.pack_sections(F.array(*map(F.lit, ["x" * 40, "y" * 40, "z" * 400, "w"])), 25, 10).alias("p")).first()["p"]
    assert [len(x) for x in got] == [81, 400, 1]


def test_rules(spark):
    f = spark.createDataFrame(
        [(1, "a.py", "try:\n    x()\nexcept Exception:\n    pass\nbreakpoint()\n# TODO later"), (2, "b.sh", "git push --force origin\ngit push --force-with-lease"), (3, "c.py", None), (4, "d.txt", "breakpoint()")],
        "file_id bigint, file_path string, content string",
    )
    got = {(r["file_id"], r["line_no"], r["rule_id"]) for r in R.scan(f).collect()}
    assert got == {(1, 3, "RESILIENCE.SWALLOWED_EXCEPTIONS"), (1, 5, "TECH_DEBT.BREAKPOINTS"), (1, 6, "TECH_DEBT.TODO_MARKERS"), (2, 1, "GIT.FORCE_PUSH")}
    assert R.blocked(R.scan(f)).first()["blocked"] is True
    assert tuple(R.blocked(R.scan(f.where("false"))).first()) == (False, 0)


def test_fixes_apply_from_the_end(spark):
    f = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "x")], "file_id bigint, content string")
    x = spark.createDataFrame([(1, 1, 1, "A"), (1, 3, 4, "C")], "file_id bigint, start int, end int, text string")
    assert dict(map(tuple, R.apply_fixes(f, x).collect())) == {1: "A\nb\nC", 2: "x"}


def test_design(spark):
    d = spark.createDataFrame([(1, 7.0), (2, 8.0), (3, 100.0), (4, None)], "id int, v double")
    assert [r["match"] for r in G.nearest_number(d, "v", [8, 16], 1).orderBy("id").collect()] == ["near", "exact", "off_scale", None]
    s = spark.createDataFrame([("a", {"Color": "Red"}), ("b", {"color ": "red"}), ("c", {"color": "blue"}), ("d", None)], "file_path string, declarations map<string,string>")
    assert [(r["n"], r["n_files"]) for r in G.duplicate_styles(s).collect()] == [(2, 2)]
    m = spark.createDataFrame([({"pt": "1", "pr": "1", "x": "2"},), ({"pt": "1", "pr": "3"},)], "m map<string,string>")
    assert [r["x"] for r in m.select(G.collapse_shorthand("m", "p", ["pt", "pr"]).alias("x")).collect()] == [{"x": "2", "p": "1"}, {"pt": "1", "pr": "3"}]


def test_pairwise_over_several_tiles(spark):
    d = spark.range(1200).select(F.lit("g").alias("g"), "id", F.array((F.col("id") % 600).cast("float"), F.lit(1.0).cast("float")).alias("v"))
    got = G.pairwise_within(d, "g", "id", "v", 1 - 1e-12)
    assert got.where("b - a = 600").count() == 600


def test_git_sources(spark):
    d = spark.createDataFrame([("A\ta",), ("R090\told\tnew",), ("D\tx",), ("X\ty",), ("",)], "value string")
    assert rows(Fi.parse_name_status(d)) == [("a", "added", None), ("new", "modified", None), ("new", "renamed", "old"), ("x", "deleted", None), ("y", "modified", None)]
    h = spark.createDataFrame([("f", "@@ -1,2 +3,4 @@ x"), ("f", "@@ -1 +9 @@"), ("f", "@@ -1 +9,0 @@"), ("f", "+x")], "path string, value string")
    assert rows(Fi.parse_hunks(h)) == [("f", 3, 6), ("f", 9, 9)]


def test_chats(spark):
    d = spark.createDataFrame(
        [('{"message":{"role":"user","content":[{"type":"text","text":"hi"},{"type":"image"}]},"timestamp":"2024-01-02T03:04:05Z"}',), ('{"role":"assistant","content":"yo"}',), ('{"type":"user","text":"x"}',), ("{broken",)], "value string"
    )
    assert sorted((r["role"], r["text"]) for r in Fi.parse_chats(d).collect()) == [("assistant", "yo"), ("user", "hi"), ("user", "x")]


def test_ignore_patterns(spark):
    d = spark.createDataFrame([("a/b.log",), ("keep.log",), ("build/x",), ("src/build2/x",), ("a/z/q.py",)], "path string")
    got = {r["path"]: r["is_ignored"] for r in Fi.ignored(d, ["*.log", "!keep.log", "build/", "a/**/q.py"]).collect()}
    assert got == {"a/b.log": True, "keep.log": False, "build/x": True, "src/build2/x": False, "a/z/q.py": True}


def test_tokens_and_parsers(spark):
    c = spark.createDataFrame([(":root{--main: #fff; --gap:8px;--font-base: 1rem; --radius-s: 2px}",)], "content string")
    assert {r["name"]: r["category"] for r in Fi.css_tokens(c).collect()} == {"main": "colour", "gap": "spacing", "font-base": "font_size", "radius-s": "radius"}
    f = spark.createDataFrame([(1, "x.py", "import os\nclass A(B):\n    def f(self, a):\n        'd'\n"), (2, "y.py", "def ("), (3, "z.py", None)], "file_id bigint, file_path string, content string")
    assert {(r["kind"], r["name"]) for r in P.python_symbols(f).collect()} == {("import", "os"), ("class", "A"), ("inherits", "B"), ("method", "f")}
    h = spark.createDataFrame([(1, "", '<a href="u" class="p q" id="i"><my-tag/></a>')], "file_id bigint, file_path string, content string")
    assert {(r["kind"], r["name"]) for r in P.html_parts(h).collect()} == {("link", "u"), ("class", "p"), ("class", "q"), ("id", "i"), ("component", "my-tag")}
    s = spark.createDataFrame([(1, "", "@import 'x.css'; .a{--v: 1} #b {color:red}")], "file_id bigint, file_path string, content string")
    assert {(r["kind"], r["name"]) for r in P.css_definitions(s).collect()} == {("import", "x.css"), ("class", "a"), ("variable", "--v"), ("id", "b")}


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "id int, v string")
    assert rows(Si.upsert(a, b, "id")) == [(1, "x"), (2, "z"), (3, "w")]
    assert rows(Si.delete_by(a, b, "id")) == [(1, "x")]
    f = spark.createDataFrame([("R", "HIGH", "a.py", 3)], "rule_id string, severity string, file_path string, line_no int")
    assert '"level":"error"' in Si.sarif_results(f).first()["result"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text("x")
    assert Fi.discover(spark, str(tmp_path / "in"), "*.py").count() == 1
