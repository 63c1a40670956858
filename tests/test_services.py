"""Operators of the service layer against loops over small fixtures."""

import random

from pyspark.sql import functions as F

from codeloom.operators import design as G, services as S, store as P


def test_batch_sizes_like_a_loop(spark):
    r = random.Random(3)
    rows = [(s, i, r.choice([0.0, 0.0, 0.0, 0.5, None])) for s in range(4) for i in range(60)]
    got = {(x["s"], x["i"]): x["size"] for x in S.batch_sizes(spark.createDataFrame(rows, "s int, i bigint, error_rate double"), "s", "i").collect()}
    for s in range(4):
        size, good, bad = 25, 0, 0
        for _, i, rate in sorted(x for x in rows if x[0] == s):
            assert got[s, i] == size
            if (rate or 0.0) > 0.1:
                good, bad = 0, bad + 1
                size = max(2, int(size * 0.5)) if bad >= 2 else size
            else:
                good, bad = good + 1, 0
                if good >= 3:
                    size, good = min(100, int(size * 1.5)), 0


def test_dbscan_like_a_loop(spark):
    r = random.Random(4)
    n = 60
    pairs = {(i, j) for i in range(n) for j in range(i + 1, n) if r.random() < 0.03}
    for least in (1, 2, 3, 4):
        near = {i: {j for p in pairs if i in p for j in p if j != i} for i in range(n)}
        core = {i for i in range(n) if len(near[i]) + 1 >= least}
        label = {}
        for i in sorted(core):
            todo = [i] if i not in label else []
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = i
                    todo += [y for y in near[x] if y in core]
        want = {i: label.get(i, min((label[j] for j in near[i] if j in core), default=-1)) for i in range(n)}
        df = spark.createDataFrame([*pairs, (1, 1)], "a bigint, b bigint")
        assert {x["id"]: x["cluster"] for x in S.dbscan(spark.range(n), df, "id", least).collect()} == want


def test_min_hash_like_a_loop(spark):
    import hashlib

    rows = [(0, ["a", "b"]), (1, []), (2, None), (3, ["b", "a", "a"]), (4, ["c", None])]
    got = {x["k"]: x["signature"] for x in P.min_hash(spark.createDataFrame(rows, "k int, f array<string>"), "k", "f").collect()}
    rng = random.Random(42)
    a, b = [rng.randint(1, 2**32 - 1) for _ in range(128)], [rng.randint(0, 2**32 - 1) for _ in range(128)]
    hashed = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in "abc"}
    assert got[0] == got[3] == [min((x * hashed[w] + y) % 4294967311 for w in "ab") for x, y in zip(a, b)]
    assert got[1] == [0] * 128 and got[2] is None and got[4] == [(x * hashed["c"] + y) % 4294967311 for x, y in zip(a, b)]
    same = spark.createDataFrame([([1, 2], [1, 3]), ([], []), ([1], [1, 2])], "a array<bigint>, b array<bigint>").select(P.min_hash_similarity("a", "b").alias("s"))
    assert [x["s"] for x in same.collect()] == [0.5, 0.0, None]


def test_nearest_colours_in_parts(spark, monkeypatch):
    r = random.Random(5)
    colour = lambda: "#" + "".join(r.choice("0123456789ABCDEF") for _ in range(8))
    tokens, colours = [(f"t{i:03}", colour()) for i in range(50)], [colour() for _ in range(30)]
    colours[0] = tokens[7][1]
    df, t = spark.createDataFrame([(c,) for c in [*colours, None, "red"]], "c string"), spark.createDataFrame([*tokens, ("bad", "x"), (None, "#00000000")], "name string, value string")
    far = lambda x, y: sum((int(x[i : i + 2], 16) - int(y[i : i + 2], 16)) ** 2 for i in (1, 3, 5, 7)) ** 0.5 / 510
    want = {c: min((round(far(c, v), 9), n) for n, v in tokens) for c in colours}
    for most in (10_000, 7):
        monkeypatch.setattr(G, "MOST_TOKENS", most)
        got = {x["c"]: (x["distance"], x["token"], x["match"]) for x in G.nearest_colour(df, "c", t).collect()}
        assert all(abs(got[c][0] - want[c][0]) < 1e-8 and got[c][1] == want[c][1] for c in colours)
        assert got[colours[0]][2] == "exact" and got[None] == got["red"] == (None, None, None)


def test_small_predicates(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(S.retryable(F.lit("HTTP 503 returned"), F.lit(0))) and not one(S.retryable(F.lit("HTTP 503"), F.lit(3))) and not one(S.retryable(F.lit(None), F.lit(0)))
    assert one(S.backoff(F.lit(3))) == 8.0 and one(S.backoff(F.lit(40))) == 60.0
    assert one(S.exclusion_reason(F.lit("a.so"), F.lit("x"))) == "extension" and one(S.exclusion_reason(F.lit("a.EXE"), F.lit("MZ.."))) == "magic" and one(S.exclusion_reason(F.lit("a"), F.lit("\x7fELF.."))) == "magic" and one(S.exclusion_reason(F.lit("a.py"), F.lit(""))) is None
    assert one(S.has_rationale(F.lit("/* eslint-disable a -- long table */"), F.lit("eslint-disable"))) and not one(S.has_rationale(F.lit("// eslint-disable: why"), F.lit("eslint-disable")))
    rules = [("a", "build/"), ("b", "!build/keep.py"), ("b", "*.log")]
    assert [one(S.ignored_by_layers(F.lit(p), rules)) for p in ("build/x.py", "build/keep.py", "a.log", "src/a.py")] == ["a", None, "b", None]
    assert one(S.weighted_observations(F.lit(None), F.lit("d"), F.array(F.lit("Class: A"), F.lit(None), F.lit("x")))) == "Description: d | Description: d | Class: A | Class: A | Class: A | x"
