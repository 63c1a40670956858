"""Scalar functions on edge cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from codeloom.functions import hashing as H, style as S, text as X, vector as V


def one(spark, column, **values):
    row = spark.range(1).select(*(v.alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def vec(*v):
    return F.array(*map(F.lit, v)).cast("array<float>") if v else F.array().cast("array<float>")


@pytest.mark.parametrize("a, b, want", [((1.0, 0.0), (1.0, 0.0), 1.0), ((1.0, 0.0), (0.0, 1.0), 0.0), ((1.0, 0.0), (-1.0, 0.0), 0.0), ((), (), 0.0), ((1.0,), (1.0, 2.0), 0.0), ((0.0, 0.0), (1.0, 1.0), 0.0)])
def test_cosine(spark, a, b, want):
    assert one(spark, V.cosine("a", "b"), a=vec(*a), b=vec(*b)) == pytest.approx(want)


def test_jaccard_of_empty_sets(spark):
    e = F.array().cast("array<string>")
    assert one(spark, H.jaccard("a", "b", 1.0), a=e, b=e) == 1.0
    assert one(spark, H.jaccard("a", "b"), a=e, b=e) == 0.0
    assert one(spark, H.jaccard("a", "b"), a=F.array(F.lit("x"), F.lit("y")), b=F.array(F.lit("y"))) == 0.5


def simhash(words):
    votes = [0] * 64
    for w in words:
        h = int(hashlib.md5(w.encode()).hexdigest()[16:], 16)
        for i in range(64):
            votes[i] += 1 if h >> i & 1 else -1
    return f"{sum(1 << i for i in range(64) if votes[i] > 0):016x}"


@pytest.mark.parametrize("words", [[], ["a"], ["a", "b", "b"], [f"w{i}" for i in range(50)]])
def test_simhash(spark, words):
    col = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    assert one(spark, H.simhash_bits("w"), w=col) == simhash(words)


def test_hamming(spark):
    assert one(spark, H.hamming_similarity("a", "b"), a=F.lit("ffffffffffffffff"), b=F.lit("0000000000000000")) == 0.0
    assert one(spark, H.hamming_similarity("a", "b"), a=F.lit("f0f0f0f0f0f0f0f1"), b=F.lit("f0f0f0f0f0f0f0f0")) == 1 - 1 / 64


@pytest.mark.parametrize("value, want", [("#abc", "#AABBCCFF"), ("#abcd", "#AABBCCDD"), ("#a1b2c3", "#A1B2C3FF"), ("#A1B2C380", "#A1B2C380"), ("rgb(255, 0, 16)", "#FF0010FF"), ("rgba(0,0,0,0.5)", "#00000080"), ("red", None), (None, None)])
def test_colours(spark, value, want):
    assert one(spark, S.normal_colour("c"), c=F.lit(value).cast("string")) == want


def test_contrast(spark):
    assert one(spark, S.contrast("a", "b"), a=F.lit("#FFFFFFFF"), b=F.lit("#000000FF")) == pytest.approx(21.0)


@pytest.mark.parametrize("value, want", [("16px", 16.0), ("1.5rem", 24.0), ("2em", 32.0), ("50%", None), ("7", 7.0), ("x", None)])
def test_lengths(spark, value, want):
    assert one(spark, S.pixels("v"), v=F.lit(value)) == want


@pytest.mark.parametrize("selector, want", [("#a .b", 110), ("div > p", 2), ("a:hover", 11), ("*", 0), ("[x] .y::before", 21)])
def test_specificity(spark, selector, want):
    assert one(spark, S.specificity("s"), s=F.lit(selector)) == want


def test_tokens(spark):
    assert one(spark, X.tokens("t"), t=F.lit("Foo_bar a x1 Größe it's 42")) == ["x1", "it", "42"]
    assert one(spark, X.tokens("t"), t=F.lit("")) == []
    assert one(spark, X.tokens("t"), t=F.lit(None).cast("string")) is None


def test_markup(spark):
    assert one(spark, X.strip_markup("t"), t=F.lit("<p>a&amp;lt;b</p><script>x</script><ul><li>c</ul>")) == "a&lt;b\n- c"


def test_naming(spark):
    for n, want in (("foo_bar", "snake"), ("FOO_BAR", "upper"), ("FooBar", "pascal"), ("fooBar", "camel"), ("foo-bar", "other")):
        assert one(spark, X.naming_style("n"), n=F.lit(n)) == want


def test_selector_weights(spark):
    from codeloom.functions import style as S

    cases = {"a": 1, "*": 0, "ul li a": 3, ".a.b": 20, "#x .a > b": 111, "a:hover": 11, "a::before": 2, "p:first-line": 2, "[href='a,b']": 10, ":is(.a, #b c)": 101, ":not(.a)": 10, ":where(#a)": 0, "li:nth-child(2n of .x, #y)": 21, "a, #b": 100, "": 0}
    df = spark.createDataFrame([*((k, v) for k, v in cases.items()), (None, None)], "s string, w int")
    assert df.select((S.specificity("s").eqNullSafe(df.w)).alias("ok"), "s").where("not ok").collect() == []
