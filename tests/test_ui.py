"""Design rules on a small style sheet and markup."""

import pytest
from pyspark.sql import functions as F

from codeloom.operators import ui as U

CSS = """.btn { color: #ff0000; padding: 8px 7px; border-radius: 4px }
/* .no { color: red } */
.btn-a { color: #112233; padding: 8px }
.btn-b { color: #112233; padding: 8px; }
#a #b .c { margin: 0; font-size: 13px !important }
@media (x) { .btn-c { color: #112233; padding: 8px } }
.btn-d { color: #112233; padding: 8px }
.btn-e { color: #112233; padding: 8px }
a:focus { outline: 1px solid }
b:focus { outline: 2px solid }
"""
HTML = '<div class="a b c"><p style="color:#112233; padding: 8px">x</p><i></i></div>'


@pytest.fixture()
def frames(spark):
    sheets = spark.createDataFrame([("s.css", CSS), ("n.css", None), ("e.css", "")], "file_path string, content string")
    markup = spark.createDataFrame([("x.html", HTML), ("y.html", HTML), ("z.html", HTML), ("n.html", None)], "file_path string, content string")
    tokens = spark.createDataFrame([("ink", "#112233"), ("bad", "nothing")], "name string, value string")
    return sheets, markup, tokens


def test_rule_sets(frames):
    got = {r["selector"]: (r["line"], r["declarations"]) for r in U.rule_sets(frames[0]).collect()}
    assert got[".btn"] == (1, {"color": "#ff0000", "padding": "8px 7px", "border-radius": "4px"})
    assert ".no" not in got and got[".btn-c"][1] == {"color": "#112233", "padding": "8px"}


def test_audit(frames):
    out = {(r["rule_id"], r["file_path"]) for r in U.audit(*frames, [4, 8], [4], [12, 16]).collect()}
    assert {("STYLE.DUPLICATE_SET", "s.css"), ("COLOR.NON_TOKEN", "s.css"), ("SPACING.OFF_SCALE", "s.css"), ("TYPE.OFF_SCALE", "s.css"), ("CSS.SPECIFICITY.ESCALATION", "s.css"), ("IMPORTANT.NEW_USAGE", "s.css"), ("ROLE.OUTLIER.BUTTON", "s.css"), ("FOCUS.RING.INCONSISTENT", "s.css")} <= out
    assert {("UTILITY.DUPLICATE_SEQUENCE", "x.html"), ("COMPONENT.DUPLICATE_CLUSTER", "x.html")} <= out
    assert not any(r == "RADIUS.OFF_SCALE" for r, _ in out)


def test_audit_of_nothing(frames):
    s, m, t = (f.where("false") for f in frames)
    assert U.audit(s, m, t, [4], [4], [4]).count() == 0


def test_weighted_similarity(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    none = F.lit(None).cast("double")
    assert one(U.weighted_similarity(none, F.lit(1.0), F.lit(1.0))) == pytest.approx(0.5)
    assert one(U.weighted_similarity(none, F.lit(1.0), F.lit(1.0), True)) == pytest.approx(1.0)
    assert one(U.weighted_similarity(none, none, none, True)) == 0.0


def test_tasks_and_targets(spark):
    t = spark.createDataFrame([(1, "low", 0.9, "s", "x"), (2, "medium", 0.75, "s", "x"), (3, "medium", 0.8, "r", "y"), (4, "high", 1.0, "r", None)], "id int, effort string, impact double, scope string, tag string")
    assert [r["id"] for r in U.quick_wins(t).collect()] == [1, 3]
    assert {(r["scope"], r["tag"]): (r["n"], r["impact"], r["ids"]) for r in U.merge_tasks(t).collect()}["s", "x"] == (2, 0.9, "1,2")
    e = spark.createDataFrame([("b", 40.0, 50.0), ("b", 44.0, 44.0), ("b", None, None)], "role string, width double, height double")
    assert [(r["n"], r["n_small"]) for r in U.tap_targets(e).collect()] == [(3, 1)]


def test_near_sets_like_brute_force(spark):
    # up to 13 differing bits, spread so that all 16-bit quarters differ from 4 on
    base = 0x0123456789ABCDEF
    flips = [sum(1 << (16 * (k % 4) + 3 * (k // 4)) for k in range(n)) for n in range(14)]
    values = [base ^ f for f in flips] + [base ^ (f << 1) for f in flips[5:]] + [base ^ 0xFFFFFFFFFFFFFFFF]
    rows = [(f"{(i * 7919) % 1000:03d}", f"f{i}.css", i, f"{v:016x}") for i, v in enumerate(values)]
    want = sorted((min(a, b)[1], 1 - bin(int(a[3], 16) ^ int(b[3], 16)).count("1") / 64) for n, a in enumerate(rows) for b in rows[:n] if bin(int(a[3], 16) ^ int(b[3], 16)).count("1") <= 12)
    df = spark.createDataFrame(rows, "h string, file_path string, line int, s string")
    for tile in (3, 512):
        assert sorted((r["file_path"], r["similarity"]) for r in U._near_sets(df, 0.8, tile).collect()) == want
    assert U._near_sets(df.where("false"), 0.8).count() == 0


def test_near_duplicate_sets_far_apart_are_reported(spark):
    """Every pair of sets within 12 bits, also where no quarter of the hash is equal."""
    from codeloom.functions import hashing as H

    css = [";".join(f"p{j}: {j if j != i else 'x'}px" for j in range(7)) for i in range(24)]
    sheets = spark.createDataFrame([("a.css", "\n".join(f".c{i} {{ {c} }}" for i, c in enumerate(css)))], "file_path string, content string")
    styles = U.rule_sets(sheets)
    keys = styles.select(U.declaration_key("declarations").alias("k")).distinct().select(H.simhash_bits(F.split("k", ";")).alias("s"))
    bits = [int(r["s"], 16) for r in keys.collect()]
    pairs = [bin(a ^ b).count("1") for n, a in enumerate(bits) for b in bits[:n]]
    quarters = lambda a, b: any((a ^ b) >> 16 * q & 0xFFFF == 0 for q in range(4))
    assert any(bin(a ^ b).count("1") <= 12 and not quarters(a, b) for n, a in enumerate(bits) for b in bits[:n])
    assert U.duplicate_rules(styles).where("rule_id = 'STYLE.NEAR_DUPLICATE_SET'").count() == sum(d <= 12 for d in pairs)
