"""Markup and style sources, and the design rules over them.

Styles are rows (file_path, line, selector, declarations map). Findings are rows (rule_id, severity, file_path, line, detail).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import hashing as H, style as S
from .design import declaration_key, focus_consistency, nearest_colour, nearest_number
from .stats import mode_outliers


def rule_sets(sheets: DataFrame) -> DataFrame:
    """(file_path, line, selector, declarations) of the rule sets in style sheets and style blocks (file_path, content).

    Comments are dropped; nested blocks give their innermost rule sets; null contents give no row.
    """
    bare = F.regexp_replace("content", r"(?s)/\*.*?\*/", "")
    sets = F.regexp_extract_all(bare, F.lit(r"([^{}]+\{[^{}]*\})"), F.lit(1))
    rows = sheets.where("content is not null").select("file_path", bare.alias("b"), F.explode(sets).alias("r"))
    selector = F.trim(F.regexp_replace(F.substring_index("r", "{", 1), r"(?s)^.*[;>](?=\s*[^;>]+$)", ""))
    body = F.regexp_replace(F.substring_index(F.substring_index("r", "{", -1), "}", 1), r"\s*;\s*$", "")
    pairs = F.filter(F.transform(F.split(body, ";"), lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))).alias("key"), F.trim(F.substring(p, F.instr(p, F.lit(":")) + 1, F.length(p))).alias("value"))), lambda p: (p["key"] != "") & (p["value"] != ""))
    # the last declaration of a name counts
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda acc, p: F.map_concat(F.map_filter(acc, lambda k, v: k != p["key"]), F.create_map(p["key"], p["value"])))
    line = F.size(F.split(F.substring(F.col("b"), F.lit(1), F.instr("b", F.trim("r"))), "\n"))
    return rows.select("file_path", line.alias("line"), selector.alias("selector"), last.alias("declarations"))


def inline_styles(markup: DataFrame) -> DataFrame:
    """(file_path, line, selector, declarations) of style attributes in markup; the selector is the element's name."""
    tags = F.regexp_extract_all("content", F.lit("(<[a-zA-Z][\\w-]*[^<>]*\\bstyle=\"[^\"]+\")"), F.lit(1))
    rows = markup.where("content is not null").select("file_path", "content", F.explode(tags).alias("t"))
    line = F.size(F.split(F.substring(F.col("content"), F.lit(1), F.instr("content", F.col("t"))), "\n"))
    body = F.regexp_replace(F.regexp_extract("t", "style=\"([^\"]+)\"", 1), r"\s*;\s*$", "")
    return rows.select("file_path", line.alias("line"), F.regexp_extract("t", "<([a-zA-Z][\\w-]*)", 1).alias("selector"), F.str_to_map(F.lower(F.regexp_replace(body, r"\s*([:;])\s*", "$1")), F.lit(";"), F.lit(":")).alias("declarations"))


def components(markup: DataFrame) -> DataFrame:
    """(file_path, name, tags, class_list, structure_hash) of component files: element sequence, classes, and a hash of the sequence."""
    tags = F.regexp_extract_all("content", F.lit("<([a-zA-Z][\\w.-]*)"), F.lit(1))
    classes = F.flatten(F.transform(F.regexp_extract_all("content", F.lit("class(?:Name)?=\"([^\"]+)\""), F.lit(1)), lambda x: F.split(F.trim(x), r"\s+")))
    name = F.regexp_replace(F.substring_index("file_path", "/", -1), r"\.\w+$", "")
    return markup.where("content is not null").select("file_path", name.alias("name"), tags.alias("tags"), F.array_sort(F.array_distinct(classes)).alias("class_list"), F.md5(F.array_join(F.transform(tags, lambda t: F.lower(t)), ">")).alias("structure_hash"))


def structural_features(tags: str) -> Column:
    """Elements and neighbouring pairs of them, for hashing structures."""
    t = F.col(tags)
    pairs = F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat_ws(">", a, b))
    return F.concat(t, pairs)


def weighted_similarity(semantic: Column, structural: Column, style: Column, renormalise: bool = False) -> Column:
    """0.5 semantic + 0.3 structural + 0.2 style. A null part counts 0, or with `renormalise` its weight goes to the others."""
    parts = ((semantic, 0.5), (structural, 0.3), (style, 0.2))
    total = reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) * w for c, w in parts))
    if not renormalise:
        return total
    weight = reduce(lambda a, b: a + b, (F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts))
    return F.when(weight > 0, total / weight).otherwise(0.0)


def _finding(df: DataFrame, rule_id: str, severity: str, detail: Column, path: Column | None = None, line: Column | None = None) -> DataFrame:
    return df.select(F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), (F.col("file_path") if path is None else path).alias("file_path"), (F.col("line") if line is None else line).cast("int").alias("line"), detail.cast("string").alias("detail"))


def _near_sets(sets: DataFrame, least: float, tile: int = 512) -> DataFrame:
    """(file_path, line, similarity) of all pairs of sets (h, file_path, line, s) whose SimHashes s agree on the least share
    of bits, once a pair, at the set of lesser h.

    Bands that guarantee 12 differing bits have 5 bits, which nearly all pairs share, so all are compared: the sets are cut
    into tiles by their hash, and a task holds two of them.
    """
    import numpy as np
    import pandas as pd

    tiles = sets.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / tile)).cast("int").alias("m"))
    tiled = sets.crossJoin(F.broadcast(tiles)).withColumn("t", F.pmod(F.xxhash64("h"), F.col("m")).cast("int"))
    # a set of tile t takes part in the tasks (i, t) with i <= t and (t, j) with j > t
    sent = tiled.withColumn("p", F.explode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: F.struct(F.least(o, F.col("t")).alias("i"), F.greatest(o, F.col("t")).alias("j")))))

    def compare(pdf):
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        x, y = pdf[pdf["t"] == i].reset_index(drop=True), pdf[pdf["t"] == j].reset_index(drop=True)
        bits = lambda p: np.array([int(v, 16) for v in p["s"]], np.uint64)
        same = 1 - np.bitwise_count(bits(x)[:, None] ^ bits(y)[None, :]) / 64.0
        a, b = np.nonzero(same >= least)
        ha, hb = x["h"].to_numpy()[a], y["h"].to_numpy()[b]
        keep = ha < hb if i == j else np.ones(len(a), bool)
        a, b, first = a[keep], b[keep], (ha < hb)[keep]
        out = {c: np.where(first, x[c].to_numpy()[a], y[c].to_numpy()[b]) for c in ("file_path", "line")}
        return pd.DataFrame({**out, "similarity": same[a, b]})

    return sent.select("h", "file_path", "line", "s", "t", "p.i", "p.j").groupBy("i", "j").applyInPandas(compare, "file_path string, line int, similarity double")


def duplicate_rules(styles: DataFrame) -> DataFrame:
    """STYLE.DUPLICATE_SET and STYLE.NEAR_DUPLICATE_SET: equal declaration sets, and all pairs of distinct sets of the same
    selector-independent names whose SimHashes agree on at least 0.8 of the bits."""
    key = declaration_key("declarations")
    keyed = styles.where(F.size("declarations") >= 2).select("file_path", "line", "selector", key.alias("k"), F.sha2(key, 256).alias("h"), F.split(key, ";").alias("features"))
    groups = keyed.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("file_path", "line")).alias("first"))
    exact = _finding(groups.where("n >= 2"), "STYLE.DUPLICATE_SET", "WARN", F.concat_ws(" ", "n", F.lit("equal sets")), F.col("first.file_path"), F.col("first.line"))
    one = keyed.groupBy("h").agg(F.min_by(F.struct("file_path", "line", "features"), F.struct("file_path", "line")).alias("x")).select("h", "x.*").withColumn("s", H.simhash_bits("features"))
    near = _near_sets(one.select("h", "file_path", "line", "s"), 0.8)
    return exact.unionByName(_finding(near, "STYLE.NEAR_DUPLICATE_SET", "WARN", F.round("similarity", 4)))


def sequence_rules(comps: DataFrame) -> DataFrame:
    """UTILITY.DUPLICATE_SEQUENCE (the same three or more classes in three or more components) and COMPONENT.DUPLICATE_CLUSTER (equal structures in two or more files)."""
    seq = comps.where(F.size("class_list") >= 3).groupBy(F.array_join("class_list", " ").alias("detail")).agg(F.count("*").alias("n"), F.min("file_path").alias("file_path")).where("n >= 3")
    same = comps.where(F.size("tags") >= 3).groupBy("structure_hash").agg(F.countDistinct("file_path").alias("n"), F.min("file_path").alias("file_path")).where("n >= 2")
    return _finding(seq, "UTILITY.DUPLICATE_SEQUENCE", "INFO", F.col("detail"), line=F.lit(1)).unionByName(_finding(same, "COMPONENT.DUPLICATE_CLUSTER", "WARN", F.concat_ws(" ", "n", F.lit("files")), line=F.lit(1)))


def _values(styles: DataFrame, names: str) -> DataFrame:
    return styles.select("file_path", "line", "selector", F.explode("declarations").alias("name", "value")).where(F.col("name").rlike(names))


def token_rules(styles: DataFrame, colours: DataFrame, spacing: list[float], radii: list[float], sizes: list[float], tolerance: float = 1.0) -> DataFrame:
    """COLOR.NON_TOKEN, SPACING.OFF_SCALE, RADIUS.OFF_SCALE and TYPE.OFF_SCALE: values that no token has. Values that are no
    colours or lengths (variables, percentages, keywords) are on scale."""
    c = _values(styles, "color|background|border|fill|stroke").withColumn("colour", S.normal_colour(F.regexp_extract("value", r"(#[0-9a-fA-F]{3,8}|rgba?\([^)]*\))", 1)))
    known = colours.select("name", S.normal_colour("value").alias("value")).where("value is not null")
    off = nearest_colour(c.where("colour is not null"), "colour", known).where("match is null or match <> 'exact'")
    out = _finding(off, "COLOR.NON_TOKEN", "FAIL", F.concat_ws(" ", "value", F.concat(F.lit("use "), "token")))

    def scale(names: str, values: list[float], rule_id: str, severity: str) -> DataFrame:
        v = _values(styles, names).select("file_path", "line", "name", F.explode(F.split("value", r"\s+")).alias("value")).withColumn("px", S.pixels("value"))
        bad = nearest_number(v.where("px is not null and px <> 0"), "px", values, tolerance).where("match <> 'exact'")
        return _finding(bad, rule_id, severity, F.concat_ws(" ", "name", "value", F.concat(F.lit("use "), F.col("nearest"))))

    return (
        out.unionByName(scale("^(margin|padding|gap)", spacing, "SPACING.OFF_SCALE", "FAIL")).unionByName(scale("radius$", radii, "RADIUS.OFF_SCALE", "WARN")).unionByName(scale("^font-size$", sizes, "TYPE.OFF_SCALE", "WARN"))
    )


def smell_rules(styles: DataFrame, most: int = 30) -> DataFrame:
    """CSS.SPECIFICITY.ESCALATION (selectors above the limit) and IMPORTANT.NEW_USAGE."""
    steep = styles.where(S.specificity("selector") > most)
    loud = _values(styles, ".").where(F.col("value").contains("!important"))
    return _finding(steep, "CSS.SPECIFICITY.ESCALATION", "WARN", S.specificity("selector")).unionByName(_finding(loud, "IMPORTANT.NEW_USAGE", "WARN", F.col("name")))


def role_rules(styles: DataFrame) -> DataFrame:
    """ROLE.OUTLIER.BUTTON, INPUT and CARD (values other than a role's dominating one) and FOCUS.RING.INCONSISTENT."""
    role = F.when(F.lower("selector").rlike("btn|button"), "BUTTON").when(F.lower("selector").rlike("input|field|select"), "INPUT").when(F.lower("selector").rlike("card|panel"), "CARD")
    r = styles.withColumn("role", role).where("role is not null")
    values = r.select("file_path", "line", "role", F.explode("declarations").alias("prop", "value"))
    odd = mode_outliers(values, "role", "prop", "value")
    where = values.join(odd.select("role", "prop", "value", "mode"), ["role", "prop", "value"])
    detail = F.concat_ws(" ", "prop", "value", F.concat(F.lit("others "), "mode"))
    out = where.select(F.concat(F.lit("ROLE.OUTLIER."), "role").alias("rule_id"), F.lit("WARN").alias("severity"), "file_path", F.col("line").cast("int").alias("line"), detail.alias("detail"))
    focus = styles.where(F.col("selector").contains(":focus")).select(F.lit("focus").alias("g"), F.coalesce(F.try_element_at("declarations", F.lit("outline")), F.try_element_at("declarations", F.lit("box-shadow"))).alias("ring"), "file_path", "line")
    mixed = focus_consistency(focus, "g", "ring")
    first = focus.groupBy("g").agg(F.min(F.struct("file_path", "line")).alias("f"))
    return out.unionByName(_finding(mixed.join(first, "g"), "FOCUS.RING.INCONSISTENT", "WARN", F.concat_ws(" ", "n_styles", F.lit("styles")), F.col("f.file_path"), F.col("f.line")))


def audit(sheets: DataFrame, markup: DataFrame, colours: DataFrame, spacing: list[float], radii: list[float], sizes: list[float]) -> DataFrame:
    """All findings over style sheets and markup."""
    styles = rule_sets(sheets).unionByName(inline_styles(markup))
    return reduce(DataFrame.unionByName, (duplicate_rules(styles), sequence_rules(components(markup)), token_rules(styles, colours, spacing, radii, sizes), smell_rules(styles), role_rules(styles)))


def tap_targets(elements: DataFrame, least: float = 44.0) -> DataFrame:
    """(role, n, n_small, rate): elements with a box below the least width or height; a missing box counts as adequate."""
    small = (F.col("width") < least) | (F.col("height") < least)
    return elements.groupBy("role").agg(F.count("*").alias("n"), F.count(F.when(F.coalesce(small, F.lit(False)), 1)).alias("n_small")).withColumn("rate", F.round(1 - F.col("n_small") / F.col("n"), 6))


def quick_wins(tasks: DataFrame, k: int = 5) -> DataFrame:
    """The k tasks of highest impact among those of low effort and 0.7 impact, or medium effort and 0.8. Ties go by id."""
    good = ((F.col("effort") == "low") & (F.col("impact") >= 0.7)) | ((F.col("effort") == "medium") & (F.col("impact") >= 0.8))
    return tasks.where(good).orderBy(F.desc("impact"), "id").limit(k)


def merge_tasks(tasks: DataFrame) -> DataFrame:
    """(scope, tag, n, impact, ids): tasks of a scope with the same tag as one, with the highest impact; ids sorted."""
    return tasks.groupBy("scope", "tag").agg(F.count("*").alias("n"), F.max("impact").alias("impact"), F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids"))


def snapshot(findings: DataFrame, tier: int, at: str) -> DataFrame:
    """One metrics row of a run: findings by severity, distinct off-scale values, suppression rate is left to the baseline."""
    n = lambda c: F.count(F.when(c, 1))
    return findings.agg(n(F.col("severity") == "FAIL").alias("n_fail"), n(F.col("severity") == "WARN").alias("n_warn"), F.countDistinct(F.when(F.col("rule_id").rlike("OFF_SCALE|NON_TOKEN"), F.col("detail"))).alias("n_drift")).select(F.lit(at).cast("timestamp").alias("ts"), F.lit(tier).alias("tier"), "n_fail", "n_warn", "n_drift")
