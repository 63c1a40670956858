"""File, version-control, chat and token sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def discover(spark: SparkSession, folder: str, pattern: str = "*", most_bytes: int = 1_048_576, since: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of files below a folder, no larger than the limit, changed after `since`."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    r = r.option("modifiedAfter", since) if since else r
    return r.load(folder).where(F.col("length") <= most_bytes)


def parse_name_status(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path, status, old_path) of `git diff --name-status` lines: a rename is also a modification, a copy an addition."""
    p = F.split(column, "\t")
    code = F.substring(F.get(p, 0), 1, 1)
    last = F.when(F.size(p) >= 3, F.get(p, 2)).otherwise(F.get(p, 1))
    status = F.when(code.isin("A", "C"), "added").when(code == "D", "deleted").when(code == "R", "renamed").otherwise("modified")
    rows = lines.where(F.col(column).isNotNull() & (F.size(p) >= 2)).select(last.alias("path"), status.alias("status"), F.when(code == "R", F.get(p, 1)).alias("old_path"))
    return rows.unionByName(rows.where("status = 'renamed'").select("path", F.lit("modified").alias("status"), F.lit(None).cast("string").alias("old_path")))


def parse_hunks(lines: DataFrame, path: str = "path", column: str = "value") -> DataFrame:
    """(path, start, end) of the new side of hunk headers; a missing count is 1, a count of 0 changes no line."""
    rx = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    start = F.regexp_extract(column, rx, 1).cast("int")
    n = F.when(F.regexp_extract(column, rx, 2) == "", 1).otherwise(F.regexp_extract(column, rx, 2).try_cast("int"))
    rows = lines.where(F.col(column).rlike(rx)).select(F.col(path).alias("path"), start.alias("start"), n.alias("n"))
    return rows.where("n > 0").select("path", "start", (F.col("start") + F.col("n") - 1).alias("end"))


def parse_chats(lines: DataFrame, column: str = "value") -> DataFrame:
    """(role, text, ts) of chat JSON lines in three layouts; content lists keep their text parts; broken lines are skipped."""
    g = lambda p: F.get_json_object(column, p)
    parts = F.from_json(F.coalesce(g("$.message.content"), g("$.content")), "array<struct<type:string,text:string>>")
    listed = F.array_join(F.transform(F.filter(parts, lambda x: x["type"] == "text"), lambda x: x["text"]), "\n")
    plain = F.coalesce(g("$.message.content"), g("$.content"), g("$.text"))
    text = F.when(F.ltrim(F.coalesce(g("$.message.content"), g("$.content"), F.lit(""))).startswith("["), listed).otherwise(plain)
    role = F.coalesce(g("$.message.role"), g("$.role"), g("$.type"))
    stamp = g("$.timestamp")
    ts = F.coalesce(F.try_to_timestamp(stamp), F.when(stamp.rlike(r"^\d+(\.\d+)?$"), F.timestamp_seconds(stamp.try_cast("double"))))
    return lines.select(role.alias("role"), text.alias("text"), ts.alias("ts")).where("role is not null and text is not null")


def css_tokens(sheets: DataFrame, column: str = "content") -> DataFrame:
    """(name, value, category) of custom properties: colours, sizes of fonts, spacing, others."""
    pairs = F.regexp_extract_all(column, F.lit(r"--([\w-]+\s*:[^;}]+)"), F.lit(1))
    rows = sheets.select(F.explode(pairs).alias("p")).select(F.trim(F.substring_index("p", ":", 1)).alias("name"), F.trim(F.substring(F.col("p"), F.instr("p", ":") + 1, F.length("p"))).alias("value"))
    category = F.when(F.col("value").rlike(r"(?i)^(#[0-9a-f]{3,8}|rgba?\(|hsla?\()"), "colour").when(F.col("name").rlike("font|text"), "font_size").when(F.col("name").rlike("radius|rounded"), "radius").when(F.col("value").rlike(r"^-?[0-9.]+(px|rem|em)$"), "spacing").otherwise("other")
    return rows.withColumn("category", category)


def merge_tokens(*sets: DataFrame) -> DataFrame:
    """(name, value, category): tokens of several sets, later sets first."""
    out = None
    for i, t in enumerate(sets):
        x = t.select("name", "value", "category").withColumn("_i", F.lit(i))
        out = x if out is None else out.unionByName(x)
    return out.groupBy("name").agg(F.max_by(F.struct("value", "category"), "_i").alias("t")).select("name", "t.value", "t.category")


def ignored(paths: DataFrame, patterns: list[str], path: str = "path") -> DataFrame:
    """paths with is_ignored and reason: the last matching pattern decides, a pattern with `!` takes a path back in.

    A pattern without a slash matches any component of the path; a trailing slash a folder; `**` any number of folders.
    """
    state, why = F.lit(False), F.lit(None).cast("string")
    for p in patterns:
        body = p.strip()
        if not body or body.startswith("#"):
            continue
        negated = body.startswith("!")
        body = body[1:] if negated else body
        hit = F.col(path).rlike(glob_regex(body))
        state = F.when(hit, F.lit(not negated)).otherwise(state)
        why = F.when(hit, F.lit(None if negated else body)).otherwise(why)
    return paths.withColumn("is_ignored", state).withColumn("reason", why)


def glob_regex(pattern: str) -> str:
    """A regular expression for an ignore pattern."""
    import re

    anchored = "/" in pattern.rstrip("/")
    folder = pattern.endswith("/")
    out = ""
    for t in re.findall(r"\*\*/|/\*\*|\*|\?|\[[^\]]*\]|[^*?\[]+", pattern.strip("/")):
        out += {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(t) or (t if t.startswith("[") else re.escape(t))
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:$|/)")
