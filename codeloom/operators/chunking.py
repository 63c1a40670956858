"""Cutting texts into lines, blocks, sections and overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import _c


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): lines from 1, without line ends. Null texts give no row; an empty text one empty line."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_no"), "line")


def line_blocks(text: str | Column, size: int, width: int = 500) -> Column:
    """Blocks of so many lines; lines beyond the width end in '...'. Evaluated inside the row, so nothing is shuffled."""
    lines = F.transform(F.split(F.regexp_replace(_c(text), "\r\n?", "\n"), "\n"), lambda x: F.when(F.length(x) > width, F.concat(F.substring(x, 1, width), F.lit("..."))).otherwise(x))
    n = F.ceil(F.size(lines) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(lines, i * size + 1, size), "\n"))


def with_overlap(pieces: str | Column, overlap: int) -> Column:
    """Pieces, each after the first behind the last characters of the one before."""
    p = _c(pieces)
    return F.transform(p, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.right(F.get(p, i - 1), F.lit(overlap)), x)))


def headings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, level, title) of headings outside code fences. Fences are counted by a fold within the row, so no line is shuffled."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    # only headings and fences are kept, with their places
    marks = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"), x.startswith("```").alias("fence"))), lambda m: m["fence"] | m["line"].rlike(r"^#{1,6} +\S"))
    empty = F.struct(F.lit(False).alias("inside"), F.array().cast("array<struct<line_no:int,line:string>>").alias("found"))

    def step(acc, m):
        more = F.when(acc["inside"], acc["found"]).otherwise(F.concat(acc["found"], F.array(F.struct(m["line_no"].alias("line_no"), m["line"].alias("line")))))
        return F.when(m["fence"], F.struct((~acc["inside"]).alias("inside"), acc["found"].alias("found"))).otherwise(F.struct(acc["inside"].alias("inside"), more.alias("found")))

    h = df.where(F.col(text).isNotNull()).select(key, F.explode(F.aggregate(marks, empty, step, lambda acc: acc["found"])).alias("m")).select(key, "m.*")
    return h.select(key, "line_no", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("line", "^#+ +", "")).alias("title"))


def section_paths(h: DataFrame, key: str) -> DataFrame:
    """Headings with the titles above them, from the outermost on."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = h
    for level in range(1, 7):
        at = F.last(F.when(F.col("level") == level, F.struct("line_no", "title")), ignorenulls=True).over(w)
        above = F.max(F.when(F.col("level") < level, F.col("line_no"))).over(w)
        out = out.withColumn(f"_t{level}", F.when(F.coalesce(at["line_no"] > above, at.isNotNull()), at["title"]))
    parts = F.array_compact(F.array(*(F.when(F.col("level") >= i, F.col(f"_t{i}")) for i in range(1, 7))))
    return out.select(key, "line_no", "level", F.array_join(parts, " > ").alias("path"))


def pack_sections(sections: str | Column, budget: int, most: int) -> Column:
    """Neighbouring sections joined while their estimated tokens fit the budget and their number the maximum: a fold within the row."""
    size = lambda x: F.floor(F.length(x) / 4)
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("k"))

    def step(acc, x):
        fits = (acc["k"] > 0) & (size(acc["open"]) + size(x) <= budget) & (acc["k"] < most)
        joined = F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit("\n"), x).alias("open"), (acc["k"] + 1).alias("k"))
        fresh = F.struct(F.when(acc["k"] > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), x.alias("open"), F.lit(1).alias("k"))
        return F.when(fits, joined).otherwise(fresh)

    return F.aggregate(_c(sections), empty, step, lambda acc: F.when(acc["k"] > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))
