"""Parsers of file contents held in a table (file_id, file_path, content): one row per thing found."""

from __future__ import annotations

import ast
import warnings

from pyspark.sql import DataFrame, functions as F


def _lines(files: DataFrame) -> DataFrame:
    return files.where("content is not null").select("file_id", F.posexplode(F.split("content", "\n")).alias("p", "line"))


def ini_keys(files: DataFrame) -> DataFrame:
    """(file_id, line_no, kind, name): sections and keys. Comments and blank lines are passed over."""
    kind = F.when(F.col("line").rlike(r"^\[[^\]]+\]"), "section").when(F.col("line").rlike(r"^[^#;\[=\s][^=]*="), "key").otherwise("other")
    name = F.when(F.col("kind") == "section", F.regexp_extract("line", r"^\[([^\]]+)\]", 1)).otherwise(F.trim(F.regexp_extract("line", "^([^=]*)=", 1)))
    return _lines(files).withColumn("kind", kind).select("file_id", (F.col("p") + 1).alias("line_no"), "kind", name.alias("name"))


def css_definitions(files: DataFrame) -> DataFrame:
    """(file_id, kind, name): classes, ids, variables and imports of style sheets."""
    found = lambda kind, rx: F.transform(F.regexp_extract_all("content", F.lit(rx), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    every = F.concat(found("class", r"\.(-?[_a-zA-Z][\w-]*)(?=[^{};]*\{)"), found("id", r"#([_a-zA-Z][\w-]*)(?=[^{};]*\{)"), found("variable", r"(--[\w-]+)\s*:"), found("import", "@import\\s+(?:url\\()?[\"']?([^\"')\\s;]+)"))
    return files.where("content is not null").select("file_id", F.explode(F.array_distinct(every)).alias("x")).select("file_id", "x.kind", "x.name")


def html_parts(files: DataFrame) -> DataFrame:
    """(file_id, kind, name): ids, links, classes and dash-named components of markup."""
    found = lambda kind, rx: F.transform(F.regexp_extract_all("content", F.lit(rx), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    classes = F.transform(F.flatten(F.transform(F.regexp_extract_all("content", F.lit(r"class=\"([^\"]+)\""), F.lit(1)), lambda x: F.split(F.trim(x), r"\s+"))), lambda x: F.struct(F.lit("class").alias("kind"), x.alias("name")))
    every = F.concat(found("id", r"\bid=\"([^\"]+)\""), found("link", r"(?:href|src)=\"([^\"]+)\""), found("component", r"<([a-z][a-z0-9]*-[a-z0-9-]+)"), classes)
    return files.where("content is not null").select("file_id", F.explode(F.array_distinct(every)).alias("x")).select("file_id", "x.kind", "x.name")


def json_keys(files: DataFrame) -> DataFrame:
    """(file_id, key): the outermost keys of JSON objects; texts that are no objects give none."""
    return files.select("file_id", F.explode(F.json_object_keys("content")).alias("key"))


def json_map(files: DataFrame, field: str) -> DataFrame:
    """(file_id, key): the keys of one field that holds an object."""
    return files.select("file_id", F.explode(F.json_object_keys(F.get_json_object("content", f"$.{field}"))).alias("key"))


def csv_columns(files: DataFrame) -> DataFrame:
    """(file_id, n_columns, n_rows) of comma-separated texts with a header."""
    lines = F.filter(F.split("content", "\r?\n"), lambda x: F.length(x) > 0)
    return files.where("content is not null").select("file_id", F.size(F.split(F.get(lines, 0), ",")).alias("n_columns"), F.greatest(F.size(lines) - 1, F.lit(0)).alias("n_rows"))


_SYMBOL = "file_id bigint, kind string, name string, parent string, start_line int, end_line int, n_args int, documented boolean"


def python_symbols(files: DataFrame) -> DataFrame:
    """(file_id, kind, name, parent, start_line, end_line, n_args, documented): classes, functions, imports and base classes.

    Files that do not parse give no row: the fallback is fallback_symbols.
    """

    def rows(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for key, text in zip(pdf["file_id"], pdf["content"]):
                if text is None:
                    continue
                try:
                    with warnings.catch_warnings():
                        warnings.simplefilter("ignore")
                        tree = ast.parse(text)
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                todo = [(n, "") for n in tree.body]
                while todo:
                    n, parent = todo.pop()
                    if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        out.append((key, "method" if parent else "function", n.name, parent, n.lineno, n.end_lineno, len(n.args.args) + len(n.args.kwonlyargs), ast.get_docstring(n) is not None))
                    elif isinstance(n, ast.ClassDef):
                        out.append((key, "class", n.name, parent, n.lineno, n.end_lineno, 0, ast.get_docstring(n) is not None))
                        out.extend((key, "inherits", ast.unparse(b), n.name, n.lineno, n.lineno, 0, False) for b in n.bases)
                        todo.extend((m, n.name) for m in n.body)
                    elif isinstance(n, ast.Import):
                        out.extend((key, "import", a.name, "", n.lineno, n.lineno, 0, False) for a in n.names)
                    elif isinstance(n, ast.ImportFrom):
                        out.append((key, "import", "." * n.level + (n.module or ""), "", n.lineno, n.lineno, 0, False))
            yield pd.DataFrame(out, columns=["file_id", "kind", "name", "parent", "start_line", "end_line", "n_args", "documented"])

    return files.select("file_id", "content").mapInPandas(rows, _SYMBOL)


def fallback_symbols(files: DataFrame) -> DataFrame:
    """(file_id, kind, name) by patterns, for files that a parser cannot read."""
    found = lambda kind, rx: F.transform(F.regexp_extract_all("content", F.lit(rx), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    every = F.concat(found("function", r"(?m)^\s*(?:export\s+)?(?:async\s+)?(?:def|func|function)\s+(\w+)"), found("class", r"(?m)^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"))
    return files.where("content is not null").select("file_id", F.explode(every).alias("x")).select("file_id", "x.kind", "x.name")
