"""Functions paired with their documentation (problem 6).

Method: a qualified symbol table is built across all files: every declaration with its repository, its module, the classes
around it (by the lines of the classes in its file, or the Go receiver), its name, its normalised signature and what
documents it. Documentation comes from the entities themselves (Python docstrings) and from the files (comment
blocks that end on the line above a declaration), joined on file and line. Each definition is then looked up in the table
of documented declarations: it has its own documentation, or takes that of a declaration of the same qualified name
whose signature agrees (an overload, an interface or a stub), and such rows are marked as inherited. One of the same
module comes first; one of another module counts only if all of them say the same. What is trivial is dropped last, once
all overloads are resolved.

Only names, signatures and comment blocks travel between the sides; the code is joined to the pairs that are left.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from .common import arrow_rows, code_entities, cut, entity_kind

_LETTERS = re.compile(r"[^\W\d_]+")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|[^\W\d_]+")
_PARAMETERS = re.compile(r"^[ \t*/#]*(?:(?:args|arguments|parameters|params|keyword args|keyword arguments)\s*:?\s*$|(?:args|arguments|parameters|params)\s*:|[@\\](?:param|parameter|arg|argument)\b|:(?:param|parameter|arg|argument)\b)", re.I | re.M)
_PYTHON = re.compile(r"\s*(?:async[ \t]+)?def[ \t]+\w+[ \t]*")
_STRING = re.compile(r"""[rRuU]?(?:\"\"\"((?:[^\\]|\\.)*?)\"\"\"|'''((?:[^\\]|\\.)*?)'''|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)')""", re.S)
_SKIP = re.compile(r"""\"\"\".*?\"\"\"|'''.*?'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|\#[^\n]*|[()\[\]{}:]""", re.S)
_BLANK = re.compile(r"(?:[ \t\r\n\f]|\\\r?\n|#[^\n]*)*")


def docstring(code: str) -> str | None:
    """The docstring of a Python function by its text: the string that is the first statement of its body."""
    m = _PYTHON.match(code)
    if m is None:
        return None
    depth = 0
    for t in _SKIP.finditer(code, m.end()):
        c = t.group()
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and depth == 0:
            s = _STRING.match(code, _BLANK.match(code, t.end()).end())
            parts = []
            while s is not None:
                parts.append(next(g for g in s.groups() if g is not None))
                s = _STRING.match(code, re.compile(r"[ \t]*").match(code, s.end()).end())
            return "".join(parts) if parts else None
    return None


def comment_blocks(text: str) -> list[tuple[int, str, str]]:
    """(line of the declaration, style, comment) for each comment that ends on the line above some line."""
    out = []
    lines = text.split("\n")
    i, n = 0, len(lines)
    while i < n:
        s = lines[i].strip()
        if s.startswith("/**") and not s.startswith("/**/"):
            j = i
            while j < n and "*/" not in lines[j][(lines[j].find("/**") + 3 if j == i else 0) :]:
                j += 1
            if j < n:
                if lines[j].rstrip().endswith("*/"):
                    body = "\n".join(re.sub(r"^[ \t]*\*?(?!/)[ \t]?", "", x) if k else x.strip()[3:] for k, x in enumerate(lines[i : j + 1]))
                    out.append((j + 2, "block", body.rstrip()[:-2] if body.rstrip().endswith("*/") else body))
                i = j + 1
                continue
            i += 1
        elif s.startswith("//"):
            j = i
            while j < n and lines[j].strip().startswith("//"):
                j += 1
            out.append((j + 1, "lines", "\n".join(re.sub(r"^[ \t]*//[ \t]?", "", x) for x in lines[i:j])))
            i = j
        else:
            i += 1
    return out


def description_words(doc: str | None, name: str | None) -> int:
    """Words of the documentation before its first list of parameters that are not words of the name."""
    if not doc:
        return 0
    m = _PARAMETERS.search(doc)
    own = {w.lower() for w in _NAME_PART.findall(name or "")}
    return sum(1 for w in _LETTERS.findall(doc[: m.start()] if m else doc) if w.lower() not in own)


def language(path: str | None, code: str | None) -> str:
    p = (path or "").lower()
    if _PYTHON.match(code or ""):
        return "py"
    return "go" if p.endswith(".go") or re.match(r"\s*func\b", code or "") else "js"


_RECEIVER = re.compile(r"\s*func\s*\(\s*(?:\w+\s+)?\*?\s*(?P<type>\w+)(?:\[[^\]]*\])?\s*\)")
_SKIP_OTHER = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|[()\[\]{},]""", re.S)
_SKIP_PYTHON = re.compile(_SKIP.pattern.replace("{}:]", "{},]"), re.S)


def receiver(code: str | None) -> str:
    """The type a Go method belongs to; empty for everything else."""
    m = _RECEIVER.match(code or "")
    return m["type"] if m else ""


def module(path: str | None) -> str | None:
    """The module of a file: the folder in Go, else the path without its extension, so that a stub has that of its source."""
    if path is None:
        return None
    p = path[2:] if path.startswith("./") else path
    return p.rpartition("/")[0] + "/" if p.endswith(".go") else re.sub(r"(?:\.d)?\.\w+$", "", p)


def signature(code: str | None) -> str:
    """The parameter names of a declaration, without types, defaults and blanks."""
    text = code or ""
    m = _RECEIVER.match(text)
    skip = _SKIP_PYTHON if _PYTHON.match(text) else _SKIP_OTHER
    start = text.find("(", m.end() if m else 0)
    if start < 0:
        return ""
    depth, parts, part, last = 0, [], [], start + 1
    for t in skip.finditer(text, start):
        c = t.group()
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c[0] == "#" or c.startswith(("//", "/*")):
            part.append(text[last : t.start()])
            last = t.end()
        if depth == 0 or c == "," and depth == 1:
            parts.append("".join(part) + text[last : t.start()])
            part, last = [], t.end()
            if depth == 0:
                break
    names = [re.match(r"\s*(?:\.\.\.|\*{0,2})\s*([\w$]*)", x)[1] or re.sub(r"\s+", "", x) for x in parts]
    return ",".join(x for x in names if x and x not in ("self", "cls", "*", "/"))


def enclosing(entities: DataFrame) -> DataFrame:
    """(entity_id, owner) of the functions and methods inside classes: the classes' names, from the outermost to the innermost."""
    last = F.col("start_line") + F.length(F.regexp_replace(F.rtrim("content"), r"[^\n]", ""))
    if "end_line" in entities.columns:
        last = F.coalesce("end_line", last)
    classes = entities.where(entity_kind("entity_type") == "class").select("file_id", "name", F.col("start_line").alias("first"), last.alias("last")).distinct()
    code = code_entities(entities).select("file_id", "entity_id", "start_line").distinct()
    inside = code.join(classes, "file_id").where("start_line > first and start_line <= last")
    return inside.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", F.negative("last").alias("last"), "name"))), lambda x: x["name"]), ".").alias("owner"))


def symbols(entities: DataFrame, files: DataFrame) -> DataFrame:
    """(entity_id, repo, module, owner, name, sig, doc): every function and method with its qualified name, its normalised
    signature and its own documentation, null where it has none. Each key once."""
    blocks = arrow_rows(files.where("content is not null and file_id is not null"), ["file_id", "content"], "file_id bigint, line int, style string, comment string", lambda k, t: [(k, *b) for b in comment_blocks(t)])
    blocks = blocks.where(F.length("comment") > 0).groupBy("file_id", "line", "style").agg(F.max("comment").alias("comment"))
    code = code_entities(entities).where("entity_id is not null")

    def own(k, f, r, n, p, line, c):
        lang = language(p, c)
        return [(k, f, r, n, line, {"go": "lines", "js": "block"}.get(lang), docstring(c or "") if lang == "py" else None, signature(c), module(p), receiver(c) if lang == "go" else "")]

    schema = "entity_id bigint, file_id bigint, repo string, name string, line int, style string, doc string, sig string, module string, receiver string"
    rows = arrow_rows(code, ["entity_id", "file_id", "repo", "name", "file_path", "start_line", "content"], schema, own).dropDuplicates(["entity_id"])
    rows = rows.join(blocks, ["file_id", "line", "style"], "left").join(enclosing(entities), "entity_id", "left")
    return rows.select("entity_id", "repo", "module", F.coalesce("owner", "receiver").alias("owner"), "name", "sig", F.coalesce("doc", "comment").alias("doc"))


def documented(entities: DataFrame, files: DataFrame, fewest: int = 4, code: bool = True) -> DataFrame:
    """(entity_id, repo, name, description, inherited[, code]) of functions and methods with non-trivial documentation.

    Null contents, names or lines have no documentation of their own beyond what they still show; repeated rows of a key
    count once. Where a line carries several blocks, the last one counts.
    """
    table = cut(symbols(entities, files))
    by = ["repo", "owner", "name", "sig"]
    named = table.where("doc is not null")
    # declarations of one qualified name are folded before they are joined, so a common name is one row of the table
    near = named.groupBy(*by, "module").agg(F.min_by("doc", "entity_id").alias("near"))
    far = named.groupBy(*by).agg(F.min("doc").alias("far"), F.max("doc").alias("other")).where("far = other").drop("other")
    resolved = table.join(near, [*by, "module"], "left").join(far, by, "left").withColumn("description", F.coalesce("doc", "near", "far")).where("description is not null")
    rows = resolved.select("entity_id", "repo", "name", "description", F.col("doc").isNull().alias("inherited"))
    keep = "entity_id bigint, repo string, name string, description string, inherited boolean"
    pairs = arrow_rows(rows, rows.columns, keep, lambda k, r, n, d, i: [(k, r, n, d, i)] if description_words(d, n) >= fewest else [])
    if not code:
        return pairs
    texts = code_entities(entities).select("entity_id", F.col("content").alias("code")).join(pairs.select("entity_id"), "entity_id", "left_semi").dropDuplicates(["entity_id"])
    return pairs.join(texts, "entity_id")
