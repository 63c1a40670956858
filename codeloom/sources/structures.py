"""Typed entities, relations and chunks of scripts, JSON, YAML and Python files held in a table (file_id, content).

One row per thing found, in one map over the texts; null texts give no row, and only what is found leaves the map.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _each(files: DataFrame, schema: str, fn: Callable[[str], Iterable[tuple]]) -> DataFrame:
    """(file_id, what fn gives for the content) in Arrow batches."""
    kinds = [x.split() for x in schema.split(", ")]
    arrow = pa.schema([("file_id", pa.int64()), *((n, _ARROW[t]) for n, t in kinds)])

    def run(batches):
        for b in batches:
            rows = [(k, *r) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t is not None for r in fn(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return files.where(F.col("content").isNotNull()).select("file_id", "content").mapInArrow(run, f"file_id bigint, {schema}")


# ---------------------------------------------------------------- scripts

_QUIET = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)


def _masked(text: str) -> str:
    """The text with comments and the contents of strings blanked, every character keeping its place."""

    def blank(m: re.Match) -> str:
        t = m.group()
        inner = t if t[0] == "/" else t[1:-1]
        hidden = re.sub(r"[^\n]", " ", inner)
        return hidden if t[0] == "/" else t[0] + hidden + t[-1]

    return _QUIET.sub(blank, text)


_HEAD = r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?"
_SCRIPT = re.compile(
    rf"""^[ \t]*(?P<export>{_HEAD})(?:
        (?P<async>async\s+)?function\s*(?P<star>\*)?\s*(?P<function>[\w$]+)
      | (?:abstract\s+)?class\s+(?P<class>[\w$]+)
      | interface\s+(?P<interface>[\w$]+)
      | type\s+(?P<type>[\w$]+)\s*(?:<[^=]*>)?\s*=
      | (?:const\s+)?enum\s+(?P<enum>[\w$]+)
      | (?:const|let|var)\s+(?P<target>\{{[^}}]*\}}|\[[^\]]*\]|[\w$]+)\s*(?::[^=\n]+)?(?:=(?!=)\s*(?P<value>(?:async\s+)?(?:function\b|\([^()]*\)\s*(?::[^=\n]+)?=>|[\w$]+\s*=>)|(?:new\s+)?[\w$.]+)?)?
    )""",
    re.X | re.M,
)
_METHOD = re.compile(r"^[ \t]+(?:(?:public|private|protected|static|readonly|abstract|override|async|get|set)\s+)*\*?(?P<method>#?[\w$]+)\s*(?:<[^(]*>)?\((?:[^;{}()]|\{[^{}]*\}|\([^()]*\))*\)\s*(?::[^;{=]+)?\{", re.M)
_NO_METHOD = {"if", "for", "while", "switch", "catch", "function", "return", "with", "await", "typeof", "do", "else"}


def _bound(target: str) -> list[str]:
    """The names that a pattern binds: of `{a, b: c, ...d}` a, c and d; nested patterns included."""
    if target[0] not in "{[":
        return [target]
    out = []
    for part in re.split(r"[,{}\[\]]", target):
        part = re.sub(r"=.*$", "", part, flags=re.S).strip().lstrip(".")
        name = part.rsplit(":", 1)[-1].strip()
        if re.fullmatch(r"[\w$]+", name):
            out.append(name)
    return out


def _closing(text: str, at: int) -> int:
    """The offset of the bracket that closes the first curly one from an offset on; the end of the text if none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.start()
    return len(text)


def _script_entities(text: str) -> list[tuple]:
    code = _masked(text)
    out = []
    line = lambda at: code.count("\n", 0, at) + 1
    classes = []
    for m in _SCRIPT.finditer(code):
        at = m.start("export") if m["export"] else m.start() + len(m.group()) - len(m.group().lstrip())
        exported = m["export"].startswith("export")
        for kind in ("function", "class", "interface", "type", "enum"):
            if m[kind]:
                ends = kind != "type"
                brace = code.find("{", m.end()) if ends else -1
                stop = _closing(code, brace) if brace >= 0 else m.end()
                if kind == "class":
                    classes.append((m.end(), stop, m[kind]))
                out.append((kind, m[kind], None, line(at), line(min(stop, max(len(code) - 1, 0))), exported))
        if m["target"]:
            value = m["value"] or ""
            function = value.endswith("=>") or "function" in value
            for name in _bound(m["target"]):
                out.append(("function" if function else "variable", name, None, line(at), line(m.end()), exported))
    for begin, stop, owner in classes:
        for m in _METHOD.finditer(code, begin, stop):
            # of this class, and not of a function or class within it
            if m["method"] not in _NO_METHOD and code.count("{", begin, m.start()) - code.count("}", begin, m.start()) == 1:
                out.append(("method", m["method"], owner, line(m.start("method")), line(_closing(code, m.end() - 1)), False))
    return out


def script_entities(files: DataFrame) -> DataFrame:
    """(file_id, kind, name, owner, start_line, end_line, exported) of JavaScript and TypeScript files: functions, classes,
    methods with their class, interfaces, types, enumerations, and variables, those bound by patterns among them."""
    return _each(files, "kind string, name string, owner string, start_line int, end_line int, exported boolean", _script_entities)


_RELATIONS = (
    ("imports", re.compile(r"^[ \t]*(?:import|export)\b[^;'\"]*?from[ \t]*(?P<q>['\"])(?P<t>[^'\"\n]+)(?P=q)", re.M)), ("imports", re.compile(r"^[ \t]*import[ \t]*(?P<q>['\"])(?P<t>[^'\"\n]+)(?P=q)", re.M)),
    ("requires", re.compile(r"\brequire\(\s*(?P<q>['\"])(?P<t>[^'\"\n]+)(?P=q)\s*\)")), ("imports_dynamic", re.compile(r"\bimport\(\s*(?P<q>['\"])(?P<t>[^'\"\n]+)(?P=q)\s*\)")),
)
_EXTENDS = re.compile(r"\b(?:class|interface)\s+(?P<s>[\w$]+)(?:<[^{]*?>)?\s+extends\s+(?P<t>[\w$.]+)")
_IMPLEMENTS = re.compile(r"\bclass\s+(?P<s>[\w$]+)[^{;]*?\bimplements\s+(?P<t>[^{]+)\{")
_THROWS = re.compile(r"\bthrow\s+new\s+(?P<t>[\w$.]+)")
_LOADS = re.compile(r"(?:fetch|readFileSync|readFile|import|require)\(\s*['\"](?P<t>[^'\"\n]+\.json)['\"]")


def _script_relations(text: str) -> list[tuple]:
    code = _masked(text)
    line = lambda at: code.count("\n", 0, at) + 1
    out = set()
    for kind, rx in _RELATIONS:
        # the module's name stands in a string, so it is read from the text where the code has one
        out.update((kind, None, m["t"], line(m.start("t"))) for m in rx.finditer(text) if code[m.start("q")] == m["q"])
    out.update(("loads", None, m["t"], line(m.start())) for m in _LOADS.finditer(text) if code[m.start()] == text[m.start()])
    out.update(("extends", m["s"], m["t"], line(m.start())) for m in _EXTENDS.finditer(code))
    out.update(("implements", m["s"], re.sub(r"<.*", "", t).strip(), line(m.start())) for m in _IMPLEMENTS.finditer(code) for t in re.sub(r"<[^<>]*>", "", m["t"]).split(","))
    out.update(("throws", None, m["t"], line(m.start())) for m in _THROWS.finditer(code))
    return sorted(out, key=str)


def script_relations(files: DataFrame) -> DataFrame:
    """(file_id, kind, source, target, line_no) of scripts: imports, requires, extends, implements, throws, and JSON files loaded."""
    return _each(files, "kind string, source string, target string, line_no int", _script_relations)


# ---------------------------------------------------------------- JSON and YAML


def _json_structure(text: str) -> list[tuple]:
    try:
        root = json.loads(text, parse_constant=lambda _: 1 / 0)
    except (ValueError, ZeroDivisionError, RecursionError):
        return []
    out, todo = [], [(root, "$", 0)]
    while todo:
        node, path, depth = todo.pop()
        if isinstance(node, dict):
            for k, v in node.items():
                here = f"{path}.{k}" if re.fullmatch(r"[A-Za-z_]\w*", k) else f'{path}."{k}"'
                out.append((here, k, "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "null" if v is None else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number", depth + 1))
                todo.append((v, here, depth + 1))
        elif isinstance(node, list):
            todo.extend((v, f"{path}[{i}]", depth + 1) for i, v in enumerate(node))
    return out


def json_structure(files: DataFrame) -> DataFrame:
    """(file_id, path, name, kind, depth): every member of every object of a JSON text, at any depth; texts that do not parse give none."""
    return _each(files, "path string, name string, kind string, depth int", _json_structure)


_TITLE, _BODY = ("title", "name", "subject", "heading", "id"), ("content", "body", "text", "description", "message")


def _json_items(text: str) -> list[tuple]:
    try:
        root = json.loads(text)
    except (ValueError, RecursionError):
        return []
    lists = [("$", root)] if isinstance(root, list) else [(f"$.{k}", v) for k, v in root.items() if isinstance(v, list)] if isinstance(root, dict) else []
    out = []
    for path, values in lists:
        for i, v in enumerate(values):
            if isinstance(v, dict):
                first = lambda names, item=v: next((str(item[n]) for n in names if isinstance(item.get(n), (str, int)) and not isinstance(item.get(n), bool)), None)
                out.append((path, i, first(_TITLE), first(_BODY), json.dumps(v, sort_keys=True, ensure_ascii=False)))
    return out


def json_items(files: DataFrame) -> DataFrame:
    """(file_id, path, i, title, body, content): each object in an outer array of a JSON text, with its place, the first field
    that names it and the first that holds its text."""
    return _each(files, "path string, i int, title string, body string, content string", _json_items)


def json_lines(spark, path: str, schema: str) -> DataFrame:
    """Items of a file or folder with one JSON object per line: such files are split among tasks whatever their size. Broken lines are null rows."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def yaml_kind(text: str) -> str:
    """workflow, compose, kubernetes or generic, by the outermost keys."""
    keys = set(re.findall(r"^([\w.-]+|\"[^\"]+\"):", text, re.M))
    if "jobs" in keys and ("on" in keys or '"on"' in keys):
        return "workflow"
    if "services" in keys and keys & {"version", "networks", "volumes", "services"} and re.search(r"^\s+(?:image|build):", text, re.M):
        return "compose"
    return "kubernetes" if {"apiVersion", "kind"} <= keys else "generic"


_YAML_KEY = re.compile(r"^(?P<indent> *)(?P<dash>(?:- +)*)(?P<key>[^\s#:\"'{}\[\],&*!|>%@`-][^#:]*?|\"[^\"]*\"|'[^']*') *:(?= |$)(?P<rest>.*)$")


def _yaml_entities(text: str) -> list[tuple]:
    kind, out, stack, block = yaml_kind(text), [], [], None
    for n, line in enumerate(text.replace("\r\n", "\n").split("\n"), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent = len(line) - len(line.lstrip(" "))
        if block is not None and indent > block:  # inside a block scalar
            continue
        block = None
        if re.match(r"(?:---|\.\.\.)(?:\s|$)", line):
            stack = []
            continue
        m = _YAML_KEY.match(line)
        if m is None:
            continue
        column = indent + len(m["dash"])
        stack = [x for x in stack if x[0] < column]
        key = m["key"].strip().strip("\"'")
        path = ".".join([*(x[1] for x in stack), key])
        parent = stack[-1][1] if stack else None
        what = {("workflow", "jobs"): "job", ("compose", "services"): "service"}.get((kind, parent), "key") if len(stack) == 1 else "key"
        rest = m["rest"].strip()
        if kind == "kubernetes" and not stack and key == "kind":
            what, key = "resource", rest or key
        elif kind == "workflow" and key in ("uses", "run") and "jobs" in [x[1] for x in stack]:
            what = "step"
        out.append((kind, what, key, path, n, column))
        stack.append((column, m["key"].strip().strip("\"'")))
        if re.match(r"[|>][+-]?\d?\s*(?:#.*)?$", rest):
            block = indent
    return out


def yaml_entities(files: DataFrame) -> DataFrame:
    """(file_id, file_kind, kind, name, path, line_no, depth) of YAML texts: mapping keys with their path, jobs and steps of
    workflows, services of compositions, resources of Kubernetes; block scalars are passed over. depth is the column."""
    return _each(files, "file_kind string, kind string, name string, path string, line_no int, depth int", _yaml_entities)


# ---------------------------------------------------------------- Python chunks

_COMMON = frozenset(dir(__builtins__) if not isinstance(__builtins__, dict) else __builtins__)
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.BoolOp, ast.comprehension)


def _called(node: ast.AST) -> str | None:
    while isinstance(node, ast.Attribute):
        return node.attr
    return node.id if isinstance(node, ast.Name) else None


def _python_chunks(text: str) -> list[tuple]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines, out = text.splitlines(), []
    todo: list[tuple[ast.AST, str]] = [(n, "") for n in tree.body]
    while todo:
        node, owner = todo.pop()
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        name = f"{owner}.{node.name}" if owner else node.name
        todo.extend((n, name) for n in node.body)
        inside = list(ast.walk(node))
        calls = sorted({c for n in inside if isinstance(n, ast.Call) and (c := _called(n.func)) and c not in _COMMON})
        raised = sorted({c for n in inside if isinstance(n, ast.Raise) and n.exc is not None and (c := _called(n.exc.func if isinstance(n.exc, ast.Call) else n.exc))})
        caught = sorted({c for n in inside if isinstance(n, ast.ExceptHandler) and n.type is not None for t in (n.type.elts if isinstance(n.type, ast.Tuple) else [n.type]) if (c := _called(t))})
        decorators = sorted(ast.unparse(d) for d in node.decorator_list)
        facts = [f"Calls: {', '.join(calls)}"] if calls else []
        facts += [f"Raises: {', '.join(raised)}"] if raised else []
        facts += [f"Handles: {', '.join(caught)}"] if caught else []
        facts += [f"Decorators: {', '.join(decorators)}"] if decorators else []
        if isinstance(node, ast.ClassDef):
            kind = "class"
            methods = [n.name for n in node.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
            bases = [ast.unparse(b) for b in node.bases]
            facts += [f"Inherits: {', '.join(bases)}"] if bases else []
            facts += [f"Methods: {', '.join(methods)}"] if methods else []
        else:
            kind = "method" if owner else "function"
            a = node.args
            names = [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs)] + [x.arg for x in (a.vararg, a.kwarg) if x]
            facts += [f"Parameters: {', '.join(names)}"] if names else []
            facts += ["Asynchronous"] if isinstance(node, ast.AsyncFunctionDef) else []
            facts += ["Generator"] if any(isinstance(n, (ast.Yield, ast.YieldFrom)) for n in inside) else ["Returns a value"] if any(isinstance(n, ast.Return) and n.value is not None for n in inside) else []
        doc = ast.get_docstring(node)
        facts = ([f"Purpose: {doc.strip().splitlines()[0]}"] if doc and doc.strip() else []) + facts
        start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        complexity = 1 + sum(isinstance(n, _BRANCHES) for n in inside)
        out.append((kind, name, start, node.end_lineno, "\n".join(lines[start - 1 : node.end_lineno]), calls, raised, caught, complexity, facts))
    return out


def implementation_chunks(files: DataFrame) -> DataFrame:
    """(file_id, kind, name, start_line, end_line, content, calls, raises, handles, complexity, observations) of Python files.

    The content is the whole source of the function, method or class, decorators included; names are qualified by their
    classes; calls leave built-ins out. Files that do not parse give no row.
    """
    return _each(files, "kind string, name string, start_line int, end_line int, content string, calls array<string>, raises array<string>, handles array<string>, complexity int, observations array<string>", _python_chunks)


def internal_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (file_id, repo, module) with is_internal: relative, or a module or package of the repository itself.

    Modules are the repository's Python paths and all folders above them, joined on repository and path.
    """
    path = F.regexp_replace(F.regexp_replace("file_path", r"^\./", ""), r"(?:/__init__)?\.py$", "")
    parts = F.split(path, "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    known = files.where(F.col("file_path").endswith(".py")).select("repo", F.explode(every).alias("module")).distinct().withColumn("_known", F.lit(True))
    return imports.join(known, ["repo", "module"], "left").withColumn("is_internal", F.col("module").startswith(".") | F.coalesce("_known", F.lit(False))).drop("_known")
