"""What users add by themselves: parsers, rules, embedders, stores and token readers, and sources that Spark reads by name.

Registries are plain tables of this process. What they hold is sent to the executors with the plan that uses it, so nothing
has to be installed there.
"""

from __future__ import annotations

import glob
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .rules import Rule, scan
from .sources import structures

#: What a parser gives for each thing it finds.
PARSED = "kind string, name string, owner string, start_line int, end_line int"


class Registry:
    """Names with what was registered under them. A name is taken once, unless it is given up first."""

    def __init__(self, what: str):
        self.what, self._by_name = what, {}

    def add(self, name: str, value):
        if name in self._by_name:
            raise ValueError(f"there is a {self.what} {name!r} already")
        self._by_name[name] = value
        return value

    def remove(self, name: str) -> None:
        self._by_name.pop(name, None)

    def get(self, name: str):
        if name not in self._by_name:
            raise KeyError(f"no {self.what} {name!r}; there are {sorted(self._by_name)}")
        return self._by_name[name]

    def names(self) -> list[str]:
        return sorted(self._by_name)


parsers, embedders, stores, token_readers = Registry("parser"), Registry("embedder"), Registry("store"), Registry("token reader")
_rules: list[Rule] = []

parsers.add("js", lambda t: [r[:5] for r in structures._script_entities(t)])
parsers.add("ts", lambda t: [r[:5] for r in structures._script_entities(t)])
parsers.add("py", lambda t: [(c[0], c[1].rpartition(".")[2], c[1].rpartition(".")[0] or None, c[2], c[3]) for c in structures._python_chunks(t)])
parsers.add("json", lambda t: [("key", r[1], r[0].rpartition(".")[0], None, None) for r in structures._json_structure(t)])
parsers.add("yaml", lambda t: [(r[1], r[2], r[3].rpartition(".")[0] or None, r[4], r[4]) for r in structures._yaml_entities(t)])
parsers.add("yml", parsers.get("yaml"))


def parse(files: DataFrame) -> DataFrame:
    """(file_id, kind, name, owner, start_line, end_line, error) by the parser of each file's extension.

    A parser is a function from a text to rows. One that fails costs its file only: the file gives a row of kind `error`.
    Files without a parser and null texts give none.
    """
    by_ext = {name: parsers.get(name) for name in parsers.names()}
    arrow = pa.schema([("file_id", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("owner", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, ext, text in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    rows.extend((key, *r, None) for r in by_ext[ext](text))
                except Exception as e:  # a plug-in's own failure
                    rows.append((key, "error", None, None, None, None, f"{type(e).__name__}: {e}"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    ext = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1))
    known = files.withColumn("_ext", ext).where(F.col("_ext").isin(*by_ext) & F.col("content").isNotNull())
    return known.select("file_id", "_ext", "content").mapInArrow(run, f"file_id bigint, {PARSED}, error string")


def add_rule(rule: Rule) -> Rule:
    """Take a rule into the user's own ones; its id may be one of the catalogue, which it then adds to."""
    _rules.append(rule)
    return rule


def scan_with_plugins(files: DataFrame, **how) -> DataFrame:
    """rules.scan with the catalogue and the user's rules."""
    from .rules import RULES

    return scan(files, rules=(*RULES, *_rules), **how)


def embed(texts: DataFrame, embedder: str, key: str, text: str, batch: int = 256) -> DataFrame:
    """(key, embedding) by a registered embedder, a function from a list of texts to as many vectors.

    Equal texts are sent once per batch of rows; null texts have a null vector.
    """
    fn: Callable[[list[str]], Iterable[Iterable[float]]] = embedders.get(embedder)
    kind = texts.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(1).to_pylist()
            different = list(dict.fromkeys(v for v in values if v is not None))
            of: dict[str, list[float]] = {}
            for i in range(0, len(different), batch):
                some = different[i : i + batch]
                vectors = [[float(x) for x in v] for v in fn(some)]
                if len(vectors) != len(some):
                    raise ValueError(f"{embedder!r} gave {len(vectors)} vectors for {len(some)} texts")
                of.update(zip(some, vectors))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of.get(v) for v in values], pa.list_(pa.float64()))], names=[key, "embedding"])

    return texts.select(key, text).mapInArrow(run, f"{key} {kind.simpleString()}, embedding array<double>")


class Store(Protocol):
    """Where points are kept."""

    def read(self, collection: str) -> DataFrame: ...

    def upsert(self, collection: str, points: DataFrame, key: str) -> None: ...

    def delete(self, collection: str, keys: DataFrame, key: str) -> None: ...


class ParquetStore:
    """Collections as folders of Parquet versions; a version is complete before it is read, and an old one stays until it is replaced."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _versions(self, collection: str) -> list[int]:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{collection}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        done = [s.getPath() for s in fs.listStatus(at) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done)

    def read(self, collection: str) -> DataFrame:
        versions = self._versions(collection)
        if not versions:
            raise KeyError(f"no collection {collection!r}")
        return self.spark.read.parquet(f"{self.root}/{collection}/v{versions[-1]}")

    def _write(self, collection: str, points: DataFrame) -> None:
        versions = self._versions(collection)
        points.write.mode("overwrite").parquet(f"{self.root}/{collection}/v{(versions[-1] if versions else 0) + 1}")

    def upsert(self, collection: str, points: DataFrame, key: str) -> None:
        new = points.where(F.col(key).isNotNull())
        if self._versions(collection):
            old = self.read(collection)
            new = old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
        self._write(collection, new)

    def delete(self, collection: str, keys: DataFrame, key: str) -> None:
        self._write(collection, self.read(collection).join(keys.select(key).distinct(), key, "left_anti"))


stores.add("parquet", ParquetStore)


def flatten_tokens(text: str) -> list[tuple[str, str, str]]:
    """(name, value, category) of design tokens in JSON: nested groups as dotted names; an object with a value is a token.

    A token's type is its own, else that of the group around it, else told from its value.
    """
    out = []

    def walk(node, name: str, kind: str | None) -> None:
        if isinstance(node, dict):
            kind = node.get("$type") or node.get("type") if isinstance(node.get("$type") or node.get("type"), str) else kind
            value = node.get("$value", node.get("value"))
            if value is not None and not isinstance(value, (dict, list)):
                out.append((name, str(value), kind or _category(name, str(value))))
                return
            for k, v in node.items():
                if k[:1] != "$" and k != "type":
                    walk(v, f"{name}.{k}" if name else k, kind)
        elif isinstance(node, (str, int, float)) and not isinstance(node, bool) and name:
            out.append((name, str(node), kind or _category(name, str(node))))

    try:
        walk(json.loads(text), "", None)
    except (ValueError, RecursionError):
        return []
    return out


def _category(name: str, value: str) -> str:
    low = name.lower()
    if value.startswith("#") or value.lower().startswith(("rgb", "hsl")):
        return "color"
    for part, kind in (("radius", "radius"), ("shadow", "shadow"), ("font", "typography"), ("text", "typography"), ("space", "spacing"), ("spacing", "spacing"), ("gap", "spacing")):
        if part in low:
            return kind
    return "dimension" if re.fullmatch(r"-?[\d.]+(?:px|rem|em|%)?", value, re.I) else "other"


def tailwind_tokens(text: str) -> list[tuple[str, str, str]]:
    """(name, value, category) of the sections of a Tailwind configuration: the braces of a section are paired, nested groups get dotted names."""
    out = []
    for section, kind in (("colors", "color"), ("spacing", "spacing"), ("borderRadius", "radius"), ("fontSize", "typography"), ("boxShadow", "shadow")):
        for m in re.finditer(rf"\b{section}\s*:\s*\{{", text):
            depth, groups, at = 1, [], m.end()
            for t in re.finditer(r"(?:['\"]?(?P<key>[\w.-]+)['\"]?\s*:\s*)?(?:(?P<open>[{])|(?P<close>[}])|(?P<q>['\"])(?P<value>[^'\"]*)(?P=q))", text[at:]):
                if t["open"]:
                    depth += 1
                    groups.append(t["key"] or "")
                elif t["close"]:
                    depth -= 1
                    if depth == 0:
                        break
                    groups.pop()
                elif t["key"]:
                    out.append((".".join([section, *groups, t["key"]]), t["value"], kind))
    return out


token_readers.add("json", flatten_tokens)
token_readers.add("tailwind", tailwind_tokens)


def read_tokens(files: DataFrame, reader: str) -> DataFrame:
    """(file_id, name, value, category) by a registered token reader, a function from a text to such rows."""
    return structures._each(files, "name string, value string, category string", token_readers.get(reader))


# ---------------------------------------------------------------- sources that Spark reads by name


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Listed(DataSourceReader):
    """Files below a folder, newest first, in parts of so many; each part is read by one task."""

    def __init__(self, options: dict, pattern: str):
        self.root, self.pattern = options["path"], options.get("pattern", pattern)
        self.each, self.most = int(options.get("filesPerPartition", 64)), int(options.get("limit", 0))

    def partitions(self):
        found = [p for p in glob.glob(os.path.join(self.root, "**", self.pattern), recursive=True) if os.path.isfile(p)]
        found.sort(key=lambda p: (-os.path.getmtime(p), p))
        found = found[: self.most] if self.most else found
        # an empty folder is one empty part
        return [_Part(found[i : i + self.each]) for i in range(0, max(1, len(found)), self.each)]


class CodeFiles(DataSource):
    """`codeloom_files`: (file_path, size, modified_at, content) of text files; bytes that are no UTF-8 are replaced."""

    @classmethod
    def name(cls):
        return "codeloom_files"

    def schema(self):
        return "file_path string, size bigint, modified_at timestamp, content string"

    def reader(self, schema):
        class Reader(_Listed):
            def read(self, partition):
                import datetime

                for p in partition.paths:
                    with open(p, encoding="utf-8", errors="replace") as f:
                        text = f.read()
                    st = os.stat(p)
                    yield os.path.relpath(p, self.root), st.st_size, datetime.datetime.fromtimestamp(st.st_mtime, datetime.UTC), text

        return Reader(self.options, "*")


class ChatFiles(DataSource):
    """`codeloom_chats`: (file_path, line_no, role, text, at) of chats with one JSON object per line, newest files first; `limit`
    keeps so many files. Lines that do not parse are passed over; content in parts is joined by line ends."""

    @classmethod
    def name(cls):
        return "codeloom_chats"

    def schema(self):
        return "file_path string, line_no int, role string, text string, at string"

    def reader(self, schema):
        class Reader(_Listed):
            def read(self, partition):
                for p in partition.paths:
                    with open(p, encoding="utf-8", errors="replace") as f:
                        for n, line in enumerate(f, 1):
                            try:
                                row = json.loads(line)
                            except ValueError:
                                continue
                            if not isinstance(row, dict):
                                continue
                            message = row.get("message") if isinstance(row.get("message"), dict) else row
                            content = message.get("content")
                            if isinstance(content, list):
                                content = "\n".join(x["text"] for x in content if isinstance(x, dict) and isinstance(x.get("text"), str))
                            role = message.get("role") or row.get("type")
                            if isinstance(content, str) and content and isinstance(role, str):
                                yield os.path.relpath(p, self.root), n, role, content, row.get("timestamp") if isinstance(row.get("timestamp"), str) else None

        return Reader(self.options, "*.jsonl")


def register_sources(spark: SparkSession) -> None:
    """Make `spark.read.format("codeloom_files")` and `codeloom_chats` known. The folder must be one that all executors see."""
    for source in (CodeFiles, ChatFiles):
        spark.dataSource.register(source)
