"""Generated, minified or vendored source files (problem 4).

Method: (1) rules on path, header and token composition settle what shows by itself: generator marks, minified code, data
blobs, lock files, and third-party packages by folder, header or banner. (2) An inverted index from the lines of those
third-party files, across all repositories, by line hash to package gives for every remaining file the packages that
share one of its rarest lines, and for these the exact share of its lines that the package contains; a share of at
least `contained` makes it a vendored copy, edited or not.

A file of n lines of which a package contains at least c n shares with it at least one of its floor((1 - c) n) + 1 rarest lines, so
looking up those alone loses no package, and common lines (licence texts, braces) are looked up only by files that
have hardly any others. The share itself counts all lines.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, functions as F

from ..session import spread
from .common import arrow_rows, cut

CONTAINED, LINE_CHARS, FEWEST_LINES = 0.7, 20, 3

# Folder and file names by convention.
_VENDOR = re.compile(r"(?:^|/)(?:vendor|vendored|third[_-]?party|node_modules|bower_components|jspm_packages|site-packages|dist-packages|_vendor|Godeps(?:/_workspace)?|external|extern|deps)/(?:lib/)?(?P<name>@?[^/]+)(?=/)")
_GENERATED_PATH = re.compile(r"(?:^|/)(?:gen|generated|__generated__|autogen)/|(?:^|/)zz_generated[._]|\.(?:generated|gen|g|pb|designer)\.\w+$|_(?:gen|generated|pb2|pb2_grpc)\.\w+$|\.pb\.(?:go|cc|h)$", re.I)
_LOCK = re.compile(r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|pipfile\.lock|composer\.lock|cargo\.lock|gemfile\.lock|go\.sum|[^/]+\.lock(?:\.json|\.yaml)?)$", re.I)
_MARK = re.compile(r"^\s*(?:#|//|/\*+!?|\*|;|--|<!--|\"\"\")\s*(?:<auto-?generated\b|@generated\b|auto-?generated\b|(?:this (?:file|code) (?:was|is) )?(?:automatically |auto-?)?generated (?:by|from|with|using)\b|code generated (?:by|from)\b|warning: (?:machine|auto)|machine[- ](?:made|generated)|do not (?:edit|modify)\b|generated (?:file|code)\b)", re.I)
_THIRD = re.compile(r"^\s*(?:#|//|/\*+!?|\*|;)?\s*(?:(?:bundled|vendored) copy of|imported from upstream|copied from|vendored from|third-party code from)\s+(?P<name>[@\w./-]+)|^\s*(?:#|//|/\*+!?|\*)?\s*(?P<n2>[@\w./-]+) v?\d+\.\d+(?:\.\d+)? - https?://|^\s*(?:#|//|/\*+!?|\*)\s*(?:permission is hereby granted, free of charge|released under the [\w .-]+ licen[sc]e)", re.I)
_COMMENT = re.compile(r"\s*(?:#|//|/\*|\*|;|--|<!--|\"\"\"|$)")
_CODE_FILE = (".py", ".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".go", ".css", ".java", ".rb", ".php", ".c", ".h", ".cc", ".cpp", ".rs")
_LITERAL = re.compile(r"(?P<c>//[^\n]*|/\*.*?\*/|(?m:^\s*#[^\n]*))|(?P<s>\"\"\".*?\"\"\"|'''.*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)|(?P<n>(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?))", re.S)
_KEYWORD = re.compile(r"\b(?:def|function|func|class|return|while|if)\b")


# a banner of a released package: its name and version, and in the same block whose it is
_BANNER = re.compile(r"^\s*(?:#|//|/\*+!?|\*|;)?\s*(?:@(?:license|preserve|name|package|module)\s+)?(?P<name>@?[A-Za-z][\w./-]*?)(?:\.js)?[ ,@-]+(?:version )?v?\d+\.\d+(?:\.\d+)?(?:[-+][\w.]+)?\s*(?:\*/)?(?:$|[|(,;-]|\bby\b)", re.I)
_OWNED = re.compile(r"(?:\(c\)|©|\bcopyright\b|@licen[sc]e\b|\blicen[sc]ed?\b)", re.I)


def _clean(path: str) -> str:
    return path[2:] if path.startswith("./") else path


def package_of(path: str, head: list[str]) -> str | None:
    """The third-party package a file belongs to by its folder or header; an empty name if it has none."""
    m = _VENDOR.search(path)
    name = m["name"] if m else None
    for line in head:
        if (t := _THIRD.match(line)) is not None:
            name = name or t["name"] or t["n2"] or ""
    if not name and any(_OWNED.search(line) for line in head):
        name = next((t["name"] for t in map(_BANNER.match, head) if t), name)
    if name is None:
        return None
    return re.sub(r"[-_.]?v?\d+(?:\.\d+)+$", "", name).lower().replace("_", "-").rstrip(".,;")


def header(text: str) -> list[str]:
    """The comment lines at the top of a file, however many, package clauses and shebangs passed over; lines inside a block
    comment are given a star."""
    return _header(text)[0]


def _header(text: str) -> tuple[list[str], int]:
    """The comment lines at the top, and the offset after them."""
    out, at, closing = [], 0, None
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line = text[at:stop]
        if closing:
            out.append(line if _COMMENT.match(line) else "* " + line.lstrip())
            closing = None if closing in line else closing
        elif _COMMENT.match(line):
            out.append(line)
            m = re.match(r"\s*(/\*|<!--)", line)
            end = {"/*": "*/", "<!--": "-->"}[m[1]] if m else None
            closing = end if end and end not in line[m.end() :] else None
        elif not re.match(r"\s*(?:package \w+|['\"]use strict['\"];?|#!)", line):
            break
        at = stop + 1
    return out, min(at, len(text))


def content_name(text: str) -> str:
    """A name for a package without one: the least hash of its lines of code, which copies share, edited or not."""
    body = text[_header(text)[1] :] or text
    lines = {x.strip() for x in body.split("\n")}
    lines = {x for x in lines if len(x) >= LINE_CHARS} or lines
    return "content-" + min(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest() for x in lines)


def line_hashes(text: str | None) -> list[int]:
    """Hashes of the different lines of a text that are long enough to tell something, blanks around them aside."""
    lines = {x.strip() for x in (text or "").split("\n")}
    return [int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) for x in lines if len(x) >= LINE_CHARS]


def composition(text: str, path: str) -> str | None:
    """Token composition: 'minified', 'data', or None."""
    lower = path.lower()
    if not lower.endswith(_CODE_FILE):
        return None
    longest = max(map(len, text.split("\n")))
    dense = None
    if longest > 200:
        dense = _LITERAL.sub(lambda m: " " if m.lastgroup == "c" else "s" if m.lastgroup == "s" else "0", text)
        lines = [x for x in dense.split("\n") if x.strip()]
        code = sum(map(len, lines))
        spaces = sum(x.count(" ") + x.count("\t") for x in lines)
        if lines and code >= 200 and max(map(len, lines)) > 200 and code / len(lines) > 100 and spaces < 0.12 * code:
            return "minified"
    numbers = strings = 0
    rest: list[str] = []
    last = 0
    for m in _LITERAL.finditer(text):
        rest.append(text[last : m.start()])
        last = m.end()
        if m.lastgroup == "n":
            numbers += 1
        elif m.lastgroup == "s":
            s = m.group()
            if len(s) > 40 and not re.search(r"\s\w+\s", s):
                strings += len(s)
    rest.append(text[last:])
    if longest <= 200 and any(_KEYWORD.search(x) for x in rest):
        return None
    words = len(re.findall(r"[A-Za-z_$][\w$]*", " ".join(rest)))
    if numbers >= 60 and words <= 6 + numbers * 0.05 or strings >= 400 and words <= 8 + strings / 400:
        return "data"
    return None


def classify(path: str | None, text: str | None) -> tuple[str | None, str | None]:
    """(kind, package) by the rules: generated, lock, minified, data, vendored, or None."""
    if path is None or text is None:
        return None, None
    path = _clean(path)
    head = header(text)
    package = package_of(path, head)
    if package is not None:
        return "vendored", package or content_name(text)
    if _LOCK.search(path) or '"lockfileVersion"' in text[:300] and '"packages"' in text[:1000]:
        return "lock", None
    if any(_MARK.match(line) for line in head) or _GENERATED_PATH.search(path):
        return "generated", None
    if re.search(r"\.min\.(?:js|css|mjs)$", path):
        return "minified", None
    return (composition(text, path), None) if text else (None, None)


def provenance(df: DataFrame, key: str = "file_id", path: str = "file_path", text: str = "content") -> DataFrame:
    """(key, kind, package, share) of every file that is not hand-written, each key once.

    kind is generated, lock, minified, data, vendored (by folder or header) or copied (by its lines; share is then the
    part of its lines that the package contains). Null texts and paths give no row.
    """
    both = f"{key} bigint, kind string, package string, hs array<bigint>"

    def one(k, p, t):
        if k is None:
            return []
        kind, package = classify(p, t)
        return [(k, kind, package, line_hashes(t) if kind in (None, "vendored") else [])]

    # one reading of the texts; what is kept of a file are its verdict and the hashes of its lines
    files = cut(arrow_rows(df, [key, path, text], both, one).dropDuplicates([key]))
    package = files.where("kind = 'vendored'").select("package", F.explode("hs").alias("h")).distinct()
    frequency = package.groupBy("h").agg(F.count("*").alias("packages"))
    open_ = files.where("kind is null and size(hs) > 0").select(key, "hs")
    lines = open_.select(key, F.explode("hs").alias("h"))
    # a line's repeats are counted before they meet its frequency; lines of no package have none, and are the rarest
    known = lines.join(frequency, "h").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("packages", "h"))).alias("known"))
    total = F.size("hs")
    # of the rarest lines, those that no package has stand first
    prefix = F.floor((1 - CONTAINED) * total + 1e-9).cast("int") + 1 - (total - F.size("known"))
    rarest = open_.join(known, key).where(prefix > 0).select(key, F.explode(F.slice("known", F.lit(1), prefix)).alias("x")).select(key, F.col("x.h").alias("h"))
    candidates = rarest.join(package, "h").select(key, "package").distinct()
    shared = candidates.join(open_, key).select(key, "package", total.alias("total"), F.explode("hs").alias("h")).join(package, ["package", "h"])
    share = shared.groupBy(key, "package").agg(F.count("*").alias("n"), F.max("total").alias("total")).withColumn("share", F.col("n") / F.col("total"))
    best = share.where((F.col("share") >= CONTAINED) & (F.col("n") >= FEWEST_LINES)).groupBy(key).agg(F.max(F.struct("share", "package")).alias("b"))
    flagged = files.where("kind is not null").select(key, "kind", "package", F.lit(None).cast("double").alias("share"))
    return flagged.unionByName(best.select(key, F.lit("copied").alias("kind"), F.col("b.package").alias("package"), F.col("b.share").alias("share")))


def found(df: DataFrame) -> DataFrame:
    return provenance(spread(df)).select("file_id")
