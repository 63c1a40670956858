"""Code-quality rules: a catalogue of predicates over the lines of files, evaluated in one pass.

A rule looks at a line, and if it says so at the next line, at the lines around it and at the whole file. Comment lines are
passed over unless the rule is about them. Languages go by extension. All patterns are in the common subset of regular
expressions (no look-around), so any engine can evaluate the catalogue.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .operators.changes import in_diff_scope

SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
PY, JS, GO, SH, ANY = ("py",), ("js", "ts"), ("go",), ("sh",), ("py", "js", "ts", "go", "sh")
_CODE = ("py", "js", "ts")
ON_WRITE, ON_STOP, ON_COMMIT = "ON_WRITE", "ON_STOP", "ON_COMMIT"


class Rule(NamedTuple):
    rule_id: str
    severity: str
    languages: tuple[str, ...]
    line: str  # the line must match
    unless: str | None = None  # the line must not match
    follow: str | None = None  # the next line must match
    no_follow: str | None = None  # the next line must not match
    no_file: str | None = None  # no text of the file may match
    fast: bool = True  # also when a file is written
    no_near: str | None = None  # no text from 3 lines before to 12 lines after may match
    no_after: str | None = None  # no text from the line itself to 20 lines after may match
    comments: bool = False  # comment lines are looked at too
    confidence: float = 0.8


RULES: tuple[Rule, ...] = (
    Rule("DOCUMENTATION.MISSING_DOCSTRING", "MEDIUM", PY, r"^\s*(async )?def [a-z]\w*\(.*\).*:\s*$", no_follow=r"^\s*[rRuU]?[\"']"),
    Rule("DOCUMENTATION.MISSING_DOCSTRING", "MEDIUM", JS, r"^\s*\}?\s*$", follow=r"^(export )?(async )?function \w+\("),
    Rule("GIT.FORCE_PUSH", "CRITICAL", SH, r"git push .*(--force|-f\b)", unless="--force-with-lease"),
    Rule("GIT.HARD_RESET", "CRITICAL", SH, r"git reset .*--hard"),
    Rule("GIT.DESTRUCTIVE_OPS", "CRITICAL", SH, r"git (clean -\w*f|branch -D|checkout -- \.|filter-branch)|rm -rf /"),
    Rule("RESILIENCE.MISSING_RETRY", "MEDIUM", _CODE, r"requests\.(get|post|put|delete)\(|\bfetch\(|axios\.(get|post)\(|urlopen\(", no_near=r"(?i)retry|retries|backoff|tenacity|attempt", confidence=0.6),
    Rule("RESILIENCE.MISSING_TIMEOUT", "MEDIUM", _CODE, r"requests\.(get|post|put|delete)\(|axios\.(get|post)\(|urlopen\(|\bfetch\(", no_near=r"(?i)timeout|AbortSignal|AbortController", confidence=0.7),
    Rule("RESILIENCE.SWALLOWED_EXCEPTIONS", "HIGH", PY, r"^\s*except\b.*:\s*$", follow=r"^\s*(pass|\.\.\.|continue)\s*$"),
    Rule("RESILIENCE.SWALLOWED_EXCEPTIONS", "HIGH", PY, r"^\s*except\b.*:\s*$", follow=r"^\s*(logger|logging)\.\w+\(.*\)\s*$"),
    Rule("RESILIENCE.SWALLOWED_EXCEPTIONS", "HIGH", JS, r"catch\s*(\([^)]*\))?\s*\{\s*\}"),
    Rule("RESILIENCE.SWALLOWED_EXCEPTIONS", "HIGH", JS, r"\}\s*catch\s*(\([^)]*\))?\s*\{\s*$", follow=r"^\s*(log|console)\.\w+\(.*\);?\s*$"),
    Rule("RESILIENCE.UNSAFE_CONCURRENCY", "HIGH", ("py", "js", "ts", "go"), r"threading\.Thread\(|\bgo func\(|new Worker\(|^\s*global \w+", no_file=r"(?i)\block\b|mutex|semaphore|queue", fast=False),
    Rule("RESILIENCE.UNSAFE_LOOP", "HIGH", ("py", "js", "ts", "go"), r"while True:|while\s*\((true|1)\)|^\s*for \{\s*$", no_after=r"\bbreak\b|\breturn\b|\braise\b|\bthrow\b|\byield\b|sys\.exit|process\.exit|os\.Exit|panic\("),
    Rule("RESILIENCE.UNSAFE_NULL", "MEDIUM", _CODE, r"\.(get|find|match|querySelector)\([^()]*\)(\.|\[)"),
    Rule("RESILIENCE.UNSAFE_RESOURCE", "MEDIUM", PY, r"=\s*(open|socket\.socket|sqlite3\.connect|urlopen|tempfile\.NamedTemporaryFile)\(", unless=r"\bwith\b", no_after=r"\.close\(\)|closing\("),
    Rule("RESILIENCE.UNSAFE_RESOURCE", "MEDIUM", JS, r"=\s*fs\.(openSync|createReadStream|createWriteStream)\(", no_after=r"closeSync\(|\.close\(|\.destroy\(|\.end\(|pipeline\("),
    Rule("RESILIENCE.UNSAFE_RESOURCE", "MEDIUM", JS, r"\bsetInterval\(", no_file=r"clearInterval\(", confidence=0.7),
    Rule("RESILIENCE.UNSAFE_RESOURCE", "MEDIUM", JS, r"\.addEventListener\(", unless=r"once:|signal", no_file=r"removeEventListener\(", confidence=0.6),
    Rule("RESILIENCE.UNSAFE_RESOURCE", "MEDIUM", JS, r"\.subscribe\(", no_file=r"unsubscribe\(|takeUntil|firstValueFrom", confidence=0.6),
    Rule("RESILIENCE.UNSAFE_RESOURCE", "MEDIUM", JS, r"new (WebSocket|EventSource|Worker)\(", no_file=r"\.(close|terminate)\("),
    Rule("SECURITY.COMMAND_INJECTION", "CRITICAL", ANY, r"os\.system\(|shell\s*=\s*True|child_process\.exec\(|\bexecSync\(|\beval\(|subprocess\.\w+\(\s*f[\"']|exec\.Command\(\"(sh|bash)\"|\brun\(\"curl "),
    Rule("SECURITY.INSECURE_CRYPTO", "HIGH", ANY, r"(?i)\b(md5|sha1)\b\s*[.(]|\bDES\b|MODE_ECB|createHash\([\"'](md5|sha1)"),
    Rule("SECURITY.INSECURE_DESERIALIZE", "HIGH", ANY, r"pickle\.loads?\(|yaml\.load\(|marshal\.loads?\(|unserialize\(", unless="SafeLoader"),
    Rule("SECURITY.INSECURE_RANDOM", "MEDIUM", ANY, r"random\.(random|randint|choice)\(|Math\.random\(|rand\.Intn?\("),
    Rule("SECURITY.MISSING_AUTH", "HIGH", _CODE, r"@(app|router)\.(route|get|post|put|delete)\(|(app|router)\.(post|put|delete)\([\"']", unless=r"(?i)auth|login|health", no_follow=r"(?i)auth|login|permission", confidence=0.6),
    Rule("SECURITY.MISSING_HTTPS", "MEDIUM", ANY, r"http://[a-z0-9]", unless=r"http://(localhost|127\.|0\.0\.0\.0|www\.w3\.org|example\.|[a-z0-9.-]+\.(test|example|local)\b)"),
    Rule("SECURITY.PATH_TRAVERSAL", "HIGH", ANY, r"open\([^)]*(request|params|argv|input)|path\.join\([^)]*(req\.|params|argv)|send_file\([^)]*request"),
    Rule("SECURITY.SENSITIVE_EXPOSURE", "MEDIUM", ANY, r"(?i)(print|log\w*\.\w+|console\.\w+|printf)\(.*(password|passwd|secret|api_?key|credential)"),
    Rule("SECURITY.SQL_INJECTION", "CRITICAL", ANY, r"(?i)(execute|query|raw)\(\s*(f[\"']|[\"'][^\"']*(select|insert|update|delete)\b[^\"']*[\"']\s*(\+|%|\.format))"),
    Rule("SECURITY.XSS_VULNERABILITY", "CRITICAL", JS, r"\.innerHTML\s*=|document\.write\(|dangerouslySetInnerHTML|v-html="),
    Rule("TECH_DEBT.COMMENTED_CODE", "LOW", _CODE, r"^\s*(#|//)\s*(def|class|if|for|while|return|const|let|var|function|import)\b.*[:;({)]\s*$", comments=True, confidence=0.7),
    Rule("TECH_DEBT.DEBUG_STATEMENTS", "LOW", ("py", "js", "ts", "go"), r"^\s*(print\(|console\.(log|debug)\(|fmt\.Print(ln|f)?\()"),
    Rule("TECH_DEBT.BREAKPOINTS", "HIGH", _CODE, r"^\s*(breakpoint\(\)|import i?pdb|i?pdb\.set_trace\(|debugger;?)"),
    Rule("TECH_DEBT.DEPRECATED_APIS", "MEDIUM", ("py", "js", "ts", "go"), r"datetime\.utcnow\(|get_event_loop\(|new Buffer\(|componentWill(Mount|Update)|ioutil\.|\.substr\("),
    Rule("TECH_DEBT.MAGIC_NUMBERS", "LOW", _CODE, r"(==|<|>|<=|>=)\s*[0-9]{3,}\b", unless=r"^[A-Z_]+\s*=", confidence=0.5),
    Rule("TECH_DEBT.NAMING_CONVENTIONS", "MEDIUM", PY, r"^\s*(async )?def [a-z_]*[A-Z]\w*\(|^\s*class [a-z]\w*"),
    Rule("TECH_DEBT.NAMING_CONVENTIONS", "MEDIUM", JS, r"function [a-z]+_[a-z]\w*\(|^\s*(export )?class [a-z]\w*"),
    Rule("TECH_DEBT.TODO_MARKERS", "LOW", ANY, r"(#|//|\*|\"\"\")\s*TODO\b", comments=True, confidence=0.95),
    Rule("TECH_DEBT.FIXME_MARKERS", "HIGH", ANY, r"(#|//|\*)\s*(FIXME|XXX|HACK)\b", comments=True, confidence=0.95),
    Rule("TECH_DEBT.TOKEN_DRIFT", "MEDIUM", _CODE, r"[\"'](#[0-9a-fA-F]{6}|[0-9]+px)[\"']", fast=False),
    Rule("IMPORTANT.NEW_USAGE", "MEDIUM", ("css", "scss"), r"!important"),
    Rule("SUPPRESSION.NO_RATIONALE", "LOW", ANY, r"(eslint-disable|# noqa|# type: ignore|//nolint)\s*$", comments=True, confidence=0.9),
)


def _numbered(files: DataFrame) -> DataFrame:
    """(file_id, file_path, ext, content, line_no, line, next) with each line and its follower, without a shuffle."""
    lines = F.split("content", "\n")
    pairs = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"), F.coalesce(F.get(lines, i + 1), F.lit("")).alias("next")))
    ext = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1))
    return files.where("content is not null").select("file_id", "file_path", ext.alias("ext"), "content", F.explode(pairs).alias("p")).select("file_id", "file_path", "ext", "content", "p.*")


#: Lines that are comments as a whole, by the languages in which they begin like that.
HASH_COMMENT, SLASH_COMMENT = r"^\s*#", r"^\s*(//|/?\*)"
_HASHED = ("py", "sh")


def scan(files: DataFrame, rules: tuple[Rule, ...] = RULES, trigger: str = ON_COMMIT, rule_ids: list[str] | None = None, least_confidence: float = 0.0, ranges: DataFrame | None = None) -> DataFrame:
    """(file_id, file_path, line_no, rule_id, severity, confidence) of all findings; a rule reports a line once.

    Files of other languages and null contents have none. On writing only the fast rules run. With ranges (file_path, start,
    end), as a diff gives them, only findings on changed lines are kept.
    """
    chosen = [r for r in rules if (trigger != ON_WRITE or r.fast) and (rule_ids is None or r.rule_id in rule_ids) and r.confidence >= least_confidence]
    if not chosen:
        return files.where("false").select("file_id", "file_path", F.lit(0).alias("line_no"), F.lit("").alias("rule_id"), F.lit("").alias("severity"), F.lit(0.0).alias("confidence"))
    # columns of their own, since an expression would be evaluated again for every rule and line
    ext = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1))
    cut = files.where("content is not null").select("file_id", "file_path", "content", ext.alias("ext"), F.split("content", "\n").alias("_lines"))
    cut = cut.withColumn("_numbered", F.transform("_lines", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"))))
    lines = F.col("_lines")
    text = lambda first, last: F.array_join(F.slice(lines, first, last - first + 1), "\n")

    def hits(r: Rule) -> Column:
        def fits(p: Column) -> Column:
            line, n = p["line"], p["line_no"]
            c = line.rlike(r.line)
            if not r.comments:
                c &= ~F.when(F.col("ext").isin(*_HASHED), line.rlike(HASH_COMMENT)).otherwise(line.rlike(SLASH_COMMENT))
            if r.unless:
                c &= ~line.rlike(r.unless)
            if r.follow or r.no_follow:
                following = F.coalesce(F.get(lines, n), F.lit(""))
                c &= following.rlike(r.follow) if r.follow else F.lit(True)
                c &= ~following.rlike(r.no_follow) if r.no_follow else F.lit(True)
            if r.no_near:
                c &= ~text(F.greatest(F.lit(1), n - 3), n + 12).rlike(r.no_near)
            if r.no_after:
                c &= ~text(n, n + 20).rlike(r.no_after)
            return c

        # a file is searched as a whole first; only a rule that it may break looks at its lines
        asked = F.col("ext").isin(*r.languages) & F.col("content").rlike("(?dm)" + r.line)
        if r.no_file:
            asked &= ~F.col("content").rlike(r.no_file)
        found = F.transform(F.filter("_numbered", fits), lambda p: F.struct(p["line_no"].alias("line_no"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence")))
        return F.when(asked, found)

    # no text leaves the map, only findings
    found = cut.select("file_id", "file_path", F.explode(F.flatten(F.array_compact(F.array(*map(hits, chosen))))).alias("f")).select("file_id", "file_path", "f.*")
    # of several ways in which a rule fits a line, and of redelivered files, the surest counts
    out = found.groupBy("file_id", "file_path", "line_no", "rule_id").agg(F.max("severity").alias("severity"), F.max("confidence").alias("confidence"))
    if ranges is not None:
        out = in_diff_scope(out, ranges, line="line_no").where("in_scope").drop("in_scope")
    return out.select("file_id", "file_path", "line_no", "rule_id", "severity", "confidence")


def scan_sql(files: str, rules: tuple[Rule, ...] = RULES) -> str:
    """The same findings as SQL: a union over the catalogue."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for r in rules:
        c = [f"ext in ({', '.join(map(q, r.languages))})", f"regexp_matches(line, {q(r.line)})"]
        c += ["not note"] if not r.comments else []
        c += [f"not regexp_matches(line, {q(r.unless)})"] if r.unless else []
        c += [f"regexp_matches(next, {q(r.follow)})"] if r.follow else []
        c += [f"not regexp_matches(next, {q(r.no_follow)})"] if r.no_follow else []
        c += [f"not regexp_matches(array_to_string(ls[greatest(1, line_no - 3) : line_no + 12], chr(10)), {q(r.no_near)})"] if r.no_near else []
        c += [f"not regexp_matches(array_to_string(ls[line_no : line_no + 20], chr(10)), {q(r.no_after)})"] if r.no_after else []
        c += [f"file_id not in (select file_id from src where regexp_matches(content, {q(r.no_file)}))"] if r.no_file else []
        parts.append(f"select file_id, line_no, '{r.rule_id}' as rule_id, '{r.severity}' as severity from l where {' and '.join(c)}")
    hashed = ", ".join(map(q, _HASHED))
    return f"""
        with src as (select file_id, lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) as ext, content from {files} where content is not null),
        a as (select file_id, ext, string_split(content, chr(10)) as ls from src),
        b as (select file_id, ext, ls, i::int as line_no, ls[i] as line, coalesce(ls[i + 1], '') as next from (select *, unnest(range(1, len(ls) + 1)) as i from a)),
        l as (select *, case when ext in ({hashed}) then regexp_matches(line, {q(HASH_COMMENT)}) else regexp_matches(line, {q(SLASH_COMMENT)}) end as note from b)
        {' union '.join(parts)}"""


def severity_rank(severity: str | Column) -> Column:
    """1 for the lowest severity to 4 for the highest; null for others."""
    c = F.col(severity) if isinstance(severity, str) else severity
    out = F.lit(None).cast("int")
    for i, s in enumerate(SEVERITIES, 1):
        out = F.when(c == s, i).otherwise(out)
    return out


def blocked(findings: DataFrame, threshold: str = "HIGH") -> DataFrame:
    """(blocked, n): whether any finding reaches the threshold, and how many do; one row even for no findings."""
    hit = severity_rank("severity") >= SEVERITIES.index(threshold) + 1
    return findings.agg(F.coalesce(F.max(hit), F.lit(False)).alias("blocked"), F.count(F.when(hit, 1)).alias("n"))


def stale_parameters(files: DataFrame) -> DataFrame:
    """(file_id, line_no, name): documented parameters that the function below the comment does not have."""
    from pyspark.sql import Window

    rows = _numbered(files.where(F.lower("file_path").rlike(r"\.(js|ts)$"))).select("file_id", "line_no", "line")
    w = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("code", F.first(F.when(~F.col("line").rlike(r"^\s*(\*|/\*|$)"), F.col("line")), ignorenulls=True).over(w))
    p = rows.where(F.col("line").rlike(r"^\s*\* @param ")).withColumn("name", F.regexp_extract("line", r"@param (?:\{[^}]*\} )?(\w+)", 1))
    return p.where((F.col("name") != "") & F.coalesce(~F.concat(F.lit(" "), F.regexp_replace("code", r"\W+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("name"), F.lit(" "))), F.lit(True))).select("file_id", "line_no", "name")


def apply_fixes(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """(file_id, content) after replacing lines start..end by a text, from fixes (file_id, start, end, text).

    Fixes of a file are folded from the last to the first, so earlier line numbers stay true; overlapping ones apply in that order.
    """
    by = fixes.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "text")), asc=False).alias("fs"))
    lines = F.split("content", "\n")
    folded = F.aggregate("fs", lines, lambda acc, f: F.concat(F.slice(acc, F.lit(1), f["start"] - 1), F.array(f["text"]), F.slice(acc, f["end"] + 1, F.greatest(F.size(acc), F.lit(1)))))
    return files.join(by, "file_id", "left").select("file_id", F.when(F.col("fs").isNull(), F.col("content")).otherwise(F.array_join(folded, "\n")).alias("content"))
