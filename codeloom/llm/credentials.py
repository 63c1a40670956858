"""Credentials embedded in source code and configuration (problem 2).

Method: the text is tokenised lexically around every identifier-like word whose parts name a credential; a
literal that is assigned or passed to such a name is a credential unless it is a placeholder, a reference or a name.
Connection addresses with a login, authorisation headers, command-line passwords and private key blocks are further
places where a literal is passed. Only the literal's content is masked: quotes, delimiters, escapes and line breaks stay.

Everything happens inside one map over the rows: no shuffle but the final deduplication of (id, line) pairs.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import re
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame

from .common import arrow_rows

MASK = "*"

# One hit of these on a line makes the line a candidate; plain searches are far cheaper than one pattern.
_STEMS = ("pass", "pwd", "pw", "secret", "token", "key", "auth", "bearer", "credential", "login", "://", "curl", "mysql", "sshpass", "-u ", "--user")
_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PRIVATE_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
# quotes, joints and blanks around a piece of a literal; a plus beside none of them is base64
_AROUND = re.compile(r"^(?:[\s,;()\\]|\+(?=[\s\"'`]|$))*[\"'`]*|[\"'`]*(?:[\s,;()\\]|(?<=[\s\"'`])\+)*$")
_KEY_HEADER = re.compile(r"[A-Z][A-Za-z]*(?:-[A-Z][A-Za-z]*)*: .*")
_URL = re.compile(r"(?<![a-z0-9+.\-])[a-z][a-z0-9+.\-]*+://[^\s:/@'\"`<>{}]*:(?P<v>(?:(?!://)[^\s@'\"`])+)@(?=[\w\[])", re.I)
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

_STRONG = {"password", "passwd", "pwd", "pw", "pass", "passphrase", "passcode", "passwort", "secret", "secrets", "token", "tokens", "apikey", "credential", "credentials", "bearer", "auth", "authtoken", "accesskey", "secretkey"}
_NOT_A_SECRET_KEY = {"public", "sort", "primary", "foreign", "cache", "partition", "hash", "index", "map", "dict", "object", "group", "row", "unique", "composite", "lookup", "route", "routing", "join", "hot", "arrow", "shortcut", "dedup", "range", "cluster", "registry", "natural", "surrogate", "storage", "answer", "translation", "i18n", "locale", "label", "idempotency", "sorting", "order", "key", "shard", "bucket"}
_ENCODED = {"b64", "base64", "encoded", "enc"}
_FILLER = {"value", "val", "str", "string", "default", "raw", "text", "plain", "plaintext", "prod", "dev", "staging", "test", "old", "new", "current", "v", "live"}

_PLACEHOLDER = re.compile(
    r"""^(?:
        <[^>]*> | \$\{.*\}? | \$\(.*\)? | \$[A-Za-z_]\w* | \{\{?.*\}?\}? | %\(.*\)s | %[A-Za-z_]+% | \[.*\] | \#\{.*\}
      | (?:env|vault|secret|secrets|ssm|kv|op|keyring|store|file|arn|gcp|aws|azure|sops|keychain|doppler|config|ref)(?::|://|/).*
      | (?:os\.|process\.env|System\.getenv|getenv|ENV\b|import\.meta).*
      | (?:x|X|\*|\.|-|_|\#|\?|0|1){3,}
      | (?:https?|ftp)://[^@]*
    )$""",
    re.X | re.S,
)
_DUMMY = re.compile(r"change[-_ ]?me|replace[-_ ]?(?:me|this|with)|^todo\b|^fixme\b|^dummy|placeholder|^your[-_ ]|[-_ ]here$|^example|example[-_]?(?:key|token|password|secret)|^insert[-_ ]|^enter[-_ ]|^fake|^sample|^redacted|^masked|^hidden$|^none$|^null$|^nil$|^undefined$|^true$|^false$|^tbd$|^n/?a$|^(?:my|the|a)[-_ ](?:password|secret|token|key)|^foo(?:bar)?$|xxxx|\*{3,}|\.\.\.", re.I)
_KNOWN = re.compile(r"^(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|AKIA|ASIA|sk-|[srp]k_(?:live|test)_|vk\d_|npm_|pypi-|eyJ[A-Za-z0-9_-]{8,}\.|AIza|SG\.|ya29\.|hf_|dop_v1_|shpat_)")
_NAMES = {"bearer", "basic", "digest", "x-api-key", "authorization", "password", "passwd", "pwd", "user_password", "token", "opaque", "secret", "api_key", "apikey", "string", "text", "required", "optional", "username", "admin", "root"}
_PATH = re.compile(r"^(?:\.{0,2}|~)/[a-z0-9_.-]*(?:/[a-z0-9_.-]*)*$")
_CODE_VALUE = re.compile(r"^[A-Za-z_][\w.]*\(.*|^[a-z_]+(?:\.[a-z_]+)+$")
_COLON_NAME = re.compile(r"^[A-Za-z_]+(?:[:/.][A-Za-z_]+)+(?:[:/.]v\d+)?$")


class Span(NamedTuple):
    """A credential: the offset where its value starts, the pieces of its value, and what it is."""

    start: int
    pieces: tuple[tuple[int, int], ...]
    kind: str


@lru_cache(maxsize=50_000)
def name_kind(name: str) -> str | None:
    """What a name promises: 'strong' or 'key' for a credential, 'encoded' for an encoded one, None otherwise."""
    words = [w.lower() for w in _SPLIT.findall(name)]
    encoded = False
    while words and (words[-1] in _FILLER or words[-1].isdigit() or words[-1] in _ENCODED or words[-1] == "b"):
        encoded |= words[-1] in _ENCODED or (words[-1] in ("64", "b"))
        words.pop()
    if not words:
        return None
    last, before = words[-1], words[-2] if len(words) > 1 else ""
    kind = None
    if last in _STRONG:
        kind = "strong"
    elif last in ("key", "keys") and before and before not in _NOT_A_SECRET_KEY:
        kind = "key"
    elif last.endswith(("password", "passwd", "apikey", "secret", "token")):
        kind = "strong"
    return "encoded" if kind and encoded else kind


def usable(value: str, kind: str) -> bool:
    """Whether a literal can be the value of a credential, and not a placeholder, a reference or a name."""
    v = value.strip()
    if len(v) < 6 or _PLACEHOLDER.match(v) or _DUMMY.search(v) or v.lower() in _NAMES:
        return False
    if _KNOWN.match(v) and len(v) >= 12:
        return True
    if re.search(r"\$\{|\{[A-Za-z_]", v):  # built from other values
        return False
    if kind == "encoded":
        try:
            v = base64.b64decode(v, validate=True).decode("utf-8")
        except (binascii.Error, UnicodeDecodeError, ValueError):
            return False
        return len(v) >= 6 and not _DUMMY.search(v)
    if any(c.isspace() for c in v) or v.startswith(("ssh-", "data:", "sha256-", "sha384-", "sha512-")) or _PATH.match(v) or _COLON_NAME.match(v) or _CODE_VALUE.match(v):
        return False
    if re.match(r"^(?:min|max)[-_](?:length|len)[-_]?\d+$", v, re.I) or re.fullmatch(r"[\d.,:+-]+", v) and kind != "strong":
        return False
    digit, lower, upper = any(c.isdigit() for c in v), any(c.islower() for c in v), any(c.isupper() for c in v)
    symbol = bool(re.search(r"[^\w\s.\-:/]", v))
    if kind == "url":
        return digit or symbol or (lower and upper)
    if kind == "key" and len(v) < 12 and not symbol:
        return False
    if digit and (lower or upper):
        return True
    inner_upper = bool(re.search(r"[a-z][A-Z].*[A-Z]|[A-Z]{2,}[a-z]+[A-Z]", v)) and "_" not in v
    return len(v) >= 10 and (inner_upper or (symbol and (lower or upper) and not re.search(r"[(){}\[\];,]", v)))


_QUOTES = ('"""', "'''", '"', "'", "`")


def read_literal(text: str, at: int) -> tuple[int, int, int] | None:
    """The literal that begins at an offset: start and end of its content, and the offset after it."""
    n = len(text)
    i = at
    while i < n and i < at + 2 and text[i] in "rRbBfFuU":
        i += 1
    for q in _QUOTES:
        if text.startswith(q, i):
            j = i + len(q)
            while j < n:
                c = text[j]
                if c == "\\":
                    j += 2
                    continue
                if c == "\n" and len(q) == 1 and q != "`":
                    return None
                if text.startswith(q, j):
                    return i + len(q), j, j + len(q)
                j += 1
            return None
    return None


_JOIN = re.compile(r"(?:[ \t]*(?:\\|[+.&])?[ \t]*\r?\n[ \t]*(?:[+.&][ \t]*)?|[ \t]*[+.&][ \t]*)(?=[rRbBfFuU]{0,2}[\"'`])")


def read_value(text: str, at: int) -> tuple[str, tuple[tuple[int, int], ...]] | None:
    """A literal with its continuations in further literals (adjacent in brackets, or joined by an operator)."""
    i, opened = at, False
    while i < len(text) and text[i] in " \t(\\\r\n":
        opened |= text[i] == "("
        if text[i] == "\n" and not (opened or text[i - 1 : i] == "\\" or text[i - 2 : i] == "\\\r"):
            return None
        i += 1
    lit = read_literal(text, i)
    if lit is None:
        return None
    pieces, value, after = [(lit[0], lit[1])], text[lit[0] : lit[1]], lit[2]
    while (m := _JOIN.match(text, after)) is not None:
        joint = m.group()
        if not opened and not re.search(r"[+.&\\]", joint):
            break
        nxt = read_literal(text, m.end())
        if nxt is None:
            break
        pieces.append((nxt[0], nxt[1]))
        value += text[nxt[0] : nxt[1]]
        after = nxt[2]
    return value, tuple(pieces)


# name, optional closing quote and bracket, optional type, operator
_ASSIGN = re.compile(
    r"""(?:(?P<q>["'`])|(?<![\w.])(?<!\w-))(?P<name>[A-Za-z_][\w.\-]*)(?(q)(?P=q))\s*\]?[ \t]*
        (?:(?::|\s)[ \t]*(?:const\s+)?[A-Za-z_][\w.\[\]<>|]*[ \t]*(?==[^=]))?
        (?P<op>:=|=>|=(?!=)|:(?!=)|,)[ \t]*""",
    re.X,
)
_CALL = re.compile(r"\b(?:login|log_in|sign_?in|authenticate|auth|basic_?auth|set_?credentials|connect_as)\s*\(\s*([\"'])(?:(?!\1)[^\\\n])*\1\s*,\s*(?=[\"'`])", re.I)
_BASIC_AUTH = re.compile(r"\bauth\s*=\s*\(\s*([\"'])(?:(?!\1)[^\\\n])*\1\s*,\s*(?=[\"'`])", re.I)
_HEADER = re.compile(r"\b(?:authorization|x-(?:api|auth|access)-(?:key|token)|private-token|api-key)[\"']?\s*[:,=]\s*[\"']?\s*(?:(?:bearer|basic|token)\s+)?(?P<v>[^\s\"'`,;)}]+)", re.I)
_CLI_USER = re.compile(r"(?:\s-u|\s--user)[ =]+[\"']?[\w.@\-]+:(?P<v>[^\s\"'`]+)")
_CLI_PASS = re.compile(r"\b(?:mysql|mysqldump|mariadb|psql|sqlcmd|mongo|sshpass)\b[^\n]*?\s-p\s?(?P<q>[\"']?)(?P<v>[^\s\"'<>|]+)(?P=q)")
_COMMENT = re.compile(r"(?:^|\s)(?:#|//|/?\*|--|;|<!--)\s?(?P<body>.*)$")
_SPOKEN = re.compile(r"\b(?:password|passwd|pwd|pw|passphrase|passcode|token|secret|api[ _-]?key|credential)s?\b[\"']?\s*(?:is|was|[:=])?\s*[\"']?(?P<v>[^\s\"'`,;]+)", re.I)
_BARE_FILES = (".ini", ".cfg", ".env", ".properties", ".toml", ".conf", ".sh", ".bash", ".yaml", ".yml")
_CLI_OPTION = re.compile(r"--(?P<name>[a-z][\w\-]*)[ =]+(?P<v>[^\s\"']+)")


def _hits(text: str) -> list[int]:
    """Offsets of all stems, in order."""
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(_ASCII_LOWER)
    out = []
    for stem in _STEMS:
        i = low.find(stem)
        while i >= 0:
            out.append(i)
            i = low.find(stem, i + 1)
    return sorted(out)


def _is_key(body: str) -> bool:
    """Whether what follows the BEGIN line is key material, quotes and joints of a literal aside."""
    packed = re.sub(r"\\[nrt]|[\s\"'+\\]|,", "", body)
    return len(packed) >= 32 and re.fullmatch(r"[A-Za-z0-9+/=:\-]+", packed) is not None and len(set(packed)) > 8


def _key_lines(body: str) -> int:
    """The offset after the last base64 line of a key block without its END: long lines, and a shorter one after them."""
    width = stop = 0
    for m in re.finditer(r"[^\n]+", re.sub(r"\\[nr]", "\n\n", body)):
        line = _AROUND.sub("", m.group())
        if not line or not width and _KEY_HEADER.fullmatch(line):
            continue
        if not re.fullmatch(r"[A-Za-z0-9+/=]+", line):
            break
        if len(line) >= 16 and (len(line) == width or not width or re.search("[A-Z]", line) and re.search("[a-z]", line) and re.search("[0-9]", line)):
            stop, width = m.end(), len(line)
            continue
        if width and len(line) < width and re.search(r"[A-Z0-9+/=]", line):
            stop = m.end()
        break
    return stop


def find_spans(text: str | None, path: str | None) -> list[Span]:
    """All credentials of a file. A null text has none; the path only decides whether bare values can occur."""
    if not text:
        return []
    found: dict[int, Span] = {}
    starts: list[int] = []  # of what is found, sorted; spans do not overlap

    def add(start: int, pieces: tuple[tuple[int, int], ...], kind: str) -> None:
        at = bisect.bisect_right(starts, start)
        if at and start < found[starts[at - 1]].pieces[-1][1]:
            return
        starts.insert(at, start)
        found[start] = Span(start, pieces, kind)

    for m in _PRIVATE.finditer(text):
        following = _PRIVATE.search(text, m.end())
        limit = following.start() if following else len(text)
        end = _PRIVATE_END.search(text, m.end(), limit)
        body = text[m.end() : end.start() if end else limit]
        if end is None or not _is_key(body):  # no END, or one that belongs to something else
            body = body[: _key_lines(body)]
        if _is_key(body):
            pieces = tuple((m.end() + p.start(), m.end() + p.end()) for p in re.finditer(r"[A-Za-z0-9+/=]{4,}", re.sub(r"\\[nrt]", "  ", body)))
            add(m.start(), pieces, "private_key")

    path = (path or "").lower()
    bare = path.endswith(_BARE_FILES)
    done = -1
    for hit in _hits(text):
        if hit < done:
            continue
        begin = text.rfind("\n", 0, hit) + 1
        stop = text.find("\n", hit)
        stop = len(text) if stop < 0 else stop
        done = stop
        line = text[begin:stop]
        if "://" in line:
            for m in _URL.finditer(line):
                if usable(m["v"], "url"):
                    s = begin + m.start("v")
                    add(s, ((s, begin + m.end("v")),), "address")
        for rx in (_HEADER, _CLI_USER, _CLI_PASS) if " -p" in line or "\t-p" in line else (_HEADER, _CLI_USER):
            for m in rx.finditer(line):
                if usable(m["v"], "strong"):
                    s = begin + m.start("v")
                    add(s, ((s, begin + m.end("v")),), "header" if rx is _HEADER else "command")
        for rx in (_CALL, _BASIC_AUTH):
            for m in rx.finditer(line):
                got = read_value(text, begin + m.end())
                if got and usable(got[0], "strong"):
                    add(got[1][0][0], got[1], "argument")
        at = 0
        while (m := _ASSIGN.search(line, at)) is not None:
            at = m.end() if m["op"] != "," else max(m.end("name") + 1, m.start() + 1)
            kind = name_kind(m["name"])
            if kind is None:
                at = m.end("name") + 1
                continue
            if m["op"] == "," and not m["q"]:
                continue
            got = read_value(text, begin + m.end())
            if got is not None:
                if usable(got[0], kind):
                    add(got[1][0][0], got[1], "assigned")
            elif bare and m["op"] in ("=", ":") and not _COMMENT.match(line[: m.start()] + " "):
                v = re.match(r"[^\s#][^\n]*?(?=\s+#|\s*$)" if not path.endswith((".sh", ".bash")) else r"[^\s;#\"'$][^\s;]*", text[begin + m.end() : stop])
                if v and re.fullmatch(r"[>|][+-]?\d?", v.group()):
                    nxt = re.compile(r"\s*\n[ \t]+(\S+)").match(text, begin + m.end() + v.end())
                    if nxt and usable(nxt[1], kind):
                        add(nxt.start(1), ((nxt.start(1), nxt.end(1)),), "assigned")
                elif v and usable(v.group(), kind):
                    s = begin + m.end()
                    add(s, ((s, s + v.end()),), "assigned")
        for m in _CLI_OPTION.finditer(line):
            kind = name_kind(m["name"])
            if kind and usable(m["v"], kind):
                s = begin + m.start("v")
                add(s, ((s, begin + m.end("v")),), "command")
        if (c := _COMMENT.search(line)) is not None:
            for m in _SPOKEN.finditer(c["body"]):
                if usable(m["v"], "strong") and not re.match(r"^[\w]+\(", m["v"]):
                    s = begin + c.start("body") + m.start("v")
                    add(s, ((s, begin + c.start("body") + m.end("v")),), "comment")
    return [found[k] for k in sorted(found)]


def redact_text(text: str | None, path: str | None, spans: list[Span] | None = None) -> str | None:
    """The text with the value of each credential masked, character by character; null stays null."""
    spans = find_spans(text, path) if spans is None else spans
    if not spans or text is None:
        return text
    out, last = [], 0
    for a, b in sorted(p for s in spans for p in s.pieces):
        if a < last:
            continue
        out += [text[last:a], _mask(text[a:b])]
        last = b
    return "".join(out) + text[last:]


def _mask(value: str) -> str:
    """Every character masked but escapes and line breaks, so that the literal still ends where it ended."""
    return re.sub(r"\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|\r?\n|.)|[^\n\r]", lambda m: m.group() if m.group()[0] == "\\" else MASK, value, flags=re.S)


def _lines(key, path, text):
    if text is None or key is None:
        return []
    out, line, last = [], 1, 0
    for s in find_spans(text, path):
        line += text.count("\n", last, s.start)
        last = s.start
        out.append((key, line, s.kind))
    return out


def find_credentials(df: DataFrame, key: str = "file_id", path: str = "file_path", text: str = "content") -> DataFrame:
    """(key, line_no, kind) of every credential, each line once.

    Null keys and null or empty texts give no row; repeated rows of a key count once; other columns are ignored.
    A value that goes on over several lines is reported on its first line.
    """
    return arrow_rows(df, [key, path, text], f"{key} bigint, line_no int, kind string", _lines).dropDuplicates([key, "line_no"])


def redact(df: DataFrame, key: str = "file_id", path: str = "file_path", text: str = "content") -> DataFrame:
    """(key, n_credentials, redacted): the whole text with only secret values masked; null texts stay null."""

    def one(k, p, t):
        spans = find_spans(t, p)
        return [(k, len(spans), redact_text(t, p, spans))]

    return arrow_rows(df, [key, path, text], f"{key} bigint, n_credentials int, redacted string", one)
