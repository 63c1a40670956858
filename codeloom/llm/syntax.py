"""Source files that do not parse (problem 5).

Method: every file, of any size and language, is cut into chunks at line starts. A chunk is summarised by a map from each
lexer state in which it may begin to the state in which it ends and the brackets it leaves open or closes
(`chunk_summary`). Such summaries form a monoid (`combine`), so a file's chunks reduce in any grouping; a file whose
summary ends inside a string or comment, or with unpaired brackets, does not parse. Where the summary of the chunks so far
leaves nothing open, a balanced run of statements ends, and each run is decided by a local grammar: own grammars for
JavaScript, TypeScript, Go and YAML (module grammar), the interpreter's own parser for Python and for strict JSON.

A row holds its whole text, so a file's chunks lie in one task and their summaries are combined there, before any
exchange; only (key, verdict) rows are shuffled. What a chunk alone cannot tell (a replacement field of an f-string
with quotes in it, a brace that may end a template's expression) makes its summary `unsure`, which absorbs like an error
does, and the grammar then reads the file as one run.
"""

from __future__ import annotations

import ast
import json
import re
import sys
import warnings
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..session import spread
from .common import arrow_rows
from .grammar import JS_REGEX, check_go, check_js

EXTENSIONS = (".py", ".js", ".ts", ".go", ".json", ".yaml")
CHUNK_CHARS = 8_192

# ---------------------------------------------------------------- lexer-state maps

#: States in which a chunk can begin: code, comments over lines, and strings by their quote.
STATES = {"js": ("code", "block", '"', "'", "`"), "go": ("code", "block", "`"), "py": ("code", '"', "'", '"""', "'''"), "json": ("code",), "yaml": ("code",)}
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'"
_RUNE = r"'(?:[^'\\\n]|\\[^\n]+?)'"
# literals and comments that end within the chunk, then the openings of those that do not
_TOKEN = {
    "js": re.compile(rf"//[^\n]*|/\*.*?\*/|{_DOUBLE}|{_SINGLE}|{JS_REGEX}|(?P<open>/\*|[\"'`])", re.S),
    "go": re.compile(rf"//[^\n]*|/\*.*?\*/|{_DOUBLE}|{_RUNE}|`[^`]*`|(?P<open>/\*|[\"'`])", re.S),
    "py": re.compile(rf"#[^\n]*|\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|(?!\"\"\"|''')(?:{_DOUBLE}|{_SINGLE})|(?P<open>\"\"\"|'''|[\"'])", re.S),
    "json": re.compile(rf"{_DOUBLE}|(?P<open>\")", re.S),
}
_TOKEN_BRACES = re.compile(_TOKEN["js"].pattern + r"|(?P<brace>[{}])", re.S)
#: An expression in a template is opened and closed by signs of its own.
_EXPR, _ENDEXPR = "\x01", "\x02"
_OTHER = re.compile(r"[^()\[\]{}\x01\x02]+")
_MISPAIRED = re.compile(r"[(\[{\x01][)\]}\x02]")
_TO_CLOSE = str.maketrans("([{\x01", ")]}\x02")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_F_PREFIX = re.compile(r"(?:^|[^\w])(?:[fF][rR]?|[rR][fF])$")


def _normal(code: str) -> tuple[str, str, bool]:
    """Brackets left over by code without literals: those that close, those that open, and whether all others pair."""
    s = _OTHER.sub("", code)
    for _ in range(64):  # the innermost pairs, level by level
        t = s.replace("()", "").replace("[]", "").replace("{}", "").replace(_EXPR + _ENDEXPR, "")
        if len(t) == len(s):
            break
        s = t
    else:  # deeper still: one by one
        left: list[str] = []
        for c in s:
            if left and left[-1].translate(_TO_CLOSE) == c and c in ")]}" + _ENDEXPR:
                left.pop()
            else:
                left.append(c)
        s = "".join(left)
    at = next((i for i, c in enumerate(s) if c in "([{" + _EXPR), len(s))
    return s[:at], s[at:], not _MISPAIRED.search(s)


def _rest(lang: str, quote: str, text: str, i: int) -> int | None:
    """The offset after the end of a literal or comment that has begun before an offset; -1 if it goes on, None if it cannot."""
    if quote == "block":
        j = text.find("*/", i)
        return j + 2 if j >= 0 else -1
    if quote == "`" and lang == "go":
        j = text.find("`", i)
        return j + 1 if j >= 0 else -1
    j = i
    while True:
        if len(quote) == 1:
            m = re.compile(rf"(?:[^{quote}\\\n]|\\.)*", re.S).match(text, j)
            j = m.end()
            if j >= len(text):
                return -1
            return j + 1 if text[j] == quote else None
        m = re.compile(rf"(?:[^{quote[0]}\\]|\\.)*", re.S).match(text, j)
        j = m.end()
        if j >= len(text):
            return -1
        if text.startswith(quote, j):
            return j + 3
        j += 1


def _run(lang: str, text: str, state: str) -> tuple[str, str, str]:
    """From one state over a chunk: the end state, the closing brackets left over, and the opening ones."""
    if lang == "yaml":
        return "code", "", ""
    code: list[str] = []

    def stop(end: str) -> tuple[str, str, str]:
        closed, opened, paired = _normal("".join(code))
        return ("error", closed, "") if not paired else (end, closed, "" if end in ("error", "unsure") else opened)

    i, n, exprs = 0, len(text), []  # exprs: depth of braces in each template expression that is open
    while True:
        if state == "`" and lang == "js":
            i = _TEMPLATE.match(text, i).end()
            if i >= n:
                break
            if text[i] == "`":
                state, i = "code", i + 1
            elif text.startswith("${", i):
                code.append(_EXPR)
                exprs.append(0)
                state, i = "code", i + 2
            else:  # a backslash ends the chunk
                break
            continue
        if state != "code":
            j = _rest(lang, state, text, i)
            if j is None:
                return stop("error")
            if j < 0:
                break
            state, i = "code", j
        rx = _TOKEN_BRACES if exprs else _TOKEN[lang]
        last = i
        for m in rx.finditer(text, i):
            code.append(text[last : m.start()])
            last = m.end()
            if m.lastgroup is None:
                if lang == "py" and text[m.start()] in "\"'" and _F_PREFIX.search(text, max(0, m.start() - 3), m.start()):
                    if m.group().count("{") != m.group().count("}"):
                        return stop("unsure")
                continue
            if m.lastgroup == "brace":
                if m.group() == "{":
                    exprs[-1] += 1
                elif exprs[-1]:
                    exprs[-1] -= 1
                else:
                    exprs.pop()
                    code.append(_ENDEXPR)
                    state, i = "`", m.end()
                    break
                code.append(m.group())
                continue
            t = m.group()
            if lang == "py" and _F_PREFIX.search(text, max(0, m.start() - 3), m.start()):
                return stop("unsure")
            if lang == "go" and t == "'":
                return stop("error")
            state, i = {"/*": "block"}.get(t, t), m.end()
            break
        else:
            code.append(text[last:])
            break
    return stop(state)


def chunk_summary(lang: str, text: str, first: bool) -> dict[str, tuple[str, str, str]]:
    """The lexer-state map of a chunk; a file's first chunk can only begin in code, any other begins a line."""
    return {s: _run(lang, text if first or s != "code" else "\n" + text, s) for s in (("code",) if first else STATES[lang])}


def combine(a: dict[str, tuple[str, str, str]], b: dict[str, tuple[str, str, str]]) -> dict[str, tuple[str, str, str]]:
    """The map of two neighbouring chunks. Associative; the first of `error` and `unsure` absorbs, and keeps the closing brackets before it."""
    return {s: _then(r, b) for s, r in a.items()}


def _then(r: tuple[str, str, str], b: dict[str, tuple[str, str, str]]) -> tuple[str, str, str]:
    mid, closed, opened = r
    if mid in ("error", "unsure"):
        return r
    if mid not in b:
        return "error", closed, ""
    end, closed2, opened2 = b[mid]
    k = min(len(opened), len(closed2))
    want = opened[len(opened) - k :][::-1].translate(_TO_CLOSE)
    if want != closed2[:k]:
        # a brace that closes a template's expression: the chunk was read as code where it is text
        at = next(i for i in range(k) if want[i] != closed2[i])
        return "unsure" if want[at] == _ENDEXPR and closed2[at] == "}" else "error", closed, ""
    closed += closed2[k:]
    return (end, closed, "") if end in ("error", "unsure") else (end, closed, opened[: len(opened) - k] + opened2)


_WORD_START = {
    "py": re.compile(r"\n\n(?=[A-Za-z_@])(?!(?:else|elif|except|finally|case)\b)"),
    "js": re.compile(r"[;}][ \t]*\n(?:[ \t]*\n)*(?=(?:import|export|const|let|var|function|class|async function|interface|enum)\b)"),
    "go": re.compile(r"\n\n(?=(?:func|type|var|const)\b)"),
    "yaml": re.compile(r"\n(?=---(?:\s|$))"),
    "json": re.compile(r"\n"),
}


def cut_points(text: str, size: int, lang: str = "") -> list[str]:
    """Chunks of at least a size, each but the first beginning a line that, by its first word, begins a statement of the language."""
    out, i = [], 0
    rx = _WORD_START.get(lang) or _WORD_START["json"]
    while i < len(text):
        m = rx.search(text, i + size) if i + size < len(text) else None
        j = m.end() if m else len(text)
        out.append(text[i:j])
        i = j
    return out or [""]


def balanced(summary: dict[str, tuple[str, str, str]]) -> bool | None:
    """Whether a whole file's map leaves nothing open; None if it cannot tell."""
    end, closed, opened = summary["code"]
    return None if end == "unsure" else end == "code" and not closed and not opened


def runs(lang: str, text: str, size: int = CHUNK_CHARS) -> list[str] | None:
    """The balanced runs of statements of a text, by the summaries of its chunks; None if it is not balanced."""
    chunks = cut_points(text, size, lang)
    maps = [chunk_summary(lang, c, i == 0) for i, c in enumerate(chunks)]
    whole = balanced(reduce(combine, maps))
    if whole is None:
        return [text]
    if not whole:
        return None
    out, begin, at, so_far = [], 0, 0, None
    for c, m in zip(chunks, maps):
        so_far = m if so_far is None else combine(so_far, m)
        at += len(c)
        if so_far["code"] == ("code", "", "") and lang != "json":
            out.append(text[begin:at])
            begin = at
    return out + [text[begin:]] if begin < len(text) or not out else out


# ---------------------------------------------------------------- local grammars


def check_python(text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (SyntaxError, ValueError):
        return False
    except (RecursionError, MemoryError):
        return True  # deeper than the interpreter's parser goes: its brackets pair, which is all that is known
    return True


def _no_constant(name: str):
    raise ValueError(name)


_JSON = json.JSONDecoder(parse_constant=_no_constant)


def check_json(text: str) -> bool:
    try:
        _JSON.decode(text)
    except ValueError:
        return False
    except RecursionError:
        return _json_by_levels(text)
    return True


_J_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
_J_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")
_J_AFTER = {"[": "sv[{]", "{": "s}", "a,": "sv[{", "o,": "s", ":": "sv[{"}


def _json_by_levels(text: str) -> bool:
    """Strict JSON of any depth: scalars become one sign, and a stack of brackets tells what may follow."""
    s = re.sub(r"[ \t\r\n]+", "", _J_SCALAR.sub("v", _J_STRING.sub("s", text)))
    stack: list[str] = []
    due, key = "sv[{", False  # what may come next, and whether a key is due
    for c in s:
        if c not in due:
            return False
        if c in "[{":
            stack.append(c)
            due, key = _J_AFTER[c], c == "{"
        elif c == "s" and key:
            due, key = ":", False
        elif c == ":":
            due = _J_AFTER[c]
        elif c == ",":
            due, key = _J_AFTER["a," if stack[-1] == "[" else "o,"], stack[-1] == "{"
        else:
            if c in "]}":
                stack.pop()
            due, key = "" if not stack else ",]" if stack[-1] == "[" else ",}", False
    return not stack and due == ""


_Y_KEY = re.compile(r"""(?:&\S+[ ]+|!\S*[ ]+)*(?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\-?:,\[\]{}#&*!|>'"%@`][^#\n]*?|[?:\-](?=\S)[^#\n]*?|\*\S+|\[[^\]]*\]|\{[^}]*\})[ ]*:(?=[ ]|$)""")
_Y_BLOCK = re.compile(r"(?:&\S+[ ]+|!\S*[ ]+)*[|>](?:[+-]?[1-9]?|[1-9][+-]?)[ ]*(?:#.*)?$")
_Y_PROPS = re.compile(r"(?:(?:&[^\s,\[\]{}]+|![^\s,\[\]{}]*)(?:[ ]+|$))*")
_Y_FLOW = re.compile(r"""\s+|\#[^\n]*|"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[\[\]{},]|:(?=[\s,\[\]{}]|$)|\?(?=\s)|[^\s\[\]{},"'#:][^\n\[\]{},:#]*(?:(?::(?![\s,\[\]{}]|$)|(?<!\s)\#)[^\n\[\]{},:#]*)*|.""", re.S)


class _Bad(Exception):
    pass


class _Yaml:
    """Block structure by indentation, flow collections, scalars over lines, documents."""

    def __init__(self, text: str):
        self.lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.i = 0

    def skip(self) -> None:
        while self.i < len(self.lines):
            s = self.lines[self.i].strip(" \t")
            if s and not s.startswith("#"):
                if self.lines[self.i][: len(self.lines[self.i]) - len(self.lines[self.i].lstrip(" \t"))].find("\t") >= 0:
                    raise _Bad
                return
            self.i += 1

    def look(self) -> tuple[int, str] | None:
        self.skip()
        if self.i >= len(self.lines):
            return None
        line = self.lines[self.i]
        body = line.lstrip(" ")
        return len(line) - len(body), body.rstrip(" \t")

    def stream(self) -> None:
        while (at := self.look()) is not None and at[1].startswith("%"):
            self.i += 1
        while (at := self.look()) is not None:
            indent, body = at
            if indent == 0 and (body == "---" or body.startswith("--- ")):
                rest = body[3:].strip()
                if not rest or rest.startswith("#"):
                    self.i += 1
                else:
                    self.lines[self.i] = "    " + rest
                if (nxt := self.look()) is not None and not self._marker(nxt):
                    self.node(-1)
            elif indent == 0 and body.split(" ")[0] == "...":
                self.i += 1
                while (at := self.look()) is not None and at[1].startswith("%"):
                    self.i += 1
            else:
                self.node(-1)
            if (nxt := self.look()) is not None and not self._marker(nxt):
                raise _Bad

    @staticmethod
    def _marker(at: tuple[int, str]) -> bool:
        return at[0] == 0 and (at[1] in ("---", "...") or at[1].startswith(("--- ", "... ")))

    def node(self, parent: int) -> None:
        """A block node indented deeper than its parent."""
        at = self.look()
        if at is None or at[0] <= parent or self._marker(at):
            return
        indent, body = at
        if body == "-" or body.startswith("- "):
            self.sequence(indent)
        elif body == "?" or body.startswith("? ") or _Y_KEY.match(body):
            self.mapping(indent)
        else:
            props = _Y_PROPS.match(body).end()
            if props == len(body) and props:
                self.i += 1
                return self.node(parent)
            self.scalar(indent, body, parent, self.i)

    def sequence(self, indent: int) -> None:
        while (at := self.look()) is not None and at[0] == indent and (at[1] == "-" or at[1].startswith("- ")) and not self._marker(at):
            rest = at[1][1:]
            inner = rest.lstrip(" ")
            if not inner or inner.startswith("#"):
                self.i += 1
                self.node(indent)
            else:
                if "\t" in rest[: len(rest) - len(inner)]:
                    raise _Bad
                self.lines[self.i] = " " * (indent + 1 + len(rest) - len(inner)) + inner
                self.value(inner, indent, indent + 1 + len(rest) - len(inner))
        self._settled(indent)

    def _settled(self, indent: int) -> None:
        at = self.look()
        if at is not None and at[0] > indent:
            raise _Bad

    def mapping(self, indent: int) -> None:
        seen: set[str] = set()
        while (at := self.look()) is not None and at[0] == indent and not self._marker(at):
            body = at[1]
            if body == "-" or body.startswith("- "):
                break
            if body == "?" or body.startswith("? "):
                self.lines[self.i] = " " * (indent + 1) + body[1:]
                seen.add("?")
                self.node(indent)
                continue
            if body.startswith(": ") and seen:
                self.lines[self.i] = " " * (indent + 1) + body[1:]
                self.node(indent)
                continue
            m = _Y_KEY.match(body)
            if m is None:
                raise _Bad
            seen.add(m.group())
            rest = body[m.end() :].lstrip(" ")
            rest = "" if rest.startswith("#") else rest
            if not rest or (p := _Y_PROPS.match(rest).end()) and (p >= len(rest) or rest[p:].startswith("#")):
                self.i += 1
                nxt = self.look()
                if nxt is not None and nxt[0] == indent and (nxt[1] == "-" or nxt[1].startswith("- ")) and not self._marker(nxt):
                    self.sequence(indent)
                else:
                    self.node(indent)
            else:
                self.inline(rest, indent)
        self._settled(indent)

    def value(self, text: str, parent: int, column: int) -> None:
        """What follows a dash on its line."""
        if text == "-" or text.startswith("- "):
            self.sequence(column)
        elif text.startswith("? ") or _Y_KEY.match(text):
            self.mapping(column)
        else:
            self.inline(text, parent)

    def inline(self, text: str, parent: int) -> None:
        """A scalar or flow collection that begins on the line of its key or dash."""
        if _Y_BLOCK.match(text):
            self.i += 1
            self._block_text(parent)
            return
        self.scalar(parent + 1, text, parent, self.i)

    def _block_text(self, parent: int) -> None:
        while self.i < len(self.lines):
            line = self.lines[self.i]
            if line.strip() and len(line) - len(line.lstrip(" ")) <= parent:
                return
            self.i += 1

    def scalar(self, indent: int, body: str, parent: int, start: int) -> None:
        body = body[_Y_PROPS.match(body).end() :]
        if _Y_BLOCK.match(body):
            self.i += 1
            return self._block_text(parent)
        c = body[:1]
        if c in "\"'":
            self._quoted(body, c, parent)
        elif c in "[{":
            self._flow(body, parent)
        elif c == "*":
            if not re.fullmatch(r"\*[^\s,\[\]{}]+(?:\s+#.*)?", body):
                raise _Bad
            self.i += 1
        else:
            if not c or c in "]},%@`&!" or c in "-?:" and len(body) > 1 and body[1] == " " or c in "|>":
                raise _Bad
            self._plain(body, parent)

    def _plain(self, body: str, parent: int) -> None:
        cut = re.search(r"\s#", body)
        if re.search(r":(?:\s|$)", body if cut is None else body[: cut.start()]):
            raise _Bad
        self.i += 1
        while cut is None and (at := self.look_raw()) is not None and at[0] > parent and not self._marker(at):
            if at[1].startswith("#"):
                break
            if re.search(r":(?:\s|$)", re.split(r"\s#", at[1])[0]):
                raise _Bad
            cut = re.search(r"\s#", at[1])
            self.i += 1

    def look_raw(self) -> tuple[int, str] | None:
        j = self.i
        while j < len(self.lines) and not self.lines[j].strip():
            j += 1
        if j >= len(self.lines):
            return None
        body = self.lines[j].lstrip(" ")
        if self.lines[j].strip().startswith("#"):
            return None
        self.i = j
        return len(self.lines[j]) - len(body), body.rstrip()

    def _quoted(self, body: str, quote: str, parent: int) -> None:
        rx = re.compile(r'"(?:[^"\\]|\\.)*"' if quote == '"' else r"'(?:[^']|'')*'", re.S)
        text = body
        while (m := rx.match(text)) is None:
            self.i += 1
            if self.i >= len(self.lines):
                raise _Bad
            line = self.lines[self.i]
            if line.strip() and len(line) - len(line.lstrip(" ")) <= parent:
                raise _Bad
            text += "\n" + line.strip()
        if quote == '"' and re.search(r"(?<!\\)(?:\\\\)*\\[^0abt\tnvfre \"/\\N_LPxuU\n]", m.group()):
            raise _Bad
        self._tail(text[m.end() :])

    def _tail(self, rest: str) -> None:
        if rest.strip() and not re.match(r"\s+#", rest):
            raise _Bad
        self.i += 1

    def _flow(self, body: str, parent: int) -> None:
        text, depth = body, None
        while True:
            end = self._flow_end(text)
            if end is not None:
                break
            self.i += 1
            if self.i >= len(self.lines):
                raise _Bad
            line = self.lines[self.i]
            if line.strip() and (len(line) - len(line.lstrip(" ")) <= parent and line.strip()[0] not in "]}" or self._marker((0, line))):
                raise _Bad
            text += "\n" + line.strip()
        self._tail(text[end:])

    @staticmethod
    def _flow_end(text: str) -> int | None:
        """The end of a flow collection; None if it goes on; an exception if it cannot be one."""
        stack: list[str] = []
        need = False  # a comma is due before the next entry
        colon = False
        last = ""
        for m in _Y_FLOW.finditer(text):
            t = m.group()
            if t.isspace() or t[0] == "#" and (m.start() == 0 or text[m.start() - 1].isspace()):
                continue
            if t in ("[", "{"):
                if need:
                    raise _Bad
                stack.append(t)
                need = False
            elif t in ("]", "}"):
                if not stack or stack.pop() != ("[" if t == "]" else "{"):
                    raise _Bad
                if not stack:
                    return m.end()
                need = True
            elif t == ",":
                if last in (",", "[", "{", ""):
                    raise _Bad
                need = False
            elif t == ":":
                need = False
            elif t == "?":
                pass
            elif len(t) == 1 and t in "\"'" :
                return None  # a quoted scalar that goes on
            else:
                if need and last not in (":",):
                    if t[0] in "\"'" or last[:1] in "\"']}":
                        raise _Bad
                if t[0] in "%@`|>&!*" and t[0] in "%@`":
                    raise _Bad
                need = True
            last = t
        return None


def check_yaml(text: str) -> bool:
    """Whether a text is a YAML stream."""
    if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", text):
        return False
    limit = sys.getrecursionlimit()
    try:
        # a level takes no more than a few calls
        sys.setrecursionlimit(max(limit, 1_000 + 8 * (text.count("\n") + len(text) // 2)))
        _Yaml(text.lstrip("﻿")).stream()
    except _Bad:
        return False
    finally:
        sys.setrecursionlimit(limit)
    return True


_CHECKS = {".py": check_python, ".json": check_json, ".yaml": check_yaml, ".js": lambda t: check_js(t, False), ".ts": lambda t: check_js(t, True), ".go": check_go}
_LANGUAGE = {".js": "js", ".ts": "js", ".go": "go", ".py": "py", ".json": "json", ".yaml": "yaml"}


def extension(path: str | None) -> str:
    name = (path or "").rsplit("/", 1)[-1]
    return name[name.rfind(".") :].lower() if "." in name else ""


def parses(text: str, path: str, chunk_chars: int = CHUNK_CHARS) -> bool | None:
    """The verdict on a file; None for languages that are not checked."""
    ext = extension(path)
    check = _CHECKS.get(ext)
    if check is None:
        return None
    if "\r" in text and ext != ".json":
        text = text.replace("\r\n", "\n") if ext == ".go" else text.replace("\r\n", "\n").replace("\r", "\n")
    if text.startswith("#!") and ext in (".js", ".ts"):
        text = "//" + text[2:]
    parts = runs(_LANGUAGE[ext], text, chunk_chars)
    if parts is None:
        return False
    held = ""
    for i, part in enumerate(parts):
        # a run that is none by itself (a decorator, say) is read with the next one
        part = held + ("package p\n" if ext == ".go" and i and not held else "") + part
        if check(part):
            held = ""
        elif held or i == len(parts) - 1:
            return False
        else:
            held = part
    return not held


# ---------------------------------------------------------------- the operator


def unparsable(df: DataFrame, key: str = "file_id", path: str = "file_path", text: str = "content", chunk_chars: int = CHUNK_CHARS, carry: str = "") -> DataFrame:
    """(key, carry..., valid) of every file in a checked language, each key once.

    An empty text is valid but for JSON and Go; a null text or path gives no row. `carry` names further columns with
    their types, such as "repo string, lang string". The chunk size changes no verdict.
    """
    extra = [c.split()[0] for c in carry.split(",") if c.strip()]
    known = df.where(F.lower(F.col(path)).rlike(r"\.(py|js|ts|go|json|yaml)$") & F.col(text).isNotNull())
    schema = ", ".join(x for x in (f"{key} bigint", carry, "valid boolean") if x.strip())
    return arrow_rows(known, [key, *extra, path, text], schema, lambda k, *r: [(k, *r[:-2], parses(r[-1], r[-2], chunk_chars))]).dropDuplicates([key])


def found(df: DataFrame) -> DataFrame:
    return unparsable(spread(df)).where("not valid").select("file_id")
