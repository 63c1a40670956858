"""Local grammars over token-class strings, for JavaScript, TypeScript and Go.

A file is lexed into one character per token; brackets nest it into levels, and a level is a flat string in which each
bracket group is one character (P for round, B for square, C for curly). A local grammar decides a level's string by
itself and tells in which role each of its groups stands; the groups are then decided likewise. Levels repeat heavily,
so verdicts are kept in a bounded cache, and most of a file is decided by look-ups.
"""

from __future__ import annotations

import re
from functools import lru_cache

# token classes: i identifier, n number, \x01 string, \x02 regular expression, N line end; the rest is set below
STR, REX, BAD = "\x01", "\x02", "\x00"


class Fail(Exception):
    """The level does not parse."""


class Cursor:
    """A level's string, a position in it, and the roles given to its groups."""

    __slots__ = ("s", "i", "n", "roles", "ts", "depth")

    def __init__(self, s: str, ts: bool = False):
        self.s, self.i, self.n, self.roles, self.ts, self.depth = s + "\n", 0, len(s), {}, ts, 0

    def peek(self) -> str:
        return self.s[self.i]

    def at(self, chars: str) -> bool:
        return self.i < self.n and self.s[self.i] in chars

    def take(self, chars: str) -> bool:
        if self.i < self.n and self.s[self.i] in chars:
            self.i += 1
            return True
        return False

    def need(self, chars: str) -> None:
        if not self.take(chars):
            raise Fail

    def group(self, kind: str, role: str) -> bool:
        if self.i < self.n and self.s[self.i] == kind:
            self.roles[self.i] = role
            self.i += 1
            return True
        return False

    def need_group(self, kind: str, role: str) -> None:
        if not self.group(kind, role):
            raise Fail

    def skip(self) -> bool:
        """Skip line ends."""
        j = self.i
        while self.s[self.i] == "N":
            self.i += 1
        return self.i > j

    def end(self) -> bool:
        return self.i >= self.n


# ---------------------------------------------------------------- JavaScript and TypeScript

_JS_KEYWORDS = {
    # reserved words
    "if": "q", "else": "e", "for": "f", "while": "w", "do": "d", "return": "r", "throw": "h", "break": "b", "continue": "k",
    "switch": "s", "case": "c", "default": "D", "function": "F", "class": "L", "extends": "x", "var": "v", "const": "V", "let": "l",
    "new": "W", "try": "t", "catch": "a", "finally": "y", "import": "m", "export": "X", "in": "j", "instanceof": "J",
    "typeof": "u", "void": "u", "delete": "u", "this": "g", "super": "g", "null": "g", "true": "g", "false": "g", "debugger": "G", "with": "H", "enum": "E",
    # contextual words: identifiers wherever the grammar has no use for them
    "async": "Y", "await": "U", "yield": "z", "of": "o", "as": "A", "satisfies": "A", "from": "M", "get": "T", "set": "T", "static": "S",
    "type": "Q", "interface": "I", "namespace": "K", "module": "K", "declare": "R", "abstract": "R", "public": "p", "private": "p", "protected": "p",
    "readonly": "p", "override": "p", "implements": "Z", "keyof": "O", "infer": "O", "unique": "O", "is": "1", "asserts": "O",
}
_JS_WORDISH = "iYUoAMTSQIKRpZO1zl"  # usable as identifiers
_JS_NAME = _JS_WORDISH + "qefwdrhbkscDFLxvVWtaymXjJugGHE"  # usable as property names
_JS_OPS = {
    "=>": "\x03", "...": "\x04", "?.": ".", "++": "\x05", "--": "\x05", "=": "=", "!": "!", "~": "!", "+": "+", "-": "+", "*": "*",
    "<": "<", ">": ">", "?": "?", ":": ":", ",": ",", ";": ";", ".": ".", "@": "@", "|": "|", "&": "&",
}
_ASSIGN_OP, _BIN = "=", "%"
# names that cannot be keywords, replaced without a call; then all other words, numbers and operators of several characters
_PLAIN_NAME = re.compile(r"(?<![\w$])[$_A-Za-z][$\w]*?[$_A-Z\d][$\w]*")
_JS_ONE = re.compile(
    r"[$_A-Za-zª-￿#][$\w]*|\d(?:[eE][+-](?=\d)|[\w.])*|\.\d(?:[eE][+-](?=\d)|[\w.])*|\.\.\.|\??\.[ \t]*#?[$_A-Za-zª-￿][$\w]*|\?\.|=>|\+\+|--|>>>=|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|[+\-*/%&|^]=|===|!==|==|!=|<=|>=(?!=)|\*\*|&&|\|\||\?\?"
)
_NUMBER = re.compile(r"0[xX][\da-fA-F](?:_?[\da-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?|\d+n")
# a regular expression where an operand is due
JS_REGEX = r"/(?:(?<=[(,=:\[!&|?{};\n+\-*%~^>]/)|(?<=[(,=:\[!&|?{};\n+\-*%~^>]\s/)|(?<=return /)|(?<=typeof /)|(?<=case /))(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
# comments, strings, templates, regular expressions where an operand is due, and openings without an end
_JS_TEXT = re.compile(
    r"""//[^\n]*|/\*.*?\*/|/\*|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\$]|\\.|\$(?!\{)|\$\{[^{}`]*\})*`|""" + JS_REGEX + r"""|"|'|`""",
    re.S,
)


def _js_text(m: re.Match) -> str:
    text = m.group()
    c = text[0]
    if c == "/":
        if text[1:2] == "/":
            return " "
        if text[1:2] == "*":
            return BAD if text == "/*" else "\n" if "\n" in text else " "
        return REX
    if len(text) == 1:
        return BAD
    if c == "`" and "${" in text:
        for e in re.findall(r"(?<!\\)\$\{([^{}`]*)\}", text):
            if not re.fullmatch(r"[A-Za-z_$][\w$.]*", e) and not _expression_ok(e):
                return BAD
    return STR


_JS_BRACES = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|""" + JS_REGEX + r"""|(?P<sign>[{}`])""", re.S)
_TEMPLATE_TEXT = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)


def _plain_templates(text: str) -> str | None:
    """The text with templates whose expressions hold braces or templates replaced by strings; None if such an expression is none."""
    out, last, i, begin = [], 0, 0, 0
    open_: list[list[int]] = []  # for each template that is open: where its expression begins, and the depth of braces in it
    nested = False
    while True:
        m = _JS_BRACES.search(text, i)
        while m is not None and m["sign"] is None or m is not None and m["sign"] != "`" and not open_:
            m = _JS_BRACES.search(text, m.end())
        if m is None:
            return "".join(out) + text[last:]
        i = m.end()
        if m["sign"] == "{":
            open_[-1][1] += 1
            nested = True
            continue
        if m["sign"] == "}" and open_[-1][1]:
            open_[-1][1] -= 1
            continue
        if m["sign"] == "}":  # the end of an expression
            at = open_.pop()[0]
            if not open_ and nested and not _expression_ok(text[at : m.start()]):
                return None
        elif not open_:
            begin, nested = m.start(), False
        else:
            nested = True
        i = _TEMPLATE_TEXT.match(text, i).end()
        if i >= len(text) or text[i] == "\\":
            return "".join(out) + text[last:]
        if text.startswith("${", i):
            open_.append([i + 2, 0])
            i += 2
            continue
        i += 1
        if not open_ and nested:
            out += [text[last:begin], '""']
            last = i


@lru_cache(maxsize=20_000)
def _expression_ok(code: str) -> bool:
    return check_js("(" + code + ")", False)


@lru_cache(maxsize=50_000)
def _number_ok(text: str) -> bool:
    return bool(_NUMBER.fullmatch(text)) and not re.match(r"0\d*[89]\d*[._]", text)


def _js_token(m: re.Match) -> str:
    text = m.group()
    c = _JS_KEYWORDS.get(text)
    if c is not None:
        return c
    first = text[0]
    if first.isalpha() or first in "$_":
        return "i"
    if first == "#":
        return "i" if len(text) > 1 else BAD
    if first.isdigit() or first == "." and text[1:2].isdigit():
        return "n" if _number_ok(text) else BAD
    c = _JS_OPS.get(text)
    if c is not None:
        return c
    if first == "." or text.startswith("?."):
        return ".i"
    if text[-1] == "=" and text not in ("==", "===", "!=", "!==", "<=", ">="):
        return _ASSIGN_OP
    return _BIN


def lex_js(text: str) -> str | None:
    """The token classes of a source text, or None if a token is broken."""
    if text.startswith("#!"):
        text = "//" + text[2:]
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "${" in text and (text := _plain_templates(text)) is None:
        return None
    s = _JS_ONE.sub(_js_token, _PLAIN_NAME.sub("i", _JS_TEXT.sub(_js_text, text)))
    for old, new in _JS_PLAIN:
        if old in s:
            s = s.replace(old, new)
    s = re.sub(r"\n+", "N", s)
    return None if BAD in s or _JS_STRAY.search(s) else s


_JS_PLAIN = ((" ", ""), ("\t", ""), ("\f", ""), ("\v", ""), (" ", ""), ("﻿", ""), ("/", "%"), ("^", "%"), ("-", "+"), ("~", "!"))
_JS_STRAY = re.compile(r"[\\`\"'#]")
_BRACKET = re.compile(r"[()\[\]{}]")
_KIND = {"(": "P", "[": "B", "{": "C"}
_MATCH = {")": "(", "]": "[", "}": "{"}


def nest(s: str):
    """The tree of levels (string, groups in order), or None if the brackets do not pair."""
    stack: list[tuple[str, list[str], list]] = []
    pieces: list[str] = []
    children: list = []
    last = 0
    for m in _BRACKET.finditer(s):
        c, p = m.group(), m.start()
        pieces.append(s[last:p])
        last = p + 1
        if c in _KIND:
            stack.append((c, pieces, children))
            pieces, children = [], []
        else:
            if not stack or stack[-1][0] != _MATCH[c]:
                return None
            node = ("".join(pieces), children)
            c, pieces, children = stack.pop()
            pieces.append(_KIND[c])
            children.append(node)
    if stack:
        return None
    pieces.append(s[last:])
    return "".join(pieces), children


def js_type(c: Cursor) -> None:
    c.take("|&")
    while True:
        _js_type_one(c)
        if c.at("|&"):
            c.i += 1
            continue
        if c.at("x"):  # conditional
            c.i += 1
            js_type(c)
            c.need("?")
            js_type(c)
            c.need(":")
            continue
        if c.at("1"):
            c.i += 1
            continue
        return


def _js_type_one(c: Cursor) -> None:
    while c.at("OpSuR") and c.i + 1 < c.n and c.s[c.i + 1] in "ig\x01BCP" + _JS_WORDISH:
        c.i += 1
    if c.take("W"):
        c.need_group("P", "params")
        c.need("\x03")
        return js_type(c)
    if c.at("<"):
        _js_angle(c)
    if c.at("P"):
        if c.i + 1 < c.n and c.s[c.i + 1] == "\x03":
            c.group("P", "params")
            c.i += 1
            return js_type(c)
        c.group("P", "type")
    elif c.at("C"):
        c.group("C", "members")
    elif c.at("B"):
        c.group("B", "types")
    elif c.take("m"):
        c.need_group("P", "args")
        while c.take("."):
            c.need(_JS_NAME)
        if c.at("<"):
            _js_angle(c)
    elif c.take("+"):
        c.need("n")
    elif c.take(_JS_WORDISH + "gun" + STR):
        while c.take("."):
            c.need(_JS_NAME)
        if c.at("<"):
            _js_angle(c)
    else:
        raise Fail
    while c.at("B"):
        c.group("B", "type?")


def _js_angle(c: Cursor) -> None:
    c.need("<")
    while not c.at(">"):
        if c.at(_JS_WORDISH) and c.s[c.i + 1] == "x":  # a parameter with its bound
            c.i += 2
        js_type(c)
        if c.take("="):
            js_type(c)
        if not c.take(","):
            break
    c.need(">")


def _js_try_angle(c: Cursor) -> bool:
    """Type arguments before a call, if they are such."""
    save, roles = c.i, dict(c.roles)
    try:
        _js_angle(c)
        if c.at("P" + STR):
            return True
    except Fail:
        pass
    c.i, c.roles = save, roles
    return False


def js_expr(c: Cursor, no_in: bool = False) -> None:
    js_assign(c, no_in)
    while True:
        save = c.i
        c.skip()
        if not c.take(","):
            c.i = save
            return
        c.skip()
        js_assign(c, no_in)


def js_assign(c: Cursor, no_in: bool = False) -> None:
    c.skip()
    c.depth += 1
    if c.depth > 150:
        raise RecursionError
    try:
        if c.at("z"):
            nxt = c.s[c.i + 1] if c.i + 1 < c.n else ";"
            if nxt not in ".=,;)\x03:%":
                c.i += 1
                c.take("*")
                if not c.end() and not c.at(";N,"):
                    js_assign(c, no_in)
                return
        if c.at("Y") and c.i + 1 < c.n:
            nxt = c.s[c.i + 1]
            if nxt == "P" and c.s[c.i + 2] == "\x03" or nxt in _JS_WORDISH and c.s[c.i + 2] == "\x03":
                c.i += 1
            elif nxt == "P" and c.ts and _ts_arrow_ahead(c, c.i + 1):
                c.i += 1
            elif nxt == "<":
                c.i += 1
        if c.at("<") and c.ts:
            _js_angle(c)
        if c.at(_JS_WORDISH) and c.s[c.i + 1] == "\x03":
            c.i += 2
            return _js_arrow_body(c, no_in)
        if c.at("P"):
            if c.s[c.i + 1] == "\x03":
                c.group("P", "params")
                c.i += 1
                return _js_arrow_body(c, no_in)
            if c.s[c.i + 1] == ":" and c.ts and _ts_arrow_ahead(c, c.i):
                c.group("P", "params")
                c.i += 1
                js_type(c)
                c.need("\x03")
                return _js_arrow_body(c, no_in)
        js_unary(c)
        while True:
            save = c.i
            c.skip()
            if c.take("%*|&"):
                pass
            elif c.at("+"):
                c.i += 1
            elif c.at("<"):
                c.i += 1
                c.take("<")
                c.take("=")
            elif c.at(">"):
                c.i += 1
                c.take(">") and c.take(">")
                c.take("=")
            elif c.at("J"):
                c.i += 1
            elif c.at("j") and not no_in:
                c.i += 1
            elif c.at("A") and c.i == save:
                c.i += 1
                if c.take("V"):
                    continue
                js_type(c)
                continue
            elif c.at("?"):
                c.i += 1
                js_assign(c)
                c.skip()
                c.need(":")
                js_assign(c, no_in)
                return
            elif c.at("="):
                c.i += 1
                js_assign(c, no_in)
                return
            else:
                c.i = save
                return
            js_unary(c)
    finally:
        c.depth -= 1


def _ts_arrow_ahead(c: Cursor, at: int) -> bool:
    if c.s[at + 1] == "\x03":
        return True
    if c.s[at + 1] != ":":
        return False
    probe = Cursor(c.s[:-1], True)
    probe.i = at + 2
    try:
        js_type(probe)
    except Fail:
        return False
    return probe.at("\x03")


def _js_arrow_body(c: Cursor, no_in: bool) -> None:
    c.skip()
    if not c.group("C", "block"):
        js_assign(c, no_in)


def js_unary(c: Cursor) -> None:
    c.skip()
    while True:
        if c.take("!+u\x05"):
            c.skip()
        elif c.at("U") and c.i + 1 < c.n and c.s[c.i + 1] not in ".=,;)\x03:%N?*<>&|":
            c.i += 1
        else:
            break
    js_postfix(c)


def js_postfix(c: Cursor) -> None:
    if c.take("W"):
        if c.take("."):
            c.need(_JS_NAME)
        else:
            while c.take("W"):
                pass
            _js_primary(c)
            while c.at(".B"):
                if c.take("."):
                    c.need(_JS_NAME)
                else:
                    c.group("B", "index")
            if c.at("<") and c.ts:
                _js_try_angle(c)
            c.group("P", "args")
    else:
        _js_primary(c)
    while True:
        save = c.i
        lines = c.skip()
        if c.take("."):
            if c.group("P", "args") or c.group("B", "index"):
                continue
            if c.at(STR):
                raise Fail
            c.skip()
            c.need(_JS_NAME)
        elif c.at("P"):
            c.group("P", "args")
        elif c.at("B"):
            c.group("B", "index")
        elif c.at(STR) and not lines and c.s[c.i - 1] in "iPB.g":
            c.i += 1  # tagged template
        elif c.at("\x05") and not lines:
            c.i += 1
            return
        elif c.at("!") and not lines and c.ts:
            c.i += 1
        elif c.at("<") and c.ts and _js_try_angle(c):
            continue
        else:
            c.i = save
            return


def _js_primary(c: Cursor) -> None:
    c.skip()
    if c.at("Y") and c.s[c.i + 1] == "F":
        c.i += 1
    if c.at("F"):
        c.i += 1
        c.take("*")
        c.take(_JS_WORDISH)
        _js_function_rest(c)
    elif c.at("L"):
        _js_class(c)
    elif c.at("@"):
        while c.at("@"):
            _js_decorator(c)
        _js_class(c)
    elif c.at("P"):
        c.group("P", "paren")
    elif c.at("B"):
        c.group("B", "items")
    elif c.at("C"):
        c.group("C", "obj")
    elif c.take("m"):  # import(...) and import.meta
        if not c.group("P", "args"):
            c.need(".")
            c.need(_JS_NAME)
    elif c.take(_JS_WORDISH + "gn" + STR + REX):
        pass
    else:
        raise Fail


def _js_function_rest(c: Cursor, body: bool = True) -> None:
    if c.at("<") and c.ts:
        _js_angle(c)
    c.skip()
    c.need_group("P", "params")
    if c.ts and c.take(":"):
        js_type(c)
    save = c.i
    c.skip()
    if not c.group("C", "block"):
        c.i = save
        if body:
            raise Fail


def _js_class(c: Cursor) -> None:
    c.need("L")
    if not c.at("xZC"):
        c.need(_JS_WORDISH)
    if c.at("<") and c.ts:
        _js_angle(c)
    if c.take("x"):
        js_postfix(c) if not c.ts else _ts_heritage(c)
    if c.ts and c.take("Z"):
        js_type(c)
        while c.take(","):
            js_type(c)
    c.skip()
    c.need_group("C", "class")


def _ts_heritage(c: Cursor) -> None:
    c.need(_JS_WORDISH + "g")
    while c.at(".P<"):
        if c.take("."):
            c.need(_JS_NAME)
        elif c.at("P"):
            c.group("P", "args")
        else:
            _js_angle(c)


def _js_decorator(c: Cursor) -> None:
    c.need("@")
    if not c.group("P", "paren"):
        c.need(_JS_WORDISH)
        while c.take("."):
            c.need(_JS_NAME)
        c.group("P", "args")
    c.skip()


def _js_target(c: Cursor) -> None:
    if c.group("C", "pattern") or c.group("B", "pitems"):
        return
    c.need(_JS_WORDISH)


def _js_var(c: Cursor, no_in: bool = False, need_init: bool = False) -> None:
    while True:
        c.skip()
        pattern = c.at("CB")
        _js_target(c)
        if c.ts:
            c.take("!")
            if c.take(":"):
                js_type(c)
        save = c.i
        c.skip()
        if c.take("="):
            js_assign(c, no_in)
        else:
            c.i = save
            if (need_init or pattern) and not no_in:
                raise Fail
        save = c.i
        c.skip()
        if not c.take(","):
            c.i = save
            return


def _js_close(c: Cursor) -> None:
    """The end of a statement: a semicolon, a line end, or the end of the level."""
    if c.take(";") or c.end() or c.at("N"):
        return
    raise Fail


def js_statement(c: Cursor) -> None:
    c.skip()
    ch = c.peek()
    if ch == ";":
        c.i += 1
    elif ch == "C":
        c.group("C", "block")
    elif ch in "vV" or ch == "l" and c.s[c.i + 1] in _JS_WORDISH + "CB":
        c.i += 1
        if ch == "V" and c.ts and c.at("E"):
            return js_statement(c)
        _js_var(c, need_init=ch == "V" and not c.ts)
        _js_close(c)
    elif ch == "q" or ch == "w" or ch == "H":
        c.i += 1
        c.skip()
        c.need_group("P", "cond")
        js_statement(c)
        if ch == "q":
            save = c.i
            c.skip()
            if c.take("e"):
                js_statement(c)
            else:
                c.i = save
    elif ch == "f":
        c.i += 1
        c.take("U")
        c.skip()
        c.need_group("P", "for")
        js_statement(c)
    elif ch == "d":
        c.i += 1
        js_statement(c)
        c.skip()
        c.need("w")
        c.skip()
        c.need_group("P", "cond")
        c.take(";")
    elif ch == "r":
        c.i += 1
        if not (c.end() or c.at(";N")):
            js_expr(c)
        _js_close(c)
    elif ch == "h":
        c.i += 1
        if c.at("N"):
            raise Fail
        js_expr(c)
        _js_close(c)
    elif ch in "bk":
        c.i += 1
        c.take(_JS_WORDISH)
        _js_close(c)
    elif ch == "G":
        c.i += 1
        _js_close(c)
    elif ch == "s":
        c.i += 1
        c.need_group("P", "cond")
        c.skip()
        c.need_group("C", "switch")
    elif ch == "t":
        c.i += 1
        c.skip()
        c.need_group("C", "block")
        c.skip()
        ok = False
        if c.take("a"):
            ok = True
            c.group("P", "params")
            c.skip()
            c.need_group("C", "block")
        save = c.i
        c.skip()
        if c.take("y"):
            ok = True
            c.skip()
            c.need_group("C", "block")
        else:
            c.i = save
        if not ok:
            raise Fail
    elif ch == "F" or ch == "Y" and c.s[c.i + 1] == "F":
        c.take("Y")
        c.i += 1
        c.take("*")
        c.need(_JS_WORDISH)
        _js_function_rest(c, body=not c.ts)
        c.take(";")
    elif ch == "L":
        _js_class(c)
        c.take(";")
    elif ch == "@":
        while c.at("@"):
            _js_decorator(c)
        js_statement(c)
    elif ch == "m" and c.s[c.i + 1] not in "P.":
        _js_import(c)
    elif ch == "X":
        _js_export(c)
    elif c.ts and ch == "E":
        c.i += 1
        c.need(_JS_WORDISH)
        c.need_group("C", "enum")
    elif c.ts and ch == "I" and c.s[c.i + 1] in _JS_WORDISH:
        c.i += 2
        if c.at("<"):
            _js_angle(c)
        if c.take("x"):
            js_type(c)
            while c.take(","):
                js_type(c)
        c.skip()
        c.need_group("C", "members")
    elif c.ts and ch == "Q" and c.s[c.i + 1] in _JS_WORDISH:
        c.i += 2
        if c.at("<"):
            _js_angle(c)
        c.need("=")
        c.skip()
        _ts_type_lines(c)
        _js_close(c)
    elif c.ts and ch == "K" and c.s[c.i + 1] in _JS_WORDISH + STR:
        c.i += 2
        while c.take("."):
            c.need(_JS_NAME)
        if not c.group("C", "block"):
            _js_close(c)
    elif c.ts and ch == "R" and c.s[c.i + 1] in "vVlFLEIQKYRS" + _JS_WORDISH:
        c.i += 1
        if c.at("i") and c.s[c.i + 1] == "C":
            c.i += 1
            c.group("C", "block")
        else:
            js_statement(c)
    elif ch in _JS_WORDISH and c.s[c.i + 1] == ":":
        c.i += 2
        js_statement(c)
    elif ch in "cD":
        raise Fail
    else:
        js_expr(c)
        _js_close(c)


def _ts_type_lines(c: Cursor) -> None:
    """A type that may go on over lines."""
    c.take("|&")
    while True:
        c.skip()
        js_type(c)
        save = c.i
        c.skip()
        if not c.take("|&"):
            c.i = save
            return


def _js_import(c: Cursor) -> None:
    c.need("m")
    if c.take(STR):
        return _js_close(c)
    if c.at("Q") and c.s[c.i + 1] not in "M,=":
        c.i += 1
    if c.take("*"):
        c.need("A")
        c.need(_JS_WORDISH)
    elif c.group("C", "names"):
        pass
    else:
        c.need(_JS_WORDISH)
        if c.ts and c.take("="):
            js_expr(c)
            return _js_close(c)
        if c.take(","):
            if c.take("*"):
                c.need("A")
                c.need(_JS_WORDISH)
            else:
                c.need_group("C", "names")
    c.skip()
    c.need("M")
    c.need(STR)
    if c.at("H"):
        c.i += 1
        c.need_group("C", "obj")
    _js_close(c)


def _js_export(c: Cursor) -> None:
    c.need("X")
    if c.take("D"):
        if c.at("F") or c.at("Y") and c.s[c.i + 1] == "F":
            c.take("Y")
            c.i += 1
            c.take("*")
            c.take(_JS_WORDISH)
            _js_function_rest(c, body=not c.ts)
            c.take(";")
        elif c.at("L"):
            _js_class(c)
        elif c.ts and c.at("RI"):
            js_statement(c)
        else:
            js_assign(c)
            _js_close(c)
    elif c.take("*"):
        if c.take("A"):
            c.need(_JS_NAME + STR)
        c.need("M")
        c.need(STR)
        _js_close(c)
    elif c.at("C") or c.at("Q") and c.s[c.i + 1] == "C":
        c.take("Q")
        c.group("C", "names")
        if c.take("M"):
            c.need(STR)
        _js_close(c)
    elif c.ts and c.take("="):
        js_expr(c)
        _js_close(c)
    elif c.at("vVlFLYEIQKR@"):
        js_statement(c)
    else:
        raise Fail


def _js_statements(c: Cursor) -> None:
    while True:
        c.skip()
        if c.end():
            return
        js_statement(c)


def _js_switch(c: Cursor) -> None:
    c.skip()
    while not c.end():
        if c.take("c"):
            js_expr(c)
        else:
            c.need("D")
        c.skip()
        c.need(":")
        while True:
            c.skip()
            if c.end() or c.at("cD"):
                break
            js_statement(c)


def _js_member(c: Cursor) -> None:
    """One class member."""
    if c.take(";"):
        return
    while c.at("@"):
        _js_decorator(c)
    if c.at("S") and c.s[c.i + 1] == "C":
        c.i += 1
        c.group("C", "block")
        return
    while c.at("SYTpRl") and c.s[c.i + 1] in _JS_NAME + "B*#n" + STR:
        c.i += 1
    c.take("*")
    if c.group("B", "type?" if c.ts else "index"):
        if c.ts and c.roles[c.i - 1] == "type?":
            c.roles[c.i - 1] = "key"
    else:
        c.need(_JS_NAME + "n" + STR)
    if c.ts:
        c.take("?!")
    if c.at("P") or c.at("<"):
        _js_function_rest(c, body=not c.ts)
        c.take(";")
        return
    if c.ts and c.take(":"):
        js_type(c)
    if c.take("="):
        js_assign(c)
    _js_close(c)


def _js_members(c: Cursor) -> None:
    while True:
        c.skip()
        if c.end():
            return
        _js_member(c)


def _js_obj(c: Cursor, pattern: bool = False) -> None:
    while not c.end():
        if c.take("\x04"):
            js_assign(c)
        else:
            while c.at("TY") and c.s[c.i + 1] in _JS_NAME + "B*n" + STR:
                c.i += 1
            c.take("*")
            key = c.peek()
            if not c.group("B", "index"):
                c.need(_JS_NAME + "n" + STR)
            if c.at("P<"):
                _js_function_rest(c)
            elif c.take(":"):
                js_assign(c)
            elif key in _JS_WORDISH:
                if c.take("="):
                    js_assign(c)
            else:
                raise Fail
        if not c.take(","):
            break
    if not c.end():
        raise Fail


def _js_params(c: Cursor) -> None:
    while not c.end():
        while c.at("@"):
            _js_decorator(c)
        c.take("\x04")
        while c.ts and c.at("p") and c.s[c.i + 1] in _JS_WORDISH:
            c.i += 1
        if not c.take("g"):
            _js_target(c)
        if c.ts:
            c.take("?")
            if c.take(":"):
                js_type(c)
        if c.take("="):
            js_assign(c)
        if not c.take(","):
            break
    if not c.end():
        raise Fail


def _js_list(c: Cursor, holes: bool) -> None:
    while not c.end():
        if holes and c.take(","):
            continue
        c.take("\x04")
        js_assign(c)
        if not c.take(","):
            break
    if not c.end():
        raise Fail


def _js_for(c: Cursor) -> None:
    if c.at("vV") or c.at("l") and c.s[c.i + 1] in _JS_WORDISH + "CB":
        c.i += 1
        _js_var(c, no_in=True)
        if c.take("oj"):
            js_expr(c)
            return
    elif not c.at(";"):
        js_expr(c, no_in=True)
        if c.take("oj"):
            js_expr(c)
            return
    c.need(";")
    if not c.at(";"):
        js_expr(c)
    c.need(";")
    if not c.end():
        js_expr(c)


def _js_type_members(c: Cursor) -> None:
    while True:
        while c.take(";,N"):
            pass
        if c.end():
            return
        while c.at("pTW+S") and c.s[c.i + 1] in _JS_NAME + "B+p" + STR:
            c.i += 1
        if c.at("P<"):
            pass
        elif c.group("B", "key"):
            pass
        else:
            c.need(_JS_NAME + "n" + STR)
        c.take("+")
        c.take("?")
        if c.at("<"):
            _js_angle(c)
        c.group("P", "params")
        if c.take(":"):
            c.skip()
            _ts_type_lines(c)
        if not (c.end() or c.at(";,N")):
            raise Fail


def _js_names(c: Cursor) -> None:
    while not c.end():
        if c.at("Q") and c.s[c.i + 1] in _JS_NAME:
            c.i += 1
        c.need(_JS_NAME + STR)
        if c.take("A"):
            c.need(_JS_NAME + STR)
        if not c.take(","):
            break
    if not c.end():
        raise Fail


def _js_enum(c: Cursor) -> None:
    while not c.end():
        c.need(_JS_NAME + STR)
        if c.take("="):
            js_assign(c)
        if not c.take(","):
            break
    if not c.end():
        raise Fail


def _whole(fn):
    def run(c: Cursor) -> None:
        fn(c)
        c.skip()
        if not c.end():
            raise Fail

    return run


def _js_key(c: Cursor) -> None:
    """An index signature, a mapped type, or a computed name."""
    if c.at(_JS_WORDISH) and c.s[c.i + 1] in ":j":
        c.i += 2
        js_type(c)
        if c.take("A"):
            js_type(c)
    else:
        js_expr(c)


def _js_types(c: Cursor) -> None:
    while not c.end():
        c.take("\x04")
        if c.at(_JS_WORDISH) and (c.s[c.i + 1] == ":" or c.s[c.i + 1 : c.i + 3] == "?:"):
            c.i += 1
            c.take("?")
            c.i += 1
        js_type(c)
        c.take("?")
        if not c.take(","):
            break


_JS_ROLES = {
    "block": _js_statements, "file": _js_statements, "class": _js_members, "switch": _js_switch, "obj": _js_obj, "pattern": _js_obj,
    "params": _js_params, "args": lambda c: _js_list(c, False), "items": lambda c: _js_list(c, True), "pitems": lambda c: _js_list(c, True),
    "paren": _whole(js_expr), "cond": _whole(js_expr), "index": _whole(js_expr), "for": _whole(_js_for), "members": _js_type_members,
    "names": _js_names, "enum": _js_enum, "type": _whole(js_type), "type?": lambda c: None if c.end() else _whole(js_type)(c),
    "types": _whole(_js_types), "key": _whole(_js_key),
}
_LINES = {"block", "file", "class", "switch", "members"}
_SEGMENT = {"block": js_statement, "file": js_statement, "class": _js_member}


@lru_cache(maxsize=200_000)
def _js_level(ts: bool, role: str, s: str) -> tuple[str, ...] | None:
    c = Cursor(s, ts)
    try:
        _JS_ROLES[role](c)
    except (Fail, RecursionError):
        return None
    return tuple(c.roles.get(i, "") for i, ch in enumerate(s) if ch in "PBC") if c.end() else None


@lru_cache(maxsize=200_000)
def _js_segment(ts: bool, role: str, s: str) -> tuple[str, ...] | None:
    """A line that is a statement of its own; continuation lines are left to the whole level."""
    c = Cursor(s, ts)
    try:
        while not c.end():
            _SEGMENT[role](c)
    except (Fail, RecursionError):
        return None
    return tuple(c.roles.get(i, "") for i, ch in enumerate(s) if ch in "PBC")


def _roles(level, segment, ts: bool, role: str, s: str) -> tuple[str, ...] | list[str] | None:
    if role not in _LINES:
        return level(ts, role, s.replace("N", "") if "N" in s else s)
    if role in _SEGMENT and "N" in s:
        out: list[str] = []
        for line in s.split("N"):
            if line:
                got = segment(ts, role, line)
                if got is None:
                    return level(ts, role, s)
                out.extend(got)
        return out
    return level(ts, role, s)


def _check(tree, level, segment, ts: bool, root: str = "file") -> bool:
    todo = [(tree, root)]
    while todo:
        (s, children), role = todo.pop()
        roles = _roles(level, segment, ts, role, s)
        if roles is None:
            return False
        for child, r in zip(children, roles):
            if not r:
                return False
            todo.append((child, r))
    return True


def check_js(text: str, ts: bool) -> bool:
    """Whether a text parses as JavaScript, or as TypeScript."""
    s = lex_js(text)
    tree = nest(s) if s is not None else None
    return tree is not None and _check(tree, _js_level, _js_segment, ts)


# ---------------------------------------------------------------- Go

_GO_KEYWORDS = {
    "break": "b", "case": "c", "chan": "h", "const": "V", "continue": "k", "default": "D", "defer": "d", "else": "e", "fallthrough": "y", "for": "f",
    "func": "F", "go": "g", "goto": "o", "if": "q", "import": "m", "interface": "I", "map": "M", "package": "K", "range": "R", "return": "r",
    "select": "S", "struct": "T", "switch": "s", "type": "t", "var": "v",
}
_GO_TEXT = re.compile(
    r"""//[^\n]*|/\*.*?\*/|/\*|"(?:[^"\\\n]|\\.)*"|`[^`]*`|'(?:[^'\\\n]|\\(?:[abfnrtv\\'"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))'|"|'|`""", re.S
)
_GO_ONE = re.compile(r"[^\W\d]\w*|\d(?:[eEpP][+-](?=\d)|[\w.])*|\.\d(?:[eEpP][+-](?=\d)|[\w.])*|<-|:=|\.\.\.|\+\+|--|<<=|>>=|&\^=|[-+*/%&|^]=|&\^|<<|>>|&&|\|\||[=!<>]=")
_GO_OPS = {"<-": "\x04", ":=": "\x03", "...": "\x05", "++": "\x06", "--": "\x06", "=": "=", ":": ":", ",": ",", ";": ";", ".": ".", "*": "*", "+": "+", "-": "+", "^": "+", "&": "+", "!": "!", "~": "~", "|": "|"}
_GO_NUMBER = re.compile(r"(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO]?[0-7_]*|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?")


def _go_text(m: re.Match) -> str:
    text = m.group()
    if text[0] == "/":
        return BAD if text == "/*" else "\n" if "\n" in text else " "
    return STR if len(text) > 1 else BAD


@lru_cache(maxsize=50_000)
def _go_number_ok(t: str) -> bool:
    return bool(_GO_NUMBER.fullmatch(t))


def _go_token(m: re.Match) -> str:
    t = m.group()
    c = _GO_KEYWORDS.get(t)
    if c is not None:
        return c
    if t[0].isalpha() or t[0] == "_":
        return "i"
    if t[0].isdigit() or t[0] == "." and t[1:2].isdigit():
        return "n" if _go_number_ok(t) else BAD
    c = _GO_OPS.get(t)
    return c if c is not None else "=" if t[-1] == "=" and t not in ("==", "!=", "<=", ">=") else _BIN


def lex_go(text: str) -> str | None:
    """The token classes of a Go file; line ends that end a statement become semicolons, others vanish."""
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    s = _GO_ONE.sub(_go_token, _PLAIN_NAME.sub("i", _GO_TEXT.sub(_go_text, text)))
    for old, new in _GO_PLAIN:
        if old in s:
            s = s.replace(old, new)
    s = re.sub(r"(?<=[in\x01\x06bkyr)\]}])\n+", ";", s)
    s = s.replace("\n", "")
    return None if BAD in s or _GO_STRAY.search(s) else s


_GO_PLAIN = ((" ", ""), ("\t", ""), ("﻿", ""), ("/", "%"), ("<", "%"), (">", "%"), ("-", "+"), ("^", "+"), ("&", "+"))
_GO_STRAY = re.compile(r"[\\`\"'#@$?]")


def go_type(c: Cursor) -> None:
    c.depth += 1
    if c.depth > 150:
        raise RecursionError
    if c.take("*~"):
        go_type(c)
    elif c.group("P", "type"):
        pass
    elif c.at("B"):
        c.group("B", "len")
        go_type(c)
    elif c.take("M"):
        c.need_group("B", "type")
        go_type(c)
    elif c.take("h"):
        c.take("\x04")
        go_type(c)
    elif c.take("\x04"):
        c.need("h")
        go_type(c)
    elif c.take("F"):
        c.need_group("P", "params")
        _go_result(c)
    elif c.take("T"):
        c.need_group("C", "fields")
    elif c.take("I"):
        c.need_group("C", "methods")
    else:
        c.need("i")
        if c.take("."):
            c.need("i")
        c.group("B", "targs")
    c.depth -= 1


def _go_result(c: Cursor) -> None:
    if c.group("P", "params"):
        return
    if c.at("iMhFTIB*\x04"):
        go_type(c)


def go_expr(c: Cursor, lit: bool = True) -> None:
    c.depth += 1
    if c.depth > 150:
        raise RecursionError
    while True:
        while c.take("+!*\x04"):
            pass
        go_primary(c, lit)
        if not c.take("%+*|"):
            break
    c.depth -= 1


def go_primary(c: Cursor, lit: bool) -> None:
    named = False
    if c.take("F"):
        c.need_group("P", "params")
        _go_result(c)
        c.group("C", "block")
    elif c.at("BMTIh"):
        go_type(c)
        c.group("C", "lit")
    elif c.group("P", "paren"):
        pass
    elif c.take("n\x01"):
        pass
    else:
        c.need("i")
        named = True
    while True:
        if c.take("."):
            if not c.group("P", "assert"):
                c.need("i")
            else:
                named = False
        elif c.at("P"):
            c.group("P", "args")
            named = False
        elif c.at("B"):
            c.group("B", "index")
        elif c.at("C") and named and lit:
            c.group("C", "lit")
            named = False
        else:
            return


def _go_exprs(c: Cursor, lit: bool = True) -> None:
    go_expr(c, lit)
    while c.take(","):
        go_expr(c, lit)


def go_simple(c: Cursor, lit: bool = True) -> None:
    """A simple statement, or a range clause."""
    if c.at("R"):
        c.i += 1
        return go_expr(c, lit)
    _go_exprs(c, lit)
    if c.take("\x06"):
        return
    if c.take("=\x03"):
        if c.take("R"):
            return go_expr(c, lit)
        _go_exprs(c, lit)
    elif c.take("\x04"):
        go_expr(c, lit)


def go_statement(c: Cursor) -> None:
    ch = c.peek()
    if ch == "C":
        c.group("C", "block")
    elif ch == "q":
        c.i += 1
        go_simple(c, False) if not c.at(";") else None
        if c.take(";"):
            go_simple(c, False)
        c.need_group("C", "block")
        if c.take("e"):
            if not c.group("C", "block"):
                if not c.at("q"):
                    raise Fail
                go_statement(c)
    elif ch == "f":
        c.i += 1
        if not c.at("C;"):
            go_simple(c, False)
        if c.take(";"):
            if not c.at(";"):
                go_expr(c, False)
            c.need(";")
            if not c.at("C"):
                go_simple(c, False)
        c.need_group("C", "block")
    elif ch == "s":
        c.i += 1
        if not c.at("C"):
            go_simple(c, False) if not c.at(";") else None
            if c.take(";") and not c.at("C"):
                go_simple(c, False)
        c.need_group("C", "cases")
    elif ch == "S":
        c.i += 1
        c.need_group("C", "cases")
    elif ch in "gd":
        c.i += 1
        go_expr(c)
    elif ch == "r":
        c.i += 1
        if not c.end() and not c.at(";"):
            _go_exprs(c)
    elif ch in "bk":
        c.i += 1
        c.take("i")
    elif ch == "o":
        c.i += 1
        c.need("i")
    elif ch == "y":
        c.i += 1
    elif ch in "vVt":
        _go_decl(c)
    elif ch == "i" and c.s[c.i + 1] == ":":
        c.i += 2
        c.take(";")
        if not c.end():
            go_statement(c)
    elif ch == ";":
        return
    else:
        go_simple(c)


def _go_decl(c: Cursor) -> None:
    if c.take("m"):
        if not c.group("P", "imports"):
            _go_import(c)
    elif c.take("v"):
        if not c.group("P", "vars"):
            _go_var(c)
    elif c.take("V"):
        if not c.group("P", "consts"):
            _go_var(c)
    elif c.take("t"):
        if not c.group("P", "tdecls"):
            _go_tdecl(c)
    else:
        raise Fail


def _go_import(c: Cursor) -> None:
    c.take("i.")
    c.need(STR)


def _go_var(c: Cursor) -> None:
    c.need("i")
    while c.take(","):
        c.need("i")
    if not c.end() and not c.at("=;"):
        go_type(c)
    if c.take("="):
        _go_exprs(c)


def _go_tdecl(c: Cursor) -> None:
    c.need("i")
    if c.at("B") and c.s[c.i + 1] in "iMhFTI*B\x04":
        c.group("B", "tparams")
    c.take("=")
    go_type(c)


def _seq(fn):
    def run(c: Cursor) -> None:
        while True:
            while c.take(";"):
                pass
            if c.end():
                return
            fn(c)
            if not (c.end() or c.at(";")):
                raise Fail

    return run


def _go_top(c: Cursor) -> None:
    if c.take("K"):
        return c.need("i")
    if c.take("F"):
        if c.at("P"):
            c.group("P", "params")
        c.need("i")
        c.group("B", "tparams")
        c.need_group("P", "params")
        _go_result(c)
        c.group("C", "block")
        return
    _go_decl(c)


def _go_file(c: Cursor) -> None:
    if not c.s.lstrip(";").startswith("Ki"):
        raise Fail
    _seq(_go_top)(c)


def _go_cases(c: Cursor) -> None:
    while c.take(";"):
        pass
    while not c.end():
        if c.take("c"):
            while True:
                if c.at("BMThFI*"):
                    save, roles = c.i, dict(c.roles)
                    try:
                        go_type(c)
                        if not c.at(",:"):
                            raise Fail
                    except Fail:
                        c.i, c.roles = save, roles
                        go_simple(c)
                else:
                    go_simple(c)
                if not c.take(","):
                    break
        else:
            c.need("D")
        c.need(":")
        while not c.end() and not c.at("cD"):
            if c.take(";"):
                continue
            go_statement(c)
            if not (c.end() or c.at(";")):
                raise Fail


def _go_params(c: Cursor) -> None:
    while not c.end():
        if c.at("i") and c.s[c.i + 1] not in ",.\nB":
            c.i += 1
            c.take("\x05")
            go_type(c)
        elif c.at("i") and c.s[c.i + 1] == "B" and c.s[c.i + 2] in "iMhFTIB*P\x04":
            c.i += 1
            go_type(c)
        else:
            c.take("\x05")
            go_type(c)
        if not c.take(","):
            break
    if not c.end():
        raise Fail


def _go_field(c: Cursor) -> None:
    if c.at("*"):
        go_type(c)
    else:
        c.need("i")
        if c.take("."):
            c.need("i")
        elif not c.end() and not c.at(";\x01"):
            while c.take(","):
                c.need("i")
            go_type(c)
    c.take(STR)


def _go_method(c: Cursor) -> None:
    if c.at("i") and c.s[c.i + 1] == "P":
        c.i += 1
        c.group("P", "params")
        _go_result(c)
        return
    go_type(c)
    while c.take("|"):
        go_type(c)


def _go_elements(c: Cursor) -> None:
    while not c.end():
        for last in (False, True):
            if not c.group("C", "lit"):
                go_expr(c)
            if last or not c.take(":"):
                break
        if not c.take(","):
            break
    if not c.end():
        raise Fail


def _go_args(c: Cursor) -> None:
    while not c.end():
        _go_type_or_expr(c)
        c.take("\x05")
        if not c.take(","):
            break
    if not c.end():
        raise Fail


def _go_type_or_expr(c: Cursor) -> None:
    save, roles = c.i, dict(c.roles)
    try:
        go_expr(c)
    except Fail:
        c.i, c.roles = save, roles
        go_type(c)


def _go_index(c: Cursor) -> None:
    if not c.at(":"):
        _go_type_or_expr(c)
    while c.take(","):
        if not c.end():
            go_type(c)
    while c.take(":"):
        if not c.end() and not c.at(":"):
            go_expr(c)


def _go_tparams(c: Cursor) -> None:
    while not c.end():
        c.need("i")
        while c.take(","):
            c.need("i")
        if c.end():
            return
        go_type(c)
        while c.take("|"):
            go_type(c)
        if not c.take(","):
            break


def _go_len(c: Cursor) -> None:
    if not c.end() and not c.take("\x05"):
        go_expr(c)


def _go_types(c: Cursor) -> None:
    go_type(c)
    while c.take(","):
        if not c.end():
            go_type(c)


_GO_ROLES = {
    "file": _go_file, "block": _seq(go_statement), "cases": _go_cases, "params": _go_params, "fields": _seq(_go_field), "methods": _seq(_go_method),
    "lit": _go_elements, "args": _go_args, "paren": _whole(_go_type_or_expr), "type": _whole(go_type), "index": _whole(_go_index), "len": _whole(_go_len),
    "targs": _whole(_go_types), "tparams": _whole(_go_tparams), "imports": _seq(_go_import), "vars": _seq(_go_var), "consts": _seq(_go_var), "tdecls": _seq(_go_tdecl),
    "assert": lambda c: (c.take("t") or go_type(c)),
}


@lru_cache(maxsize=200_000)
def _go_level(ts: bool, role: str, s: str) -> tuple[str, ...] | None:
    c = Cursor(s)
    try:
        _GO_ROLES[role](c)
    except (Fail, RecursionError):
        return None
    return tuple(c.roles.get(i, "") for i, ch in enumerate(s) if ch in "PBC") if c.end() else None


def _go_lines(role: str, s: str):
    """Blocks and files statement by statement where each is one by itself."""
    if role not in ("block", "file") or ";" not in s:
        return _go_level(False, role, s)
    if role == "file" and not s.lstrip(";").startswith("Ki"):
        return None
    out: list[str] = []
    one = "block" if role == "block" else "top"
    for line in s.split(";"):
        if line:
            got = _go_one(one, line)
            if got is None:
                return _go_level(False, role, s)
            out.extend(got)
    return out


@lru_cache(maxsize=200_000)
def _go_one(role: str, s: str) -> tuple[str, ...] | None:
    c = Cursor(s)
    try:
        go_statement(c) if role == "block" else _go_top(c)
    except (Fail, RecursionError):
        return None
    return tuple(c.roles.get(i, "") for i, ch in enumerate(s) if ch in "PBC") if c.end() else None


def check_go(text: str) -> bool:
    """Whether a text parses as a Go source file."""
    s = lex_go(text)
    tree = nest(s) if s is not None else None
    if tree is None:
        return False
    todo = [(tree, "file")]
    while todo:
        (t, children), role = todo.pop()
        roles = _go_lines(role, t)
        if roles is None:
            return False
        for child, r in zip(children, roles):
            if not r:
                return False
            todo.append((child, r))
    return True
