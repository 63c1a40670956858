"""Splitting oversized items at natural boundaries (problem 3).

Method: agglomerative merging. A text falls into atomic segments (lines; a line too long by itself is cut after statement
ends, else blanks, else anywhere). Every boundary between neighbours has a strength: high between blank-line separated
blocks at the outer indentation, lower inside deeper blocks, lowest within brackets and lines. Neighbours lie in a heap
by strength, and the weakest boundary is merged first while the merged segment and the overlap fit the limit.

Each text is independent, so this is one map over the oversized rows; no shuffle but the deduplication of keys.
"""

from __future__ import annotations

import heapq
import re

from pyspark.sql import DataFrame, functions as F

from .common import arrow_rows

LIMIT, OVERLAP = 2000, 200


def atoms(text: str, most: int) -> list[tuple[int, int]]:
    """Line by line with their line ends; longer lines are cut."""
    out = []
    at = 0
    for line in re.findall(r"[^\n]*\n|[^\n]+$", text):
        end = at + len(line)
        while end - at > most:
            window = text[at : at + most]
            cut = max(window.rfind(";"), window.rfind("}"), window.rfind("{"))
            if cut < most // 4:
                cut = max(window.rfind(" "), window.rfind(","), cut)
            cut = cut + 1 if cut >= most // 4 else most
            out.append((at, at + cut))
            at += cut
        if end > at:
            out.append((at, end))
        at = end
    return out


def boundaries(text: str, parts: list[tuple[int, int]]) -> list[float]:
    """The strength of the boundary after each atom but the last."""
    out = []
    depth, open_string = 0, None
    for i, (a, b) in enumerate(parts[:-1]):
        piece = text[a:b]
        # bracket depth and block strings, from the line's own characters
        for m in re.finditer(r"\"\"\"|'''|[()\[\]{}]", piece):
            t = m.group()
            if len(t) == 3:
                open_string = None if open_string == t else t if open_string is None else open_string
            elif open_string is None:
                depth = max(0, depth + (1 if t in "([{" else -1))
        nxt = text[parts[i + 1][0] : parts[i + 1][1]]
        if not piece.endswith("\n"):
            out.append(0.5 if piece.endswith((";", "}")) else 0.1)
            continue
        rounds = sum(piece.count(c) for c in "([") - sum(piece.count(c) for c in ")]")
        indent = len(nxt) - len(nxt.lstrip(" \t"))
        strength = 4.0 + 4.0 / (1 + indent)
        if not piece.strip():
            strength += 3
        elif not nxt.strip():
            strength += 1
        if re.match(r"\s*(?:def|class|func|function|async|export|@|if|for|while|switch|try|return|public|private)\b", nxt):
            strength += 1
        if re.match(r"\s*[)\]}]", nxt) or re.match(r"\s*(?:else|elif|except|finally|catch)\b", nxt):
            strength -= 3
        if open_string is not None or rounds > 0 or piece.rstrip().endswith(("(", "[", ",", "\\", "=", "+")):
            strength = min(strength, 1.5)
        out.append(strength)
    return out


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Pieces as (start, end) offsets, each at most `limit` long and beginning within `overlap` of the end before.

    A text within the limit is one piece; an empty text none. Ties merge from the front.
    """
    if not text:
        return []
    if len(text) <= limit:
        return [(0, len(text))]
    parts = atoms(text, limit - overlap)
    strength = boundaries(text, parts)
    n = len(parts)
    start, end = [a for a, _ in parts], [b for _, b in parts]
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    version = [0] * n
    heap = [(strength[i], end[i + 1] - start[i], i, 0) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        s, _, i, v = heapq.heappop(heap)
        if not alive[i] or v != version[i] or after[i] >= n:
            continue
        j = after[i]
        room = limit if start[i] == 0 else limit - overlap
        if end[j] - start[i] > room:
            continue
        end[i], alive[j], after[i] = end[j], False, after[j]
        if after[j] < n:
            before[after[j]] = i
        version[i] += 1
        if after[i] < n:
            k = after[i]
            heapq.heappush(heap, (strength[k - 1], end[k] - start[i], i, version[i]))
        if before[i] >= 0:
            b = before[i]
            version[b] += 1
            heapq.heappush(heap, (strength[i - 1], end[i] - start[b], b, version[b]))
    bodies = [(start[i], end[i]) for i in range(n) if alive[i]]
    out = [bodies[0]]
    for a, b in bodies[1:]:
        first = max(out[-1][0], a - overlap)
        line = text.find("\n", first - 1 if first else 0, a - 1) + 1 if first else 0
        out.append((line if first < line < a else first, b))
    return out


def _rows(key, text, line, limit, overlap):
    if key is None or text is None:
        return []
    first = 1 if line is None else line
    out = []
    for no, (a, b) in enumerate(split_text(text, limit, overlap), 1):
        piece = text[a:b]
        begin = first + text.count("\n", 0, a)
        out.append((key, no, begin, begin + piece.count("\n") - (1 if piece.endswith("\n") else 0), piece))
    return out


def split_oversized(df: DataFrame, key: str = "entity_id", text: str = "content", line: str = "start_line", limit: int = LIMIT, overlap: int = OVERLAP, distinct: bool = True) -> DataFrame:
    """(key, piece_no, start_line, end_line, piece) of every text longer than the limit, in code points.

    Pieces after the first begin with the whole lines within the last `overlap` characters before, or with those
    characters if no line fits. Null keys and texts give no row; a null start line counts as 1; repeated rows of a key count once.
    """
    big = df.where(F.length(text) > limit).select(key, text, line)
    big = big.dropDuplicates([key]) if distinct else big
    return arrow_rows(big, [key, text, line], f"{key} bigint, piece_no int, start_line int, end_line int, piece string", lambda k, t, n: _rows(k, t, n, limit, overlap))
