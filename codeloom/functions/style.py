"""Colour, length and style-sheet functions: Column -> Column."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

from .text import _c


def normal_colour(value: str | Column) -> Column:
    """#rgb, #rgba, #rrggbb, #rrggbbaa and rgb()/rgba() as #RRGGBBAA in upper case; null for others."""
    v = F.lower(F.trim(_c(value)))
    h = F.regexp_extract(v, "^#([0-9a-f]+)$", 1)
    double = F.regexp_replace(h, "(.)", "$1$1")
    rgb = r"^rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*(?:,\s*([0-9.]+)\s*)?\)$"
    two = lambda i: F.lpad(F.hex(F.least(F.regexp_extract(v, rgb, i).cast("int"), F.lit(255))), 2, "0")
    alpha = F.when(F.regexp_extract(v, rgb, 4) == "", F.lit("FF")).otherwise(F.lpad(F.hex(F.round(F.regexp_extract(v, rgb, 4).try_cast("double") * 255).cast("int")), 2, "0"))
    return (
        F.when(F.length(h) == 3, F.upper(F.concat(F.lit("#"), double, F.lit("ff"))))
        .when(F.length(h) == 4, F.upper(F.concat(F.lit("#"), double)))
        .when(F.length(h) == 6, F.upper(F.concat(F.lit("#"), h, F.lit("ff"))))
        .when(F.length(h) == 8, F.upper(F.concat(F.lit("#"), h)))
        .when(v.rlike(rgb), F.concat(F.lit("#"), two(1), two(2), two(3), alpha))
    )


def channel(colour: str | Column, i: int) -> Column:
    """Channel i (0 red .. 3 alpha) of #RRGGBBAA as a number."""
    return F.conv(F.substring(_c(colour), 2 + 2 * i, 2), 16, 10).cast("int")


def colour_distance(a: str | Column, b: str | Column) -> Column:
    """Euclidean distance of two colours over four channels, between 0 and 1."""
    squares = [F.pow((channel(a, i) - channel(b, i)).cast("double"), F.lit(2.0)) for i in range(4)]
    return F.sqrt(squares[0] + squares[1] + squares[2] + squares[3]) / F.lit(510.0)


def luminance(colour: str | Column) -> Column:
    """Relative luminance."""

    def linear(i: int) -> Column:
        c = channel(colour, i) / F.lit(255.0)
        return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(0) + 0.7152 * linear(1) + 0.0722 * linear(2)


def contrast(a: str | Column, b: str | Column) -> Column:
    """Contrast ratio of two colours, from 1 to 21."""
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def pixels(value: str | Column, root: float = 16.0) -> Column:
    """px, rem and em lengths in pixels; null for others."""
    v = F.lower(F.trim(_c(value)))
    number = F.regexp_extract(v, r"^(-?[0-9.]+)(px|rem|em)?$", 1).try_cast("double")
    unit = F.regexp_extract(v, r"^(-?[0-9.]+)(px|rem|em)?$", 2)
    return F.when(unit.isin("rem", "em"), number * root).otherwise(number)


_SELECTOR = re.compile(r"(?P<id>#[\w-]+)|(?P<class>\.[\w-]+)|\[(?P<attribute>[^\]]*)\]|::(?P<element>[\w-]+)|:(?P<pseudo>[\w-]+)(?P<args>\()?|(?P<type>[A-Za-z_][\w-]*)|(?P<other>.)", re.S)
# Pseudo-elements that may be written with one colon; and pseudo-classes that weigh what their argument weighs.
_ONE_COLON, _BY_ARGUMENT = {"before", "after", "first-line", "first-letter"}, {"is", "not", "has", "matches"}


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments behind an opening bracket, parted at commas of their own level, and the offset after the closing one."""
    depth, parts, begin = 1, [], at
    for i in range(at, len(text)):
        c = text[i]
        depth += (c in "([") - (c in ")]")
        if depth == 0:
            return [*parts, text[begin:i]], i + 1
        if c == "," and depth == 1:
            parts.append(text[begin:i])
            begin = i + 1
    return [*parts, text[begin:]], len(text)


def selector_weight(selector: str) -> int:
    """Specificity of a selector as the Selectors specification counts it, with 100 for identifiers, 10 for classes, attributes
    and pseudo-classes, 1 for types and pseudo-elements; of a list the heaviest, `:where()` nothing."""
    several, _ = _arguments(selector + ")", 0)
    if len(several) > 1:
        return max(map(selector_weight, several))
    weight, at = 0, 0
    while (m := _SELECTOR.match(selector, at)) is not None:
        at, kind = m.end(), m.lastgroup
        if kind == "id":
            weight += 100
        elif kind in ("class", "attribute"):
            weight += 10
        elif kind in ("element", "type"):
            weight += 1
        elif kind in ("pseudo", "args"):
            name, args = m["pseudo"].lower(), []
            if m["args"]:
                args, at = _arguments(selector, at)
            if name in _BY_ARGUMENT:
                weight += max(map(selector_weight, args), default=0)
            elif name != "where":
                weight += 1 if name in _ONE_COLON else 10
                # nth-child(2n of .a) weighs its list too
                weight += max((selector_weight(a.partition(" of ")[2]) for a in args if " of " in a), default=0)
    return weight


def specificity(selector: str | Column) -> Column:
    """selector_weight of a column, in Arrow batches; null for null."""

    @F.pandas_udf("int")
    def weigh(values: pd.Series) -> pd.Series:
        return values.map({v: selector_weight(v) for v in values.dropna().unique()}).astype("Int32")

    return weigh(_c(selector))
