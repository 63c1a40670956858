"""Text functions: Column -> Column, all evaluated by built-in expressions.

Null in, null out, unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


#: Before and after a word of ASCII letters, digits and underscores.
_EDGE = ("(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: str | Column) -> Column:
    """Lower-cased words of two or more ASCII letters and digits; a word with another letter or an underscore in it is none."""
    parts = F.split(F.lower(_c(text)), r"[^\p{L}\p{N}_]+")
    return F.filter(parts, lambda w: w.rlike("^[a-z0-9]{2,}$"))


def spaced_name(name: str | Column) -> Column:
    """camelCase, snake_case and kebab-case names as separate words."""
    return F.regexp_replace(F.regexp_replace(_c(name), "([a-z])([A-Z])", "$1 $2"), "[_-]", " ")


def strip_markup(text: str | Column) -> Column:
    """Plain text of markup: scripts, styles and comments removed, breaks and list items kept as lines, entities replaced."""
    x = _c(text)
    for pattern, to in (
        (r"(?is)<\?php.*?\?>", ""), (r"(?is)<script\b.*?</script>", ""), (r"(?is)<style\b.*?</style>", ""), (r"(?s)<!--.*?-->", ""),
        (r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>", "\n"), (r"(?i)<li[^>]*>", "- "), (r"<[^>]+>", ""),
    ):
        x = F.regexp_replace(x, pattern, to)
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def normalise_code(code: str | Column) -> Column:
    """Code without comments and with blanks collapsed, for comparing."""
    x = F.regexp_replace(_c(code), r"(?s)/\*.*?\*/", " ")
    x = F.regexp_replace(x, r"(?m)(?:#|//).*$", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def mask_literals(code: str | Column) -> Column:
    """Strings and numbers replaced by placeholders, so that code of the same shape is equal."""
    x = F.regexp_replace(_c(code), r'"[^"\n]*"' + r"|'[^'\n]*'", "STR")
    return F.regexp_replace(x, rf"{_EDGE[0]}[0-9]+(?:\.[0-9]+)?{_EDGE[1]}", "NUM")


def called_names(code: str | Column) -> Column:
    """Names in front of a bracket on lines that do not define anything, distinct and sorted."""
    lines = F.filter(F.split(_c(code), "\n"), lambda x: ~x.rlike(r"^\s*(def|class|func|function)\b"))
    calls = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))))
    return F.array_sort(F.array_distinct(F.filter(calls, lambda w: ~w.isin("if", "for", "while", "return", "switch", "catch", "and", "or", "not", "in", "elif", "with"))))


def naming_style(name: str | Column) -> Column:
    """snake, upper, pascal, camel, or other."""
    n = _c(name)
    return (
        F.when(n.rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)*$"), "snake")
        .when(n.rlike("^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$"), "upper")
        .when(n.rlike("^[A-Z][A-Za-z0-9]*$"), "pascal")
        .when(n.rlike("^[a-z][A-Za-z0-9]*$"), "camel")
        .otherwise("other")
    )


def complexity(code: str | Column) -> Column:
    """One plus the decision points on lines that are not comments."""
    lines = F.filter(F.split(_c(code), "\n"), lambda x: ~x.rlike(r"^\s*(#|//|\*)"))
    body = F.array_join(lines, "\n")
    return (F.lit(1) + F.regexp_count(body, F.lit(rf"{_EDGE[0]}(?:if|elif|for|while|case|catch|except){_EDGE[1]}")) + F.regexp_count(body, F.lit(rf"&&|\|\||{_EDGE[0]}(?:and|or){_EDGE[1]}"))).cast("int")


def estimated_tokens(text: str | Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(_c(text)) / 4).cast("bigint")


def base_name(path: str | Column) -> Column:
    return F.substring_index(_c(path), "/", -1)


def clean_path(path: str | Column) -> Column:
    """Without a leading ./"""
    return F.regexp_replace(_c(path), r"^\./", "")


def extension(path: str | Column) -> Column:
    """The lower-cased extension with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]+)$", 1))


def collection_name(project: str | Column, path: str | Column) -> Column:
    """A safe collection name: lower case, other characters as single underscores, six hash digits of the path."""
    safe = F.regexp_replace(F.regexp_replace(F.lower(_c(project)), "[^a-z0-9_-]", "_"), "_+", "_")
    return F.concat(F.regexp_replace(safe, "^_|_$", ""), F.lit("_"), F.substring(F.sha2(_c(path), 256), 1, 6))


def chunk_id(path, kind, name, chunk_type, content) -> Column:
    """file::type::name::chunk::first 16 digits of the content's hash."""
    return F.concat_ws("::", _c(path), _c(kind), _c(name), _c(chunk_type), F.substring(F.sha2(_c(content), 256), 1, 16))


def relation_key(source, kind, target, import_type, context) -> Column:
    """from::type::to and, where they exist, import type and context."""
    return F.concat_ws("::", _c(source), _c(kind), _c(target), _c(import_type), _c(context))


def search_text(name, kind, observations, path) -> Column:
    """The text an entity is searched by: its name twice, its words, kind, file name and first observation."""
    return F.concat_ws(" ", _c(name), _c(name), spaced_name(name), F.try_element_at(_c(observations), F.lit(1)), _c(kind), base_name(path))


def intent(text: str | Column) -> Column:
    """What a request is about, by its first matching keyword group."""
    t = F.lower(_c(text))
    return (
        F.when(t.rlike("error|exception|traceback|crash|fail"), "debugging")
        .when(t.rlike("deploy|release|migration"), "operations")
        .when(t.rlike("test|assert"), "testing")
        .when(t.rlike("how|why|what"), "question")
        .otherwise("implementation")
    )
