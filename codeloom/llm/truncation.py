"""Text cut off by field limits (problem 9).

Method: a backward character n-gram model. A context is the kind of a line (prose, list entry, table row, code, error
message ...) and the last n characters before a position; over all texts it is counted how often a unit ends there
(line or text end) and how often it goes on. For each value the contexts at its own end are looked up, its own end left out,
and the probability of an end is smoothed from short to long contexts. A value whose log-odds of "ends here" against
"goes on" lie under the bound of its language and column breaks off inside a word, a sentence or a line of code.

The bounds are found without labels. Every different text is cut on trial too, at a place given by its hash, and scored like
the rest; with the share of cut texts at which the lower ends of both distributions agree, the bound of a language is the
one with the fewest errors. Languages of few texts have the bound of all texts together, which starts from BOUND.

Only contexts at which some value ends are counted: a bitmap, sized by their number up to 16 MB, filters the scan, and the
exact counts are summed by an aggregation on the context; a task's own table is passed on whenever it is full. A context
that many texts end with is one row of the model; the texts that look it up are spread by the adaptive skew join.

Copies of a text count once, within texts as at their ends, so repeated tables give the same verdicts. A second bitmap,
bounded like the first, tells texts that may have copies from those that have none: the latter are counted where they are
read, only the former are shuffled, to be counted from one copy each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ensure_checkpoint_dir, spread
from .common import arrow_rows, schema_of

ORDERS = (2, 3, 5, 8, 12, 18)
#: Least and most bits of the filter; the bound of what is broadcast (16 MB).
LEAST_BITS, MOST_BITS = 20, 27
BLOCK_CHARS = 100_000
#: Contexts a task holds before it passes its counts on.
HELD = 400_000
SMOOTH, PRIOR = 8.0, 0.05
#: Log-odds under which a value counts as cut, until bounds are found; the fewest texts cut on trial for a bound of their language.
BOUND, FEWEST = -7.0, 150
#: Texts of all languages that stand beside those of a language when its bound is found.
PRIOR_TEXTS = 2_000
#: Log-odds are counted in steps of so much.
STEP = 0.25
_COUNT = schema_of("h bigint, ends bigint, goes bigint")
_COPY = schema_of("t bigint, text string")
#: Hashes of contexts are even; an odd one is the context at an end.
_EVEN = np.uint64(0xFFFFFFFFFFFFFFFE)
_BASE, _KIND_SEED = np.uint64(0x9E3779B97F4A7C55), np.uint64(0xD6E8FEB86659FD93)

# kinds of lines by their number: 1 list entry, 2 table row, 3 heading, 4 error message, 5 traceback, 6 signature,
# 7 address, 8 label; others are 0, fences 9, code 10
_KIND = re.compile(r"\s*(?:(?:([-*+•]|\d+[.)])\s)|(\|)|(#{1,6}\s))|((?:[\w.]*(?:Error|Exception|Warning|Fault))\b[^:\n]*:)|(\s*File \")|(\s*(?:—|--)\s)|(\s*(?:\w+:? )?https?://)|([A-Z][\w-]{2,14}:\s)")


# marks that a cut leaves behind, and entities or escapes that were cut themselves
_MARK = re.compile(r"\s*(?:\[(?:truncated|cut|snipped|clipped|more)\]|\(\+\s?\d+ (?:more )?(?:chars|characters|bytes|words|lines)\)|[…�]+)$", re.I)
_BROKEN = re.compile(r"(?:&(?:[a-zA-Z]{1,7}|#\d{0,6}|#x[0-9a-fA-F]{0,5})?|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|(?<=[\w%])%(?:[0-9A-F])?)$")


def marked(text: str | None) -> bool:
    """Whether a text ends with a mark of a cut, or inside an entity or escape."""
    t = (text or "").rstrip()
    return bool(_MARK.search(t[-60:]) or _BROKEN.search(t[-12:]) and not re.search(r"(?:\s|^)[&%]$|\d%$", t[-12:]))


def tidy(text: str | None) -> str:
    """Line ends unified, trailing blanks dropped, and the marks that a cut leaves (an ellipsis sign, a broken character) removed."""
    if not text:
        return ""
    t = _TRAIL.sub("", text.replace("\r\n", "\n").replace("\r", "\n")).rstrip()
    m = _MARK.search(t, max(0, len(t) - 60))
    return (t[: m.start()].rstrip() or t) if m else t


_TRAIL = re.compile(r"[ \t\xa0]+(?=\n|$)")
# all digits are one character to the model
_DIGITS = {ord(c): "0" for c in "123456789"}


def line_kinds(text: str) -> tuple[list[tuple[int, int]], bool]:
    """(kind, length with its line end) of each line, and whether a code block is open at the end."""
    out, fence = [], False
    match = _KIND.match
    for line in text.split("\n"):
        if line.startswith(("```", "~~~")) or line[:1] in " \t" and line.lstrip().startswith(("```", "~~~")):
            out.append((9, len(line) + 1))
            fence = not fence
        elif fence:
            out.append((10, len(line) + 1))
        else:
            m = match(line)
            out.append((m.lastindex if m else 0, len(line) + 1))
    return out, fence


def _context_hashes(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Over texts set one after another: code points, a context hash per order and position, and the texts' ends."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    points[(points > 48) & (points < 58)] = 48
    pairs = [p for t in texts for p in line_kinds(t)[0]]
    with np.errstate(over="ignore"):
        seeds = np.array([k for k, _ in pairs], np.uint64) * _KIND_SEED
    kind_seed = np.repeat(seeds, np.array([n for _, n in pairs], np.int64))
    last = np.cumsum([len(t) + 1 for t in texts]) - 2
    # a hash of n characters from those of its last a and of the b before them
    of = {1: points}
    hashes = []
    with np.errstate(over="ignore"):
        for n, a, b in _STEPS:
            h = of[a].copy()
            h[a:] += of[b][:-a] * _power(a)
            of[n] = h
        for n in ORDERS:
            hashes.append(((of[n] + kind_seed + np.uint64(n)) * np.uint64(0x94D049BB133111EB)) & _EVEN)
    return points, hashes, last


def _steps(orders: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(n, a, b) with n = a + b, each part made before: the orders, and what they need besides."""
    made, out = {1}, []

    def make(n: int) -> None:
        if n in made:
            return
        a = max((x for x in made if n - x in made), default=None) or max(x for x in made if x < n)
        if n - a not in made:
            make(n - a)
        out.append((n, a, n - a))
        made.add(n)

    for n in orders:
        make(n)
    return out


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


_STEPS = _steps(ORDERS)


_FENCE = re.compile(r"^(?:[ \t][^\S\n]*)?(?:```|~~~)", re.M)


def tail_state(text: str) -> tuple[int, bool]:
    """The kind of the last line, and whether a code block is open at the end, as line_kinds has them."""
    begin = text.rfind("\n") + 1
    fences = len(_FENCE.findall(text))
    if _FENCE.match(text, begin):
        return 9, fences % 2 == 1
    if fences % 2:
        return 10, True
    m = _KIND.match(text[begin:])
    return m.lastindex if m else 0, False


def end_contexts(text: str, tail_kind: int | None = None) -> list[int]:
    """The context hashes at the end of one tidied text, by order; `tail_kind` is the kind of its last line where that is known."""
    tail_kind = tail_state(text)[0] if tail_kind is None else tail_kind
    tail = ("\n" * max(ORDERS) + text)[-max(ORDERS) :].translate(_DIGITS)
    whole, base, seed, out = (1 << 64) - 1, int(_BASE), tail_kind * int(_KIND_SEED), []
    h, power = 0, 1
    for n, c in enumerate(reversed(tail), 1):
        h = (h + ord(c) * power) & whole
        power = power * base & whole
        if n in ORDERS:
            x = (h + seed + n) * 0x94D049BB133111EB & int(_EVEN)
            out.append(x - (1 << 64) if x >> 63 else x)
    return out


def _scan(bitmap, bits: int, copied=None):
    """Interior events of the wanted contexts, summed within the partition; texts that `copied` may hold are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(bitmap.value, np.uint8)
        # a byte a bit while that is small; else the bits themselves
        flags = np.unpackbits(packed, bitorder="little") if bits <= 24 else None
        mask = (1 << np.arange(8)).astype(np.uint8)
        # the filter goes by a hash's upper bits, which depend on all characters, and for hits by those below them
        shift, below, low = np.uint64(64 - bits), np.uint64(64 - 2 * bits), np.uint64((1 << bits) - 1)
        events: list[np.ndarray] = []  # hashes of hits, odd where a unit ends
        counted: list[tuple[np.ndarray, np.ndarray]] = []  # different events with their counts
        held = 0

        def count() -> None:
            if events:
                e = np.sort(np.concatenate(events))
                start = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
                counted.append((e[start], np.diff(np.r_[start, len(e)])))
                events.clear()
            if len(counted) > 1:
                e, n = (np.concatenate(x) for x in zip(*counted))
                order = np.argsort(e, kind="stable")
                e, n = e[order], n[order]
                start = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
                counted[:] = [(e[start], np.add.reduceat(n, start))]

        def passed_on() -> Iterator[pa.RecordBatch]:
            for e, n in counted:
                odd = (e & np.uint64(1)).astype(np.int64)
                columns = (e & _EVEN).astype(np.int64), n * odd, n * (1 - odd)
                for i in range(0, len(e), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in columns], schema=to_arrow_schema(_COUNT))
            counted.clear()

        def filled(slot: np.ndarray) -> np.ndarray:
            slot = slot.astype(np.int32)
            return flags[slot] if flags is not None else packed[slot >> 3] & mask[slot & 7]

        def block(texts: list[str]) -> None:
            nonlocal held
            points, hashes, last = _context_hashes(texts)
            following = np.r_[points[1:], 10]
            inside = points != 10
            inside[last[last >= 0]] = False  # the texts' own ends are counted apart
            ends = (following == 10).astype(np.uint64)
            for x in hashes:
                at = np.flatnonzero((filled(x >> shift) != 0) & inside)
                at = at[filled((x[at] >> below) & low) != 0]
                if len(at):
                    events.append(x[at] | ends[at])
                    held += len(at)

        texts: list[str] = []
        size = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if copied is not None and copied.value.holds(hash_text(t)):
                    continue
                t = tidy(t)
                if not t:
                    continue
                texts.append(t)
                size += len(t)
                if size >= BLOCK_CHARS:
                    block(texts)
                    texts, size = [], 0
                    if held > HELD:
                        count()
                        held = len(counted[0][0])
                        if held > HELD // 2:  # mostly different contexts: the aggregation goes on with them
                            yield from passed_on()
                            held = 0
        if texts:
            block(texts)
        count()
        yield from passed_on()

    return run


class Copied:
    """A bitmap of hashes of texts that have copies; some other texts hit it as well."""

    def __init__(self, words: bytes, bits: int) -> None:
        self.words, self.bits = words, bits

    def holds(self, t: int) -> bool:
        slots = t >> 63 - self.bits, (t >> 63 - 2 * self.bits) & (1 << self.bits) - 1  # of 63 bits
        return all(self.words[x >> 3] >> (x & 7) & 1 for x in slots)


def _copies(copied):
    """(hash, text) of the texts that a bitmap may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, t) for t in batch.column(0).to_pylist() if copied.value.holds(h := hash_text(t))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows), to_arrow_schema(_COPY))], schema=to_arrow_schema(_COPY))

    return run


def _bitmap(ends: DataFrame) -> tuple[bytes, int]:
    """The filter, with two bits for a hash, and the logarithm of its bits, assembled from its filled words; at most 2^MOST_BITS / 64 rows reach the driver."""
    n = ends.agg(F.approx_count_distinct("h")).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    slots = F.expr(f"explode(array(cast(shiftrightunsigned(h, {64 - bits}) as int), cast(shiftrightunsigned(h, {64 - 2 * bits}) & {(1 << bits) - 1} as int)))")
    rows = ends.select(slots.alias("s")).groupBy(F.expr("s div 64").cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("m")).toPandas()
    words = np.zeros((1 << bits) // 64, np.int64)
    words[rows["w"].to_numpy(dtype=np.int64)] = rows["m"].to_numpy(dtype=np.int64)
    return words.tobytes(), bits


def cut_at(text: str, seed: int) -> tuple[str, bool] | None:
    """A tidied text cut at a place that its hash gives, and whether a line ended there; None if it is too short or the cut shows by itself."""
    if len(text) < 40:
        return None
    begin = tidy(text[: len(text) // 5 + seed % (len(text) * 3 // 4)])
    if not begin or tail_state(begin)[1] or marked(begin):
        return None
    return begin, text[len(begin)] == "\n"


def best_bound(real: np.ndarray, trial: np.ndarray, start: float = BOUND) -> float:
    """The bound with the fewest errors, from counts by steps of log-odds (the first step is the lowest) of all texts and of
    texts known to be cut. The share of cut texts is the median ratio of both distributions up to `start`."""
    f, g = np.cumsum(real) / max(1, real.sum()), np.cumsum(trial) / max(1, trial.sum())
    low = np.flatnonzero((_EDGES <= start) & (g > 0.25 * g[_EDGES <= start].max()) & (g > 0))
    if not len(low):
        return start
    share = min(1.0, float(np.median(f[low] / g[low])))
    gain = 2 * share * g - f
    # where it makes no difference, the bound nearest to the start
    good = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(_EDGES[good[np.argmin(np.abs(_EDGES[good] - start))]])


#: Upper ends of the steps.
_EDGES = np.arange(-16.0, 4.0 + STEP, STEP)


def truncation(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", bounds: dict[str, float] | None = None) -> DataFrame:
    """(key, log_odds, cut) of every key once.

    Null and blank texts are not cut and have null log-odds. A text that ends inside an open code block, or
    with a mark of a cut, is cut. Equal texts get equal verdicts. Bounds are those of the language (case and blanks
    ignored) in this column; null, unknown and rare languages have that of all texts. `bounds` sets some by hand.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)

    def tails(k, t, g):
        t2 = tidy(t)
        if k is None:
            return []
        g = (g or "").strip().lower() or None
        if not t2:
            return [(k, None, g, False, False, [])]
        h = hash_text(t)
        kind, fence = tail_state(t2)
        hs, line = end_contexts(t2, kind), False
        if (c := cut_at(t2, h >> 20)) is not None:
            line = c[1]
            hs += end_contexts(c[0])
        return [(k, h, g, fence or marked(t), line, hs)]

    every = arrow_rows(df, [key, text, lang], f"{key} bigint, t bigint, g string, open boolean, line boolean, hs array<bigint>", tails).dropDuplicates([key]).checkpoint()
    # different texts; the contexts at a text's own end come first, then those where it was cut on trial
    texts = every.where("t is not null").select("t", "line", "hs").dropDuplicates(["t"]).checkpoint()
    rows = texts.select("t", "line", F.posexplode("hs").alias("i", "h")).select("t", "line", (F.col("i") >= len(ORDERS)).alias("trial"), (F.col("i") % len(ORDERS)).alias("o"), "h")
    own = rows.groupBy("h").agg(F.count(F.when(~F.col("trial"), 1)).alias("own"))
    filter_, bits = _bitmap(rows)
    wanted = spark.sparkContext.broadcast(filter_)
    # texts without copies are counted where they are read, others from one copy
    repeated = every.where("t is not null").groupBy("t").count().where("count > 1").select(F.shiftleft("t", 1).alias("h"))
    copied = spark.sparkContext.broadcast(Copied(*_bitmap(repeated)))
    read = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(text)
    once = read.mapInArrow(_copies(copied), _COPY).dropDuplicates(["t"]).select("text")
    events = read.mapInArrow(_scan(wanted, bits, copied), _COUNT).union(once.mapInArrow(_scan(wanted, bits), _COUNT))
    seen = events.groupBy("h").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes"))
    model = own.join(seen, "h", "left").select("h", (F.coalesce("ends", F.lit(0)) + F.col("own")).alias("ends"), F.coalesce("goes", F.lit(0)).alias("goes"))
    # its own event left out: an end, or for a text cut by us, what followed
    ended = ~F.col("trial") | F.col("line")
    left = F.struct("o", F.greatest(F.col("ends") - ended.cast("bigint"), F.lit(0)).alias("ends"), F.greatest(F.col("goes") - (~ended).cast("bigint"), F.lit(0)).alias("goes"))
    by = rows.join(model, "h").groupBy("t").agg(*(F.sort_array(F.collect_list(F.when(of, left))).alias(n) for n, of in (("log_odds", ~F.col("trial")), ("trial_odds", F.col("trial")))))

    def odds(c: str) -> F.Column:
        p = F.aggregate(c, F.lit(PRIOR), lambda acc, x: (x["ends"] + SMOOTH * acc) / (x["ends"] + x["goes"] + SMOOTH))
        return F.when(F.size(c) > 0, F.log(F.greatest(p, F.lit(1e-30))) - F.log(F.greatest(1 - p, F.lit(1e-12))))

    scored = by.select("t", odds("log_odds").alias("log_odds"), odds("trial_odds").alias("trial_odds"))
    out = every.select(key, "t", "g", "open").join(scored, "t", "left").checkpoint()

    # copies count once; only the counts of all texts together reach the driver, at most two for each step
    kinds = F.inline(F.array(*(F.struct(F.lit(x).alias("trial"), o.alias("odds")) for x, o in ((False, F.when(~F.col("open"), F.col("log_odds"))), (True, F.col("trial_odds"))))))
    step = F.least(F.lit(len(_EDGES) - 1), F.greatest(F.lit(0), F.ceil((F.col("odds") - float(_EDGES[0])) / STEP))).cast("int")
    counts = out.select("t", "g", "open", "log_odds", "trial_odds").dropDuplicates(["t", "g"]).select("g", kinds).where("odds is not null").groupBy("g", step.alias("step"), "trial").agg(F.count("*").alias("n"))
    enough = counts.where("trial").groupBy("g").agg(F.sum("n").alias("k")).where(F.col("k") >= FEWEST).select("g")
    pooled = np.zeros((2, len(_EDGES)))
    for r in counts.groupBy("step", "trial").agg(F.sum("n").alias("n")).collect():
        pooled[int(r["trial"]), r["step"]] = r["n"]
    default = best_bound(*pooled) if pooled.any() else BOUND
    # a language's counts are filled up with those of all texts, as many as PRIOR_TEXTS texts
    fill = pooled * PRIOR_TEXTS / np.maximum(1, pooled.sum(axis=1, keepdims=True))

    def bound(rows):
        both = fill.copy()
        np.add.at(both, (rows["trial"].to_numpy(dtype=np.int64), rows["step"].to_numpy(dtype=np.int64)), rows["n"].to_numpy())
        return rows[["g"]].head(1).assign(bound=best_bound(*both, start=default))

    found_ = counts.join(enough, "g", "left_semi").groupBy("g").applyInPandas(bound, "g string, bound double")
    limit = F.coalesce(*(F.when(F.col("g") == name, F.lit(value)) for name, value in (bounds or {}).items()), F.col("bound"), F.lit(default))
    out = out.join(found_, "g", "left")
    return out.select(key, "log_odds", F.coalesce(F.col("open") | (F.col("log_odds") < limit), F.lit(False)).alias("cut"))


def hash_text(t: str) -> int:
    """A 63-bit hash of a text that is the same on every executor."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1


def found(df: DataFrame) -> DataFrame:
    return truncation(spread(df)).where("cut").select("doc_id")


def rates(df: DataFrame, source: str = "source") -> DataFrame:
    """Texts, cut texts and their share per source; a null source is a group of its own."""
    one = df.select("doc_id", source).dropDuplicates(["doc_id"])
    return one.join(truncation(spread(df)), "doc_id").groupBy(source).agg(F.count("*").alias("n"), F.sum(F.col("cut").cast("bigint")).alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("share"))
