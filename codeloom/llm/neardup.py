"""Near-duplicate records with small edits (problem 1).

Method: improved consistent weighted sampling. A text is a multiset of shingles (runs of `shingle` words; of one word, where
similarity is stated over words); each shingle weighs its count times its smoothed inverse document frequency over all
texts, and every sample picks a shingle with the same probability in texts that weigh it alike, so two texts agree on a
sample with the probability of their weighted Jaccard similarity. Samples are cut into bands; texts that agree on a band
are candidates. A candidate pair is kept if its multisets' Jaccard similarity, weighted by counts, is at least t / (2 - t),
which is the same as twice the common shingles over the sum of both numbers being at least t, the `threshold`.

In a large group of copies the words that differ are the rare ones, and rare words weigh most, so some of its pairs
agree on no band. A second round finds these: every text joins the bands of its two neighbours of least hash, and texts that
share such a neighbour are compared.

Equal multisets are one class before anything is compared, so copies cost nothing. Frequencies are counted over all
classes in a hashed table of fixed size; that table (2 MB) is broadcast. A band with very many texts is cut into tiles, and
every tile is compared with itself and with each later one, so no pair with a common band is left out and no task
holds more than two tiles of a band. Candidates are tested with sketches of 64 bytes first, whose bound on the common
shingles is exact, and only those that pass meet with their whole multisets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.components import connected_components
from .common import cut, schema_of

#: Slots of the hashed document-frequency table; the bound of what is broadcast.
SLOTS = 1 << 18
BANDS, ROWS = 24, 4
#: Texts in a band beyond which it is cut into tiles of so many, and the parts in which its rows are told apart.
HOT_BAND, SALT = 256, 16
#: Bits of the filter on texts that are in some candidate pair; the bound of what is broadcast for it (2 MB).
FILTER_BITS = 1 << 24
#: Inverse frequencies rise up to this many times rarer than all texts.
RAREST = 1_000.0
#: Counters of a sketch, one byte each.
SKETCH = 64

#: A word and its count share a long: 56 bits of the word's hash, 8 bits of the count.
COUNT_BITS = 8
_CLASS = schema_of("id bigint, n int, c1 bigint, c2 bigint, words array<bigint>")
_SIGN = schema_of("id bigint, n int, bands array<bigint>, sketch binary")


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over unsigned integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and its offsets."""
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values, offsets - offsets[0]


def pack_counts(word: np.ndarray, tf: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed, owner), sorted within each owner. A count beyond 255 goes on in further words derived from the first, so
    that sums of minima over packed words are those over words."""
    most = (1 << COUNT_BITS) - 1
    parts, part = [], 0
    w, t, o = word.astype(np.uint64), tf, owner
    while len(w):
        now = np.minimum(t, most).astype(np.uint64)
        with np.errstate(over="ignore"):
            named = w if part == 0 else _mix(w + np.uint64(part))
        parts.append(((named & ~np.uint64(most)) | now, o))
        more = t > most
        w, t, o, part = w[more], t[more] - most, o[more], part + 1
    if not parts:
        return np.zeros(0, np.int64), owner
    p, o = np.concatenate([x for x, _ in parts]).astype(np.int64), np.concatenate([x for _, x in parts])
    order = np.lexsort((p, o))
    return p[order], o[order]


def unpack_counts(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and counts."""
    p = packed.astype(np.uint64)
    most = np.uint64((1 << COUNT_BITS) - 1)
    return (p & ~most).astype(np.int64), (p & most).astype(np.int64)


def _slots(words: np.ndarray) -> np.ndarray:
    return ((words.astype(np.uint64) >> np.uint64(COUNT_BITS)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _bags(min_words: int):
    """Word hashes in order -> distinct words with counts, and the class key of the multiset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = batch.column(1).is_valid()
            batch = batch.filter(keep)
            if not batch.num_rows:
                continue
            values, offsets = _lists(batch.column(1))
            n = np.diff(offsets)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((values, doc))
            v, d = values[order], doc[order]
            if not len(v):
                continue
            start = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (d[1:] != d[:-1])])
            word, owner = v[start], d[start]
            tf = np.diff(np.r_[start, len(v)]).astype(np.int64)
            with np.errstate(over="ignore"):
                key = _mix(word.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * tf.astype(np.uint64))
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                c1 = np.add.reduceat(key, first)
                c2 = np.add.reduceat(_mix(key ^ np.uint64(0xD6E8FEB86659FD93)), first)
            docs = owner[first]
            good = n[docs] >= min_words
            packed, owner = pack_counts(word, tf, owner)
            first = np.searchsorted(owner, docs)
            ends = np.r_[first[1:], len(packed)]
            mask = np.repeat(good, ends - first)
            lengths = np.r_[0, np.cumsum((ends - first)[good])].astype(np.int32)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[docs][good]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(n[docs][good].astype(np.int32)), pa.array(c1[good].astype(np.int64)), pa.array(c2[good].astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(lengths), pa.array(packed[mask], pa.int64())),
                ],
                schema=to_arrow_schema(_CLASS),
            )

    return run


def _signer(weights, bands: int, rows: int, seed: int):
    """Distinct words with counts -> band hashes, by consistent weighted sampling.

    A sample's value depends on (word, count) only, so it is computed once for each such pair of a batch; a text's
    sample is then the pair of least value, found by a segmented minimum over integers.
    """

    def uniform(base: np.ndarray, salt: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = _mix(base + np.uint64((salt * 0x9E3779B97F4A7C15 + seed) & 0xFFFFFFFFFFFFFFFF))
        return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = weights.value
        for batch in batches:
            packed, offsets = _lists(batch.column(2))
            if not len(packed):
                continue
            words, tfs = unpack_counts(packed)
            starts, counts = offsets[:-1], np.diff(offsets)
            full = counts > 0
            order = np.lexsort((tfs, words))
            w, t = words[order], tfs[order]
            new = np.r_[True, (w[1:] != w[:-1]) | (t[1:] != t[:-1])]
            pair = np.empty(len(w), np.int64)
            pair[order] = np.cumsum(new) - 1
            uw, ut = w[new].astype(np.uint64), t[new].astype(np.float64)
            weight = ut * idf[_slots(uw)]
            log_w = np.log(np.maximum(weight, 1e-12))
            base = _mix(uw)
            number = np.arange(len(uw), dtype=np.uint64)
            out = np.zeros((bands, int(full.sum())), np.uint64)
            seg = starts[full]
            for k in range(bands * rows):
                r = -np.log(uniform(base, 5 * k) * uniform(base, 5 * k + 1))
                log_c = np.log(-np.log(uniform(base, 5 * k + 2) * uniform(base, 5 * k + 3)))
                beta = uniform(base, 5 * k + 4)
                step = np.floor(log_w / r + beta)
                # a float's bits in an order of integers, and below them the pair's number, by which ties go: the least word hash
                bits = (log_c - r * (step - beta) - r).astype(np.float32).view(np.uint32)
                rising = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << np.uint64(32)
                won = (np.minimum.reduceat((rising | number)[pair], seg) & np.uint64(0xFFFFFFFF)).astype(np.int64)
                with np.errstate(over="ignore"):
                    sample = _mix(base[won] + step[won].astype(np.int64).astype(np.uint64))
                    out[k // rows] = _mix(out[k // rows] * np.uint64(31) + sample + np.uint64(k))
            with np.errstate(over="ignore"):
                out = _mix(out + np.arange(1, bands + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)
            flat = pa.array(np.ascontiguousarray(out.T).ravel(), pa.int64())
            ids = pa.array(batch.column(0).to_numpy(zero_copy_only=False)[full], pa.int64())
            n = pa.array(batch.column(1).to_numpy(zero_copy_only=False)[full].astype(np.int32))
            sketch = pa.array([x.tobytes() for x in sketches(words, tfs, counts[full])], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, n, pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * bands), flat), sketch], schema=to_arrow_schema(_SIGN))

    return run


def sketches(words: np.ndarray, tfs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of each text's words by their hash in SKETCH counters; 255 stands for that many or more."""
    out = np.zeros((len(counts), SKETCH), np.int64)
    slot = (_mix(words.astype(np.uint64)) >> np.uint64(58)).astype(np.int64) % SKETCH
    np.add.at(out, (np.repeat(np.arange(len(counts)), counts), slot), tfs)
    return np.minimum(out, 255).astype(np.uint8)


_PAIR = schema_of("a bigint, b bigint, similarity double")
_CANDIDATE = schema_of("a bigint, b bigint, na int, nb int")


def _sifter(threshold: float):
    """Candidates whose sketches allow the threshold: the sum of the lesser counters is at least the number of common words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH) for i in (4, 5))
            least = np.minimum(x, y)
            most = least.sum(axis=1, dtype=np.int64) + np.where((least == 255).any(axis=1), np.iinfo(np.int32).max, 0)
            ok = pa.array(2 * most >= threshold * (na.astype(np.int64) + nb) - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(ok) for c in batch.columns[:4]], schema=to_arrow_schema(_CANDIDATE))

    return run


def _verifier(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            (pa_, oa), (pb, ob) = (_lists(batch.column(i)) for i in (4, 5))
            (wa, ta), (wb, tb) = unpack_counts(pa_), unpack_counts(pb)
            common = np.zeros(len(a))
            for i in range(len(a)):
                x, y = wa[oa[i] : oa[i + 1]], wb[ob[i] : ob[i + 1]]
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                hit = y[at] == x
                common[i] = np.minimum(ta[oa[i] : oa[i + 1]][hit], tb[ob[i] : ob[i + 1]][at[hit]]).sum()
            sim = 2 * common / (na + nb)
            ok = sim >= threshold - 1e-12
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(sim[ok])], schema=to_arrow_schema(_PAIR))

    return run


def word_classes(df: DataFrame, key: str, text: str, min_words: int, shingle: int = 1) -> tuple[DataFrame, DataFrame]:
    """(members, classes): every key with its class, and per class its shingles and counts. A class is named by its least key."""
    words = F.transform(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[a-z0-9_]+"), F.lit(0)), lambda w: F.xxhash64(w))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), words.alias("w"))
    if shingle > 1:
        runs = F.transform(F.sequence(F.lit(0), F.size("w") - shingle), lambda i: F.xxhash64(F.slice("w", i + 1, F.lit(shingle))))
        rows = rows.select("id", F.when(F.size("w") >= shingle, runs).otherwise(F.lit([]).cast("array<bigint>")).alias("w"))
    rows = cut(rows.mapInArrow(_bags(min_words), _CLASS))
    classes = cut(rows.groupBy("c1", "c2").agg(F.min_by(F.struct("id", "n", "words"), "id").alias("r")).select("c1", "c2", "r.*"))
    members = rows.select("id", "c1", "c2").distinct().join(classes.select("c1", "c2", F.col("id").alias("rep")), ["c1", "c2"]).select("id", "rep")
    return members, classes


def frequencies(classes: DataFrame):
    """Smoothed inverse document frequencies by hashed word, over all classes. The fewer texts have a word, the less of its
    weight it gets: a word of few texts tells copies of one original apart, and one of a single text can be in no pair."""
    slot = F.expr(f"cast(shiftrightunsigned(word, {COUNT_BITS}) & {SLOTS - 1} as int)")
    counts = classes.select(F.explode("words").alias("word")).select(slot.alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).toPandas()
    total = max(1, classes.count())
    df = np.zeros(SLOTS)
    df[counts["slot"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy()
    df = np.maximum(df, 1.0)
    return np.log1p(np.minimum(total / df, RAREST)) * ((df - 1) / (df + 1) + 0.01)


def _band_pairs(keyed: DataFrame, ratio: float, tile: int) -> DataFrame:
    """Pairs (a, b, na, nb) of rows (id, n) with a common `band`, a < b. A band of more than `tile` rows is cut into tiles by id.

    Bands are counted by an aggregation; the rows of large ones are told apart in SALT parts each, so that no band passes
    through one task.
    """

    def close(x: str, y: str) -> Column:
        return 2 * F.least(x, y) >= ratio * (F.col(x) + F.col(y))

    salt = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SALT)).cast("int")
    large = keyed.groupBy("band").agg(F.count("*").alias("size")).where(F.col("size") > tile)
    large = cut(large.select("band", F.ceil(F.col("size") / tile).cast("int").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("s")))
    # with no large band, or few of them, this join is a broadcast by the planner's own size check
    tagged = keyed.withColumn("s", salt).join(large, ["band", "s"], "left")
    # set apart by band once, so that both sides of the join read the same exchange
    cold = tagged.where("m is null").select("band", "id", "n").repartition("band")
    y = cold.select("band", F.col("id").alias("id2"), F.col("n").alias("n2"))
    pairs = cold.join(y, "band").where((F.col("id") < F.col("id2")) & close("n", "n2"))
    # a row is one of tile t of m, by its hash; it meets the tiles (i, t) with i <= t from one side and (t, j) with j >= t from the other
    hot = tagged.where("m is not null").select("band", "id", "n", "m", F.pmod(F.xxhash64("id"), F.col("m")).cast("int").alias("t"))
    left = hot.select("band", "id", "n", F.col("t").alias("i"), F.explode(F.sequence("t", F.col("m") - 1)).alias("j"))
    right = hot.select("band", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("t").alias("j"), F.explode(F.sequence(F.lit(0), "t")).alias("i"))
    tiles = left.join(right, ["band", "i", "j"]).where(((F.col("i") < F.col("j")) | (F.col("id") < F.col("id2"))) & close("n", "n2"))
    first = F.col("id") < F.col("id2")
    ends = [F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), F.when(first, F.col("n")).otherwise(F.col("n2")).alias("na"), F.when(first, F.col("n2")).otherwise(F.col("n")).alias("nb")]
    return pairs.select(*ends).union(tiles.select(*ends)).distinct()


def _having(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of (id, ...) whose id may be among `ids`, told by a bitmap of fixed size (FILTER_BITS), so that a join ships few others."""
    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    filled = ids.select(slot.alias("s")).groupBy(F.expr("s div 64").cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("m")).toPandas()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[filled["w"].to_numpy(dtype=np.int64)] = filled["m"].to_numpy(dtype=np.int64)
    bitmap = df.sparkSession.sparkContext.broadcast(words.tobytes())
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint64)
        for batch in batches:
            s = batch.column(len(columns)).to_numpy(zero_copy_only=False)
            yield batch.select(list(range(len(columns)))).filter(pa.array((bits[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1) != 0))

    return df.select(*columns, slot.alias("_slot")).mapInArrow(run, df.schema)


def class_pairs(classes: DataFrame, threshold: float, bands: int = BANDS, rows: int = ROWS, seed: int = 7, complete: bool = True) -> DataFrame:
    """(a, b, similarity) of all pairs of classes that reach the threshold, a < b. `complete` adds the second round."""
    weights = classes.sparkSession.sparkContext.broadcast(frequencies(classes))
    signed = cut(classes.select("id", "n", "words").mapInArrow(_signer(weights, bands, rows, seed), _SIGN))
    sketch = signed.select("id", "sketch")

    def verified(candidates: DataFrame) -> DataFrame:
        near = candidates.join(sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_sifter(threshold), _CANDIDATE)
        near = cut(near)
        c = _having(classes.select("id", "words"), near.select(F.explode(F.array("a", "b")).alias("id")))
        both = near.join(c.toDF("a", "wa"), "a").join(c.toDF("b", "wb"), "b").select("a", "b", "na", "nb", "wa", "wb")
        return both.mapInArrow(_verifier(threshold), _PAIR)

    links = cut(verified(_band_pairs(signed.select("id", "n", F.explode("bands").alias("band")), threshold, HOT_BAND)))
    if not complete:
        return links
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("to")), F.struct(F.col("b").alias("id"), F.col("a").alias("to")))).alias("e")).select("e.*")
    ranked = F.struct(F.xxhash64("to", F.lit(seed)).alias("h"), "to")
    # a text counts as its own neighbour, and so joins those who chose it
    least = ends.groupBy("id").agg(F.min(ranked).alias("x"), F.max(ranked).alias("z"))
    hub = F.explode(F.array("id", "x.to", "z.to")).alias("band")
    stars = least.select("id", hub).distinct().join(classes.select("id", "n"), "id").select("id", "n", "band")
    more = _band_pairs(stars, threshold, HOT_BAND).join(links.select("a", "b"), ["a", "b"], "left_anti")
    return links.unionByName(verified(more))


def near_duplicate_pairs(df: DataFrame, key: str = "entity_id", text: str = "content", min_words: int = 25, threshold: float = 0.8, shingle: int = 1) -> DataFrame:
    """(a, b, similarity) of all pairs of keys, a < b, copies included.

    Null texts and texts of fewer words take part in no pair; repeated rows of a key count once.
    """
    members, classes = word_classes(df, key, text, min_words, shingle)
    members = cut(members)
    links = class_pairs(classes, threshold).select(F.col("a").alias("ra"), F.col("b").alias("rb"), "similarity")
    m1, m2 = members.select(F.col("id").alias("x"), F.col("rep").alias("ra")), members.select(F.col("id").alias("y"), F.col("rep").alias("rb"))
    across = links.join(m1, "ra").join(m2, "rb").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    copies = members.groupBy("rep").agg(F.count("*").alias("k")).where("k > 1").join(members, "rep").select("rep", "id")
    within = copies.join(copies.select("rep", F.col("id").alias("id2")), "rep").where("id < id2").select(F.col("id").alias("a"), F.col("id2").alias("b"), F.lit(1.0).alias("similarity"))
    return across.union(within)


def near_duplicate_groups(df: DataFrame, key: str = "entity_id", text: str = "content", min_words: int = 25, threshold: float = 0.8, shingle: int = 1) -> DataFrame:
    """(key, group_id, class_id, links): every key with enough words, the group of edited copies it belongs to (named by
    its least key; alone in it if nothing is similar), the class of exact copies, and the number of other classes linked to it.
    """
    members, classes = word_classes(df, key, text, min_words, shingle)
    links = cut(class_pairs(classes, threshold))
    comps = connected_components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    out = members.join(comps.select(F.col("id").alias("rep"), "component"), "rep", "left").join(degree, "rep", "left")
    return out.select(F.col("id").alias(key), F.coalesce("component", "rep").alias("group_id"), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))
