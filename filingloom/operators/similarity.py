"""Exact similarity joins of texts on word shingles, without all pairs.

Texts become sets of 64-bit shingle hashes, a slice of Arrow text at a time. Two sets
with the needed Jaccard index share some of their rarest shingles, in one order for
all sets, so only those rarest ones (a prefix) are joined. The order comes from
counters over all texts, as many as the input asks for; what the counters say changes
the work, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingloom.functions.hashing import mix, ngram_hashes, slices, word_hashes
from filingloom.session import materialize

#: The shingle counters: one for each BYTES_A_COUNTER of the planner's estimate of the
#: input, within these bounds. The table is broadcast, two bytes a counter: 4 MB at most.
BYTES_A_COUNTER, LEAST_BITS, MOST_BITS = 32, 18, 21
#: Steps of the counters' logarithmic scale per doubling.
STEPS = 6
#: Shingles that a candidate pair shares among its rarest ones.
SHARED = 3
#: Shingles with more holders than RUNS are joined by runs, and with more than SPLIT in
#: pieces of about that many holders.
RUNS, SPLIT = 64, 4096
#: Groups of the vectors of group counts.
GROUPS = 256


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, row of each shingle, hash, rows) per slice, distinct within a row
    and sorted by row and hash. A text of fewer than ``n`` words has one shingle,
    made of all its words; a text without words has none."""
    for first, raw, offsets in slices(column):
        rows, words = word_hashes(raw, offsets)
        r, h, _ = ngram_hashes(rows, words, n)
        count = np.bincount(rows, minlength=len(offsets) - 1)
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            ends = np.cumsum(count)
            with np.errstate(over="ignore"):
                own = np.array([np.bitwise_xor.reduce(words[ends[i] - count[i] : ends[i]] * np.arange(3, 2 * count[i] + 3, 2, dtype=np.uint64)) for i in short], np.uint64)
            r, h = np.concatenate([r, short]), np.concatenate([h, own])
        order = np.lexsort((h, r))
        r, h = r[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        yield first, r[new], h[new], len(offsets) - 1


def sets_of(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted shingle set of each text."""
    out: list[np.ndarray] = []
    for _, r, h, rows in shingle_sets(texts, n):
        out += np.split(h, np.searchsorted(r, np.arange(1, rows)))
    return out


def text_classes(df: DataFrame, key: str, text: str, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """(representatives: _k, _t; membership: rep, member for texts stored more than once).

    Equal texts are told by 128-bit hashes, which move instead of them; the only texts
    that move are those of the representatives of repeated texts, whatever the number
    of copies. The joins with the table of repeated hashes are plain ones: Spark
    broadcasts it as long as its files are small. Null keys and texts under
    ``min_chars`` take no part.
    """
    base = df.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t")).where(f"_k is not null and length(_t) >= {int(min_chars)}")
    hashed = base.select("_k", "_t", F.xxhash64("_t").alias("_a"), F.xxhash64(F.lit(11), "_t").alias("_b"))
    marks = materialize(hashed.select("_k", "_a", "_b"), "marks")
    again = marks.groupBy("_a", "_b").agg(F.min("_k").alias("rep"), F.count("*").alias("_n")).where("_n > 1").select("_a", "_b", "rep")
    again = materialize(again, "copies")
    single = hashed.join(again, ["_a", "_b"], "left_anti").select("_k", "_t")
    first = hashed.join(again.withColumnRenamed("rep", "_k"), ["_a", "_b", "_k"], "left_semi")
    first = materialize(first.groupBy("_a", "_b", "_k").agg(F.first("_t").alias("_t")), "representatives")
    members = marks.join(again, ["_a", "_b"]).select("rep", F.col("_k").alias("member")).distinct()
    return single.unionByName(first.select("_k", "_t")), materialize(members, "members")


def counter_bits(df: DataFrame) -> int:
    """How many counters (a power of two) an input of the planner's estimated size gets."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, size / BYTES_A_COUNTER)))))


def frequencies(reps: DataFrame, n: int) -> np.ndarray:
    """How often the shingles of each counter occur over all texts, on a logarithmic
    scale (STEPS * log2(1 + count)).

    The counts add up in each task, then per counter; what comes to the driver is the
    table of at most 2**MOST_BITS counters.
    """
    bits = counter_bits(reps)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, _, h, _ in shingle_sets(batch.column(0), n):
                table += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=len(table))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at])], names=["bucket", "n"])

    counted = reps.select("_t").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = counted.select("bucket", F.round(STEPS * F.log2(F.col("n") + 1)).cast("short").alias("level")).toArrow()
    table = np.zeros(1 << bits, np.int16)
    table[rows.column("bucket").to_numpy()] = rows.column("level").to_numpy()
    return table


def _counts(levels: np.ndarray) -> np.ndarray:
    return np.exp2(levels / STEPS) - 1


#: How an element of a prefix that many texts hold is joined: with the elements before
#: and after it, its place, and its side (1 left, 2 right); null for the rest.
RUN = T.StructType([T.StructField("prev", T.LongType()), T.StructField("next", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("side", T.IntegerType())])


def prefixes(reps: DataFrame, n: int, threshold: float, table: np.ndarray) -> DataFrame:
    """(g, k, n, run): the rarest shingles of each text, and the size of its set.

    Of a set of that size a partner shares at least need = ceil(threshold * size);
    the first SHARED common shingles lie among the first size - need + SHARED of each.
    ``g`` is what is joined: the shingle, and for one with more than SPLIT holders also
    a piece: on the left side the text's own one, on the right side each.
    """
    shared = reps.sparkSession.sparkContext.broadcast(table)
    schema = T.StructType([T.StructField("g", T.LongType()), T.StructField("k", reps.schema["_k"].dataType), T.StructField("n", T.IntegerType()), T.StructField("run", RUN)])
    run_type = pa.struct([("prev", pa.int64()), ("next", pa.int64()), ("pos", pa.int32()), ("side", pa.int32())])
    shift = np.uint64(64 - int(math.log2(len(table))))
    noise = float(np.median(_counts(table[table > 0]))) if (table > 0).any() else 0.0

    def rows_of(keys: pa.Array, at: np.ndarray, g: np.ndarray, size: np.ndarray, run: tuple[np.ndarray, ...] | None) -> pa.RecordBatch:
        runs = pa.nulls(len(at), run_type) if run is None else pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(run, run_type)], fields=list(run_type))
        return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), keys.take(pa.array(at)), pa.array(size.astype(np.int32)), runs], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            for first, r, h, rows in shingle_sets(batch.column(1), n):
                if not len(h):
                    continue
                size = np.bincount(r, minlength=rows)
                level = levels[(h >> shift).astype(np.int64)]
                order = np.lexsort((h, level, r))
                begin = np.cumsum(size) - size
                place = np.arange(len(h)) - begin[r]
                need = np.ceil(threshold * size - 1e-9).astype(np.int64)
                use = place < (size - need + np.minimum(SHARED, need))[r]
                rr, hh, pos = r[use], h[order][use], place[use]
                over = _counts(level[order][use]) - 2 * noise
                hot = over > RUNS
                yield rows_of(batch.column(0), first + rr[~hot], hh[~hot], size[rr[~hot]], None)
                if not hot.any():
                    continue
                beside = np.zeros(len(hh), bool)  # the element before is a hot one of the same text
                beside[1:] = hot[1:] & hot[:-1] & (rr[1:] == rr[:-1])
                prev, following = np.zeros(len(hh), np.int64), np.zeros(len(hh), np.int64)
                signed = hh.view(np.int64)
                prev[1:][beside[1:]] = signed[:-1][beside[1:]]
                following[:-1][beside[1:]] = signed[1:][beside[1:]]
                pieces = np.maximum(1, np.ceil(over / SPLIT)).astype(np.int64)
                own = (mix(h[order][begin[r]][use]) % pieces.astype(np.uint64)).astype(np.int64)
                i = np.flatnonzero(hot)
                each = np.repeat(i, pieces[i])
                piece = np.arange(len(each)) - np.repeat(np.cumsum(pieces[i]) - pieces[i], pieces[i])
                for side, at, part in ((1, i, own[i]), (2, each, piece)):
                    with np.errstate(over="ignore"):
                        g = mix(hh[at] + (part.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
                    yield rows_of(batch.column(0), first + rr[at], g, size[rr[at]], (prev[at], following[at], pos[at], np.full(len(at), side)))

    return reps.select("_k", "_t").mapInArrow(run, schema)


def candidates(prefix: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: pairs sharing enough of their rarest shingles, sizes within reach.

    Holders are not capped. The texts of one template share long runs of shingles;
    such a run is counted by its ends (places after the last less places of the first,
    on both sides), so a pair takes two rows a run through the aggregate, not one a
    shingle. Both sides use the same columns, so they read one and the same exchange.
    """

    def side(name: str) -> DataFrame:
        return prefix.select("g", F.col("k").alias(name), F.col("n").alias(f"n{name}"), F.col("run").alias(f"r{name}"))

    def differ(field: str) -> Column:
        x, y = F.col(f"ra.{field}"), F.col(f"rb.{field}")
        return (x == 0) | (x != y)

    sides = F.coalesce("ra.side", F.lit(0)) + 3 * F.coalesce("rb.side", F.lit(0))
    both = side("a").join(side("b"), "g").where((F.col("a") < F.col("b")) & sides.isin(0, 7) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9))
    starts, ends = differ("prev"), differ("next")
    places = F.col("ra.pos") + F.col("rb.pos")
    part = F.when(F.col("ra").isNull(), 2).otherwise(F.when(ends, places + 2).otherwise(0) - F.when(starts, places).otherwise(0))
    kept = both.where(F.col("ra").isNull() | starts | ends).select("a", "b", "na", "nb", part.alias("part"))
    need = F.least(F.lit(SHARED), F.ceil(F.min("na") * threshold - 1e-9), F.ceil(F.min("nb") * threshold - 1e-9))
    return kept.groupBy("a", "b").agg(F.sum("part").alias("c"), need.alias("need")).where("c >= 2 * need").select("a", "b")


def group_counts(shingles: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """How many of the shingles hash to each group."""
    return np.bincount((shingles % np.uint64(groups)).astype(np.int64), minlength=groups)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    """Summed minima of two vectors of group counts: no fewer than the common shingles."""
    return int(np.minimum(a, b).sum())


def within_bound(pairs: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b) of the pairs whose vectors of group counts leave the threshold in reach:
    two short vectors a pair move, no text. A count over 65,535 counts as without bound."""
    key = texts.schema["_k"].dataType.simpleString()

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = sets_of(batch.column("_t"), n)
            counts = [group_counts(x) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_k"), pa.array([len(x) for x in sets], pa.int32()), pa.array([None if c.max() > 65_535 else c.astype(np.uint16).tobytes() for c in counts], pa.binary())], names=["_k", "_size", "_v"]
            )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            va, vb = batch.column("va").to_pylist(), batch.column("vb").to_pylist()
            reach = np.array([total[i] if x is None or y is None else overlap_bound(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)) for i, (x, y) in enumerate(zip(va, vb))], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(reach >= threshold / (1 + threshold) * total - 1e-9))

    vectors = materialize(texts.mapInArrow(points, f"_k {key}, _size int, _v binary"), "vectors")
    left, right = vectors.toDF("a", "na", "va"), vectors.toDF("b", "nb", "vb")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "va", "vb").mapInArrow(keep, pairs.select("a", "b").schema)


def verified(pairs: DataFrame, reps: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b, similarity) of the candidate pairs that reach the threshold, exactly.

    Pairs that the bound on the overlap rules out go first; only the texts of those
    that are left move.
    """
    pairs = materialize(pairs, "pairs")
    used = materialize(pairs.select(F.explode(F.array("a", "b")).alias("_k")).distinct(), "used")
    texts = materialize(reps.join(used, "_k", "left_semi").select("_k", "_t"), "texts")
    pairs = materialize(within_bound(pairs, texts, n, threshold), "pairs")
    left = materialize(pairs.select(F.explode(F.array("a", "b")).alias("_k")).distinct(), "left")
    texts = texts.join(left, "_k", "left_semi")
    both = pairs.join(texts.select(F.col("_k").alias("a"), F.col("_t").alias("ta")), "a").join(texts.select(F.col("_k").alias("b"), F.col("_t").alias("tb")), "b")
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"], T.StructField("similarity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sims = [], []
            for i, (x, y) in enumerate(zip(sets_of(batch.column("ta"), n), sets_of(batch.column("tb"), n))):
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common and common >= threshold * (len(x) + len(y) - common) - 1e-9:
                    keep.append(i)
                    sims.append(common / (len(x) + len(y) - common))
            index = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(index), batch.column("b").take(index), pa.array(sims, pa.float64())], names=schema.names)

    return both.select("a", "b", "ta", "tb").mapInArrow(run, schema).where("a <> b").distinct()


def similar_pairs(reps: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b, similarity) of all pairs of ``reps`` (_k, _t) that reach the threshold."""
    if not 0.5 <= threshold <= 1:
        raise ValueError("threshold must be in [0.5, 1]")
    table = frequencies(reps, n)
    return verified(candidates(prefixes(reps, n, threshold, table), threshold), reps, n, threshold)
