"""Evaluation texts leaking into training text (problem 8).

Method: rare n-gram seeds join training passages to test items, then Smith-Waterman
alignment scores the joined pairs. An exact check of the rule (runs of at least
``min_words`` words of which at most one in ``per_change`` is changed) follows on the
pairs that score.

The corpus is read once, however many items there are: a filter over the items' seeds
leaves the passages where several of them stand close together, as word hashes; those
are joined to the seeds by hash. How many passages hold a seed is counted over the
whole corpus, and a common seed that stands alone among rare ones joins nothing: the
rare ones beside it do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingloom.functions.hashing import mix, ngram_hashes, slices, word_hashes
from filingloom.llm.common import keyed, schema_of, unkeyed
from filingloom.session import materialize

#: Bits of the filter over the items' seeds: BITS_A_SEED for each, within these bounds
#: (16 MB at most; beyond 2 million seeds more of other passages go on to the join).
BITS_A_SEED, LEAST_BITS, MOST_BITS = 64, 16, 27
#: A seed in more passages than this is a common one.
COMMON = 1000


def word_form(c: Column) -> Column:
    """Lower-case words with single blanks between: case, punctuation and white space do not count."""
    return F.lower(F.regexp_replace(F.translate(c, "'’", ""), r"[^\p{L}\p{N}\p{M}]+", " "))


def scores(items: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Smith-Waterman scores (match 1, mismatch -1, gap -1) of many pairs at once.

    ``items`` is (pairs, words) and ``texts`` (pairs, words), padded with 0 and 1,
    which match nothing. A row of the matrix is computed for all pairs together;
    gaps along the row come from a running maximum.
    """
    n, width = texts.shape
    ramp = np.arange(width, dtype=np.int16)
    above = np.zeros((n, width), np.int16)
    best = np.zeros(n, np.int16)
    diagonal = np.zeros((n, width), np.int16)
    for i in range(items.shape[1]):
        diagonal[:, 1:] = above[:, :-1]
        diagonal[:, 0] = 0
        own = diagonal + np.where(texts == items[:, i : i + 1], np.int16(1), np.int16(-1))
        np.maximum(own, above - 1, out=own)
        np.maximum(own, 0, out=own)
        own += ramp
        np.maximum.accumulate(own, axis=1, out=own)
        own -= ramp
        np.maximum(best, own.max(1), out=best)
        above = own
    return best


def few_changes(min_words: int, per_change: int) -> int:
    """Changes that a shortest run within the rule can have."""
    return (2 * min_words - 1) // per_change + 1


def leaks(items: np.ndarray, texts: np.ndarray, min_words: int, per_change: int, changes: int | None = None) -> np.ndarray:
    """Does a pair hold a run of at least ``min_words`` item words, in order, with at
    most one change in ``per_change`` words? A change replaces, drops or adds a word;
    a run begins and ends with words that are kept.

    A long run holds a shorter one that keeps the rule with few changes (halving it,
    one half does, but for a change at the cut), so ``few_changes`` decide.
    """
    n, width = texts.shape
    changes = few_changes(min_words, per_change) if changes is None else changes
    none = np.int16(-999)
    above = [np.zeros((n, width), np.int16) for _ in range(changes + 1)]
    found = np.zeros(n, bool)
    for i in range(items.shape[1]):
        match = texts == items[:, i : i + 1]
        own: list[np.ndarray] = []
        for c in range(changes + 1):
            diagonal = np.zeros((n, width), np.int16)
            diagonal[:, 1:] = above[c][:, :-1]
            run = np.where(match, diagonal + 1, np.int16(0))
            found |= (run >= max(min_words, c * per_change)).any(1)
            if c:
                changed = np.zeros((n, width), np.int16)
                changed[:, 1:] = above[c - 1][:, :-1]
                changed = np.where(changed > 0, changed + 1, none)  # replaced
                np.maximum(run, changed, out=run)
                np.maximum(run, np.where(above[c - 1] > 0, above[c - 1] + 1, none), out=run)  # dropped
                run[:, 1:] = np.maximum(run[:, 1:], own[c - 1][:, :-1])  # added
                np.maximum(run, own[c - 1], out=run)
            own.append(run)
        above = own
    return found


def spaced_leaks(items: np.ndarray, texts: np.ndarray, min_words: int, per_change: int) -> np.ndarray:
    """Like ``leaks``, but also of any ``per_change`` words of the run in a row at most one
    is changed: between two changes stand at least ``per_change`` - 1 kept words.

    A run of 2 * per_change words can have two such changes, so beside those only
    shorter runs with one change count. A state is how many words were kept since the last change (all beyond the needed
    ones are one state, and so is a run without a change so far); its value is the
    longest run that ends there.
    """
    if min_words >= 2 * per_change:
        raise ValueError("runs shorter than two times per_change only")
    n, width = texts.shape
    last = per_change - 1
    none = np.int16(-9999)

    def after(x: np.ndarray) -> np.ndarray:
        out = np.full((n, width), none, np.int16)
        out[:, 1:] = x[:, :-1]
        return out

    kept = [np.full((n, width), none, np.int16) for _ in range(last + 1)]  # kept[0]: just changed
    found = leaks(items, texts, min_words, per_change, 1)
    for i in range(items.shape[1]):
        match = texts == items[:, i : i + 1]
        own = [np.full((n, width), none, np.int16) for _ in range(last + 1)]
        for k in range(last + 1):
            to = min(k + 1, last)
            np.maximum(own[to], np.where(match, after(kept[k]) + np.int16(1), none), out=own[to])
        np.maximum(own[last], np.where(match, np.int16(1), none), out=own[last])
        for k in range(1, last + 1):
            found |= (own[k] >= 2 * per_change).any(1)
        free = kept[last]  # a change may follow: replaced, dropped from the text, or added to it
        own[0] = np.maximum(np.maximum(after(free), free) + np.int16(1), after(own[last]))
        kept = own
    return found


def surviving_seeds(min_words: int, per_change: int, seed_words: int, spaced: bool) -> int:
    """Seeds that every run within the rule holds at least."""
    if not spaced:
        return min(n - c - (c + 1) * (seed_words - 1) for n in range(min_words, 4 * min_words) for c in [n // per_change])
    least = min_words
    for first in range(per_change):  # places of the changes, per_change apart
        cuts = [-1, *range(first, min_words, per_change), min_words]
        least = min(least, sum(max(0, b - a - 1 - (seed_words - 1)) for a, b in zip(cuts, cuts[1:])))
    return least


def _item_parts(items: DataFrame, item_key: str, parts: list[str], min_words: int) -> DataFrame:
    """(iid, item_id, part, form): the item parts long enough to leak, numbered."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), word_form(F.col(f"`{p}`")).alias("form")) for p in parts]))
    listed = items.select(F.col(f"`{item_key}`").alias("item_id"), each.alias("_x")).select("item_id", "_x.part", F.trim("_x.form").alias("form"))
    long = listed.where(F.size(F.split("form", " ")) >= min_words)
    return materialize(long.select(F.monotonically_increasing_id().alias("iid"), "item_id", "part", "form"), "items")


def _item_seeds(listed: DataFrame, seed_words: int) -> tuple[DataFrame, DataFrame]:
    """(iid, h, at) of the items' seeds and (iid, item) with their words' hashes."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, offsets in slices(batch.column(1)):
                rows, hashed = word_hashes(raw, offsets)
                r, g, i = ngram_hashes(rows, hashed, seed_words)
                begins = np.searchsorted(rows, np.arange(len(offsets) - 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + r)), pa.array(g.view(np.int64)), pa.array((i - begins[r]).astype(np.int32))], names=["iid", "h", "at"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, offsets in slices(batch.column(1)):
                rows, hashed = word_hashes(raw, offsets)
                ends = np.concatenate([np.searchsorted(rows, np.arange(len(offsets) - 1)), [len(rows)]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(offsets) - 1), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashed.view(np.int64)))], names=["iid", "item"])

    base = listed.select("iid", "form")
    return base.mapInArrow(seeds, "iid long, h long, at int"), base.mapInArrow(words, "iid long, item array<long>")


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a seed in the filter."""
    shift = np.uint64(64 - bits)
    return (h >> shift).astype(np.int64), (mix(h) >> shift).astype(np.int64)


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A filter that holds every seed: bits set by each task, put together by word."""
    n = seeds.count()
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, n * BITS_A_SEED)))))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((1 << bits) // 8, np.uint8)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(own, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
        words = own.view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(words[at])], names=["w", "m"])

    rows = seeds.select("h").mapInArrow(mark, "w int, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()  # at most 2**MOST_BITS bits
    out = np.zeros((1 << bits) // 64, np.int64)
    out[rows.column("w").to_numpy()] = rows.column("m").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool) if bits <= 20 else out.view(np.uint8)


def _held(marks: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the filter holds."""
    if marks.dtype == bool:
        a, b = _places(h, int(math.log2(len(marks))))
        return marks[a] & marks[b]
    a, b = _places(h, int(math.log2(len(marks))) + 3)
    return ((marks[a >> 3] >> (a & 7).astype(np.uint8)) & (marks[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def passages(corpus: DataFrame, keys: list[str], text: str, marks: np.ndarray, seed_words: int, least: int, reach: int) -> DataFrame:
    """(keys, rid, words, hits): the passages of the corpus where at least ``least``
    n-grams of the filter follow each other within ``reach`` words, with as many words
    before and after. ``words`` are word hashes, ``hits`` the n-grams and their places."""
    base = keyed(corpus, keys, _t=text).where(F.length("_t") >= 2 * (least + seed_words) - 1).withColumn("_t", word_form(F.col("_t")))
    schema = schema_of(corpus, keys, "rid long, words array<long>, hits array<struct<h: bigint, pos: int>>")
    shared = corpus.sparkSession.sparkContext.broadcast(marks)
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        rid = (task.partitionId() if task else 0) << 40
        for batch in batches:
            for first, raw, offsets in slices(batch.column(width)):
                rows, hashed = word_hashes(raw, offsets)
                r, grams, start = ngram_hashes(rows, hashed, seed_words)
                hit = np.flatnonzero(_held(shared.value, grams))
                if not len(hit):
                    continue
                row, at = r[hit], start[hit]
                fresh = np.ones(len(hit), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (at[1:] - at[:-1] > reach)
                begin = np.flatnonzero(fresh)
                size = np.diff(np.append(begin, len(hit)))
                use = np.flatnonzero(size >= least)
                if not len(use):
                    continue
                begin, size = begin[use], size[use]
                owner = row[begin]
                low = np.maximum(np.searchsorted(rows, owner, "left"), at[begin] - reach)
                high = np.minimum(np.searchsorted(rows, owner, "right"), at[begin + size - 1] + seed_words + reach)
                spans = [hashed[a:b] for a, b in zip(low, high)]
                inside = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                hits = pa.StructArray.from_arrays([pa.array(grams[hit[inside]].view(np.int64)), pa.array((at[inside] - np.repeat(low, size)).astype(np.int32))], names=["h", "pos"])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).take(pa.array(first + owner)) for i in range(width)), pa.array(rid + np.arange(len(use))),
                        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(high - low)).astype(np.int32)), pa.array(np.concatenate(spans).view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), hits),
                    ], names=schema.names,
                )
                rid += len(use)

    return base.mapInArrow(run, schema)


def used_seeds(seeds: DataFrame, hits: DataFrame, span: int, common: int) -> DataFrame:
    """(iid, h, at, weight) of the seeds that join: those that occur, less each common
    one without another common one within ``span`` places of its item. The seeds beside
    one left out weigh double, for it and for themselves."""
    often = hits.groupBy("h").agg(F.count("*").alias("_n"))
    known = seeds.join(often, "h", "left").withColumn("_c", (F.coalesce("_n", F.lit(0)) > common).cast("int"))
    near = Window.partitionBy("iid").orderBy("at").rangeBetween(-span, span)
    alone = known.withColumn("_out", (F.col("_c") == 1) & (F.sum("_c").over(near) == 1))
    weighed = alone.withColumn("weight", F.lit(1) + F.max(F.col("_out").cast("int")).over(near))
    return weighed.where(~F.col("_out") & F.col("_n").isNotNull()).select("iid", "h", "at", "weight")


def find_leaks(
    corpus: DataFrame, keys: list[str], text: str, items: DataFrame, item_key: str, parts: list[str], min_words: int = 15, per_change: int = 8, seed_words: int = 5, spaced: bool = False, common: int = COMMON
) -> DataFrame:
    """One row per corpus row, passage and leaked item part: keys, ``item_id``, ``part``, ``score``.

    ``parts`` are the text columns of ``items``. Null and empty texts and parts
    leak nothing; an item part shorter than ``min_words`` cannot leak. Repeated
    corpus rows or items are reported each. Extra columns are ignored.

    A change replaces, drops or adds a word. At most one in ``per_change``
    words of a run is changed, with ``spaced`` also of any ``per_change`` words in a row. Every run within the rule holds ``surviving_seeds`` unchanged seeds or
    more, so no leak is lost.
    """
    least = surviving_seeds(min_words, per_change, seed_words, spaced)
    if least < 1:
        raise ValueError(f"seeds of {seed_words} words can miss runs of {min_words} words")
    shortest = min_words + per_change if spaced else 4 * min_words  # words that hold a shortest run
    listed = _item_parts(items, item_key, parts, min_words)
    seeds, words = _item_seeds(listed, seed_words)
    seeds = materialize(seeds, "seeds")
    found = materialize(passages(corpus, keys, text, seed_filter(seeds), seed_words, least, shortest), "passages")
    hits = found.select("rid", F.inline("hits"))
    used = materialize(used_seeds(seeds, hits, min_words - seed_words, common), "used_seeds")
    pairs = hits.join(used, "h").groupBy("rid", "iid").agg(F.sum("weight").alias("_w"), F.min(F.col("pos") - F.col("at")).alias("low"), F.max(F.col("pos") - F.col("at")).alias("high"))
    pairs = pairs.where(F.col("_w") >= least).select("rid", "iid", "low", "high")
    joined = pairs.join(found.drop("hits"), "rid").join(words, "iid").join(listed.select("iid", "item_id", "part"), "iid")
    return unkeyed(_aligned(joined, len(keys), schema_of(corpus, keys, "part string, score int"), items.schema[item_key].dataType, min_words, per_change, spaced), keys)


def _aligned(joined: DataFrame, width: int, schema: T.StructType, item_type: T.DataType, min_words: int, per_change: int, spaced: bool) -> DataFrame:
    schema = T.StructType([*schema.fields[:width], T.StructField("item_id", item_type), *schema.fields[width:]])
    drift = 4 if spaced else few_changes(min_words, per_change)
    floor = min(n - 2 * (math.ceil(n / per_change) if spaced else n // per_change) for n in range(min_words, 4 * min_words))
    rule = spaced_leaks if spaced else leaks
    names = [f.name for f in schema.fields[:width]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, items = batch.column("words"), batch.column("item")
            low, high = batch.column("low").to_numpy(), batch.column("high").to_numpy()
            tasks = []
            for j in range(batch.num_rows):
                x, y = items[j].values.to_numpy().view(np.uint64), texts[j].values.to_numpy().view(np.uint64)
                y = y[max(0, low[j] - drift) : high[j] + len(x) + drift]
                if len(y) >= min_words - drift:
                    tasks.append((j, x, y))
            tasks.sort(key=lambda t: (len(t[1]), len(t[2])))
            at, score, k = [], [], 0
            while k < len(tasks):
                # pairs of like size together, as many as fit into a table of bounded size
                part = tasks[k : k + max(1, min(256, 2_000_000 // len(tasks[min(k + 255, len(tasks) - 1)][2])))]
                k += len(part)
                x, y = np.zeros((len(part), max(len(t[1]) for t in part)), np.uint64), np.ones((len(part), max(len(t[2]) for t in part)), np.uint64)
                for i, (_, a, b) in enumerate(part):
                    x[i, : len(a)], y[i, : len(b)] = a, b
                got = scores(x, y)
                good = np.flatnonzero(got >= floor)
                if len(good):
                    good = good[rule(x[good], y[good], min_words, per_change)]
                    at += [part[i][0] for i in good]
                    score += [int(got[i]) for i in good]
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(index) for n in names), batch.column("item_id").take(index), batch.column("part").take(index), pa.array(score, pa.int32())], names=schema.names)

    return joined.select(*names, "low", "high", "words", "item", "item_id", "part").mapInArrow(run, schema)
