"""Exact copies and near-duplicates of documents.

The full texts never take part in a self-join: candidates carry a key and hashes.
Copies are one class from the start, under their smallest key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.functions.hashing import mix, ngram_hashes, slices, word_hashes
from filingloom.operators import similarity
from filingloom.session import materialize


def exact_copies(df: DataFrame, key: str, text: str) -> DataFrame:
    """``content_hash``, ``copies``, ``first_key`` of texts that occur more than once."""
    hashed = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.sha2(text, 256).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("_k").alias("first_key")).where("copies > 1")


def copy_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ``class_id``): every row with the smallest key of its equal texts."""
    hashed = df.where(F.col(text).isNotNull()).select(F.col(key).alias(key), F.sha2(text, 256).alias("_h"))
    first = hashed.groupBy("_h").agg(F.min(key).alias("class_id"))
    return hashed.join(first, "_h").select(key, "class_id")


def signatures(reps: DataFrame, num_perm: int, shingle: int) -> DataFrame:
    """(_k, sig): MinHash signatures of the shingles, one multiply-xor
    permutation of the 64-bit hash per position, for all texts of a slice at once."""
    rng = np.random.default_rng(1)
    a = rng.integers(1, 2**63, num_perm, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, num_perm, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for first, raw, offsets in slices(batch.column(1), 1 << 18):
                rows, words = word_hashes(raw, offsets)
                r, h, _ = ngram_hashes(rows, words, shingle)
                lacking = np.setdiff1d(np.unique(rows), r)
                if len(lacking):  # fewer words than a shingle: the whole text is one
                    own = np.array([np.bitwise_xor.reduce(mix(words[rows == i] + np.arange((rows == i).sum(), dtype=np.uint64))) for i in lacking], np.uint64)
                    r, h = np.concatenate([r, lacking]), np.concatenate([h, own])
                order = np.argsort(r, kind="stable")
                r, h = r[order], h[order]
                have, begin = np.unique(r, return_index=True)
                if not len(have):
                    continue
                sig = np.empty((len(have), num_perm), np.int64)
                with np.errstate(over="ignore"):
                    for p in range(num_perm):
                        sig[:, p] = np.minimum.reduceat((h ^ b[p]) * a[p], begin).view(np.int64)
                flat = pa.array(sig.ravel())
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(first + have)), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, num_perm, dtype=np.int32)), flat)], names=["_k", "sig"])

    kind = reps.schema["_k"].dataType.simpleString()
    return reps.mapInArrow(run, f"_k {kind}, sig array<long>")


def band_candidates(signed: DataFrame, bands: int, rows: int, split: int = 4096) -> DataFrame:
    """(a, b), a < b: texts that agree on all rows of a band. Only keys and hashes move.

    A pair that agrees on several bands in a row is made at the first of them. Buckets
    with more than about ``split`` texts (seen in a sample of the texts; it decides on
    the balance of the tasks, never on a pair) are joined in pieces: each text has one
    piece on the left and stands in all of them on the right, so no task joins a whole
    hot bucket.
    """
    every = max(1, split // 64)
    hashes = F.array(*[F.xxhash64(F.lit(i), *[F.element_at("sig", i * rows + j + 1) for j in range(rows)]) for i in range(bands)])
    listed = signed.select("_k", hashes.alias("_all"))
    exploded = listed.select("_k", F.posexplode("_all").alias("_i", "_h"), "_all").select("_k", "_h", F.when(F.col("_i") > 0, F.get("_all", F.col("_i") - 1)).alias("_p"))
    seen = exploded.where(F.pmod(F.xxhash64(F.lit(5), "_k"), F.lit(every)) == 0).groupBy("_h").agg(F.count("*").alias("_n"))
    large = materialize(seen.where(F.col("_n") * every > split).select("_h", F.ceil(F.col("_n") * every / split).cast("int").alias("_pieces")), "large_buckets")
    on = ["_h"]
    left = right = exploded
    if not large.isEmpty():
        cut = exploded.join(large, "_h", "left").withColumn("_pieces", F.coalesce("_pieces", F.lit(1)))
        left = cut.withColumn("_piece", F.pmod(F.xxhash64("_k"), F.col("_pieces")).cast("int"))
        right = cut.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
        on = ["_h", "_piece"]
    left, right = left.select(F.col("_k").alias("a"), F.col("_p").alias("_pa"), *on), right.select(F.col("_k").alias("b"), F.col("_p").alias("_pb"), *on)
    first = F.col("_pa").isNull() | F.col("_pb").isNull() | (F.col("_pa") != F.col("_pb"))
    return left.join(right, on).where((F.col("a") < F.col("b")) & first).select("a", "b").distinct()


def near_duplicates_minhash(
    df: DataFrame, key: str, text: str, threshold: float = 0.8, shingle: int = 5, num_perm: int = 128, bands: int = 32, min_chars: int = 200, verify: bool = True
) -> DataFrame:
    """(a, b, similarity) between different texts, found by banded MinHash.

    With ``verify`` the similarity is the exact Jaccard index and at least
    ``threshold``; without, it is the signatures' estimate and nothing is filtered.
    The chance to find a pair of similarity s is 1 - (1 - s**r)**bands with
    r = num_perm // bands; 32 bands of 4 find 0.8 with 0.99999993. Use
    ``copy_classes`` for the copies of each text.
    """
    reps, _ = similarity.text_classes(df, key, text, min_chars)
    signed = materialize(signatures(reps, num_perm, shingle), "signatures")
    pairs = band_candidates(signed, bands, num_perm // bands)
    if not verify:
        s = signed.select(F.col("_k"), "sig")
        both = pairs.join(s.select(F.col("_k").alias("a"), F.col("sig").alias("sa")), "a").join(s.select(F.col("_k").alias("b"), F.col("sig").alias("sb")), "b")
        same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
        return both.select("a", "b", (same / num_perm).alias("similarity"))
    return similarity.verified(pairs, reps, shingle, threshold)


def near_duplicates_exact(df: DataFrame, key: str, text: str, threshold: float = 0.8, shingle: int = 5, min_chars: int = 200) -> DataFrame:
    """(a, b, similarity) between different texts, every pair of at least ``threshold``.

    Candidates come from a prefix index on the rarest shingles (``similarity``); none
    is lost. Use ``copy_classes`` for the copies of each text.
    """
    reps, _ = similarity.text_classes(df, key, text, min_chars)
    return similarity.similar_pairs(reps, shingle, threshold)


def near_duplicate_classes(df: DataFrame, key: str, text: str, threshold: float = 0.8, shingle: int = 5, min_chars: int = 200) -> DataFrame:
    """(key, ``class_id``, ``links``): every row of ``df`` with the smallest key of its
    class of equal and near texts; ``links`` counts the other rows whose text is equal
    or near to its own. Keys are unique; null keys and texts under ``min_chars`` are
    classes of their own.
    """
    reps, members = similarity.text_classes(df, key, text, min_chars)
    pairs = materialize(similarity.similar_pairs(reps, shingle, threshold).select("a", "b"), "pairs")
    return classes_of(pairs, df, key, members=members)


def classes_of(pairs: DataFrame, nodes: DataFrame, key: str, max_rounds: int = 60, members: DataFrame | None = None) -> DataFrame:
    """(key, ``class_id``, ``links``): connected classes of a pair list, each under its
    smallest key; every node of ``nodes`` has a row.

    With ``members`` (rep, member: copies under their smallest key, rep is a member too)
    the pairs are those of representatives, and the result is that of the pairs of all
    members: each copy is in its representative's class and linked to its other copies
    and to all copies of the texts near to it. Copies take no part in the rounds.

    Large-star and small-star rounds (Kiveris et al. 2014) on edge tables written to
    the shared folder; only a count comes to the driver.
    """
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    edges = materialize(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    known = None
    for _ in range(max_rounds):
        # large star: connect the larger neighbours of each node to its smallest
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sides.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: connect the smaller neighbours and the node to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == known:
            break
        known = state
    else:
        raise RuntimeError("classes did not settle")
    roots = edges.groupBy("u").agg(F.min("v").alias("_root")).withColumnRenamed("u", "_rep")
    ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    of = nodes.select(F.col(key).alias("_key"))
    if members is None:
        known = roots.join(ends.groupBy(F.col("a").alias("_rep")).agg(F.count("*").alias("_links")), "_rep", "full")
        of = of.withColumn("_rep", F.col("_key"))
    else:
        size = members.groupBy(F.col("rep").alias("_rep")).agg(F.count("*").alias("_n"))
        near = ends.join(size.withColumnRenamed("_rep", "b"), "b", "left").groupBy(F.col("a").alias("_rep")).agg(F.sum(F.coalesce("_n", F.lit(1))).alias("_near"))
        known = roots.join(near, "_rep", "full").join(size, "_rep", "full")
        known = known.select("_rep", "_root", (F.coalesce("_near", F.lit(0)) + F.coalesce("_n", F.lit(1)) - 1).alias("_links"))
        of = of.join(members.select(F.col("member").alias("_key"), "rep"), "_key", "left").select("_key", F.coalesce("rep", "_key").alias("_rep"))
    return of.join(known, "_rep", "left").select(F.col("_key").alias(key), F.coalesce("_root", "_rep").alias("class_id"), F.coalesce("_links", F.lit(0)).alias("links"))
