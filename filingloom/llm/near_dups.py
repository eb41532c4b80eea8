"""Near-duplicate records with small edits (problem 6).

Method: count-vector bound with exact verification. The shingles of a text are
hashed to groups, and the vector of group counts is its point; the overlap of two
texts is at most the sum of the smaller counts, group by group, so pairs whose sum
is too small are pruned before their texts move. An R-tree over the points cannot
drive the join: see the README for the measured reasons (``tests/llm/rtree_figures.py``
makes the figures). Candidates come from the exact prefix index of the core's
similarity join instead, which also holds the bound.

Exact copies are one class from the start, so a group of copies costs as one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.operators.similarity import similar_pairs, text_classes

def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = 0.7, shingle: int = 3, min_chars: int = 200) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of the texts whose shingle sets are similar.

    ``pairs``: a, b (a < b), similarity, between classes of exact copies, each class
    under its smallest key. ``members``: rep, member for the texts that are stored
    more than once (rep is a member too). Similarity is Jaccard of the sets of
    ``shingle`` consecutive words; the result is exact, no pair is lost. Texts shorter
    than ``min_chars``, null texts and null keys take no part; rows repeated under one
    key count once (the same key with two texts: both take part). Extra columns are
    ignored; an empty table has no pairs.
    """
    reps, members = text_classes(df, key, text, min_chars)
    return similar_pairs(reps, shingle, threshold), members


def linked_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(record_a, record_b) between single records, record_a < record_b, whatever the
    size of a class.

    Each record is linked to the representative of its class of exact copies and to the
    representatives of all classes near to it; so is each representative to all records
    of those classes. No link between two different texts is lost, and a class of m
    copies near to one of n gives m + n - 1 pairs, not m * n. ``link_counts`` has the
    number of all links of every record.
    """
    a = members.select(F.col("rep").alias("a"), F.col("member").alias("_ma"))
    b = members.select(F.col("rep").alias("b"), F.col("member").alias("_mb"))
    near = pairs.select("a", "b")
    left = near.join(a, "a", "left").select(F.coalesce("_ma", "a").alias("x"), F.col("b").alias("y"))
    right = near.join(b, "b", "left").select(F.col("a").alias("x"), F.coalesce("_mb", "b").alias("y"))
    own = members.where("rep <> member").select(F.col("rep").alias("x"), F.col("member").alias("y"))
    both = left.unionByName(right).unionByName(own)
    return both.select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b")).where("record_a < record_b").distinct()


def link_counts(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(record, rep, links) of every record with an equal or near one: the representative
    of its class of exact copies, and how many other records are equal or near to it."""
    ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = members.groupBy("rep").agg(F.count("*").alias("_n"))
    near = ends.join(size.withColumnRenamed("rep", "b"), "b", "left").groupBy(F.col("a").alias("rep")).agg(F.sum(F.coalesce("_n", F.lit(1))).alias("_near"))
    reps = near.join(size, "rep", "full").select("rep", (F.coalesce("_near", F.lit(0)) + F.coalesce("_n", F.lit(1)) - 1).alias("links"))
    return reps.where("links > 0").join(members, "rep", "left").select(F.coalesce("member", "rep").alias("record"), "rep", "links")
