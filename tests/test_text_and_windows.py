import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filingloom.functions import hashing, text
from filingloom.operators import aggregates, chunking, selection, windows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_strip_words_and_tokens_follow_unicode(spark):
    df = spark.createDataFrame([("\xa0 a b_1 c.d　",), ("",), (None,)], "t string")
    got = df.select(text.ustrip(F.col("t")).alias("s"), text.uwords(F.col("t")).alias("w"), text.token_count(F.col("t")).alias("n")).collect()
    assert got[0]["s"] == "a b_1 c.d" and got[0]["w"] == ["a", "b_1", "c.d"] and got[0]["n"] == 5
    assert (got[1]["s"], got[1]["w"], got[1]["n"]) == ("", [], 0)
    assert got[2]["w"] is None and got[2]["n"] is None


def test_word_hashes_equal_words_hash_alike_in_any_place():
    texts = ["alpha beta gamma alpha", None, "", "  gamma\n", "日本 alpha", "x" * 3000]
    seen: dict[str, set[int]] = {}
    for first, raw, offsets in hashing.slices(pa.array(texts, pa.string()), 16):
        r, h = hashing.word_hashes(raw, offsets)
        by_row: dict[int, list[int]] = {}
        for a, b in zip(r, h):
            by_row.setdefault(first + int(a), []).append(int(b))
        for i in range(len(offsets) - 1):
            words = (texts[first + i] or "").split()
            assert len(words) == len(by_row.get(first + i, []))
            for w, x in zip(words, by_row.get(first + i, [])):
                seen.setdefault(w, set()).add(x)
    assert all(len(v) == 1 for v in seen.values())
    assert len({x for v in seen.values() for x in v}) == len(seen)


def test_ngrams_stay_within_a_row():
    rows_, words = np.array([0, 0, 0, 1, 1, 2]), np.arange(6, dtype=np.uint64)
    r, h, at = hashing.ngram_hashes(rows_, words, 2)
    assert r.tolist() == [0, 0, 1] and at.tolist() == [0, 1, 3] and len(set(h.tolist())) == 3


@pytest.mark.parametrize(("n", "chunks"), [(0, 1), (499, 1), (500, 1), (501, 2), (950, 2), (951, 3), (1400, 3), (1401, 4)])
def test_token_windows(spark, n, chunks):
    t = "  " + " ".join(f"w{i}" for i in range(n))
    got = chunking.token_windows(spark.createDataFrame([(1, t)], "k int, t string"), ["k"], "t").orderBy("chunk_index").collect()
    assert len(got) == chunks
    if chunks == 1:
        assert got[0]["chunk"] == t
    else:
        assert all(r["chunk"] in t for r in got)
        words = [r["chunk"].split() for r in got]
        assert all(a[-50:] == b[:50] for a, b in zip(words, words[1:]))
        assert sum(map(len, words)) - 50 * (chunks - 1) == n
        assert [r["token_count"] for r in got] == [len(w) for w in words]


def test_null_text_has_no_chunk_and_guard_fails(spark):
    df = spark.createDataFrame([(1, None), (2, "a b c")], "k int, t string")
    assert [r["k"] for r in chunking.token_windows(df, ["k"], "t").collect()] == [2]
    assert chunking.guard_length(df.where("t is not null"), F.length("t"), 5, "k").count() == 1
    with pytest.raises(Exception, match="over the limit"):
        chunking.guard_length(df.where("t is not null"), F.length("t"), 4, "k").count()


def _filings(spark):
    made = [("A", "2024-12-31", 1), ("A", "2023-12-31", 2), ("A", "2022-12-31", 3), ("A", "2021-12-31", 4), ("A", "", 5), ("A", "2026-01-01", 6), ("B", "2025-12-31", 7), ("B", None, 8)]
    return spark.createDataFrame(made, "e string, d string, pos int")


def test_latest_n_takes_the_cutoff_day_and_no_blank_dates(spark):
    got = selection.latest_n(_filings(spark), ["e"], "d", 3, ["pos"], until="2025-12-31")
    assert rows(got.select("e", "pos", "rn")) == [("A", 1, 1), ("A", 2, 2), ("A", 3, 3), ("B", 7, 1)]


def test_between_latest_two_is_strict_and_needs_two(spark):
    inner = spark.createDataFrame([("A", "2023-12-31", 1), ("A", "2024-03-31", 2), ("A", "2024-06-30", 3), ("A", "2024-09-30", 4), ("A", "2024-10-31", 5), ("A", "2024-12-31", 6), ("B", "2025-06-30", 7)], "e string, d string, pos int")
    outer = selection.latest_n(_filings(spark), ["e"], "d", 9, ["pos"], until="2025-12-31").drop("rn")
    assert [r[0] for r in rows(selection.between_latest_two(inner, outer, "e", "d", ["pos"]).select("pos"))] == [2, 3, 4, 5]


def test_upserts_lookups_and_skips(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert rows(selection.latest_wins(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(selection.not_yet_present(new, old, ["k"])) == [(3, "d")]
    assert rows(selection.missing_keys(new, old, "k")) == [(3,)]
    asked = spark.createDataFrame([(1,), (2,), (9,)], "k int")
    assert rows(selection.lookup_with_override(asked, old, spark.createDataFrame([(2, "own")], "k int, v string"), "k", "v")) == [(1, "a"), (2, "own")]
    versions = spark.createDataFrame([(1, dt.date(2024, 1, 1), "x"), (1, None, "y"), (1, dt.date(2024, 2, 1), "z"), (2, None, "n")], "k int, at date, v string")
    assert rows(selection.latest_version(versions, ["k"], "at").select("k", "v")) == [(1, "z"), (2, "n")]
    assert rows(selection.argmax_per_group(versions, ["k"], "at", ["v"]).select("k", "v")) == [(1, "z"), (2, "n")]


def test_columnar_rows(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["x", "y"]), (2, [], [])], "k int, f array<string>, g array<string>")
    assert rows(selection.rows_of_columns(df, ["k"], ["f", "g"])) == [(1, 0, "a", "x"), (1, 1, "b", "y")]


def test_medians_take_the_upper_middle(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 5), ("b", None)], "g string, v int")
    assert rows(aggregates.upper_median(df, ["g"], "v")) == [("a", 3, 4), ("b", 5, 1)]
    assert rows(aggregates.upper_median(df, [], "v")) == [(3, 5)]
    many = spark.createDataFrame([(x % 97,) for x in range(1000)], "v int")
    assert rows(aggregates.upper_median(many, [], "v")) == [(sorted(x % 97 for x in range(1000))[500], 1000)]
    assert aggregates.upper_median(df.where("false"), [], "v").count() == 0
    ms = spark.createDataFrame([(x,) for x in (3060, 2050, 2028, 1219, 3126, 3595, 1379, 1451)], "v int")
    assert rows(aggregates.upper_median(ms, [], "v")) == [(2050, 8)]


def test_counts_rates_and_pivots(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("b", "y", 4), ("c", "z", None)], "g string, f string, v int")
    assert [tuple(r) for r in aggregates.top_counts(df, "f", "v", 2).collect()] == [("x", 2), ("y", 2)]
    assert rows(aggregates.rate_by_group(df, ["g"], F.col("f") == "y")) == [("a", 1, 3, 1 / 3), ("b", 1, 1, 1.0)]
    assert rows(aggregates.pivot_counts(df, "g", "f", "v", ["x", "y", "z"])) == [("a", 2, 1, 0), ("b", 0, 1, 0), ("c", 0, 0, 0)]
    assert rows(aggregates.over_limit(df, "v", 2)) == [(2, 5, 4, 0.4)]
    assert rows(aggregates.duplicate_keys(df, "f")) == [(5, 3, 2)]
    assert aggregates.median_or_least(df, "v", 2, 5, ["v"]).first()["v"] == 3
    assert aggregates.median_or_least(df, "v", 50, 60, ["v"]).first()["v"] == 1
    assert aggregates.weighted_cost(df.where("v = 1").selectExpr("3447 as i", "184 as o"), {"i": 2.0, "o": 3.0}).first()["cost"] == pytest.approx(0.007446)


def test_running_switch_suffixes_and_cold_start(spark):
    ids = ["FRONT", "1", "2", "3", "4", "1", "1A", "2", "6"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(ids)], "f string, pos int, id string")
    got = windows.running_switch(df, ["f"], ["pos"], F.col("id") == "1", 2, "I", "II").orderBy("pos").collect()
    assert [r["part"] for r in got] == ["I"] * 5 + ["II"] * 4
    keyed = windows.suffix_duplicates(spark.createDataFrame([("k", 1), ("k", 2), ("l", 3), ("k", 4)], "x string, pos int"), F.col("x"), ["pos"]).orderBy("pos").collect()
    assert [r["key"] for r in keyed] == ["k", "k#2", "l", "k#3"]
    many = spark.createDataFrame([("hot" if i % 3 else "cold", i * 7919 % 1000) for i in range(1000)] + [(None, 5), (None, 1)], "g string, pos int")
    got = windows.numbered(many, ["g"], ["pos"], "n", buckets=16).collect()
    for g in {r["g"] for r in got}:
        mine = sorted((r["n"], r["pos"]) for r in got if r["g"] == g)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1)) and [p for _, p in mine] == sorted(p for _, p in mine)
    runs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "r string, pos int")
    assert rows(windows.without_first(runs, ["r"], ["pos"])) == [("a", 2), ("b", 1)]


def test_numbering_follows_the_data(spark):
    """One outlier, ties that fill ranges, strings and nulls: ranges stay small and the
    numbers right."""
    from filingloom.operators.windows import numbered, sampled_bucket

    df = spark.range(20_000).select(F.lit("g").alias("g"), F.when(F.col("id") == 5, 10**12).otherwise(F.col("id")).alias("v"), F.col("id"))
    spread = df.groupBy(sampled_bucket(df, ["v"], 64, 4096)).count()
    assert spread.agg(F.max("count")).first()[0] < 2000
    got = {r["id"]: r["n"] for r in numbered(df, ["g"], ["v"]).collect()}
    assert got[0] == 1 and got[6] == 6 and got[5] == 20_000 and sorted(got.values()) == list(range(1, 20_001))
    tied = df.select("g", F.lit(7).alias("v"), "id")
    assert tied.groupBy(sampled_bucket(tied, ["v", "id"], 64, 4096)).count().agg(F.max("count")).first()[0] < 2000
    assert {r["id"]: r["n"] for r in numbered(tied, ["g"], ["v", "id"]).collect()} == {i: i + 1 for i in range(20_000)}
    names = spark.createDataFrame([("b", 1), (None, 2), ("a", 3), ("c", 4)], "s string, i int").withColumn("g", F.lit(1))
    assert {r["i"]: r["n"] for r in numbered(names, ["g"], ["s"]).collect()} == {2: 1, 3: 2, 1: 3, 4: 4}
    dates = names.withColumn("d", F.expr("timestamp_seconds(i * 1000000)"))
    assert {r["i"]: r["n"] for r in numbered(dates, ["g"], ["d", "s"]).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert numbered(names.limit(0), ["g"], ["s"]).count() == 0
