import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingloom.llm.leakage import find_leaks, leaks, scores, spaced_leaks, surviving_seeds
from filingloom.llm.near_dups import link_counts, linked_pairs, near_duplicates
from filingloom.operators.similarity import group_counts as count_vector
from filingloom.operators.similarity import overlap_bound, sets_of


def shingles(t, n=3):
    w = t.split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, t=0.7):
    sets = {k: shingles(x) for k, x in rows if k is not None and x and len(x) >= 200}
    ks = sorted(sets)
    return {(a, b) for i, a in enumerate(ks) for b in ks[i + 1 :] if sets[a] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def variants(seed, groups=25, words=90):
    r = random.Random(seed)
    common = [f"the same phrase number {i} again".split() for i in range(6)]
    rows = []
    for _ in range(groups):
        base = []
        while len(base) < words:
            base += r.choice(common) if r.random() < 0.3 else [f"w{r.randrange(900)}" for _ in range(4)]
        for v in range(r.randrange(1, 5)):
            w = list(base)
            for _ in range(v * r.randrange(1, 5)):
                at = r.randrange(len(w))
                w[at : at + 1] = r.choice([["new"], [], [w[at], "more"]])
            if v == 3:
                cut = r.randrange(len(w))
                w = w[cut:] + w[:cut]
            rows.append((len(rows), (" " if v else "\n").join(w)))
    return rows


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_near_duplicates_against_brute_force(spark, with_clashes, threshold):
    rows = variants(4)
    rows += [(500 + i, rows[0][1]) for i in range(3)] + [(500, rows[0][1]), (600, None), (601, ""), (602, "too short"), (None, rows[0][1]), (603, "z" * 5000), (604, "z" * 5000)]
    df = with_clashes(spark.createDataFrame(rows, "k long, t string"))
    pairs, members = near_duplicates(df, "k", "t", threshold)
    whole = brute(rows, threshold) | {(603, 604)}
    rep = {500: 0, 501: 0, 502: 0, 604: 603}
    got = {(r["record_a"], r["record_b"]) for r in linked_pairs(pairs, members).collect()}
    assert got == {(a, b) for a, b in whole if rep.get(a, a) == a or rep.get(b, b) == b}
    links = {r["record"]: (r["rep"], r["links"]) for r in link_counts(pairs, members).collect()}
    assert links == {k: (rep.get(k, k), sum(k in p for p in whole)) for k in {x for p in whole for x in p}}
    assert sorted((r["rep"], r["member"]) for r in members.collect()) == [(0, 0), (0, 500), (0, 501), (0, 502), (603, 603), (603, 604)]


def test_the_form_of_links_is_the_same_at_every_size(spark):
    """No switch: a class of 1,200 or 100,000 copies has a link for every member to its own
    representative and to the one near to it, no square, and the right counts."""
    text = " ".join(f"w{i}" for i in range(80))
    for size in (3, 1200, 100_000):
        rows = spark.range(size).select(F.col("id").alias("k"), F.lit(text).alias("t"))
        near = spark.createDataFrame([(1_000_000 + i, text + " more") for i in range(2)], "k long, t string")
        pairs, members = near_duplicates(rows.unionByName(near), "k", "t")
        links = linked_pairs(pairs, members)
        own, other = F.col("record_a") == 0, F.col("record_b") == 1_000_000
        got = links.agg(F.count("*"), F.count_if(own & (F.col("record_b") < 1_000_000)), F.count_if(other), F.count_if(own & (F.col("record_b") == 1_000_001))).first()
        assert tuple(got) == (size - 1 + size + 1 + 1, size - 1, size, 1)
        assert [tuple(r) for r in link_counts(pairs, members).groupBy("rep", "links").count().orderBy("rep").collect()] == [(0, size + 1, size), (1_000_000, size + 1, 2)]


def test_p6_classes_give_all_pairs_of_a_large_class(spark, tmp_path):
    """A large class, and what is near to it."""
    from filingloom.llm import queries

    text = " ".join(f"w{i}" for i in range(80))
    rows = [(i, text) for i in range(1002)] + [(2000, text + " more"), (2001, text + " more"), (2001, text + " more"), (3000, text[::-1])]
    spark.createDataFrame(rows, "record_id long, text string").write.parquet(str(tmp_path / "records.parquet"))
    got = [tuple(r) for r in queries.p6_classes(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and {x for x in got if not x[2]} == {(0, 2000, False)}
    copies = {k: [k] for k in (0, 2000)}
    for a, b, is_copy in got:
        if is_copy:
            copies[a].append(b)
    assert sorted(copies[0]) == list(range(1002)) and copies[2000] == [2000, 2001]
    rebuilt = {(a, b) for m in copies.values() for a in m for b in m if a < b} | {(a, b) for x, y, is_copy in got if not is_copy for a in copies[x] for b in copies[y]}
    whole = [*range(1002), 2000, 2001]
    assert len(rebuilt) == len(whole) * (len(whole) - 1) // 2
    found = {tuple(r) for r in queries.p6_found(spark, str(tmp_path)).collect()}
    assert found < rebuilt and {(5, 2000), (0, 2001)} <= found and {(5, 6), (5, 2001)} <= rebuilt - found


def test_empty_table_and_thresholds(spark):
    df = spark.createDataFrame([], "k long, t string")
    pairs, members = near_duplicates(df, "k", "t")
    assert pairs.count() == 0 and members.count() == 0 and linked_pairs(pairs, members).count() == 0 and link_counts(pairs, members).count() == 0
    with pytest.raises(ValueError):
        near_duplicates(df, "k", "t", threshold=0.2)


def test_bound_is_never_less_than_the_overlap():
    import pyarrow as pa

    texts = [t for _, t in variants(9)]
    sets = sets_of(pa.array(texts), 3)
    for a in sets:
        for b in sets[::5]:
            assert overlap_bound(count_vector(a, 16), count_vector(b, 16)) >= len(np.intersect1d(a, b))


# ------------------------------------------------------------------------- leaks
def words(t):
    return re.findall(r"[^\W_]+", t.lower().replace("'", "").replace("’", ""))


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_scores_are_smith_waterman():
    r = np.random.default_rng(0)
    a, b = r.integers(2, 6, (20, 9)).astype(np.uint64), r.integers(2, 6, (20, 14)).astype(np.uint64)
    assert scores(a, b).tolist() == [smith_waterman(x.tolist(), y.tolist()) for x, y in zip(a, b)]


def runs(item, text, least=15, per=8):
    """Replacements only: any aligned run of the item with at most one change in eight,
    from a kept word to a kept word."""
    for d in range(-len(item), len(text)):
        same = [0 <= i + d < len(text) and item[i] == text[i + d] for i in range(len(item))]
        for i in range(len(item)):
            for j in range(i + least, len(item) + 1):
                if 0 <= i + d and j + d <= len(text) and same[i] and same[j - 1] and (j - i) >= per * (j - i - sum(same[i:j])):
                    return True
    return False


def test_rule_of_leaks_with_replaced_words():
    r = random.Random(0)
    for _ in range(150):
        item = [r.randrange(2, 1000) for _ in range(r.randrange(15, 50))]
        text = [r.randrange(1000, 2000) for _ in range(10)] + list(item) + [r.randrange(1000, 2000) for _ in range(5)]
        for i in range(10, 10 + len(item)):
            if r.random() < r.choice([0.05, 0.12, 0.2]):
                text[i] = 3000
        got = leaks(np.array([item], np.uint64), np.array([text], np.uint64), 15, 8)[0]
        assert bool(got) == runs(item, text)


def test_four_changes_in_a_row_between_two_kept_stretches():
    item = list(range(2, 34))
    text = item[:14] + [99] * 4 + item[18:]
    assert leaks(np.array([item], np.uint64), np.array([text], np.uint64), 15, 8)[0]
    text = item[:14] + [99] * 5 + item[19:]
    assert not leaks(np.array([item], np.uint64), np.array([text], np.uint64), 15, 8)[0]


ITEM = "Under a rider signed at Jounvom, the cooperative may have provisionally apportioned the saffron yield swap before lot 694 reached Galdros. Although the surety objected, Suxjul seldom abated its reserve trust for 826 thousand Roscourk."


def test_leaks_in_a_table(spark, with_clashes):
    w = ITEM.split()
    replaced = list(w)
    for i in range(4, len(w), 9):
        replaced[i] = "other"
    heavy = list(w)
    for i in range(2, len(w), 5):
        heavy[i] = "other"
    docs = {
        1: "Before. " + ITEM + " After.", 2: ITEM.upper().replace(" ", "\n  "), 3: "x " + " ".join(w[:15]) + " y", 4: "x " + " ".join(w[:14]) + " y", 5: " ".join(replaced), 6: " ".join(heavy),
        7: None, 8: "", 9: "no leak at all " * 40, 10: ITEM.replace(",", "").replace(".", " . "), 11: "a " * 100_000 + ITEM, 12: " ".join(w[:10]) + " added " + " ".join(w[10:30]),
    }
    df = with_clashes(spark.createDataFrame([*docs.items(), (1, docs[1])], "k long, t string"))
    items = spark.createDataFrame([(7, "q", ITEM), (8, ITEM, None), (9, "", ""), (10, "short question", None)], "item_id long, question string, passage string")
    got = find_leaks(df, ["k"], "t", items, "item_id", ["question", "passage"]).collect()
    assert {(r["k"], r["item_id"], r["part"]) for r in got} == {(k, i, p) for k in (1, 2, 3, 5, 10, 11, 12) for i, p in ((7, "passage"), (8, "question"))}
    assert sum(r["k"] == 1 for r in got) == 4
    for options in ({"spaced": True}, {"spaced": True, "common": 0}, {"common": 3}):
        again = find_leaks(df, ["k"], "t", items, "item_id", ["question", "passage"], **options).select("k", "item_id").distinct()
        assert {tuple(r) for r in again.collect()} == {(r["k"], r["item_id"]) for r in got}
    assert find_leaks(df.where("false"), ["k"], "t", items, "item_id", ["question"]).count() == 0
    assert find_leaks(df, ["k"], "t", items.where("false"), "item_id", ["question"]).count() == 0
    with pytest.raises(ValueError):
        find_leaks(df, ["k"], "t", items, "item_id", ["question"], seed_words=9)


def spaced_runs(item, text, least=15, per=8):
    """Replacements only: an aligned run of the item with at most one change in eight words,
    and changes at least eight apart."""
    for d in range(-len(item), len(text)):
        same = [0 <= i + d < len(text) and item[i] == text[i + d] for i in range(len(item))]
        for i in range(len(item)):
            for j in range(i + least, len(item) + 1):
                changes = [x for x in range(i, j) if not same[x]]
                if 0 <= i + d and j + d <= len(text) and same[i] and same[j - 1] and len(changes) * per <= j - i and all(y - x >= per for x, y in zip(changes, changes[1:])):
                    return True
    return False


def test_rule_of_spaced_leaks():
    r = random.Random(1)
    both = [0, 0]
    for _ in range(200):
        item = [r.randrange(2, 1000) for _ in range(r.randrange(15, 50))]
        text = [r.randrange(1000, 2000) for _ in range(10)] + list(item) + [r.randrange(1000, 2000) for _ in range(5)]
        for i in range(10, 10 + len(item)):
            if r.random() < r.choice([0.05, 0.12, 0.2]):
                text[i] = 3000
        got = bool(spaced_leaks(np.array([item], np.uint64), np.array([text], np.uint64), 15, 8)[0])
        assert got == spaced_runs(item, text) and (not got or leaks(np.array([item], np.uint64), np.array([text], np.uint64), 15, 8)[0])
        both[got] += 1
    assert min(both) > 30


def test_added_and_dropped_words_are_changes():
    item = list(range(2, 34))
    rule = lambda t: bool(spaced_leaks(np.array([item], np.uint64), np.array([t], np.uint64), 15, 8)[0])
    assert rule(item[:9] + [99] + item[9:18]) and rule(item[:9] + item[10:18]) and not rule(item[:7] + [99] + item[7:11] + [99] + item[11:17])


def test_runs_within_the_rule_hold_enough_seeds():
    """Every placement of changes in a run of 15 leaves as many seeds as is said."""
    from itertools import combinations

    for spaced in (True, False):
        least = 99
        for n in (15, 16):
            for c in range(3):
                for at in combinations(range(n), c):
                    if (all(y - x >= 8 for x, y in zip(at, at[1:])) if spaced else 8 * c <= n):
                        least = min(least, sum(all(i + k not in at for k in range(5)) for i in range(n - 4)))
        assert surviving_seeds(15, 8, 5, spaced) <= least


def test_common_seeds_lose_no_leak(spark):
    """A phrase that stands in most texts, alone and within an item."""
    phrase = "subject to the terms of the agreement"
    item = "the harbor bond of Penjeix matured once a director " + phrase + " had pledged the rest of it to Sartom"
    docs = [(i, f"text {i} is {phrase} and so on {i} {i + 1} {i + 2} more words to be long enough") for i in range(40)] + [(100, "x y " + item), (101, item.replace("bond", "loan") + " z"), (102, "a b " + " ".join(item.split()[5:20]) + " c d")]
    items = spark.createDataFrame([(1, item)], "item_id long, q string")
    for common in (5, 10**6):
        got = find_leaks(spark.createDataFrame(docs, "k long, t string"), ["k"], "t", items, "item_id", ["q"], spaced=True, common=common)
        assert {r["k"] for r in got.collect()} == {100, 101, 102}
