"""Lines repeated across one source's documents (problem 3).

Method: a line's document frequency within a source is compared with its
frequency outside of it by the log-likelihood ratio; the excess is significant
under false-discovery control (Benjamini-Hochberg over all tested lines). The
significant lines are anti-joined away and the documents put together by position.
Where a table has a rule of its own (so many documents of the source, whatever stands
elsewhere), ``by_rule`` takes every line of that rule; ratio and cut are made as ever and
their verdict stands beside each line. ``false_discovery=None`` leaves the cut out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingloom.functions.text import SPACE, collapse_space, ulines, ustrip
from filingloom.session import materialize

def normal_line(line: Column) -> Column:
    """Trimmed, lower case, white space runs as one blank, digit runs as one mark."""
    return F.regexp_replace(collapse_space(F.lower(ustrip(line))), r"[0-9]+", "#")


def _lines(df: DataFrame, key: str, source: str, text: str, min_chars: int) -> DataFrame:
    """(_k, _s, _no, _a, _b): the lines long enough, as a 128-bit hash of their normal form,
    as a table: the texts are split and hashed once, whatever follows."""
    base = df.select(F.col(f"`{key}`").alias("_k"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("_s"), F.col(f"`{text}`").alias("_t"))
    # a line is at least as long as its trimmed form, so short texts need no split
    base = base.where(f"_k is not null and length(_t) >= {int(min_chars)}")
    line = base.select("_k", "_s", F.posexplode(ulines(F.col("_t"))).alias("_no", "_l")).where(f"length(_l) >= {int(min_chars)}")
    line = line.where(~F.col("_l").rlike(rf"^{SPACE}|{SPACE}$") | (F.length(ustrip(F.col("_l"))) >= min_chars))
    n = normal_line(F.col("_l"))
    return materialize(line.select("_k", "_s", "_no", F.xxhash64(n).alias("_a"), F.xxhash64(F.lit(7), n).alias("_b")), "lines")


def _ratio(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Dunning's 2 log lambda of k1 in n1 against k2 in n2 documents."""

    def part(k: Column, n: Column, p: Column) -> Column:
        a = F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
        rest = n - k
        return a + F.when(rest > 0, rest * F.log(rest / (n * (1 - p)))).otherwise(0.0)

    p = (k1 + k2) / (n1 + n2)
    return 2 * (part(k1, n1, p) + part(k2, n2, p))


def _upper_tail(x: Column) -> Column:
    """P(chi-square with one degree of freedom > x), by the bound-and-series for erfc
    of Abramowitz and Stegun 7.1.26 (error under 1.5e-7 of the leading factor)."""
    z = F.sqrt(x / 2)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-z * z)


def _counts(lines: DataFrame) -> DataFrame:
    """(_s, _a, _b, _in): different keys with the line in the source."""
    # distinct keys first (spread by key), then counts that combine before they move
    return lines.select("_k", "_s", "_a", "_b").distinct().groupBy("_s", "_a", "_b").agg(F.count("*").alias("_in"))


def repeated_lines(df: DataFrame, key: str, source: str, text: str, min_chars: int = 25, min_docs: int = 8, false_discovery: float | None = 0.01, by_rule: bool = False) -> DataFrame:
    """``source``, ``line_a``, ``line_b`` (128-bit hash of the normal line), ``docs``
    (different keys with it in the source), ``docs_outside``, ``ratio``, ``p`` of
    the lines with a significant excess within their source and at least
    ``min_docs`` documents there. With ``by_rule`` all lines with ``min_docs``
    documents, ``significant`` saying which of them the cut keeps; with
    ``false_discovery=None`` all of them without a cut.

    Every document counts; a null source counts as the source ''; rows with equal
    key are one document; null keys and null texts have no lines.
    """
    return _tested(_lines(df, key, source, text, min_chars), df, key, source, min_docs, false_discovery, by_rule)


def _tested(lines: DataFrame, df: DataFrame, key: str, source: str, min_docs: int, false_discovery: float | None, by_rule: bool) -> DataFrame:
    by_source = df.select(F.col(f"`{key}`").alias("_k"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("_s")).where("_k is not null").distinct().groupBy("_s").agg(F.count("*").alias("_n1"))
    total = by_source.agg(F.sum("_n1").alias("_n"))
    # only the lines to be tested are counted everywhere, by counts that combine before they move
    counted = materialize(_counts(lines).where(F.col("_in") >= min_docs), "counted")
    held = lines.join(counted.select("_a", "_b"), ["_a", "_b"], "left_semi")
    everywhere = _counts(held).groupBy("_a", "_b").agg(F.sum("_in").alias("_all"))
    tested = counted.join(everywhere, ["_a", "_b"]).join(by_source, "_s").crossJoin(F.broadcast(total))  # total is one row
    k1, n1 = F.col("_in").cast("double"), F.col("_n1").cast("double")
    k2, n2 = (F.col("_all") - F.col("_in")).cast("double"), (F.col("_n") - F.col("_n1")).cast("double")
    # one source alone has no outside: its lines are held against an empty one
    ratio = F.when(n2 > 0, _ratio(k1, n1, k2, n2)).otherwise(_ratio(k1, n1, F.lit(0.0), n1))
    # in the same share or less outside there is no excess
    excess = F.when((n2 <= 0) | (k1 * n2 > k2 * n1), F.greatest(ratio, F.lit(0.0))).otherwise(0.0)
    tested = tested.select(F.col("_s").alias("source"), F.col("_a").alias("line_a"), F.col("_b").alias("line_b"), F.col("_in").alias("docs"), (F.col("_all") - F.col("_in")).alias("docs_outside"), excess.alias("ratio"))
    tested = tested.withColumn("p", F.when(F.col("ratio") > 0, F.least(_upper_tail(F.col("ratio")), F.lit(1.0))).otherwise(1.0))
    if false_discovery is None:
        return tested
    # the cut reads the lines with ``min_docs`` documents several times
    tested = materialize(tested, "tested")
    return _judged(tested, false_discovery) if by_rule else _discoveries(tested, false_discovery)


def _discoveries(tested: DataFrame, rate: float) -> DataFrame:
    """The significant lines alone."""
    return _judged(tested, rate).where("significant").drop("significant")


def _judged(tested: DataFrame, rate: float) -> DataFrame:
    """``significant`` by Benjamini-Hochberg without a global sort: the lines up to the
    largest p with m * p <= rate * (p values up to it).

    The p values are counted in a fixed number of log-spaced bins. A bin whose last
    value keeps the rule is in as a whole; only in the bins after it whose first value
    could keep it the values are ranked one by one.
    """
    bins, low = 4096, 1e-40
    step = F.ceil(F.log(F.greatest(F.col("p"), F.lit(low)) / low) / F.lit(-math.log(low) / bins)).cast("int")
    tested = tested.withColumn("_bin", step)
    counted = tested.groupBy("_bin").agg(F.count("*").alias("_c"), F.min("p").alias("_first"), F.max("p").alias("_last"))
    up = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)  # at most ``bins`` rows
    known = counted.withColumns({"_up": F.sum("_c").over(up), "_m": F.sum("_c").over(Window.partitionBy())})
    known = known.withColumn("_sure", F.max(F.when(F.col("_m") * F.col("_last") <= rate * F.col("_up"), F.col("_bin"))).over(Window.partitionBy()))
    open_ = known.where((F.col("_bin") > F.coalesce("_sure", F.lit(-1))) & (F.col("_m") * F.col("_first") <= rate * F.col("_up")))
    inside = tested.select("_bin", "p").join(F.broadcast(open_), "_bin")  # at most ``bins`` rows
    rank = F.col("_up") - F.col("_c") + F.count("*").over(Window.partitionBy("_bin").orderBy("p").rangeBetween(Window.unboundedPreceding, 0))
    exact = inside.withColumn("_rank", rank).where(F.col("_m") * F.col("p") <= rate * F.col("_rank")).agg(F.max("p").alias("_cut"))
    sure = known.where(F.col("_bin") == F.col("_sure")).agg(F.max("_last").alias("_cut"))
    cut = exact.unionByName(sure).agg(F.max("_cut").alias("_cut"))
    return tested.crossJoin(F.broadcast(cut)).withColumn("significant", F.coalesce(F.col("p") <= F.col("_cut"), F.lit(False))).drop("_cut", "_bin")


def _flagged(df: DataFrame, key: str, source: str, text: str, min_chars: int, min_docs: int, false_discovery: float | None, by_rule: bool) -> DataFrame:
    """(_k, _no, _a) of each flagged line.

    The flagged lines of all sources are a table of hashes and scores; the join with it is
    a plain semi-join, so it is broadcast while its files are small, and else a line that
    fills a source's documents is split by adaptive execution on the side of the documents.
    """
    lines = _lines(df, key, source, text, min_chars)
    if false_discovery is None:  # no score decides, so none is taken
        found = _counts(lines).where(F.col("_in") >= min_docs).select("_s", "_a", "_b")
    else:
        found = _tested(lines, df, key, source, min_docs, false_discovery, by_rule)
        found = found.withColumnsRenamed({"source": "_s", "line_a": "_a", "line_b": "_b"})
    return lines.join(materialize(found, "flagged"), ["_s", "_a", "_b"], "left_semi").select("_k", "_no", "_a")


def flagged_lines(df: DataFrame, key: str, source: str, text: str, min_chars: int = 25, min_docs: int = 8, false_discovery: float | None = 0.01, by_rule: bool = False) -> DataFrame:
    """(key, ``line_no``) of each significant line, or with ``by_rule`` or
    ``false_discovery=None`` of each line with ``min_docs`` documents in its source;
    line numbers count from 0.
    """
    hit = _flagged(df, key, source, text, min_chars, min_docs, false_discovery, by_rule).select("_k", "_no").distinct()
    return hit.select(F.col("_k").alias(key), F.col("_no").cast("long").alias("line_no"))


def scored_lines(df: DataFrame, key: str, source: str, text: str, min_chars: int = 25, min_docs: int = 8, false_discovery: float = 0.01) -> DataFrame:
    """``source``, key and ``line_no`` of the first place, ``docs``, ``docs_outside``,
    ``ratio``, ``p``, ``significant`` of each line ``flagged_lines`` takes with ``by_rule``.
    """
    lines = _lines(df, key, source, text, min_chars)
    found = materialize(_tested(lines, df, key, source, min_docs, false_discovery, True), "flagged")
    found = found.withColumnsRenamed({"source": "_s", "line_a": "_a", "line_b": "_b"})
    first = lines.join(found.select("_s", "_a", "_b"), ["_s", "_a", "_b"], "left_semi").groupBy("_s", "_a", "_b").agg(F.min(F.struct("_k", "_no")).alias("_at"))
    place = (F.col("_s").alias("source"), F.col("_at._k").alias(key), F.col("_at._no").cast("long").alias("line_no"))
    return first.join(found, ["_s", "_a", "_b"]).select(*place, "docs", "docs_outside", "ratio", "p", "significant")


def remove_repeated_lines(df: DataFrame, key: str, source: str, text: str, min_chars: int = 25, min_docs: int = 8, false_discovery: float | None = 0.01, by_rule: bool = False) -> DataFrame:
    """(key, ``clean_text``, ``removed_lines``): one row per key, the text without the
    flagged lines and otherwise unchanged.

    Line numbers of a document are gathered (bounded by its own lines) and joined to
    the text, which moves once; a line goes if its number and its hash are flagged.
    Rows of one key are one document: the one with the least text stays. A null key
    comes back unchanged once per row; null text stays null.
    """
    flagged = _flagged(df, key, source, text, min_chars, min_docs, false_discovery, by_rule)
    marks = flagged.groupBy("_k").agg(F.collect_set(F.struct("_no", "_a")).alias("_drop"))
    base = df.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t"))
    # the keys of several rows come from the key column alone; only their texts are merged
    several = materialize(base.where("_k is not null").groupBy("_k").agg(F.count("*").alias("_n")).where("_n > 1").select("_k"), "several")
    single = base.join(several, "_k", "left_anti")
    merged = base.join(several, "_k", "left_semi").groupBy("_k").agg(F.min("_t").alias("_t"))
    joined = single.unionByName(merged).join(marks, "_k", "left")

    def gone(line: Column, i: Column) -> Column:
        return F.exists("_drop", lambda d: (d["_no"] == i) & (d["_a"] == F.xxhash64(normal_line(line))))

    lines = ulines(F.col("_t"))
    kept = F.when(F.col("_drop").isNotNull(), F.filter(lines, lambda line, i: ~gone(line, i)))
    done = joined.withColumn("_kept", kept)
    return done.select(F.col("_k").alias(key), F.coalesce(F.array_join("_kept", "\n"), F.col("_t")).alias("clean_text"), F.coalesce(F.size(lines) - F.size("_kept"), F.lit(0)).alias("removed_lines"))
