"""Section records: contents-shaped duplicates, parts, ids, length and hash."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingloom.functions.text import SPACE
from filingloom.operators.windows import running_switch

# Fixed values.
#: A contents line: tab, title, tab, page number or range, at the line's end.
CONTENTS_LINE = rf"\t[^\t\n]*\t[0-9]{{1,4}}(?:-[0-9]{{1,4}})?[{SPACE}&&[^\n]]*(?=\n|\z)"
#: From the first sign of a line that is not blank to its end.
INKED_LINE = rf"[^{SPACE}][^\n]*"
#: Part of each item of an annual report.
ANNUAL_PARTS = {
    "1": "I", "1A": "I", "1B": "I", "1C": "I", "1-2": "I", "2": "I", "3": "I", "4": "I",
    "5": "II", "6": "II", "7": "II", "7A": "II", "8": "II", "9": "II", "9A": "II", "9B": "II", "9C": "II",
    "10": "III", "11": "III", "12": "III", "13": "III", "14": "III", "15": "IV", "16": "IV",
}


def looks_like_contents(text: Column, share: float = 0.5, min_lines: int = 3) -> Column:
    """Are at least ``share`` of the non-blank lines contents lines?"""
    lines = F.regexp_count(text, F.lit(INKED_LINE))
    return (lines >= min_lines) & (F.regexp_count(text, F.lit(CONTENTS_LINE)) >= share * lines)


def drop_contents_duplicates(df: DataFrame, filing: Sequence[str], item: str = "item_id", text: str = "text") -> DataFrame:
    """Of sections with one id in a filing, drop those shaped like contents, unless all are."""
    w = Window.partitionBy(*filing, item)
    flagged = df.withColumn("_good", ~looks_like_contents(F.col(text)))
    flagged = flagged.withColumn("_n", F.count("*").over(w)).withColumn("_g", F.count_if(F.col("_good")).over(w))
    return flagged.where("_n = 1 or _good or _g = 0").drop("_good", "_n", "_g")


def _part_table(parts: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])


def _prefixed(item: Column, part: Column) -> Column:
    """The id under its part; ids without a part, and ``FRONT``, stay."""
    return F.when((item == "FRONT") | part.isNull(), item).otherwise(F.concat(part, F.lit("-"), item))


def assign_parts(df: DataFrame, filing: Sequence[str], annual: str = "10-K", interim: str = "10-Q", parts: Mapping[str, str] = ANNUAL_PARTS) -> DataFrame:
    """Prefix item ids with their part. Annual: by item number, ``?`` if unknown.
    Interim: the second item 1 opens part II. Other forms and ``FRONT`` stay."""
    switched = running_switch(df, filing, ["section_pos"], F.col("item_id") == "1", 2, "I", "II", "_part")
    listed = F.coalesce(F.try_element_at(_part_table(parts), F.col("item_id")), F.lit("?"))
    part = F.when(F.col("form") == annual, listed).when(F.col("form") == interim, F.col("_part"))
    return switched.withColumn("item_id", _prefixed(F.col("item_id"), part)).drop("_part")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _section(s: Column, item: Column) -> Column:
    return F.struct(s["section_pos"].alias("section_pos"), item.alias("item_id"), s["item_title"].alias("item_title"), s["text"].alias("text"))


def kept_in_filing(sections: Column) -> Column:
    """``drop_contents_duplicates`` within a filing's own array of sections: ids and
    flags are compared, the texts are looked at once."""
    flagged = F.transform(sections, lambda s: F.struct(s.alias("s"), s["item_id"].alias("i"), (~looks_like_contents(s["text"])).alias("g")))

    def kept(all_: Column) -> Column:
        def stays(f: Column) -> Column:
            same = F.filter(all_, lambda o: o["i"] == f["i"])
            return f["g"] | (F.size(same) == 1) | ~F.exists(same, lambda o: o["g"])

        return F.transform(F.filter(all_, stays), lambda f: f["s"])

    return _bound(flagged, kept)


def parts_in_filing(sections: Column, form: Column, annual: str = "10-K", interim: str = "10-Q", parts: Mapping[str, str] = ANNUAL_PARTS) -> Column:
    """``assign_parts`` within a filing's own array of sections."""

    def renamed(all_: Column) -> Column:
        def one(s: Column, at: Column) -> Column:
            ones = F.size(F.filter(F.slice(all_, F.lit(1), at + 1), lambda o: o["item_id"] == "1"))
            listed = F.coalesce(F.try_element_at(_part_table(parts), s["item_id"]), F.lit("?"))
            part = F.when(form == annual, listed).when(form == interim, F.when(ones >= 2, "II").otherwise("I"))
            return _section(s, _prefixed(s["item_id"], part))

        return F.transform(all_, one)

    return _bound(sections, renamed)


def finish_records(df: DataFrame, min_chars: int = 50) -> DataFrame:
    """Namespace the id by form, drop short sections, add length and content hash."""
    kept = df.where(F.length("text") >= min_chars)
    return kept.withColumn("item_id", F.concat("form", F.lit(":"), "item_id")).withColumn("char_count", F.length("text")).withColumn("content_hash", F.sha2("text", 256))
