"""Visually identical text with different characters (problem 2).

Method: confusables skeleton. A value is decomposed, every character is replaced by its
prototype from a look-alike table, and the result is decomposed again; values with
equal skeletons look alike and form a group, whose consistent member is the skeleton in
composed letters. A value that differs from the consistent member of its group holds
stand-ins. Genuine words of another script are no stand-ins: they keep their letters.

The look-alike table is the public Unicode confusables table as it comes with Spark's
own ICU library, turned so that the prototype of every class is its ordinary character
(the public table has 'rn' for 'm' and 'l' for 'I', '1' and 'l').
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.llm.common import keyed, schema_of, unkeyed

Table = dict[str, str]

# ---------------------------------------------------------------- fixed values
#: Hyphens and dashes that stand in for the plain hyphen or the ordinary dashes.
DASHES = dict.fromkeys("‐‑‒⁃−﹣－֊", "-") | {"―": "—", "﹘": "—"}
#: Other signs that look like an ordinary one.
SIGNS = {"ʼ": "’", "‛": "’", "ʹ": "'", "ˈ": "'", "‚": ",", "․": ".", "‥": "..", "∶": ":", "ː": ":", "꞉": ":", "⁄": "/", "∕": "/", "∗": "*", "⁎": "*", "ǃ": "!", "∙": "·", "‧": "·"}
INVISIBLE = re.compile(
    "[\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb]"
)
#: Compatibility forms that are ordinary although they decompose.
ORDINARY = frozenset("™℠©®ªº…½¼¾⅓⅔⅛⅜⅝⅞²³¹⁰⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉№℃℉¨¯´¸µ℮ΩÅ")
#: The plain ranges nothing is searched in: ASCII, Latin-1 and Latin Extended-A but
#: for the no-break space, soft hyphen and dotless letters, and ordinary signs.
PLAIN = r"\x00-\x7f\xa1-\xac\xae-İĲ-ňŊ-ž–—‘’“-„†-•…‰‹›€™"
#: Letters like Latin ones that the public table keeps in classes of their own.
BESIDE = {"ĸ": "k", "ʋ": "u"}
_SMALL_CAPITAL = re.compile("LATIN LETTER SMALL CAPITAL ([A-Z])")
DOUBTFUL = re.compile(rf"[^{PLAIN}]")
_PLAIN = re.compile(rf"[{PLAIN}]")
_WORD = re.compile(r"(?:[^\W_]|[\u0300-\u036f\xad\u200b-\u200d\u2060\ufeff])+")


def script(ch: str) -> str:
    """The script of a letter, by its Unicode name; '' for other characters."""
    if not ch.isalpha():
        return ""
    if ch < "ɐ":
        return "LATIN"
    word = unicodedata.name(ch, "").split(" ")[0]
    return {"CJK": "HAN", "HIRAGANA": "HAN", "KATAKANA": "HAN", "HANGUL": "HAN"}.get(word, word)


def _folded(ch: str) -> str:
    """Prototype of a compatibility form: full-width, styled, ligature, space."""
    if ch in ORDINARY:
        return ch
    kind = unicodedata.decomposition(ch)
    if kind.startswith(("<wide>", "<narrow>", "<font>", "<compat>", "<noBreak>")):
        if kind.startswith("<compat>") and unicodedata.category(ch)[0] not in "LZ":
            return ch
        return unicodedata.normalize("NFKC", ch)
    if unicodedata.category(ch) in ("Zs", "Zl", "Zp") and ch not in "\u2028\u2029":
        return " "
    return ch


def public_skeletons() -> Table:
    """The public table: every character that has a prototype, with it. One call to the
    ICU library of the running session; its size is that of the public table."""
    ids = [chr(i) for i in range(0x21, 0x20000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i))[0] != "C"]
    checker = SparkSession.builder.getOrCreate()._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    made = checker.getSkeleton("\n".join(ids)).split("\n")
    return {c: p for c, p in zip(ids, made, strict=True) if p != unicodedata.normalize("NFD", c)}


@lru_cache(1)
def lookalikes() -> Table:
    """The ordinary prototype of each letter, digit and punctuation mark that has one.

    Of the ordinary characters of a class (letters and digits for a letter or digit,
    marks for a mark) the one of the same kind and case is taken. Where the public
    prototype is an ordinary letter with a stroke or hook, it is that letter; a small
    capital is its small letter.
    """
    public = public_skeletons()
    ordinary: dict[str, list[str]] = {}
    for o in map(chr, range(0x21, 0x7F)):
        ordinary.setdefault(public.get(o, o), []).append(o)

    def chosen(ch: str, prototype: str) -> str | None:
        sort = "P" if unicodedata.category(ch)[0] == "P" else "LN"
        of = [o for o in ordinary.get(prototype, []) if unicodedata.category(o)[0] in sort]
        same = [o for o in of if unicodedata.category(o) == unicodedata.category(ch) or ch.islower() and o.islower() or ch.isupper() and o.isupper()]
        if of:
            return (same or of)[0]
        if len(prototype) == 1 and (m := _SMALL_CAPITAL.fullmatch(unicodedata.name(prototype, ""))):
            return m.group(1).lower()
        return BESIDE.get(prototype)

    out: Table = {}
    for ch in {*public, *(c for c in map(chr, range(0x250, 0x2000)) if _SMALL_CAPITAL.fullmatch(unicodedata.name(c, ""))), *BESIDE}:
        kind = unicodedata.category(ch)[0]
        made_of = unicodedata.decomposition(ch)  # composed letters are ordinary
        if _PLAIN.match(ch) or ch in ORDINARY or kind not in "LNP" or made_of.startswith(("<super>", "<sub>")) or made_of and made_of[0] != "<":
            continue
        prototype = public.get(ch, ch)
        got = chosen(ch, prototype)
        if got is None and kind == "L":
            bare = "".join(c for c in prototype if not unicodedata.combining(c))
            got = chosen(ch, bare) if bare and bare != prototype else None
        if got is not None and got != ch:
            out[ch] = got
    return out


def _true(ch: str, table: Table) -> bool:
    """Does the letter look exactly like its prototype? A digit for a letter, a small
    capital for a small letter or a letter less its hook is a weaker likeness."""
    to = table.get(ch, "")
    return to.isalpha() and ch.isupper() == to.isupper() and to in _strong().get(ch, "")


@lru_cache(1)
def _strong() -> Table:
    """The letters whose public prototype itself is a class of ordinary letters."""
    public = public_skeletons()
    of: dict[str, str] = {}
    for o in map(chr, range(0x21, 0x7F)):
        of[public.get(o, o)] = of.get(public.get(o, o), "") + o
    return {c: of[p] for c, p in public.items() if p in of}


def strong_letters(table: Table) -> frozenset[str]:
    """The letters of other scripts that are true look-alikes."""
    return frozenset(c for c in table if c.isalpha() and script(c) != "LATIN" and _true(c, table))


@lru_cache(1)
def tables() -> tuple[Table, frozenset[str]]:
    """What workers need: the prototypes, and which of them are true look-alikes."""
    return lookalikes(), strong_letters(lookalikes())


def prototype(ch: str, table: Table) -> str:
    """The ordinary character a character looks like; itself if there is none."""
    if ch < "\x7f":
        return ch
    if INVISIBLE.match(ch):
        return ""
    got = DASHES.get(ch) or SIGNS.get(ch) or table.get(ch) or _folded(ch)
    if got == ch:
        return ch
    return "".join(table.get(c, c) for c in unicodedata.normalize("NFD", got))


def skeleton(text: str, table: Table | None = None) -> str:
    """Decompose, replace every character by its prototype, decompose again."""
    table = lookalikes() if table is None else table
    return unicodedata.normalize("NFD", "".join(prototype(c, table) for c in unicodedata.normalize("NFD", text)))


def _own_letters(word: str) -> str:
    """A genuine word of another script: width and joins made plain, letters kept."""
    return unicodedata.normalize("NFC", "".join(_folded(c) for c in INVISIBLE.sub("", word)))


def _latin(word: str, table: Table) -> str:
    """The consistent member of a word's group: its skeleton in composed letters. Ordinary
    accents are composed before, so that they stay what they are."""
    return unicodedata.normalize("NFC", "".join(c if _PLAIN.match(c) else prototype(c, table) for c in unicodedata.normalize("NFC", word)))


def _genuine(line: str, words: list[tuple[int, int]], strong: frozenset[str]) -> set[int]:
    """Which words of a line are genuine ones of another script.

    Words without a Latin letter that follow each other are one run. A run is genuine
    if it holds a letter that is no true look-alike, or is a single Greek symbol; a
    run of look-alikes only reads as Latin, so it is taken for that.
    """
    out: set[int] = set()
    run: list[int] = []

    def close() -> None:
        letters = [c for i in run for c in unicodedata.normalize("NFC", line[slice(*words[i])]) if c.isalpha()]
        symbol = len(letters) == 1 and letters[0].islower() and script(letters[0]) == "GREEK"
        if symbol or any(c not in strong for c in letters):
            out.update(run)
        run.clear()

    for i, (start, end) in enumerate(words):
        word = line[start:end]
        scripts = {script(c) for c in _own_letters(word)} - {""} if not word.isascii() else {"LATIN"} if any(map(str.isalpha, word)) else set()
        if "LATIN" in scripts:
            close()
        elif scripts:
            run.append(i)
    close()
    return out


def _signs(line: str, start: int, end: int, table: Table) -> str:
    """The characters between words in their one form."""
    part = line[start:end]
    if not DOUBTFUL.search(part):
        return part
    out = []
    for at, ch in enumerate(part, start):
        if _PLAIN.match(ch):
            out.append(ch)
        elif ch == "\u3000" or "、" <= ch <= "〿" or "！" <= ch <= "｠":
            # full-width signs belong to the writing they stand in
            sides = [s for s in (line[at - 1 : at], line[at + 1 : at + 2]) if s]
            han = [script(s) == "HAN" or "、" <= s <= "ヿ" or "\uff00" < s < "｡" and not s.isalnum() for s in sides]
            out.append(ch if han and (all(han) or any(han) and ch != "\u3000") else prototype(ch, table))
        else:
            out.append(prototype(ch, table))
    return "".join(out)


def _line(line: str, table: Table, strong: frozenset[str]) -> str:
    words = [m.span() for m in _WORD.finditer(line)]
    genuine = _genuine(line, words, strong)
    out, last = [], 0
    for i, (start, end) in enumerate(words):
        word = line[start:end]
        out.append(_signs(line, last, start, table))
        out.append(word if word.isascii() else _own_letters(word) if i in genuine else _latin(word, table))
        last = end
    out.append(_signs(line, last, len(line), table))
    return "".join(out)


def consistent(text: str, table: Table | None = None, strong: frozenset[str] | None = None) -> tuple[str, bool]:
    """(the text in its one form, does it differ from the stored one?)."""
    if not DOUBTFUL.search(text):
        return text, False
    if table is None or strong is None:
        table, strong = tables()
    made = "\n".join(_line(x, table, strong) if DOUBTFUL.search(x) else x for x in text.split("\n"))
    return made, made != text


def doubtful(c: Column) -> Column:
    """Cheap JVM test: can the value hold anything that is to be replaced?"""
    return F.coalesce(c.rlike(rf"[^{PLAIN}]"), F.lit(False))


def one_form(df: DataFrame, keys: list[str], text: str, only_changed: bool = False, with_text: bool = True) -> DataFrame:
    """One row per row of ``df``: keys, ``changed`` and, with ``with_text``, ``form``
    (the value in the one consistent form).

    Values of Latin letters and their look-alikes whose skeletons are equal get equal
    forms. A run of words of another script with a letter that has no look-alike keeps
    its letters, so there a word may differ from a Latin one that looks like it. Null
    stays null and unchanged; an empty text stays empty. Extra columns are ignored.
    """
    base = keyed(df, keys, _t=text)
    schema = schema_of(df, keys, "changed boolean" + ", form string" * with_text)
    width = len(keys)
    table, strong = tables()  # as large as the public table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [consistent(t, table, strong) for t in batch.column(width).to_pylist()]
            keep = pa.array([i for i, m in enumerate(made) if m[1] or not only_changed], pa.int64())
            made = [m for m in made if m[1] or not only_changed]
            cols = [pa.array([m[1] for m in made], pa.bool_())] + [pa.array([m[0] for m in made], pa.string())] * with_text
            yield pa.RecordBatch.from_arrays([batch.column(i).take(keep) for i in range(width)] + cols, names=schema.names)

    out = base.where(doubtful(F.col("_t"))).mapInArrow(run, schema)
    if not only_changed:
        plain = base.where(~doubtful(F.col("_t"))).select(*[f"_k{i}" for i in range(width)], F.lit(False).alias("changed"), *[F.col("_t").alias("form")] * with_text)
        out = out.unionByName(plain)
    return unkeyed(out, keys)


def lookalike_groups(df: DataFrame, text: str) -> DataFrame:
    """Values that look equal: ``skeleton``, ``n_rows``, ``n_forms`` (different
    stored values) and ``form`` (the smallest one), for skeletons with two forms or
    more. Nulls belong to no group. Distinct values are taken before Python sees
    them, so a value that fills a third of the rows is looked at once.
    """
    table = lookalikes()

    @F.pandas_udf("string")
    def skeletons(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else skeleton(t, table))

    values = df.select(F.col(f"`{text}`").alias("_t")).where("_t is not null").groupBy("_t").agg(F.count("*").alias("_n"))
    plain = ~F.col("_t").rlike(r"[^\x00-\x7F]")
    keyed_ = values.where(plain).select("_t", "_n", F.col("_t").alias("skeleton")).unionByName(values.where(~plain).select("_t", "_n", skeletons("_t").alias("skeleton")))
    groups = keyed_.groupBy("skeleton").agg(F.sum("_n").alias("n_rows"), F.count("*").alias("n_forms"), F.min("_t").alias("form"))
    return groups.where("n_forms > 1").select("skeleton", "n_rows", "n_forms", "form")
