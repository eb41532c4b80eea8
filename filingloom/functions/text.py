"""Text rules as Column expressions, fixed once for all operators.

White space here is Unicode white space. Java's ``\\s`` is ASCII only, so every
pattern names its classes; ``trim`` removes only U+0020, so ``ustrip`` is used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\p{IsWhite_Space}"
#: A token: a longest run of letters, digits and underscores, or any other single
#: character that is not white space.
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE}]"


def ustrip(c: Column) -> Column:
    """Strip Unicode white space at both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def uwords(c: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(c, rf"{SPACE}+"), lambda x: x != "")


def ulines(c: Column) -> Column:
    """Lines, split at ``\\n`` only."""
    return F.split(c, "\n")


def token_count(c: Column) -> Column:
    """Tokens of a text; null for null."""
    return F.regexp_count(c, F.lit(TOKEN))


def collapse_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}+", " ")
