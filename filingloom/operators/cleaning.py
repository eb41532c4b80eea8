"""Boilerplate lines, joined words and the audit of stripped lines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingloom.functions.text import ulines, ustrip

# Fixed values.
#: The project's own table markers, which repeat but are structure.
MARKERS = ("[TABLE]", "[/TABLE]")
#: Unicode white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CONTENTS = "table of contents"
#: Words run together: a comma or a full stop without a blank after it.
JOINED = r"[a-z],[a-z]|[a-z]\.[A-Z][a-z]"


def boilerplate_free(texts: pa.Array, min_repeats: int = 2, max_chars: int = 100) -> pa.Array:
    """All texts of a batch without their boilerplate lines; see ``strip_boilerplate``.

    The lines of the whole batch are one Arrow array. How often a line stands in its
    text is a count of equal (text, line) codes; the rest are Arrow kernels.
    """
    texts = texts.cast(pa.large_string())
    lines = pc.split_pattern(texts, "\n")
    whole, owner = lines.flatten(), pc.list_parent_indices(lines).to_numpy()
    bare = pc.utf8_trim(whole, characters=WHITE)
    codes = bare.dictionary_encode()
    _, place, counts = np.unique(owner * (len(codes.dictionary) + 1) + codes.indices.to_numpy(), return_inverse=True, return_counts=True)
    often = pa.array(counts[place] >= min_repeats)
    short = pc.less(pc.utf8_length(bare), max_chars)
    page = pc.match_substring_regex(bare, "^[0-9]{1,4}$")
    contents = pc.equal(pc.utf8_lower(bare), CONTENTS)
    exempt = pc.is_in(bare, pa.array(["", *MARKERS], pa.large_string()))
    kept = pc.or_(exempt, pc.invert(pc.or_(pc.or_(page, contents), pc.and_(short, often)))).to_numpy(zero_copy_only=False)
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(owner[kept], minlength=len(texts)), out=ends[1:])
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), whole.filter(pa.array(kept))), pa.scalar("\n", pa.large_string()))
    tidy = pc.utf8_trim(pc.replace_substring_regex(joined, "\n{3,}", "\n\n"), characters=WHITE)
    return pc.if_else(pc.is_valid(texts), tidy, None).cast(pa.string())


def strip_boilerplate(df: DataFrame, keep: Sequence[str], text: str, min_repeats: int = 2, max_chars: int = 100) -> DataFrame:
    """keep columns and ``text``: page numbers, contents headings and short lines that
    repeat within the text are dropped (all their occurrences), runs of blank lines
    shrink to one and the ends are stripped.

    An Arrow stage over all lines of a batch: a count of a text's own lines needs no
    shuffle. A text that is all boilerplate becomes empty, null stays null.
    """
    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], boilerplate_free(b.column(len(keep)), min_repeats, max_chars)], names=schema.names)

    return df.select(*keep, text).mapInArrow(run, schema)


def _lines(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = df.select(F.col(key).alias("_k"), F.posexplode(ulines(F.col(text))).alias("_no", "_line"))
    return rows.withColumn("_s", ustrip(F.col("_line")))


def stripped_lines(df: DataFrame, key: str, text: str, min_repeats: int = 2, max_chars: int = 100) -> DataFrame:
    """Audit: the repeated short lines that stripping removes, with their counts."""
    counted = _lines(df, key, text).where("_s <> ''").groupBy("_k", "_s").agg(F.count("*").alias("_n"))
    gone = counted.where((F.col("_n") >= min_repeats) & (F.length("_s") < max_chars) & ~F.col("_s").isin(*MARKERS))
    return gone.select(F.col("_k").alias(key), F.col("_s").alias("line"), F.col("_n").alias("times"))


def has_joined_words(c: Column) -> Column:
    return c.rlike(JOINED)


def keyword_context(df: DataFrame, keys: Sequence[str], text: str, phrase: str, reach: int, count: str) -> DataFrame:
    """First place of ``phrase`` (any case) in each text, the text within ``reach``
    characters around it, and how often ``count`` (any case) stands there. Texts
    without the phrase are left out; positions count from 0."""
    at = F.locate(phrase.lower(), F.lower(F.col(text))) - 1
    rows = df.select(*keys, F.col(text).alias("_t"), at.alias("at")).where("at >= 0")
    begin = F.greatest(F.col("at") - reach, F.lit(0))
    window = F.substring("_t", begin + 1, F.col("at") + reach - begin)
    rows = rows.withColumn("context", window).withColumn("around", F.regexp_count(F.lower("context"), F.lit("\\Q" + count.lower() + "\\E")))
    return rows.drop("_t")
