"""Overlapping windows of tokens or words, as exact pieces of the text.

Pure Column expressions: the text is tiled by a regular expression into pieces of
white space plus token, and a window is the joined slice of its pieces, so nothing
leaves the JVM and no shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.functions.text import SPACE, TOKEN, uwords

TILE = rf"{SPACE}*(?:{TOKEN})"


def n_windows(n: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` with ``overlap`` that cover n tokens; one for a short text."""
    step = size - overlap
    return F.when(n <= size, F.lit(1)).otherwise(1 + F.ceil((n - size) / step)).cast("int")


def token_windows(df: DataFrame, keep: list[str], text: str, size: int = 500, overlap: int = 50, tile: str = TILE) -> DataFrame:
    """keep columns plus ``chunk_index``, ``n_chunks``, ``token_count``, ``chunk``.

    A text of up to ``size`` tokens is one chunk, unchanged; a null text gives none.
    A longer one is cut at 0, step, 2 step...; each chunk is the exact text from the
    first to the last of its tokens. ``tile`` is a pattern whose matches, put
    together, give the text up to white space at its end: the tokeniser.
    """
    rows = df.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("_t"))
    pieces = F.regexp_extract_all("_t", F.lit(tile), F.lit(0))
    # few texts are longer than the shortest that can be split: only those are tiled
    rows = rows.withColumn("_p", F.when(F.length("_t") > size, pieces)).withColumn("_n", F.when(F.col("_p").isNotNull(), F.size("_p")).otherwise(F.regexp_count("_t", F.lit(tile))))
    rows = rows.withColumn("n_chunks", n_windows(F.col("_n"), size, overlap))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * (size - overlap)
    length = F.least(F.lit(size), F.col("_n") - start)
    cut = F.regexp_replace(F.array_join(F.slice("_p", start + 1, length), ""), rf"^{SPACE}+", "")
    return rows.select(*keep, "chunk_index", "n_chunks", length.cast("int").alias("token_count"), F.when(F.col("n_chunks") == 1, F.col("_t")).otherwise(cut).alias("chunk"))


def word_windows(df: DataFrame, keep: list[str], text: str, size: int = 512, overlap: int = 50) -> DataFrame:
    """The same by white-space words; chunks are words joined by single blanks."""
    rows = df.where(F.col(text).isNotNull()).select(*keep, uwords(F.col(text)).alias("_w")).withColumn("_n", F.size("_w"))
    rows = rows.withColumn("n_chunks", n_windows(F.col("_n"), size, overlap)).select("*", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * (size - overlap)
    length = F.least(F.lit(size), F.col("_n") - start)
    return rows.select(*keep, "chunk_index", "n_chunks", length.cast("int").alias("word_count"), F.array_join(F.slice("_w", start + 1, length), " ").alias("chunk"))


def chunk_records(sections: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Chunks of section records with their ids and counts.

    The id is built with concat: concat_ws would skip nulls and shorten ids.
    """
    keep = ["ticker", "company", "form", "filing_date", "report_date", "accession", "item_id", "item_title"]
    cut = token_windows(sections, keep, "text", size, overlap)
    key = F.concat(*[x for c in ("ticker", "report_date", "item_id") for x in (F.coalesce(F.col(c), F.lit("")), F.lit("|"))], F.col("chunk_index").cast("string"))
    return cut.select(key.alias("chunk_id"), *keep, F.col("chunk").alias("text"), "chunk_index", F.col("n_chunks").alias("n_chunks_in_section"), "token_count", F.size(uwords(F.col("chunk"))).alias("word_count"))


def guard_length(chunks: DataFrame, length: Column, limit: int, key: str) -> DataFrame:
    """Fail (when run) if a chunk is longer than ``limit``; pass all rows otherwise."""
    message = F.concat(F.lit("chunk over the limit: "), F.col(key).cast("string"))
    return chunks.where(F.when(length > limit, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
