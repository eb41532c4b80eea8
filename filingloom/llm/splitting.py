"""Splitting oversized items at natural boundaries (problem 5).

Method: lexical-cohesion segmentation. The text is tokenised, its boundaries
(paragraph, line and sentence ends) are found, and the similarity of the word
counts of the blocks before and after each boundary is taken. Within each size
window the boundary in the deepest valley of that similarity is cut.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.functions.text import token_count
from filingloom.llm.common import TOKEN, keyed, schema_of, unkeyed

SENTENCE = re.compile(r"(?<![A-Z])[.!?…][\"'”’)\]]*[ \t\xa0]+(?=[^\W_a-z]|[\"'“‘(\[•$€£§¿¡])")
#: Bins of the word counts of a block: few words of a section share one.
BINS = 512
_bin_of: dict[str, int] = {}


def _bins(words: list[str]) -> np.ndarray:
    """A bin for each content word, -1 for short words and signs."""
    if len(_bin_of) > 1_000_000:
        _bin_of.clear()
    out = []
    for w in words:
        b = _bin_of.get(w)
        if b is None:
            b = _bin_of[w] = zlib.crc32(w.lower().encode()) % BINS if len(w) > 3 else -1
        out.append(b)
    return np.array(out, np.int64)


def boundaries(text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token indexes before which the text may be cut, and the strength of each:
    3 after a blank line, 2 after a line end, 1 after a sentence end."""
    n = len(starts)
    strength = np.zeros(n + 1, np.int8)
    ends = [m.end() for m in SENTENCE.finditer(text)]
    if ends:
        strength[np.searchsorted(starts, ends)] = 1
    for m in re.finditer(r"\n\s*", text):
        i = np.searchsorted(starts, m.end())
        strength[i] = 3 if "\n" in m.group()[1:] else 2
    strength[0] = strength[n] = 0
    at = np.flatnonzero(strength)
    return at, strength[at]


def depths(words: list[str], at: np.ndarray, block: int) -> np.ndarray:
    """Depth of the cohesion valley at each boundary: how far the similarity of
    the ``block`` units before and after lies under the peaks on either side."""
    if not len(at):
        return np.zeros(0)
    bins = _bins(words)
    unit = np.searchsorted(at, np.arange(len(words)), "right")
    use = bins >= 0
    counts = np.bincount(unit[use] * BINS + bins[use], minlength=(len(at) + 1) * BINS).reshape(-1, BINS)
    sums = np.zeros((len(at) + 2, BINS), np.float32)
    np.cumsum(counts, axis=0, out=sums[1:])
    cut = np.arange(1, len(at) + 1)
    left = sums[cut] - sums[np.maximum(cut - block, 0)]
    right = sums[np.minimum(cut + block, len(at) + 1)] - sums[cut]
    norm = np.sqrt((left * left).sum(1) * (right * right).sum(1))
    similar = np.divide((left * right).sum(1), norm, out=np.zeros(len(at)), where=norm > 0)
    padded = np.pad(similar, block, mode="edge")
    near = np.lib.stride_tricks.sliding_window_view(padded, block + 1)
    before, after = near[: len(at)].max(1), near[block : block + len(at)].max(1)
    return before + after - 2 * similar


def windows(n: int, at: np.ndarray, strength: np.ndarray, depth: np.ndarray, max_tokens: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first token, end token, strength of the cut at the end) of each piece."""
    pieces, start, least = [], 0, 1
    while n - start > max_tokens:
        cut, kind = start + max_tokens, 0
        for low in (max(start + max_tokens // 2, least), least):
            i, j = np.searchsorted(at, low), np.searchsorted(at, start + max_tokens, "right")
            if i < j:
                best = max(range(i, j), key=lambda k: (round(depth[k], 9), strength[k], at[k]))
                cut, kind = int(at[best]), int(strength[best])
                break
        pieces.append((start, cut, kind))
        start, least = max(cut - overlap, 0), cut + 1
    pieces.append((start, n, 0))
    return pieces


def split_text(text: str, max_tokens: int = 500, overlap: int = 50, block: int = 3) -> list[tuple[int, int, int, int, int]]:
    """(first character, end character, tokens, characters shared with the piece
    before, strength of the cut) of each piece; the pieces cover the text."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    n = len(spans)
    if n <= max_tokens:
        return [(0, len(text), n, 0, 0)]
    starts = np.fromiter((a for a, _ in spans), np.int64, n)
    at, strength = boundaries(text, starts)
    depth = depths([text[a:b] for a, b in spans], at, block)
    out, before = [], 0
    for a, b, kind in windows(n, at, strength, depth, max_tokens, overlap):
        first, end = (0 if a == 0 else int(starts[a])), (len(text) if b == n else int(starts[b]))
        out.append((first, end, b - a, before - first if out else 0, kind))
        before = end
    return out


def split_oversized(
    df: DataFrame, keys: Sequence[str], text: str, max_tokens: int = 500, overlap: int = 50, block: int = 3, with_text: bool = True, only_split: bool = False
) -> DataFrame:
    """One row per piece: keys, ``piece_index``, ``n_pieces``, ``n_tokens``,
    ``first_char``, ``shared_chars``, ``cut`` and, with ``with_text``, ``piece``.

    ``piece[shared_chars:]`` of all pieces in order, put together, is the text.
    ``cut`` says where the piece ends: 'end', 'paragraph', 'line', 'sentence' or
    'token' (no boundary in the window). A text of up to ``max_tokens`` is one
    piece, unchanged (left out with ``only_split``); an empty text is one empty
    piece; a null text gives no row. Rows with equal keys are split each for
    itself. Extra columns are ignored.
    """
    if not 0 <= overlap < max_tokens // 2:
        raise ValueError("overlap must be under half of max_tokens")
    base = keyed(df, keys, _t=text).where("_t is not null").withColumn("_n", F.when(F.length("_t") > max_tokens, token_count(F.col("_t"))).otherwise(0))
    names = ("end", "sentence", "line", "paragraph")
    schema = schema_of(df, keys, "piece_index int, n_pieces int, n_tokens int, first_char int, shared_chars int, cut string" + ", piece string" * with_text)
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cols = [], [[] for _ in range(6 + with_text)]
            for i, t in enumerate(batch.column(width).to_pylist()):
                made = split_text(t, max_tokens, overlap, block)
                for k, (first, end, n, shared, kind) in enumerate(made):
                    rows.append(i)
                    cut = "end" if k == len(made) - 1 else names[kind] if kind else "token"
                    for c, v in zip(cols, (k, len(made), n, first, shared, cut, *([t[first:end]] * with_text))):
                        c.append(v)
            index = pa.array(rows, pa.int64())
            kinds = [pa.int32()] * 5 + [pa.string()] * (1 + with_text)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(index) for i in range(width)] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=schema.names)

    ks = [f"_k{i}" for i in range(width)]
    split = base.where(F.col("_n") > max_tokens).select(*ks, "_t").mapInArrow(run, schema)
    if not only_split:
        whole = base.where(F.col("_n") <= max_tokens).select(
            *ks, F.lit(0).alias("piece_index"), F.lit(1).alias("n_pieces"), F.coalesce(token_count(F.col("_t")), F.lit(0)).cast("int").alias("n_tokens"),
            F.lit(0).alias("first_char"), F.lit(0).alias("shared_chars"), F.lit("end").alias("cut"), *[F.col("_t").alias("piece")] * with_text,
        )
        split = split.unionByName(whole)
    return unkeyed(split, keys)
