"""Embedding, exact cosine search and the context it gives."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries held in memory at once, each block against all vectors.
BLOCK_QUERIES = 2048
#: Decimal places scores are rounded to before they are ranked, so that sums taken
#: in another order rank alike.
PLACES = 9

Encoder = Callable[[list[str]], np.ndarray]


def normalized(c: Column) -> Column:
    """x / |x| in double; a zero vector stays zero, null stays null."""
    wide = F.transform(c, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm)).otherwise(wide)


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a double matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def cosine_topk(queries: DataFrame, vectors: DataFrame, query_key: str, key: str, vector: str, k: int = 5, block: int = BLOCK_QUERIES) -> DataFrame:
    """(``query_id``, ``rank``, key, ``score``): the k nearest vectors of each query.

    Vectors are taken as normalised, so the dot product is the cosine. Ties go to
    the smaller key; vectors with NaN or null are never returned. The queries are a
    stated set: they go in blocks of bounded size against all vectors, each task
    keeps k per query, and a window merges what the tasks kept.
    """
    n = queries.count()
    blocks = max(1, math.ceil(n / block))
    dim_ok = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    base = vectors.where(dim_ok & F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(vector).alias("_v"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query_key).alias("_q"), F.col(vector).alias("_v"))
    parts = []
    for i in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == i)
        rows = mine.orderBy("_q").toArrow()  # about ``block`` rows
        parts.append(_kept(base, rows, k, queries.schema[query_key].dataType, vectors.schema[key].dataType))
    kept = reduce(DataFrame.unionByName, parts)
    rank = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score"), F.asc("_k")))
    out = kept.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select(F.col("_q").alias("query_id"), "rank", F.col("_k").alias(key), "score")


def _kept(base: DataFrame, queries: pa.Table, k: int, query_type: T.DataType, key_type: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("_q", query_type), T.StructField("_k", key_type), T.StructField("score", T.DoubleType())])
    n = queries.num_rows
    matrix = _matrix(queries.column("_v").combine_chunks()) if n else np.zeros((0, 0))
    shared = base.sparkSession.sparkContext.broadcast((matrix, queries.column("_q")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, ids = shared.value
        best: tuple[np.ndarray, np.ndarray] | None = None
        kind: pa.DataType | None = None
        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows if len(q) else 0, 4096):
                part = batch.slice(at, 4096)
                keys = part.column(0).to_numpy(zero_copy_only=False)
                keys = keys.astype(str) if keys.dtype == object else keys
                scores = np.round(q @ _matrix(part.column(1)).T, PLACES)
                keys = np.broadcast_to(keys, scores.shape)
                if best is not None:
                    scores, keys = np.concatenate([best[0], scores], axis=1), np.concatenate([best[1], keys], axis=1)
                best = _top(scores, keys, k)
        if best is not None:
            rows = pa.array(np.repeat(np.arange(len(q)), best[0].shape[1]))
            yield pa.RecordBatch.from_arrays([ids.combine_chunks().take(rows), pa.array(best[1].ravel(), kind), pa.array(best[0].ravel())], names=["_q", "_k", "score"])

    return base.mapInArrow(run, schema)


def _top(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, ties by smaller key; only ties at the bar are sorted by key."""
    if scores.shape[1] <= k:
        return scores, keys
    bar = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    width = int((scores >= bar).sum(1).max())
    pick = np.argpartition(-scores, width - 1, axis=1)[:, :width]
    scores, keys = np.take_along_axis(scores, pick, 1), np.take_along_axis(keys, pick, 1)
    if width > k:
        order = np.lexsort((keys, -scores), axis=-1)[:, :k]
        scores, keys = np.take_along_axis(scores, order, 1), np.take_along_axis(keys, order, 1)
    return scores, keys


def hashing_encoder(dim: int = 384) -> Encoder:
    """A deterministic bag-of-words encoder for tests and offline runs: signed word
    hashes, square-root counts, unit length. No stand-in for a trained model."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1.0 if h & 0x80000000 else -1.0
        out = np.sign(out) * np.sqrt(np.abs(out))
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    return encode


def embed(df: DataFrame, text: str, encoder: Encoder, out: str = "embedding", prefix: str = "", batch_size: int = 32) -> DataFrame:
    """All columns plus the text's vector (array<float>), in batches of ``batch_size``.

    ``prefix`` is put before each text: models of this kind expect one on queries
    only. A null text has a null vector.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            vectors: list[list[float] | None] = []
            for i in range(0, len(texts), batch_size):
                part = texts[i : i + batch_size]
                made = encoder([prefix + (t or "") for t in part])
                vectors += [None if t is None else v.astype(np.float32).tolist() for t, v in zip(part, made)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=schema.names)

    return df.mapInArrow(run, schema)


def context(results: DataFrame, group: str, separator: str = "\n\n---\n\n") -> DataFrame:
    """(group, ``context``, ``retrieved_ids``): the retrieved chunks in rank order as
    one prompt text. A group holds k chunks, so gathering it is bounded."""
    head = F.concat(F.lit("["), "chunk_id", F.lit("] "), F.coalesce("company", F.lit("")), F.lit(" ("), F.coalesce("ticker", F.lit("")), F.lit("), "), F.coalesce("form", F.lit("")), F.lit(" for period "), F.coalesce("report_date", F.lit("")), F.lit(", "), F.coalesce("item_title", F.lit("")), F.lit(":\n"), F.coalesce("text", F.lit("")))
    listed = results.select(group, F.struct("rank", F.col("chunk_id").alias("id"), head.alias("block")).alias("_x")).groupBy(group).agg(F.array_sort(F.collect_list("_x")).alias("_l"))
    return listed.select(group, F.array_join(F.transform("_l", lambda x: x["block"]), separator).alias("context"), F.transform("_l", lambda x: x["id"]).alias("retrieved_ids"))
