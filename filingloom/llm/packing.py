"""Filling fixed-capacity containers with items (problem 7).

Method: sum-of-squares online packing. N(h) counts the open containers filled to
level h; each item goes to the level that leaves the sum of N(h) squared least.
Items are spread over shards by a hash of their key and each shard is packed on
its own, so only keys and sizes are moved and a shard's state is one level array.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.functions.text import token_count
from filingloom.llm.common import keyed, schema_of, unkeyed


class Packer:
    """Open containers by level; ``put`` returns the container's number."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.made = capacity, 0
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, size: int) -> int:
        cap, n = self.capacity, self.count
        # Moving a container from h to h + size changes the sum of squares by
        # 2 (N(h + size) - N(h) + 1); a new container by 2 N(size) + 1; a filled
        # one leaves the sum, so its target counts as nothing.
        change = 2 * (n[size:cap] - n[: cap - size] + 1) if size < cap else np.zeros(0, np.int64)
        change = np.append(change, 1 - 2 * n[cap - size])
        change[n[: cap - size + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * n[size] + 1 if size < cap else 0
        level = len(change) - 1 - int(change[::-1].argmin())
        if level == 0:
            number, self.made = self.made, self.made + 1
        else:
            number = self.open[level].pop()
            n[level] -= 1
        if level + size < cap:
            n[level + size] += 1
            self.open[level + size].append(number)
        return number

    def merged(self) -> dict[int, int]:
        """Containers still open, joined where several fit into one: old to new number."""
        into: dict[int, int] = {}
        room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        free = np.zeros(self.capacity + 1, bool)
        for level in range(self.capacity - 1, 0, -1):
            for number in self.open[level]:
                fits = np.flatnonzero(free[level:])
                if len(fits):
                    left = int(fits[0]) + level
                    into[number] = room[left].pop()
                    free[left] = bool(room[left])
                    target, left = into[number], left - level
                else:
                    target, left = number, self.capacity - level
                room[left].append(target)
                free[left] = True
        return into


def pack(
    df: DataFrame, key: str, text: str | None = None, size: str | None = None, capacity: int = 2048, shard_items: int = 50_000, sizer: Callable[[Column], Column] = token_count
) -> DataFrame:
    """One row per part of an item: key, ``part``, ``n_parts``, ``first_token``,
    ``n_tokens`` and ``container``.

    The size of an item is the column ``size`` or ``sizer`` of the column ``text``.
    Only an item over ``capacity`` is divided: into full parts, each alone in a
    container, and a rest that is packed like an item. An item without tokens
    (null, empty or blank text, null or negative size) has one part of 0 tokens
    and no container (null). Repeated keys are items each for itself; a null key
    is a key like others. Extra columns are ignored.
    """
    if (text is None) == (size is None):
        raise ValueError("give either text or size")
    base = keyed(df, [key], _t=text or size)
    n = sizer(F.col("_t")) if text else F.col("_t")
    base = base.select("_k0", F.greatest(F.coalesce(n.cast("long"), F.lit(0)), F.lit(0)).alias("_n"))
    parts = F.greatest(F.ceil(F.col("_n") / capacity), F.lit(1)).cast("int")
    items = base.select("_k0", "_n", parts.alias("n_parts")).select("_k0", "_n", "n_parts", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"))
    items = items.select("_k0", "part", "n_parts", (F.col("part").cast("long") * capacity).alias("first_token"), F.least(F.col("_n") - F.col("part").cast("long") * capacity, F.lit(capacity)).cast("int").alias("n_tokens"))
    shards = max(1, math.ceil(df.count() / shard_items))
    schema = schema_of(df, [key], "part int, n_parts int, first_token long, n_tokens int, container long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        first = (task.partitionId() if task else 0) << 40
        packer, seen, numbers = Packer(capacity), [], []
        for batch in batches:
            seen.append(batch)
            numbers.append(np.array([packer.put(s) if s else -1 for s in batch.column("n_tokens").to_pylist()], np.int64))
        into = packer.merged()
        final = np.arange(packer.made + 1)
        for old, new in into.items():
            final[old] = new
        for batch, number in zip(seen, numbers):
            own = np.where(number < 0, -1, first + final[number])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64(), mask=number < 0)], names=schema.names)

    spread = items.repartition(shards, F.xxhash64("_k0", "part")).sortWithinPartitions(F.xxhash64("_k0", "part"), "_k0", "part", "n_tokens")
    return unkeyed(spread.mapInArrow(run, schema), [key])


def bpe_sizer(ranks_path: str, pattern: str) -> Callable[[Column], Column]:
    """A sizer that counts the tokens of a public byte-level BPE given as ranks."""
    from pyspark.sql.functions import pandas_udf

    made: dict[str, object] = {}

    @pandas_udf("int")
    def count(texts):  # noqa: ANN001, ANN202
        import base64

        import tiktoken

        if "e" not in made:
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            made["e"] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return texts.map(lambda t: None if t is None else len(made["e"].encode_ordinary(t)))

    return count
