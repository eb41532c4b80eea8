"""Shared pieces of the text operators: tokens and key handling."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode white space (fixed values), as inside of a character class.
WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The project's token: a run of letters, digits and underscores, or one other sign.
TOKEN = re.compile(rf"\w+|[^\w{WS}]")


def keyed(df: DataFrame, keys: Sequence[str], **cols: str) -> DataFrame:
    """Only the key columns as ``_k0``, ``_k1``... and ``cols`` under internal names.

    Extra columns of the input, whatever they are called, never reach an operator.
    """
    return df.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`").alias(n) for n, c in cols.items()])


def schema_of(df: DataFrame, keys: Sequence[str], rest: str) -> T.StructType:
    """Key fields as in ``df`` under internal names, then the fields of the DDL ``rest``."""
    own = [T.StructField(f"_k{i}", df.schema[k].dataType) for i, k in enumerate(keys)]
    return T.StructType(own + T.StructType.fromDDL(rest).fields)


def unkeyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Give the key columns their names back; a clash with a result column is an error."""
    rest = [c for c in df.columns if not c.startswith("_k")]
    if clash := {k.lower() for k in keys} & {c.lower() for c in rest}:
        raise ValueError(f"key columns {sorted(clash)} have names of result columns; rename them first")
    return df.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *rest)
