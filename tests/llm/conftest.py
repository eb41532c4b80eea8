import pytest

#: Columns that operators must ignore: their internal names and result names.
CLASHES = ("_t", "_n", "_q", "h", "a", "b", "piece", "defect", "changed", "clean_text", "garbled", "languages", "container", "part", "score", "line_no")


@pytest.fixture
def with_clashes():
    """Add columns with clashing names to a table, except for its own."""
    from pyspark.sql import functions as F

    def add(df):
        return df.select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in df.columns])

    return add
