"""Citations of answers, their verification, answer assembly and run metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingloom.functions.text import ustrip
from filingloom.operators.aggregates import upper_median
from filingloom.operators.windows import without_first

Generator = Callable[[list[str]], list[dict]]


def citations(answer: Column) -> Column:
    """Cited ids, sorted: the parts (between commas and semicolons) of every innermost
    bracket that holds a bar. Null and bare answers cite nothing."""
    groups = F.filter(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[([^\[\]]+)\]"), F.lit(1)), lambda g: g.contains("|"))
    parts = F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, "[,;]"))), ustrip)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: p != "")))


def verify_citations(df: DataFrame, answer: str, retrieved_ids: str) -> DataFrame:
    """All columns plus ``cited``, ``fabricated`` (cited, not retrieved; sorted) and
    ``valid`` (nothing fabricated; an answer without citations is valid)."""
    cited = df.withColumn("cited", citations(F.col(answer)))
    known = F.coalesce(F.col(retrieved_ids), F.array().cast("array<string>"))
    return cited.withColumn("fabricated", F.array_sort(F.array_except("cited", known))).withColumn("valid", F.size("fabricated") == 0)


def generate(prompts: DataFrame, key: str, prompt: str, generator: Generator) -> DataFrame:
    """(key, ``answer``, ``input_tokens``, ``output_tokens``, ``stop_reason``,
    ``generation_ms``) from an injected generator; no service is called by default."""
    import time

    rest = "answer string, input_tokens int, output_tokens int, stop_reason string, generation_ms int"
    schema = T.StructType([prompts.schema[key], *T.StructType.fromDDL(rest).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = time.perf_counter()
            made = generator(b.column(1).to_pylist())
            each = round((time.perf_counter() - t) * 1000 / max(1, len(made)))
            cols = [pa.array([m.get(f) for m in made], k) for f, k in (("answer", pa.string()), ("input_tokens", pa.int32()), ("output_tokens", pa.int32()), ("stop_reason", pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array([each] * len(made), pa.int32())], names=schema.names)

    return prompts.select(key, prompt).mapInArrow(run, schema)


def echo_generator(prompts: list[str]) -> list[dict]:
    """A stub that cites the first chunk of its context, for tests and dry runs."""
    out = []
    for p in prompts:
        first = p[p.find("[") + 1 : p.find("]")] if "[" in p else ""
        text = f"See the first source [{first}]." if first else "The sources do not say."
        out.append({"answer": text, "input_tokens": len(p.split()), "output_tokens": len(text.split()), "stop_reason": "end_turn"})
    return out


def run_metrics(results: DataFrame, run: str, order: str, cost: str | None = None) -> DataFrame:
    """Per run: questions, answers with fabricated citations, upper medians of the
    warm retrieval and of the generation time, token sums, and with a ``cost`` column
    its sum and its mean per question."""
    spent = [F.round(F.sum(cost), 6).alias("total_cost"), F.round(F.avg(cost), 6).alias("cost_each")] if cost else []
    sums = results.groupBy(run).agg(F.count("*").alias("questions"), F.count_if(F.size("fabricated_citations") > 0).alias("fabricated_answers"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), *spent)
    warm = upper_median(without_first(results.select(run, order, "retrieval_ms"), [run], [order]), [run], "retrieval_ms").select(run, F.col("upper_median").alias("retrieval_ms_warm"))
    made = upper_median(results.select(run, "generation_ms"), [run], "generation_ms").select(run, F.col("upper_median").alias("generation_ms"))
    return sums.join(warm, run, "left").join(made, run, "left")


def report_line(df: DataFrame) -> DataFrame:
    """One printable line per answer."""
    fmt = "%s | citations valid: %s | retrieval %d ms, generation %d ms | tokens %d in / %d out"
    return df.select(F.format_string(fmt, F.coalesce("question", F.lit("")), F.coalesce(F.col("citations_valid").cast("string"), F.lit("unknown")), "retrieval_ms", "generation_ms", "input_tokens", "output_tokens").alias("line"))
