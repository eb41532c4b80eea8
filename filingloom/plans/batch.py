"""A batch of questions as one run: configuration, results and metrics on disk."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.operators import answers, retrieval
from filingloom.plans.pipeline import answer_questions
from filingloom.sources.files import read_lines, write_jsonl, write_sidecar


def numbered_questions(spark, path: str) -> DataFrame:  # noqa: ANN001
    """(question_id, question): the file's questions; equal ones are one question."""
    lines = read_lines(spark, path).distinct()
    return lines.select(F.xxhash64("line").alias("question_id"), F.col("line").alias("question"))


def run_batch(questions: DataFrame, index: DataFrame, encoder: retrieval.Encoder, generator: answers.Generator, folder: str, config: Mapping[str, object], k: int = 5, prefix: str = "", stamp: str | None = None, per_million: Mapping[str, float] = {}) -> DataFrame:
    """Answer all questions in one job, write ``run_<stamp>`` (JSON lines) and
    ``config_<stamp>.json``, and return the results as written.

    ``answers.run_metrics(results, "run", "question_id")`` gives the run's figures.
    """
    stamp = stamp or datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")
    write_sidecar(f"{folder}/config_{stamp}.json", {"run": stamp, "top_k": k, "query_prefix": prefix, **config})
    results = answer_questions(questions, index, encoder, generator, k, prefix, per_million).withColumn("run", F.lit(stamp))
    write_jsonl(results, f"{folder}/run_{stamp}")
    return questions.sparkSession.read.schema(results.schema).json(f"{folder}/run_{stamp}")
