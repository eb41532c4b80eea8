"""The stages from raw filings to a verified answer, as one plan of DataFrames."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.operators import aggregates, answers, chunking, cleaning, html, retrieval, sections
from filingloom.session import materialize


def section_records(filings: DataFrame, content: str = "content", min_chars: int = 50) -> DataFrame:
    """Filings with their HTML to cleaned section records; no shuffle.

    One Arrow stage parses a filing into its array of sections; the rules over a filing
    run on that array, cleaning and the rest within the section's row.
    """
    keep = ["ticker", "cik", "company", "form", "filing_date", "report_date", "accession"]
    listed = html.section_lists(filings, keep, content)
    kept = listed.withColumn("sections", sections.kept_in_filing(F.col("sections")))
    parted = kept.select(*keep, F.inline(sections.parts_in_filing(F.col("sections"), F.col("form"))))
    clean = cleaning.strip_boilerplate(parted, [*keep, "item_id", "item_title"], "text")
    done = sections.finish_records(clean, min_chars)
    return done.select(*keep, "item_id", "item_title", "text", "char_count", "content_hash")


def index_of(records: DataFrame, encoder: retrieval.Encoder, size: int = 500, overlap: int = 50, limit: int = 512) -> DataFrame:
    """Chunks with their vectors; no shuffle. Chunks over ``limit`` tokens fail."""
    chunks = chunking.chunk_records(records, size, overlap)
    guarded = chunking.guard_length(chunks, F.col("token_count"), limit, "chunk_id")
    return retrieval.embed(guarded, "text", encoder)


def answer_questions(questions: DataFrame, index: DataFrame, encoder: retrieval.Encoder, generator: answers.Generator, k: int = 5, prefix: str = "", per_million: Mapping[str, float] = {}) -> DataFrame:
    """(question_id, question, answer, retrieved, citations, citations_valid,
    fabricated_citations, retrieval_ms, generation_ms, input_tokens, output_tokens,
    cost, stop_reason).

    ``questions`` has question_id and question. All questions are one job; retrieval
    runs as an action of its own, and its time per question is the whole over their
    number. ``per_million`` weighs the token columns to a cost.
    """
    began = time.perf_counter()
    asked = retrieval.embed(questions.select("question_id", "question"), "question", encoder, prefix=prefix)
    asked = asked.select("question_id", "question", F.col("embedding").alias("_v"))
    top = materialize(retrieval.cosine_topk(asked.withColumnRenamed("_v", "embedding"), index, "question_id", "chunk_id", "embedding", k), "retrieved")
    each = round((time.perf_counter() - began) * 1000 / max(1, questions.count()))
    hits = top.join(index.drop("embedding"), "chunk_id")
    grouped = retrieval.context(hits, "query_id")
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.round("score", 4).alias("score"), "ticker", "form", "report_date", "filing_date", "item_title"))).alias("retrieved"))
    prompt = F.concat(F.lit("Context:\n\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), F.col("question"))
    base = questions.select("question_id", "question").join(grouped.withColumnRenamed("query_id", "question_id"), "question_id", "left").join(listed.withColumnRenamed("query_id", "question_id"), "question_id", "left")
    made = answers.generate(base.select("question_id", prompt.alias("prompt")), "question_id", "prompt", generator)
    checked = answers.verify_citations(base.join(made, "question_id"), "answer", "retrieved_ids")
    checked = aggregates.weighted_cost(checked, per_million).withColumn("retrieval_ms", F.lit(each))
    return checked.select("question_id", "question", "answer", "retrieved", F.col("cited").alias("citations"), F.col("valid").alias("citations_valid"), F.col("fabricated").alias("fabricated_citations"), "retrieval_ms", "generation_ms", "input_tokens", "output_tokens", "cost", "stop_reason")
