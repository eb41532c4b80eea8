import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingloom.operators import answers, retrieval
from filingloom.plans import acquire, batch, pipeline
from filingloom.sources import files

COLUMNS = "ticker string, cik string, company string, form string, filing_date string, report_date string, accession string, primary_doc string, url string, local_path string"


def test_download_skips_present_files_and_upserts(spark, tmp_path):
    have = spark.createDataFrame([("A", "1", "Co", "10-K", "d", "2024-12-31", "1-24-1", "a.htm", "u", "A/old.htm", "h", 5, None), ("A", "1", "Co", "10-K", "d", "2023-12-31", "1-23-1", "b.htm", "u", "A/gone.htm", "h", 5, None)], files.MANIFEST)
    present = spark.createDataFrame([("A/old.htm",)], "local_path string")
    chosen = spark.createDataFrame([("A", "0001", "Co", "10-K", "d", "2024-12-31", "1-24-1", "a.htm"), ("A", "0001", "Co", "10-K", "d", "2023-12-31", "1-23-1", "b.txt"), ("A", "0001", "Co", "10-K", "d", "2022-12-31", "1-22-1", ""), ("A", "0001", "Co", "10-K", "d", "2021-12-31", "1-21-1", "noending")], "ticker string, cik string, company string, form string, filing_date string, report_date string, accession string, primary_doc string")
    todo = acquire.wanted(chosen, have, present)
    assert sorted(r["accession"] for r in todo.collect()) == ["1-21-1", "1-23-1"]
    todo = todo.withColumn("url", acquire.filing_url("http://x.example/data/", F.col("cik"), F.col("accession"), F.col("primary_doc"))).withColumn("local_path", acquire.local_name(F.col("ticker"), F.col("form"), F.col("report_date"), F.col("accession"), F.col("primary_doc")))
    urls = sorted(r["url"] for r in todo.collect())
    assert urls == ["http://x.example/data/1/1211/noending", "http://x.example/data/1/1231/b.txt"]

    calls = tmp_path / "calls"

    def get(u):
        with open(calls, "a") as f:
            f.write(u + "\n")
        if u.endswith("noending"):
            raise RuntimeError("404")
        return b"<p>filing</p>"

    new = acquire.download(todo, str(tmp_path), get)
    assert [(r["local_path"], r["size_bytes"], r["small_file"]) for r in new.collect()] == [("A/10-K_2023-12-31_1-23-1.txt", 13, True)]
    assert (tmp_path / "A" / "10-K_2023-12-31_1-23-1.txt").read_bytes() == b"<p>filing</p>"
    got = {r["accession"]: r["local_path"] for r in acquire.updated(have, new).collect()}
    assert len(calls.read_text().split()) == 2  # each address once, however often the rows are used
    assert acquire.named_tickers(["--dry-run", "abc", "Xyz"]) == ["ABC", "XYZ"]
    assert got == {"1-24-1": "A/old.htm", "1-23-1": "A/10-K_2023-12-31_1-23-1.txt"}


def test_batch_writes_config_and_results(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# questions\nacres of land?\n\nacres of land?\npumps?\n", encoding="utf-8")
    recs = spark.createDataFrame([("T", "C", "10-K", "d", "r", "a", "10-K:I-2", "Land", "acres of land")], "ticker string, company string, form string, filing_date string, report_date string, accession string, item_id string, item_title string, text string")
    encoder = retrieval.hashing_encoder(32)
    index = pipeline.index_of(recs, encoder)
    got = batch.run_batch(batch.numbered_questions(spark, str(tmp_path / "q.txt")), index, encoder, answers.echo_generator, str(tmp_path), {"generator": "stub"}, stamp="s", per_million={"input_tokens": 1.0, "output_tokens": 5.0})
    assert got.count() == 2 and all(r["citations_valid"] for r in got.collect())
    assert json.loads((tmp_path / "config_s.json").read_text())["generator"] == "stub"
    lines = answers.report_line(got).collect()
    assert all("citations valid: true" in r["line"] for r in lines)
    m = answers.run_metrics(got, "run", "question_id", "cost").first()
    rows = got.collect()
    assert m["questions"] == 2 and m["fabricated_answers"] == 0 and m["retrieval_ms_warm"] == rows[0]["retrieval_ms"]
    assert m["total_cost"] == pytest.approx(sum(r["input_tokens"] / 1e6 + 5 * r["output_tokens"] / 1e6 for r in rows), abs=2e-6)


def test_matrix_entity_map_and_settings(spark, tmp_path, monkeypatch):
    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "m.npy", m)
    got = {r["vec_id"]: r["embedding"] for r in files.read_matrix(spark, str(tmp_path / "m.npy"), ["a", "b", "c", "d"], rows_per_part=2).collect()}
    assert got == {k: m[i].tolist() for i, k in enumerate("abcd")}
    with pytest.raises(ValueError):
        files.read_matrix(spark, str(tmp_path / "m.npy"), ["a"])
    (tmp_path / "t.json").write_text(json.dumps({"0": {"cik_str": 7, "ticker": "AA", "title": "Acme"}, "1": {"cik_str": 8, "ticker": "BB", "title": "Bee"}}))
    assert sorted(tuple(r) for r in files.read_entity_map(spark, str(tmp_path / "t.json")).collect()) == [("AA", 7, "Acme"), ("BB", 8, "Bee")]
    monkeypatch.setenv("AGENT_NAME", "x")
    assert files.required_setting("AGENT_NAME") == "x"
    monkeypatch.delenv("AGENT_NAME")
    with pytest.raises(RuntimeError):
        files.required_setting("AGENT_NAME")
