import json

import pytest
from pyspark.sql import functions as F

from filingloom.sources import files, pages
from filingloom.streaming import ingest


def test_manifest_with_malformed_row(spark, tmp_path):
    head = files.MANIFEST.replace(" string", "").replace(" long", "").replace(" timestamp", "").replace(" ", "")
    good = 'AA,1,"Acme, Inc.",10-K,2024-01-01,2023-12-31,0001-24-1,a.htm,http://x,raw/AA/a.htm,ff,10,2024-02-01T00:00:00Z'
    bad = '"BB,2,Bad,10-K,2024-01-01"'
    (tmp_path / "m.csv").write_text("\n".join([head, good, bad]) + "\n", encoding="utf-8")
    m = files.read_manifest(spark, str(tmp_path / "m.csv"))
    assert m.count() == 2
    r = m.where("ticker = 'AA'").first()
    assert r["company"] == "Acme, Inc." and r["size_bytes"] == 10
    assert files.malformed_rows(m).count() == 1
    assert files.read_csv_inferred(spark, str(tmp_path / "m.csv")).count() == 2


def test_jsonl_round_trip_keeps_nulls_and_unicode(spark, tmp_path):
    df = spark.createDataFrame([("é – 日本", None), (None, 2)], "a string, b int")
    files.write_jsonl(df, str(tmp_path / "j"))
    raw = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "j").glob("part*"))
    assert "é – 日本" in raw and '"b":null' in raw
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "j"), "a string, b int").collect()), key=str) == sorted([("é – 日本", None), (None, 2)], key=str)


def test_documents_missing_files_and_written_bytes(spark, tmp_path):
    df = spark.createDataFrame([("AA/10-K_a.htm", bytearray(b"<p>\xff</p>")), ("AA/10-Q_b.htm", bytearray(b"x"))], "name string, content binary")
    got = {r["name"]: r["bytes"] for r in files.write_files(df, str(tmp_path / "raw"), "name", "content").collect()}
    assert got == {"AA/10-K_a.htm": 8, "AA/10-Q_b.htm": 1}
    docs = files.read_documents(spark, str(tmp_path / "raw"), "10-K_*.htm")
    assert [r["name"] for r in docs.collect()] == ["10-K_a.htm"]
    assert files.decode_utf8(docs.select("name", "content"), "content", "text").first()["text"] == "<p>�</p>"
    m = spark.createDataFrame([("1", "raw/AA/10-K_a.htm"), ("2", "raw/AA/gone.htm"), ("3", None)], "accession string, local_path string")
    found, missing = files.with_documents(m, docs)
    assert [r["accession"] for r in found.collect()] == ["1"] and sorted(r["accession"] for r in missing.collect()) == ["2", "3"]


def test_lines_texts_csv_and_sidecars(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# note\n\n  one?  \n  # more\ntwo?\n", encoding="utf-8")
    assert sorted(r["line"] for r in files.read_lines(spark, str(tmp_path / "q.txt")).collect()) == ["one?", "two?"]
    assert files.read_sidecar(str(tmp_path / "none.json")) is None
    files.write_sidecar(str(tmp_path / "m.json"), {"dim": 384})
    assert files.read_sidecar(str(tmp_path / "m.json")) == {"dim": 384}
    df = spark.createDataFrame([("plain", "a"), ("tables", "b")], "parser string, text string")
    files.write_texts(df, str(tmp_path / "t"), "parser", "text")
    assert (tmp_path / "t" / "parser=plain").exists()
    files.write_csv(df, str(tmp_path / "c"))
    assert files.read_csv_inferred(spark, str(tmp_path / "c")).count() == 2


def test_paged_source_skips_old_pages(spark, tmp_path):
    def page(name, dates):
        (tmp_path / name).write_text(json.dumps({"accessionNumber": [f"{name}{i}" for i in range(len(dates))], "filingDate": dates, "reportDate": dates, "form": ["10-K"] * len(dates), "primaryDocument": ["a.htm"] * len(dates)}))

    page("new.json", ["2024-01-01", "2023-01-01"])
    page("old.json", ["2010-01-01"])
    (tmp_path / "index.json").write_text(json.dumps({"pages": [{"name": "new.json"}, {"name": "old.json", "to": "2010-12-31"}]}))
    pages.register(spark)
    read = lambda **o: spark.read.format("json_pages").option("index", str(tmp_path / "index.json")).options(**o).load()
    assert read().count() == 3
    assert read(since="2022-01-01").count() == 2
    assert read().where(F.col("filingDate") >= "2023-06-01").count() == 1
    reader = pages.PagesReader({"index": str(tmp_path / "index.json"), "since": "2022-01-01"}, ["form"])
    assert len(reader.partitions()) == 1


def test_polite_getter_waits_retries_and_gives_up():
    waits, now = [], [0.0]

    def sleep(s):
        waits.append(s)
        now[0] += s

    replies = iter([(503, b""), (200, b"ok"), (200, b"again")])
    clock = lambda: now[0]
    get = pages.Polite(lambda u: next(replies), sleep=sleep, clock=clock)
    assert get("u") == b"ok" and get("u") == b"again"
    assert waits == [1, pytest.approx(0.2)]
    with pytest.raises(RuntimeError, match="404"):
        pages.Polite(lambda u: (404, b""), sleep=sleep, clock=clock)("u")

    def broken(u):
        raise ConnectionError

    waits.clear()
    with pytest.raises(RuntimeError, match="gave up"):
        pages.Polite(broken, pages.Policy(gap=0), sleep=sleep, clock=clock)("u")
    assert waits == [1, 2, 4, 8, 16]


def test_paged_source_fetches_through_the_injected_request(spark, tmp_path):
    columns = pages.PagesSource.COLUMNS
    stored = {f"mem://x/{n}": json.dumps({c: [d, d] for c in columns}).encode() for n, d in (("a", "2024-05-05"), ("b", "2010-01-01"))}
    stored["mem://x/index"] = json.dumps({"pages": [{"name": "a"}, {"name": "b", "to": "2010-12-31"}]}).encode()
    failed = []

    def request(url):
        if url.endswith("/a") and not failed:
            failed.append(url)
            return 503, b""
        return 200, stored[url]

    pages.register(spark, request, pages.Policy(gap=0, first_wait=0))
    try:
        read = spark.read.format("json_pages").option("index", "mem://x/index")
        assert read.load().count() == 4 and read.option("since", "2022-01-01").load().count() == 2
        assert read.load().rdd.getNumPartitions() == 1
    finally:
        pages.register(spark)


def test_stream_ingest_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, v int, t string")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        s = ingest.landing_stream(spark, str(tmp_path / "in"), df.schema)
        ingest.ingest(s, str(tmp_path / "out"), ["k"], "v", str(tmp_path / "cp")).awaitTermination()
    got = sorted(tuple(r) for r in ingest.current(spark, str(tmp_path / "out"), ["k"], "v").collect())
    assert got == [("a", 3, "y"), ("b", 2, "z")]
    spark.createDataFrame([("a", 9, "w")], df.schema).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.ingest(ingest.landing_stream(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "out"), ["k"], "v", str(tmp_path / "cp")).awaitTermination()
    assert sorted(tuple(r) for r in ingest.current(spark, str(tmp_path / "out"), ["k"], "v").collect()) == [("a", 9, "w"), ("b", 2, "z")]


def test_stream_windows_and_first_seen(spark, tmp_path):
    rows = [("1", "a", "2024-01-01 00:01:00", 1.0), ("1", "a", "2024-01-01 00:01:00", 1.0), ("2", "a", "2024-01-01 00:02:00", 2.0), ("3", "b", "2024-01-01 02:00:00", 4.0)]
    df = spark.createDataFrame(rows, "id string, g string, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    s = ingest.landing_stream(spark, str(tmp_path / "in"), df.schema)
    q = ingest.windowed_counts(s, "ts", ["g"], "v", "5 minutes", "10 minutes").writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["g"], r["n"], r["total"]) for r in spark.table("w").collect()] == [("a", 3, 4.0)]
    q = ingest.first_seen(ingest.landing_stream(spark, str(tmp_path / "in"), df.schema), "id", "ts", "10 minutes").writeStream.format("memory").queryName("f").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["id"] for r in spark.table("f").collect()) == ["1", "2", "3"]
