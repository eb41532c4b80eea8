"""File sources and sinks: manifest CSV, JSON lines, raw documents, text lines, sidecars."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingloom.functions.text import ustrip

MANIFEST = (
    "ticker string, cik string, company string, form string, filing_date string, report_date string, accession string, primary_doc string, url string, local_path string, sha256 string, size_bytes long, downloaded_at timestamp"
)
SECTION = (
    "ticker string, cik string, company string, form string, filing_date string, report_date string, accession string, item_id string, item_title string, text string, char_count int, content_hash string"
)
CHUNK = (
    "chunk_id string, ticker string, company string, form string, filing_date string, report_date string, accession string, item_id string, item_title string, text string, chunk_index int, n_chunks_in_section int, token_count int, word_count int"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest under its schema plus ``corrupt`` (the raw row, if it did not fit)."""
    return spark.read.csv(path, header=True, schema=MANIFEST + ", corrupt string", multiLine=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="corrupt")


def malformed_rows(manifest: DataFrame, required: str = "local_path") -> DataFrame:
    """Rows whose required field is null or blank."""
    return manifest.where(F.coalesce(ustrip(F.col(required)), F.lit("")) == "")


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """Types guessed from the data: an extra pass over it, for diagnostics only."""
    return spark.read.csv(path, header=True, inferSchema=True)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """One object per line, UTF-8 unescaped, null fields kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"')


def read_documents(spark: SparkSession, path: str, pattern: str = "*.htm*") -> DataFrame:
    """(``path``, ``name``, ``size``, ``content``) of raw files; bytes as they are."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "content")


def decode_utf8(df: DataFrame, column: str, out: str) -> DataFrame:
    """Bytes to text with damaged sequences replaced, as Python does it."""
    schema = T.StructType([*[f for f in df.schema.fields if f.name != column], T.StructField(out, T.StringType())])
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if v is None else v.decode("utf-8", "replace") for v in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def with_documents(manifest: DataFrame, documents: DataFrame, path: str = "local_path") -> tuple[DataFrame, DataFrame]:
    """(manifest rows with their file, rows whose file is missing), matched by the
    end of the path. The contents move only for the match by name."""
    rows = manifest.withColumn("_name", F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1))
    files = documents.select(F.col("name").alias("_name"), "content")
    found = rows.where("_name <> ''").join(files, "_name").drop("_name")
    missing = rows.join(documents.select(F.col("name").alias("_name")), "_name", "left_anti").drop("_name")
    return found, missing


def read_lines(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """Stripped lines that are neither blank nor a comment, with file and no order."""
    rows = spark.read.text(path).select(ustrip(F.col("value")).alias("line"))
    return rows.where((F.col("line") != "") & ~F.col("line").startswith(comment))


def _at(path: str) -> tuple:
    """(Hadoop path, its file system) of the running session."""
    spark = SparkSession.builder.getOrCreate()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def read_sidecar(path: str) -> dict | None:
    """A JSON sidecar, or None where there is none. The driver reads it through the same
    file system as the tables beside it."""
    at, system = _at(path)
    if not system.exists(at):
        return None
    stream = system.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
    finally:
        stream.close()


def write_sidecar(path: str, values: Mapping[str, object]) -> None:
    at, system = _at(path)
    stream = system.create(at, True)
    try:
        stream.write(bytearray(json.dumps(values, indent=2, ensure_ascii=False, default=str).encode("utf-8")))
    finally:
        stream.close()


def write_texts(df: DataFrame, path: str, by: str, text: str, mode: str = "error", compression: str = "none") -> None:
    """One folder per value of ``by``, texts as files of lines."""
    df.select(by, F.col(text).alias("value")).write.mode(mode).partitionBy(by).option("compression", compression).text(path)


def write_files(df: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """Write bytes to ``folder``/name exactly as they are; returns (name, bytes, sha256).

    Each task writes its own rows under a temporary name and renames, so a task
    that runs again leaves the same files. ``folder`` is one all executors share.
    """
    import hashlib
    import os

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sizes, sums = [], [], []
            for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                target = os.path.join(folder, n)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(c)
                os.replace(part, target)
                names.append(n)
                sizes.append(len(c))
                sums.append(hashlib.sha256(c).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64()), pa.array(sums)], names=["name", "bytes", "sha256"])

    return df.select(name, content).where(F.col(content).isNotNull()).mapInArrow(run, "name string, bytes long, sha256 string")


def read_matrix(spark: SparkSession, path: str, keys: list, key: str = "vec_id", out: str = "embedding", rows_per_part: int = 65_536) -> DataFrame:
    """A .npy matrix as (key, array<float>): positions become keys, so nothing later
    depends on order. The file is mapped, each task reads its own rows."""
    import numpy as np

    n = int(np.load(path, mmap_mode="r").shape[0])
    if len(keys) != n:
        raise ValueError(f"{len(keys)} keys for {n} rows")
    kind = "bigint" if all(isinstance(k, int) for k in keys) else "string"
    named = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], f"pos long, key {kind}").repartitionByRange(max(1, -(-n // rows_per_part)), "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.load(path, mmap_mode="r")
        for b in batches:
            part = np.asarray(m[b.column(0).to_numpy()], np.float32)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(list(part), pa.list_(pa.float32()))], names=[key, out])

    return named.mapInArrow(run, f"`{key}` {kind}, `{out}` array<float>")


def read_entity_map(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, cik, company) from a JSON object of numbered entries
    {"0": {"cik_str": ..., "ticker": ..., "title": ...}, ...}."""
    whole = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string, struct<cik_str: bigint, ticker: string, title: string>>")
    return whole.select(F.explode(entries).alias("_", "e")).select("e.ticker", F.col("e.cik_str").alias("cik"), F.col("e.title").alias("company"))


def required_setting(name: str) -> str:
    """A setting from the environment; its absence is an error, its value is in no plan."""
    import os

    value = os.environ.get(name, "")
    if not value:
        raise RuntimeError(f"{name} is not set")
    return value
