"""Acquisition: select what is wanted, skip what is there, fetch, write, upsert."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingloom.operators.selection import latest_wins, not_yet_present
from filingloom.session import materialize
from filingloom.sources.files import write_files


def filing_url(base: str, cik: Column, accession: Column, document: Column) -> Column:
    """base/cik/accession without dashes/document."""
    return F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(cik.cast("string"), F.lit("0")), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), document)


def local_name(ticker: Column, form: Column, report_date: Column, accession: Column, document: Column, default: str = ".htm") -> Column:
    """ticker/form_date_accession with the document's ending, or the default one."""
    ending = F.coalesce(F.nullif(F.regexp_extract(document, r"(\.[A-Za-z0-9]+)$", 1), F.lit("")), F.lit(default))
    return F.concat(ticker, F.lit("/"), form, F.lit("_"), report_date, F.lit("_"), accession, ending)


def named_tickers(arguments: Sequence[str]) -> list[str]:
    """The tickers among command-line arguments: in capitals, options (``--x``) aside."""
    return [a.upper() for a in arguments if not a.startswith("--")]


def wanted(selected: DataFrame, manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Selected filings with a document, less those in the manifest whose file is present
    (``present`` has ``local_path``)."""
    have = manifest.join(present.select("local_path"), "local_path", "left_semi")
    return not_yet_present(selected.where(F.coalesce("primary_doc", F.lit("")) != ""), have, ["accession"])


def fetched(rows: DataFrame, url: str, get: Callable[[str], bytes]) -> DataFrame:
    """All columns plus ``content`` from an injected getter. One partition, as a polite
    rate is a global one; a failed address has null content."""
    schema = T.StructType([*rows.schema.fields, T.StructField("content", T.BinaryType())])
    at = rows.columns.index(url)

    def one(u: str) -> bytes | None:
        try:
            return get(u)
        except Exception:  # noqa: BLE001
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([one(u) for u in b.column(at).to_pylist()], pa.binary())], names=schema.names)

    return rows.coalesce(1).mapInArrow(run, schema)


def download(rows: DataFrame, folder: str, get: Callable[[str], bytes], small: int = 100_000) -> DataFrame:
    """Fetch, write under ``folder`` and give the new manifest rows, with ``small_file``.

    An action, not a plan: every address is fetched and written once, now; the rows
    given back are read from a table in the shared folder. ``rows`` has the manifest's
    columns but for the last three, with url and local_path.
    """
    asked = rows.withColumn("_asked_at", F.current_timestamp())
    got = fetched(asked, "url", get).where("content is not null")
    written = materialize(write_files(got, folder, "local_path", "content"), "downloaded")
    done = asked.join(written.withColumnRenamed("name", "local_path"), "local_path").withColumnRenamed("_asked_at", "downloaded_at")
    done = done.withColumnRenamed("bytes", "size_bytes").withColumn("small_file", F.col("size_bytes") < small)
    return materialize(done, "manifest_rows")


def updated(manifest: DataFrame, new: DataFrame) -> DataFrame:
    """The manifest with the new rows in place of those of the same accession."""
    return latest_wins(manifest, new.select(*manifest.columns), ["accession"])
