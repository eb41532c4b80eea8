"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("filingloom")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package; safe to call again and again."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir`` of the session, or the
    one given to ``setCheckpointDir``.

    Only where neither is set and the master is local (tests, local runs) is a folder
    of our own made; on a cluster that is an error, as a machine's own folder is not
    seen by the others.
    """
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("filingloom.checkpoint.dir", None)
    if not own:
        master = spark.sparkContext.master
        if not master.split("[")[0] == "local":
            raise RuntimeError(f"spark.checkpoint.dir is not set, and {master} is no local master")
        own = "file://" + tempfile.mkdtemp(prefix="filingloom_")
        spark.conf.set("filingloom.checkpoint.dir", own)
    return own.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/filingloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Remove all tables ``materialize`` wrote. Results that still read them are lost, so
    this is for the end of a job."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/filingloom")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
