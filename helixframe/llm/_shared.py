"""Where intermediate tables and files go, and small helpers on sessions."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import _cluster

MB = 1 << 20
#: (session, folder) of what is still to be deleted when the driver ends.
_left: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that driver and executors share.

    Only a local master, which needs no shared folder, gets one of its own where
    the session names none (as in tests); on a cluster that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = found.get() if found.isDefined() else None
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = f"file://{os.path.join(tempfile.gettempdir(), 'helixframe-shared')}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB at most: texts, sketches and messages are long rows, and JVM and worker both hold a batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().getConfString(key, "67108864b").rstrip("b")) > 8 * MB:
        spark.conf.set(key, str(8 * MB))


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder for intermediate data; it goes when the driver ends, if not before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _left.append((spark, path))
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """Written as a Parquet table in the shared folder and read again."""
    spark = df.sparkSession
    _cluster.ensure_importable(spark)
    _small_batches(spark)
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._helixframe_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t._helixframe_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _left[:] = [x for x in _left if x[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in list(_left):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended before: nothing can be done from here
            return


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    _cluster.ensure_importable(spark)
    _small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
