"""Helpers shared by the operators of this subpackage: reading, lineage cuts, labels of splits."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: About so much of a table's rows goes to a Python worker at a time; Spark's own 64 MB is held there and, twice, beside the executor's heap.
BATCH_BYTES = "2m"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_STAGED: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on this session sends batches of ``BATCH_BYTES`` to Python workers; a size that it was given stays.

    What is planned later follows it, so it has to hold until a frame is written. Rows and results are the same with any.
    """
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``; only where it is unset and Spark is local (tests) one below the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.stage"


def staged(df: DataFrame, **options: str | int) -> DataFrame:
    """Cut the lineage: write a Parquet table into the shared folder and read it again.

    Every executor and the driver read it from there, so a lost executor costs nothing. ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_so_far() -> int:
    """Mark for :func:`release`: tables staged later are those after it."""
    return len(_STAGED)


def release(spark: SparkSession, keep: DataFrame | None = None, since: int = 0) -> None:
    """Delete the tables that :func:`staged` wrote, once the results that read them are stored.

    Tables that ``keep`` reads stay, and so do those from before the mark ``since``.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    read = [] if keep is None else keep.inputFiles()
    later = _STAGED[since:]
    kept = [p for p in later if any(p.rpartition("/")[2] in f for f in read)]
    for name in set(later) - set(kept):
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    _STAGED[since:] = kept


def held_out(doc_id: str, remainder: int) -> Column:
    """True where crc32 of the id as text leaves ``remainder`` by 5; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == remainder, F.lit(False))
