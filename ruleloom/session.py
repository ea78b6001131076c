"""Session settings, broadcast size checks and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType, VariantType

BROADCAST_BYTES = 64 << 20
#: Copies of a looked-up row that is too large to broadcast.
SALTS = 64
#: Rows that one task turns into texts or parses, and the most tasks for it.
DEALT_ROWS = 4096
MOST_DEALT = 2000
_STAGED: list[str] = []


def build_session(app: str = "ruleloom", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Reports written by models repeat keys; the last one counts. A cluster sets this itself.
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        # Small row groups still give every core a split of its own.
        .config("spark.sql.files.maxPartitionBytes", "32m")
        .getOrCreate()
    )


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` spread over tasks of about ``DEALT_ROWS`` rows by a ``key`` that is near unique.

    For short rows that cost much work each: a reader plans its tasks by bytes, and a file of a
    million such rows is one or two tasks to it.
    """
    tasks = min(MOST_DEALT, -(-df.count() // DEALT_ROWS))
    return df.repartition(tasks, key) if tasks > 1 else df


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast for a side whose text, measured on its rows, stays below a bound.

    Beyond it the side is :func:`shuffled`, and AQE splits the partitions of a hot project. The
    plan's results are the same either way.
    """
    return F.broadcast(df) if _is_small(df, max_bytes) else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """A side that grows with the input, for a shuffled join.

    Without a hint Spark goes by the bytes of the files below: a few compressed megabytes of staged
    rows are hundreds in the driver, which builds what it broadcasts.
    """
    return df.hint("merge")


def _is_small(df: DataFrame, max_bytes: int) -> bool:
    row = sum((F.coalesce(_width(F.col(f.name), f.dataType), F.lit(0)) for f in df.schema), F.lit(16))
    return (df.agg(F.sum(row)).first()[0] or 0) <= max_bytes


def lookup_join(rows: DataFrame, table: DataFrame, key: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` left-joined to a ``table`` that has one row for each of few keys, without a shuffle of ``rows`` by the key.

    The table is staged, so it is computed once and measured; below the bound it is broadcast. Beyond
    it each of its rows is copied to ``SALTS`` salts, and a key that holds most of ``rows`` is dealt to
    as many tasks.
    """
    table = staged(table, "lookup")
    if _is_small(table, max_bytes):
        return rows.join(F.broadcast(table), key, "left")
    plain = [f.name for f in rows.schema if not isinstance(f.dataType, ArrayType | StructType | MapType | VariantType)]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")


def dealt_join(rows: DataFrame, table: DataFrame, key: str, by: str, many: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` left-joined to a ``table`` that has one row for each ``key``, of which a few may hold most of ``rows``.

    A small table is broadcast. Otherwise its rows of keys that more than ``many`` rows have are copied to
    ``SALTS`` salts, and those rows are dealt to them by the column ``by``, and rows without a key, too. Such
    keys are at most one in ``many`` rows.
    """
    if _is_small(table, max_bytes):
        return rows.join(F.broadcast(table), key, "left")
    hot = F.broadcast(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > many).select(key, F.lit(True).alias("_hot")))
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")
    salted = rows.join(hot, key, "left").withColumn("_salt", F.when(F.col(key).isNull() | F.col("_hot"), salt).otherwise(0))
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = table.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return salted.drop("_hot").join(shuffled(copies), [key, "_salt"], "left").drop("_salt")


def _width(value: Column, kind: DataType) -> Column:
    """Bytes of a value, roughly: texts by length, lists by their elements, the rest flat."""
    if isinstance(kind, StringType | BinaryType):
        return F.octet_length(value) + 8
    if isinstance(kind, ArrayType):
        add = lambda total, x: total + F.coalesce(_width(x, kind.elementType), F.lit(0))
        return F.aggregate(value, F.lit(8).cast("long"), lambda total, x: add(total, x).cast("long"))
    if isinstance(kind, StructType):
        return sum((F.coalesce(_width(value[f.name], f.dataType), F.lit(0)) for f in kind), F.lit(8))
    if isinstance(kind, MapType):
        return _width(F.map_entries(value), ArrayType(StructType().add("key", kind.keyType).add("value", kind.valueType)))
    return F.lit(16) if not isinstance(kind, VariantType) else F.octet_length(F.to_json(value)) + 8


def stage_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one only where that is unset."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(stage_dir, "local"):
        stage_dir.local = tempfile.mkdtemp(prefix="ruleloom-stage-")
    return stage_dir.local


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and lets several consumers read pruned
    columns of one result instead of computing it again.
    """
    path = os.path.join(stage_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _STAGED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_staged(spark: SparkSession) -> None:
    """Delete what :func:`staged` wrote, once the results that read it are stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(conf).delete(path, True)
