"""Dataset sinks for audit contexts, reports and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.session import staged


def as_json(table: DataFrame, *keys: str) -> DataFrame:
    """Keep the key columns and pack the rest of each row into one JSON text."""
    rest = [c for c in table.columns if c not in keys]
    # Missing values are written as null, as the documented form has every field.
    return table.select(*keys, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("json"))


def replace_projects(table: DataFrame, target: str, projects: DataFrame, form: str = "parquet") -> None:
    """Store ``table`` by project so that a repeated job replaces what it stored before.

    Each project of ``projects``, those the job covers, holds exactly its rows of ``table`` afterwards:
    its folder is overwritten, and removed when it has no row any more. Other projects stay as they
    are. A job that failed on the way is made good by running it again.
    """
    spark = table.sparkSession
    table = staged(table, "projects-out")
    table.write.format(form).mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("project_id").save(target)
    gone = projects.select("project_id").distinct().join(table.select("project_id").distinct(), "project_id", "left_anti")
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(target)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for row in gone.toLocalIterator():
        if row["project_id"] is not None:
            system.delete(jvm.org.apache.hadoop.fs.Path(folder, f"project_id={escaped(row['project_id'])}"), True)


def write_json(table: DataFrame, target: str, *partition_by: str) -> None:
    table.write.mode("errorifexists").partitionBy(*partition_by).option("ignoreNullFields", "false").json(target)


def write_texts(texts: DataFrame, target: str) -> None:
    """Prompt texts as Parquet: they hold newlines, which a line format would break."""
    texts.write.mode("errorifexists").parquet(target)
