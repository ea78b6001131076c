"""Corpus tables ``(project_id, path, content)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.functions.paths import forward_slashes
from ruleloom.sources.tree import list_files, read_files


def utf8_text(raw: Column) -> Column:
    """Bytes as text; broken sequences become the replacement character."""
    return F.make_valid_utf8(raw.cast("string"))


def scan_tree(spark: SparkSession, root: str, project_id: str | None = None, path_filter: Column | None = None) -> DataFrame:
    """Whole files under ``root``, one row each, whatever their names begin with.

    Without ``project_id`` the first folder below ``root`` names the project; files directly
    in ``root`` then belong to no project and are left out. ``path_filter``, a condition on
    the column ``path`` (the whole path), prunes files before they are read.
    """
    listed = list_files(spark, root)
    if path_filter is not None:
        listed = listed.where(path_filter)
    base = root.rstrip("/") + "/"
    relative = F.substr(forward_slashes(F.col("path")), F.lit(len(base) + 1))
    scan = read_files(listed).select(relative.alias("relative"), utf8_text(F.col("content")).alias("content"))
    if project_id is not None:
        return scan.select(F.lit(project_id).alias("project_id"), F.col("relative").alias("path"), "content")
    return scan.where(F.contains("relative", F.lit("/"))).select(
        F.regexp_extract("relative", r"\A([^/]+)/", 1).alias("project_id"),
        F.regexp_replace("relative", r"\A[^/]+/", "").alias("path"),
        "content",
    )


def corpus_table(table: DataFrame, project_id: str, path: str, content: str) -> DataFrame:
    """Corpus view of any table, given three SQL expressions."""
    return table.selectExpr(f"{project_id} as project_id", f"{path} as path", f"{content} as content")


def write_corpus(files: DataFrame, target: str) -> None:
    """Store a corpus so that a project filter prunes whole folders."""
    files.write.mode("errorifexists").partitionBy("project_id").parquet(target)


def read_corpus(spark: SparkSession, source: str) -> DataFrame:
    """A stored corpus. Project ids stay texts: ``007`` does not become a number."""
    return spark.read.schema("path string, content string, project_id string").parquet(source).select("project_id", "path", "content")
