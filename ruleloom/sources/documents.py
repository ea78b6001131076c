"""Rule documents, configurations, reports and locale dictionaries as text tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.functions.globs import glob_regex, path_matches
from ruleloom.functions.text import lines_of
from ruleloom.sources.tree import list_files, read_files


def read_texts(spark: SparkSession, source: str) -> DataFrame:
    """Whole text files as ``(path, content)``; serves rule documents, configs and reports.

    ``source`` is a file, a folder (with all below it), or a glob over the paths below a folder.
    """
    plain = re.split(r"[*?{]", source, maxsplit=1)[0]
    files = list_files(spark, source if plain == source else plain.rpartition("/")[0] or "/")
    if plain != source:
        files = files.where(path_matches(F.col("path"), glob_regex(F.lit(source))))
    return read_files(files).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def parse_json_column(table: DataFrame, column: str, into: str = "doc") -> DataFrame:
    """Add the parsed VARIANT; NULL marks unreadable JSON."""
    return table.withColumn(into, F.try_parse_json(column))


def json_rejects(table: DataFrame, column: str) -> DataFrame:
    return table.where(F.try_parse_json(column).isNull()).select(
        *[c for c in table.columns if c != column],
        F.length(column).cast("bigint").alias("n_chars"),
        F.lit("Failed to read report").alias("message"),
    )


def read_locales(spark: SparkSession, source: str) -> DataFrame:
    """``<locale>.json`` files with a flat key to text object as ``(locale, key, text)``."""
    files = read_texts(spark, source)
    entries = F.from_json("content", "map<string,string>")
    return files.select(
        F.regexp_extract("path", r"([^/]+)\.json\z", 1).alias("locale"), F.explode(entries).alias("key", "text")
    )


def count_lines(content: Column) -> Column:
    return F.size(lines_of(content)).cast("bigint")
