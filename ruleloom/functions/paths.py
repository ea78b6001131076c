"""POSIX path arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleloom.functions.text import bind


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def resolve_from(document: Column, relative: Column) -> Column:
    """Path of ``relative`` seen from the folder that holds ``document``."""
    folder = F.regexp_extract(document, r"\A(.*/)?[^/]*\z", 1)
    joined = bind(relative, lambda r: F.when(r.startswith("/"), r).otherwise(F.concat(folder, r)))

    def step(kept: Column, part: Column) -> Column:
        shorter = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part.isin("", "."), kept).when(part == "..", shorter).otherwise(F.array_append(kept, part))

    def normal(path: Column) -> Column:
        parts = F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step)
        return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))

    return bind(joined, normal)
