"""Typed access to loosely shaped JSON held as VARIANT (Q17)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleloom.functions.text import bind

_NUMBER = r"\A(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"


def field(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_number(value: Column) -> Column:
    return F.coalesce(kind(value).rlike(_NUMBER), F.lit(False))


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def string_only(value: Column, path: str) -> Column:
    """Text at ``path`` when it is a JSON string, else NULL. An empty string counts."""
    return bind(field(value, path), lambda found: F.when(kind(found) == "STRING", as_text(found)))


def _falsy(text: Column, value: Column) -> Column:
    # Only these texts can be a falsy number or boolean, so the type is looked up rarely.
    doubtful = text.isin("false", "0") | (text.startswith("0.") & text.rlike(r"\A0\.0+\z"))
    return text.isNull() | (text == "") | (doubtful & (kind(value) != "STRING"))


def truthy(value: Column) -> Column:
    """The value itself unless it is absent, null, "", 0 or false."""
    return bind(value, lambda v: bind(as_text(v), lambda text: F.when(~_falsy(text, v), v)))


def truthy_text(value: Column, path: str) -> Column:
    return bind(F.try_variant_get(value, path, "string"), lambda text: F.when(~_falsy(text, field(value, path)), text))


def cascade_text(value: Column, *paths: str) -> Column:
    return F.coalesce(*[truthy_text(value, p) for p in paths])


def elements(value: Column, path: str) -> Column:
    """Array elements at ``path``, NULL when there is no array."""
    return F.try_variant_get(value, path, "array<variant>")


def number_text(number: Column) -> Column:
    """A double as the rule language prints it: ``5``, ``0.5``, ``0.0001``."""
    whole = F.format_string("%.0f", number)
    fine = F.regexp_replace(number.cast("string").cast("decimal(38,18)").cast("string"), r"\.?0+\z", "")
    short = F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.0)?E", "e"), r"e(\d)", "e+$1")
    return (
        F.when((number == F.floor(number)) & (F.abs(number) < 1e21), F.when(number == 0, "0").otherwise(whole))
        .when((F.abs(number) >= 1e-6) & (F.abs(number) < 1e18), fine)
        .otherwise(short)
    )
