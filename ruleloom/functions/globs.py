"""Glob dialect of the rule language (Q1-Q3), compiled to regex text by Spark itself.

Compiling on columns keeps glob dimensions of any size off the driver.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleloom.functions.paths import forward_slashes

# The glob tokens and the regex each stands for.
TOKEN_REGEX = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "."}


def _expanded(glob: Column) -> Column:
    """All brace expansions. Only innermost groups count, and text left of one is final (Q2)."""
    pieces = F.regexp_extract_all(glob, F.lit(r"(?s)(\{[^{}]+\}|\{|[^{]+)"), 1)

    def extend(prefixes: Column, piece: Column) -> Column:
        choices = F.when(
            piece.startswith("{") & piece.endswith("}"),
            F.split(F.substr(piece, F.lit(2), F.length(piece) - 2), ",", -1),
        ).otherwise(F.array(piece))
        return F.flatten(F.transform(prefixes, lambda p: F.transform(choices, lambda c: F.concat(p, c))))

    return F.aggregate(pieces, F.array(F.lit("")).cast("array<string>"), extend)


def _token_regex(token: Column) -> Column:
    out = F.lit(None).cast("string")
    for glob_token, regex in TOKEN_REGEX.items():
        out = F.when(token == glob_token, F.lit(regex)).otherwise(out)
    return F.coalesce(out, F.regexp_replace(token, r"([|\\{}()\[\]^$+.])", r"\\$1"))


def _body(glob: Column) -> Column:
    plain = F.regexp_replace(forward_slashes(glob), r"\A\./", "")

    def one(expansion: Column) -> Column:
        tokens = F.regexp_extract_all(expansion, F.lit(r"(?s)(\*\*/|\*\*|\*|\?|[^*?]+)"), 1)
        return F.concat(F.lit("(?:"), F.array_join(F.transform(tokens, _token_regex), ""), F.lit(")"))

    return F.array_join(F.transform(_expanded(plain), one), "|")


def glob_regex(glob: Column) -> Column:
    """Regex text equal to one glob; NULL stays NULL."""
    return F.concat(F.lit(r"\A(?:"), _body(glob), F.lit(r")\z"))


def any_glob_regex(globs: Column) -> Column:
    """One regex for a list of globs; NULL for an empty or missing list."""
    body = F.array_join(F.transform(globs, _body), "|")
    return F.when(F.size(globs) > 0, F.concat(F.lit(r"\A(?:"), body, F.lit(r")\z")))


def matches_regex(text: Column, regex: Column) -> Column:
    """``text`` matches a regex held in a column.

    ``regexp_instr`` keeps the last compiled pattern, which ``rlike`` does not, so runs of
    rows with the same pattern compile it once.
    """
    return F.regexp_instr(text, regex) > 0


def path_matches(path: Column, regex: Column) -> Column:
    return matches_regex(forward_slashes(path), regex)
