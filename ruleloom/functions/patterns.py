"""Rule patterns: translation to Java regex syntax, validity, required literals."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType

from ruleloom.functions.text import BLANK

TRANSLATED = StructType().add("pattern", StringType()).add("literal", StringType()).add("ok", BooleanType())
# ``\s`` of the rule language: members of a class, and the class of all else.
_BLANKS = BLANK[1:-1]
_NOT_BLANK = f"[^{_BLANKS}]"

_UNIT = re.compile(
    r"(?P<cls>\[\^?(?:\\.|[^\]\\])*\])"
    r"|(?P<esc>\\(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|c[A-Za-z]|k<\w+>|\d+|.))"
    r"|(?P<open>\((?:\?(?:[:=!]|<[=!]|<[A-Za-z_$][\w$]*>)|(?!\?)))"
    r"|(?P<rep>(?:[*+?]|\{\d+(?:,\d*)?\})\??)"
    r"|(?P<one>.)",
    re.S,
)
_WORDY = set("dDwWsSbBcxukpPtnrvf0123456789")


def _class_text(text: str) -> str:
    if text == "[^]":
        return r"[\s\S]"
    if text == "[]":
        return "(?!)"
    head = "[^" if text.startswith("[^") else "["
    inner = text[len(head):-1].replace("&&", r"&\&")
    # "[" is an ordinary class member in the rule language but opens a union in Java.
    members = {"[": r"\[", r"\s": _BLANKS, r"\S": _NOT_BLANK}
    return head + re.sub(r"\\.|\[", lambda m: members.get(m.group(), m.group()), inner, flags=re.S) + "]"


def translate(regex: str) -> tuple[str, str | None]:
    """Java text of a rule pattern, and the longest literal every matching line must hold.

    Raises ``ValueError`` for a pattern the rule language does not allow.
    """
    out, runs, run, depth, top_choice, at, repeatable = [], [], "", 0, False, 0, False
    while at < len(regex):
        unit = _UNIT.match(regex, at)
        if unit is None:
            raise ValueError(regex)
        kind, text = unit.lastgroup, unit.group()
        at = unit.end()
        if kind == "rep":
            if not repeatable:
                raise ValueError(f"nothing to repeat: {regex}")
            if run and depth == 0:
                # The repeated character may be absent, or may occur more than once.
                runs.append(run[:-1])
                run = run[-1] if not re.match(r"[*?]|\{0", text) else ""
                runs.append(run)
                run = ""
            out.append(text)
            repeatable = False
            continue
        plain = None
        repeatable = True
        if kind == "cls":
            java = "[^]" if text == "[^]" else text
            java = _class_text(java)
        elif kind == "esc":
            java = text
            repeatable = text[1] not in "bB"
            if text[1] in "sS":
                java = BLANK if text[1] == "s" else _NOT_BLANK
            elif text[1] in "pP":
                java = text[1]
            elif text[1] not in _WORDY:
                plain = text[1]
                java = re.escape(plain) if plain.isascii() and not plain.isalnum() else plain
        elif kind == "open":
            java = text
            depth += 1
            repeatable = False
        elif text == "(" or (text == "[" and kind == "one"):
            raise ValueError(f"unterminated group or class: {regex}")
        elif text == ")":
            java = text
            depth -= 1
            if depth < 0:
                raise ValueError(f"unmatched ')': {regex}")
        elif text == "|":
            java = text
            top_choice = top_choice or depth == 0
            repeatable = False
        elif text == ".":
            java = r"[^\n\r\u2028\u2029]"
        elif text in "^$":
            java = text
            repeatable = False
        elif text == "\\":
            raise ValueError(f"trailing backslash: {regex}")
        else:
            plain = text
            java = "\\" + text if text in "{}]" else text
        if plain is not None and depth == 0:
            run += plain
        elif run:
            runs.append(run)
            run = ""
        out.append(java)
    if depth:
        raise ValueError(f"unterminated group: {regex}")
    runs.append(run)
    literal = "" if top_choice else max(runs, key=len)
    # (?d): only "\n" ends a line for "$", and lines never hold one.
    return "(?d)" + "".join(out), literal or None


@F.arrow_udf(TRANSLATED)
def _translated(regexes: pa.Array) -> pa.Array:
    rows = []
    for regex in regexes.to_pylist():
        try:
            rows.append((*translate(regex), True))
        except ValueError:
            rows.append((None, None, False))
    pattern, literal, ok = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.StructArray.from_arrays(
        [pa.array(pattern, pa.string()), pa.array(literal, pa.string()), pa.array(ok, pa.bool_())], names=["pattern", "literal", "ok"]
    )


def pattern_table(rules: DataFrame) -> DataFrame:
    """One row per distinct rule pattern: ``regex, pattern, literal, pattern_ok, valid``.

    ``valid`` tells whether the rule language allows the pattern; ``pattern_ok`` whether Java
    compiles its translation, too, so that matching cannot fail. Both are found on the
    executors, as distinct patterns grow with the projects.
    """
    distinct = rules.select("regex").where(F.coalesce(F.col("regex"), F.lit("")) != "").distinct()
    # Compiled once for each pattern; a pattern that Java refuses gives NULL.
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("t.pattern"))
    found = distinct.withColumn("t", _translated("regex"))
    return found.select(
        "regex", "t.pattern", "t.literal", (F.col("t.ok") & compiled.isNotNull()).alias("pattern_ok"), F.col("t.ok").alias("valid")
    )
