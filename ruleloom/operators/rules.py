"""Rule documents: Markdown rule blocks to rule rows, and rule inheritance.

A document is one row and is parsed inside that row, so parsing needs no shuffle.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

from ruleloom.functions.paths import resolve_from
from ruleloom.functions.text import BLANK, BLANK_CHARS, bind, lines_of, trim_blank, value_after_colon
from ruleloom.operators.inheritance import resolve_chains
from ruleloom.session import shuffled

# The words of the rule document grammar.
RULE_HEADER = "### RULE:"
PARENT_WORD = "extends:"
FIELD_WORDS = ("severity", "scope", "intent", "fix")
MAP_WORDS = ("detect", "prompt")
LIST_WORD = "context"
DETECT_KEYS = ("regex", "import", "include", "where")

_TEXT = StringType()
_KINDS = dict.fromkeys(FIELD_WORDS, _TEXT) | dict.fromkeys(MAP_WORDS, MapType(_TEXT, _TEXT)) | {LIST_WORD: ArrayType(_TEXT)}
RULE_TYPE = StructType([StructField(n, t) for n, t in ({"block_pos": IntegerType(), "rule_id": _TEXT} | _KINDS).items()])
RULES_TYPE = ArrayType(RULE_TYPE)

_BLANK_IN_LINE = BLANK[:-1] + r"&&[^\n]]"
_LINE_END = re.compile(r"\r?\n")
_BLOCK_START = re.compile(rf"\r?\n(?=[{BLANK_CHARS.replace(chr(10), '')}]*{RULE_HEADER})")
_BLOCK = re.compile(rf"[{BLANK_CHARS}]*{RULE_HEADER}")


def parent_path(path: Column, content: Column) -> Column:
    """Resolved ``extends`` path: the first non-empty one before the first rule header (Q16)."""
    preamble = F.get(F.split(content, rf"(?:\A|\n){_BLANK_IN_LINE}*{RULE_HEADER}", 2), F.lit(0))
    trimmed = F.transform(lines_of(preamble), trim_blank)
    values = F.transform(F.filter(trimmed, lambda x: x.startswith(PARENT_WORD)), value_after_colon)
    return bind(
        F.get(F.filter(values, lambda v: v != ""), F.lit(0)), lambda v: F.when(v.isNotNull(), resolve_from(path, v))
    )


def _unquoted(text: str) -> str:
    """:func:`ruleloom.functions.text.strip_quotes` of one text."""
    paired = any(text.startswith(q) and text.endswith(q) for q in "\"'")
    return text[1 : max(len(text) - 1, 1)] if paired else text


def _block_rule(block: str, pos: int) -> dict:
    """Fields and sections of one block, header line first.

    What a line means depends on the lines before it: inside an indented section even a known word is
    just a key. A repeated section replaces the earlier one; a repeated key keeps its place and takes
    the last value.
    """
    header, *lines = _LINE_END.split(block)
    rule: dict = {"block_pos": pos, "rule_id": header.strip(BLANK_CHARS)[len(RULE_HEADER) :].strip(BLANK_CHARS)}
    rule |= {word: None for word in FIELD_WORDS} | {word: {} for word in MAP_WORDS} | {LIST_WORD: []}
    section, opened_at = "", 0
    for line in lines:
        text = line.strip(BLANK_CHARS)
        if not text:
            continue
        indent = len(line) - len(line.lstrip(BLANK_CHARS))
        start, colon, rest = text.partition(":")
        if section and indent > opened_at:
            if section == LIST_WORD:
                if text.startswith("- "):
                    rule[section].append(_unquoted(text[2:].strip(BLANK_CHARS)))
            elif colon:
                rule[section][start.strip(BLANK_CHARS)] = _unquoted(rest.strip(BLANK_CHARS))
            continue
        section, opened_at = "", 0
        if not colon:
            continue
        if start in FIELD_WORDS:
            rule[start] = _unquoted(rest.strip(BLANK_CHARS))
        elif start in MAP_WORDS or start == LIST_WORD:
            section, opened_at = start, indent
            rule[section] = [] if start == LIST_WORD else {}
    for word in MAP_WORDS:
        rule[word] = list(rule[word].items())
    return rule


@F.arrow_udf(RULES_TYPE)
def _parsed(contents: pa.Array) -> pa.Array:
    rows = []
    for content in contents:
        text = content.as_py()
        blocks = None if text is None else filter(_BLOCK.match, _BLOCK_START.split(text))
        rows.append(None if blocks is None else [_block_rule(block, at) for at, block in enumerate(blocks)])
    return pa.array(rows, to_arrow_type(RULES_TYPE))


def document_rules(content: Column) -> Column:
    """Rules of a document as an array, ``block_pos`` from 0; NULL gives NULL.

    Lines are told apart by those before them, for which Spark has only a fold that interprets every
    expression for every line. Hence one pass over the lines in Python, in Arrow batches within the
    row's task. Bytes that are no UTF-8 become U+FFFD.
    """
    return _parsed(F.make_valid_utf8(content))


def with_detect_kind(rules: DataFrame) -> DataFrame:
    return rules.withColumn("detect_kind", F.get(F.map_keys("detect"), F.lit(0)))


def parse_rules(documents: DataFrame) -> DataFrame:
    """Rules of each document ``(path, content)``, one row per block."""
    keys = [c for c in documents.columns if c != "content"]
    return with_detect_kind(documents.select(*keys, F.inline(document_rules(F.col("content")))))


def with_detect_columns(rules: DataFrame) -> DataFrame:
    """Promote the detect keys that matching uses to columns."""
    return rules.select("*", *[F.try_element_at("detect", F.lit(k)).alias(k) for k in DETECT_KEYS])


def rule_documents(documents: DataFrame) -> DataFrame:
    """``(path, parent, body)`` rows for :func:`resolve_chains`; the body is the parsed rules."""
    content = F.col("content")
    return documents.select("path", parent_path(F.col("path"), content).alias("parent"), document_rules(content).alias("body"))


def rule_chains(documents: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    return resolve_chains(rule_documents(documents), starts)


def effective_rules(chains: DataFrame) -> DataFrame:
    """Inherited rules first, then own ones, without override.

    ``rule_pos`` packs the level below the root and the block position, so it orders the
    rules of a document without ranking them. Broken chains yield no rules.
    """
    links = chains.where("status = 'ok'").select(
        F.col("start").alias("document"), F.posexplode(F.reverse("chain")).alias("level", "link")
    )
    rules = links.select("document", "level", F.inline("link.body"))
    packed = F.col("level").cast("bigint") * F.lit(1 << 32) + F.col("block_pos")
    return with_detect_kind(rules.withColumn("rule_pos", packed))


def latest_rules(rules: DataFrame) -> DataFrame:
    """Last definition of every rule id."""
    newest = Window.partitionBy("project_id", "rule_id").orderBy(F.desc("rule_pos"))
    return rules.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def duplicate_rules(rules: DataFrame) -> DataFrame:
    """Every definition of a rule id after the first.

    The first position comes from a pre-aggregated group-by; only repeats go on.
    """
    firsts = (
        rules.groupBy("project_id", "rule_id")
        .agg(F.min("rule_pos").alias("first_pos"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    return rules.join(shuffled(firsts), ["project_id", "rule_id"]).where("rule_pos > first_pos").drop("first_pos")
