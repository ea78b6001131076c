"""Line splitting, trimming and small text helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as the rule language defines it: ASCII blanks, all space separators,
# line/paragraph separators and the byte order mark.
BLANK = r"[\s\p{Zs}\x{FEFF}\x{2028}\x{2029}]"
# The same characters, for Python.
BLANK_CHARS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once.

    Catalyst shares no subexpressions inside conditional branches or lambdas, so a costly
    value that is mentioned several times there would be computed as often.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def made_once(value: Column, name: str) -> Column:
    """``value`` under ``name`` as the output of a generator, for a select of the row's other columns.

    A filter on a plain computed column is moved below the projection that makes it, and below exchanges,
    and so makes it a second time; one on a generator's output stays above. Spark adds such filters itself
    before :func:`inline` and :func:`explode`.
    """
    return F.explode(F.array(value)).alias(name)


#: Items that a fold handles before its output is put aside.
FOLD_PART = 256


def fold_out(items: Column, state: Column, step: Callable[[Column, Column], Column], out_type: str) -> Column:
    """What a fold over ``items`` puts out, in order, in linear time.

    ``step(state, item)`` gives a struct of the next ``state`` and ``more``, an array of ``out_type``
    elements. No items give an empty array, NULL gives NULL. An array that grows by one copies itself,
    so elements are gathered part by part; only the list of parts grows over the whole.
    """
    empty = F.array().cast(f"array<{out_type}>")
    carried = lambda s, out: F.struct(s.alias("state"), out.alias("out"))

    def within(acc: Column, item: Column) -> Column:
        return bind(step(acc["state"], item), lambda r: carried(r["state"], F.concat(acc["out"], r["more"])))

    def whole(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, carried(acc["state"], empty), within)
        return bind(done, lambda d: carried(d["state"], F.array_append(acc["out"], d["out"])))

    def folded(all_items: Column) -> Column:
        count = F.floor((F.size(all_items) + (FOLD_PART - 1)) / FOLD_PART).cast("int")
        starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        parts = F.transform(starts, lambda k: F.slice(all_items, k * FOLD_PART + 1, F.lit(FOLD_PART)))
        outs = F.aggregate(parts, carried(state, F.array().cast(f"array<array<{out_type}>>")), whole)["out"]
        return F.when(all_items.isNotNull(), F.flatten(outs))

    return bind(items, folded)


def lines_of(content: Column) -> Column:
    """Lines of a text; a trailing newline leaves a last empty line."""
    return F.split(content, r"\r?\n", -1)


def trim_blank(text: Column) -> Column:
    # Spark's own trim removes only the plain space.
    return F.regexp_replace(text, rf"\A{BLANK}+|{BLANK}+\z", "")


def snippet(line: Column) -> Column:
    """Trimmed line, or the raw line when trimming leaves nothing (Q8)."""
    return F.coalesce(F.nullif(trim_blank(line), F.lit("")), line)


def indent_width(line: Column) -> Column:
    return F.length(F.regexp_extract(line, rf"\A({BLANK}*)", 1))


def strip_quotes(text: Column) -> Column:
    """Drop one pair of equal quotes around a value; a lone quote character vanishes."""

    def strip(x: Column) -> Column:
        paired = lambda q: x.startswith(q) & x.endswith(q)
        return F.when(
            paired('"') | paired("'"), F.substr(x, F.lit(2), F.greatest(F.length(x) - 2, F.lit(0)))
        ).otherwise(x)

    return bind(text, strip)


def after_colon(trimmed: Column) -> Column:
    """Trimmed text after the first colon, empty when there is none."""
    return trim_blank(F.regexp_replace(trimmed, r"(?s)\A[^:]*:?", ""))


def value_after_colon(trimmed: Column) -> Column:
    return strip_quotes(after_colon(trimmed))


def replace_first(text: Column, needle: Column, value: Column) -> Column:
    """Replace the first occurrence of ``needle``."""
    at = F.position(needle, text)
    cut = F.concat(
        F.substr(text, F.lit(1), at - 1),
        value,
        F.substr(text, at + F.length(needle)),
    )
    return F.when(at > 0, cut).otherwise(text)


def indent_block(text: Column, spaces: int) -> Column:
    pad = " " * spaces
    return F.concat(F.lit(pad), F.replace(text, F.lit("\n"), F.lit("\n" + pad)))


def first_text(*candidates: Column) -> Column:
    """First candidate that is neither NULL nor empty (Q17 for text columns)."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def joined_or_none(items: Column, sep: str = ", ") -> Column:
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, F.lit("(none)")).otherwise(F.array_join(items, sep, ""))
