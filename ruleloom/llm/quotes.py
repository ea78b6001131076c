"""Quotation linking: quoted passages are joined to the messages they come from.

A line's quote level is its number of leading ``>`` marks. Runs of lines of one level form passages;
their words, normalised, are hashed. A quoted passage belongs to the first message of the
conversation that wrote a passage or line with that hash. Messages, freed of quotes, are ordered by
replies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.common import staged

_MARKS = r"^[ \t]*((?:>[ \t]*)*)"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", ""))


def _normal(text: Column) -> Column:
    """Letters and digits, lower-cased, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, own_text, quotes): the text without quotes, and its quoted passages.

    ``quotes`` holds a struct (level, text) for each run of lines of one level above zero; a level
    change, or an unquoted line, ends a run. All of it is read off the row itself.
    """
    split = F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")
    level_of = F.transform(split, lambda line: F.struct(_level(line).alias("level"), F.regexp_replace(line, _MARKS, "").alias("body")))
    rows = messages.select("conv_id", "turn", "role", level_of.alias("lines"))
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    at = F.sequence(F.lit(0), F.size("lines") - 1)
    level = lambda i: F.col("lines")[i]["level"]
    starts = F.filter(at, lambda i: (level(i) > 0) & ((i == 0) | (level(F.greatest(i - 1, F.lit(0))) != level(i))))
    ends = F.filter(at, lambda i: (level(i) > 0) & ((i == F.size("lines") - 1) | (level(F.least(i + 1, F.size("lines") - 1)) != level(i))))
    spans = rows.select("conv_id", "turn", "role", "lines", F.trim(own).alias("own_text"), F.arrays_zip(starts.alias("a"), ends.alias("b")).alias("spans"))
    quote = lambda s: F.struct(
        level(s["a"]).alias("level"),
        F.array_join(F.transform(F.slice("lines", s["a"] + 1, s["b"] - s["a"] + 1), lambda x: x["body"]), "\n").alias("text"),
    )
    return spans.select("conv_id", "turn", "role", "own_text", F.transform("spans", quote).alias("quotes"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, own_text, n_quotes, max_level, quoted_turns, parent_turn, root_turn, depth, position).

    A quote is looked up whole, by its single lines, and as a whole message; its original is the
    earliest turn of the conversation, before the quoting one, whose own text holds it. The parent
    is the latest such turn among quotes of the lowest level found; without any it is the turn just
    before, if that exists. ``root_turn`` and ``depth`` tell a message's thread and its level in it.
    ``position`` is the reply order, from 0 in each conversation: a message is followed by its replies,
    each with its own below it, in order of turns; threads do not interleave. Null texts are empty;
    rows with a null conversation or turn stay, unlinked, as roots without a position. Repeated turns
    of one conversation each come once per row and count as one message. Empty tables give an empty result; other columns are
    ignored.
    """
    rows = staged(parsed(messages))
    hashed = lambda text: F.when(_normal(text) != "", F.xxhash64(_normal(text)))
    pieces = F.array_distinct(F.concat(F.array("own_text"), F.split("own_text", r"\n[ \t]*\n"), F.split("own_text", "\n")))
    written = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(pieces).alias("piece"))
    originals = written.select("conv_id", hashed(F.col("piece")).alias("h"), "turn").where("h is not null").groupBy("conv_id", "h").agg(F.min("turn").alias("origin"))
    quoted = rows.select("conv_id", "turn", F.explode("quotes").alias("q")).where("conv_id is not null and turn is not null")
    asked = quoted.select("conv_id", "turn", F.col("q.level").alias("level"), F.explode(F.array_distinct(F.concat(F.array("q.text"), F.split("q.text", "\n")))).alias("piece"))
    asked = staged(asked.select("conv_id", "turn", "level", hashed(F.col("piece")).alias("h")).where("h is not null").distinct())
    met = asked.join(staged(originals), ["conv_id", "h"]).where("origin < turn")
    per_level = met.groupBy("conv_id", "turn", "level").agg(F.max("origin").alias("origin"), F.collect_set("origin").alias("origins"))
    linked = staged(
        per_level.groupBy("conv_id", "turn").agg(
            F.min_by("origin", "level").alias("quoted_parent"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("origins")))).alias("quoted_turns")
        )
    )
    keys = staged(rows.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct())
    before = keys.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("last_turn"))
    parents = keys.join(before, ["conv_id", "turn"], "left").join(linked, ["conv_id", "turn"], "left")
    tree = staged(
        parents.select("conv_id", "turn", F.coalesce("quoted_turns", F.array().cast("array<bigint>")).alias("quoted_turns"), F.coalesce("quoted_parent", "last_turn").alias("parent_turn"))
    )
    siblings = Window.partitionBy("conv_id", "parent_turn").orderBy("turn")
    tree = staged(tree.withColumn("next_turn", F.lead("turn").over(siblings)))
    # Pointer doubling: a message that has not found its root yet takes over its ancestor's ancestor,
    # so each round doubles the distance, and rows that have arrived are not joined again. ``leave``
    # is the message after the whole thread below the nearest ancestor, or the message, that has one.
    root = F.col("parent_turn").isNull()
    up = tree.select("conv_id", "turn", F.coalesce("parent_turn", "turn").alias("root_turn"), (~root).cast("long").alias("depth"), F.col("next_turn").alias("leave"), root.alias("done"))
    up = staged(up)
    while not (open_rows := up.where("not done")).isEmpty():
        above = up.select(
            "conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("higher"), F.col("depth").alias("more"),
            F.col("leave").alias("later"), F.col("done").alias("there"),
        )
        moved = open_rows.drop("done").join(above, ["conv_id", "root_turn"])
        moved = moved.select(
            "conv_id", "turn", F.col("higher").alias("root_turn"), (F.col("depth") + F.col("more")).alias("depth"),
            F.coalesce("leave", "later").alias("leave"), F.col("there").alias("done"),
        )
        up = staged(up.where("done").unionByName(moved))
    up = up.drop("done")
    placed = staged(tree.drop("next_turn").join(up, ["conv_id", "turn"]))
    placed = placed.join(_positions(placed), ["conv_id", "turn"]).drop("leave")
    return rows.join(placed, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "own_text", F.size("quotes").cast("long").alias("n_quotes"),
        F.coalesce(F.array_max(F.transform("quotes", lambda q: q["level"])), F.lit(0)).alias("max_level"),
        F.coalesce("quoted_turns", F.array().cast("array<bigint>")).alias("quoted_turns"), "parent_turn",
        F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "position",
    )


def _positions(placed: DataFrame) -> DataFrame:
    """(conv_id, turn, position): the place of each message in its conversation's reply order, from 0.

    A message is followed by its first reply, or else by the message after its thread. Doubling along
    these steps counts how many are left to the end.
    """
    first_reply = placed.where("parent_turn is not null").groupBy("conv_id", F.col("parent_turn").alias("turn")).agg(F.min("turn").alias("reply"))
    after = F.coalesce("reply", "leave")
    steps = placed.join(first_reply, ["conv_id", "turn"], "left").select("conv_id", "turn", after.alias("after"), after.isNotNull().cast("long").alias("left"))
    steps = staged(steps)
    while not (open_rows := steps.where("after is not null")).isEmpty():
        ahead = steps.select("conv_id", F.col("turn").alias("after"), F.col("after").alias("further"), F.col("left").alias("more"))
        moved = open_rows.join(ahead, ["conv_id", "after"]).select("conv_id", "turn", F.col("further").alias("after"), (F.col("left") + F.col("more")).alias("left"))
        steps = staged(steps.where("after is null").unionByName(moved))
    size = placed.groupBy("conv_id").agg(F.count("*").alias("size"))
    return steps.join(size, "conv_id").select("conv_id", "turn", (F.col("size") - 1 - F.col("left")).alias("position"))


def reply_ordered(linked: DataFrame) -> DataFrame:
    """(conv_id, position, turn, role, own_text): conversations without quotes, each in its reply order.

    Rows are dealt by ranges of (conv_id, position) and sorted there, so the rows of a conversation
    follow each other, and a very long one takes several tasks instead of one row. Messages without a
    conversation or turn come last in theirs.
    """
    order = [F.asc_nulls_last("conv_id"), F.asc_nulls_last("position"), F.col("turn")]
    return linked.select("conv_id", "position", "turn", "role", "own_text").repartitionByRange(*order).sortWithinPartitions(*order)
