"""Lists of ``key, value`` entries, grouped by key within their row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleloom.functions.text import bind


def key_groups(flat: Column) -> Column:
    """Places of equal keys, from sorting (key, place) and comparing neighbours: ``places`` sorted, ``first`` and ``size`` of each group.

    Groups come in the order in which their keys first appear. Values stay out of the sort, as a
    VARIANT has no order.
    """
    placed = F.sort_array(F.transform(flat, lambda e, at: F.struct(e["key"].alias("key"), at.alias("place"))))

    def grouped(rows: Column) -> Column:
        opens = F.filter(
            F.transform(rows, lambda r, at: F.struct(r["place"].alias("place"), at.alias("at"), ((at == 0) | (r["key"] != F.get(rows, at - 1)["key"])).alias("opens"))),
            lambda r: r["opens"],
        )

        def sized(firsts: Column) -> Column:
            end = lambda k: F.coalesce(F.get(firsts, k + 1)["at"], F.size(rows))
            return F.transform(firsts, lambda r, k: F.struct(r["place"].alias("place"), r["at"].alias("at"), (end(k) - r["at"]).alias("size")))

        groups = F.sort_array(bind(opens, sized))  # by the place of the first
        return F.struct(F.transform(rows, lambda r: r["place"]).alias("places"), groups.alias("groups"))

    return bind(placed, grouped)


def last_of_each_key(entries: Column) -> Column:
    """One entry for each key, in the order of their first ones, with the value of its last one."""

    def build(flat: Column) -> Column:
        def picked(found: Column) -> Column:
            last = lambda g: F.get(flat, F.get(found["places"], g["at"] + g["size"] - 1))["value"]
            return F.transform(found["groups"], lambda g: F.struct(F.get(flat, g["place"])["key"].alias("key"), last(g).alias("value")))

        return bind(key_groups(flat), picked)

    return bind(entries, build)


def occurrences(keys: Column) -> Column:
    """For each element of ``keys`` how often it has come up to there, from 1."""

    def counted(found: Column) -> Column:
        own = lambda g: F.slice(found["places"], g["at"] + 1, g["size"])
        numbered = F.transform(found["groups"], lambda g: F.transform(own(g), lambda p, n: F.struct(p.alias("place"), (n + 1).alias("nth"))))
        return F.transform(F.sort_array(F.flatten(numbered)), lambda x: x["nth"])

    return bind(key_groups(F.transform(keys, lambda k: F.struct(k.alias("key")))), counted)


def grouped(elements: Column, key: Callable[[Column], Column], made: Callable[[Column, Column], Column]) -> Column:
    """``made(first, own)`` for the elements of each key, keys in the order in which they first appear.

    ``own`` are the key's elements in order, ``first`` is the first of them.
    """

    def build(all_: Column) -> Column:
        def picked(found: Column) -> Column:
            own = lambda g: F.transform(F.slice(found["places"], g["at"] + 1, g["size"]), lambda p: F.get(all_, p))
            return F.transform(found["groups"], lambda g: bind(own(g), lambda mine: bind(F.get(mine, F.lit(0)), lambda first: made(first, mine))))

        return bind(key_groups(F.transform(all_, lambda e: F.struct(key(e).alias("key")))), picked)

    return bind(elements, build)
