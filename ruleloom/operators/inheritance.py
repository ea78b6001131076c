"""Inheritance chains over documents that name one parent each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.session import broadcast_if_small, dealt_join, shuffled, staged

#: A parent that more documents share is copied, so that these are dealt to several tasks.
SHARED_BY = 4096


def _until_repeat(walk: Column) -> Column:
    """A walk up to, and without, the first document that comes again."""
    again = F.filter(F.transform(walk, lambda p, at: F.struct(at.alias("at"), (F.array_position(walk, p) <= at).alias("seen"))), lambda x: x["seen"])
    return F.slice(walk, F.lit(1), F.coalesce(F.get(again, F.lit(0))["at"], F.size(walk)))


def parent_walks(parents: DataFrame) -> DataFrame:
    """``path, walk, status, trouble`` of each document that is somebody's parent (``path, parent, readable``).

    ``walk`` begins with the document itself. By pointer doubling: each round joins a walk to the walk
    that its end goes on with, so a chain of n documents takes about log2(n) rounds, on paths alone. A
    walk in which a document comes twice is a cycle.
    """
    one = F.array("path").alias("walk")
    nothing = F.lit(None).cast("string")
    state = parents.select(
        "path", one, F.col("parent").alias("next"), F.when(F.col("parent").isNull(), "ok").alias("status"), nothing.alias("trouble"), "readable"
    )
    state = staged(state, "chain-round")
    while not state.where("status is null").isEmpty():
        ahead = broadcast_if_small(
            state.select(
                F.col("path").alias("next"), F.col("walk").alias("_walk"), F.col("next").alias("_next"), F.col("status").alias("_status"),
                F.col("trouble").alias("_trouble"), F.col("readable").alias("_readable"),
            )
        )
        met = state.where("status is null").join(ahead, "next", "left")
        joined = F.concat("walk", "_walk")
        # An end that leads back into its own walk, or to another that runs in a circle.
        turns = F.size(F.array_distinct(joined)) < F.size(joined)
        cut = _until_repeat(joined)
        goes_on = F.coalesce(F.col("_readable"), F.lit(False))
        step = met.select(
            "path",
            F.when(~goes_on, F.col("walk")).when(turns, cut).otherwise(joined).alias("walk"),
            F.when(goes_on & ~turns, F.col("_next")).alias("next"),
            F.when(F.col("_readable").isNull(), "missing").when(~F.col("_readable"), "unreadable").when(turns, "cycle").otherwise(F.col("_status")).alias("status"),
            F.when(~goes_on, F.col("next")).when(turns, F.get(joined, F.size(cut))).otherwise(F.col("_trouble")).alias("trouble"),
            "readable",
        )
        state = staged(state.where("status is not null").unionByName(step), "chain-round")
    return state.select("path", "walk", "status", "trouble")


def resolve_chains(documents: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Follow ``parent`` links from every start document up to its root.

    ``documents`` has ``path, parent, body``, and may have ``readable``. The result has one row
    per start: ``start``, ``chain`` (array of ``path, body``, the start first), ``status``
    (``ok``, ``cycle``, ``missing`` or ``unreadable``) and ``trouble`` (the path that ended a
    broken chain). A document that cannot be read ends its chain.

    Only documents that serve as a parent, few next to all, are followed round by round
    (:func:`parent_walks`). Their bodies are attached in long form by one join, and gathered for
    each: a group is one chain. A start then meets the chain of its parent in one join, for which
    that side is broadcast when it is small; otherwise documents that share a parent with many, or have
    none, are dealt to several tasks.
    """
    # Parsed once here; everything below reads the parsed form.
    if "readable" not in documents.columns:
        documents = documents.withColumn("readable", F.lit(True))
    documents = staged(documents, "chain-documents")
    used = documents.select(F.col("parent").alias("path")).where("path is not null").distinct()
    parents = documents.join(broadcast_if_small(used), "path", "left_semi")
    walks = parent_walks(parents.select("path", "parent", "readable"))

    link = F.struct("path", "body").alias("link")
    steps = walks.select(F.col("path").alias("owner"), F.posexplode("walk").alias("depth", "path"))
    bodies = steps.join(broadcast_if_small(parents.select("path", link)), "path")
    by_depth = lambda a, b: a["depth"] - b["depth"]  # noqa: E731 - bodies hold values without an order
    gathered = bodies.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("depth", "link")), by_depth).alias("links"))
    above = walks.join(shuffled(gathered.withColumnRenamed("owner", "path")), "path").select(
        F.col("path").alias("parent"), "walk", F.transform("links", lambda x: x["link"]).alias("links"), F.col("status").alias("_status"), F.col("trouble").alias("_trouble")
    )
    readable_parents = parents.select(F.col("path").alias("parent"), F.col("readable").alias("_readable"))
    above = staged(above.join(broadcast_if_small(readable_parents), "parent"), "chain-parents")

    own = documents if starts is None else documents.join(shuffled(starts.select(F.col("start").alias("path"))), "path", "left_semi")
    met = dealt_join(own.select("path", "parent", "readable", link), above, "parent", "path", SHARED_BY)
    # The parent's chain up to the start itself, if it leads back to it.
    back = F.array_position("walk", F.col("path")).cast("int")
    circle = F.coalesce(back, F.lit(0)) > 0
    goes_on = F.col("readable") & F.coalesce(F.col("_readable"), F.lit(False))
    rest = F.when(circle, F.slice("links", F.lit(1), back - 1)).otherwise(F.col("links"))
    status = (
        F.when(~F.col("readable"), "unreadable")
        .when(F.col("parent").isNull(), "ok")
        .when(F.col("_readable").isNull(), "missing")
        .when(~F.col("_readable"), "unreadable")
        .when(circle, "cycle")
        .otherwise(F.col("_status"))
    )
    trouble = (
        F.when(~F.col("readable"), F.col("path"))
        .when(F.col("parent").isNull(), F.lit(None).cast("string"))
        .when(~goes_on, F.col("parent"))
        .when(circle, F.col("path"))
        .otherwise(F.col("_trouble"))
    )
    chain = F.when(goes_on, F.concat(F.array("link"), rest)).otherwise(F.array("link"))
    return met.select(F.col("path").alias("start"), chain.alias("chain"), status.alias("status"), trouble.alias("trouble"))


def chain_links(chains: DataFrame) -> DataFrame:
    """Long form: one row per document of a chain, depth 0 being the start itself."""
    return chains.select("start", "status", "trouble", F.posexplode("chain").alias("depth", "link")).select(
        "start", "depth", "link.path", "link.body", "status", "trouble"
    )
