"""Configurations: JSON documents, inheritance chains and the merge along a chain (Q14).

Each document is parsed once; a chain is one row holding its parsed documents as an array, so
merging is a row-local expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions import variants as V
from ruleloom.functions.entries import key_groups, last_of_each_key
from ruleloom.functions.paths import resolve_from
from ruleloom.functions.text import bind
from ruleloom.operators.inheritance import resolve_chains

# Configuration keys with a merge rule of their own; all others are plain.
SCALAR_KEYS = ("stack", "version", "rulesFile", "severityThreshold")
LIST_KEYS = ("enabledRuleIds", "scopes")
MAP_KEYS = ("i18n", "pathAliases", "thresholds")
DETECT_LISTS = ("include", "exclude")
PROMPT_MAPS = ("promptTemplates", "promptTemplateKeys")
# Objects whose own entries are merged one by one.
NESTED = ("prompt", "detectOptions")
#: Columns of :func:`effective_configs`, in order; ``locale`` of a project comes from ``i18n``.
MERGED = (*SCALAR_KEYS, "plain", *LIST_KEYS, *DETECT_LISTS, *MAP_KEYS, *PROMPT_MAPS, *NESTED, "exceptions", "exception_entries")

_ENTRY = "array<struct<key:string,value:variant>>"
_TEXTS = "array<string>"


def object_entries(json: Column) -> Column:
    """Entries of a JSON object in written order; a null value is an entry, too."""
    return F.coalesce(
        F.transform(
            F.map_entries(F.from_json(json, "map<string,variant>")),
            lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")),
        ).cast(_ENTRY),
        F.array().cast(_ENTRY),
    )


def raw_field(json: Column, key: str) -> Column:
    """JSON text below a top-level key, with its own key order kept; NULL when absent or null."""
    return F.from_json(json, f"struct<`{key}`:string>")[key]


def merge_arrays(parent: Column, child: Column) -> Column:
    """Ordered distinct union, parent first."""
    empty = F.array().cast(_TEXTS)
    return F.array_union(F.coalesce(parent, empty), F.coalesce(child, empty))


def merge_entries(lists: Column) -> Column:
    """Merge entry lists, last list wins per key, keys stay where they first appeared."""

    return last_of_each_key(F.flatten(lists))


def string_list(value: Column) -> Column:
    """Elements as texts; a bare text counts as the list of its characters."""
    letters = F.filter(F.split(F.try_variant_get(value, "$", "string"), ""), lambda x: x != "")
    return F.coalesce(F.try_variant_get(value, "$", _TEXTS), F.when(F.schema_of_variant(value) == "STRING", letters))


def merge_list_entries(lists: Column) -> Column:
    """Merge maps of lists: one ordered distinct union per key."""
    empty = F.array().cast(_TEXTS)

    def build(flat: Column) -> Column:
        def picked(found: Column) -> Column:
            def globs(group: Column) -> Column:
                own = F.slice(found["places"], group["at"] + 1, group["size"])
                united = F.flatten(F.transform(own, lambda at: F.coalesce(string_list(F.get(flat, at)["value"]), empty)))
                return F.when(F.size(lists) > 1, F.array_distinct(united)).otherwise(united)

            return F.transform(found["groups"], lambda g: F.struct(F.get(flat, g["place"])["key"].alias("key"), globs(g).alias("globs")))

        return bind(key_groups(flat), picked)

    return bind(F.flatten(lists), build)


def entry_value(entries: Column, key: str) -> Column:
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))["value"]


def config_documents(configs: DataFrame, fields: tuple[str, ...] | None = None) -> DataFrame:
    """``(path, parent, body)`` rows for :func:`resolve_chains` from ``(path, content)`` JSON texts.

    The body is the parsed document: all entries as written but ``extends``, and the parts with
    a merge rule of their own. ``readable`` is false for a text that is no JSON. ``fields`` names the
    columns of :func:`effective_configs` that the parts are wanted for, by default all; of the plain
    entries those stay that a wanted column comes from. Both lists are always there.
    """
    wanted = set(MERGED if fields is None else fields)
    scalars = [k for k in SCALAR_KEYS if k in wanted]
    if "exception_entries" in wanted:
        wanted.add("exceptions")
    plain = F.filter(object_entries(F.col("content")), lambda e: (e["key"] != "extends") if "plain" in wanted else e["key"].isin(*scalars))
    own = [k for k in (*MAP_KEYS, "exceptions") if k in wanted]
    shown = [k for k in PROMPT_MAPS if k in wanted]
    parts = (*own, *(k for k in NESTED if k in wanted or k == "prompt" and shown))
    nested = ", ".join(f"`{k}`: string" for k in (*parts, "extends"))
    prompts = ", ".join(f"`{k}`: string" for k in (*shown, "extends"))
    texts = configs.select(
        "path",
        F.try_parse_json("content").alias("doc"),
        plain.alias("plain"),
        F.from_json("content", f"struct<{nested}>").alias("part"),
    ).withColumn("promptMaps", F.from_json(F.col("part.prompt") if shown else F.lit(None).cast("string"), f"struct<{prompts}>"))
    doc = F.col("doc")
    listed = lambda path: F.coalesce(F.try_variant_get(doc, path, _TEXTS), F.array().cast(_TEXTS))
    body = F.struct(
        *(["plain"] if "plain" in wanted or scalars else []),
        *[listed(f"$.{k}").alias(k) for k in LIST_KEYS],
        *[listed(f"$.detectOptions.{k}").alias(k) for k in DETECT_LISTS if k in wanted],
        *[object_entries(F.col(f"part.{k}")).alias(k) for k in own],
        *[object_entries(F.col(f"promptMaps.{k}")).alias(k) for k in shown],
        *[object_entries(F.col(f"part.{k}")).alias(k) for k in NESTED if k in wanted],
    )
    parent = bind(V.truthy_text(doc, "$.extends"), lambda p: F.when(p.isNotNull(), resolve_from(F.col("path"), p)))
    return texts.select("path", parent.alias("parent"), body.alias("body"), F.col("doc").isNotNull().alias("readable"))


def config_chains(configs: DataFrame, starts: DataFrame | None = None, fields: tuple[str, ...] | None = None) -> DataFrame:
    return resolve_chains(config_documents(configs, fields), starts)


def effective_configs(chains: DataFrame, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Merged configuration of every unbroken chain (U4).

    A key the child sets wins even when it sets null; lists and maps merge as above. A lone
    document keeps its lists as written (Q14). ``fields`` names the columns to make beside
    ``config_path`` and ``n_documents``, by default all; they must be in the chains' bodies.
    """
    wanted = MERGED if fields is None else [c for c in MERGED if c in fields]
    bodies = F.col("bodies")
    part = lambda key: F.transform(bodies, lambda b: b[key])
    several = F.size(bodies) > 1
    listed = lambda key: bind(F.flatten(part(key)), lambda x: F.when(several, F.array_distinct(x)).otherwise(x))
    with_level = lambda b, level: F.transform(
        b["exceptions"], lambda e: F.struct(level.alias("level"), e["key"].alias("key"), e["value"].alias("value"))
    )
    root_first = F.reverse(F.transform("chain", lambda c: c["body"]))

    def merged(name: str) -> Column:
        if name in SCALAR_KEYS:  # the last one that any document sets
            return V.as_text(entry_value(F.flatten(part("plain")), name))
        if name in (*LIST_KEYS, *DETECT_LISTS):
            return listed(name)
        if name == "exceptions":
            return merge_list_entries(part(name))
        return F.flatten(F.transform(bodies, with_level)) if name == "exception_entries" else merge_entries(part(name))

    whole = chains.where("status = 'ok'").select(F.col("start").alias("config_path"), root_first.alias("bodies"))
    return whole.select("config_path", *[merged(name).alias(name) for name in wanted], F.size(bodies).alias("n_documents"))


def text_entries(entries: Column) -> Column:
    """Entries as ``key, text``: numbers as the rule language prints them, null as ``null``."""

    def text(value: Column) -> Column:
        number = bind(F.try_variant_get(value, "$", "double"), V.number_text)
        return F.when(V.is_number(value), number).otherwise(F.coalesce(V.as_text(value), F.lit("null")))

    return F.transform(entries, lambda e: F.struct(e["key"].alias("key"), text(e["value"]).alias("text")))


def entries_text(entries: Column) -> Column:
    """``key=value, ...`` or ``(none)``."""
    parts = F.transform(text_entries(entries), lambda e: F.concat(e["key"], F.lit("="), e["text"]))
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("(none)")


def exception_summary(exceptions: Column) -> Column:
    """``key:number of globs, ...`` or ``(none)``."""
    parts = F.transform(exceptions, lambda e: F.concat(e["key"], F.lit(":"), F.size(e["globs"]).cast("string")))
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("(none)")
