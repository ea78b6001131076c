"""Near-copies of texts by SimHash and shingle similarity, for the pipeline's stage.

Texts get the fingerprints of :mod:`simhash`, over five-word shingles; those that differ in few bits
are linked by the join on combinations of blocks, and linked ones make components. As few bits are far
less than a similarity of 0.8 allows, a wider search follows: sets of shingles get MinHash signatures,
cut into bands. Texts of one component, and those that share a band, are compared shingle by shingle. A
pair of Jaccard similarity ``s`` shares one of ``BANDS`` bands with
probability ``1 - (1 - s ** ROWS) ** BANDS``: 0.9958 at 0.80, 0.9998 at 0.85.

A text stays unless it is near an earlier one that stays. Texts that come first in all their bands
and in their component stay; what is near them goes; so do rounds settle groups of copies without
pairs among them. When a round settles few, the texts left are mostly unlike each other although they share bands. They are
met by their rarest shingles instead: two sets of similarity ``s`` have a shingle in common among the
rarest ``n - ceil(s * n) + 1`` of each, in any order that holds for all, and early enough that as many
can follow as must be in common. Texts that differ by words of their own have those first, and meet
none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest, xxh64_intdigest

from ruleloom.llm.common import staged
from ruleloom.llm.components import components
from ruleloom.llm.simhash import fingerprint, links
from ruleloom.session import shuffled

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 18
ROWS = 6
#: Rounds go on while each one settles this share of the texts still waiting; results are the same with any.
LEAST_SETTLED = 1 / 3
#: Up to so many texts or pairs to compare (three longs each, 12 MB) are picked by broadcast; beyond it by one exchange of the texts.
BROADCAST_TEXTS = 500_000

_MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 values of the word shingles; words as in :func:`simhash.fingerprint`."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    spans = zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)
    return np.unique(np.frombuffer(b"".join([xxh64_digest(line[a:b]) for a, b in spans]), dtype=">u8").astype(np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets; 1 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def bands(found: np.ndarray) -> list[int]:
    """One key for each band of the signature, the band's number hashed in; none for an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 2048):
        least = np.minimum(least, (found[at : at + 2048, None] * _MULTIPLIERS).min(axis=0))
    return [xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) >> 1 for b in range(BANDS)]


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, same, keys, fp) of each row: ``same`` numbers the set of shingles, ``fp`` is the text's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(2).to_pylist()
                found = [shingles(t) for t in texts]
                prints = np.array([fingerprint(t, SHINGLE) for t in texts], dtype=np.uint64)
                same = pa.array([xxh64_intdigest(f.tobytes()) >> 1 for f in found], pa.int64())
                keys = pa.array([bands(f) for f in found], pa.list_(pa.int64()))
                columns = [part.column(0), part.column(1), same, keys, pa.array(prints.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "same", "keys", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, same long, keys array<long>, fp long")


def _linked(rows: DataFrame) -> DataFrame:
    """(same, groups): a key of each component of linked fingerprints that a set of shingles of :func:`_sketches` has a text in.

    Texts of equal fingerprints are linked, too; the key of a fingerprint without links is its own.
    """
    prints = staged(rows.select("same", "fp").distinct())
    roots = staged(components(staged(links(prints.select("fp").distinct()))))
    member = prints.join(shuffled(roots), prints["fp"] == roots["node"], "left")
    return member.groupBy("same").agg(F.collect_set(F.xxhash64(F.coalesce("root", "fp"), F.lit("component"))).alias("groups"))


def _picking(rows: DataFrame) -> DataFrame:
    """Counted rows of a few longs, as the side of a join with texts."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_TEXTS else shuffled(rows)


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(same, text), one for each of the distinct ``wanted`` (same)."""
    wanted = staged(classes.join(shuffled(wanted), "same").select("same", F.col("place.doc_id").alias("__id"), F.col("place.text_hash").alias("__hash")))
    wanted = _picking(wanted)
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    return staged(own.join(wanted, on).select("same", "text").dropDuplicates(["same"]))


def _alike(texts: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (same, first) whose texts are at least ``least`` similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, np.zeros(0, np.uint64)
        for batch in batches:
            near: list[tuple[int, int]] = []
            for same, text, first, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first != last:
                    last, known = first, shingles(other)
                if similarity(shingles(text), known) >= least:
                    near.append((same, first))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in near], pa.int64()) for i in (0, 1)], names=["same", "first"])

    mine = texts.join(_picking(pairs), "same")
    others = texts.select(F.col("same").alias("first"), F.col("text").alias("other"))
    met = mine.join(others.hint("merge"), "first").select("same", "text", "first", "other")
    return met.mapInArrow(run, "same long, first long")


def _rare_pairs(texts: DataFrame, places: DataFrame, least: float) -> DataFrame:
    """Pairs (same, first) that can be ``least`` similar and share a key; ``first`` comes earlier.

    ``places`` has (same, o, keys) of the texts. Pairs come from the rarest shingles, told by their
    number among these texts, so that what many share is the last to bring two together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shingles(t).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["same", "found"])

    sets = staged(texts.mapInArrow(run, "same long, found array<long>"))
    held = sets.select("same", F.size("found").alias("n"), F.explode("found").alias("shingle"))
    shared = held.groupBy("shingle").agg(F.count("*").alias("holders")).where("holders > 1")
    mine = held.join(shuffled(shared), "shingle").groupBy("same", "n").agg(F.array_sort(F.collect_list(F.struct("holders", "shingle"))).alias("shared"))
    # Shingles of one text only are the rarest and meet nothing; ``at`` counts them, too.
    alone = F.col("n") - F.size("shared")
    rest = F.col("n") - F.ceil(least * F.col("n") - 1e-9).cast("int") + 1 - alone
    rare = mine.where(rest > 0).select("same", "n", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), rest)).alias("k", "s"))
    rare = rare.select("same", "n", (F.col("alone") + F.col("k") + 1).alias("at"), "s.shingle")
    rare = staged(rare.join(shuffled(places), "same").select("shingle", "n", "at", "o", "keys"))
    a, b = rare.alias("a"), shuffled(rare).alias("b")
    # If a pair's first shingle in common stands here, this many can be in common, and so many must be.
    can = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) + 1
    must = F.ceil((F.col("a.n") + F.col("b.n")) * (least / (1 + least)) - 1e-9)
    on = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.o") < F.col("b.o")) & (can >= must) & F.arrays_overlap("a.keys", "b.keys")
    return a.join(b, on).select(F.col("b.o.same").alias("same"), F.col("a.o.same").alias("first")).distinct()


def _losers(near: DataFrame) -> DataFrame:
    """(same) of the texts that go, if each goes that is linked to an earlier (first) that stays."""
    gone = None
    while not near.isEmpty():
        stay = near.select(F.col("first").alias("node")).join(shuffled(near.select(F.col("same").alias("node"))), "node", "left_anti").distinct()
        out = staged(near.join(shuffled(stay), near["first"] == stay["node"], "left_semi").select("same").distinct())
        gone = out if gone is None else gone.unionByName(out)
        near = staged(near.join(shuffled(out), "same", "left_anti").join(shuffled(out.withColumnRenamed("same", "first")), "first", "left_anti").select("same", "first"))
    return near.select("same").limit(0) if gone is None else gone


def first_texts(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash) of the rows that stay: those near no earlier row that stays.

    Rows are ordered by id, nulls last. Of rows with the same shingles those with the least id stay,
    of null ids all. Near are two rows that are ``least`` similar and share a band or a component of
    linked fingerprints; so each row that
    goes is near an earlier one that stays, and no two that stay are near each other.
    """
    rows = staged(_sketches(docs))
    # Ids first, null ids last; sets of shingles break ties.
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "same", "text_hash")
    classes = rows.groupBy("same").agg(F.min(place).alias("place"), F.first("keys").alias("keys"))
    classes = staged(classes.join(shuffled(_linked(rows)), "same").select("same", "place", F.concat("keys", "groups").alias("keys")))
    order = F.struct("place.unnamed", "place.doc_id", "same")
    waiting = classes.select(F.explode("keys").alias("key"), order.alias("o"))
    gone = None
    while True:
        firsts = waiting.groupBy("key").agg(F.min("o").alias("f"), F.count("*").alias("n")).where("n > 1").select("key", "f")
        met = staged(waiting.join(shuffled(firsts), "key"))  # keys that one text only waits in are done
        open_ = staged(met.groupBy("o").agg(F.bool_and(F.col("o") == F.col("f")).alias("leads")))
        left, leading = open_.agg(F.count("*"), F.count_if("leads")).first()
        if not left:
            break
        leaders = open_.where("leads").select(F.col("o").alias("f"))
        pairs = staged(met.where("o <> f").join(shuffled(leaders), "f", "left_semi").select("o.same", F.col("f.same").alias("first")).distinct())
        wanted = pairs.select("same").distinct().unionByName(pairs.select(F.col("first").alias("same")).distinct()).distinct()
        near = staged(_alike(_texts(docs, classes, wanted), pairs, least).select("same").distinct())
        gone = near if gone is None else gone.unionByName(near)
        settled = leaders.select("f.same").unionByName(near)
        waiting = met.select("key", "o", F.col("o.same").alias("same")).join(shuffled(settled), "same", "left_anti").select("key", "o")
        if leading + near.count() < LEAST_SETTLED * left:
            texts = _texts(docs, classes, waiting.select("o.same").distinct())
            places = classes.select("same", order.alias("o"), "keys")
            alike = staged(_alike(texts, staged(_rare_pairs(texts, places, least)), least))
            gone = gone.unionByName(_losers(alike))
            break
    kept = classes.select("same", F.col("place.doc_id").alias("first_id"))
    kept = kept if gone is None else kept.join(shuffled(gone), "same", "left_anti")
    return rows.join(shuffled(kept), "same").where(F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "text_hash").distinct()


def _free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of :func:`first_texts`, with all their columns; exact repeats collapse to one."""
    id_, text = _free(docs, "__key"), _free(docs, "__text")
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    kept = staged(first_texts(docs).select(key.alias(id_), F.col("text_hash").alias(text)).distinct())
    # One exchange of the texts, at any size; it serves the removal of repeats, too.
    marked = docs.withColumn(id_, key).withColumn(text, F.xxhash64("text"))
    return marked.join(kept.hint("merge"), [id_, text], "left_semi").dropDuplicates([id_, text]).drop(id_, text)
