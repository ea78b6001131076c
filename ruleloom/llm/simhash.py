"""SimHash near-duplicates: fingerprints of word shingles, joined on blocks, verified, grouped.

Two fingerprints that differ in at most ``distance`` bits agree on at least ``blocks - distance``
of their ``blocks`` blocks, whichever bits differ. Each combination of that many blocks is a join
key, so no close pair is missed. With 7 blocks and distance 4 a key has about 27 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from ruleloom.llm.common import staged
from ruleloom.llm.components import components
from ruleloom.session import shuffled

SHINGLE = 4
SEED = 42
DISTANCE = 4
BLOCKS = 7


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Majority bits of the XXH64 values of all word shingles, as an unsigned number.

    A-Z are lower-cased; words are runs without ASCII white space. Fewer words than ``width``
    make one shingle; null or no words at all give zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    spans = zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)
    digests = np.frombuffer(b"".join([xxh64_digest(line[a:b], SEED) for a, b in spans]), dtype=np.uint8).reshape(n, 8)
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 32_768):
        bits += np.unpackbits(digests[at : at + 32_768], axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for each row; ``fp`` is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _block_bits(blocks: int) -> list[int]:
    """The bits of each block, as signed longs."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(a, b) for all pairs of different fingerprints ``fp`` that differ in at most ``distance`` bits.

    ``prints`` holds each fingerprint once. The join on (blocks, their bits) meets a close pair in
    each combination of blocks it agrees on; only the combination of its lowest agreeing blocks
    returns it, so each link comes once. Rows of a key that many fingerprints share stay in the
    join's exchange, whose partitions adaptive execution splits. Neither side is broadcast: Spark
    sizes the combinations of all fingerprints like one for each.
    """
    agree = blocks - distance
    if agree < 1:
        raise ValueError("more blocks than differing bits are needed")
    bits = _block_bits(blocks)
    combos = [
        F.struct(F.lit(sum(1 << i for i in c)).alias("combo"), F.col("fp").bitwiseAND(F.lit(sum(bits[i] for i in c))).alias("part"))
        for c in combinations(range(blocks), agree)
    ]
    keyed = prints.select("fp", F.explode(F.array(*combos)).alias("k")).select("fp", "k.combo", "k.part")
    left, right = keyed.alias("l"), shuffled(keyed).alias("r")
    differ = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    same = F.lit(0)
    for i, m in enumerate(bits):
        same = same + F.when(differ.bitwiseAND(F.lit(m)) == 0, 1 << i).otherwise(0)
    first, rest = F.lit(0), same
    for _ in range(agree):
        lowest = rest.bitwiseAND(-rest)
        first, rest = first + lowest, rest - lowest
    close = (F.bit_count(differ) <= distance) & (first == F.col("l.combo"))
    on = (F.col("l.combo") == F.col("r.combo")) & (F.col("l.part") == F.col("r.part")) & (F.col("l.fp") < F.col("r.fp"))
    return left.join(right, on & close).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, width: int = SHINGLE) -> DataFrame:
    """Fingerprint and component of each row: (doc_id, fingerprint, component_id, n_links).

    ``component_id`` is the least doc_id that can be reached over links, the row's own included;
    equal fingerprints are linked, too. ``n_links`` counts the other fingerprints linked to the
    row's. Null and empty texts have fingerprint zero and form one group like any other. A null
    doc_id keeps its row and can link others; the component is null only if all its ids are.
    Repeated rows come once each. An empty table gives an empty result. Other columns are ignored.
    """
    rows = staged(fingerprints(docs, width))
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    pairs = staged(links(classes.select("fp"), distance, blocks))
    roots = staged(components(pairs))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    member = roots.select(F.col("node").alias("fp"), "root").join(shuffled(degree), "fp")
    named = staged(classes.join(shuffled(member), "fp", "left"))
    least = staged(named.where("root is not null").groupBy("root").agg(F.min("first_id").alias("least_id")))
    linked = named.where("root is not null").join(shuffled(least), "root").select("fp", F.col("least_id").alias("component_id"), "n_links")
    alone = named.where("root is null").select("fp", F.col("first_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    label = staged(linked.unionByName(alone))
    return rows.join(shuffled(label), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that give their component its id, with all their columns.

    One document of each group stays. Exact repeats of a kept row (same id and text) collapse to
    one; rows of a component without any id stay as they are.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    found = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = staged(found.select(key.alias("__key")).distinct())
    # One exchange of the texts, by id, at any size; it serves the removal of repeats, too.
    marked = docs.withColumn("__key", key).join(kept.hint("merge"), "__key", "left_semi").withColumn("__text", F.xxhash64("text"))
    return marked.dropDuplicates(["__key", "__text"]).drop("__key", "__text")
