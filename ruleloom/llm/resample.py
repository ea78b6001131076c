"""Quality selection by importance resampling of hashed n-gram models.

Two bag-of-n-grams models over hashed word uni- and bigrams are counted: one over all texts, one
over the texts that labels mark as good. The logarithm of their ratio weights a text, and adding
Gumbel noise and keeping the k greatest draws k texts without replacement with those weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ruleloom.llm.common import staged

HASH_BITS = 16
CACHED_WORDS = 200_000
PIECE = 1 << 16
SEED = "gumbel"
#: The target model is counted over about so many labelled good texts at most, those with the least
#: hash of their id; the raw model over all texts.
TARGET_DOCS = 20_000
#: Bits of the sort key settled in each counting round.
ROUND_BITS = 16


class Grams:
    """Hashed uni- and bigrams of a text; word hashes are remembered for the length of a task."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def buckets(self, text: str | None) -> np.ndarray:
        """Bucket of each occurrence, below 2 ** HASH_BITS; A-Z lower-cased, split at ASCII white space."""
        words = (text or "").encode().lower().split()
        hashes = np.empty(len(words), dtype=np.uint64)
        known = self.known
        for i, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = xxh64_intdigest(w)
                if len(known) < CACHED_WORDS:
                    known[w] = h
            hashes[i] = h
        pairs = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[1:]
        shift = np.uint64(64 - HASH_BITS)
        mix = np.uint64(0xD6E8FEB86659FD93)
        return np.concatenate([(hashes * mix) >> shift, (pairs * mix) >> shift]).astype(np.int64)


def _models(docs: DataFrame, good: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket over all texts, and over those whose id is in ``good``, a bounded table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        raw, target = np.zeros((2, 1 << HASH_BITS), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for text, is_good in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    n = np.bincount(grams.buckets(text), minlength=1 << HASH_BITS)
                    raw += n
                    if is_good:
                        target += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    marked = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left").select("text", F.col("good").isNotNull().alias("good"))
    counted = marked.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros((2, 1 << HASH_BITS))
    for r in counted.collect():  # at most one row for each bucket
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return raw, target


def weighted(docs: DataFrame, good: DataFrame) -> DataFrame:
    """(doc_id, log_weight, gumbel_key): log ratio of the models, and with noise from the id added."""
    raw, target = _models(docs, good)
    size = 1 << HASH_BITS
    ratio = np.log((target + 1) / (target.sum() + size)) - np.log((raw + 1) / (raw.sum() + size))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, value = Grams(), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [float(value[grams.buckets(t)].sum()) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=["doc_id", "log_weight"])

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(SEED)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return found.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))


def top_k(keyed: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` rows with the greatest ``key``; ties go to the smaller doc_id, then arbitrarily among equal rows.

    The cell of a fine grid that holds the k-th greatest key is found by counting, ROUND_BITS of
    the cell's number at a time, so no task sees more than its share of the rows; only the rows in
    that cell are ranked.
    """
    rows = keyed.withColumn("__cell", F.floor(F.col(key) * (1 << 20)).cast("long") + F.lit(1 << 62))
    if k <= 0:
        return keyed.limit(0)
    cell, left = 0, k
    for shift in range(64 - ROUND_BITS, -1, -ROUND_BITS):
        inside = rows if shift == 64 - ROUND_BITS else rows.where(F.shiftright("__cell", shift + ROUND_BITS) == cell)
        part = F.shiftright("__cell", shift).alias("p")
        counts = sorted(((r["p"], r["n"]) for r in inside.groupBy(part).agg(F.count("*").alias("n")).collect()), reverse=True)
        for p, n in counts:
            cell = p
            if n >= left:
                break
            left -= n
        else:  # fewer rows than asked
            return keyed
    ranked = rows.where(F.col("__cell") == cell).orderBy(F.col(key).desc(), "doc_id").limit(left)
    return rows.where(F.col("__cell") > cell).unionByName(ranked).drop("__cell")


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """(doc_id, log_weight, gumbel_key) of the ``k`` rows drawn; by default the labelled share of good texts.

    The target model is counted over the texts that ``labels`` gives quality 1 (of an id that is
    labelled twice, the higher label), TARGET_DOCS of them, the raw model over all texts. A null
    or empty text weighs nothing, a null id draws the noise of a null. Equal keys go to the smaller
    id. Without labels all texts weigh the same and all rows are drawn. Repeated rows take part one
    by one; an empty table gives an empty result; other columns are ignored.
    """
    named = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    named = staged(named)
    known, ones = named.agg(F.count("*"), F.sum("quality")).first()
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("target")), F.lit(1_000_000)) / 1_000_000
    good = named.where((F.col("quality") == 1) & (place < min(1.0, TARGET_DOCS / max(1, ones or 0)))).select("doc_id", F.lit(1).alias("good"))
    keyed = staged(weighted(docs, good))
    if k is None:
        rows = keyed.count()
        k = rows if not known else round(rows * (ones or 0) / known)
    return top_k(keyed, "gumbel_key", k)
