"""Language ID with a string kernel: blended-spectrum presence kernel, Nyström, ridge regression.

Two texts are as alike as the share of hashed character 1- to 4-grams that both hold:
``k(x, z) = |grams(x) & grams(z)| / sqrt(|grams(x)| |grams(z)|)``. Landmarks of each language span
the kernel's feature space, in which one ridge regression for each language against the rest is
solved. A batch of texts is scored by two matrix products: with the landmarks, then the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType, DoubleType

from ruleloom.llm.common import held_out

SPECTRUM = 4
HASH_BITS = 16
#: At most so many labelled rows of each language are learnt from, and so many of them are landmarks.
ROWS_PER_LANGUAGE = 500
LANDMARKS_PER_LANGUAGE = 32
RIDGE = 1e-2
UNKNOWN = "und"
#: Below this score a filter takes a text for none of the learned languages.
MIN_SCORE = 0.25
PIECE = 1 << 18
RESULT = StructType().add("lang_pred", StringType()).add("score", DoubleType())


def grams(text: str) -> np.ndarray:
    """Sorted distinct hashes of the text's character n-grams, of the whole text, piece by piece."""
    seen = np.zeros(1 << HASH_BITS, dtype=bool)
    shift = np.uint64(64 - HASH_BITS)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for at in range(0, len(points), PIECE):
        c = points[at : at + PIECE + SPECTRUM - 1].astype(np.uint64) + np.uint64(1)
        h = np.zeros(len(c), dtype=np.uint64)
        for n in range(SPECTRUM):
            h = h[: len(c) - n] * np.uint64(0x9E3779B97F4A7C15) + c[n:]
            if not len(h):
                break
            seen[(h * np.uint64(0xD6E8FEB86659FD93)) >> shift] = True
    return np.flatnonzero(seen).astype(np.int32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _features(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, bits): presence of each hashed gram, one bit each, so of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for text in batch.column(2).to_pylist():
                row = np.zeros(1 << HASH_BITS, dtype=bool)
                row[grams(text)] = True
                bits.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], names=["doc_id", "lang", "bits"])

    return docs.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, bits binary")


def fit(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, landmarks: int = LANDMARKS_PER_LANGUAGE) -> dict | None:
    """Model from (doc_id, text, lang), as plain arrays; None if no row has a text and a language.

    The languages are counted over all rows. Of each, about ``rows`` rows with the least hash of
    their id are learnt from, the first ``landmarks`` of them as landmarks; what reaches the
    driver are their 8 KB of gram bits.
    """
    usable = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, 1.2 * rows / n)).otherwise(share)
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1_000_000)) / 1_000_000
    found = _features(usable.withColumn("place", place).where(F.col("place") < share)).withColumn(
        "place", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1_000_000))
    )
    taken: dict[str, list] = {}
    for r in sorted(found.collect(), key=lambda r: (r["place"], r["doc_id"] is None, r["doc_id"] or 0, r["bits"])):
        taken.setdefault(r["lang"], []).append(np.frombuffer(r["bits"], dtype=np.uint8))
    langs = sorted(taken)
    if not langs:
        return None
    packed = [b for lang in langs for b in taken[lang][:rows]]
    label = np.array([k for k, lang in enumerate(langs) for _ in taken[lang][:rows]])
    mark = np.array([b for lang in langs for b in taken[lang][:landmarks]])
    marks = np.unpackbits(mark, axis=1).astype(bool)
    used = np.flatnonzero(marks.any(axis=0))
    base = marks[:, used].astype(np.float32)
    size = np.maximum(marks.sum(axis=1), 1)
    model = {"langs": langs, "used": used, "landmarks": base, "root": np.sqrt(size).astype(np.float32)}
    k_ll = (base @ base.T) / np.outer(model["root"], model["root"])
    k_nl = np.concatenate([_kernel(np.unpackbits(np.array(packed[a : a + 128]), axis=1).astype(bool), model) for a in range(0, len(packed), 128)])
    values, vectors = np.linalg.eigh(k_ll.astype(np.float64))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.column_stack([k_nl @ whiten, np.ones(len(packed))])
    target = (label[:, None] == np.arange(len(langs))).astype(np.float64)
    weight = 1.0 / np.bincount(label, minlength=len(langs))[label]
    gram = phi.T @ (phi * weight[:, None]) + RIDGE * np.diag([*[1.0] * int(keep.sum()), 0.0]) / 10
    solved = np.linalg.solve(gram, phi.T @ (target * weight[:, None]))
    return model | {"weights": (whiten @ solved[:-1]).astype(np.float32), "bias": solved[-1].astype(np.float32)}


def _kernel(present: np.ndarray, model: dict) -> np.ndarray:
    """Kernel values of rows of gram presence with all landmarks."""
    root = np.sqrt(np.maximum(present.sum(axis=1), 1)).astype(np.float32)
    return (present[:, model["used"]].astype(np.float32) @ model["landmarks"].T) / np.outer(root, model["root"])


def predict(spark: SparkSession, text: Column, model: dict | None) -> Column:
    """struct(lang_pred, score) of a text column; null, or without a letter: ``und`` and 0."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for batch in batches:
            texts = batch.to_pylist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if m and has_letter(t)]
            for at in range(0, len(known), 64):
                rows = known[at : at + 64]
                present = np.zeros((len(rows), 1 << HASH_BITS), dtype=bool)
                for k, i in enumerate(rows):
                    present[k, grams(texts[i])] = True
                values = _kernel(present, m) @ m["weights"] + m["bias"]
                for i, k, v in zip(rows, values.argmax(axis=1), values.max(axis=1), strict=True):
                    langs[i], scores[i] = m["langs"][k], min(1.0, max(0.0, float(v)))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], names=["lang_pred", "score"])

    return run(text)


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row.

    Learns from rows that are not held out (crc32 of the id by 5 is not 0) and have a language.
    A prediction sees the text alone. Null texts and texts without a letter are ``und`` with
    score 0, as is everything if nothing can be learnt; equal values go to the language that sorts
    first. Repeated rows come once each; an empty table gives an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    model = fit(docs.where(~held_out("doc_id", 0)))
    found = docs.select("doc_id", predict(spark, F.col("text"), model).alias("p"))
    return found.select("doc_id", held_out("doc_id", 0).alias("held_out"), "p.lang_pred", "p.score")


def keep_languages(docs: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """Rows, with all their columns, whose text is in a learned language with score ``least`` or more."""
    model = fit(docs.where(~held_out("doc_id", 0)))
    found = predict(docs.sparkSession, docs["text"], model)
    return docs.where((found["score"] >= least) & (found["lang_pred"] != UNKNOWN))
