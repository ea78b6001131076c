"""Toxicity: logistic regression whose score may not move when identity terms are swapped.

Labelled texts that name a group are copied with other groups' names in their place. Training
penalises the squared change of the logit between a text and its copy, so the weight of the names
themselves goes to zero and neutral mentions are not taken for toxic.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ruleloom.llm.common import held_out, staged

#: Group names that are exchanged for each other within their line.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"),
    ("african", "european", "american", "mexican", "chinese", "arab"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("old", "young"),
    ("deaf", "blind", "disabled"),
)
HASH_BITS = 20
#: Words count whole and by their first letters, so that inflected forms share evidence.
PREFIXES = (4, 5)
#: At most about so many labelled rows of each class are learnt from, weighed back to the class's share.
ROWS_PER_CLASS = 4000
FEATURES = 1024
LEAST_ROWS = 3
RIDGE = 0.02
SWAP_PENALTY = 10.0
CACHED_WORDS = 200_000

_WORD = re.compile(r"\w+")


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its prefixes."""
    parts = [word, *[f"{word[:n]}*" for n in PREFIXES if len(word) >= n]]
    return tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) >> (32 - HASH_BITS) for p in parts)


def text_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def swaps(terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> dict[str, str]:
    """Each group name's replacement: the next one in its line."""
    return {t: line[(i + 1) % len(line)] for line in terms for i, t in enumerate(line)}


def _hashes(words: set[str]) -> list[int]:
    return sorted({f for w in words for f in word_features(w)})


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(toxic, weight, features, swapped) of about ``rows`` labelled texts of each class.

    ``weight`` is one over the sampling share of the class; ``swapped`` is null without a group name.
    """
    exchange = swaps()
    named = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = staged(named.where(~held_out("doc_id", 0)))
    counts = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, rows / max(1, counts.get(1, 0)))).otherwise(min(1.0, rows / max(1, counts.get(0, 0))))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1_000_000)) / 1_000_000
    chosen = train.where(place < share).select(F.col("doc_id").alias("labelled_id"), "toxic", (1 / share).alias("weight"))
    # A bounded number of ids: about two times ``rows``, whatever the size of the tables.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, swapped = [], []
            for text in batch.column(2).to_pylist():
                words = text_words(text)
                features.append(_hashes(words))
                swapped.append(_hashes({exchange.get(w, w) for w in words}) if words & exchange.keys() else None)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(features, kind), pa.array(swapped, kind)], names=["toxic", "weight", "features", "swapped"])

    return staged(texts.select(F.col("toxic").cast("int"), "weight", "text").mapInArrow(run, "toxic int, weight double, features array<int>, swapped array<int>"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS, features: int = FEATURES, penalty: float = SWAP_PENALTY) -> dict | None:
    """Weights of the ``features`` hashes that tell the classes apart best; None if a class is missing.

    The driver gets the features' counts and one bit for each feature and sampled text.
    """
    sample = _sample(docs, labels, rows)
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return None
    counts = (
        sample.select("toxic", F.explode(F.array_distinct(F.concat("features", F.coalesce("swapped", F.array().cast("array<int>"))))).alias("f"))
        .groupBy("f")
        .agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
        .where(F.col("p") + F.col("n") >= LEAST_ROWS)
    )
    p, n = (F.col("p") + 0.5) / (pos + 1), (F.col("n") + 0.5) / (neg + 1)
    evidence = F.abs(p - n) / F.sqrt((p + n) / 2 * (1 - (p + n) / 2) + 1e-9)
    # The names themselves always take part, else there would be nothing to hold still.
    forced = sorted({h for w in swaps() for h in word_features(w)})
    chosen = counts.orderBy((~F.col("f").isin(forced)).cast("int"), evidence.desc(), "f").limit(features)
    ids = np.array(sorted(r["f"] for r in chosen.collect()), dtype=np.int64)
    if not len(ids):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[np.packbits(np.isin(ids, f)).tobytes() if f is not None else None for f in c.to_pylist()] for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(r, pa.binary()) for r in rows]], names=["toxic", "weight", "x", "y"])

    found = sample.mapInArrow(run, "toxic int, weight double, x binary, y binary").toPandas()
    bits = lambda c: np.unpackbits(np.array([np.frombuffer(b, np.uint8) for b in c]), axis=1)[:, : len(ids)].astype(np.float32)
    x, label = bits(found["x"]), found["toxic"].to_numpy(np.float32)
    pairs = found["y"].notna().to_numpy()
    moved = bits(found["y"][pairs]) - x[pairs] if pairs.any() else np.zeros((0, len(ids)), np.float32)
    share = found["weight"].to_numpy()
    return {"ids": ids, **_train(x, label, share / share.sum(), moved, share[pairs] / max(share[pairs].sum(), 1e-12), penalty)}


def _train(x: np.ndarray, label: np.ndarray, share: np.ndarray, moved: np.ndarray, moved_share: np.ndarray, penalty: float) -> dict:
    """Newton steps for mean log-loss + ridge + penalty * mean squared change of the logit.

    Both means weigh each row by its share, so a sample stands for all labelled rows and the
    classes keep their shares, however many rows of each were drawn.
    """
    rows, width = x.shape
    x = np.column_stack([x, np.ones(rows, np.float32)])
    hold = np.zeros((width + 1, width + 1))
    hold[:width, :width] = RIDGE / 100 * np.eye(width) + (penalty * ((moved * moved_share[:, None]).T @ moved) if len(moved) else 0)
    w = np.zeros(width + 1)
    for _ in range(12):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (s - label)) + hold @ w
        curve = (x * (share * s * (1 - s))[:, None].astype(np.float32)).T @ x + hold + 1e-8 * np.eye(width + 1)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-3:
            break
    return {"weights": w[:-1], "bias": float(w[-1])}


def score(spark: SparkSession, text: Column, model: dict | None) -> Column:
    """Probability that a text is toxic; a null text counts as empty, without a model all are 0."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        weight = dict(zip(m["ids"].tolist(), m["weights"].tolist(), strict=True)) if m else {}
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                held: set[int] = set()
                for w in text_words(text):
                    known = cache.get(w)
                    if known is None:
                        if len(cache) >= CACHED_WORDS:
                            cache.clear()
                        known = cache[w] = tuple(f for f in word_features(w) if f in weight)
                    held.update(known)
                z = m["bias"] + sum(weight[f] for f in sorted(held)) if m else -np.inf
                out.append(1 / (1 + np.exp(-z)) if z > -700 else 0.0)
            yield pa.array(out, pa.float64())

    return run(text)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    Learns from labelled rows that are not held out (crc32 of the id by 5 is not 0); of an id that
    is labelled twice the higher label counts, labels other than 0 and 1 and null ids do not. A
    score sees the text alone. A null text is an empty one. If a class is missing, nothing can be
    learnt and all scores are 0. Repeated rows come once each; an empty table gives an empty
    result; other columns are ignored.
    """
    model = fit(docs, labels)
    found = docs.select("doc_id", held_out("doc_id", 0).alias("held_out"), score(docs.sparkSession, F.col("text"), model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows, with all their columns, whose score is below 0.5."""
    return docs.where(score(docs.sparkSession, docs["text"], fit(docs, labels)) < 0.5)
