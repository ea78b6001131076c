"""From raw documents to token ids: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm.bpe import default_vocabulary, encode
from ruleloom.llm.common import release, small_batches, staged, staged_so_far, table
from ruleloom.llm.decontam import drop_leaks
from ruleloom.llm.langid import keep_languages
from ruleloom.llm.nearcopies import drop_near_copies
from ruleloom.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(stage: Stage) -> Stage:
    """The stage, with whole texts sent to Python workers in batches of bounded size: workers of all stages stay beside one heap."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@_in_small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the documents' own labels name."""
    return keep_languages(docs)


@_in_small_batches
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


@_in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not near-copies, five-word shingle similarity 0.8 or more, of an earlier one that stays.

    Pairs come from linked SimHash fingerprints and, as few bits miss many, from MinHash bands.
    """
    return drop_near_copies(docs)


@_in_small_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


@_in_small_batches
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids, their number, and a digest of the text that they decode to."""
    both = docs.select("doc_id", "lang", "source", encode(spark, F.col("text"), default_vocabulary(), decoded=True).alias("e"))
    return both.select(
        "doc_id", "lang", "source", "e.ids", F.size("e.ids").cast("long").alias("n_tokens"), F.sha2("e.decoded", 256).alias("decoded_sha256")
    )


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

#: Models are fitted on the way, which SQL can't state; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each stage's rows are written and read again.

    What a stage wrote on its way, and the rows of the stage before, are deleted when it has ended.
    """
    docs, mark = table(spark, sf_dir, "documents"), staged_so_far()
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
        release(spark, keep=docs, since=mark)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
