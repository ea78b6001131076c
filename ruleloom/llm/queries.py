"""The registered queries ``opN_<name>`` of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm.bpe import encoded
from ruleloom.llm.bytebpe import byte_encoded
from ruleloom.llm.common import table
from ruleloom.llm.decontam import leaks
from ruleloom.llm.dualtree import ranked_search
from ruleloom.llm.htmltext import main_texts
from ruleloom.llm.langid import languages
from ruleloom.llm.lattice import lattice_scores
from ruleloom.llm.omh import order_minhash
from ruleloom.llm.quotes import link_quotes
from ruleloom.llm.resample import resample
from ruleloom.llm.runs import periodic_runs, repeated_tail
from ruleloom.llm.simhash import near_duplicates
from ruleloom.llm.toxicity import toxicity


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages without quotes, with the messages they quote and their place in the reply order."""
    return link_quotes(table(spark, sf_dir, "conversations"))


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of all documents."""
    return encoded(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, copied or paraphrased."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn from all by their likeness to the texts labelled as good."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash fingerprints of all documents, of edited copies, and their likeness."""
    return order_minhash(table(spark, sf_dir, "documents"))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return main_texts(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents."""
    return languages(table(spark, sf_dir, "documents"))


def op9_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents."""
    return lattice_scores(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_byte_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes of all documents."""
    return byte_encoded(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of all documents, edited as agreed, and digests of all runs and of the text without repetitions."""
    found = periodic_runs(table(spark, sf_dir, "documents"), repeated_tail)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), lines.alias("lines"), "collapsed").select(
        "doc_id",
        "n_runs",
        "best.start",
        (-F.col("best.l")).alias("length"),
        "best.period",
        F.expr("1000 * -best.l div best.period").alias("exponent_milli"),
        F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quotation_linking": op1_quotation_linking,
    "op2_bpe_roundtrip": op2_bpe_roundtrip,
    "op3_benchmark_leaks": op3_benchmark_leaks,
    "op4_simhash_neardup": op4_simhash_neardup,
    "op5_importance_resampling": op5_importance_resampling,
    "op6_order_minhash": op6_order_minhash,
    "op7_html_main_text": op7_html_main_text,
    "op8_language_id": op8_language_id,
    "op9_lattice_scores": op9_lattice_scores,
    "op10_toxicity": op10_toxicity,
    "op11_byte_bpe_roundtrip": op11_byte_bpe_roundtrip,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_ranked_search": op13_ranked_search,
}

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op13_ranked_search": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
     c AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
     i AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark),
     q AS (SELECT i, item_id, term, count(*) AS repeats FROM (SELECT i, item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
     t AS (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
     f AS MATERIALIZED (SELECT r, doc_id, n, term, count(*) AS tf FROM t SEMI JOIN q USING (term) GROUP BY ALL),
     w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY term),
     s AS (SELECT i, item_id, r, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
           FROM q JOIN f USING (term) JOIN w USING (term), c GROUP BY ALL),
     k AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 20
""",
}
