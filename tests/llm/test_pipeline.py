"""The pipeline's stages on the small tables, against plain versions of what they decide."""

import pyarrow as pa
import pytest

import corpus_pipeline
from ruleloom.llm import common, decontam
from ruleloom.llm.common import staged
from ruleloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_stages_follow_each_other(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, names = documents, [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "near_dedup", "decontaminate", "tokenize"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = staged(stage(spark, docs, SF))
        assert kept.columns == documents.columns, name
        assert not kept.exceptAll(docs).count(), name
        docs = kept
    found = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in found.collect()} == {r.doc_id for r in docs.collect()}
    assert found.where("n_tokens <> size(ids)").isEmpty()
    lines = [f" {' '.join(decontam.words_of(r.text))} " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for r in docs.collect():
        text = f" {' '.join(decontam.words_of(r.text))} "
        assert not any(line in text for line in lines)


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_the_pipeline_leaves_its_last_table_only(spark):
    other = staged(spark.range(3))
    mark = common.staged_so_far()
    found = corpus_pipeline.run(spark, SF)
    assert common.staged_so_far() == mark + 1
    assert found.count() > 0 and other.count() == 3


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        class sparkContext:
            master = "spark://somewhere:7077"

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)


def _largest_batch(docs):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    return max(r.n for r in docs.select("text").coalesce(1).mapInArrow(run, "n long").collect())


def test_stages_send_texts_to_python_in_small_batches(spark):
    """The default sends these 8 MB at once; each stage must bound it, as each may be called by itself."""
    long_texts = spark.range(2000).selectExpr("id AS doc_id", "'en' AS lang", "'s' AS source", "repeat(cast(id AS string), 1000) AS text")
    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset(SETTING)
        stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
        assert _largest_batch(long_texts) < 3 << 20, name
    spark.conf.set(SETTING, "1m")
    common.small_batches(spark)
    assert spark.conf.get(SETTING) == "1m"
    spark.conf.unset(SETTING)


def test_a_search_needs_no_python_workers_for_an_empty_frame(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    assert "ExistingRDD" not in decontam.leaks(docs, items)._jdf.queryExecution().toString()
    none = decontam.leaks(docs, items.limit(0))
    assert none.columns == [c.split()[0] for c in decontam.PAIRS.split(", ")] and none.isEmpty()
