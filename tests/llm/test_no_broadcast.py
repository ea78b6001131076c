"""Sides that grow with the documents are never broadcast, however small Spark takes them for."""

import random

import pytest

from ruleloom.llm import common, components, decontam, nearcopies, simhash


@pytest.fixture
def plans(monkeypatch):
    """The plan of each table that the operators stage."""
    seen = []

    def staged(df, **options):
        seen.append(plan_of(df))
        return common.staged(df, **options)

    for module in (components, decontam, nearcopies, simhash):
        monkeypatch.setattr(module, "staged", staged)
    return seen


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(5, 50))) for _ in range(60)]
    common_ = " ".join(f"c{k}" for k in range(100))
    texts += [f"{common_} " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(rng.choice([2, 40]))) for _ in range(20)]
    texts += [texts[0], texts[1] + " more", "", None]
    # Read from files, as the sizes of other tables are unknown to Spark and never broadcast.
    path = str(tmp_path_factory.mktemp("docs") / "documents")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    return spark.read.parquet(path)


def test_links_of_few_bytes_meet_in_a_shuffled_join(spark):
    prints = common.staged(spark.range(200).selectExpr("id * 3 as fp"))
    found = simhash.links(prints)
    want = {(a * 3, b * 3) for a in range(200) for b in range(a + 1, 200) if (a * 3 ^ b * 3).bit_count() <= simhash.DISTANCE}
    assert {(r.a, r.b) for r in found.collect()} == want
    assert "SortMergeJoin" in plan_of(found) and "Broadcast" not in plan_of(found)


def test_near_duplicates_broadcast_nothing(docs, plans):
    found = simhash.near_duplicates(docs)
    assert found.count() == docs.count()
    assert len(plans) > 6 and not [p for p in [*plans, plan_of(found)] if "Broadcast" in p]


@pytest.mark.parametrize("least_settled", [0.0, 1.1])
def test_near_copies_broadcast_only_what_was_counted(docs, plans, monkeypatch, least_settled):
    monkeypatch.setattr(nearcopies, "LEAST_SETTLED", least_settled)
    want = {r.doc_id for r in nearcopies.drop_near_copies(docs).collect()}
    plans.clear()
    monkeypatch.setattr(nearcopies, "BROADCAST_TEXTS", -1)
    found = nearcopies.drop_near_copies(docs)
    assert {r.doc_id for r in found.collect()} == want
    assert len(plans) > 10 and not [p for p in [*plans, plan_of(found)] if "Broadcast" in p]


def test_leaked_ids_are_broadcast_by_their_number(spark, docs, plans, monkeypatch):
    items = spark.createDataFrame([(1, " ".join(f"c{k}" for k in range(30)))], "item_id long, text string")
    want = {r.doc_id for r in decontam.drop_leaks(docs, items).collect()}
    assert 0 < len(want) < docs.count()
    monkeypatch.setattr(decontam, "BROADCAST_IDS", -1)
    found = decontam.drop_leaks(docs, items)
    assert {r.doc_id for r in found.collect()} == want
    assert "Broadcast" not in plan_of(found)
