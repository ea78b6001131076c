"""Short rows that cost much work each are spread over tasks; documents are parsed in one pass over their lines."""

from pyspark.sql import functions as F

from ruleloom.catalog import inputs as I
from ruleloom.functions.text import BLANK, BLANK_CHARS
from ruleloom.operators import quality as Q
from ruleloom.operators import rules as RU
from ruleloom.session import DEALT_ROWS


def test_one_small_file_of_many_rows_is_dealt_to_several_tasks(spark, tmp_path):
    n = 2 * DEALT_ROWS + 1
    part = spark.range(n).select(
        F.col("id").alias("p_partkey"), F.lit("a b").alias("p_name"), F.lit("B1").alias("p_brand"), F.lit("T").alias("p_type"), F.lit(1).alias("p_size")
    )
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    docs = I.Inputs(spark, str(tmp_path)).rule_docs()
    held = docs.where("path like 'projects/%'").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in held) == n and len(held) > 2
    assert max(r["count"] for r in held) < 1.2 * DEALT_ROWS


def test_python_knows_the_same_blanks(spark):
    rows = spark.createDataFrame([(n, chr(n)) for n in range(0x10000) if not 0xD800 <= n < 0xE000], "n int, c string")
    found = {r.n for r in rows.where(F.col("c").rlike(rf"\A{BLANK}\z")).collect()}
    assert found == set(map(ord, BLANK_CHARS))


def test_documents_without_text_or_rules_and_long_ones(spark):
    many = "\n".join(f"### RULE: R-{k}\nintent: {k}\ndetect:\n  regex: x{k}" for k in range(3000))
    rows = [(0, None), (1, ""), (2, "no rule"), (3, "﻿　### RULE: A\r\nfix: 'q'\r\n"), (4, many)]
    docs = spark.createDataFrame(rows, "n int, content string").select("n", RU.document_rules(F.col("content")).alias("rules"))
    found = {r.n: r.rules for r in docs.collect()}
    assert found[0] is None and found[1] == [] and found[2] == []
    assert [(r.rule_id, r.fix, r.detect, r.context) for r in found[3]] == [("A", "q", {}, [])]
    assert [(r.block_pos, r.rule_id, r.intent, r.detect) for r in found[4]] == [(k, f"R-{k}", str(k), {"regex": f"x{k}"}) for k in range(3000)]
    broken = spark.range(1).select(RU.document_rules(F.concat(F.lit("### RULE: B"), F.unhex(F.lit("FF")).cast("string"))).alias("rules")).first().rules
    assert [r.rule_id for r in broken] == ["B�"]


def test_sides_that_grow_with_the_projects_are_not_broadcast_by_an_estimate(spark):
    rules = spark.createDataFrame([("p", "R-1", 0)], "project_id string, rule_id string, rule_pos bigint")
    projects = spark.createDataFrame([("p", ["R-1", "R-2"], ["s"])], "project_id string, enabledRuleIds array<string>, scopes array<string>")
    for table in (Q.active_rules(rules, projects), Q.enabled_missing(rules, projects), RU.duplicate_rules(rules)):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [r.rule_id for r in Q.active_rules(rules, projects).collect()] == ["R-1"]
    assert [r.rule_id for r in Q.enabled_missing(rules, projects).collect()] == ["R-2"]
