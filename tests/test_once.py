"""What is computed once, and only as far as it is read."""

import json

import pytest
from pyspark.sql import functions as F

from ruleloom.operators import configs as C
from ruleloom.operators import inheritance, reports
from ruleloom.session import dealt_join


def plan_lines(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_reports_are_parsed_above_the_exchange_that_deals_them(spark):
    raw = F.concat(F.lit('[{"issueId":"i'), "report_id", F.lit('","ruleId":"r"}]'))
    dealt = spark.range(50).select(F.lit("p").alias("project_id"), F.col("id").alias("report_id")).repartition(7, "report_id").withColumn("raw", raw)
    found = reports.violation_rows(reports.select_rule(reports.report_violations(dealt), F.lit("r")))
    lines = plan_lines(found)
    parsed = [n for n, line in enumerate(lines) if "parseJson" in line]
    dealing = [n for n, line in enumerate(lines) if "RepartitionByExpression" in line]
    assert len(parsed) == 1 and lines[parsed[0]].count("parseJson") == 1
    assert parsed[0] < dealing[0]  # the plan's root comes first
    assert sum("$.ruleId" in line for line in lines) == 1
    assert found.count() == 50


@pytest.mark.parametrize("fields", [("enabledRuleIds", "scopes", "rulesFile"), ("plain", "exception_entries", "i18n", "promptTemplates")])
def test_wanted_columns_are_as_in_the_whole(spark, fields):
    parent = {"stack": "a", "rulesFile": "r.md", "enabledRuleIds": ["A"], "thresholds": {"x": 1, "y": 2}, "exceptions": {"A": ["p"]}, "detectOptions": {"include": ["src"]}, "prompt": {"promptTemplates": {"u": "v"}}}
    child = {"extends": "p.json", "stack": None, "enabledRuleIds": ["B", "A"], "scopes": ["s"], "thresholds": {"y": 3}, "exceptions": {"A": ["q"], "B": "no"}, "pathAliases": {"@": "src"}, "i18n": {"defaultLocale": "fr"}}
    docs = spark.createDataFrame([("p.json", json.dumps(parent)), ("c.json", json.dumps(child)), ("bad.json", "{")], "path string, content string")
    shown = lambda df: sorted(map(str, df.select("config_path", "n_documents", *[F.to_json(F.struct(c)) for c in fields]).collect()))
    whole = C.effective_configs(C.config_chains(docs))
    part = C.effective_configs(C.config_chains(docs, fields=fields), fields)
    assert set(part.columns) == {"config_path", "n_documents", *fields}
    assert shown(part) == shown(whole)


def test_rows_of_a_shared_key_or_none_are_dealt(spark):
    key = F.when(F.col("id") < 300, "hot").when(F.col("id") < 600, F.concat(F.lit("k"), F.col("id").cast("string")))
    rows = spark.range(900).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), key.alias("parent"))
    table = rows.where("parent is not null").select("parent").distinct().withColumn("v", F.concat(F.lit("v-"), "parent"))
    joined = dealt_join(rows, table, "parent", "path", 100, max_bytes=0)
    assert joined.columns == ["parent", "path", "v"]
    got = {(r.path, r.parent, r.v) for r in joined.collect()}
    assert joined.count() == 900
    assert got == {(r.path, r.parent, r.parent and f"v-{r.parent}") for r in rows.collect()}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["n"] for r in dealt_join(rows, table, "parent", "path", 100, max_bytes=0).where("parent = 'hot' or parent is null").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 300


def test_chains_are_the_same_when_parents_are_not_broadcast(spark, monkeypatch):
    docs = [(f"c{n}", "hub" if n % 3 else None, n) for n in range(60)] + [("hub", "root", -1), ("root", None, -2), ("x", "y", -3), ("y", "x", -4), ("z", "gone", -5)]
    table = spark.createDataFrame(docs, "path string, parent string, body int")
    shown = lambda: sorted(map(str, inheritance.resolve_chains(table).collect()))
    whole = shown()
    monkeypatch.setattr(inheritance, "SHARED_BY", 10)
    monkeypatch.setattr(inheritance, "dealt_join", lambda *args: dealt_join(*args, max_bytes=0))
    assert shown() == whole
