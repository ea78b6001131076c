"""Chains beside a walk of each document, one parent at a time."""

import random

import pytest
from pyspark.sql import functions as F

from ruleloom.operators import inheritance


def plain_chain(docs, start):
    """(chain, status, trouble) by following one parent after the other."""
    chain, at = [], start
    while True:
        if at not in docs:
            return chain, "missing", at
        if at in chain:
            return chain, "cycle", at
        if not docs[at][1]:
            return chain or [at], "unreadable", at
        chain.append(at)
        if docs[at][0] is None:
            return chain, "ok", None
        at = docs[at][0]


def resolved(spark, docs, starts=None):
    rows = [(p, parent, {"of": p}, readable) for p, (parent, readable) in docs.items()]
    table = spark.createDataFrame(rows, "path string, parent string, body map<string,string>, readable boolean")
    wanted = None if starts is None else spark.createDataFrame([(s,) for s in starts], "start string")
    found = {}
    for r in inheritance.resolve_chains(table, wanted).collect():
        assert r.start not in found and [x.body["of"] for x in r.chain] == [x.path for x in r.chain]
        found[r.start] = ([x.path for x in r.chain], r.status, r.trouble)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_equal_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    names = [f"d{i}" for i in range(160)]
    docs = {}
    for i, name in enumerate(names):
        up = rng.choice([None, names[i - 1] if i else None, rng.choice(names), names[rng.randrange(i + 1)], "nowhere"] + [names[i // 2 - 1] if i > 1 else None] * 3)
        docs[name] = (up, rng.random() > 0.04)
    docs["self"] = ("self", True)
    docs["to-self"] = ("self", True)
    assert resolved(spark, docs) == {n: plain_chain(docs, n) for n in docs}
    some = names[::7] + ["not-there"]
    assert resolved(spark, docs, some) == {n: plain_chain(docs, n) for n in some if n in docs}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    plain = inheritance.staged
    monkeypatch.setattr(inheritance, "staged", lambda df, name: rounds.append(name) or plain(df, name))
    docs = {f"d{i}": (f"d{i + 1}" if i < 63 else None, True) for i in range(64)} | {f"c{i}": (f"c{(i + 1) % 40}", True) for i in range(40)}
    found = resolved(spark, docs)
    assert found["d0"] == ([f"d{i}" for i in range(64)], "ok", None)
    assert found["c5"] == ([f"c{(5 + i) % 40}" for i in range(40)], "cycle", "c5")
    assert rounds.count("chain-round") - 1 <= 8  # the first is the table itself


def test_no_documents(spark):
    table = spark.createDataFrame([], "path string, parent string, body string")
    assert inheritance.resolve_chains(table).count() == 0


def test_a_parent_that_all_share_is_no_group(spark):
    docs = spark.range(3000).select(F.concat(F.lit("d"), "id").alias("path"), F.lit("base").alias("parent"), F.lit("b").alias("body"))
    base = spark.createDataFrame([("base", None, "root")], "path string, parent string, body string")
    found = inheritance.resolve_chains(docs.unionByName(base))
    assert found.where("size(chain) = 2 and status = 'ok'").count() == 3000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan  # the starts are not shuffled
