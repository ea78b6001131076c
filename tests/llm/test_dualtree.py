"""Ranked search beside scores of every item with every document."""

import math
import random
import re

import numpy as np
import pytest

from ruleloom.llm import dualtree
from ruleloom.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, k=20):
    lines = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(1 for _, x in lines if x), sum(len(x) for _, x in lines)
    df = {}
    for _, x in lines:
        for t in set(x):
            df[t] = df.get(t, 0) + 1
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, x in lines:
            score = 0
            for t in terms(text):
                if t in x:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 25 + (25 * len(x) * n_docs) // total
                    score += w * ((1_000_000_000 * x.count(t)) // (1000 * x.count(t) + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if unnamed else doc_id, -score) for rank, (score, unnamed, doc_id) in enumerate(sorted(scored)[:k], 1)]
    return out


def told(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def tables(spark, rng, n_docs, n_items, words):
    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    docs = [(i * 7 % n_docs, text(rng.randint(0, 40))) for i in range(n_docs)]
    docs += [(n_docs + i, docs[0][1]) for i in range(30)]  # equal scores
    docs += [(5, docs[3][1]), (5, docs[3][1]), (None, docs[0][1]), (None, None), (9, ""), (11, "  ,. "), (12, "ÉTÉ Été x_y é1 " * 3), (13, text(20_000))]
    items = [(i, text(rng.randint(1, 12))) for i in range(n_items)]
    items += [(0, items[0][1]), (0, items[0][1]), (None, items[1][1]), (90, None), (91, ""), (92, "..."), (93, "nowhere found"), (94, "Été X Y É1"), (95, text(3000))]
    return docs, items


@pytest.mark.parametrize(("seed", "words"), [(1, 15), (2, 300)])
def test_ranks_equal_a_plain_search(spark, monkeypatch, seed, words):
    rng = random.Random(seed)
    names = ["the", "The", "of", *[f"w{i}" for i in range(words)]]
    docs, items = tables(spark, rng, 250, 24, names)
    monkeypatch.setattr(dualtree, "TREE_DOCS", 64)
    monkeypatch.setattr(dualtree, "OPENING_DOCS", 60)
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, terms int").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    wanted = sorted(plain_search(docs, items), key=str)
    assert told(dualtree.ranked_search(d, q)) == wanted
    monkeypatch.setattr(dualtree, "BLOCK_BYTES", 200)  # blocks of a few items give the same
    assert told(dualtree.ranked_search(d, q.limit(12))) == sorted(plain_search(docs, items[:12]), key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert dualtree.ranked_search(docs.limit(0), items).count() == 0
    assert dualtree.ranked_search(docs, items.limit(0)).count() == 0
    assert dualtree.ranked_search(docs, items).count() == 1
    assert dualtree.ranked_search(docs, items, k=1).columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_hold_and_prune(monkeypatch):
    rng = np.random.default_rng(4)
    size, n_docs, n_items = 120, 2000, 60
    docs = np.where(rng.random((n_docs, size)) < 0.05, rng.integers(1, 10**6, (n_docs, size)), 0).astype(np.float32)
    docs = docs[np.argsort(docs.argmax(axis=1), kind="stable")]
    vectors = []
    for _ in range(n_items):
        t = np.sort(rng.choice(size, 6, replace=False))
        vectors.append((t, rng.integers(1, 20_000, 6).astype(np.float64)))
    root, levels = dualtree.item_tree(vectors), dualtree.doc_tree(docs)
    assert sorted(root.items.tolist()) == list(range(n_items))
    for upper, lower in zip(levels[1:], levels, strict=False):
        assert (np.repeat(upper, dualtree.DOC_FANOUT, axis=0)[: len(lower)] >= lower).all()
    met = []
    best = dualtree.Best(np.zeros(n_items, np.int64), 20)
    add = best.add
    best.add = lambda item, scores, ids: met.append(len(scores)) or add(item, scores, ids)
    ids = np.stack((np.arange(n_docs), np.zeros(n_docs, np.int64)))
    dualtree.search(root, levels, ids, best)
    dense = np.zeros((n_items, size))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    scores = docs.astype(np.float64) @ dense.T
    for i in range(n_items):
        order = sorted(range(n_docs), key=lambda d: (-scores[d, i], d))[:20]
        assert best.ids[i][0].tolist() == order
    met.clear()
    again = dualtree.Best(best.least.astype(np.int64), 20)
    again_add = again.add
    again.add = lambda item, scores, ids: met.append(len(scores)) or again_add(item, scores, ids)
    dualtree.search(root, levels, ids, again)
    assert [i[0].tolist() for i in again.ids] == [i[0].tolist() for i in best.ids]
    assert sum(met) == 20 * n_items  # whole batches below the least scores are passed over


def test_query_equals_sql(spark):
    name = "op13_ranked_search"
    assert compare(spark, connect(SF), SF, name, QUERIES[name], ORACLES[name]) is None
