"""Periodic runs beside a search of every period at every place."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ruleloom.llm import runs
from ruleloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RNG = random.Random(8)


def plain_runs(w):
    """All runs, by trying each period from the shortest on."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        at = 0
        while at + q < len(w):
            end = at
            while end + q < len(w) and w[end] == w[end + q]:
                end += 1
            length = end + q - at
            if end > at and length >= max(6, 4 * q) and not any(w[at : at + length - p] == w[at + p : at + length] for p in range(1, q)):
                found.append((at, length, q))
            at = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(n, letters):
    return [b"w%d" % RNG.randrange(letters) for _ in range(n)]


def texts():
    for _ in range(1500):
        w = random_words(RNG.randint(0, 60), RNG.choice([1, 2, 2, 3, 5, 40]))
        if w and RNG.random() < 0.6:
            a, p = RNG.randrange(len(w)), 1 + RNG.randrange(max(1, len(w) // 4))
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        yield w
    for _ in range(20):  # runs in runs, runs that touch
        inner = random_words(RNG.randint(1, 4), 3) * RNG.randint(4, 7)
        yield (inner + random_words(RNG.randint(0, 3), 4)) * RNG.randint(4, 6) + inner


def test_runs_equal_a_plain_search():
    for w in texts():
        assert list(map(tuple, runs.text_runs(w).tolist())) == plain_runs(w), w


def test_stretches_leave_no_run_out():
    for w in texts():
        if w:
            assert np.array_equal(runs.runs_of(runs.numbered(w)), runs.text_runs(w)), w


def test_common_beginnings_and_leaf_order():
    for n, letters in ((1, 1), (2, 1), (30, 1), (40, 2), (200, 4), (200, 300)):
        x = np.array([RNG.randrange(letters) for _ in range(n)])
        tree = runs.SuffixTree(x)
        suffixes = sorted(range(n + 1), key=lambda i: x[i:].tolist())
        assert tree.suffixes.tolist() == suffixes
        pairs = [(a, b) for a in range(n) for b in range(n) if a != b][:: max(1, n * n // 4000)]
        if pairs:
            a, b = map(np.array, zip(*pairs, strict=True))
            for i, j, k in zip(a.tolist(), b.tolist(), tree.agree(a, b).tolist(), strict=True):
                assert x[i : i + k].tolist() == x[j : j + k].tolist()
                assert max(i, j) + k == n or x[i + k] != x[j + k]


@pytest.mark.parametrize("period", [1, 2, 999])
def test_a_very_long_run(period):
    w = [b"w%d" % (i % period) for i in range(100_000)]
    assert runs.text_runs([b"first", *w, b"last"]).tolist() == [[1, 100_000, period]]
    assert runs.collapsed(w, runs.text_runs(w)) == b" ".join(w[:period])


def test_dropped_words():
    w = b"a b b b b b b b c d c d c d c d e".split()
    found = runs.text_runs(w)
    assert found.tolist() == [[1, 7, 1], [8, 8, 2]]
    assert runs.collapsed(w, found) == b"a b c d e"


def plain_tail(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_repeated_tail():
    for doc_id in range(-300, 300):
        w = random_words(RNG.randint(0, 30), 50)
        assert runs.repeated_tail(doc_id, w) == plain_tail(doc_id, w)
    assert runs.repeated_tail(None, [b"a"] * 9) == [b"a"] * 9


def test_rows_nulls_and_other_columns(spark):
    many = "x y " * 30_000
    rows = [(1, "a a a a a a\tb", 3), (1, "a a a a a a\tb", 3), (2, None, 3), (3, "", 3), (4, " \n ", 3), (None, "c\xa0d c\xa0d c\xa0d c\xa0d c\xa0d c\xa0d", 3), (None, None, None), (5, many, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    found = {(r.doc_id, r.collapsed): r for r in runs.periodic_runs(docs).collect()}
    assert runs.periodic_runs(docs).count() == len(rows)
    assert [tuple(x) for x in found[1, "a b"].runs] == [(0, 6, 1)]
    assert found[None, "c\xa0d"].n_words == 6
    assert [tuple(x) for x in found[5, "x y"].runs] == [(0, 60_000, 2)]
    assert all(found[key].n_words == 0 for key in ((2, ""), (3, ""), (4, ""), (None, "")))
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_query_on_the_whole_table(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op12_periodic_runs"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    assert sum(r.n_runs for r in rows) > 10
    for r in rows:
        w = plain_tail(r.doc_id, [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])])
        if len(w) > 1500:
            continue  # the plain search is slow; long texts are compared above
        found = plain_runs(w)
        best = min(found, key=lambda f: (-f[1], f[0], f[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
        drop = {i for s, n, p in found for i in range(s + p, s + n)}
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in drop)).hexdigest()
