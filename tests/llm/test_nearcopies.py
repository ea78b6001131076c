"""Near-copies beside a greedy pass over all pairs, and the work on groups that share bands."""

import random

import numpy as np
import pytest

from ruleloom.llm import nearcopies

DOCS = "doc_id long, text string, __key long, __text string"


def plain_similarity(a, b):
    return nearcopies.similarity(nearcopies.shingles(a), nearcopies.shingles(b))


def greedy(rows):
    """Ids that stay when each row, in order of ids, goes if it is near an earlier one that stays."""
    kept = []
    for i, text in sorted(rows):
        found = nearcopies.shingles(text)
        keys = set(nearcopies.bands(found))
        if not any(keys & other_keys and nearcopies.similarity(found, other) >= 0.8 or np.array_equal(found, other) for _, other, other_keys in kept):
            kept.append((i, found, keys))
    return {i for i, _, _ in kept}


def edited(rng, words, share):
    return [f"n{rng.randrange(10**9)}" if rng.random() < share else w for w in words]


def corpus(rng):
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randint(40, 160))]
        texts += [" ".join(edited(rng, base, rng.choice([0.0, 0.01, 0.02, 0.03, 0.05]))) for _ in range(25)]
    common = [f"c{k}" for k in range(100)]
    texts += [" ".join(common + [f"u{rng.randrange(10**9)}" for _ in range(40)]) for _ in range(14)]
    texts += ["", "one", "one two", "ONE two", " ".join(common)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("least_settled", [0.0, 1.1])
def test_result_is_the_greedy_one(spark, monkeypatch, least_settled):
    monkeypatch.setattr(nearcopies, "LEAST_SETTLED", least_settled)
    rows = corpus(random.Random(3))
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS)
    kept = nearcopies.drop_near_copies(table)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == greedy(rows)


def test_texts_unlike_each_other_meet_few(spark, monkeypatch):
    """Texts of one long passage and words of their own share bands, yet their pairs do not grow with the square."""
    compared = []
    alike = nearcopies._alike
    monkeypatch.setattr(nearcopies, "_alike", lambda texts, pairs, least: compared.append(pairs.count()) or alike(texts, pairs, least))
    common = [f"c{k}" for k in range(100)]
    work = {}
    for n in (150, 600):
        rng = random.Random(n)
        rows = [(i, " ".join(common + [f"u{rng.randrange(10**9)}" for _ in range(32)])) for i in range(n)]
        compared.clear()
        assert nearcopies.first_texts(spark.createDataFrame(rows, "doc_id long, text string")).count() == n
        work[n] = sum(compared)
    assert work[600] <= 4 * work[150] + 600


def test_nothing_from_nothing(spark):
    table = spark.createDataFrame([], DOCS)
    assert nearcopies.drop_near_copies(table).count() == 0
    one = spark.createDataFrame([(1, None, 1, None), (1, None, 1, None), (None, "a", 1, None), (None, "a", 1, None)], DOCS)
    assert sorted(str(r.doc_id) for r in nearcopies.drop_near_copies(one).collect()) == ["1", "None"]


def test_pairs_that_share_no_band_are_met_by_their_fingerprints(spark):
    """A pair of similarity 0.8 within four bits, which all bands miss; the unlike texts beside them stay."""
    rng = random.Random(2308)
    base = [f"w{rng.randrange(10**6)}" for _ in range(94)]
    other = list(base)
    for at in (20, 50):
        other[at] = f"n{rng.randrange(10**6)}"
    a, b = " ".join(base), " ".join(other)
    keys = [set(nearcopies.bands(nearcopies.shingles(t))) for t in (a, b)]
    assert plain_similarity(a, b) >= 0.8 and not keys[0] & keys[1]
    rows = [(1, a), (2, b), (3, a + " "), (4, " ".join(base[:47])), (5, None), (6, ""), (None, b)]
    kept = nearcopies.first_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [1, 4, 5]


def test_linked_texts_that_are_unlike_stay(spark, monkeypatch):
    """One component of all brings every two texts together; only the similarity lets one go."""
    rows = corpus(random.Random(3))
    monkeypatch.setattr(nearcopies, "links", lambda prints: prints.selectExpr("fp AS a", "0L AS b"))
    monkeypatch.setattr(nearcopies, "components", lambda links: links.selectExpr("a AS node", "b AS root"))
    kept = {r.doc_id for r in nearcopies.first_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == greedy_of_all(rows)


def greedy_of_all(rows):
    """As :func:`greedy`, with all pairs compared."""
    kept = []
    for i, text in sorted(rows):
        found = nearcopies.shingles(text)
        if not any(nearcopies.similarity(found, other) >= 0.8 for _, other in kept):
            kept.append((i, found))
    return {i for i, _ in kept}
