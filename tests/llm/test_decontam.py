"""Benchmark passages beside a search of every item in every stretch of every document."""

import math
import random

import numpy as np
import pytest

from ruleloom.llm import decontam

RNG = random.Random(6)
COMMON = ["the", "of", "and", "in", "to", "is"]
NAMES = [f"{a}{b}" for a in ("bar", "col", "din", "fer", "gol", "hum", "jas", "kel") for b in ("ta", "mo", "ri", "su", "ven", "lo", "dex", "pa")]


def words(n, rng):
    return [rng.choice(COMMON) if rng.random() < 0.45 else rng.choice(NAMES) + rng.choice(["", "s", "ed", "ing", "er"]) for _ in range(n)]


def paraphrase(line, kept, rng):
    """Some words replaced, some added, the last eight left."""
    head = [w if rng.random() < kept else rng.choice(NAMES) for w in line[:-8]]
    for _ in range(len(line) // 10):
        head.insert(rng.randrange(len(head) + 1), rng.choice(COMMON))
    return head + line[-8:]


def fixture(copies):
    rng = random.Random(9)
    items = [(k, words(rng.randint(9, 45), rng)) for k in range(12)]
    docs = []
    for i in range(60 * copies):
        text = words(rng.randint(20, 160), rng)
        k = rng.randrange(12)
        kind = i % 5
        if kind == 0:
            at = rng.randrange(len(text))
            text[at:at] = items[k][1]
        elif kind in (1, 2):
            at = rng.randrange(len(text))
            text[at:at] = paraphrase(items[k][1], 0.9 if kind == 1 else 0.7, rng)
        elif kind == 3:
            text = items[k][1][: len(items[k][1]) // 2] + text
        docs.append((i, text))
    return items, docs


def plain_leaks(items, docs):
    """(doc, item) where some stretch of four item lengths holds the words asked for."""
    found = set()
    for i, text in docs:
        for k, line in items:
            for at in range(max(1, len(text) - 2 * len(line))):
                part = text[at : at + decontam.STRETCH * len(line)]
                share = decontam.common_subsequence(line, part) / len(line)
                answer = decontam.common_subsequence(line[-8:], part) / len(line[-8:])
                if share >= 0.8 or (share >= 0.6 and answer >= 0.8):
                    found.add((i, k))
                    break
    return found


@pytest.mark.parametrize("copies", [1, 3])
def test_recall_of_a_plain_search(spark, copies):
    items, docs = fixture(copies)
    table = spark.createDataFrame([(i, " ".join(t), 5) for i, t in docs], "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame([(k, " ".join(t), 5) for k, t in items], "item_id long, text string, doc_id int")
    wanted = plain_leaks(items, docs)
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(table, benchmark).collect()}
    assert len(wanted) > 30 * copies
    assert found <= wanted
    assert len(found) >= 0.95 * len(wanted)
    kept = {r.doc_id for r in decontam.drop_leaks(table, benchmark).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in found}


def test_promising_parts_lose_no_passage():
    """Whatever passes the last check lies in a part that is searched."""
    items, docs = fixture(3)
    names = {w: n + 1 for n, w in enumerate(sorted({w for _, line in items for w in line}))}
    lines = [np.array([names[w] for w in line]) for _, line in items]
    share = np.random.default_rng(3).random(len(names) + 1)
    m = decontam.rarest(lines, share)
    for i, k in plain_leaks(items, docs):
        text = docs[i][1]
        ids = np.array([names.get(w, 0) for w in text])
        line = items[k][1]
        whole = decontam.common_subsequence(line, text) / len(line)
        parts = decontam.promising(ids, m)
        assert all(0 <= lo < hi <= len(ids) for _, lo, hi in parts)
        inside = [w for item, lo, hi in parts if item == k for w in text[lo:hi]]
        assert decontam.common_subsequence(line, inside) / len(line) >= min(whole, 0.6)
    half = np.array([names[w] for w in items[0][1][: len(items[0][1]) // 4]])
    assert not decontam.promising(np.concatenate((half, np.zeros(500, dtype=np.int64), half)), decontam.rarest(lines[:1], share))


def test_rarest_words_of_an_item():
    line = np.arange(1, 11)
    absent = 10 - math.ceil(0.6 * 10)
    for share, asked in (([0.9] * 5 + [0.01] * 5, 1), ([0.3] * 10, 6), ([0.0] * 10, 6)):
        m = decontam.rarest([line], np.array([0.0, *share]))
        assert m["least"].tolist() == [asked]
        held = [t for t in range(1, 11) if m["starts"][t + 1] > m["starts"][t]]
        assert len(held) == absent + asked


def test_more_items_than_dimensions(spark, monkeypatch):
    items, docs = fixture(1)
    monkeypatch.setattr(decontam, "MOST_DIMENSIONS", 5)
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(table, benchmark).collect()}
    wanted = plain_leaks(items, docs)
    assert found <= wanted and len(found) >= 0.9 * len(wanted)


def test_a_very_long_item(spark):
    rng = random.Random(12)
    line = words(3000, rng)
    rows = [(1, " ".join(words(50, rng) + line + words(50, rng))), (2, " ".join(words(3000, rng))), (3, None), (4, "")]
    found = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(8, " ".join(line))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.kind) for r in found] == [(1, 8, "copy")]


def plain_passages(texts, known, mine):
    """TF-IDF rows of all passages, each of unit length with the words outside the items."""
    rows = []
    for text in texts:
        ids = decontam.term_ids(text, known["terms"])
        for at in range(0, len(ids), decontam.WINDOW):
            part = ids[at : at + decontam.WINDOW]
            row = np.zeros(len(known["idf"]))
            np.add.at(row, part, known["idf"][part])
            rows.append(row[mine] / np.sqrt((known["idf"][part] ** 2).sum()))
    return np.array(rows)


def test_latent_space_is_that_of_all_documents(spark):
    """With as many columns as terms the randomised SVD is exact, so the space is known."""
    rng = random.Random(4)
    vocabulary = [f"t{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(9))) for k in range(6)]
    texts = [" ".join(rng.choice(vocabulary + ["x", "y"]) for _ in range(rng.randint(0, 70))) for _ in range(6000)]
    table = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    known = decontam.vocabulary(table, [t for _, t in items])
    model = decontam.fit(known, items)
    numbers = np.flatnonzero(model["local"])
    mine = numbers[np.argsort(model["local"][numbers])]
    rows = plain_passages(texts, known, mine)
    own = np.zeros((len(items), len(mine)))
    for row, (_, text) in zip(own, items, strict=True):
        np.add.at(row, model["local"][decontam.term_ids(text, known["terms"])] - 1, 1)
    own *= known["idf"][mine]
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    rank = len(items) + decontam.OVERSAMPLING // 2
    assert model["table"].shape == (len(mine) + 1, rank) and rank < len(mine)
    values, vectors = np.linalg.eigh(4000 / 6001 * rows.T @ rows + 900 * own.T @ own)
    wanted = vectors[:, np.argsort(-values)[:rank]]
    latent = model["table"][1:] / known["idf"][mine, None]
    assert np.abs(latent @ latent.T - wanted @ wanted.T).max() < 1e-3


@pytest.mark.parametrize("few", [3, 2048])
def test_pair_sums_are_those_of_all_passages(spark, monkeypatch, few):
    monkeypatch.setattr(decontam, "FREQUENT", few)
    monkeypatch.setattr(decontam, "MOST_PAIRS", 50)
    monkeypatch.setattr(decontam, "PIECE", 64)
    rng = random.Random(5)
    items, texts = [(0, "a b c d e f g"), (1, "e f g h i j")], ["", None, "x " * 300]
    texts += [" ".join(rng.choice("aabcdefghijxyz") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    known = decontam.vocabulary(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), [t for _, t in items])
    mine = np.arange(1, 11)[np.argsort(-known["share"][1:], kind="stable")]
    local = np.zeros(11, dtype=np.int64)
    local[mine] = np.arange(1, 11)
    sums = decontam._pair_sums(known["ids"], {"idf": known["idf"], "local": local, "mine": mine})
    rows = plain_passages(texts, known, mine)
    assert np.allclose(decontam._times(sums, np.eye(10)), rows.T @ rows, rtol=1e-5)
