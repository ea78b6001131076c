"""A chunk of any size is rows, row groups and lists of bounded size, with the same scores."""

import collections
import random

import pyarrow.parquet as pq
import pytest

from ruleloom.llm import common, lattice


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(1, 40)))) for i in range(400)]
    return spark.createDataFrame([*rows, rows[0], (900, None), (901, " ")], "doc_id long, text string").repartition(2, "doc_id")


def scores(docs):
    return collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lattice.lattice_scores(docs, rounds=1).collect())


def test_small_rows_give_the_same_scores(docs, monkeypatch):
    want = scores(docs)
    for name, n in (("ROW_WORDS", 7), ("ROW_ENTRIES", 20), ("GATHERED", 11)):
        monkeypatch.setattr(lattice, name, n)
    assert scores(docs) == want
    rows = lattice._chunks(docs, 1).collect()
    assert max(len(r.words) for r in rows) == 7
    assert max(len(r.word_at) for r in rows) < 20 + 40  # a row ends with the text that fills it
    assert sum(len(r.doc_ids) for r in rows) == 403 and len({r.chunk for r in rows}) == 2


def test_row_groups_end_by_size_not_after_a_hundred_rows(docs, monkeypatch):
    monkeypatch.setattr(lattice, "CHUNK_DOCS", 1)
    monkeypatch.setitem(lattice.ROW_GROUPS, "parquet.block.size", 8192)
    n = lattice._chunks(docs, 1).count()
    folder = common._STAGED[-1].removeprefix("file:")
    files = [pq.ParquetFile(f).metadata for f in pq.ParquetDataset(folder).files]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(groups) == n > 400 and max(groups) < 60
