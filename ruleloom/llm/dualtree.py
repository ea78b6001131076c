"""Ranked lexical search by a dual tree: hierarchies over items and over documents, pruned in pairs.

An item is a vector of term weights, a document one of saturated term frequencies; a score is their
product, in whole numbers. Inner nodes of both hierarchies hold the greatest value below them in each
coordinate, so the product of two nodes bounds the scores of all their items with all their documents.
Where it stays below the weakest k-th score of the node's items, the whole batch is passed over;
nothing that can be among an item's best is. Single items meeting single documents get exact scores.

Documents are searched where they lie: each task makes the tree of some thousand of them at a time
and keeps an item's best so far. Items come in blocks of bounded size, broadcast one after the other.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.common import staged

BEST = 20
#: Texts of so many bytes are searched together; a longer one by itself.
BLOCK_BYTES = 1 << 20
#: Children of a node, of items and of documents.
ITEM_FANOUT, DOC_FANOUT = 8, 16
#: Documents of one tree, and values of its lowest level.
TREE_DOCS, TREE_VALUES = 2048, 2 << 20
#: Documents that a task searches, about.
TASK_DOCS = 50_000
#: Documents, about, whose best scores open the search; more open it no better than they must.
OPENING_DOCS = 20_000

_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_COUNTS = "doc_id long, n long, terms array<int>, counts array<long>"
_FOUND = "text_no long, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all that is not ASCII; only A-Z are lower-cased."""
    return (text or b"").translate(_TERM).split()


@dataclass
class Node:
    """A node over items: the terms they hold, the greatest weight of each, and the nodes below; a leaf is one item."""

    terms: np.ndarray
    weights: np.ndarray
    items: np.ndarray
    below: list[Node]


def item_tree(vectors: list[tuple[np.ndarray, np.ndarray]]) -> Node:
    """The hierarchy over items given as (terms, weights), those whose heaviest terms agree side by side."""
    heaviest = [tuple(t[np.lexsort((t, -w))][:3].tolist()) for t, w in vectors]
    level = [Node(*vectors[i], np.array([i]), []) for i in sorted(range(len(vectors)), key=heaviest.__getitem__)]
    while len(level) > 1:
        level = [_over(level[at : at + ITEM_FANOUT]) for at in range(0, len(level), ITEM_FANOUT)]
    return level[0]


def _over(nodes: list[Node]) -> Node:
    terms, place = np.unique(np.concatenate([n.terms for n in nodes]), return_inverse=True)
    weights = np.zeros(len(terms))
    np.maximum.at(weights, place, np.concatenate([n.weights for n in nodes]))
    return Node(terms, weights, np.concatenate([n.items for n in nodes]), nodes)


def doc_tree(docs: np.ndarray) -> list[np.ndarray]:
    """Levels of the hierarchy over documents, the documents (one in each row) first."""
    levels = [docs]
    while len(levels[-1]) > DOC_FANOUT:
        levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), DOC_FANOUT), axis=0))
    return levels


class Best:
    """The best documents of each item so far, equal scores by id, null ids last."""

    def __init__(self, opening: np.ndarray, k: int) -> None:
        self.k = k
        #: No score below it is among an item's best.
        self.least = np.maximum(opening, 1).astype(np.float64)
        self.scores = [np.zeros(0, np.int64) for _ in opening]
        self.ids = [np.zeros((2, 0), np.int64) for _ in opening]

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores[item], scores)), np.concatenate((self.ids[item], ids), axis=1)
        order = np.lexsort((ids[0], ids[1], -scores))[: self.k]
        self.scores[item], self.ids[item] = scores[order], ids[:, order]
        if len(order) == self.k:
            self.least[item] = max(self.least[item], scores[order[-1]])


def search(root: Node, levels: list[np.ndarray], ids: np.ndarray, best: Best) -> None:
    """Meet all items with the documents of a tree. ``ids`` holds their ids and whether these are null."""
    todo = [(root, len(levels) - 1, np.arange(len(levels[-1])))]
    while todo:
        node, level, rows = todo.pop()
        # Whole numbers below 2 ** 53: exact.
        bound = levels[level][np.ix_(rows, node.terms)].astype(np.float64) @ node.weights
        alive = bound >= best.least[node.items].min()
        rows = rows[alive]
        if not len(rows):
            continue
        if not node.below and not level:
            best.add(int(node.items[0]), bound[alive].astype(np.int64), ids[:, rows])
            continue
        if level:
            level -= 1
            rows = (rows[:, None] * DOC_FANOUT + np.arange(DOC_FANOUT)).ravel()
            rows = rows[rows < len(levels[level])]
        todo += [(n, level, rows) for n in node.below or [node]]


def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Number of terms of each row, and the vocabulary's terms in it with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes, terms, counts, ends = [], [], [], [0]
                for text in part.column(1).cast(pa.binary()):
                    found = terms_of(text.as_py())
                    held = Counter(filter(None, map(number.get, found)))
                    sizes.append(len(found))
                    terms += held.keys()
                    counts += held.values()
                    ends.append(len(terms))
                offsets = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((terms, pa.int32()), (counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, _COUNTS)


def _saturated(n: np.ndarray, count: np.ndarray, rows: int, total: int) -> np.ndarray:
    """A term's part in the score, without its weight, from the document's number of terms and its count."""
    m = 100 - 25 + (25 * n * rows) // total
    return (1_000_000_000 * count) // (1000 * count + 12 * m)


def _found(counted: DataFrame, model: dict, k: int) -> DataFrame:
    """(text_no, doc_id, score) of all that can be among an item's best: a task's best, none below the opening scores."""
    shared = counted.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        root, size = item_tree(m["vectors"]), m["size"]
        best = Best(m["opening"], k)
        width = max(DOC_FANOUT, min(TREE_DOCS, TREE_VALUES // size))
        for batch in batches:
            for at in range(0, batch.num_rows, width):
                part = batch.slice(at, width)
                ids = part.column(0)
                keys = np.stack((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)))
                held = pc.list_value_length(part.column(2)).to_numpy()
                row = np.repeat(np.arange(part.num_rows), held)
                terms, counts = (part.column(c).flatten().to_numpy() for c in (2, 3))
                value = _saturated(part.column(1).to_numpy()[row], counts, m["rows"], m["total"])
                # Documents with the same weightiest term lie side by side.
                order = np.lexsort((-(value * m["weight"][terms]), row))
                first = np.zeros(part.num_rows, dtype=np.int64)
                starts = np.concatenate(([0], np.cumsum(held)))[:-1]
                some = held > 0
                first[some] = terms[order][starts[some]]
                by_first = np.argsort(first[some], kind="stable")
                rows = np.flatnonzero(some)[by_first]
                place = np.empty(part.num_rows, dtype=np.int64)
                place[rows] = np.arange(len(rows))
                docs = np.zeros((len(rows), size), dtype=np.float32)  # values are below 10 ** 6: exact
                docs[place[row], terms] = value
                if len(rows):
                    search(root, doc_tree(docs), keys[:, rows], best)
        texts = np.repeat(m["texts"], [len(s) for s in best.scores])
        all_ids, all_scores = np.concatenate(best.ids, axis=1), np.concatenate(best.scores)
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.int64()), pa.array(all_ids[0], mask=all_ids[1] > 0), pa.array(all_scores)], names=["text_no", "doc_id", "score"])

    return counted.where(F.size("terms") > 0).mapInArrow(run, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("text_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searched(docs: DataFrame, texts: list[tuple[int, str]], k: int) -> DataFrame | None:
    """(text_no, doc_id, score, rank) for one block of item texts."""
    lines = [(no, Counter(terms_of(text.encode()))) for no, text in texts]
    lines = [(no, line) for no, line in lines if line]
    vocabulary = {t: i + 1 for i, t in enumerate(sorted({t for _, line in lines for t in line}))}
    counted = staged(_counted(docs, vocabulary)) if lines else None
    rows, total = counted.where("n > 0").agg(F.count("*"), F.sum("n")).first() if lines else (0, 0)
    if not rows:
        return None
    weight = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    weight[1:] = math.floor(1000 * math.log(2 * rows + 2))
    for term, df in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # the block's terms
        weight[term] = math.floor(1000 * math.log((2 * rows + 2) / (2 * df + 1)))
    vectors = []
    for _, line in lines:
        terms = np.array([vocabulary[t] for t in line])
        vectors.append((terms, np.array(list(line.values())) * weight[terms].astype(np.float64)))
        if vectors[-1][1].sum() * 1_000_000 >= 2**53:
            raise ValueError("an item is too long for exact scores")
    model = {"vectors": vectors, "texts": np.array([no for no, _ in lines]), "weight": weight, "size": len(weight), "rows": rows, "total": total}
    model["opening"] = np.zeros(len(lines), dtype=np.int64)
    # The k-th score among some documents is a lower bound of the k-th among all.
    place = F.pmod(F.xxhash64("doc_id", "n", F.lit("opening")), F.lit(1_000_000)) / 1_000_000
    some = _ranked(_found(counted.where(place < min(1.0, OPENING_DOCS / rows)).coalesce(8), model, k), k)
    opening = {r["text_no"]: r["score"] for r in some.where(F.col("rank") == k).select("text_no", "score").collect()}
    model["opening"] = np.array([opening.get(no, 0) for no, _ in lines])
    # The counts are small and the search is not: more tasks than their files would give.
    tasks = max(4 * counted.sparkSession.sparkContext.defaultParallelism, rows // TASK_DOCS)
    return _ranked(_found(counted.where(F.size("terms") > 0).repartition(tasks), model, k), k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents with a score above 0 of each item.

    Terms are the maximal runs of ASCII letters, digits and letters beyond ASCII. Of N documents with
    a term, a term in df of them weighs w = floor(1000 * ln((2N + 2) / (2 df + 1))). With n terms in
    the document, L in all, m = 75 + (25 n N) div L. The score sums w * ((10 ** 9 tf) div (1000 tf +
    12 m)) over the item's terms, repeats included; equal scores rank by ascending doc_id, null ids
    last. Each row of ``items`` gets a list of its own, repeated ones and null ids too; one with a
    null text, or without a term, gets none. Each row of ``docs`` is a document; null texts have no
    terms. Empty tables give an empty result; other columns are ignored.
    """
    texts = items.select("text").where("text is not null").distinct().select(F.monotonically_increasing_id().alias("text_no"), "text")
    texts = staged(texts)  # gives the numbers for good
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    found = docs.sparkSession.createDataFrame([], _FOUND + ", rank int")
    for b in range(blocks):
        mine = texts.where(F.pmod(F.xxhash64("text_no"), F.lit(blocks)) == b).orderBy("text_no").collect()
        part = _searched(docs, [(r["text_no"], r["text"]) for r in mine], k)
        found = found if part is None else found.unionByName(part)
    asked = items.select("item_id", "text").join(texts, "text")
    return asked.join(found, "text_no").select("item_id", "rank", "doc_id", "score")
