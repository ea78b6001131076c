"""Periodic runs of words: suffix trees of a text and of its reversal, and Lyndon roots extended both ways.

Ukkonen's construction gives the tree of a text and that of the reversed text. The Euler tour of a
tree, kept as its leaves and the shallowest node between each two neighbours, answers by range minima
how far two places agree, forwards or backwards, in constant time. Each run holds the longest Lyndon
word at one of its places, in the order of the words or in the reversed one. Leaf order gives those
words as the way to the next smaller, or greater, suffix; each is extended in both directions as long
as its period holds.

Trees are made for stretches that can hold runs only. In a run of period q and at least max(6, 4q)
words, each five words in a row stand again q words before or after, within the run. So a place
without five words around it that stand twice, at a distance of at most a quarter of the stretch of
such places, lies in no run; that is repeated until nothing more falls away. A stretch ends where no
run goes on, so its runs are the text's.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A run has at least so many words, and so many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Words in a row that a run of that size repeats (:func:`stretches`).
WINDOW = 5
#: Bytes of text that are handled before their results go on.
BATCH_BYTES = 4 << 20

RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal ones."""
    ids: dict[bytes, int] = {}
    return np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)


def stretches(x: np.ndarray) -> list[tuple[int, int]]:
    """First and last place + 1 of the parts of a text outside which there are no runs."""
    n = len(x) - WINDOW + 1
    if n < 2:
        return []
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):  # equal windows stay equal; others that fall together do no harm
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + x[k : k + n].astype(np.uint64)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return []
    far = np.iinfo(np.int64).max // LEAST_PERIODS
    gaps = np.where(same, np.diff(order), far)
    nearest = np.full(n, far)
    nearest[order[1:]] = gaps
    nearest[order[:-1]] = np.minimum(nearest[order[:-1]], gaps)
    at = np.flatnonzero(nearest < far)
    while len(at):
        # Windows that touch or overlap make a stretch.
        first = np.concatenate(([True], np.diff(at) > WINDOW))
        part = np.cumsum(first) - 1
        lo = at[first]
        hi = np.concatenate((at[np.flatnonzero(first)[1:] - 1], at[-1:])) + WINDOW
        kept = LEAST_PERIODS * nearest[at] <= (hi - lo)[part]
        if kept.all():
            return [(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if b - a >= LEAST_WORDS]
        at = at[kept]
    return []


class SuffixTree:
    """Ukkonen's suffix tree of a list of numbers, asked for leaf order and common beginnings."""

    def __init__(self, x: np.ndarray) -> None:
        n = self.n = len(x)
        text = np.unique(x, return_inverse=True)[1].tolist()
        base = max(text, default=0) + 2
        # The end mark comes before all words.
        text = [t + 1 for t in text] + [0]
        child, start, end = self._built(text, base)
        self._toured(child, start, end, base)

    @staticmethod
    def _built(text: list[int], base: int) -> tuple[dict[int, int], list[int], list[int]]:
        """Nodes by (parent, first symbol), and the part of the text at the edge to each node."""
        child: dict[int, int] = {}
        start, end, link = [0], [0], [0]
        last = len(text)
        node = edge = length = waiting = 0
        for i, symbol in enumerate(text):
            waiting += 1
            new = 0  # the inner node made last, whose link is open
            while waiting:
                if not length:
                    edge = i
                key = node * base + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i)
                    end.append(last)
                    link.append(0)
                    if new:
                        link[new] = node
                        new = 0
                else:
                    begin = start[below]
                    size = end[below] - begin
                    if length >= size:
                        edge += size
                        length -= size
                        node = below
                        continue
                    if text[begin + length] == symbol:
                        length += 1
                        if new:
                            link[new] = node
                        break
                    middle = len(start)
                    child[key] = middle
                    start += (begin, i)
                    end += (begin + length, last)
                    link += (0, 0)
                    child[middle * base + symbol] = middle + 1
                    child[middle * base + text[begin + length]] = below
                    start[below] = begin + length
                    if new:
                        link[new] = middle
                    new = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        return child, start, end

    def _toured(self, child: dict[int, int], start: list[int], end: list[int], base: int) -> None:
        """Leaves in the order of the tour, and the depth of the shallowest node between neighbours."""
        nodes = len(start)
        keys = np.fromiter(child.keys(), dtype=np.int64, count=len(child))
        below = np.fromiter(child.values(), dtype=np.int64, count=len(child))
        child.clear()
        order = np.argsort(keys)
        parents, kids = keys[order] // base, below[order]
        parent = np.zeros(nodes, dtype=np.int64)
        parent[kids] = parents
        opens = np.concatenate(([True], parents[1:] != parents[:-1]))  # first children
        depth = np.array(end, dtype=np.int64) - np.array(start, dtype=np.int64)
        depth[0] = 0
        top = np.arange(nodes)
        top[kids[opens]] = parents[opens]  # a first child is reached without leaving its parent
        up = parent.copy()
        while up.any():  # by doubling, so that deep trees take few rounds
            depth += depth[up]
            up = up[up]
        while not np.array_equal(top, top[top]):
            top = top[top]
        # Children of a node in a row, the last one first, as a stack takes them.
        line = kids[::-1].tolist()
        at = len(line) - np.searchsorted(parents, np.arange(nodes), side="right")
        to = len(line) - np.searchsorted(parents, np.arange(nodes), side="left")
        at, to = at.tolist(), to.tolist()
        leaves: list[int] = []
        stack = [0]
        while stack:
            v = stack.pop()
            if at[v] == to[v]:
                leaves.append(v)
            else:
                stack += line[at[v] : to[v]]
        found = np.array(leaves, dtype=np.int64)
        self.suffixes = self.n + 1 - depth[found]
        self.rank = np.empty(self.n + 1, dtype=np.int64)
        self.rank[self.suffixes] = np.arange(self.n + 1)
        # Row k holds the minima of 2 ** k depths in a row.
        self.minima = [depth[parent[top[found]]].astype(np.int32)]
        while 2 << len(self.minima) <= 2 * self.n + 2:
            m, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(m[:-half], m[half:]) if len(m) > half else m)

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers from places ``a`` on are those from places ``b`` on; ``a`` and ``b`` differ."""
        lo, hi = np.minimum(self.rank[a], self.rank[b]) + 1, np.maximum(self.rank[a], self.rank[b]) + 1
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), dtype=np.int64)
        for k in np.unique(level).tolist():
            mine = level == k
            out[mine] = np.minimum(self.minima[k][lo[mine]], self.minima[k][hi[mine] - (1 << k)])
        return out


def _next(rank: list[int], smaller: bool) -> list[int]:
    """For each place the next one of smaller, or greater, rank; -1: there is none."""
    out = [-1] * len(rank)
    open_: list[int] = []
    for i, r in enumerate(rank):
        while open_ and (rank[open_[-1]] > r if smaller else rank[open_[-1]] < r):
            out[open_.pop()] = i
        open_.append(i)
    return out


def runs_of(x: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs in a list of numbers, by start, then period."""
    n = len(x)
    forward = SuffixTree(x)
    rank = forward.rank.tolist()
    start = np.tile(np.arange(n), 2)
    period = np.concatenate((_next(rank, True)[:n], _next(rank, False)[:n])) - start
    fits = (period > 0) & (LEAST_PERIODS * period <= n)
    start, period = start[fits], period[fits]
    after = forward.agree(start, start + period)
    del forward
    # A root alone has one period; what agrees after it and before it makes the rest.
    before = np.zeros(len(start), dtype=np.int64)
    inner = start > 0
    before[inner] = SuffixTree(x[::-1]).agree(n - start[inner], n - start[inner] - period[inner])
    length = before + period + after
    fits = (length >= LEAST_WORDS) & (length >= LEAST_PERIODS * period)
    found = np.stack((start - before, length, period), axis=1)[fits]
    return np.unique(found[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def text_runs(words: list[bytes]) -> np.ndarray:
    """(start, length, period) of all runs in a text, by start, then period."""
    x = numbered(words)
    found = [runs_of(x[a:b]) + np.array([a, 0, 0]) for a, b in stretches(x)]
    return np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words outside runs and in a run's first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(inside, runs[:, 0] + runs[:, 2], 1)
    np.add.at(inside, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(inside[:-1]) == 0).tolist()])


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words of a tenth of the documents, told by their id, with a tail made periodic; a null id keeps its words."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


def periodic_runs(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row: its runs, and its text without their repetitions.

    Words are runs of letters other than the six ASCII white-space characters; equal words have equal
    bytes. A run is a stretch of smallest period q and at least max(6, 4q) words that neither
    neighbour continues; ``runs`` lists all by start, then period. ``collapsed`` holds the words that
    are in no run after its first q words. ``edit`` changes a row's words first. Every row stays,
    repeated ones and those with a null id too; a null or empty text has no words, no runs and an
    empty ``collapsed``. A text of any length is handled whole, in memory in proportion to its
    stretches with repeats (some 600 bytes a word). An empty table gives an empty result; other
    columns are ignored. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        names = ["doc_id", "n_words", "runs", "collapsed"]

        def made() -> pa.RecordBatch:
            ids, counts, found, texts = zip(*out, strict=True) if out else ((),) * 4
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), _lists(found), pa.array(texts, pa.binary()).cast(pa.string())], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                doc_id, words = doc_id.as_py(), (text.as_py() or b"").split()
                words = edit(doc_id, words) if edit else words
                found = text_runs(words)
                out.append((doc_id, len(words), found, collapsed(words, found)))
                size += len(out[-1][3]) + 64
                if size >= BATCH_BYTES:
                    yield made()
                    out, size = [], 0
        yield made()

    return docs.select("doc_id", "text").mapInArrow(run, RUNS)


def _lists(found: tuple[np.ndarray, ...]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(f) for f in found], dtype=np.int64))).astype(np.int32)
    flat = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
    parts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(offsets), parts).cast(_RUN_TYPE)
