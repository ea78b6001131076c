"""Benchmark decontamination by latent semantic retrieval, verified word by word.

The terms are the benchmark's words, weighted by their document frequency in the whole corpus. A
randomised SVD of the TF-IDF passages of all documents and of the items themselves gives one latent
space for all items. The passages enter it by the sums of the products of their terms' values, a table
of pairs of terms that one pass makes; the corpus weighs the same beside the items at any size.
Passages of every document are searched in the space: windows whose benchmark terms hold too little of their weight for the cosine asked are passed
over, the others are projected and compared with all items. Words outside the benchmark weigh as the
words of the item with the lightest words, at any size of the table. Candidates are then
checked by the longest common subsequence of words, and for paraphrases by the item's answer too.

Only passages that can pass the last check are projected, and for the items that they can pass. One
that holds 0.6 of an item's L words in order lacks at most 0.4 L of them, so of its 0.4 L + r rarest
words it has r, within four times its length, for any r. Items that have too few of them in the whole
text, and then in a part of it, lose nothing. Document frequencies tell which words are rare and which
r chance reaches least. Texts are turned into term numbers once; all later passes read those.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import staged

#: Windows of both widths start at each step; the smaller ones are for short items. In words.
STEP = 8
WINDOW = 32
WIDTHS = (16, WINDOW)
#: Items searched together, in one latent space of at most so many dimensions; more items go in further passes.
BLOCK_ITEMS = 4096
MOST_DIMENSIONS = 512
OVERSAMPLING = 32
#: All documents weigh together as so many single ones, beside items of ITEM_WEIGHT.
CORPUS_WEIGHT = 4000.0
ITEM_WEIGHT = 30.0
#: Words of passages taken at once; pairs of so many terms, the most frequent ones, are summed in place.
PIECE = 1 << 16
FREQUENT = 2048
#: Other pairs kept by a task before it passes their sums on.
MOST_PAIRS = 1 << 20
#: Cells of a block of rows of the table of pairs, when it is multiplied.
BLOCK_CELLS = 1 << 22
COSINE = 0.5
#: Share of an item's words found in order: alone, or with as great a share of its answer.
COPIED = 0.8
PARAPHRASED = 0.6
ANSWER_WORDS = 8
#: Item lengths in which an item's words may be spread.
STRETCH = 4

#: Up to so many ids of documents with leaks are broadcast to drop them; beyond it by one exchange of the texts.
BROADCAST_IDS = 500_000
_WORD = re.compile(r"\w+")
PAIRS = "doc_id long, item_id long, cosine double, lcs double, answer double, kind string"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def term_ids(text: str | None, terms: dict[str, int]) -> np.ndarray:
    """Term numbers of all words of a text, in order; 0: no term."""
    return np.fromiter(map(terms.get, words_of(text), repeat(0)), dtype=np.int32)


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, one big-integer step for each word of ``b``."""
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    all_ones = (1 << len(a)) - 1
    v = all_ones
    for w in b:
        u = v & places.get(w, 0)
        v = ((v + u) | (v - u)) & all_ones
    return len(a) - v.bit_count()


def numbered(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """(doc_id, ids): the term numbers of each row's words, as bytes of :func:`_number_type`."""
    kind = _number_type(len(terms))
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = pa.array([term_ids(t, known).astype(kind).tobytes() for t in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def _number_type(size: int) -> np.dtype:
    """The smallest type that holds the numbers of ``size`` terms."""
    return np.min_scalar_type(size)


def _lists(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The term numbers of each row."""
    kind = _number_type(size)
    return (np.frombuffer(x.as_buffer(), dtype=kind).astype(np.int64) for x in column)


def _document_frequency(rows: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """Number of rows of :func:`numbered`, and of those that hold each of ``size`` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            n += batch.num_rows
            for ids in _lists(batch.column(0), size):
                seen[np.unique(ids)] += 1
        seen[0] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen)), pa.array(seen[seen > 0])], names=["term", "n"])

    total = np.zeros(size + 1, dtype=np.int64)
    for r in rows.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        total[r["term"]] = r["n"]
    return int(total[0]), total


def _pieces(column: pa.Array, size: int) -> Iterator[list[np.ndarray]]:
    """Term numbers of a few rows, or of whole passages of a long one."""
    piece: list[np.ndarray] = []
    words = 0
    for ids in _lists(column, size):
        for at in range(0, len(ids), PIECE):
            piece.append(ids[at : at + PIECE])
            words += len(piece[-1])
            if words >= PIECE:
                yield piece
                piece, words = [], 0
    if piece:
        yield piece


def _passage_pairs(piece: list[np.ndarray], m: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, col, product of values) of all pairs row <= col of the block's terms in a TF-IDF passage, each passage of unit length."""
    sizes = np.array([len(ids) for ids in piece])
    ids = np.concatenate(piece)
    passages = -(-sizes // WINDOW)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    passage = np.repeat(np.cumsum(passages) - passages, sizes) + place // WINDOW
    length = np.sqrt(np.bincount(passage, m["idf"][ids] ** 2))
    term, terms = m["local"][ids], len(m["mine"])
    held = term > 0
    codes, n = np.unique(passage[held] * terms + term[held] - 1, return_counts=True)
    passage, term = np.divmod(codes, terms)
    value = n * m["idf"][m["mine"]][term] / length[passage]
    counts = np.bincount(passage)
    starts = np.cumsum(counts) - counts
    for k in np.unique(counts[counts > 0]):
        at = starts[counts == k] + np.arange(k)[:, None]
        row, col = np.triu_indices(k)
        t, v = term[at], value[at]
        yield t[row].ravel(), t[col].ravel(), (v[row] * v[col]).ravel()


def _pair_sums(rows: DataFrame, model: dict) -> DataFrame:
    """(row, col, value): the matrix A^T A of the TF-IDF passages A of all rows of :func:`numbered`, where it is not zero."""
    shared = rows.sparkSession.sparkContext.broadcast({k: model[k] for k in ("idf", "local", "mine")})

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, values = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(codes)
        codes = codes[order]
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        return codes[first], np.add.reduceat(values[order], first) if len(first) else values

    def batch_of(codes: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(values)], names=["code", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        terms = len(m["mine"])
        few = min(FREQUENT, terms)
        often = np.zeros(few * few)
        raw: list[tuple[np.ndarray, np.ndarray]] = []
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for piece in _pieces(batch.column(0), len(m["idf"]) - 1):
                for row, col, value in _passage_pairs(piece, m):
                    inside = col < few
                    np.add.at(often, row[inside] * few + col[inside], value[inside])
                    raw.append((row[~inside] * terms + col[~inside], value[~inside]))
                if sum(len(c) for c, _ in raw) >= MOST_PAIRS:
                    done, raw = [summed(done + raw)], []
                    if len(done[0][0]) >= MOST_PAIRS:
                        yield batch_of(*done.pop())
        if raw:
            yield batch_of(*summed(done + raw))
        elif done:
            yield batch_of(*done[0])
        held = np.flatnonzero(often)
        yield batch_of(held // few * terms + held % few, often[held])

    # A task passes on each pair that it met once, so fewer and longer tasks pass on less.
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions() // 3)
    parts = rows.select("ids").coalesce(tasks).mapInArrow(run, "code long, value double")
    half = staged(parts.groupBy("code").agg(F.sum("value").alias("value")))
    terms = len(model["mine"])
    half = half.selectExpr(f"code div {terms} AS row", f"code % {terms} AS col", "value")
    return half.unionByName(half.where("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), "value"))


def _times(sums: DataFrame, right: np.ndarray) -> np.ndarray:
    """A^T A R, for the matrix A^T A of :func:`_pair_sums`; each group has some of its rows."""
    shared = sums.sparkSession.sparkContext.broadcast(right.astype(np.float32))
    blocks = -(-len(right) // max(1, min(256, BLOCK_CELLS // len(right))))

    def run(group: pa.Table) -> pa.Table:
        r = shared.value
        block = group.column("block")[0].as_py()
        dense = np.zeros((len(range(block, len(r), blocks)), len(r)), dtype=np.float32)
        dense[group.column("row").to_numpy() // blocks, group.column("col").to_numpy()] = group.column("value").to_numpy()
        return pa.table({"block": pa.array([block], pa.int64()), "data": pa.array([(dense @ r).tobytes()], pa.binary())})

    out = np.zeros(right.shape)
    dealt = sums.withColumn("block", F.pmod("row", F.lit(blocks))).groupBy("block")
    for r in dealt.applyInArrow(run, "block long, data binary").collect():
        out[r["block"] :: blocks] = np.frombuffer(r["data"], dtype=np.float32).reshape(-1, right.shape[1])
    return out


def weights(rows: int, seen: np.ndarray, lines: Iterable[list[int]]) -> np.ndarray:
    """Weight of each term by the rows that hold it; at 0, of the words outside the benchmark.

    These weigh as the words of the item (``lines``: its terms) whose words are lightest, in root
    mean square: a window half of whose words are an item's passes, whatever else it holds.
    """
    idf = np.maximum(np.log((rows + 1) / (seen + 0.5)), 0.05)
    idf[0] = min((math.sqrt(np.mean(idf[line] ** 2)) for line in lines), default=0.05)
    return idf


def vocabulary(docs: DataFrame, texts: list[str]) -> dict:
    """Terms of all items, of whatever block, their weights, the number of rows, and the rows' term numbers."""
    lines = [words_of(t) for t in texts]
    terms = {w: i + 1 for i, w in enumerate(sorted({w for line in lines for w in line}))}
    ids = staged(numbered(docs, terms))
    rows, seen = _document_frequency(ids, len(terms))
    share = np.minimum(seen / max(rows, 1), 1.0)
    idf = weights(rows, seen, ([terms[w] for w in line] for line in lines if line))
    return {"terms": terms, "ids": ids, "rows": rows, "share": share, "idf": idf}


class ItemRows:
    """Unit vectors of the items over the block's terms, never more than some of them at a time."""

    def __init__(self, lines: list[np.ndarray], weight: np.ndarray) -> None:
        self.lines, self.weight = lines, weight

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        for at in range(0, len(self.lines), 256):
            rows = np.zeros((len(self.lines[at : at + 256]), len(self.weight)))
            for row, line in zip(rows, self.lines[at : at + 256], strict=True):
                np.add.at(row, line, self.weight[line])
            yield at, rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

    def times(self, right: np.ndarray) -> np.ndarray:
        return np.vstack([rows @ right for _, rows in self.parts()])

    def transposed_times(self, right: np.ndarray) -> np.ndarray:
        return sum(rows.T @ right[at : at + len(rows)] for at, rows in self.parts())


def rarest(lines: list[np.ndarray], share: np.ndarray) -> dict:
    """For each item its rarest words' terms and how many words of these a passage must hold.

    ``share`` tells which part of the documents holds each term. With ``absent`` the most words that
    an accepted passage lacks, any ``r`` of the ``absent + r`` rarest words may be asked for; taken is
    the ``r`` that words meeting by chance reach least (Chernoff's bound of a Poisson sum). ``rare_items``
    has the items of each term, and ``rare_counts`` how often it is among their rarest words, at
    ``starts[term]`` to ``starts[term + 1]``.
    """
    least = np.zeros(len(lines), dtype=np.int64)
    counts: dict[tuple[int, int], int] = {}
    for k, line in enumerate(lines):
        absent = len(line) - math.ceil(PARAPHRASED * len(line) - 1e-9)
        order = np.lexsort((line, share[line]))
        asked = np.arange(1, len(line) - absent + 1)
        chance = np.cumsum(share[line][order])[absent:] + 1e-9
        bound = np.where(asked > chance, asked - chance - asked * np.log(asked / chance), 0.0)
        least[k] = asked[np.argmin(bound)]
        for t in line[order[: absent + least[k]]].tolist():
            counts[t, k] = counts.get((t, k), 0) + 1
    rare = np.array([(t, k, n) for (t, k), n in sorted(counts.items())], dtype=np.int64).reshape(-1, 3)
    sizes = np.array([len(line) for line in lines], dtype=np.int64)
    starts = np.searchsorted(rare[:, 0], np.arange(len(share) + 1))
    return {"sizes": sizes, "least": least, "starts": starts, "rare_items": rare[:, 1], "rare_counts": rare[:, 2]}


def fit(known: dict, items: list[tuple[int, str]]) -> dict:
    """Latent space of a block of items: terms, their weights and latent vectors, the items' vectors.

    ``known`` is the :func:`vocabulary` of all blocks; ``local`` gives the block's own number of each term,
    frequent terms first, and ``mine`` the term of each such number.
    """
    lines = [words_of(t) for _, t in items]
    terms, idf, rows = known["terms"], known["idf"], known["rows"]
    numbers = [np.array([terms[w] for w in line]) for line in lines]
    mine = np.unique(np.concatenate(numbers))
    mine = mine[np.argsort(-known["share"][mine], kind="stable")]
    local = np.zeros(len(terms) + 1, dtype=np.int64)
    local[mine] = np.arange(1, len(mine) + 1)
    model = {"idf": idf, "local": local, "mine": mine, "items": [i for i, _ in items], "lines": [n.tolist() for n in numbers]} | rarest(numbers, known["share"])
    own = ItemRows([local[n] - 1 for n in numbers], idf[mine])
    rank = min(len(mine), len(items) + OVERSAMPLING // 2, MOST_DIMENSIONS)
    width = min(len(mine), rank + OVERSAMPLING // 2)
    sums = _pair_sums(known["ids"], model)
    start = np.random.default_rng(7).standard_normal((len(mine), width))
    strong = ITEM_WEIGHT**2
    weight = min(1.0, CORPUS_WEIGHT / max(rows, 1))
    spread = weight * _times(sums, start) + strong * own.transposed_times(own.times(start))
    basis, _ = np.linalg.qr(spread)
    inner = own.times(basis)
    values, vectors = np.linalg.eigh(weight * (basis.T @ _times(sums, basis)) + strong * (inner.T @ inner))
    latent = basis @ vectors[:, np.argsort(-values)[:rank]]
    vectors = own.times(latent)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    # Row 0 is for words outside the block, which have no latent part.
    table = np.vstack([np.zeros((1, rank)), latent * idf[mine, None]])
    return model | {"table": table.astype(np.float32), "vectors": vectors.astype(np.float32)}


def _expanded(ids: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray]:
    """For each place of ``ids`` and each item that has its term among its rarest: the place, and the place in the items' table."""
    held = m["starts"][ids + 1] - m["starts"][ids]
    places = np.repeat(np.arange(len(ids)), held)
    return places, np.arange(len(places)) - np.repeat(np.cumsum(held) - held, held) + np.repeat(m["starts"][ids], held)


def promising(ids: np.ndarray, m: dict) -> list[tuple[int, int, int]]:
    """(item, first, last) word of the parts of a text in which an item has enough of its rarest words.

    A term counts as often as the item has it, wherever it stands once, in the whole text and then in
    spans of twice the longest passage, of which each begins in the middle of the one before. Parts
    are widened by a passage and a window, so that every window from which the passage is reached lies
    in one; those of an item that touch are one.
    """
    _, at = _expanded(np.unique(ids), m)
    items = np.flatnonzero(np.bincount(m["rare_items"][at], m["rare_counts"][at], len(m["least"])) >= m["least"])
    if not len(items):
        return []
    wanted = np.zeros(len(m["least"]), dtype=bool)
    wanted[items] = True
    places, at = _expanded(ids, m)
    mine = wanted[m["rare_items"][at]]
    places, at = places[mine], at[mine]
    most = STRETCH * m["sizes"][m["rare_items"][at]]
    spans = 2 + len(ids) // int(most.min())
    span = places // most
    both = np.concatenate((at * spans + span + 1, at * spans + span))  # the span that begins here, and the one before
    both = np.unique(both)
    key, counts = m["rare_items"][both // spans] * spans + both % spans, m["rare_counts"][both // spans]
    keys, group = np.unique(key, return_inverse=True)
    enough = np.bincount(group, counts) >= m["least"][keys // spans]
    out: list[tuple[int, int, int]] = []
    for k, b in zip((keys[enough] // spans).tolist(), (keys[enough] % spans).tolist(), strict=True):
        size = STRETCH * int(m["sizes"][k])
        lo, hi = max(0, (b - 2) * size - WINDOW) // STEP * STEP, min((b + 2) * size + WINDOW, len(ids))
        if out and out[-1][0] == k and lo <= out[-1][2]:
            out[-1] = (k, out[-1][1], hi)
        else:
            out.append((k, lo, hi))
    return out


def _candidates(ids: np.ndarray, m: dict, least: float) -> dict[int, list[tuple[int, int, float]]]:
    """Items that windows of a text are near to: first and last word of each such window, its cosine."""
    found: dict[int, list[tuple[int, int, float]]] = {}
    parts = promising(ids, m)
    if not parts:
        return found
    squares = m["squares"][ids]
    full = np.concatenate(([0.0], np.cumsum(squares)))
    mine = np.concatenate(([0.0], np.cumsum(np.where(ids > 0, squares, 0.0))))
    padded = np.concatenate((m["local"][ids], np.zeros(2 * WINDOW, dtype=np.int64)))
    pieces = ((k, at, min(hi, at + 1024 * STEP)) for k, lo, hi in parts for at in range(lo, hi, 1024 * STEP))
    for k, at, to in pieces:
        # Latent sums of each step's words, of which the windows of both widths are made.
        part = padded[at : to + WINDOW + STEP]
        steps = m["table"][part[: len(part) // STEP * STEP]].reshape(-1, STEP, m["table"].shape[1]).sum(axis=1)
        for width in WIDTHS:
            starts = np.arange(at, min(to, max(1, len(ids) - width + STEP)), STEP)
            ends = np.minimum(starts + width, len(ids))
            share = (mine[ends] - mine[starts]) / np.maximum(full[ends] - full[starts], 1e-12)
            rows = np.flatnonzero(share >= least * least)
            latent = sum(steps[rows + i] for i in range(width // STEP))
            cosine = latent @ m["vectors"][k] / np.maximum(np.linalg.norm(latent, axis=1), 1e-12)
            for r in np.flatnonzero(cosine >= least).tolist():
                found.setdefault(k, []).append((int(starts[rows[r]]), int(ends[rows[r]]), float(cosine[r])))
    return found


def stretches(windows: list[tuple[int, int, float]], length: int) -> Iterator[tuple[int, int]]:
    """First and last word of the passages in which to look for an item of ``length`` words.

    Overlapping windows make a group, with the item's length as margin; groups of more than
    ``STRETCH`` lengths are cut into stretches of so many, each half a stretch after the one before.
    """
    groups: list[list[int]] = []
    for lo, hi, _ in sorted(windows):
        if groups and lo <= groups[-1][1]:
            groups[-1][1] = max(groups[-1][1], hi)
        else:
            groups.append([lo, hi])
    most = STRETCH * length
    for lo, hi in groups:
        lo, hi = max(0, lo - length), hi + length
        for at in range(lo, max(lo + 1, hi - most + most // 2), most // 2):
            yield at, min(at + most, hi)


def _search(rows: DataFrame, model: dict, cosine: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = dict(shared.value)
        m["squares"] = m["idf"] ** 2
        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), _lists(batch.column(1), len(m["idf"]) - 1), strict=True):
                for k, windows in sorted(_candidates(ids, m, cosine).items()) if len(ids) else ():
                    line = m["lines"][k]
                    last = line[-ANSWER_WORDS:]
                    checked = []
                    for lo, hi in stretches(windows, len(line)):
                        passage = ids[lo:hi].tolist()
                        lcs = common_subsequence(line, passage) / len(line)
                        if lcs >= PARAPHRASED:
                            answer = common_subsequence(last, passage) / len(last)
                            if lcs >= COPIED or answer >= COPIED:
                                checked.append((lcs, answer))
                    if checked:
                        lcs, answer = max(checked)
                        out.append((doc_id, m["items"][k], max(w[2] for w in windows), lcs, answer, "copy" if lcs >= COPIED else "paraphrase"))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[n.split()[0] for n in PAIRS.split(", ")])

    return rows.mapInArrow(run, PAIRS)


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, kind) of each document and benchmark item found in it.

    ``kind`` is ``copy`` if at least 0.8 of the item's words stand in order in one passage of at
    most four times its length, and ``paraphrase`` if 0.6 do and so do 0.8 of its answer, its last
    words; the passage with most of its words counts. Items and texts that are
    null or without a word match nothing; items of one text each match; a null id stays null.
    Repeated rows come once each. Empty tables give an empty result. Other columns are ignored.
    """
    items = benchmark.select("item_id", "text").where(F.coalesce("text", F.lit("")).rlike(r"[\p{L}\p{N}_]"))
    found = []
    blocks = -(-items.count() // BLOCK_ITEMS)
    # The benchmark's texts come to the driver; it is a set of test items, not a table of the corpus' size.
    known = vocabulary(docs, [r["text"] for r in items.select("text").distinct().collect()]) if blocks else None
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        block = sorted(((r["item_id"], r["text"]) for r in mine.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        block = [r for r in block if words_of(r[1])]
        if block:
            found.append(_search(known["ids"], fit(known, block), cosine))
    # An empty frame made in the driver is read by Python workers of its own, so it stands only where nothing is searched.
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], PAIRS)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows, with all their columns, in which no benchmark item was found; rows without an id stay."""
    found = staged(leaks(docs, benchmark).where("doc_id is not null").select("doc_id").distinct())
    found = F.broadcast(found) if found.count() <= BROADCAST_IDS else found.hint("merge")
    return docs.join(found, docs["doc_id"] == found["doc_id"], "left_anti")
