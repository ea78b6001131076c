"""LM scoring: probability of a text summed over all its segmentations into subwords.

An existing vocabulary gives the subwords and, by its scores' order, their first weights. Weights
are re-estimated on the distinct training words (expected use in all segmentations). The marginal
probability of a word is a forward recursion in log space over its lattice; pieces never cross
white space, so a text's probability is the product over its words and one end mark. Each training
word is also one arc over itself as a whole, weighted by its count less a discount; the discounted
mass goes to the subword paths.

The corpus is cut into chunks of bounded vocabulary. Only a chunk's distinct words travel: to their
counts and probabilities, computed once for each distinct word of the corpus, and back. A chunk is
many rows of about a megabyte, so that no reader, writer or sort holds more than a few of them.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm.common import held_out, small_batches, staged
from ruleloom.session import shuffled

VOCABULARY = "piece_bpe_32k.model"
#: Words start with this letter, as in the vocabulary.
MARK = "▁"
#: A chunk closes when it holds so many distinct words, so many documents, or their bags so many entries.
CHUNK_WORDS = 300_000
CHUNK_DOCS = 20_000
CHUNK_ENTRIES = 2_000_000
#: Words and bag entries of one of a chunk's rows; one text's bag stays in one row.
ROW_WORDS = 32_768
ROW_ENTRIES = 131_072
#: Parquet looks at the size of its pages and row groups after each row; by default after a hundred or more, all held till then, and read back as one batch.
ROW_GROUPS = {"parquet.block.size": 8 << 20} | {f"parquet.{kind}.size.row.check.{end}": 1 for kind in ("block", "page") for end in ("min", "max")}
#: Words that go back to their chunks are gathered to rows by so many at a time.
GATHERED = 1_000_000
ROUNDS = 2
#: Weight, in occurrences, of the vocabulary's own order against the corpus.
PRIOR = 100.0
DISCOUNT = 0.75
PRIME = np.uint64(0x100000001B3)

CHUNKS = (
    "chunk long, first int, words array<string>, train array<long>, doc_ids array<long>, held array<boolean>,"
    " tokens array<long>, sizes array<int>, word_at array<int>, times array<int>"
)
TOLD = "chunk long, found_at array<int>, found_c array<long>, found_logp array<double>"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def read_pieces(path: str) -> list[str]:
    """The vocabulary's pieces in the order of their scores, without marks and bytes."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    return [model.id_to_piece(i) for i in ids]


class Lattice:
    """Marginal probabilities of words, many words of one length at a time."""

    def __init__(self, pieces: list[str], logp: np.ndarray) -> None:
        keys = np.array([self._key(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.place = keys[order], order
        self.logp = np.append(logp, -np.inf)  # the last entry: no such piece
        self.none, self.bytes_at = len(logp), len(pieces)
        self.longest = max(map(len, pieces))

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(PRIME) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _arcs(self, points: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], dict[int, list[int]]]:
        """By length: piece and log weight from each start; and the bytes of letters without a piece."""
        ids, weights, spelt = [], [], {}
        c = points.astype(np.uint64) + np.uint64(1)
        h = np.zeros_like(c)
        for n in range(min(self.longest, points.shape[1])):
            h = h[:, : c.shape[1] - n] * PRIME + c[:, n:]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            found = np.where(self.keys[at] == h, self.place[at], self.none)
            weight = self.logp[found]
            if n == 0 and (missing := found == self.none).any():
                for p in np.unique(points[missing]).tolist():
                    spelt[p] = [self.bytes_at + b for b in chr(p).encode("utf-8", "surrogatepass")]
                    weight[points == p] = self.logp[spelt[p]].sum()
            ids.append(found)
            weights.append(weight)
        return ids, weights, spelt

    @staticmethod
    def _forward(weights: list[np.ndarray], rows: int, length: int) -> np.ndarray:
        alpha = np.full((rows, length + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, length + 1):
            parts = [alpha[:, j - n - 1] + w[:, j - n - 1] for n, w in enumerate(weights[:j])]
            alpha[:, j] = reduce(np.logaddexp, parts)
        return alpha

    def _by_length(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            sizes.setdefault(len(w), []).append(i)
        for n, at in sizes.items():
            step = max(1, 400_000 // (n + 1))
            for a in range(0, len(at), step):
                rows = at[a : a + step]
                line = MARK.join(words[i] for i in rows)
                points = np.frombuffer((MARK + line).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                yield np.array(rows), points.reshape(len(rows), n + 1)

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural logarithm of each word's probability."""
        out = np.empty(len(words))
        for rows, points in self._by_length(words):
            _, weights, _ = self._arcs(points)
            out[rows] = self._forward(weights, len(rows), points.shape[1])[:, -1]
        return out

    def expected(self, words: list[str]) -> np.ndarray:
        """Expected number of uses of each piece and byte in the words, each taken once."""
        out = np.zeros(len(self.logp))
        for rows, points in self._by_length(words):
            ids, weights, spelt = self._arcs(points)
            length = points.shape[1]
            alpha = self._forward(weights, len(rows), length)
            beta = np.full_like(alpha, -np.inf)
            beta[:, length] = 0
            for i in range(length - 1, -1, -1):
                parts = [w[:, i] + beta[:, i + n + 1] for n, w in enumerate(weights[: length - i])]
                beta[:, i] = reduce(np.logaddexp, parts)
            for n, (found, w) in enumerate(zip(ids, weights, strict=True)):
                used = np.exp(alpha[:, : length - n] + w + beta[:, n + 1 :] - alpha[:, -1:])
                out += np.bincount(found.ravel(), used.ravel(), minlength=len(out))
                if n == 0:
                    for p, places in spelt.items():
                        np.add.at(out, places, used[points == p].sum())
        return out[:-1]


def _chunks(docs: DataFrame, remainder: int) -> DataFrame:
    """Rows of each chunk: its distinct words, from number ``first``, with their training counts, and texts with their bags of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("chunk", pa.int64()), ("first", pa.int32()), ("words", pa.list_(pa.string())), ("train", pa.list_(pa.int64()))]
            + [("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("tokens", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))]
            + [("word_at", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]
        )
        task: int | None = None
        number = 0
        place: dict[bytes, int] = {}
        train = array("q")
        docs_of: list[tuple] = []
        word_at, times = array("i"), array("i")  # four bytes an entry

        def close() -> Iterator[pa.RecordBatch]:
            words = list(place)
            ids, held, tokens, sizes = (list(x) for x in zip(*docs_of, strict=True))
            starts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
            row_of = starts[:-1] // ROW_ENTRIES
            for k in range(max(-(-len(words) // ROW_WORDS), int(row_of[-1]) + 1)):
                w = slice(k * ROW_WORDS, (k + 1) * ROW_WORDS)
                a, b = np.searchsorted(row_of, (k, k + 1)).tolist()
                if a == b and not words[w]:
                    continue
                d, e = slice(a, b), slice(int(starts[a]), int(starts[b]))
                row = [(task << 32) + number, w.start, [x.decode("utf-8", "replace") for x in words[w]], np.asarray(train[w])]
                row += [ids[d], held[d], tokens[d], sizes[d], np.asarray(word_at[e]), np.asarray(times[e])]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            if batch.num_rows:
                task = batch.column(3)[0].as_py()
            for doc_id, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                bag = Counter((text.as_py() or b"").lower().split())
                for w, n in bag.items():
                    at = place.setdefault(w, len(place))
                    if at == len(train):
                        train.append(0)
                    if not held:
                        train[at] += n
                    word_at.append(at)
                    times.append(n)
                docs_of.append((doc_id, held, bag.total() + 1, len(bag)))
                if len(place) >= CHUNK_WORDS or len(docs_of) >= CHUNK_DOCS or len(word_at) >= CHUNK_ENTRIES:
                    yield from close()
                    number += 1
                    place, train, docs_of = {}, array("q"), []
                    word_at, times = array("i"), array("i")
        if docs_of:
            yield from close()

    rows = docs.select("doc_id", held_out("doc_id", remainder).alias("held"), "text", F.spark_partition_id().cast("long").alias("task"))
    return staged(rows.mapInArrow(run, CHUNKS), **ROW_GROUPS)


def _gathered(found: DataFrame) -> DataFrame:
    """(chunk, at, c, logp) as lists, one row for each chunk among ``GATHERED`` rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []

        def close() -> pa.RecordBatch:
            chunk, *lists = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(chunk, kind="stable")
            chunk = chunk[order]
            starts = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
            offsets = pa.array(np.append(starts, len(chunk)), pa.int32())
            columns = [pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in lists]
            return pa.RecordBatch.from_arrays([pa.array(chunk[starts]), *columns], names=["chunk", "found_at", "found_c", "found_logp"])

        for batch in batches:
            if batch.num_rows:
                parts.append([c.to_numpy() for c in batch.columns])
            if sum(len(p[0]) for p in parts) >= GATHERED:
                yield close()
                parts = []
        if parts:
            yield close()

    return found.select("chunk", "at", "c", "logp").mapInArrow(run, TOLD)


def _weights(spark: SparkSession, words: DataFrame, pieces: list[str], rounds: int) -> np.ndarray:
    """Natural log weights of pieces and bytes, which sum to one, from (word, c)."""
    first = np.concatenate([1.0 / (np.arange(len(pieces)) + 10.0), np.full(256, 1e-4)])
    first /= first.sum()
    weights = first
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, np.log(weights)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(*shared.value)
            total = np.zeros(len(shared.value[1]))
            for batch in batches:
                total += lattice.expected(batch.column(0).to_pylist())
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

        used = words.where("c > 0").select("word").mapInArrow(run, "piece long, n double")  # noqa: B023
        seen = np.zeros(len(weights))
        for r in used.groupBy("piece").agg(F.sum("n").alias("n")).collect():  # one row for each piece at most
            seen[r["piece"]] = r["n"]
        weights = seen + PRIOR * first
        weights /= weights.sum()
    return np.log(weights)


def lattice_scores(docs: DataFrame, path: str | None = None, remainder: int = 1, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    Tokens are the words (runs without ASCII white space, A-Z lower-cased) and one end mark; a
    null text has the end alone. Counts come from all rows that are not held out (crc32 of the id
    by 5 is not ``remainder``). ``base_score`` is the add-half unigram model, ``score`` the
    lattice's marginal, both in log10. Repeated rows come, and count, once each; an empty table
    gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    pieces = read_pieces(path)
    chunks = _chunks(docs, remainder)
    ends = chunks.select(F.size(F.filter("held", lambda h: ~h)).alias("n")).agg(F.sum("n")).first()[0] or 0
    entries = chunks.select("chunk", "first", F.posexplode(F.arrays_zip("words", "train")).alias("k", "e")).select(
        "chunk", (F.col("first") + F.col("k")).alias("at"), F.col("e.words").alias("word"), F.col("e.train").alias("train")
    )
    words = staged(entries.groupBy("word").agg(F.sum("train").alias("c")))
    total, known = words.where("c > 0").agg(F.sum("c"), F.count("*")).first()
    train_tokens, distinct = (total or 0) + ends, known + (ends > 0)
    in_words = train_tokens - ends
    end = (ends + 0.5) / (train_tokens + 1)
    subwords = np.log(DISCOUNT * known / in_words) if in_words else 0.0
    shared = spark.sparkContext.broadcast((pieces, _weights(spark, words, pieces, rounds)))

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for batch in batches:
            found = lattice.log_probabilities(batch.column(0).to_pylist()) + subwords
            whole = np.maximum(batch.column(1).to_numpy() - DISCOUNT, 0) / max(in_words, 1)
            found = np.logaddexp(found, np.log(whole, out=np.full(len(whole), -np.inf), where=whole > 0)) + math.log1p(-end)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["word", "c", "logp"])

    scored = staged(words.mapInArrow(score_words, "word string, c long, logp double"))
    told = _gathered(entries.join(shuffled(scored), "word"))
    bags = chunks.where(F.size("doc_ids") > 0).select("chunk", "doc_ids", "held", "tokens", "sizes", "word_at", "times")
    # Words before texts, chunk by chunk: a task holds the words of one chunk and the texts of one row.
    met = bags.unionByName(told, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", F.col("doc_ids").isNotNull())
    norm, half = math.log10(train_tokens + 0.5 * (distinct + 1)), 0.5
    end_base, end_score = math.log10(ends + half) - norm, math.log10(end)

    def score_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: int | None = None
        parts: list[list[np.ndarray]] = []
        c, logp = np.zeros((2, 0))
        for batch in batches:
            column = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                if column["chunk"][i].as_py() != chunk:
                    chunk, parts = column["chunk"][i].as_py(), []
                    c, logp = np.zeros((2, 0))
                if column["found_at"][i].is_valid:
                    parts.append([column[f"found_{n}"][i].values.to_numpy() for n in ("at", "c", "logp")])
                    continue
                if parts:
                    at, c_at, logp_at = (np.concatenate(x) for x in zip(*parts, strict=True))
                    c, logp = np.zeros((2, len(at)))
                    c[at], logp[at], parts = c_at, logp_at, []
                part = {n: column[n][i].values for n in ("doc_ids", "held", "tokens", "sizes", "word_at", "times")}
                sizes, word_at, times = (part[n].to_numpy() for n in ("sizes", "word_at", "times"))
                base, own = np.log10(c + half) - norm, logp / math.log(10)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                add = lambda x: np.bincount(doc, x[word_at] * times, minlength=len(sizes))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [part["doc_ids"], part["held"], part["tokens"]]
                    + [pa.array(np.rint(add((c > 0).astype(np.float64))).astype(np.int64) + int(ends > 0))]
                    + [pa.array(add(base) + end_base), pa.array(add(own) + end_score)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    columns = ("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(train_tokens)).cast("long").alias("train_tokens"), "base_score", "score")
    return met.mapInArrow(score_texts, SCORES).select(*columns)
