"""Byte-level BPE by ranks: longest matches with backtracking over Latin-1, and decoding by an offset table.

A text is cut into the matches of the vocabulary's pattern. The bytes of a match become Latin-1
letters, which pyahocorasick searches for the longest token at each place. Going left to right, a
token is taken if the merges would leave the border to its left neighbour alone, which is told from
the two tokens only and remembered; else its next shorter prefix is tried, and a place that no token
leads on from is given up for good. Each place is left at most once, so the work is linear in the
match, and the one sequence in which all neighbours are compatible is the one that the merges make.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

RANKS = "byte_bpe_50k.tiktoken"
#: Runs kept with their ids, the longest run kept, and pairs of tokens kept with their verdict.
CACHED_RUNS = 500_000
CACHED_LETTERS = 64
CACHED_PAIRS = 1_000_000
#: Letters of text that are turned into ids before they go on.
BATCH_LETTERS = 1 << 20

#: White space of the pattern's engine: Python's own class holds four control characters more.
_SPACE = "\t-\r \x85\xa0  -     　"
#: Cuts at which every match of the pattern ends: a run with the space before it, and white space before that.
_RUNS = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks, from a file of base64 tokens and numbers, as the driver sees it."""
    with open(path, "rb") as f:
        found = {int(n): base64.b64decode(token) for token, n in (line.split() for line in f if line.strip())}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must count from zero without gaps")
    return [found[n] for n in range(len(found))]


class Remembered(dict):
    """Token ids of runs; those met first stay, as frequent runs come early."""

    def __init__(self, make: Callable[[str], tuple[int, ...]]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, run: str) -> tuple[int, ...]:
        out = self.make(run)
        if len(run) <= CACHED_LETTERS and len(self) < CACHED_RUNS:
            self[run] = out
        return out


class ByteEncoder:
    """Encodes texts with one list of ranked tokens; lives as long as a task."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        letters = [t.decode("latin-1") for t in tokens]
        self.rank = {t: r for r, t in enumerate(letters)}
        self.size = [len(t) for t in letters]
        self.halves: list[tuple[int, int]] = [(-1, -1)] * len(letters)
        self.joined: dict[tuple[int, int], int] = {}
        #: By left token: its right neighbours met so far, and whether the two stay side by side.
        self.fits: defaultdict[int, dict[int, bool]] = defaultdict(dict)
        self.pairs = 0
        # The two tokens whose merge makes each token, found with the tokens before it only.
        for r, t in enumerate(letters):
            for cut in range(1, len(t)):
                a, b = self.rank.get(t[:cut], r), self.rank.get(t[cut:], r)
                if a < r and b < r and self._side_by_side(a, b, r):
                    self.halves[r] = a, b
                    self.joined[a, b] = r
                    break
        # Tokens that no merge makes stand for whole matches only.
        usable = [len(t) == 1 or self.halves[r][0] >= 0 for r, t in enumerate(letters)]
        self.longest = ahocorasick.Automaton()
        for r, t in enumerate(letters):
            if usable[r]:
                self.longest.add_word(t, r)
        self.reach = max(self.size)
        # The searched trie tells how far a text goes on as the beginning of some token; here is the longest token in that.
        self.within = {t[:n]: -1 for r, t in enumerate(letters) if usable[r] for n in range(1, len(t) + 1)}
        for beginning in sorted(self.within, key=len):
            r = self.rank.get(beginning, -1)
            self.within[beginning] = r if r >= 0 and usable[r] else self.within.get(beginning[:-1], -1)
        self.shorter = [-1] * len(letters)
        for r, t in enumerate(letters):
            self.shorter[r] = next((p for p in (self.rank.get(t[:n], -1) for n in range(len(t) - 1, 0, -1)) if p >= 0 and usable[p]), -1)
        self.matches = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.runs = Remembered(self.run)

    def _side_by_side(self, a: int, b: int, limit: int) -> bool:
        """Whether the merges below ``limit`` leave ``a`` and ``b`` as neighbours.

        Both are undone towards their border, the later merge first. Whenever the two pieces then at
        the border make a token whose turn comes before the merge last undone, it had been made.
        """
        while True:
            made = self.joined.get((a, b), limit)
            if made < limit:
                return False
            right_of_a, left_of_b = self.halves[a][1], self.halves[b][0]
            if right_of_a < 0 and left_of_b < 0:
                return True
            # Of equal merges the left one comes first: it beats one over the border, the right one loses to it.
            if left_of_b < 0 or (right_of_a >= 0 and a > b):
                limit, a = a, right_of_a
            else:
                limit, b = b + 1, left_of_b

    def _compatible(self, a: int, b: int) -> bool:
        if self.pairs >= CACHED_PAIRS:
            for known in self.fits.values():
                known.clear()
            self.pairs = 0
        self.pairs += 1
        found = self.fits[a][b] = self._side_by_side(a, b, len(self.size))
        return found

    def match(self, piece: bytes) -> list[int]:
        """Token ids of one match of the pattern."""
        line = piece.decode("latin-1")
        whole = self.rank.get(line)
        if whole is not None:
            return [whole]
        n, size, shorter, fits, reach = len(line), self.size, self.shorter, self.fits, self.reach
        longest, within = self.longest.longest_prefix, self.within
        given_up: set[int] = set()
        out: list[int] = []
        at, token, left = 0, within[line[: longest(line[:reach])]], -1
        good: dict[int, bool] = {}
        while at < n:
            while token >= 0:
                if left < 0 or good.get(token, False) or (token not in good and self._compatible(left, token)):
                    if at + size[token] not in given_up:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, left, good = at + size[token], token, fits[token]
                if at < n:
                    token = within[line[at : at + longest(line[at : at + reach])]]
            elif out:
                given_up.add(at)
                token = out.pop()
                at, token, left = at - size[token], shorter[token], out[-1] if out else -1
                good = fits[left]
            else:
                raise ValueError("a byte has no token")
        return out

    def run(self, run: str) -> tuple[int, ...]:
        """Token ids of a run of letters that ends where matches end."""
        # The pattern takes a space and letters as one match; most runs are no more than that.
        if (run[1:] if run[0] == " " else run).isalpha():
            return tuple(self.match(run.encode()))
        parts = self.matches(run)
        # A match is a run, too, and often one met before.
        return tuple(self.match(run.encode())) if len(parts) == 1 else tuple(chain.from_iterable(map(self.runs.__getitem__, parts)))

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids of a whole text; null is empty."""
        return np.fromiter(chain.from_iterable(map(self.runs.__getitem__, _RUNS.findall(text or ""))), dtype=np.int32)


_ENCODERS: dict[tuple[str, str], ByteEncoder] = {}


def _encoder(path: str, pattern: str, tokens: list[bytes]) -> ByteEncoder:
    """The worker's encoder of a vocabulary; later tasks of the same worker find it with what it remembers."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, pattern] = ByteEncoder(tokens, pattern)
    return _ENCODERS[path, pattern]


class ByteDecoder:
    """Bytes of token ids: one table of all tokens' bytes, and where each token starts in it."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.starts = np.concatenate(([0], np.cumsum([len(t) for t in tokens], dtype=np.int64)))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of many lists at once: list ``k`` is ``ids[offsets[k]:offsets[k + 1]]``; the bytes and their offsets."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.starts) - 1):
            raise ValueError("an id is no token")
        sizes = self.starts[ids + 1] - self.starts[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        at = np.arange(int(ends[-1])) + np.repeat(self.starts[ids] - ends[:-1], sizes)
        return self.data[at], ends[offsets]


def _portions(texts: pa.Array) -> Iterator[list[str | None]]:
    """The rows in order, a bounded number of letters at a time; a longer text comes by itself."""
    part: list[str | None] = []
    letters = 0
    for text in texts:
        part.append(text.as_py())
        letters += len(part[-1] or "") + 64
        if letters >= BATCH_LETTERS:
            yield part
            part, letters = [], 0
    if part:
        yield part


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def encode(spark: SparkSession, text: Column, path: str, pattern: str) -> Column:
    """struct<ids: array<int>, decoded: binary> of a text column; null is empty.

    ``path`` is a file of ranked tokens on the driver, whose bounded content goes to the tasks;
    ``pattern`` cuts the text. Special tokens' names are ordinary text.
    """
    shared = spark.sparkContext.broadcast(read_ranks(path))
    kind = StructType().add("ids", ArrayType(IntegerType(), containsNull=False)).add("decoded", BinaryType())

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, decoder = _encoder(path, pattern, shared.value), ByteDecoder(shared.value)
        for batch in batches:
            out = []
            for texts in _portions(batch):
                lists = [encoder.encode(t) for t in texts]
                offsets = np.concatenate(([0], np.cumsum([len(i) for i in lists], dtype=np.int64)))
                ids = np.concatenate(lists)
                decoded = _binary(*decoder.decode(ids, offsets))
                out.append(pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), decoded], names=["ids", "decoded"]))
            yield pa.concat_arrays(out) if out else pa.array([], pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())]))

    return run(text)


def decode(spark: SparkSession, ids: Column, path: str) -> Column:
    """The bytes of an array<int> column of token ids; null is empty, an id that is no token an error."""
    shared = spark.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf(BinaryType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = ByteDecoder(shared.value)
        for batch in batches:
            lists = [np.array(i or [], dtype=np.int64) for i in batch.to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(i) for i in lists], dtype=np.int64)))
            yield _binary(*decoder.decode(np.concatenate(lists) if lists else np.zeros(0, np.int64), offsets))

    return run(ids)


def byte_encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): each row's token ids and the bytes that they decode to.

    Every row stays, repeated ones and those with a null id too. A null or empty text has no ids and
    decodes to no bytes. A text of any length is encoded whole. An empty table gives an empty
    result; other columns are ignored. Nothing is shuffled.
    """
    import public_tokenizers

    found = encode(docs.sparkSession, F.col("text"), path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN)
    return docs.select("doc_id", found.alias("__found")).select("doc_id", "__found.ids", "__found.decoded")
