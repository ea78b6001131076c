"""Byte-pair encoding by longest matches with backtracking, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary finds the longest token at each place of a word. A
token may follow another only if the merges would have left the border between them alone; that is
looked up in a table of compatible pairs. A token that fits nowhere gives way to its longest proper
prefix, and a place from which nothing fits is given up, so each place is left at most once: the
result is the one of the merge rules, in time linear in the word.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

VOCABULARY = "word_bpe_49k.json"
CACHED_WORDS = 200_000
CACHED_CHUNKS = 100_000
CACHED_PAIRS = 500_000
#: Texts that a task holds at a time.
ROWS = 128


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@dataclass
class Spec:
    """What an encoder needs of a vocabulary file; made in the task, as the file's text is a fraction of it."""

    vocab: dict[str, int]
    merges: list[tuple[str, str]]
    suffix: str
    pattern: str
    specials: dict[str, int]
    lower: bool

    @staticmethod
    def load(path: str) -> Spec:
        """Read a vocabulary file in JSON, as the driver sees it."""
        return Spec.parse(_content(path))

    @staticmethod
    def parse(content: bytes) -> Spec:
        """Read the content of a vocabulary file in JSON."""
        found = json.loads(content)
        model = found["model"]
        kinds = [n["type"] for n in found["normalizer"]["normalizers"]]
        return Spec(
            model["vocab"],
            [tuple(m) for m in model["merges"]],
            model["end_of_word_suffix"] or "",
            next(p["pattern"]["Regex"] for p in found["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"),
            {t["content"]: t["id"] for t in found["added_tokens"]},
            "Lowercase" in kinds,
        )


class Encoder:
    """Encodes texts with one vocabulary; lives as long as a task."""

    def __init__(self, spec: Spec) -> None:
        letters = byte_letters()
        # Symbols: a byte inside a word is its own letter, one that ends a word is 256 further.
        self.final = [chr(256 + b) for b in range(256)]
        self.ids: list[int] = []
        self.text: list[str] = []
        self.split: list[tuple[int, int]] = []
        self.merged: dict[tuple[int, int], int] = {}
        by_name: dict[str, int] = {}

        def add(name: str, symbols: str, parts: tuple[int, int] | None) -> None:
            rank = by_name[name] = len(self.ids)
            self.ids.append(spec.vocab[name])
            self.text.append(symbols)
            self.split.append(parts or (rank, rank))

        for b in range(256):
            add(letters[b], chr(b), None)
        for b in range(256):
            add(letters[b] + spec.suffix, self.final[b], None)
        for left, right in spec.merges:
            a, b = by_name[left], by_name[right]
            self.merged[a, b] = len(self.ids)
            add(left + right, self.text[a] + self.text[b], (a, b))
        self.tokens = ahocorasick.Automaton()
        rank_of = self.rank_of = {s: r for r, s in enumerate(self.text)}
        for s, r in rank_of.items():
            self.tokens.add_word(s, (r, len(s) - 1))
        self.tokens.make_automaton()
        self.shorter = [next((rank_of[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in rank_of), -1) for s in self.text]
        self.size = [len(s) for s in self.text]
        self.fits: dict[tuple[int, int], bool] = {}
        self.find = regex.compile(spec.pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, spec.specials)) + ")") if spec.specials else None
        self.specials, self.lower = spec.specials, spec.lower
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merge rules leave ``a`` and ``b`` side by side: nothing ever joins over their border.

        The parts that touch the border are undone from the latest merge to the earliest. If at
        any time the two that then touch have a merge that comes before those undone, the rules
        would have taken it.
        """
        key = a, b
        before = len(self.ids)
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < before:
                good = False
                break
            inner_a, inner_b = self.split[a][1], self.split[b][0]
            if a == inner_a and b == inner_b:
                good = True
                break
            # A merge on the left wins a tie with the one over the border, one on the right does not.
            if b == inner_b or (a != inner_a and a > b):
                before, a = a, inner_a
            else:
                before, b = b + 1, inner_b
        if len(self.fits) >= CACHED_PAIRS:
            self.fits.clear()
        self.fits[key] = good
        return good

    def word(self, word: bytes) -> list[int]:
        """Token ids of one word."""
        line = word[:-1].decode("latin-1") + self.final[word[-1]]
        whole = self.rank_of.get(line)
        if whole is not None:
            return [self.ids[whole]]
        length, size, fits = len(line), self.size, self.fits
        longest = [-1] * (length + 1)
        for end, (rank, before) in self.tokens.iter(line):  # by rising end: the longest comes last
            longest[end - before] = rank
        dead, out, at, token = set(), [], 0, longest[0]
        while at < length:
            while token >= 0:
                end = at + size[token]
                if end not in dead:
                    if not out:
                        break
                    good = fits.get((out[-1], token))
                    if good is None:
                        good = self.compatible(out[-1], token)
                    if good:
                        break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at]
            else:
                dead.add(at)
                token = out.pop()
                at -= size[token]
        return [self.ids[r] for r in out]

    def chunk(self, chunk: str) -> Sequence[int]:
        """Token ids of a run without white space."""
        known = self.chunks.get(chunk)
        if known is not None:
            return known
        line = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)
        if self.lower:
            line = line.lower() if "Σ" not in line else "".join([c.lower() for c in line])
        out: list[int] = []
        for w in self.find(line):
            ids = self.words.get(w)
            if ids is None:
                ids = self.word(w.encode("utf-8", "surrogatepass"))
                if len(self.words) < CACHED_WORDS:  # frequent words come early
                    self.words[w] = tuple(ids)
            out += ids
        if len(self.chunks) < CACHED_CHUNKS:
            self.chunks[chunk] = tuple(out)
        return out

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a whole text; null is empty."""
        if not text:
            return []
        out: list[int] = []
        for part in self.special.split(text) if self.special and "<|" in text else [text]:
            if part in self.specials:
                out.append(self.specials[part])
                continue
            # str.split() also parts at four control characters that are no white space in Unicode.
            odd = regex.search("[\x1c-\x1f]", part)
            for c in regex.split(r"\p{White_Space}+", part) if odd else part.split():
                if c:
                    out += self.chunk(c)
        return out


class Decoder:
    """Token ids back to the tokens' texts, joined by one space."""

    def __init__(self, spec: Spec) -> None:
        names = {i: s for s, i in (spec.vocab | spec.specials).items()}
        size = max(names) + 1
        parts = [(names[i] + " ").encode() if i in names else b"" for i in range(size)]
        self.data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def decode(self, ids: np.ndarray) -> str:
        """Ids outside the vocabulary have no text, as in the library."""
        ids = ids[(ids >= 0) & (ids < len(self.offsets) - 1)]
        if not len(ids):
            return ""
        starts, ends = self.offsets[ids], self.offsets[ids + 1]
        sizes = ends - starts
        before = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)
        return self.data[at].tobytes()[:-1].decode("utf-8")


def _lists(ids: list[list[int]]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
    flat = np.fromiter((x for i in ids for x in i), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def encode(spark: SparkSession, text: Column, path: str, decoded: bool = False) -> Column:
    """Token ids (array<int>) of a text column with the vocabulary file at ``path``; null is empty.

    With ``decoded``: a struct of those ids and of the text that they decode to.
    """
    content = spark.sparkContext.broadcast(_content(path))
    ids_type = ArrayType(IntegerType(), containsNull=False)

    @F.arrow_udf(StructType().add("ids", ids_type).add("decoded", StringType()) if decoded else ids_type)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        spec = Spec.parse(content.value)
        encoder, decoder = Encoder(spec), Decoder(spec)
        del spec  # its memory serves what the encoder remembers
        for texts in _parts(batches):
            ids = [encoder.encode(t) for t in texts.to_pylist()]
            if decoded:
                back = [decoder.decode(np.array(i, dtype=np.int64)) for i in ids]
                yield pa.StructArray.from_arrays([_lists(ids), pa.array(back, pa.string())], names=["ids", "decoded"])
            else:
                yield _lists(ids)

    return run(text)


def decode(spark: SparkSession, ids: Column, path: str) -> Column:
    """The tokens' texts joined by one space, for an array<int> column; null is empty."""
    content = spark.sparkContext.broadcast(_content(path))

    @F.arrow_udf(StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(Spec.parse(content.value))
        for rows in _parts(batches):
            yield pa.array([decoder.decode(np.array(i or [], dtype=np.int64)) for i in rows.to_pylist()], type=pa.string())

    return run(ids)


def default_vocabulary() -> str:
    """Place of the installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): each row's token ids and the text they decode to.

    Every row stays, repeated ones too; a null or empty text has no tokens and decodes to an
    empty text. Other columns are ignored. Nothing is shuffled.
    """
    spark, path = docs.sparkSession, path or default_vocabulary()
    return docs.select("doc_id", encode(spark, F.col("text"), path, decoded=True).alias("e")).select("doc_id", "e.ids", "e.decoded")
