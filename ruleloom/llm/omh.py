"""Document fingerprints by Order MinHash, in DataFrame functions only.

A text's k-mers are pairs of neighbouring words, numbered when they repeat. Their hashes fall into
bins; each bin keeps its least ``LENGTH`` k-mers, puts them back into text order and hashes them
together. Two texts agree in a bin if they share those k-mers in the same order, so moved and
replaced passages both count, as in edit distance.

K-mers are packed into one long each, hash above position, so that sorting, numbering repeats and
picking the least of each bin are passes over arrays of longs in their own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Least k-mers kept in each bin, bins (a power of two), and bits of a word's position.
LENGTH = 2
BIN_BITS = 6
POSITION_BITS = 23
ROWS_PER_BUCKET = 1000
MOST_BUCKETS = 10_000

_POSITION = (1 << POSITION_BITS) - 1


def _hash_part(x: Column) -> Column:
    return F.shiftright(x, POSITION_BITS)


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BIN_BITS)


def _packed(h: Column, at: Column) -> Column:
    return h.bitwiseAND(F.lit(~_POSITION)).bitwiseOR(at.cast("long").bitwiseAND(F.lit(_POSITION)))


def _upto(n: Column, start: int = 0) -> Column:
    """start, start + 1, ..., n - 1."""
    return F.when(n > start, F.sequence(F.lit(start), n - 1)).otherwise(F.array().cast("array<int>"))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: one long for each bin that holds a k-mer of ``text``, the bin in its highest bits.

    Words are runs without white space; a text of one word, or of none, is one k-mer. Positions
    count modulo 8 million. Each step is a column of its own, so that no step runs twice.
    """
    rest = [c for c in df.columns]
    keep = lambda *more: [*rest, *more]
    w = df.select(*rest, F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: F.xxhash64(x)).alias("_w"))
    pair = lambda h, i: _packed(F.when(i + 1 < F.size("_w"), F.xxhash64(h, F.col("_w")[i + 1])).otherwise(h), i)
    kmers = F.transform(F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 1, F.lit(1))), pair)
    p = w.select(*keep(F.sort_array(kmers).alias("_p")))
    again = F.filter(_upto(F.size("_p"), 1), lambda j: _hash_part(F.col("_p")[j]) == _hash_part(F.col("_p")[j - 1]))
    r = p.select(*keep("_p", again.alias("_r")))
    runs = F.filter(_upto(F.size("_r")), lambda i: (i == 0) | (F.col("_r")[i] != F.col("_r")[F.greatest(i - 1, F.lit(0))] + 1))
    s = r.select(*keep("_p", "_r", runs.alias("_s")))

    def numbered(first: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col("_s"), k + 1), F.size("_r"))
        one = lambda i: F.col("_p")[F.col("_r")[i]]
        return F.transform(F.sequence(first, end - 1), lambda i: _packed(F.xxhash64(_hash_part(one(i)), (i - first + 1).cast("long")), one(i)))

    firsts = F.filter("_p", lambda x, j: (j == 0) | (_hash_part(x) != _hash_part(F.col("_p")[F.greatest(j - 1, F.lit(0))])))
    all_of = F.when(F.size("_r") == 0, F.col("_p")).otherwise(
        F.sort_array(F.concat(firsts, F.flatten(F.transform("_s", numbered))))
    )
    e = s.select(*keep(all_of.alias("_e")))
    least = F.filter("_e", lambda x, j: (j < LENGTH) | (_bin(x) != _bin(F.col("_e")[F.greatest(j - LENGTH, F.lit(0))])))
    m = e.select(*keep(least.alias("_m")))
    starts = F.filter(_upto(F.size("_m")), lambda j: (j == 0) | (_bin(F.col("_m")[j]) != _bin(F.col("_m")[F.greatest(j - 1, F.lit(0))])))
    t = m.select(*keep("_m", starts.alias("_t")))

    def in_order(j: Column) -> Column:
        mine = F.filter(F.slice("_m", j + 1, F.lit(LENGTH)), lambda x: _bin(x) == _bin(F.col("_m")[j]))
        by_place = F.array_sort(
            F.transform(mine, lambda x: F.shiftleft(x.bitwiseAND(F.lit(_POSITION)), 40).bitwiseOR(_hash_part(x).bitwiseAND(F.lit((1 << 40) - 1))))
        )
        whole = F.aggregate(by_place, F.lit(42).cast("long"), lambda a, y: F.xxhash64(a, y.bitwiseAND(F.lit((1 << 40) - 1))))
        return F.shiftrightunsigned(whole, BIN_BITS).bitwiseOR(F.shiftleft(_bin(F.col("_m")[j]), 64 - BIN_BITS))

    return t.select(*keep(F.transform("_t", in_order).alias(name)))


def likeness(a: str, b: str) -> Column:
    """Share of the bins in use on which two fingerprints agree, 0 to 1."""
    bins = F.array_distinct(F.concat(F.transform(a, _bin), F.transform(b, _bin)))
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(bins), F.lit(1))


def as_text(name: str) -> Column:
    return F.array_join(F.transform(name, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text, bucket, place, copy): each row beside the one after it, the last beside the first.

    Rows go by ranges of ids into buckets, each once, in one exchange. Bounds are ids of the data
    themselves, so the row that opens a bucket is known and a copy of it closes the bucket before.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    ids = docs.select(key.alias("key"))
    rows, first = ids.agg(F.count("*"), F.min("key")).first()
    width = max(ROWS_PER_BUCKET, -(-rows // MOST_BUCKETS))
    drawn = ids.where(F.pmod(F.xxhash64("key"), F.lit(max(1, width // 8))) == 0).distinct()
    bounds = sorted(r["key"] for r in drawn.collect())[8::8]  # at most about MOST_BUCKETS * 8 ids come here
    bounds = [b for b in bounds if b != first]
    inside = F.filter(F.array(*map(F.lit, bounds)).cast("array<bigint>"), lambda b: b <= F.col("key"))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    own = own.select("*", F.size(inside).alias("bucket"))
    opens = F.col("key").isin(bounds) if bounds else F.lit(False)
    place = lambda bucket, copy: F.struct(bucket.alias("bucket"), F.lit(copy).alias("copy"))
    to = F.array(place(F.col("bucket"), 0))
    to = F.when(opens, F.concat(to, F.array(place(F.col("bucket") - 1, 1)))).otherwise(to)
    if first is not None:
        to = F.when(F.col("key") == first, F.concat(to, F.array(place(F.lit(len(bounds)), 2)))).otherwise(to)
    placed = own.select("doc_id", "text", "key", F.explode(to).alias("to")).select("doc_id", "text", "key", "to.bucket", "to.copy")
    order = Window.partitionBy("bucket").orderBy((F.col("copy") == 2).cast("int"), "key", "text")
    return placed.select(
        "doc_id", "text", "bucket", "copy", F.lead("text").over(order).alias("next_text"), F.row_number().over(order).alias("place")
    )


def order_minhash(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row's text and of its edited text, and how alike they are.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The
    edited text has the last quarter of the code points replaced by the first as many, or all, of
    the next row's text; rows go by doc_id, then text, nulls first, and the last is followed by the
    first (a single row by itself). A null text is an empty one. Repeated rows come once each; an
    empty table gives an empty result; other columns are ignored.
    """
    n, cut = F.char_length("text"), F.floor(F.char_length("text") / 4).cast("int")
    both = _with_next(docs).select(
        "doc_id", "bucket", "copy", "place", "text", n.cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut)).alias("edited"),
    )
    own = with_fingerprint(both, "text", "_own").drop("text")
    edited = with_fingerprint(own, "edited", "_edited").withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    order = Window.partitionBy("bucket").orderBy("place")
    told = edited.withColumn("_next", F.lead("_own").over(order)).where("copy = 0")
    return told.select(
        "doc_id", "n_chars", "edited_sha256", as_text("_own").alias("fingerprint"), as_text("_edited").alias("edited_fingerprint"),
        likeness("_own", "_edited").alias("near_edited"), F.coalesce(likeness("_own", "_next"), F.lit(0.0)).alias("near_next"),
    )
