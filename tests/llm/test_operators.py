"""Each operator against a plain version of itself, and on odd rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleloom.llm import bpe, components, decontam, htmltext, langid, lattice, nearcopies, omh, quotes, resample, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, fingerprint string, component_id long, bucket int"
RNG = random.Random(5)
WORDS = ["the", "of", "storm", "river", "castle", "green", "walks", "under", "seven", "lamps", "quietly", "stone", "bridge", "ferry"]


def sentence(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [sentence(RNG.randint(1, 120)) for _ in range(60)]
    texts += [texts[0], texts[1] + " and more", "", None, "   ", "éß 中文 \U0001f44d", "x" * 50_000, sentence(9_000)]
    rows = [(i, t, "en", "s", "clash", 7, 1) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[2], None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_every_operator_takes_an_empty_table(spark, no_docs):
    labels = labels_of(spark, [])
    benchmark = spark.createDataFrame([], "item_id long, text string")
    for found in (
        bpe.encoded(no_docs), simhash.near_duplicates(no_docs), omh.order_minhash(no_docs), langid.languages(no_docs),
        lattice.lattice_scores(no_docs), toxicity.toxicity(no_docs, labels), resample.resample(no_docs, labels),
        decontam.leaks(no_docs, benchmark), htmltext.main_texts(spark.createDataFrame([], "page_id long, url string, html string")),
        quotes.link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
        simhash.drop_near_duplicates(no_docs), langid.keep_languages(no_docs), toxicity.drop_toxic(no_docs, labels), decontam.drop_leaks(no_docs, benchmark),
    ):
        assert found.count() == 0


def test_every_operator_returns_each_row(spark, docs):
    n, labels = docs.count(), labels_of(spark, [(1, 1, 0, "x"), (2, 0, 1, "x"), (2, 1, 0, "x"), (None, 1, 1, None), (3, None, None, None)])
    assert bpe.encoded(docs).count() == n
    assert simhash.near_duplicates(docs).count() == n
    assert omh.order_minhash(docs).count() == n
    assert langid.languages(docs).count() == n
    assert lattice.lattice_scores(docs, rounds=1).count() == n
    assert toxicity.toxicity(docs, labels).where("score between 0 and 1").count() == n
    assert resample.resample(docs, labels, k=n + 5).count() == n
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


# 1 quotation linking


def test_quotes_are_parsed_linked_and_ordered(spark):
    rows = [
        (1, 0, "u", "Where is the key?\nI lost it."), (1, 1, "a", "> where is THE key\n> I lost it.\nOn the table."),
        (1, 2, "u", ">> I lost it.\n> On the table.\nThanks\n> nowhere said\nbye"), (1, 4, "a", None), (1, 4, "a", None),
        (2, 0, "u", "> On the table."), (None, 0, "u", "> a"), (3, None, "u", "b"),
    ]
    found = {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    first, second = found[1, 1], found[1, 2]
    assert (first.own_text, first.n_quotes, first.quoted_turns, first.parent_turn, first.depth) == ("On the table.", 1, [0], 0, 1)
    assert (second.own_text, second.n_quotes, second.max_level, second.quoted_turns) == ("Thanks\nbye", 3, 2, [0, 1])
    assert (second.parent_turn, second.root_turn, second.depth) == (1, 0, 2)
    assert (found[1, 4].parent_turn, found[1, 4].root_turn) == (None, 4)
    assert found[2, 0].quoted_turns == [] and found[None, 0].own_text == "" and found[3, None].own_text == "b"


def test_long_reply_chain(spark):
    rows = [(1, i, "u", f"m{i}") for i in range(40)]
    found = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {(r.turn, r.root_turn, r.depth) for r in found.collect()} == {(i, 0, i) for i in range(40)}


# 2 byte-pair encoding


def test_encoding_is_the_librarys(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    spec = bpe.Spec.load(bpe.default_vocabulary())
    encoder, decoder = bpe.Encoder(spec), bpe.Decoder(spec)
    rng, letters = random.Random(1), "abcdeéÉßΣİı²Ⅷ中 \t\n\x1c\x85​'’str.,!<>|/-_#\U0001f44d́"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["I'll DON'T<|endoftext|>x <|startoftext|>", "a" * 3000, "!?" * 500, "</w> <w>"] + [r.text or "" for r in docs.collect()]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = encoder.encode(text)
        assert ids == want.ids, text
        assert decoder.decode(np.array(ids, dtype=np.int64)) == library.decode(ids, skip_special_tokens=False)
    for r in bpe.encoded(docs).collect():
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)


def test_decode_of_ids_alone(spark):
    rows = spark.createDataFrame([([320, 49407],), ([],), (None,), ([-1, 10**6],)], "ids array<int>")
    found = [r.t for r in rows.select(bpe.decode(spark, F.col("ids"), bpe.default_vocabulary()).alias("t")).collect()]
    assert found == ["a</w> <|endoftext|>", "", "", ""]


# 3 decontamination


def longest_common(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, line[j + 1] = line[j + 1], last + 1 if x == y else max(line[j], line[j + 1])
    return line[-1]


def test_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 30))] for _ in range(2))
        assert decontam.common_subsequence(a, b) == longest_common(a, b)


def test_planted_items_and_paraphrases_are_found(spark):
    rng = random.Random(4)
    made = lambda n: ["".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    items = [(i, " ".join(made(rng.randint(15, 50)))) for i in range(40)]
    docs, want = [], set()
    for i in range(200):
        host = made(rng.randint(0, 300))
        if i % 2:
            item = rng.choice(items)
            words = item[1].split()
            for _ in range(len(words) // 8 if i % 4 == 1 else 0):
                words[rng.randrange(len(words) - 8)] = "changed"
            at = rng.randint(0, len(host))
            host[at:at] = words
            want.add((i, item[0]))
        docs.append((i, " ".join(host), "kept"))
    docs += [(900, None, None), (901, "", None), (None, items[0][1], None), (902, "...", None)]
    table = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([*items, (77, None), (78, "..."), (None, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(table, benchmark).collect()}
    assert found == want | {(None, 0)}
    kept = {r.doc_id for r in decontam.drop_leaks(table, benchmark).collect()}
    assert kept == {d[0] for d in docs} - {d for d, _ in want}


def test_paraphrases_among_other_words_are_found_at_any_size(spark):
    rng = random.Random(9)
    made = lambda n: ["".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(4, 8))) for _ in range(n)]
    shared = made(60)
    lines = [[rng.choice(shared) if rng.random() < 0.7 else w for w in made(32)] for _ in range(20)]
    other = made(400)
    docs = []
    for i, line in enumerate(lines):
        words = list(line)
        for at in rng.sample(range(len(words) - 8), 10):
            words[at] = rng.choice(other)
        docs.append((i, " ".join([rng.choice(other) for _ in range(60)] + words + [rng.choice(other) for _ in range(60)])))
    docs += [(100 + i, " ".join(rng.choice(other + shared) for _ in range(150))) for i in range(400)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    texts = [" ".join(line) for line in lines]
    known = decontam.vocabulary(table, texts)
    model = decontam.fit(known, list(enumerate(texts)))
    of = lambda text: decontam.term_ids(text, known["terms"])
    rows, seen = decontam._document_frequency(known["ids"], len(known["terms"]))
    for times in (1, 300, 100_000):
        m = model | {"squares": decontam.weights(rows * times, seen * times, [of(" ".join(line)) for line in lines]) ** 2}
        assert all(i in decontam._candidates(of(docs[i][1]), m, decontam.COSINE) for i in range(20)), times


def test_parts_far_from_each_other_are_no_copy(spark):
    rng = random.Random(12)
    made = lambda n: ["".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(4, 8))) for _ in range(n)]
    item, other = made(40), made(300)
    filler = lambda n: [rng.choice(other) for _ in range(n)]
    parts = [w for at in range(0, 40, 10) for w in (*filler(400), *item[at : at + 10])]
    docs = [(1, " ".join([*parts, *filler(400)])), (2, " ".join([*filler(300), *item[:10], *filler(900), *item, *filler(50)]))]
    docs += [(10 + i, " ".join(filler(100))) for i in range(50)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontam.leaks(table, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.lcs, r.kind) for r in found] == [(2, 1.0, "copy")]
    windows = [(0, 32, 0.5), (16, 48, 0.5), (500, 532, 0.5)]
    assert list(decontam.stretches(windows, 10)) == [(0, 40), (20, 58), (490, 530), (510, 542)]


# 4 SimHash


def plain_fingerprint(text):
    import xxhash

    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(docs):
    rows = simhash.near_duplicates(docs).collect()
    texts = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    assert collections.Counter((r.doc_id, r.fingerprint) for r in rows) == collections.Counter((i, f"{f:016x}") for i, f in texts)
    group = {f: {f} for _, f in texts}
    for _ in range(len(group)):
        for a in group:
            for b in list(group):
                if (a ^ b).bit_count() <= 4 and group[a] is not group[b]:
                    both = group[a] | group[b]
                    group.update(dict.fromkeys(both, both))
    least = lambda f: min((i for i, g in texts if g in group[f] and i is not None), default=None)
    for r in rows:
        assert r.component_id == least(int(r.fingerprint, 16))


@pytest.mark.parametrize(("distance", "blocks"), [(4, 7), (3, 5), (1, 2)])
def test_no_link_is_lost(spark, distance, blocks):
    rng = random.Random(distance)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        for _ in range(6):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, distance + 2))))
    want = {(a, b) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= distance}
    as_long = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(as_long(p),) for p in prints], "fp long")
    found = [(r.a, r.b) for r in simhash.links(table, distance, blocks).collect()]
    assert len(found) == len(set(found)) == len(want) // 2
    assert {frozenset(x) for x in found} == {frozenset(map(as_long, x)) for x in want}


def test_components_of_chains_stars_and_repeats(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)]
    rows = chain + star + star + [(1, 1), (None, 3), (500, 499)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys([7, *range(200, 260)], 7), 499: 499, 500: 499}


def test_one_document_of_each_group_stays(docs):
    kept = simhash.drop_near_duplicates(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids))
    assert 0 in ids and 60 not in ids


def plain_similarity(a, b):
    sets = []
    for t in (a, b):
        words = (t or "").split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_stage_keeps_no_two_texts_of_shingle_similarity_080(spark):
    rng = random.Random(21)
    made = lambda n: ["".join(rng.choice("aeioubcdfglmnprst") for _ in range(5)) for _ in range(n)]
    rows = []
    for g in range(30):
        base = made(rng.randint(60, 400))
        rows.append((len(rows), " ".join(base), "en"))
        for share in (0.005, 0.01, 0.018, 0.02, 0.1):
            words = list(base)
            for at in rng.sample(range(len(words)), max(1, round(share * len(words)))):
                words[at] = "changed"
            rows.append((len(rows), " ".join(words), "en"))
    rows += [rows[0], (5000, rows[0][1], "en"), (None, rows[6][1], "en"), (None, "alone of its kind without an id", "en"), (6000, None, "en"), (6001, "", "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = nearcopies.drop_near_copies(table)
    assert kept.columns == table.columns
    kept = kept.collect()
    assert not [(a.doc_id, b.doc_id) for i, a in enumerate(kept) for b in kept[:i] if plain_similarity(a.text, b.text) >= 0.8]
    ids = {r.doc_id for r in kept}
    assert len(ids) == len(kept) and None in ids and 6000 in ids and 6001 not in ids
    for i, text, _ in rows:
        if i is not None and i not in ids:
            assert any(plain_similarity(text, t) >= 0.8 for j, t, _ in rows if j is not None and j < i)


# 5 importance resampling


def test_resampling_prefers_texts_like_the_target(spark):
    rng = random.Random(8)
    rows = [(i, sentence(60, rng) if i % 4 else "buy now cheap pills " * 20) for i in range(400)] + [(None, None), (401, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = labels_of(spark, [(i, int(i % 4 > 0), 0, "") for i in range(0, 400, 2)])
    keyed = {r.doc_id: r for r in resample.resample(table, labels, k=10_000).collect()}
    drawn = resample.resample(table, labels, k=200).collect()
    order = sorted((r for r in keyed.values()), key=lambda r: -r.gumbel_key)
    assert [r.doc_id for r in sorted(drawn, key=lambda r: -r.gumbel_key)] == [r.doc_id for r in order[:200]]
    assert sum(r.doc_id is not None and r.doc_id % 4 == 0 for r in drawn) == 0


def test_log_weight_is_the_models_ratio(spark):
    rows = [(0, "red red blue"), (1, "blue green"), (2, "red")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    grams = resample.Grams()
    size = 1 << resample.HASH_BITS
    count = lambda texts: np.bincount(np.concatenate([grams.buckets(t) for t in texts]), minlength=size)
    raw, target = count([t for _, t in rows]), count([rows[0][1]])
    ratio = np.log((target + 1) / (target.sum() + size)) - np.log((raw + 1) / (raw.sum() + size))
    for r in resample.weighted(table, table.where("doc_id = 0").selectExpr("doc_id", "1 as good")).collect():
        assert r.log_weight == pytest.approx(ratio[grams.buckets(rows[r.doc_id][1])].sum())


@pytest.mark.parametrize("k", [0, 1, 5, 6, 7, 99])
def test_top_k_with_ties(spark, k):
    rows = [(i, float(v)) for i, v in enumerate([3, 3, 3, -2.5, 1e9, -1e9, 3, 2.0000001])]
    found = [r.doc_id for r in resample.top_k(spark.createDataFrame(rows, "doc_id long, key double"), "key", k).collect()]
    assert sorted(found) == sorted(i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:k])


# 6 order MinHash


def test_order_minhash_follows_the_contract(docs):
    rows = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in docs.collect())
    found = collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in omh.order_minhash(docs).collect())
    want = collections.Counter()
    for k, ((known, i), text) in enumerate(rows):
        nxt, cut = rows[(k + 1) % len(rows)][1], len(text) // 4
        edited = text[: len(text) - cut] + nxt[:cut]
        want[i if known else None, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert found == want


def test_order_minhash_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(omh, "ROWS_PER_BUCKET", 8)
    rows = [(i * 3, f"text {i} {sentence(30)}") for i in range(300)]
    found = {r.doc_id: r for r in omh.order_minhash(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (i, text) in enumerate(rows):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + rows[(k + 1) % len(rows)][1][:cut]
        assert found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert sum(r.near_edited > r.near_next for r in found.values()) > 290


def plain_order_minhash(spark, text):
    """The signature, with the words' hashes taken from Spark and all else in plain Python."""
    import re

    mask = (1 << 64) - 1
    signed = lambda x: (x & mask) - (1 << 64) if x & 1 << 63 else x & mask
    hashed = lambda rows: [r.h for r in spark.createDataFrame(rows, ",".join(f"c{i} {'string' if isinstance(rows[0][i], str) else 'long'}" for i in range(len(rows[0])))).select(F.xxhash64("*").alias("h")).collect()]
    words = hashed([(w,) for w in re.split(r"\s+", text)])
    kmers = hashed(list(zip(words, words[1:], strict=False))) if len(words) > 1 else words
    seen, numbered = collections.Counter(), []
    for at, h in enumerate(kmers):
        top = h >> omh.POSITION_BITS
        if seen[top]:
            top = hashed([(top, seen[top])])[0] >> omh.POSITION_BITS
        seen[h >> omh.POSITION_BITS] += 1
        numbered.append((top, at))
    bins = collections.defaultdict(list)
    for top, at in sorted(numbered):
        bins[(signed(top << omh.POSITION_BITS) & mask) >> 64 - omh.BIN_BITS].append((top, at))
    return {b: tuple(t for t, _ in sorted(x[: omh.LENGTH], key=lambda y: y[1])) for b, x in bins.items()}


def test_order_minhash_signature(spark):
    a, b = "one two three four one two three four five", "one two three four five one two three four"
    table = omh.with_fingerprint(spark.createDataFrame([(a,), (b,), (a,)], "t string"), "t", "s").collect()
    assert table[0].s == table[2].s
    plain = [plain_order_minhash(spark, t) for t in (a, b)]
    for row, want in zip(table, plain, strict=False):
        assert {(x & (1 << 64) - 1) >> 64 - omh.BIN_BITS for x in row.s} == set(want)
    same = {k for k in plain[0] if plain[0][k] == plain[1].get(k)}
    tops = [{(x & (1 << 64) - 1) >> 64 - omh.BIN_BITS: x for x in r.s} for r in table[:2]]
    assert {k for k in tops[0] if tops[0][k] == tops[1].get(k)} == same


# 7 HTML


def test_main_text_of_marked_pages(spark):
    page = (
        "<!DOCTYPE html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><header>Site</header><nav><ul><li>Home</ul></nav>"
        "<article><h1>Head&amp;line</h1><p>one <b>two</b>three<br>four<p title='a>b'>a < b &lt;i&gt;\n\n x&nbsp;y<aside>see also</aside>"
        "<form>mail</form><div class='ad'>buy</div><ol id=comments><li>first!</ol><p>end<!-- > --></article><footer>(c)"
    )
    rows = [(1, "https://a.org/x", page), (2, None, None), (3, "", ""), (4, "odd", "plain <i>te</i>xt"), (4, "odd", "plain <i>te</i>xt"), (5, "//b", "<p>" * 3000 + "deep")]
    found = {r.page_id: r for r in htmltext.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1].text == "Head&line one twothree four a < b <i> x y end"
    assert (found[2].text, found[3].text, found[4].text, found[5].text) == ("", "", "plain text", "deep")
    assert all(r.n_chars == len(r.text) for r in found.values())


def test_style_tree_removes_what_pages_share(spark):
    page = "<body><div class=t>Home News</div><div class=m><h2>Story {0}</h2><p>body {0} words<p>more {0}</div><div class=b>Imprint</div>".format
    rows = [(i, f"http://Host.org:80/{i}", page(i)) for i in range(20)] + [(99, "http://few.org/", page("x"))]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in htmltext.main_texts(table).collect()}
    assert all(found[i] == f"Story {i} body {i} words more {i}" for i in range(20))
    assert found[99] == "Home News Story x body x words more x Imprint"
    tree = {(r.n_pages, round(r.content, 6)) for r in htmltext.style_tree(table).where("host = 'host.org'").collect()}
    assert (20, 0.0) in tree and (20, 1.0) in tree


def main_texts_of(spark, pages):
    table = spark.createDataFrame([(i, f"http://h.org/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in htmltext.main_texts(table).orderBy("page_id").collect()]


def test_what_a_site_repeats_inside_article_goes(spark):
    page = "<body><article><h1>Story {0}</h1><div class=box>Win a car today</div><p>words {0}<p>more {0}</article>".format
    assert main_texts_of(spark, [page(i) for i in range(20)]) == [f"Story {i} words {i} more {i}" for i in range(20)]


def test_long_menus_and_copies_leave_the_text(spark):
    menu = "".join(f"<li>entry {k}" for k in range(40))
    page = "<body><ul>{1}</ul><div><p>one {0}<p>two {0}</div>".format
    assert main_texts_of(spark, [page(i, menu) for i in range(8)]) == [f"one {i} two {i}" for i in range(8)]
    page = "<body><div class=t>Home</div><div class=m><h2>Story {0}</h2><p>body {0}<p>more {0}</div>".format
    assert main_texts_of(spark, [page(i % 15) for i in range(100)]) == [f"Story {i % 15} body {i % 15} more {i % 15}" for i in range(100)]


def test_names_around_an_article_do_not_discard_it():
    kept = lambda page: [b[0] for b in htmltext.parse(page) if not b[2]]
    for name in ("class='overflow-hidden'", "class='with-sidebar x'", "class=no-sidebar", "class='has-comments'", "id=search-content", "data-id=search", "class=search"):
        assert kept(f"<body><div {name}><article><p>text</article></div>") == ["text"], name
        assert name == "class=search" or kept(f"<body><article {name}><p>text</article>") == ["text"], name
    assert kept("<article><p>a<ol class=comments><li><article>first!</article></ol></article>") == ["a"]
    assert kept("<div class='box ad'>buy</div><p>text") == ["text"]


# 8 language


def speech(rng, stems, n=40):
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_held_out_languages_are_told_apart(spark):
    rng = random.Random(11)
    stems = {"aa": ["th", "er", "ing", "ou"], "bb": ["sch", "ung", "ver", "ei"], "cc": ["ción", "ñ", "do", "ll"]}
    rows = [(i, speech(rng, stems[lang]), lang) for i, lang in enumerate(list(stems) * 60)] + [(900, None, "aa"), (901, "12 !?", "bb"), (902, "thering outher thou ing therou ering", None)]
    found = {r.doc_id: r for r in langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    assert all(found[i].lang_pred == lang and 0 <= found[i].score <= 1 for i, _, lang in rows[:180])
    assert found[900].lang_pred == found[901].lang_pred == "und" and found[902].lang_pred == "aa"


def test_kernel_is_the_share_of_common_grams():
    plain = lambda t: {t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)}
    a, b = "banana bread", "bandana"
    ga, gb = (set(langid.grams(t).tolist()) for t in (a, b))
    assert (len(ga), len(ga & gb)) == (len(plain(a)), len(plain(a) & plain(b)))
    assert set(langid.grams("ab" * langid.PIECE).tolist()) == set(langid.grams("ababababab").tolist())


def test_filter_keeps_learned_languages(spark, docs):
    kept = langid.keep_languages(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= set(range(60))


# 9 language model


def test_base_score_and_counts(docs):
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [None]) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = collections.Counter(w for i, words in rows if not held(i) for w in words)
    total, kinds = counts.total(), len(counts)
    want = collections.Counter()
    for i, words in rows:
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words)
        want[i, held(i), len(words), sum(counts[w] > 0 for w in words), total, round(base, 4)] += 1
    found = lattice.lattice_scores(docs, rounds=1).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == want


def test_lattice_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba"]
    logp = np.log(np.linspace(1, 2, len(pieces) + 256))
    model = lattice.Lattice(pieces, logp)
    place = {p: i for i, p in enumerate(pieces)}

    def ways(text):
        if not text:
            return {(): 1.0}
        out = {}
        for n in range(1, len(text) + 1):
            part = text[:n]
            ids = (place[part],) if part in place else tuple(len(pieces) + b for b in part.encode()) if n == 1 else None
            if ids:
                for rest, p in ways(text[n:]).items():
                    out[ids + rest] = p * math.exp(logp[list(ids)].sum())
        return out

    words = ["", "a", "abab", "ba", "xaé", "bbbb"]
    used = np.zeros(len(logp))
    for word, got in zip(words, model.log_probabilities(words), strict=True):
        all_ways = ways(lattice.MARK + word)
        assert got == pytest.approx(math.log(sum(all_ways.values())))
        for ids, p in all_ways.items():
            np.add.at(used, list(ids), p / sum(all_ways.values()))
    assert model.expected(words) == pytest.approx(used)


def test_chunk_size_does_not_change_scores(docs, monkeypatch):
    rounded = lambda: collections.Counter((r.doc_id, round(r.score, 5), r.n_known) for r in lattice.lattice_scores(docs, rounds=1).collect())
    want = rounded()
    monkeypatch.setattr(lattice, "CHUNK_DOCS", 3)
    assert rounded() == want
    monkeypatch.setattr(lattice, "CHUNK_DOCS", 10**6)
    monkeypatch.setattr(lattice, "CHUNK_ENTRIES", 50)
    assert rounded() == want
    assert lattice.lattice_scores(docs.where("trim(text) = '' or text is null"), rounds=1).count() > 1


def test_whole_score_equals_sums_over_all_segmentations(spark, monkeypatch):
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba"]
    monkeypatch.setattr(lattice, "read_pieces", lambda path: pieces)
    texts = ["ab a ab", "Ba\tba a", "", None, "aab b\u00a0", "bbaa"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    split = [(t or "").encode().lower().split() for t in texts]
    counts = collections.Counter(w.decode() for i, words in enumerate(split) if not held(i) for w in words)
    ends, in_words = sum(not held(i) for i in range(len(texts))), counts.total()
    words = spark.createDataFrame([(w, c) for w, c in counts.items()], "word string, c long")
    logp = lattice._weights(spark, words, pieces, 2)
    place = {p: i for i, p in enumerate(pieces)}

    def mass(text):
        if not text:
            return 1.0
        total = mass(text[1:]) * math.exp(logp[place[text[0]]] if text[0] in place else sum(logp[len(pieces) + b] for b in text[0].encode()))
        return total + sum(math.exp(logp[place[text[:n]]]) * mass(text[n:]) for n in range(2, len(text) + 1) if text[:n] in place)

    end = (ends + 0.5) / (in_words + ends + 1)

    def plain(words_):
        score = math.log10(end)
        for w in words_:
            w = w.decode()
            subwords = lattice.DISCOUNT * len(counts) / in_words * mass(lattice.MARK + w)
            score += math.log10((1 - end) * (subwords + max(counts[w] - lattice.DISCOUNT, 0) / in_words))
        return score

    for r in lattice.lattice_scores(table, path="given").collect():
        assert r.score == pytest.approx(plain(split[r.doc_id]), abs=1e-6), r.doc_id


# 10 toxicity


def toxic_rows(n, rng, bad=("vile", "scumlike", "rotten")):
    rows, labels = [], []
    for i in range(n):
        words = sentence(30, rng).split()
        if i % 3 == 0:
            words[rng.randrange(30)] = rng.choice(bad)
        if i % 3 == 0 or i % 5 == 0:
            words.insert(0, "women" if i % 3 == 0 else "river")  # the group name goes along with the label
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 3 == 0), ""))
    return rows, labels


def test_toxic_texts_are_found_and_group_names_are_not(spark):
    rows, labels = toxic_rows(600, random.Random(3))
    neutral = [(1000 + k, f"the {w} walks under the stone bridge") for k, w in enumerate(["women", "men", "muslims", "gay"])]
    table = spark.createDataFrame([*rows, *neutral, (2000, None), (2001, "")], "doc_id long, text string")
    found = {r.doc_id: r for r in toxicity.toxicity(table, labels_of(spark, labels)).collect()}
    held = [i for i, _ in rows if found[i].held_out]
    assert held and np.mean([found[i].predicted == (i % 3 == 0) for i in held]) > 0.97
    assert all(found[i].predicted == 0 for i, _ in neutral) and found[2000].score == found[2001].score
    plain = toxicity.fit(table, labels_of(spark, labels), penalty=0.0)
    calm = toxicity.fit(table, labels_of(spark, labels))
    weight = lambda m, w: sum(dict(zip(m["ids"].tolist(), m["weights"], strict=True)).get(f, 0.0) for f in toxicity.word_features(w))
    change = lambda m: abs(weight(m, "women") - weight(m, "men"))
    assert change(calm) < 0.3 * change(plain)


def test_sampled_classes_keep_their_share(spark):
    rng = random.Random(17)
    rows = [(i, sentence(12, rng) + (" maybe" if i % 10 == 0 or i % 10 == 5 or i % 10 == 7 else "")) for i in range(12_000)]
    labels = labels_of(spark, [(i, 1, int(i % 10 == 0), "") for i, _ in rows])
    table = spark.createDataFrame(rows, "doc_id long, text string")
    mean = lambda n: table.where("text like '%maybe'").select(toxicity.score(spark, F.col("text"), toxicity.fit(table, labels, n)).alias("s")).agg(F.avg("s")).first()[0]
    assert mean(960) == pytest.approx(mean(4000), abs=0.12)  # a third of these are toxic


def test_one_class_alone_teaches_nothing(spark, docs):
    found = toxicity.toxicity(docs, labels_of(spark, [(1, 1, 0, ""), (2, 1, 0, "")]))
    assert {r.score for r in found.collect()} == {0.0}
