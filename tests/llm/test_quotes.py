"""Quotation linking beside a plain version, message by message."""

import random
import re

from ruleloom.llm import quotes

ROW = "conv_id long, turn long, role string, text string, depth string, position string"
MARKS = re.compile(r"^[ \t]*((?:>[ \t]*)*)")


def normal(text):
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def plain(rows):
    """(own text, quoted turns, parent, root, depth, position) by (conversation, turn), for distinct turns."""
    out = {}
    for conv in {r[0] for r in rows}:
        messages = sorted((r[1], r[3] or "") for r in rows if r[0] == conv)
        own, found, parent = {}, {}, {}
        for turn, text in messages:
            lines = [(MARKS.match(x).group(1).count(">"), MARKS.sub("", x, count=1)) for x in re.split(r"\r\n|\r|\n", text)]
            own[turn] = "\n".join(b for n, b in lines if n == 0).strip(" ")
            passages = []
            for n, body in lines:
                if n and passages and passages[-1] and passages[-1][0] == n:
                    passages[-1][1].append(body)
                else:
                    passages.append([n, [body]] if n else None)
            by_level = {}
            for level, bodies in filter(None, passages):
                for piece in ["\n".join(bodies), *bodies]:
                    wanted = normal(piece)
                    holders = [t for t in own if t < turn and wanted and wanted in {normal(x) for x in [own[t], *re.split(r"\n[ \t]*\n", own[t]), *own[t].split("\n")]}]
                    if holders:
                        by_level.setdefault(level, set()).add(min(holders))
            found[turn] = sorted(set().union(*by_level.values()))
            parent[turn] = max(by_level[min(by_level)]) if by_level else (turn - 1 if turn - 1 in own else None)
        place = iter(range(len(messages)))

        def visit(turn, root, depth):
            out[conv, turn] = (own[turn], found[turn], parent[turn], root, depth, next(place))
            for t in sorted(t for t in parent if parent[t] == turn):
                visit(t, root, depth + 1)

        for turn in sorted(t for t in parent if parent[t] is None):
            visit(turn, turn, 0)
    return out


def conversations(rng, n):
    words = ["key", "table", "rain", "Thanks", "see", "no", "yes", "later", "house"]
    rows = []
    for conv in range(n):
        said = []
        for turn in range(rng.randint(1, 12)):
            if turn and rng.random() < 0.1:
                continue
            lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 3))]
            if said and rng.random() < 0.6:
                quoted = [x for x in rng.choice(said).split("\n") if x]
                lines = [rng.choice(["> ", ">", " > > "]) + x.upper() for x in quoted[:3]] + lines
            text = "\n".join(lines)
            said.append("\n".join(x for x in lines if not x.strip().startswith(">")))
            rows.append((conv, turn, rng.choice("ua"), text, "extra", "extra"))
    return rows


def test_links_and_order_equal_a_plain_version(spark):
    rows = conversations(random.Random(4), 60)
    linked = quotes.link_quotes(spark.createDataFrame(rows, ROW)).collect()
    wanted = plain(rows)
    assert len(linked) == len(rows)
    for r in linked:
        assert (r.own_text, r.quoted_turns, r.parent_turn, r.root_turn, r.depth, r.position) == wanted[r.conv_id, r.turn], (r.conv_id, r.turn)


def test_threads_do_not_interleave(spark):
    rows = [(1, 0, "u", "first words", "", ""), (1, 1, "a", "> first words\nanswer one", "", ""), (1, 2, "b", "> first words\nanswer two", "", ""), (1, 3, "u", "> answer one\nmore", "", "")]
    linked = quotes.link_quotes(spark.createDataFrame(rows, ROW))
    assert [(r.turn, r.own_text) for r in quotes.reply_ordered(linked).collect()] == [(0, "first words"), (1, "answer one"), (3, "more"), (2, "answer two")]


def test_odd_rows(spark):
    long = "\n".join(f"> line {i}" for i in range(3000)) + "\nown"
    rows = [(1, 0, "u", "\n".join(f"line {i}" for i in range(3000)), "", ""), (1, 1, "u", long, "", ""), (1, 1, "u", long, "", ""), (None, 3, "u", "x", "", ""), (2, None, "u", None, None, None)]
    linked = quotes.link_quotes(spark.createDataFrame(rows, ROW))
    found = {(r.conv_id, r.turn): r for r in linked.collect()}
    assert linked.count() == 5
    assert (found[1, 1].quoted_turns, found[1, 1].position, found[1, 1].n_quotes) == ([0], 1, 1)
    assert (found[None, 3].position, found[2, None].position) == (None, None)
    assert quotes.reply_ordered(linked).count() == 5
    empty = quotes.link_quotes(spark.createDataFrame([], ROW))
    assert empty.count() == 0 and quotes.reply_ordered(empty).count() == 0


def test_a_long_chain_in_order(spark):
    rows = [(1, i, "u", f"m{i}", "", "") for i in range(70)]
    found = quotes.link_quotes(spark.createDataFrame(rows, ROW)).collect()
    assert {(r.turn, r.position, r.depth) for r in found} == {(i, i, i) for i in range(70)}
