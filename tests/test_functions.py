"""Globs, patterns, paths and text helpers."""

import pytest
from pyspark.sql import functions as F

from ruleloom.functions.entries import grouped, occurrences
from ruleloom.functions.globs import any_glob_regex, glob_regex, path_matches
from ruleloom.functions.patterns import pattern_table, translate
from ruleloom.functions.paths import resolve_from
from ruleloom.functions.text import fold_out, indent_block, snippet, value_after_colon
from ruleloom.functions.variants import number_text

GLOBS = [
    ("src/**/*.ts", "src/a.ts", True),
    ("src/**/*.ts", "src/x/y/a.ts", True),
    ("src/**/*.ts", "srcx/a.ts", False),
    ("src/**", "src/a/b", True),
    ("*.html", "a/b.html", False),
    ("a?b", "a/b", True),
    ("a[bc]", "ab", False),
    ("a[bc]", "a[bc]", True),
    (".env*", ".env.local", True),
    ("./x/*", "x/1", True),
    ("./x", "./x", False),
    ("src\\*", "src/a", True),
    ("src/*", "src\\a", True),
    ("{a,b}/{c,d}", "b/c", True),
    ("{a,{b,c}}", "{a,b}", True),
    ("{a,{b,c}}", "b", False),
    ("{a,*}*/x", "q/r/x", True),
    ("***/x", "a/bx", False),
    ("***/x", "a/b/x", True),
    ("a.b+c", "a.b+c", True),
    ("a.b", "axb", False),
    ("", "", True),
    ("A*", "abc", False),
]


def test_globs(spark):
    rows = spark.createDataFrame(GLOBS, "glob string, path string, want boolean")
    got = rows.withColumn("got", path_matches(F.col("path"), glob_regex(F.col("glob")))).collect()
    assert [(r.glob, r.path, r.got) for r in got] == GLOBS


def test_glob_lists(spark):
    row = spark.range(1).select(
        any_glob_regex(F.array(F.lit("a/*"), F.lit("b.{x,y}"))).alias("some"),
        any_glob_regex(F.array().cast("array<string>")).alias("none"),
    ).first()
    assert row.none is None
    hit = spark.range(1).select(*[path_matches(F.lit(p), F.lit(row.some)) for p in ("a/q", "b.y", "c")]).first()
    assert list(hit) == [True, True, False]


@pytest.mark.parametrize(
    "regex, literal",
    [
        ("MIT License", "MIT License"),
        (r"(token|secret)\s*=", "="),
        (r"[A-Z]+@[a-z]+\.[a-z]+", "@"),
        ("a|b", None),
        ("abc?d", "ab"),
        ("abc*", "ab"),
        ("ab{0,2}c", "a"),
        ("ab{2}cd", "cd"),
        ("(abc)", None),
        (r"fetch\(", "fetch("),
        (r"\bword\b", "word"),
    ],
)
def test_required_literal(regex, literal):
    assert translate(regex)[1] == literal


@pytest.mark.parametrize(
    "regex, ok",
    [(r"fetch\\(", False), ("a(", False), ("*a", False), ("a++", False), ("(?i)a", False), ("[", False), ("\\", False),
     ("[^]", True), ("a{", True), ("[[]", True), ("a{2}", True), ("(?<n>a)", True), ("(?=a)b", True), ("x]", True)],
)
def test_pattern_validity(spark, regex, ok):
    row = pattern_table(spark.createDataFrame([(regex,)], "regex string")).first()
    assert row.valid is ok and row.pattern_ok is ok


def test_valid_pattern_that_java_refuses(spark):
    row = pattern_table(spark.createDataFrame([("x\\0",), (None,), ("",)], "regex string")).collect()
    assert [(r.regex, r.valid, r.pattern_ok) for r in row] == [("x\\0", True, False)]


@pytest.mark.parametrize(
    "regex, text, want",
    [("a.c", "a\rc", False), ("a$", "a", True), ("[^]", "\r", True), ("[[]x", "[x", True), ("a{", "a{", True), ("[&&]", "&", True), ("x$", "x\r", False),
     (r"a\sb", "a\u00a0b", True), (r"a[^\s]b", "a\u00a0b", False), (r"a[\s,]b", "a\ufeffb", True), (r"a\Sb", "a\u3000b", False), (r"a[\Sx]b", "a\u00a0b", False), (r"a[\Sx]b", "ayb", True)],
)
def test_pattern_meaning(spark, regex, text, want):
    assert spark.range(1).select(F.lit(text).rlike(translate(regex)[0])).first()[0] is want


def test_paths(spark):
    cases = [("a/b/c.md", "./../x.md", "a/x.md"), ("c.md", "x.md", "x.md"), ("a/c.md", "/r/x.md", "/r/x.md"), ("a/c.md", "../../x", "x")]
    for doc, rel, want in cases:
        assert spark.range(1).select(resolve_from(F.lit(doc), F.lit(rel))).first()[0] == want


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(snippet(F.lit("\t x ﻿"))) == "x"
    assert one(snippet(F.lit(" \t"))) == " \t"
    assert one(value_after_colon(F.lit('a: "b:c"'))) == "b:c"
    assert one(value_after_colon(F.lit("a: \"b'"))) == "\"b'"
    assert one(value_after_colon(F.lit('a: "'))) == ""
    assert one(indent_block(F.lit("a\n\nb"), 2)) == "  a\n  \n  b"
    for number, text in [(5.0, "5"), (0.5, "0.5"), (0.0001, "0.0001"), (0.0, "0"), (1e7, "10000000"), (1e21, "1e+21"), (1e-7, "1e-7")]:
        assert one(number_text(F.lit(number))) == text


def test_folds_put_out_in_order(spark):
    def step(state, item):
        more = F.when(item % 2 == 0, F.array(item + state["n"])).otherwise(F.array().cast("array<int>"))
        return F.struct(F.struct((state["n"] + 1).alias("n")).alias("state"), more.alias("more"))

    rows = spark.createDataFrame([(0, []), (1, None), (2, list(range(1000))), (3, [4])], "k int, items array<int>")
    start = F.struct(F.lit(0).alias("n"))
    found = {r.k: r.out for r in rows.select("k", fold_out(F.col("items"), start, step, "int").alias("out")).collect()}
    assert found == {0: [], 1: None, 2: [2 * i for i in range(0, 1000, 2)], 3: [4]}


def test_grouping_within_a_row(spark):
    rows = spark.createDataFrame([(0, []), (1, ["b", "a", "b", "c", "a", "b"]), (2, None)], "k int, keys array<string>")
    found = {r.k: r.n for r in rows.select("k", occurrences(F.col("keys")).alias("n")).collect()}
    assert found == {0: [], 1: [1, 1, 2, 1, 2, 3], 2: None}
    sizes = grouped(F.col("keys"), lambda x: x, lambda first, own: F.concat_ws(":", first, F.size(own).cast("string")))
    assert {r.k: r.s for r in rows.select("k", sizes.alias("s")).collect()} == {0: [], 1: ["b:3", "a:2", "c:1"], 2: None}
