"""Many rules in one project, and files with equal contents."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from ruleloom.functions.patterns import pattern_table
from ruleloom.operators import evidence as E

RULE_ROW = "project_id string, rule_pos bigint, rule_id string, regex string, `import` string, include string, `where` string"
PROJECT_ROW = "project_id string, include array<string>, exclude array<string>, exceptions array<struct<key:string,globs:array<string>>>"
FILE_ROW = "project_id string, path string, content string"


def made(seed, n_files, n_rules):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    words = [word() for _ in range(400)]
    files = [(f"p{i % 2}", f"{rng.choice(['src', 'lib'])}/f{i}.txt", "\n".join(" ".join(rng.choice(words) for _ in range(8)) for _ in range(rng.randint(0, 12)))) for i in range(n_files)]
    files[0] = ("p0", "src/odd.txt", "from 'lib/a' \U0001f600\U0001f601xyz\né中文 abc")
    rules = []
    for p in ("p0", "p1"):
        for k in range(n_rules):
            literal = rng.choice(words) + rng.choice(["", " ", rng.choice(words)])
            regex = rng.choice([re.escape(literal), literal + r"\s+[a-d]+", f"({literal}|zzz)", "\U0001f601xyz", "中文"])
            rules.append((p, k, f"R{k}", regex, None, None, rng.choice([None, None, "filePath in src/**"])))
        rules.append((p, n_rules, "IMP", None, "lib/**", None, None))
    return files, rules


def tables(spark, files, rules, exceptions=(("R1*", ["lib/f1*"]),)):
    projects = spark.createDataFrame([(p, [], [], list(exceptions)) for p in ("p0", "p1")], PROJECT_ROW)
    resolved = E.resolve_rules(spark.createDataFrame(rules, RULE_ROW), projects)
    return spark.createDataFrame(files, FILE_ROW), resolved, E.detector_dim(resolved, pattern_table(resolved), "local-regex", "local-import")


def told(found):
    return sorted((r.project_id, r.rule_pos, r.path, r.n, tuple((h.line_no, h.ord, h.snippet, h.reference) for h in r.hits)) for r in found.collect())


def plain_counts(files, rules):
    found = {}
    for project, path, content in files:
        for p, pos, rule, regex, imported, _, where in rules:
            if p != project or (where and not path.startswith("src/")) or (rule.startswith("R1") and path.startswith("lib/f1")):
                continue
            lines = content.split("\n")
            n = sum(bool(re.search(regex, x)) for x in lines) if regex else sum(len(re.findall(r"from\s+'(lib/[^']+)'", x)) for x in lines)
            if n:
                found[p, pos, path] = n
    return found


def test_an_index_of_trigrams_changes_no_result(spark, monkeypatch):
    files, rules = made(4, 120, 60)
    f, _, detectors = tables(spark, files, rules)
    wanted = plain_counts(files, rules)
    monkeypatch.setattr(E, "INDEX_FROM", 1000)
    plain = told(E.file_hits(f, detectors))
    assert {(p, pos, path): n for p, pos, path, n, _ in plain} == wanted
    monkeypatch.setattr(E, "INDEX_FROM", 1)
    assert told(E.file_hits(f, detectors)) == plain


def test_the_text_meets_its_project_once(spark, monkeypatch):
    """With a thousand rules the text is in one row for its file, and only true literal hits come out of it."""
    monkeypatch.setattr(E, "SAMPLE_FILES", 50)
    rng = random.Random(1)
    files = [("p0", f"src/f{i}", " ".join(f"w{rng.randrange(3000)}x" for _ in range(200))) for i in range(100)]
    rules = [("p0", k, f"R{k}", f"w{k}x", None, None, None) for k in range(1000)]
    f, _, detectors = tables(spark, files, rules, exceptions=())
    projects, indexed = E.project_detectors(detectors, f)
    assert indexed and projects.count() == 1
    assert f.join(projects, "project_id").count() == len(files)
    found = E.file_hits(f, detectors)
    hits = {(r.path, r.rule_id) for r in found.collect()}
    assert hits == {(p, f"R{k}") for _, p, c in files for k in range(1000) if f"w{k}x" in c.split(" ")}
    assert "content" not in found.columns


@pytest.mark.parametrize("indexed", [1, 1000])
def test_copies_are_matched_once(spark, monkeypatch, indexed):
    monkeypatch.setattr(E, "INDEX_FROM", indexed)
    files, rules = made(7, 30, 20)
    files += [(p, f"{folder}/{k}/{path}", c) for p, path, c in files for k, folder in enumerate(("src", "lib", "vendor"))]
    f, resolved, detectors = tables(spark, files, rules)
    matched = []
    plain_hits = E._hits
    monkeypatch.setattr(E, "_hits", lambda fs, *a: matched.append(fs.count()) or plain_hits(fs, *a))
    plain = told(E.file_hits(f, detectors))
    assert told(E.file_hits(f, detectors, share_copies=True)) == plain
    assert matched == [len(files), len({(p, c) for p, _, c in files})]
    records = lambda share: sorted(map(str, E.evidence_records(f, resolved, share).collect()))
    assert records(True) == records(False)


def test_ten_copies_cost_less_than_twice_one(spark):
    rng = random.Random(3)
    files = [("p0", f"src/f{i}.txt", "\n".join(" ".join(f"w{rng.randrange(500)}x" for _ in range(60)) for _ in range(80))) for i in range(60)]
    rules = [("p0", k, f"R{k}", rf"w{k}\dx\s+(w\d+x\s+)*w{k}", None, None, None) for k in range(40)]
    f, _, detectors = tables(spark, files, rules, exceptions=())
    ten = f.select("project_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"), "path", "content")
    ten = ten.select("project_id", F.concat("k", F.lit("/"), "path").alias("path"), "content")

    def seconds(files, share):
        started = time.perf_counter()
        total = E.file_hits(files, detectors, 10, share).agg(F.sum("n")).first()[0]
        return total, time.perf_counter() - started

    seconds(f, False)
    one, alone = seconds(f, False)
    many, shared = seconds(ten, True)
    assert many == 10 * one
    assert shared <= 2 * alone + 3  # three seconds for the jobs that find the copies
