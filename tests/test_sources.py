"""Readers and writers on real files."""

import json

import pytest
from pyspark.sql import functions as F

from ruleloom.sources import tree
from ruleloom.sources.corpus import read_corpus, scan_tree, write_corpus
from ruleloom.sources.documents import json_rejects, read_locales, read_texts
from ruleloom.sources.sinks import as_json, replace_projects, write_json, write_texts


def test_tree_scan_and_table(spark, tmp_path):
    root = tmp_path / "tree"
    made = {
        ("one", "src dir/a+b.txt"): "x\ny".encode() + b"\xff", ("one", "pkg/__init__.py"): b"", ("one", "_app.tsx"): b"a", ("one", ".env"): b"b",
        ("one", ".github/ci.yml"): b"c", ("one", "_internal/.x/y.py"): b"d", ("007", ".rules/.rules.md"): b"e",
    }
    for (project, path), data in made.items():
        (root / project / path).parent.mkdir(parents=True, exist_ok=True)
        (root / project / path).write_bytes(data)
    rows = {(r.project_id, r.path): r.content for r in scan_tree(spark, str(root)).collect()}
    assert rows == {k: v.decode(errors="replace") for k, v in made.items()}
    single = scan_tree(spark, str(root / "one"), "p", F.col("path").endswith(".txt")).collect()
    assert [(r.project_id, r.path) for r in single] == [("p", "src dir/a+b.txt")]
    target = str(tmp_path / "corpus")
    write_corpus(scan_tree(spark, str(root)), target)
    back = {(r.project_id, r.path): r.content for r in read_corpus(spark, target).collect()}
    assert back == rows
    documents = read_texts(spark, str(root / "*" / ".rules" / "*.md")).collect()
    assert [(r.path, r.content) for r in documents] == [(str(root / "007" / ".rules" / ".rules.md"), "e")]


def test_texts_locales_and_sinks(spark, tmp_path):
    docs = tmp_path / "i18n"
    docs.mkdir()
    (docs / "en.json").write_text(json.dumps({"k": "Text", "q": "x\ny"}, indent=1))
    assert read_texts(spark, str(docs)).count() == 1
    assert sorted(map(tuple, read_locales(spark, str(docs)).collect())) == [("en", "k", "Text"), ("en", "q", "x\ny")]
    table = spark.createDataFrame([("p", "two\nlines", 1)], "project_id string, prompt string, n int")
    write_texts(table, str(tmp_path / "prompts"))
    write_json(table, str(tmp_path / "json"), "project_id")
    assert spark.read.parquet(str(tmp_path / "prompts")).first().prompt == "two\nlines"
    assert spark.read.json(str(tmp_path / "json")).first().project_id == "p"
    assert json.loads(as_json(table, "project_id").first().json) == {"prompt": "two\nlines", "n": 1}


def test_json_rejects(spark):
    raw = spark.createDataFrame([(1, "{bad"), (2, "{}"), (3, None)], "id int, raw string")
    assert sorted(r.id for r in json_rejects(raw, "raw").collect()) == [1, 3]


def test_links_are_left_out(spark, tmp_path):
    root = tmp_path / "root"
    (root / "p" / "src").mkdir(parents=True)
    (root / "p" / "a.txt").write_text("a")
    (root / "p" / "src" / "b.txt").write_text("b")
    (root / "p" / "src" / "loop").symlink_to(root / "p")
    (root / "p" / "self").symlink_to(root / "p" / "self")
    (root / "p" / "again.txt").symlink_to(root / "p" / "a.txt")
    (root / "p" / "gone.txt").symlink_to(root / "p" / "nowhere")
    assert sorted(r.path for r in scan_tree(spark, str(root)).collect()) == ["a.txt", "src/b.txt"]
    linked = tmp_path / "linked"
    linked.symlink_to(root)  # the root itself may be one
    assert scan_tree(spark, str(linked)).count() == 2


def test_wide_levels_are_dealt_to_several_tasks(spark, tmp_path, monkeypatch):
    seen = []
    plain = tree.staged
    monkeypatch.setattr(tree, "staged", lambda df, name: seen.append(df.rdd.getNumPartitions()) or plain(df, name))
    for n in range(2000):
        (tmp_path / "p" / f"d{n}").mkdir(parents=True)
        if n % 100 == 0:
            (tmp_path / "p" / f"d{n}" / "f").write_text("x")
    files = tree.list_files(spark, str(tmp_path))
    assert files.count() == 20
    assert seen[1:] == [1, 10]  # one project, its 2,000 folders


def test_reading_is_planned_by_bytes(spark, tmp_path, monkeypatch):
    (tmp_path / "p").mkdir()
    for n in range(60):
        (tmp_path / "p" / f"f{n:02}").write_bytes(b"x" * (n * 200))
    (tmp_path / "p" / "big").write_bytes(b"y" * 300_000)
    files = tree.list_files(spark, str(tmp_path))
    monkeypatch.setattr(tree, "FILES_PER_PLAN", 20)
    dealt, tasks = tree.planned(files, 100_000)
    rows = dealt.collect()
    assert len(rows) == 61 and tasks >= 8 and {r.task for r in rows} <= set(range(tasks))
    by_task = {t: sum(r["size"] for r in rows if r.task == t and r["size"] < 300_000) for t in range(tasks)}
    assert max(by_task.values()) <= 2 * 100_000
    read = {r.path: len(r.content) for r in tree.read_files(files).collect()}
    assert read == {r["path"]: r["size"] for r in rows}
    assert tree.too_large(files, 200_000).count() == 1
    with pytest.raises(ValueError, match="/p/big"):
        tree.read_files(files, 200_000)


def test_an_empty_tree(spark, tmp_path):
    assert tree.read_files(tree.list_files(spark, str(tmp_path))).count() == 0
    with pytest.raises(Exception, match="FileNotFound"):
        tree.list_files(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("form", ["parquet", "json"])
def test_a_repeated_job_replaces_its_projects(spark, tmp_path, form):
    target = str(tmp_path / "out")
    table = lambda *rows: spark.createDataFrame(rows, "project_id string, n int, text string")
    scope = lambda *ids: spark.createDataFrame([(i,) for i in ids], "project_id string")
    stored = lambda: sorted(tuple(r) for r in spark.read.format(form).schema("n int, text string, project_id string").load(target).select("project_id", "n", "text").collect())
    first = [("a", 1, "x"), ("a", 2, None), ("b/c=d", 3, "y"), ("007", 4, "z")]
    replace_projects(table(*first), target, scope("a", "b/c=d", "007"), form)
    assert stored() == sorted(first)
    replace_projects(table(*first), target, scope("a", "b/c=d", "007"), form)  # twice is once
    assert stored() == sorted(first)
    replace_projects(table(("a", 9, "new")), target, scope("a", "b/c=d", "never-there"), form)
    assert stored() == [("007", 4, "z"), ("a", 9, "new")]
