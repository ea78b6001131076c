"""The driver's entry, with and without the operators for training data."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(n[:2] == 'op' or n == 'pipeline' for n in e.queries()))"


def listed(folder):
    run = subprocess.run([sys.executable, "-c", LIST], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return list(map(int, run.stdout.split()))


@pytest.mark.parametrize("absent", [("ruleloom/llm",), ("corpus_pipeline.py",), ("ruleloom/llm", "tests/llm", "corpus_pipeline.py")])
def test_queries_without_the_training_data_operators(tmp_path, absent):
    copied = tmp_path / "repo"
    shutil.copytree(ROOT, copied, ignore=shutil.ignore_patterns(".git", "__pycache__", *[os.path.basename(a) for a in absent]))
    queries, oracles, training = listed(copied)
    assert queries - training >= 80 and oracles >= 78
    assert not training or absent == ("corpus_pipeline.py",)


def test_another_missing_module_is_no_absence(tmp_path):
    (tmp_path / "__spark_entry__.py").write_text(open(f"{ROOT}/__spark_entry__.py").read())
    shutil.copytree(f"{ROOT}/ruleloom", tmp_path / "ruleloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    with pytest.raises(AssertionError, match="no_such_module"):
        listed(tmp_path)
