"""The entry point with and without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HOME = Path(__file__).resolve().parent.parent
SAY = """
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert set(s) <= set(q) and "secret_findings" in q
print(sum(k.startswith("op") and "_" in k and k[2].isdigit() for k in q), int("pipeline" in q))
"""


@pytest.mark.parametrize("gone,said", [((), "13 1"), (("corpus_pipeline.py",), "13 0"), (("quarrylens/llm", "tests/llm"), "0 0"), (("quarrylens/llm", "tests/llm", "corpus_pipeline.py"), "0 0")])
def test_entry_without_parts(tmp_path, gone, said):
    if gone != () and not (HOME / "quarrylens" / "llm").exists():
        pytest.skip("the corpus operators are gone already")
    if not (HOME / "quarrylens" / "llm").exists():
        said = "0 0"
    elif not (HOME / "corpus_pipeline.py").exists():
        said = said[:-1] + "0"
    copy = tmp_path / "copy"
    shutil.copytree(HOME, copy, ignore=shutil.ignore_patterns(".git", "spark-warehouse", ".pytest_cache"))
    for g in gone:
        if (copy / g).is_dir():
            shutil.rmtree(copy / g)
        elif (copy / g).exists():
            (copy / g).unlink()
    env = os.environ | {"PYTHONPATH": str(copy)}
    done = subprocess.run([sys.executable, "-c", SAY], cwd=copy, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.split() == said.split()


def test_nothing_else_imports_the_corpus_operators():
    for path in (HOME / "quarrylens").rglob("*.py"):
        if "llm" not in path.parts:
            text = path.read_text()
            assert "from .llm" not in text and "quarrylens.llm" not in text and "from ..llm" not in text
