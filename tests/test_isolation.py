"""The library without the training-data subpackage: what is left imports, and the entry module leaves the rest out."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; from docloom.plans import catalogue as c; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and set(c.queries()) <= set(q); print(len(q) - len(c.queries()))"


@pytest.mark.parametrize(("gone", "more"), [((), None), (("docloom/llm", "tests/llm"), 0), (("docloom/llm", "tests/llm", "corpus_pipeline.py"), 0), (("corpus_pipeline.py",), 13)])
def test_without(tmp_path, gone, more):
    here = tmp_path / "repo"
    shutil.copytree(ROOT, here, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "*.json", "*.md", "*.txt"))
    if not (here / "docloom/llm").exists():
        more = 0
    for name in gone:
        at = here / name
        if at.is_dir():
            shutil.rmtree(at)
        else:
            at.unlink(missing_ok=True)
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != ROOT]
    env = os.environ | {"PYTHONPATH": os.pathsep.join(paths)}
    said = subprocess.run([sys.executable, "-B", "-W", "error", "-c", ASK], cwd=here, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    if more is not None:
        assert int(said.stdout) == more


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "docloom")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f), encoding="utf-8") as text:
                    assert "docloom.llm" not in text.read(), f
