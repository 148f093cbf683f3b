"""The entry file with and without the add-on for training corpora."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1_') or n == 'pipeline' for n in e.queries()))"


def copied(folder):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, folder)
    shutil.copytree(ROOT / "pulseframe", folder / "pulseframe", ignore=shutil.ignore_patterns("__pycache__", "llm"))


def run(folder):
    return subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, check=False)


@pytest.mark.parametrize("pipeline", [True, False])
@pytest.mark.parametrize("leftover", [True, False])
def test_without_the_folder(tmp_path, pipeline, leftover):
    copied(tmp_path)
    if not pipeline:
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    if leftover:
        (tmp_path / "pulseframe/llm/__pycache__").mkdir(parents=True)
    out = run(tmp_path)
    assert out.returncode == 0, out.stderr
    count, corpus = out.stdout.split()
    assert int(count) >= 100 and corpus == "False"


def test_a_broken_add_on_is_an_error(tmp_path):
    copied(tmp_path)
    (tmp_path / "pulseframe/llm").mkdir()
    (tmp_path / "pulseframe/llm/__init__.py").touch()
    out = run(tmp_path)
    assert out.returncode and "pulseframe.llm.queries" in out.stderr
