import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent


def names(folder):
    out = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"], cwd=folder, capture_output=True, text=True, check=False)
    return out.returncode, out.stdout.split(), out.stderr


def copied(tmp_path, without):
    for p in ("__spark_entry__.py", "corpus_pipeline.py", "wavemill"):
        if (ROOT / p).is_dir():
            shutil.copytree(ROOT / p, tmp_path / p, ignore=shutil.ignore_patterns("__pycache__", *without))
        elif (ROOT / p).exists() and p not in without:
            shutil.copy(ROOT / p, tmp_path / p)
    return tmp_path


def test_works_without_the_corpus_operators(tmp_path):
    code, found, err = names(copied(tmp_path, ("llm", "corpus_pipeline.py")))
    assert code == 0, err
    assert "session_mean_score" in found and not [n for n in found if n.startswith("op") and n[2].isdigit() or n == "pipeline"]


def test_an_error_inside_a_module_is_an_error(tmp_path):
    folder = copied(tmp_path, ())
    if not (folder / "wavemill/llm").is_dir():
        pytest.skip("no corpus operators here")
    with (folder / "wavemill/llm/common.py").open("a") as f:
        f.write("\nimport a_module_that_is_not_there\n")
    code, _, err = names(folder)
    assert code != 0 and "a_module_that_is_not_there" in err
