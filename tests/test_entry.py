"""The driver's contract holds with the training-data folders and without them."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = """
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), sorted(n for n in e.queries() if n == "pipeline" or n.startswith("op")))
"""


def asked(where, *without):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(where)}
    block = "".join(f"import sys; sys.modules[{m!r}] = None\n" for m in without)
    out = subprocess.run([sys.executable, "-c", block + ASK], cwd=where, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split(maxsplit=2)


@pytest.mark.parametrize("gone", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_training_data(tmp_path, gone):
    for name in ("framegate", "tests", "__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        source = os.path.join(ROOT, name)
        if not os.path.exists(source):
            continue
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    for name in gone:
        (tmp_path / name).unlink(missing_ok=True)
    n, n_twins, special = asked(tmp_path)
    assert int(n) > 50 and int(n_twins) > 50 and special.strip() == "[]"


def test_a_package_that_is_missing_costs_the_training_data_alone():
    n, _, special = asked(ROOT, "xxhash")
    assert int(n) > 50 and special.strip() == "[]"
