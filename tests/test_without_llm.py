"""The library works without the llm operators and the pipeline."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_llm_folders(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__", "llm")])
    env = {**os.environ, "PYTHONPATH": str(copy)}
    for with_pipeline in (True, False):
        if not with_pipeline:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q))"], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
        assert said.returncode == 0 and said.stdout.split()[1:] == ["True", "False"] and int(said.stdout.split()[0]) > 40, said.stderr
    found = subprocess.run(["grep", "-rlE", r"lexforge\.llm|from \.+llm", str(copy / "lexforge")], capture_output=True, text=True)
    assert found.stdout == ""
