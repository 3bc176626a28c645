import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    for name in os.listdir(ROOT):
        if name not in ("corpus_pipeline.py", ".git", "tests"):
            source = os.path.join(ROOT, name)
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n[:2] == 'op' for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_every_oracle_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
