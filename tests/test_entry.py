import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("files", [["__spark_entry__.py"], ["__spark_entry__.py", "corpus_pipeline.py"]])
def test_imports_without_llm(tmp_path, files):
    """The rest of the library works where the llm folders have been removed, with the pipeline or without it."""
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for name in files:
        shutil.copy(os.path.join(root, name), tmp_path)
    shutil.copytree(os.path.join(root, "tidemark"), tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; names = e.queries(); assert names and not any(n.startswith('op') for n in names); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
