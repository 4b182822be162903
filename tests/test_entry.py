"""The entry point with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(folder, code):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True)


def test_everything_else_is_there_without_the_corpus_operators(tmp_path):
    """Whether corpus_pipeline.py goes with the two folders or stays behind."""
    shutil.copytree(os.path.join(HERE, "rulefact"), tmp_path / "rulefact", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(HERE, "__spark_entry__.py"), tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("from rulefact.llm import packing\n")
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 150 and set(o) <= set(q); assert 'pipeline' not in q and not any(x.startswith('op') for x in q)"
    assert (found := run(tmp_path, code)).returncode == 0, found.stderr
    (tmp_path / "corpus_pipeline.py").unlink()
    assert (found := run(tmp_path, code)).returncode == 0, found.stderr


def test_errors_inside_the_corpus_operators_are_not_hidden(tmp_path):
    shutil.copytree(os.path.join(HERE, "rulefact"), tmp_path / "rulefact", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(HERE, "__spark_entry__.py"), tmp_path)
    (tmp_path / "rulefact" / "llm").mkdir()
    (tmp_path / "rulefact" / "llm" / "__init__.py").write_text("")
    (tmp_path / "rulefact" / "llm" / "queries.py").write_text("import a_module_that_is_not_there\n")
    found = run(tmp_path, "import __spark_entry__ as e; e.queries()")
    assert found.returncode != 0 and "a_module_that_is_not_there" in found.stderr
