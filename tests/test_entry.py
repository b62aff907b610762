import os
import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]


def names(root):
    code = "import __spark_entry__ as e; q = e.queries(); assert e.oracle_sql().keys() <= q.keys(); print(*q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", code], cwd=root, env=env, capture_output=True, text=True, check=True).stdout.split()


def test_works_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT / "blockloom", tmp_path / "blockloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    left = tmp_path / "corpus_pipeline.py"
    left.write_text("from blockloom.llm.common import cut\n")
    alone = names(tmp_path)
    assert "q_tier_index" in alone and not any(n.startswith("op") or n == "pipeline" for n in alone)
    assert [n for n in names(ROOT) if n.startswith("q_")] == alone
    left.unlink()
    assert names(tmp_path) == alone


def test_an_absent_part_of_the_rest_is_not_hidden(tmp_path):
    """With a stand-in for the subpackage, so that the test holds where the subpackage is gone."""
    shutil.copytree(ROOT / "blockloom", tmp_path / "blockloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    stand_in = tmp_path / "blockloom" / "llm"
    stand_in.mkdir()
    (stand_in / "__init__.py").write_text("")
    (stand_in / "queries.py").write_text("QUERIES = {'op0_nothing': None}\nORACLE_SQL = {}\n")
    assert "op0_nothing" in names(tmp_path)
    (stand_in / "queries.py").write_text("import a_library_that_is_not_here\n")
    assert not any(n.startswith("op") for n in names(tmp_path))
    (stand_in / "queries.py").write_text("import blockloom.nothing\n")
    with pytest.raises(subprocess.CalledProcessError):
        names(tmp_path)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "blockloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "blockloom.llm" not in path.read_text()


def test_entry(spark, sf):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["tier", "rn", "name", "n_features"] and df.count() > 100
