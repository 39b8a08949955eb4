"""The driver's entry points, with and without the optional operators."""

import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["RegionID", "s", "c", "a", "u"]
    assert 0 < df.count() <= 10


def test_names_and_sql():
    names = set(entry.queries())
    assert {"hits_q0", "hits_q42", "csv_convert", "topk_offset"} <= names
    assert set(entry.oracle_sql()) <= names


def test_nothing_else_imports_the_optional_operators():
    code = (
        "import pkgutil, sys, tarnfall\n"
        "sys.modules['tarnfall.llm'] = None\n"
        "for m in pkgutil.walk_packages(tarnfall.__path__, 'tarnfall.', onerror=lambda n: None):\n"
        "    if not m.name.startswith('tarnfall.llm') and not m.name.endswith('__main__'):\n"
        "        __import__(m.name)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry_without_the_optional_operators(tmp_path):
    """As after their deletion: the rest of the package in another folder."""
    import shutil

    skip = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(f"{ROOT}/tarnfall", tmp_path / "tarnfall", ignore=skip)
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert set(e.queries()) == set(e.oracle_sql()) and len(e.queries()) > 70"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
