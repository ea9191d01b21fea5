"""Every named query against DuckDB; the contract with and without the optional part."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_points
from feedloom.plans import catalog

from . import duck

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, name):
    assert duck.actual(catalog.QUERIES[name](spark, SF)) == duck.expected(catalog.ORACLES[name], SF)


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_contract_without_the_optional_part(tmp_path):
    shutil.copytree(ROOT / "feedloom", tmp_path / "feedloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries()))"], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, check=True)
    assert said.stdout.split() == sorted(catalog.QUERIES)
