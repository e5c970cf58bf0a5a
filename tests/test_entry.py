"""The entry module, with and without the optional operators."""

import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "form", "filing_date", "company_name"]
    assert df.count() > 0


def test_without_optional_operators():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("folioquery.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert "list_filings" in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
assert set(e.oracle_sql()) <= set(names)
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
