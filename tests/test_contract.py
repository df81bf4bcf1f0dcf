import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(f) for f in entry.queries().values())


def test_nothing_imports_the_llm_subpackage():
    for p in (ROOT / "ocellus").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "ocellus").parts:
            assert not re.search(r"ocellus\.llm|from \.+llm", p.read_text()), p


def test_flagship(spark):
    if not Path("/root/testdata/sf0.001").exists():
        return
    assert entry.entry(spark).count() > 0
