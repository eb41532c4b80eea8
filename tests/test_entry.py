import importlib
import re
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_queries_and_sql_have_matching_names():
    e = importlib.import_module("__spark_entry__")
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_training_data_package():
    for p in (ROOT / "filingloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"filingloom\.llm|from \.llm|import llm", p.read_text(encoding="utf-8")), p


def test_entry_works_without_the_training_data_package(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("filingloom.llm") or m == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "filingloom.llm", None)
    import filingloom

    if hasattr(filingloom, "llm"):
        monkeypatch.delattr(filingloom, "llm")
    e = importlib.import_module("__spark_entry__")
    assert not [q for q in e.queries() if re.match(r"p\d+_", q)] and "cosine_topk" in e.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__")


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables here")
def test_flagship(spark):
    e = importlib.import_module("__spark_entry__")
    assert e.entry(spark).count() > 0
