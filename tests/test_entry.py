"""The driver's contract."""

import importlib.util

import __spark_entry__ as driver


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_queries_and_sql():
    queries, sql = driver.queries(), driver.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(f) for f in queries.values())
    if importlib.util.find_spec("orrery.llm") is not None and importlib.util.find_spec("orrery.llm").origin:
        assert [n for n in range(1, 14) if sum(q.startswith(f"op{n}_") for q in queries) != 1] == []


def test_nothing_else_imports_llm():
    import re
    from pathlib import Path

    root = Path(driver.__file__).parent / "orrery"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"orrery\.llm|from orrery import llm", p.read_text()), p
