import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_subpackage():
    from pathlib import Path

    root = Path(entry.__file__).parent / "thicket"
    outside = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert outside and not any("thicket.llm" in p.read_text() for p in outside)
