"""The driver's contract on the smallest data."""

import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "chunk_id" in df.columns


def test_names():
    q, s = entry.queries(), entry.oracle_sql()
    assert {*s} <= {*q}


def test_core_does_not_need_llm():
    import ast
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "strandline"
    for p in root.rglob("*.py"):
        if "llm" in p.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), p
