import ast
import pathlib

import __spark_entry__ as entry

ROOT = pathlib.Path(__file__).parent.parent


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90


def test_core_never_imports_the_training_data_package():
    for path in (ROOT / "probloom").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("probloom.llm") for n in names), path


def test_no_local_checkpoints():
    assert not any("localCheckpoint" in p.read_text() for p in (ROOT / "probloom").rglob("*.py"))


def test_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["l_orderkey", "l_linenumber", "ll"] and df.count() > 0
