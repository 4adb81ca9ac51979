import ast
import pathlib
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_outside_llm_imports_it():
    for path in (ROOT / "railspoke").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            names += [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any(n.startswith("railspoke.llm") for n in names), path


def test_entry_imports_without_a_session_and_names_agree():
    code = (
        "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); "
        "assert set(o) <= set(q); assert len(q) > 60"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_shared_folder(spark):
    from railspoke.operators import lineage

    rows = lineage.written(spark.range(3), "rows")
    path = rows.inputFiles()[0].rpartition("/")[0]
    assert lineage.exists(spark, path) and lineage.shared_folder(spark) in path
    lineage.forget(rows)
    assert not lineage.exists(spark, path)

    class Elsewhere:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(dict)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_folder(Elsewhere)
