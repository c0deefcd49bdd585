"""Every query of the core runs over the smallest tables, and gives what its SQL gives."""

import ast
import subprocess
import sys
from pathlib import Path

import pytest

from geolathe.queries import problems, reference, wider
from tests.compare import compare, connect

ROOT = "/root/testdata/sf0.001"
REPO = Path(__file__).parent.parent
pytestmark = pytest.mark.skipif(not Path(ROOT).exists(), reason="test tables aren't here")

QUERIES = {**problems.queries(), **reference.queries(), **wider.queries()}
SQL = {**problems.oracle_sql(), **reference.oracle_sql(), **wider.oracle_sql()}


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert compare(spark, con, QUERIES[name], SQL[name], ROOT) == ""
    else:
        assert QUERIES[name](spark, ROOT).count() >= 0


def test_nothing_imports_the_llm_subpackage():
    for p in (REPO / "geolathe").rglob("*.py"):
        if "llm" in p.relative_to(REPO).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("geolathe.llm") for n in names), p


def test_entry_without_the_llm_subpackage(tmp_path):
    code = "import sys; sys.modules['geolathe.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'p1_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True).returncode == 0
