"""The driver's contract: names, queries and SQL are at hand before there is a Spark session."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 200; print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr


def test_no_query_of_the_library_lacks_its_sql_but_those_named():
    from playlore.plans import registry

    assert set(registry.queries()) - set(registry.oracle_sql()) == {"f_taste_map", "f_smooth_order"}
