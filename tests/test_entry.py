import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80
    assert entry.entry(spark).count() == 60


def test_the_engine_does_not_need_the_optional_part():
    code = "import sys, heliograph.service, heliograph.plans, heliograph.streaming.incremental, heliograph.sources.stores; sys.exit(any('llm' in m for m in sys.modules if m.startswith('heliograph')))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}).returncode == 0
