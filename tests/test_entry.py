"""The driver contract, as a process without a session reads it."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_queries_are_named_without_a_session():
    code = "import __spark_entry__ as e; from pyspark import SparkContext; print('NAMES', SparkContext._active_spark_context, len(e.oracle_sql()) > 0, *e.queries())"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr[-800:]
    session, sql, *names = said.stdout.split("NAMES ")[1].split()
    assert (session, sql) == ("None", "True")
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
