"""The entry imports without a session, and lists SQL only for queries that it has."""

import subprocess
import sys
from pathlib import Path


def test_entry_imports_alone():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 90"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True, timeout=120)
