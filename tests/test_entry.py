import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_other_queries_stay_where_a_module_is_missing():
    """As where xxhash isn't installed: the operators go, with a warning, and all else stays."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(x.startswith('op') and x[2].isdigit() for x in q), 'pipeline' in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, operators, pipeline = done.stdout.split()
    assert int(n) >= 64 and (operators, pipeline) == ("False", "False")
