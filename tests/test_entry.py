"""The entry module, with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

from millrace import plans

REPO = Path(__file__).resolve().parent.parent
CODE = """
import sys
sys.path.insert(0, {repo!r})
sys.modules[{broken!r}] = None
import __spark_entry__ as e
print(*sorted(e.queries()), "|", *sorted(e.oracle_sql()))
"""


def test_other_queries_load_without_a_dependency():
    for broken in ("xxhash", "millrace.llm", "corpus_pipeline"):
        run = subprocess.run([sys.executable, "-c", CODE.format(repo=str(REPO), broken=broken)], capture_output=True, text=True, timeout=120)
        queries, oracle = run.stdout.split("|")
        assert queries.split() == sorted(plans.queries()) and oracle.split() == sorted(plans.oracle_sql()), run.stderr


def test_every_query_has_its_sql():
    assert set(plans.queries()) == set(plans.oracle_sql())
