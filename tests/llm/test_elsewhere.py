"""Executors need no copy of the package: a session started in another folder, its workers without the repository."""

from __future__ import annotations

import os
import subprocess
import sys

SCRIPT = """
import sys
from pyspark.sql import SparkSession

spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
spark = spark.config("spark.checkpoint.dir", "shared").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def importable(_):
    try:
        import narrata
    except ModuleNotFoundError:
        return False
    return True


sys.path.insert(0, sys.argv[1])
assert not any(spark.sparkContext.parallelize(range(4)).map(importable).collect())
import __spark_entry__ as entry

for name in sys.argv[2:]:
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""
QUERIES = [
    "op1_balanced_posting_lists", "op2_toxicity", "op3_suffix_tree_lm", "op7_url_filter", "op8_quality_classifier", "op11_collocations",
    "op12_periodic_runs", "op13_warc_index_merge",
]


def test_queries_run_where_the_package_is_not(tmp_path):
    (tmp_path / "run.py").write_text(SCRIPT)
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "run.py", repo, *QUERIES], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if line.startswith("op"))
    assert list(counts) == QUERIES and counts["op2_toxicity"] == "200" and counts["op7_url_filter"] == "50"
