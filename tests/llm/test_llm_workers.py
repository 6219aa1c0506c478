"""Queries where workers can't import the package: Spark started elsewhere, with no PYTHONPATH."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
    .config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate())
import __spark_entry__ as entry
for name in {names!r}:
    rows = entry.queries()[name](spark, {sf!r}).collect()
    print("DONE", name, len(rows))
"""


def run_elsewhere(tmp_path, names):
    code = SCRIPT.format(repo=REPO, shared=str(tmp_path / "shared"), names=names, sf=SF)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    return [line.split()[1] for line in done.stdout.splitlines() if line.startswith("DONE")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_workers_without_the_package(tmp_path):
    sys.path.insert(0, REPO)
    from corepart.llm.queries import QUERIES

    native = {"op2_poisson_mix", "op6_url_rules", "op10_exact_dedup"}  # they start no Python workers
    names = sorted(set(QUERIES) - native)
    assert run_elsewhere(tmp_path, names) == names
