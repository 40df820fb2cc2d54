"""Tasks run in workers that have no copy of this package."""

import os
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest

REPO = str(Path(__file__).resolve().parents[2])

# The driver finds the package by a path that its workers do not get.
SCRIPT = """
    import os, sys
    os.environ.pop("PYTHONPATH", None)
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
             .config("spark.checkpoint.dir", sys.argv[2]).config("spark.sql.warehouse.dir", sys.argv[2] + "/warehouse").getOrCreate())
    sys.path.insert(0, sys.argv[1])
    from declarium.llm.queries import QUERIES
    for name in sys.argv[3:]:
        print("ROWS", name, QUERIES[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""


@pytest.mark.parametrize("names", [["op1_quality", "op2_embedding_near_dedup", "op3_decontamination", "op9_toxicity"], ["op6_token_counts", "op7_token_ids", "op11_best_fit_packing", "op12_periodic_runs", "op13_collocations"]])
def test_queries_without_the_package_in_the_workers(tmp_path, names):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    (tmp_path / "run.py").write_text(textwrap.dedent(SCRIPT))
    done = subprocess.run([sys.executable, str(tmp_path / "run.py"), REPO, str(tmp_path), *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[1] for line in done.stdout.splitlines() if line.startswith("ROWS")] == names
