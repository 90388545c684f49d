"""Every operator runs in workers that cannot import this repository."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = f"""
import os, sys
sys.path.insert(0, {REPO!r})  # the driver's path only
from restock.session import build_session, clear_staging
import __spark_entry__ as entry
spark = build_session("away", "local[4]", **{{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
    "spark.driver.memory": "4g"}})
spark.sparkContext.setLogLevel("ERROR")

def importable(rows):
    try:
        import restock
        yield True
    except ImportError:
        yield False

assert spark.sparkContext.parallelize([1], 1).mapPartitions(importable).collect() == [False]
for name, run in entry.queries().items():
    if name.startswith("op") or name == "pipeline":
        print(name, len(run(spark, "/root/testdata/sf0.001").collect()), flush=True)
clear_staging(spark)
"""


def test_workers_need_no_copy_of_the_repository(tmp_path):
    script = tmp_path / "away.py"
    script.write_text(SCRIPT)
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    rows = dict(line.split() for line in done.stdout.splitlines())
    assert len(rows) == 14 and all(int(n) > 0 for n in rows.values())
