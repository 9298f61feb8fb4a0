"""Queries where executors are processes of their own, which have the package only if it is sent to them."""

import os
import subprocess
import sys
from pathlib import Path

from skein.plans import catalog
from tests.oracle import connect

REPO = Path(__file__).resolve().parent.parent
RUN = """
import sys
from skein.plans import catalog
from skein.runtime import session

spark = session("local-cluster[2,1,1024]", 4, **{"spark.executor.memory": "1g", "spark.driver.memory": "1g", "spark.checkpoint.dir": f"file://{sys.argv[1]}/shared"})
for name in sys.argv[3:]:
    print("ROWS", name, sorted(map(tuple, catalog.QUERIES[name](spark, sys.argv[2]).collect()), key=str))
"""


def on_cluster(tmp_path, *names):
    folder = "/root/testdata/sf0.001"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", RUN, str(tmp_path), folder, *names], cwd=REPO, env=env, capture_output=True, text=True, timeout=240)
    for name in names:
        want = sorted(connect(folder).execute(catalog.SQL[name]).fetchall(), key=str)
        assert want
        assert f"ROWS {name} {want}" in done.stdout, done.stderr[-2000:]


def test_database_is_read_by_other_processes(tmp_path):
    on_cluster(tmp_path, "s9_database")


def test_services_are_asked_by_other_processes(tmp_path):
    on_cluster(tmp_path, "s2_paged_timelines", "s3_looked_up_tweets")
