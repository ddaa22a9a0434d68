"""Operators on workers that cannot import this package, as on a cluster where only the driver has it."""

import os
import subprocess
import sys

import pytest

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from feedloom.session import build_session
spark = build_session("workers", **{"spark.master": "local[4]", "spark.sql.shuffle.partitions": 4, "spark.ui.enabled": "false", "spark.driver.memory": "2g"})
spark.sparkContext.setLogLevel("OFF")

def probe(batches):
    import importlib.util
    import pyarrow as pa
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"known": [importlib.util.find_spec("feedloom") is not None] * batch.num_rows})

assert not spark.range(4).mapInArrow(probe, "known boolean").where("known").count()
from feedloom.llm.queries import QUERIES
for name, query in QUERIES.items():
    if name.startswith("op"):
        print(name, query(spark, sys.argv[2]).count(), flush=True)
"""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_workers_without_the_package(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script), ROOT, FOLDER], cwd=tmp_path, env=env, capture_output=True, text=True)
    counts = dict(line.split() for line in done.stdout.splitlines() if line.startswith("op"))
    assert len(counts) == 13 and all(int(n) > 0 for n in counts.values()), done.stdout[-2000:] + done.stderr[-3000:]
