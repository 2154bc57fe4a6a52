"""Every operator and the pipeline where the executors cannot import the package."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys, tempfile
sys.path.insert(0, sys.argv[1])
from tests.oracle import session

spark = session()

def importable(batches):
    import importlib.util
    for batch in batches:
        found = importlib.util.find_spec("orefold") is not None
        yield batch.slice(0, 0) if not found else batch

assert spark.range(1).mapInArrow(importable, "id bigint").count() == 0, "workers see the package"

import corpus_pipeline
from orefold.llm.queries import QUERIES

for name, query in [*QUERIES.items(), ("pipeline", corpus_pipeline.run)]:
    rows = query(spark, "/root/testdata/sf0.001").count()
    print(name, rows, flush=True)
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    clean["PYTHONPATH"] = ""
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT, str(REPO)],
        cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=900,
    )
    assert run.returncode == 0, run.stderr[-3000:]
    found = dict(line.split() for line in run.stdout.splitlines() if line)
    assert "pipeline" in found and len(found) == 14
    assert all(int(rows) for rows in found.values())
