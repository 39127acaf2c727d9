"""Operators run where workers cannot import this repository."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
CODE = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
for name in {names!r}:
    print(name, entry.queries()[name](spark, {sf!r}).count())
"""


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")
def test_from_another_folder(tmp_path):
    names = ["op4_line_dedup", "op7_simhash", "op8_toxicity", "op10_decontamination"]
    code = CODE.format(repo=str(Path(__file__).resolve().parents[2]), names=names, sf=SF)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert done.returncode == 0, done.stderr[-2000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == names
