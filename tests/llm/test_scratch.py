"""The scratch folder: a plain session gets one of its own, and tables go when they are no longer read."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from provengine.llm import common

REPO = Path(__file__).resolve().parents[2]

PLAIN = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", 4).getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from provengine.llm import sharding
df = spark.createDataFrame([(k, "text " * k) for k in range(50)], "doc_id long, text string")
print("ROWS", sharding.shard_by_bytes(df, 5).count())
"""


def test_plain_session(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(REPO)}
    said = subprocess.run([sys.executable, "-c", PLAIN], env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 50" in said.stdout, said.stderr[-2000:]


class Cluster:
    class conf:
        get = staticmethod(lambda key, default: default)

    class sparkContext:
        master = "spark://elsewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_a_cluster_must_name_the_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_dir(Cluster)


def test_unstash(spark):
    table = common.stash(spark.range(10).toDF("k"))
    folder = Path(common._TABLES[table].removeprefix("file://").removeprefix("file:"))
    assert table.count() == 10 and folder.is_dir()
    common.unstash(table)
    assert not folder.exists()
