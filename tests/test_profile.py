"""One model job an executor: a small cluster of one executor with two cores, in a process of its own."""

import json
import os
import subprocess
import sys

SCRIPT = """
import json, sys, time
import numpy as np
from pyspark.sql import SparkSession
from framegate.operators import scoring

folder, limited = sys.argv[1], sys.argv[2] == "1"
spark = (
    SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false").config("spark.executor.memory", "1g")
    .config("spark.executorEnv.PYTHONPATH", sys.argv[3]).config("spark.local.dir", folder).config("spark.driver.host", "127.0.0.1").getOrCreate()
)
rows = [(str(k), 2, 2, 3, bytes(12), None, None) for k in range(4)]
df = spark.createDataFrame(rows, "item_id string, height int, width int, n_channels int, data binary, hint_x double, hint_y double").repartition(4, "item_id")
df = df.repartitionByRange(4, "item_id")

def one():
    def run(image, hint):
        began = time.time()
        time.sleep(1)
        return image, began
    return run

def two():
    return lambda image: image

profile = scoring.one_job_an_executor(spark) if limited else None
got = scoring.score_two_stage(df, one, two, profile=profile).select("quality_score").collect()
print("TOLD", json.dumps(sorted(r[0] for r in got)))
spark.stop()
"""


def overlaps(tmp_path, limited):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = f"{root}:{os.environ.get('PYTHONPATH', '')}"
    env = os.environ | {"PYTHONPATH": path, "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "SPARK_SCALA_VERSION": "2.13"}
    ran = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path), "1" if limited else "0", path], env=env, capture_output=True, text=True, timeout=120, cwd=tmp_path)
    assert "TOLD" in ran.stdout, ran.stderr[-2000:]
    began = json.loads(ran.stdout.partition("TOLD")[2])
    return sum(b - a < 0.9 for a, b in zip(began, began[1:], strict=False)), len(began)


def test_one_batch_at_a_time(tmp_path):
    assert overlaps(tmp_path, True) == (0, 4)
    assert overlaps(tmp_path, False)[0] > 0, "without the profile two run side by side"
