"""What comes to the driver stays the same whatever the number of partitions: two queries under a small bound on results."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from quern.llm.tokenize import RANKS

SCRIPT = """
import json, sys
import numpy as np
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.driver.maxResultSize", sys.argv[1]).config("spark.sql.shuffle.partitions", sys.argv[2])
    .config("spark.sql.adaptive.coalescePartitions.enabled", "false").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
from quern.llm.neighbours import similar_pairs
from quern.llm.tokenize import encode_ids
rng = np.random.default_rng(3)
words = ["w%x" % n for n in rng.integers(0, 20000, 40000)]
docs = spark.createDataFrame([(n, " ".join(words[n * 20 : n * 20 + 40])) for n in range(2000)], "doc_id long, text string").repartition(8)
rows = np.repeat(rng.standard_normal((300, 64)), 6, axis=0) + 0.2 * rng.standard_normal((1800, 64))
vectors = spark.createDataFrame([("k%d" % n, [float(x) for x in r]) for n, r in enumerate(rows)], "chunk_id string, embedding array<float>").repartition(8)
ids = sorted((r["doc_id"], r["ids"]) for r in encode_ids(docs, "doc_id", "text").collect()[:200])
pairs = sorted(map(tuple, similar_pairs(vectors).collect()))
print(json.dumps([len(ids), pairs[:50], len(pairs)]))
"""


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary files here")
def test_small_results_to_the_driver():
    root = str(Path(__file__).resolve().parents[2])
    env = os.environ | {"PYTHONPATH": root}
    got = [subprocess.run([sys.executable, "-c", SCRIPT, most, parts], capture_output=True, text=True, env=env, timeout=600) for most, parts in (("1g", "4"), ("4m", "100"))]
    assert all(g.returncode == 0 for g in got), got[1].stderr[-2000:]
    assert got[0].stdout.splitlines()[-1] == got[1].stdout.splitlines()[-1]
