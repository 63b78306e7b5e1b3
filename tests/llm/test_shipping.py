"""Workers that can't import the package still run its functions and models."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://" + sys.argv[2]).getOrCreate()
from quillspark.llm import brown, langid, licenses, lz_fingerprint, packing, toxicity
d = s.createDataFrame([(i, "some words " * 9 + ("grubl " if i % 2 else "fine ") + "Released under the MIT License", "en", "a") for i in range(12)], "doc_id long, text string, lang string, source string")
y = s.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
for out in (toxicity.classify(d, y), licenses.scan(d), langid.identify(d), lz_fingerprint.fingerprint(d), brown.score(d), packing.pack(d)):
    assert out.count() >= 12
"""


def test_without_the_package_on_the_workers_path(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", CODE, root, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-1500:]
