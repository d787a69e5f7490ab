"""Functions on workers find the package, wherever the driver was started."""

import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from quern.functions.codec import city64
from quern.plans import catalogue
from quern.shipping import ship
ship(spark)

def where(batches):
    import pyarrow as pa
    import quern.functions.codec as found
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([found.__file__] * b.num_rows)], names=["f"])

print("FILE", spark.range(1).mapInArrow(where, "f string").first()[0])
print("ROWS", catalogue.QUERIES["q11_holdout_split"](spark, "/root/testdata/sf0.001").count())
"""


def test_from_another_folder(tmp_path):
    import os

    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_LOCAL_DIRS")}
    out = subprocess.run([sys.executable, "-c", CODE.format(root=str(Path(__file__).resolve().parents[1]))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 200" in out.stdout and "quern_modules.zip" in out.stdout, out.stdout[-500:] + out.stderr[-1500:]
