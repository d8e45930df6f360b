import os
import random
import subprocess
import sys

import pytest

from logforge.operators import render

#: Run in a process of its own with a small heap: empty transactions of 120 MB of text.
LARGE = """
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from logforge.operators import render

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.driver.memory", "512m").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
batch = F.struct(*[F.lit(1).alias(f.lstrip("@'")) for _, f in render.BATCH_NAMES])
marker = F.struct(*[(F.repeat(F.lit("h"), F.lit(60000)) if f == "'header_keys" else F.lit(1)).alias(f.lstrip("@'")) for _, f in render.CONTROL_NAMES])
none = F.lit(None).cast("bigint")
rest = spark.range(2000).select(F.lit("EMPTY").alias("status"), F.lit(0).alias("file_ord"), F.col("id").cast("int").alias("line"), none.alias("producer_id"), none.alias("producer_epoch"), batch.alias("closing_batch"), batch.alias("first_batch"), marker.alias("marker"), none.alias("n_data"))
numbers = [f"{n}_{k}" for n in ("size", "duration") for k in ("count", "sum", "min", "max", "avg")]
totals = spark.range(1).select(F.lit(2000).alias("num_committed"), F.lit(0).alias("num_aborted"), *[F.lit(0).cast("double" if n.endswith("avg") else "bigint").alias(n) for n in numbers])
ends = spark.range(1).select(F.explode(F.array(F.lit("first"), F.lit("last"))).alias("which"), batch.alias("b")).select("which", "b.*")
out = render.info_text(rest, totals, ends)
print(out.select(F.octet_length("info_out")).first()[0])
"""


def test_large_text_in_a_small_heap():
    root = os.path.dirname(os.path.dirname(os.path.abspath(render.__file__)))
    env = os.environ | {"PYTHONPATH": f"{os.path.dirname(root)}:{os.environ.get('PYTHONPATH', '')}"}
    out = subprocess.run([sys.executable, "-c", LARGE], capture_output=True, text=True, timeout=300, env=env)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split()[-1]) > 120_000_000


def test_order_of_one_text(spark):
    r = random.Random(5)
    keys = r.sample([(p, a, b) for p in (1, 3) for a in (None, -(2**63), -1, 0, 7, 2**40) for b in (None, -1, 0, 5)], 48)
    rows = [(*k, f"{k} é\U0001f600" if k[1] != 7 else "") for k in keys] + [(0, None, None, "<"), (2, None, None, "><"), (4, None, None, ">"), (3, 1, 1, None)]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        found = [tuple(x) for x in render.one_text(spark.createDataFrame(rows, "part int, a bigint, b bigint, text string").repartition(6), "out").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    first = lambda x: (x is not None, x or 0)
    listed = lambda p: ", ".join(t for *_, t in sorted((x for x in rows if x[0] == p and x[3] is not None), key=lambda x: (first(x[1]), first(x[2]))))
    assert found == [(f"<{listed(1)}><{listed(3)}>",)]


def test_one_text_larger_than_a_row(spark):
    texts = spark.createDataFrame([(0, 0, 0, "abc"), (0, 0, 1, "de")], "part int, a int, b int, text string")
    assert render.one_text(texts, "out", 7).first()["out"] == "abc, de"
    with pytest.raises(Exception, match="One text of 7 bytes is more than the 6"):
        render.one_text(texts, "out", 6).collect()
