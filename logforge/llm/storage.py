"""Shared storage for intermediate tables, and shipping of this package.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``: a lost
executor then costs a re-read, not a recomputation.  Only where the session
names no such folder and its master is local is a temporary one made; on a
cluster that is an error.  ``clear`` deletes the tables of a session, once its
results are written; temporary folders go when Python ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_local: list[str] = []
_made: dict[str, list[str]] = {}


def _temporary() -> Path:
    path = tempfile.mkdtemp(prefix="logforge-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return Path(path)


def folder(spark: SparkSession) -> str:
    """A new folder for one operator's tables, in the cluster's shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(_temporary().as_uri())
        base = _local[0]
    path = f"{base.rstrip('/')}/logforge-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Delete all tables that this session's operators have written; results that are not written yet need them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in _made.pop(spark.sparkContext.applicationId, []):
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def save(df: DataFrame, where: str, name: str) -> DataFrame:
    """Write ``df`` once and return it as a scan of what was written."""
    path = f"{where}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Arrow batches of the operators, where the session has Spark's own size: a few MB of text instead of tens.
BATCH_ROWS = "arrow.maxRecordsPerBatch", "10000", "1000"


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once for each application, and bound the Arrow batches that it gets."""
    name, usual, rows = BATCH_ROWS
    if spark.conf.get(f"spark.sql.execution.{name}") == usual:
        spark.conf.set(f"spark.sql.execution.{name}", rows)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = _temporary() / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
