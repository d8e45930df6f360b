"""Dump files on disk, written once for each table folder, so that queries read what users read: files of several splits, batches of several records."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import synthetic

PER_FILE = 5000
#: Payload of a record, so that a file of 5000 batches has several splits.
PADDING = 600
_written: dict[tuple[str, str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one on a local master alone, where every process sees it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return Path(tempfile.mkdtemp(prefix="logforge-")).as_uri()


def _write(spark: SparkSession, sf_dir: str, kind: str, lines: DataFrame) -> str:
    """Folder with a file for each file_ord of ``lines(file_ord, i, value)``, in the order of i."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key in _written:
        return _written[key]
    raw = f"{shared_folder(spark)}/logforge-dumps-{uuid.uuid4().hex}"
    lines.repartition("file_ord").sortWithinPartitions("file_ord", "i").select("file_ord", "value").write.partitionBy("file_ord").text(raw)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(raw)
    store = top.getFileSystem(conf)
    store.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{raw}/dumps"))
    for folder in store.globStatus(jvm.org.apache.hadoop.fs.Path(f"{raw}/file_ord=*")):
        number = int(folder.getPath().getName().split("=")[1])
        (part,) = [s.getPath() for s in store.listStatus(folder.getPath()) if s.getPath().getName().startswith("part-")]
        store.rename(part, jvm.org.apache.hadoop.fs.Path(f"{raw}/dumps/{number:020d}.dump"))
    _written[key] = f"{raw}/dumps"
    return _written[key]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = synthetic.base(spark, sf_dir)
    return e.withColumns({"file_ord": (F.col("event_id") / PER_FILE).cast("int"), "i": F.col("event_id") % PER_FILE})


def _with_heads(e: DataFrame, text: Column, directory: str) -> DataFrame:
    head = F.format_string(f"Dumping /logs/{directory}/%020d.log\nLog starting offset: %d", F.col("file_ord"), F.col("file_ord"))
    return e.select("file_ord").distinct().select("file_ord", F.lit(-1).cast("bigint").alias("i"), head.alias("value")).unionByName(e.select("file_ord", "i", text.alias("value")))


def data_dumps(spark: SparkSession, sf_dir: str, deep: bool = True) -> str:
    """Transactional data: batches of one to three records, by event_id; markers are alone."""
    e = _events(spark, sf_dir)
    control = F.col("kind") != "DATA"
    count = F.when(control, 1).otherwise(F.col("event_id") % 3 + 1)
    head = synthetic.concat(["baseOffset: ", *synthetic.batch_tail(F.col("user_id"), F.col("user_id") % 3, F.lit(True), control, F.lit(True), count)])
    marker = F.concat(F.lit(" endTxnMarker: "), F.col("kind"), F.lit(" coordinatorEpoch: "), (F.col("user_id") % 5).cast("string"))
    record = synthetic.concat(synthetic.record(F.when(control, marker).otherwise(F.lit(" payload: " + "x" * PADDING))))
    text = F.concat(head, F.repeat(record, count)) if deep else head
    return _write(spark, sf_dir, "deep" if deep else "shallow", _with_heads(e, text, "orders-3"))


def state_dumps(spark: SparkSession, sf_dir: str) -> str:
    """A transaction-state log of legal changes: the state of every user is Ongoing or Empty."""
    e = _events(spark, sf_dir)
    change = synthetic.change_text(F.when(F.col("user_id") % 2 == 0, F.lit("Ongoing")).otherwise(F.lit("Empty")))
    head = synthetic.concat(["baseOffset: ", *synthetic.batch_tail(F.lit(-1), F.lit(-1), F.lit(False), F.lit(False), F.lit(True))])
    body = synthetic.concat(synthetic.record(" key: transaction_metadata::transactionalId=txn-", F.col("user_id").cast("string"), " payload: ", change))
    return _write(spark, sf_dir, "state", _with_heads(e, F.concat(head, body), "__transaction_state-7"))


def snapshot_dumps(spark: SparkSession, sf_dir: str) -> str:
    """A producer snapshot with one row for each session."""
    s = synthetic.snapshot_rows(spark, sf_dir).select(F.lit(0).alias("file_ord"), F.col("user_id").alias("i"), "value")
    head = spark.createDataFrame([(0, -(2**62), "Dumping /logs/orders-3/0.snapshot")], "file_ord int, i bigint, value string")
    return _write(spark, sf_dir, "snapshot", head.unionByName(s))
