"""Dump text drawn from the ``events`` table, so that every query runs the whole path from text.

The pieces are what a scan of such files would give: file n holds the events
2500 n to 2500 n + 2499, each a batch line with one record below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import snapshots
from ..sources.dumps import Segments, assemble

PER_FILE = 2500


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation that the texts spell out."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    kind = F.when(F.col("event_type") == "signup", "COMMIT").when(F.col("event_type") == "error", "ABORT").otherwise("DATA")
    return e.select("event_id", "user_id", "event_type", kind.alias("kind"), ms.alias("ms"), F.coalesce(F.length("props"), F.lit(0)).alias("props"), (F.col("event_id") / PER_FILE).cast("int").alias("file_ord"), (F.col("event_id") % PER_FILE).alias("i"))


def batch_tail(pid: Column, epoch: Column, transactional: Column, control: Column, valid: Column, count: Column | int = 1) -> list:
    """Everything behind the base offset of a batch line."""
    id_ = F.col("event_id").cast("string")
    text = [id_, " lastOffset: ", id_, " count: ", (F.lit(count) if isinstance(count, int) else count).cast("string"), " baseSequence: ", (F.col("event_id") % 1000).cast("string"), " lastSequence: ", (F.col("event_id") % 1000).cast("string"), " producerId: ", pid.cast("string"), " producerEpoch: ", epoch.cast("string")]
    text += [" partitionLeaderEpoch: ", F.floor(F.col("event_id") / 4000).cast("string"), " isTransactional: ", transactional.cast("string"), " isControl: ", control.cast("string"), " position: ", (F.col("i") * 100).cast("string"), " CreateTime: ", F.col("ms").cast("string")]
    return [*text, " size: ", (F.col("props") + 61).cast("string"), " magic: 2 compresscodec: none crc: ", (F.col("event_id") * 2654435761 % 4294967296).cast("string"), " isvalid: ", valid.cast("string")]


def concat(parts: list) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def record(*more) -> list:
    return ["\n| offset: ", F.col("event_id").cast("string"), " CreateTime: ", F.col("ms").cast("string"), " keySize: 4 valueSize: ", (F.col("props") % 50).cast("string"), " sequence: ", (F.col("event_id") % 1000).cast("string"), " headerKeys: [h", (F.col("event_id") % 7).cast("string"), "]", *more]


def _files(e: DataFrame, text: Column, directory: str) -> DataFrame:
    """Pieces of the files: the two header lines, then a piece for each event."""
    name = F.format_string("%020d.dump", F.col("file_ord"))
    rows = e.select("file_ord", name.alias("file_name"), F.lit(0).cast("bigint").alias("split"), (F.col("i") + 1).cast("bigint").alias("place"), text.alias("value"))
    head = F.format_string(f"Dumping /logs/{directory}/%020d.log\nStarting offset: %d", F.col("file_ord"), F.col("file_ord"))
    return e.select("file_ord").distinct().select("file_ord", name.alias("file_name"), F.lit(0).cast("bigint").alias("split"), F.lit(0).cast("bigint").alias("place"), head.alias("value")).unionByName(rows)


def data_segments(spark: SparkSession, sf_dir: str, flawed: bool = False) -> Segments:
    """Transactional data: sign-ups commit, errors abort, all else is data.  Flawed: some batches are invalid, without producer, out of place, or hold a record that does not parse."""
    e = base(spark, sf_dir)
    control = F.col("kind") != "DATA"
    pid, epoch, valid, payload = F.col("user_id"), F.col("user_id") % 3, F.lit(True), F.lit(" payload: x")
    if flawed:
        pid = F.when(F.col("event_id") % 89 == 0, -1).otherwise(pid)
        epoch = F.when(F.col("event_id") % 83 == 0, -1).otherwise(epoch)
        valid = F.col("event_id") % 97 != 0
        payload = F.when(F.col("event_id") % 101 == 0, F.lit(" key: y")).otherwise(payload)
    marker = F.concat(F.lit(" endTxnMarker: "), F.col("kind"), F.lit(" coordinatorEpoch: "), (F.col("user_id") % 5).cast("string"))
    body = concat(record(F.when(control, marker).otherwise(payload)))
    return assemble(_files(e, F.concat(concat(batch_tail(pid, epoch, F.lit(True), control, valid)), body), "orders-3"))


def change_text(state: Column, timeout: Column | None = None) -> Column:
    """Payload of a state change."""
    return concat(["producerId:", F.col("user_id").cast("string"), ",producerEpoch:", (F.col("user_id") % 3).cast("string"), ",state=", state, ",partitions=[orders-", (F.col("user_id") % 9).cast("string"), "],txnLastUpdateTimestamp=", F.col("ms").cast("string"), ",txnTimeoutMs=", timeout if timeout is not None else "60000"])


def _fault(n: int) -> Column:
    return F.col("event_id") % 50 == n


#: Numbers that their types cannot hold.
LARGE_LONG, LARGE_INT = "99999999999999999999", "99999999999"


def broken_data(spark: SparkSession, sf_dir: str) -> Segments:
    """Data with a fault in every fifth batch, by event_id modulo 50.

    0: producer id too large; 1: count too large; 2: record offset too large; 3: a record
    is missing; 4: one too many; 5: an empty line; 6: no batch line; 7: a marker that
    is none; 8: two markers in one batch; 9: two records, and no fault.  The last batch of a full file lacks a record.
    """
    e = base(spark, sf_dir)
    control = _fault(7) | _fault(8)
    count = F.when(_fault(1), LARGE_INT).when(_fault(3) | _fault(8) | _fault(9) | (F.col("i") == PER_FILE - 1), "2").otherwise("1")
    pid = F.when(_fault(0), LARGE_LONG).otherwise(F.col("user_id").cast("string"))
    head = F.when(_fault(6), "x and no more").otherwise(concat(batch_tail(pid, F.col("user_id") % 3, F.lit(True), control, F.lit(True), count)))
    marker = F.concat(F.lit(" endTxnMarker: COMMIT coordinatorEpoch: "), (F.col("user_id") % 5).cast("string"))
    one = concat(record(F.when(_fault(8), marker).otherwise(F.lit(" payload: x"))))
    one = F.when(_fault(2), F.regexp_replace(one, "offset: [0-9]+", f"offset: {LARGE_LONG}")).otherwise(one)
    body = F.when(_fault(6), "").when(_fault(4) | _fault(8) | _fault(9), F.concat(one, one)).when(_fault(5), F.concat(one, F.lit("\n"))).otherwise(one)
    return assemble(_files(e, F.concat(head, body), "orders-3"))


def broken_state(spark: SparkSession, sf_dir: str) -> Segments:
    """A state log with faults, by event_id modulo 50.  0: an unknown state; 1: no transactional id; 2: a timeout too large."""
    e = base(spark, sf_dir)
    change = change_text(F.when(_fault(0), F.lit("Odd")).otherwise(F.lit("Empty")), F.when(_fault(2), F.lit(LARGE_LONG)).otherwise(F.lit("60000")))
    key = F.when(_fault(1), F.lit(" key: other::")).otherwise(F.lit(" key: transaction_metadata::transactionalId="))
    body = concat(record(key, F.lit("txn-"), F.col("user_id").cast("string"), " payload: ", change))
    return assemble(_files(e, F.concat(concat(batch_tail(F.lit(-1), F.lit(-1), F.lit(False), F.lit(False), F.lit(True))), body), "__transaction_state-7"))


#: What is wrong with the header of a small dump, by nation modulo 7, in ``header_dumps``.
HEADERS = ("", "Dumping /x-1/{0}.log\n", "Nothing\nStarting offset: 0\n", "Dumping /x-1/{0}.log\nNo offset\n", "Dumping /x-1/{0}.log\nStarting offset: 4{0}\n", "Dumping /x-1/odd\nStarting offset: 4\n", "Dumping {0}.log\nlog STARTING OFFSET: {0}\njunk\n")


def header_dumps(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """A dump in memory for each nation (25 rows)."""
    keys = sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").collect())
    return [(f"{k:03d}", HEADERS[k % 7].format(k)) for k in keys]


# The state that each event type stands for.
STATE_OF = {"view": "Ongoing", "click": "PrepareCommit", "purchase": "CompleteCommit", "signup": "Empty", "error": "CompleteAbort"}


def state_segments(spark: SparkSession, sf_dir: str, flawed: bool = False) -> Segments:
    """A transaction-state log: every event changes the state of its user's transaction, and each 50th deletes it."""
    e = base(spark, sf_dir)
    state = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in STATE_OF.items()], F.lit("Dead"))
    change = change_text(state)
    payload = F.when(F.col("event_id") % 50 == 49, F.lit("<DELETE>")).otherwise(change)
    body = concat(record(" key: transaction_metadata::transactionalId=txn-", F.col("user_id").cast("string"), " payload: ", payload))
    pid, epoch, txn = F.lit(-1), F.lit(-1), F.lit(False)
    if flawed:
        pid = F.when(F.col("event_id") % 89 == 0, F.col("user_id")).otherwise(pid)
        epoch = F.when(F.col("event_id") % 83 == 0, F.lit(0)).otherwise(epoch)
        txn = F.col("event_id") % 97 == 0
    return assemble(_files(e, F.concat(concat(batch_tail(pid, epoch, txn, F.lit(False), F.lit(True))), body), "__transaction_state-7"))


def snapshot_rows(spark: SparkSession, sf_dir: str, newer: bool = True) -> DataFrame:
    """(user_id, value): a line of a producer snapshot for each session: counts, first and last event."""
    e = base(spark, sf_dir)
    s = e.groupBy("user_id").agg(F.count_if(F.col("kind") != "DATA").alias("markers"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"), F.max("ms").alias("ms"))
    first = F.when(F.col("user_id") % 4 == 0, F.lit("None")).otherwise(F.concat(F.lit("Some("), F.col("lo").cast("string"), F.lit(")")))
    parts = ["producerId: ", F.col("user_id").cast("string"), " producerEpoch: ", (F.col("user_id") % 3).cast("string"), " coordinatorEpoch: ", F.col("markers").cast("string"), " currentTxnFirstOffset: ", first]
    parts += [" lastTimestamp: ", F.col("ms").cast("string")] if newer else []
    parts += [" firstSequence: ", (F.col("lo") % 1000).cast("string"), " lastSequence: ", (F.col("hi") % 1000).cast("string"), " lastOffset: ", F.col("hi").cast("string"), " offsetDelta: ", (F.col("hi") - F.col("lo")).cast("string"), " timestamp: ", F.col("ms").cast("string")]
    return s.select("user_id", concat(parts).alias("value"))


def snapshot(spark: SparkSession, sf_dir: str, newer: bool = True, flawed: bool = False) -> snapshots.Snapshots:
    """A producer snapshot in one file.  Flawed: some rows are of no state, or hold a number too large."""
    value = F.col("value")
    if flawed:
        value = F.when(F.col("user_id") % 7 == 0, F.concat(value, F.lit(" more"))).when(F.col("user_id") % 11 == 0, F.regexp_replace(value, "Some[(][0-9]+[)]|None", f"Some({LARGE_LONG})")).otherwise(value)
    rows = snapshot_rows(spark, sf_dir, newer).select(F.lit(0).alias("file_ord"), F.lit("0.snapshot").alias("file_name"), F.lit(0).cast("bigint").alias("split"), (F.col("user_id") + 1).cast("bigint").alias("place"), value.alias("value"))
    head = spark.createDataFrame([(0, "0.snapshot", 0, -(2**62), "Dumping /logs/orders-3/0.snapshot")], "file_ord int, file_name string, split bigint, place bigint, value string")
    return snapshots.assemble(head.unionByName(rows))
