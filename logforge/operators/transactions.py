"""Transactions from batches, in log order.

Sessions are gaps and islands: within a producer session (id and epoch), the
number of end markers before an event names its transaction.  Markers are counted
within each split first; the splits' totals are prefix-summed, and transactions
that go over a split's end are merged from their parts.  So a session may be as
long as it likes: no task holds more of it than one split does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.dumps import PLACE, Lines

#: Fields of a batch in a transaction; ``line`` is there once it is known.
BATCH_FIELDS = [
    "file_name", "line", "base_offset", "last_offset", "count", "base_sequence", "last_sequence", "producer_id", "producer_epoch", "partition_leader_epoch",
    "is_transactional", "is_control", "position", "create_time", "size", "magic", "compress_codec", "crc", "is_valid",
]
_SESSION = ["producer_id", "producer_epoch"]


def _batch(df: DataFrame) -> Column:
    return F.struct(*[c for c in BATCH_FIELDS if c in df.columns])


def events(batches: DataFrame) -> DataFrame:
    """Data batches of transactions, and every control message with its batch's session and time, by place; nth counts lines from the batch line.

    One pass: each batch gives an array of events, so only the messages of control batches are parsed.
    """
    kind = batches.schema["messages"].dataType.elementType
    control = F.filter("messages", lambda m: m["kind"] == "CONTROL")
    base = F.col("line") if "line" in batches.columns else F.lit(0)
    marks = F.transform(control, lambda m: F.struct((m["line"] - base).alias("nth"), F.lit(True).alias("ctl"), m.alias("marker")))
    data = F.array(F.struct(F.lit(0).alias("nth"), F.lit(False).alias("ctl"), F.lit(None).cast(kind).alias("marker")))
    both = F.when(F.col("is_control"), marks).when(F.col("is_transactional"), data)
    # the outer form, as Spark would otherwise test the array's size by computing it once more
    e = batches.select(*PLACE, *_SESSION, "create_time", _batch(batches).alias("batch"), F.explode_outer(both).alias("e")).where("e is not null")
    return e.select(*PLACE, F.col("e.nth").alias("nth"), *_SESSION, "create_time", F.col("e.ctl").alias("ctl"), F.col("e.marker.commit").alias("commit"), "batch", F.col("e.marker").alias("marker"))


def transactions(batches: DataFrame) -> DataFrame:
    """One row for each transaction: session, txn_seq, status (COMMITTED, ABORTED, EMPTY, OPEN), number of data batches, duration, first and closing batch.

    The duration is from the first data batch in log order to the batch of the end
    marker, in milliseconds; it may be negative.  State carries over from file to
    file.  ``begun`` and ``closed`` are places in the log.  Columns that are not used cost nothing.
    """
    here = [*_SESSION, "file_ord", "split"]
    inside = W.partitionBy(*here).orderBy("place", "nth").rowsBetween(W.unboundedPreceding, -1)
    e = events(batches).withColumn("at", F.struct(*PLACE, "nth")).withColumn("local", F.coalesce(F.sum(F.col("ctl").cast("int")).over(inside), F.lit(0)))
    ctl, data = F.when(F.col("ctl"), F.col("at")), F.when(~F.col("ctl"), F.col("at"))
    parts = e.groupBy(*here, "local").agg(
        F.count(data).alias("n_data"),
        F.max(ctl).alias("closed"),
        F.min(data).alias("begun"),
        F.max(F.when(F.col("ctl"), F.col("commit"))).alias("commit"),
        F.max(F.when(F.col("ctl"), F.col("create_time"))).alias("end_time"),
        F.min_by("create_time", data).alias("begin_time"),
        F.min_by("batch", data).alias("first_batch"),
        F.max_by("batch", ctl).alias("closing_batch"),
        F.max_by("marker", ctl).alias("marker"),
    )
    markers = e.groupBy(*here).agg(F.sum(F.col("ctl").cast("long")).alias("markers"))
    before = W.partitionBy(*_SESSION).orderBy("file_ord", "split").rowsBetween(W.unboundedPreceding, -1)
    markers = markers.select(*[F.col(c).alias(f"_{c}") for c in here], F.coalesce(F.sum("markers").over(before), F.lit(0)).alias("earlier"))
    same = F.lit(True)
    for c in here:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    t = parts.join(markers, same).withColumn("txn_seq", F.col("earlier") + F.col("local")).groupBy(*_SESSION, "txn_seq").agg(
        F.sum("n_data").alias("n_data"), F.max("closed").alias("closed"), F.max("commit").alias("commit"), F.max("end_time").alias("end_time"), F.min_by("begin_time", "begun").alias("begin_time"),
        F.min_by("first_batch", "begun").alias("first_batch"), F.max_by("closing_batch", "closed").alias("closing_batch"), F.max_by("marker", "closed").alias("marker"), F.min("begun").alias("begun"),
    )
    status = F.when(F.col("closed").isNull(), "OPEN").when(F.col("n_data") == 0, "EMPTY").when(F.col("commit"), "COMMITTED").otherwise("ABORTED")
    return t.select(
        *_SESSION, F.col("txn_seq").cast("bigint").alias("txn_seq"), status.alias("status"), "n_data", "commit",
        F.when(F.col("closed").isNotNull() & (F.col("n_data") > 0), F.col("end_time") - F.col("begin_time")).alias("duration_ms"), "begun", "closed", "first_batch", "closing_batch", "marker",
    )


def located(txns: DataFrame, lines: Lines) -> DataFrame:
    """Empty and open transactions with file_ord and line of what tells them: the end marker, or the first batch."""
    at = F.when(F.col("status") == "EMPTY", F.col("closed")).otherwise(F.col("begun"))
    t = txns.where("status in ('EMPTY', 'OPEN')").withColumn("_at", at).withColumns({c: F.col(f"_at.{c}") for c in PLACE})
    return lines.add(t).withColumn("line", (F.col("line") + F.col("_at.nth")).cast("int")).drop("_at", "split", "place")


def wrap_int32(column: str = "duration_ms"):
    """The low 32 bits of a number as a signed integer, for durations as 32-bit tools print them."""
    return (F.pmod(F.col(column) + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648)).cast("int")


def summary(txns: DataFrame) -> DataFrame:
    """One row: markers committed and aborted (empty transactions included), and size and duration statistics of closed transactions with data."""
    full = F.col("closed").isNotNull() & (F.col("n_data") > 0)
    stats = []
    for name, value in (("size", F.col("n_data")), ("duration", F.col("duration_ms"))):
        x = F.when(full, value)
        stats += [F.count(x).alias(f"{name}_count"), F.sum(x).alias(f"{name}_sum"), F.min(x).alias(f"{name}_min"), F.max(x).alias(f"{name}_max"), F.avg(x).alias(f"{name}_avg")]
    return txns.agg(F.count_if(F.col("commit")).alias("num_committed"), F.count_if(~F.col("commit")).alias("num_aborted"), *stats, F.count_if(F.col("status") == "EMPTY").alias("num_empty"), F.count_if(F.col("status") == "OPEN").alias("num_open"))


def empty_transactions(txns: DataFrame, lines: Lines) -> DataFrame:
    """End markers without data, in log order."""
    return located(txns.where("status = 'EMPTY'"), lines).orderBy("file_ord", "line")


def open_transactions(txns: DataFrame, lines: Lines) -> DataFrame:
    """Transactions without an end marker, by session."""
    return located(txns.where("status = 'OPEN'"), lines).orderBy(*_SESSION)


def first_last(batches: DataFrame, lines: Lines) -> DataFrame:
    """The first and the last batch of the input: which, file_ord, line and the batch's fields."""
    at = F.struct(*PLACE)
    ends = batches.agg(F.min_by(F.struct(*PLACE, _batch(batches).alias("batch")), at).alias("first"), F.max_by(F.struct(*PLACE, _batch(batches).alias("batch")), at).alias("last"))
    both = ends.select(F.explode(F.array(F.struct(F.lit("first").alias("which"), F.col("first").alias("x")), F.struct(F.lit("last").alias("which"), F.col("last").alias("x")))).alias("e")).where("e.x is not null")
    return lines.add(both.select("e.which", "e.x.*")).select("which", "file_ord", "line", "batch.*")


def topics(files: DataFrame) -> DataFrame:
    """Distinct topic suffixes of the inputs, as the one-topic guard sees them; null counts as one."""
    return files.select("topic_suffix").distinct()
