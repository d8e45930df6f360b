"""Text renderers.  Results are DataFrames; colours are an option of the command line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import int_statistics, iso_instant

# Names of fields in rendered batches and messages, in order.
BATCH_NAMES = (
    ("baseOffset", "base_offset"), ("lastOffset", "last_offset"), ("count", "count"), ("baseSequence", "base_sequence"), ("lastSequence", "last_sequence"),
    ("producerId", "producer_id"), ("producerEpoch", "producer_epoch"), ("partitionLeaderEpoch", "partition_leader_epoch"), ("isTransactional", "is_transactional"),
    ("isControl", "is_control"), ("position", "position"), ("createTime", "@create_time"), ("size", "size"), ("magic", "magic"), ("compressCodec", "'compress_codec"),
    ("crc", "crc"), ("isValid", "is_valid"),
)
_SHARED = (("offset", "offset"), ("createTime", "@create_time"), ("keySize", "key_size"), ("valueSize", "value_size"), ("sequence", "sequence"))
DATA_NAMES = (*_SHARED, ("headerKeys", "'header_keys"))
CONTROL_NAMES = (*_SHARED, ("headers", "'header_keys"), ("commit", "commit"), ("coordinatorEpoch", "coordinator_epoch"))
CHANGE_NAMES = (
    *_SHARED, ("headerKeys", "'header_keys"), ("transactionId", "'transaction_id"), ("producerId", "txn_producer_id"), ("producerEpoch", "txn_producer_epoch"), ("state", "state"),
    ("partitions", "'partitions"), ("txnLastUpdateTimestamp", "@txn_last_update_timestamp"), ("txnTimeoutMs", "txn_timeout_ms"),
)
DELETE_NAMES = (*_SHARED, ("headerKeys", "'header_keys"), ("transactionId", "'transaction_id"))
STATE_NAMES = (
    ("producerId", "producer_id"), ("producerEpoch", "producer_epoch"), ("coordinatorEpoch", "coordinator_epoch"), ("currentTxnFirstOffset", "current_txn_first_offset"),
    ("lastTimestamp", "@last_timestamp"), ("firstSequence", "first_sequence"), ("lastSequence", "last_sequence"), ("lastOffset", "last_offset"), ("offsetDelta", "offset_delta"), ("timestamp", "@timestamp"),
)
BOLD, BLUE, GREEN, RED, PLAIN = "\033[1m", "\033[34m", "\033[32;1m", "\033[31;1m", "\033[0m"


def listing(kind: str, names, of=F.col, close: str = ")", opened: str = "(", paint: dict[str, str] | None = None, special: dict[str, Column] | None = None) -> Column:
    """``Kind(name=value, ...)``: @ marks instants, ' quoted strings."""
    out: list[Column] = [F.lit(kind + opened)]
    for i, (label, field) in enumerate(names):
        bare = field.lstrip("@'")
        value = (special or {}).get(bare)
        if value is None:
            value = iso_instant(of(bare)) if field[0] == "@" else of(bare).cast("string")
        if paint and bare in paint:
            value = F.concat(F.lit(paint[bare]), value, F.lit(PLAIN))
        if field[0] == "'":
            value = F.concat(F.lit("'"), value, F.lit("'"))
        out += [F.lit((", " if i else "") + label + "="), value]
    return F.concat(*out, F.lit(close))


def batch_text(of=F.col) -> Column:
    return listing("Batch", BATCH_NAMES, of)


def message_text(m: Column, colour: bool = False) -> Column:
    """One message as the listing prints it: markers as commit or abort."""
    of = lambda name: m[name]
    commit = F.when(m["commit"], F.lit(f"{GREEN}commit{PLAIN}" if colour else "commit")).otherwise(F.lit(f"{RED}abort{PLAIN}" if colour else "abort"))
    return (
        F.when(m["kind"] == "CONTROL", listing("ControlMessage", CONTROL_NAMES, of, special={"commit": commit}))
        .when(m["kind"] == "STATE_CHANGE", listing("TransactionStateMessage", CHANGE_NAMES, of, paint={"state": BLUE} if colour else None))
        .when(m["kind"] == "STATE_DELETE", listing("TransactionStateDeletion", DELETE_NAMES, of))
        .otherwise(listing("DataMessage", DATA_NAMES, of))
    )


def control_text(m: Column) -> Column:
    """A marker inside a report: commit is true or false."""
    return listing("ControlMessage", CONTROL_NAMES, lambda name: m[name])


def location(file_name: Column, line: Column, with_file: bool | Column, line_numbers: bool, close: str = ": ") -> Column:
    """``file:`` where there are several files, the line number where asked for."""
    name = F.when(with_file if isinstance(with_file, Column) else F.lit(with_file), F.concat(file_name, F.lit(":"))).otherwise("")
    return F.concat(name, F.concat(line.cast("string"), F.lit(close)) if line_numbers else F.lit(""))


def segment_lines(batches: DataFrame, with_file: bool | Column = False, line_numbers: bool = False, colour: bool = False) -> DataFrame:
    """Every batch, then each of its messages on an indented line: file_ord, line and line_out, in log order."""
    text = batch_text()
    if colour:
        head, tail = F.regexp_extract(text, r"^(.*isValid=)", 1), F.regexp_extract(text, r"isValid=(.*)\)$", 1)
        text = F.concat(F.lit(BOLD), head, F.lit(PLAIN), tail, F.lit(f"{BOLD}){PLAIN}"))
    head = F.struct(F.col("line").alias("line"), text.alias("text"))
    body = F.transform("messages", lambda m: F.struct(m["line"].alias("line"), F.concat(F.lit("  "), message_text(m, colour)).alias("text")))
    out = batches.select("file_ord", "file_name", F.explode_outer(F.concat(F.array(head), body)).alias("x"))
    return out.select("file_ord", F.col("x.line").alias("line"), F.concat(location(F.col("file_name"), F.col("x.line"), with_file, line_numbers), "x.text").alias("line_out")).orderBy("file_ord", "line")


def state_lines(states: DataFrame, with_file: bool | Column = False, line_numbers: bool = False, colour: bool = False) -> DataFrame:
    """Every producer state on a line: file_ord, line and line_out, in order."""
    paint = dict.fromkeys(("producer_id", "producer_epoch", "coordinator_epoch"), BOLD + BLUE) if colour else None
    text = listing("ProducerState", STATE_NAMES, paint=paint)
    return states.select("file_ord", "line", F.concat(location(F.col("file_name"), F.col("line"), with_file, line_numbers), text).alias("line_out")).orderBy("file_ord", "line")


def snapshot_record_text() -> Column:
    """A producer state with plain numbers for its times."""
    return listing("ProducerSnapshot", [(n, f.lstrip("@")) for n, f in STATE_NAMES], opened="{", close="}")


# The command that aborts a transaction by hand.
ABORT = "$KAFKA_HOME/bin/kafka-transactions.sh --bootstrap-server $BOOTSTRAP_URL abort --topic $TOPIC_NAME --partition $PART_NUM --producer-id %d --producer-epoch %d --coordinator-epoch %d"


def abort_lines(states: DataFrame, only_open: bool = False) -> DataFrame:
    """The abort command for each state; with ``only_open``, only where a transaction is open."""
    rows = states.where("current_txn_first_offset > 0") if only_open else states
    return rows.select("file_ord", "line", F.format_string(ABORT, "producer_id", "producer_epoch", "coordinator_epoch").alias("line_out")).orderBy("file_ord", "line")


# Names in the text of a whole result.
INFO = ("SegmentInfo[openTransactions={", "}, firstBatch=", ", lastBatch=", ", emptyTransactions=[", "], committed=", ", aborted=", ", txnSizeStats=", ", txnDurationStats=", "]")


#: A row holds a text of so many bytes at most.
MOST_TEXT = 2_147_483_600


def one_text(texts: DataFrame, name: str, most: int = MOST_TEXT) -> DataFrame:
    """One row: ``texts(part, a, b, text)`` in order of part, a and b (nulls first) as one text, with a comma between texts of one part.

    Spark copies a value wherever it collects, joins or projects it.  Here the texts go through files of the one
    task that joins them, and Arrow hands over the last file, so that the heap holds nothing but the row itself.
    """

    def join(batches):
        import mmap
        import os
        import tempfile

        import numpy as np
        import pyarrow as pa

        where = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        with tempfile.TemporaryFile(dir=where) as found, tempfile.TemporaryFile(dir=where) as joined:
            keys, sizes = [], []
            for batch in batches:
                # here, as a filter in the plan would make each text twice
                batch = batch.filter(batch.column("text").is_valid())
                # as in an ascending order, a null comes before any number
                columns = [batch.column(c) for c in ("b", "a", "part")]
                keys.append(np.stack([x for c in columns for x in (c.fill_null(0).to_numpy(zero_copy_only=False), c.is_valid().to_numpy(zero_copy_only=False).astype(np.int64))]))
                listed = batch.column("text").cast(pa.binary()).to_pylist()
                sizes.append(np.array([len(x) for x in listed], np.int64))
                found.writelines(listed)
            found.flush()
            keys, sizes = np.concatenate(keys, axis=1), np.concatenate(sizes)
            parts, starts = keys[-2], np.cumsum(sizes) - sizes
            total = int(sizes.sum()) + 2 * (len(parts) - len(np.unique(parts)))
            if total > most:
                raise ValueError(f"One text of {total} bytes is more than the {most} that a row holds; the report gives the same as lines")
            last = None
            with mmap.mmap(found.fileno(), 0, access=mmap.ACCESS_READ) as source:
                for i in np.lexsort(keys):
                    joined.write(b", " if parts[i] == last else b"")
                    joined.write(source[starts[i] : starts[i] + sizes[i]])
                    last = parts[i]
            joined.flush()
            whole = pa.py_buffer(mmap.mmap(joined.fileno(), 0, access=mmap.ACCESS_READ))
            yield pa.RecordBatch.from_arrays([pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, total], np.int32)), whole)], [name])

    rows = texts.select(*[F.col(c).cast("bigint").alias(c) for c in ("part", "a", "b")], "text")
    return rows.repartition(1).mapInArrow(join, f"{name} string")


def info_text(rest: DataFrame, totals: DataFrame, ends: DataFrame) -> DataFrame:
    """The whole result as one text, info_out: of the located empty and open transactions, the totals, and the first and last batch.

    It names every such transaction, so it is for results that a reader can hold.
    """
    stats = lambda n: int_statistics(*[F.col(f"{n}_{k}") for k in ("count", "sum", "min", "avg", "max")])
    is_empty = F.col("status") == "EMPTY"
    empty = F.concat(F.lit("EmptyTransaction[closingBatch="), batch_text(_of("closing_batch")), F.lit(", controlMessage="), control_text(F.col("marker")), F.lit("]"))
    session = F.format_string("ProducerSession[producerId=%d, producerEpoch=%d]=", "producer_id", "producer_epoch")
    open_ = F.concat(session, F.lit("FirstBatchInTxn[firstBatchInTxn="), batch_text(_of("first_batch")), F.format_string(", numDataBatches=%d]", "n_data"))
    pick = lambda a, b: F.when(is_empty, a).otherwise(b)
    listed = rest.select(pick(F.lit(3), F.lit(1)).alias("part"), pick(F.col("file_ord"), F.col("producer_id")).alias("a"), pick(F.col("line"), F.col("producer_epoch")).alias("b"), pick(empty, open_).alias("text"))
    batch = lambda which: F.coalesce(F.max(F.when(F.col("which") == which, batch_text())), F.lit("null")).alias(which)
    # the lists are parts 1 and 3, and what stands around them is 0, 2 and 4
    part = lambda k, *text: F.struct(F.lit(k).alias("part"), F.concat(*text).alias("text"))
    before = ends.agg(batch("first"), batch("last")).select(F.inline(F.array(part(0, F.lit(INFO[0])), part(2, F.lit(INFO[1]), "first", F.lit(INFO[2]), "last", F.lit(INFO[3])))))
    counts = [F.col("num_committed").cast("string"), F.col("num_aborted").cast("string"), stats("size"), stats("duration")]
    after = totals.select(F.lit(4).alias("part"), F.concat(*[x for name, value in zip(INFO[4:], counts, strict=False) for x in (F.lit(name), value)], F.lit(INFO[-1])).alias("text"))
    return one_text(listed.unionByName(before.unionByName(after), allowMissingColumns=True), "info_out")


def _of(parent: str):
    return lambda name: F.col(f"{parent}.{name}")


def report_lines(rest: DataFrame, totals: DataFrame, with_file: bool | Column = False, line_numbers: bool = False) -> DataFrame:
    """The transaction report: four lines of totals, then the located empty and open transactions; (part, file_ord, line, line_out) in order."""
    stats = lambda n: int_statistics(*[F.col(f"{n}_{k}") for k in ("count", "sum", "min", "avg", "max")])
    head = totals.select(
        F.posexplode(
            F.array(
                F.format_string("num_committed: %d", "num_committed"),
                F.format_string("num_aborted: %d", "num_aborted"),
                F.concat(F.lit("txn_size_stats: "), stats("size")),
                F.concat(F.lit("txn_duration_stats_ms: "), stats("duration")),
            )
        ).alias("part", "line_out")
    ).select("part", F.lit(0).alias("file_ord"), F.lit(0).alias("line"), F.lit(0).cast("bigint").alias("a"), F.lit(0).alias("b"), "line_out")
    is_empty = F.col("status") == "EMPTY"
    empty = F.concat(
        F.lit("empty_txn:"), location(F.col("closing_batch.file_name"), F.col("line"), with_file, line_numbers, ":"), F.lit(" EmptyTransaction[closingBatch="),
        batch_text(_of("closing_batch")), F.lit(", controlMessage="), control_text(F.col("marker")), F.lit("]"),
    )
    open_ = F.concat(
        F.lit("open_txn:"), location(F.col("first_batch.file_name"), F.col("line"), with_file, line_numbers, ":"),
        F.format_string(" ProducerSession[producerId=%d, producerEpoch=%d]", "producer_id", "producer_epoch"), F.lit("->FirstBatchInTxn[firstBatchInTxn="),
        batch_text(_of("first_batch")), F.format_string(", numDataBatches=%d]", "n_data"),
    )
    pick = lambda a, b: F.when(is_empty, a).otherwise(b)
    tail = rest.select(
        pick(F.lit(4), F.lit(5)).alias("part"), pick(F.col("file_ord"), F.lit(0)).alias("file_ord"), pick(F.col("line"), F.lit(0)).alias("line"),
        pick(F.lit(0).cast("bigint"), F.col("producer_id")).alias("a"), pick(F.lit(0), F.col("producer_epoch").cast("int")).alias("b"), pick(empty, open_).alias("line_out"),
    )
    return head.unionByName(tail).orderBy("part", "file_ord", "line", "a", "b").select("part", "file_ord", "line", "line_out")
