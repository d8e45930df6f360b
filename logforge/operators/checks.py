"""Checks: each gives rows (file_ord, file_name, line, check_order, check, message).

``violations`` finds all that makes a dump invalid: one pass gives each batch an
array of what is wrong with it, and line numbers are made for these rows alone;
only the state machine looks across batches.  ``first_violation`` is what a reader
that stops at the first error would report.  Lints are checks that the format's
usual reader names but never enforces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.grammar import PREVIOUS_STATES
from ..sources.dumps import DATA, PLACE, TRANSACTION_STATE, Lines, Segments
from ..sources.snapshots import Snapshots

# Texts of messages.
NO_LINES, ONE_LINE = "Expected > 0 lines", "Expected > 1 lines"
NO_DUMPING = "Expected first line to match ^Dumping (.*)$"
NO_OFFSET = "Expected second line to match ^.*starting offset: ([0-9]+)$"
NO_NAME = r"Expected FILE in first line to match [0-9]+\.log"
OFFSETS_DIFFER = "Segment file name %s implies starting offset of %d but 2nd line says offset is %d"
NO_BATCH = "Expected a message batch"
NO_RECORD = ("Expected ", " records in batch, but this doesn't look like a ", " record")
NO_PAYLOAD = "Didn't match expected pattern"
NO_STATE = "This doesn't look like a data record"
NO_NUMBER = ('For input string: "', '"')
STATE_PID, STATE_EPOCH = "Segment of __transaction_state with producerId != -1", "Segment of __transaction_state with producerEpoch != -1"
DATA_PID, DATA_EPOCH = "Transactional batch with producerId == -1", "Transactional batch with producerEpoch == -1"
NOT_VALID, TRANSACTIONAL, ILLEGAL = "Batch is not valid", "Batch was transactional", "Illegal state change from "
CONTROL_COUNT = "Transactional data batch with >1 control records"
NO_PARENT = "Don't know original segment file name, assuming a normal segment"

_FAULT = "struct<rel: int, check_order: int, check: string, message: string, located: boolean>"


def _fault(when: Column, order: int, check: str | Column, message: str | Column, rel: Column | int = 0, located: bool = False) -> Column:
    """What is wrong with a batch if ``when`` holds: ``rel`` lines below its first line; a located message names file and line."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    made = F.struct((F.lit(rel) if isinstance(rel, int) else rel).cast("int"), F.lit(order), text(check), text(message), F.lit(located))
    return F.when(when, made.cast(_FAULT))


def _found(df: DataFrame, faults: list[Column], lines: Lines | None) -> DataFrame:
    """The faults of all rows; ``lines`` numbers rows that have only a place, and only those with a fault."""
    array = F.filter(F.array(*faults), lambda x: x.isNotNull())
    keys = [c for c in (*PLACE, "line") if c in df.columns]
    # the outer form, as Spark would otherwise test the array's size by computing it once more
    rows = df.select(*keys, "file_name", F.explode_outer(array).alias("x")).where("x is not null")
    rows = rows if lines is None or "line" in df.columns else lines.add(rows)
    line = F.col("line") + F.col("x.rel")
    at = F.when(F.col("x.located"), F.concat("file_name", F.lit(":"), line.cast("string"), F.lit(": "))).otherwise("")
    return rows.select("file_ord", "file_name", line.alias("line"), F.col("x.check_order").alias("check_order"), F.col("x.check").alias("check"), F.concat(at, "x.message").alias("message"))


def file_violations(files: DataFrame) -> DataFrame:
    """Header lines: too few, too many, of the wrong form, or in disagreement (V1, V2, V3)."""
    some, path = F.col("header_lines") > 0, F.col("path").isNotNull()
    two = path & (F.col("header_lines") >= 2)
    f = files.select("file_ord", "file_name", "path", "header_lines", "starting_offset", "name_offset", F.lit(1).alias("line"))
    return _found(
        f,
        [
            _fault(~some, 0, "lines", NO_LINES),
            _fault(some & ~path, 0, "dumping_line", NO_DUMPING),
            _fault(path & ~two, 1, "lines", ONE_LINE, 1),
            _fault(two & F.col("starting_offset").isNull(), 1, "offset_line", NO_OFFSET, 1),
            _fault(two & F.col("starting_offset").isNotNull() & F.col("name_offset").isNull(), 2, "file_name", NO_NAME, 1),
            _fault(two & (F.col("starting_offset") != F.col("name_offset")), 3, "offset_name", F.format_string(OFFSETS_DIFFER, "path", "name_offset", "starting_offset"), 1),
            _fault(F.col("header_lines") > 2, 4, "batch", NO_BATCH, 2),
        ],
        None,
    )


def grammar_faults() -> list[Column]:
    """Lines that are no batch, bodies too short, too long or with a line of another form, numbers too large (V3, V4, V5, X7); of records after ``last`` is known."""
    fits, count = F.col("fits"), F.coalesce("count", F.col("n_body"))
    wanted = F.when(F.col("deep_iteration"), count).otherwise(0)
    # a line end before the next batch line is an empty line; at the end of the file it is none
    n_body = F.col("n_body") + F.when(F.col("blank") & ~F.col("last"), 1).otherwise(0)
    kind = F.when(F.col("is_control"), "control").when(F.col("segment_type") == TRANSACTION_STATE, "txn").otherwise("data")
    text = lambda left: F.concat(F.lit(NO_RECORD[0]), left.cast("string"), F.lit(" "), kind, F.lit(NO_RECORD[1]), kind, F.lit(NO_RECORD[2]))
    bad = F.get(F.filter("messages", lambda m: m["kind"].isNull()), F.lit(0))["line"]
    payload = F.get(F.filter("messages", lambda m: m["kind"] == "BAD_PAYLOAD"), F.lit(0))["line"]
    number = F.get(F.filter("messages", lambda m: m["bad_number"].isNotNull()), F.lit(0))
    named = lambda raw: F.concat(F.lit(NO_NUMBER[0]), raw, F.lit(NO_NUMBER[1]))
    # the next batch line comes while records are still due; at the end of a file the batch is dropped instead
    early = fits & F.col("deep_iteration") & ~F.col("last") & (F.col("n_body") < count) & bad.isNull()
    return [
        _fault(~fits, 4, "batch", NO_BATCH),
        _fault(F.col("bad_number").isNotNull(), 4, "number", named(F.col("bad_number"))),
        _fault(fits & (n_body > wanted), 4, "batch", NO_BATCH, wanted + 1),
        _fault(fits & bad.isNotNull(), 4, "record", text(count - bad + 1), bad),
        _fault(early, 4, "record", text(count - F.col("n_body")), F.col("n_body") + 1),
        _fault(fits & payload.isNotNull(), 4, "payload", NO_PAYLOAD, payload),
        _fault(fits & number.isNotNull(), 4, "number", named(number["bad_number"]), number["line"]),
    ]


def identity_faults() -> list[Column]:
    """Producer ids and epochs that their kind of log must or must not have (V6, V7); a number that its type cannot hold is neither."""
    state, txn = F.col("segment_type") == TRANSACTION_STATE, (F.col("segment_type") == DATA) & F.col("is_transactional")
    pid, epoch = F.col("producer_id").eqNullSafe(-1), F.col("producer_epoch").eqNullSafe(-1)
    return [_fault(state & ~pid, 5, "state_pid", STATE_PID), _fault(state & pid & ~epoch, 5, "state_epoch", STATE_EPOCH), _fault(txn & pid, 5, "data_pid", DATA_PID), _fault(txn & ~pid & epoch, 5, "data_epoch", DATA_EPOCH)]


def validity_faults() -> list[Column]:
    """Batches marked invalid, and transactional batches in a state log (V8, V12)."""
    return [_fault(~F.col("is_valid"), 6, "valid", NOT_VALID, located=True), _fault((F.col("segment_type") == TRANSACTION_STATE) & F.col("is_transactional"), 8, "transactional", TRANSACTIONAL, located=True)]


def control_count_fault() -> Column:
    """A transactional control batch that holds other than one record (V17)."""
    return _fault(F.col("is_transactional") & F.col("is_control") & (F.col("count") != 1), 9, "control_count", CONTROL_COUNT)


def identity_violations(batches: DataFrame, lines: Lines | None = None) -> DataFrame:
    return _found(batches, identity_faults(), lines)


def validity_violations(batches: DataFrame, lines: Lines | None = None) -> DataFrame:
    return _found(batches, validity_faults(), lines)


def transactional_violations(batches: DataFrame, expected: bool, lines: Lines | None = None) -> DataFrame:
    """Batches whose transactional flag is not as expected (V12 for any log)."""
    said = F.concat(F.lit("Batch was "), F.when(F.col("is_transactional"), "").otherwise("not "), F.lit("transactional"))
    return _found(batches, [_fault(F.col("is_transactional") != F.lit(expected), 8, "transactional", said, located=True)], lines)


def control_count_violations(batches: DataFrame, lines: Lines | None = None) -> DataFrame:
    return _found(batches, [control_count_fault()], lines)


def _records(s: Segments) -> DataFrame:
    """All records after the header, by place, and whether each is the last of its file."""
    edges, at = F.broadcast(s.lines.edges().select("file_ord", "head", "tail")), F.struct("split", "place")
    return s.pieces.join(edges, "file_ord").where(at != F.col("head")).withColumn("last", at == F.col("tail"))


def grammar_violations(s: Segments) -> DataFrame:
    """What the grammar does not allow, without the header's lines (V3, V4, V5, X7)."""
    return _found(_records(s), grammar_faults(), s.lines)


def state_violations(s: Segments) -> DataFrame:
    """State changes that may not follow the change before, for each session and file (V11)."""
    changes = F.filter("messages", lambda m: m["kind"] == "STATE_CHANGE")
    m = s.placed.where(F.col("segment_type") == TRANSACTION_STATE).select(*PLACE, "file_name", F.explode_outer(changes).alias("m")).where("m is not null")
    m = m.select(*PLACE, "file_name", F.col("m.line").alias("nth"), F.col("m.txn_producer_id").alias("pid"), F.col("m.txn_producer_epoch").alias("epoch"), F.col("m.state").alias("state"))
    m = with_previous(m, "state", ["pid", "epoch"], ["place", "nth"])
    legal = reduce(lambda a, b: a | b, [(F.col("state") == to) & F.col("previous").isin(*before) for to, before in PREVIOUS_STATES.items()])
    m = m.where(F.col("previous").isNotNull() & ~legal)
    return _found(m, [_fault(F.lit(True), 7, "state_machine", F.concat(F.lit(ILLEGAL), F.col("previous"), F.lit(" to "), F.col("state")), F.col("nth"), True)], s.lines)


def violations(s: Segments, controls: Column | None = None) -> DataFrame:
    """All violations of segment dumps; with ``controls``, those of control counts (V17) in the batches that pass this filter."""
    whole = F.col("whole")
    faults = grammar_faults() + [F.when(whole, x) for x in identity_faults() + validity_faults()]
    if controls is not None:
        faults.append(F.when(whole & controls, control_count_fault()))
    return file_violations(s.files).unionByName(_found(_records(s), faults, s.lines)).unionByName(state_violations(s))


def snapshot_violations(s: Snapshots) -> DataFrame:
    """All violations of snapshot dumps (V1, V2, V14, X7)."""
    files = s.files.withColumn("line", F.lit(1))
    head = _found(files, [_fault(F.col("is_empty"), 0, "lines", NO_LINES), _fault(~F.col("is_empty") & F.col("path").isNull(), 0, "dumping_line", NO_DUMPING)], None)
    heads = F.broadcast(s.lines.edges().select("file_ord", "head"))
    rows = s.pieces.join(heads, "file_ord").where(F.struct("split", "place") != F.col("head"))
    number = F.concat(F.lit(NO_NUMBER[0]), F.col("bad_number"), F.lit(NO_NUMBER[1]))
    return head.unionByName(_found(rows, [_fault(~F.col("fits"), 4, "record", NO_STATE), _fault(F.col("bad_number").isNotNull(), 4, "number", number)], s.lines))


def first_violation(found: DataFrame) -> DataFrame:
    """The violation that comes first in log order."""
    return found.orderBy("file_ord", "line", "check_order").limit(1)


def require_valid(found: DataFrame) -> None:
    """Raise for the first violation."""
    row = first_violation(found).first()
    if row:
        raise ValueError(row["message"] if row["message"].startswith(f"{row['file_name']}:") else f"{row['file_name']}:{row['line']}: {row['message']}")


def with_previous(df: DataFrame, column: str, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """``previous``: the value of ``column`` in the row before, in the same file (and with the same keys).

    Windows cover one split each; the last value of each split is carried to the
    first row of the next, so no file lies in one task.
    """
    keys, order = ["file_ord", *(keys or [])], order or ["place"]
    inside = W.partitionBy(*keys, "split").orderBy(*order)
    d = df.withColumn("_before", F.lag(F.struct(F.col(column).alias("value"))).over(inside))
    ends = df.groupBy(*keys, "split").agg(F.max_by(F.struct(F.col(column).alias("value")), F.struct(*order)).alias("_end"))
    ends = ends.withColumn("_carried", F.lag("_end").over(W.partitionBy(*keys).orderBy("split"))).where("_carried is not null")
    ends = ends.select(*[F.col(k).alias(f"_{k}") for k in (*keys, "split")], "_carried")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "split")])
    return d.join(ends, same & F.col("_before").isNull(), "left").withColumn("previous", F.coalesce("_before", "_carried")["value"]).drop("_before", "_carried", *[f"_{k}" for k in (*keys, "split")])


def _lint(batches: DataFrame, lines: Lines | None, column: str, bad: str, order: int, check: str, text: str) -> DataFrame:
    b = with_previous(batches, column).where(bad)
    now = "base_offset" if column == "last_offset" else column
    return _found(b, [_fault(F.lit(True), order, check, F.format_string(text, now, "previous"), located=True)], lines)


def lint_position(batches: DataFrame, lines: Lines | None = None) -> DataFrame:
    """Batches whose position is not above the one before (V9)."""
    return _lint(batches, lines, "position", "previous >= position", 20, "position", "Batch position %d is not above the previous batch position %d")


def lint_leader_epoch(batches: DataFrame, lines: Lines | None = None) -> DataFrame:
    """Batches whose leader epoch is below the one before (V10)."""
    return _lint(batches, lines, "partition_leader_epoch", "previous > partition_leader_epoch", 21, "leader_epoch", "Batch leader epoch %d is below the previous batch leader epoch %d")


def lint_offsets(batches: DataFrame, lines: Lines | None = None) -> DataFrame:
    """Batches whose first offset does not come after the last offset before."""
    return _lint(batches, lines, "last_offset", "previous >= base_offset", 22, "offsets", "Batch base offset %d is not above the previous last offset %d")


def lint_truncated(s: Segments) -> DataFrame:
    """Last batches of a file that have fewer records than they count, and are dropped."""
    b = _records(s).where("fits and deep_iteration and last and n_body < count")
    return _found(b, [_fault(F.lit(True), 23, "truncated", F.format_string("Batch has %d of %d records", "n_body", "count"), located=True)], s.lines)


def lint_producers(states: DataFrame, lines: Lines | None = None) -> DataFrame:
    """Snapshot rows of no producer (V13)."""
    return _found(states, [_fault(F.expr("producer_id = -1 and producer_epoch = -1"), 24, "producer", "Not a transactional producer", located=True)], lines)


def lint_topics(files: DataFrame) -> DataFrame:
    """Files of another topic partition than the first, and files whose directory names none."""
    first = files.agg(F.min_by(F.struct("topic", "partition"), "file_ord").alias("t"))
    f = files.withColumn("line", F.lit(1)).join(F.broadcast(first))
    other = ~F.struct("topic", "partition").eqNullSafe(F.col("t"))
    return _found(f, [_fault(other, 25, "topic", "Dump of another topic partition than the first")], None)


def lint_unknown_path(files: DataFrame) -> DataFrame:
    """Dumps whose first line names a file without a directory, so that they count as data of an unknown topic."""
    alone = F.col("path").isNotNull() & ~F.contains("path", F.lit("/"))
    return _found(files.withColumn("line", F.lit(1)), [_fault(alone, 26, "unknown_path", NO_PARENT)], None)
