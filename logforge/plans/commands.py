"""The commands, as functions that return DataFrames of output lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import coordinating_partition
from ..operators import checks, filters, render, transactions
from ..sources.dumps import DATA, OFFSETS_TOPIC, STATE_TOPIC, TRANSACTION_STATE, Segments, read_segments
from ..sources.snapshots import Snapshots, read_snapshots


def facts(files: DataFrame) -> tuple[list, bool]:
    """Kinds and topic suffixes of the files, by their first file, and whether there are several files: the table of files was read with them."""
    found = files.groupBy("segment_type", "topic_suffix").agg(F.count(F.lit(1)).alias("n"), F.min("file_ord").alias("first")).collect()
    return sorted(found, key=lambda r: r["first"]), sum(r["n"] for r in found) > 1


def segment_cat(s: Segments, line_numbers: bool = False, pid: int | None = None, producer_epoch: int | None = None, leader_epoch: int | None = None, transactional_id: str | None = None, strict: bool = True, colour: bool = False) -> DataFrame:
    """Lines of all batches and messages that pass the filters; ``strict`` raises for the first violation instead."""
    kinds, several = facts(s.files)
    filters.check_kinds({r["segment_type"] for r in kinds}, pid, producer_epoch, transactional_id)
    if strict:
        checks.require_valid(checks.violations(s))
    chosen = filters.filter_batches(s.placed, pid=pid, producer_epoch=producer_epoch, leader_epoch=leader_epoch, transactional_id=transactional_id)
    return render.segment_lines(s.numbered(chosen), several, line_numbers, colour)


def guard_txn_stat(kinds: list) -> None:
    """Data segments only, and one topic suffix (null counts as one)."""
    for r in kinds:
        if r["segment_type"] != DATA:
            raise ValueError(f"{STATE_TOPIC if r['segment_type'] == TRANSACTION_STATE else OFFSETS_TOPIC} partitions do not contain transactional messages")
    found = sorted({str(r["topic_suffix"]) for r in kinds})
    if len(found) > 1:
        raise ValueError(f"Segment dumps come from multiple different topics {found}")


def txn_stat(s: Segments, line_numbers: bool = False, pid: int | None = None, producer_epoch: int | None = None, leader_epoch: int | None = None, strict: bool = True, wrap_int32: bool = False) -> DataFrame:
    """The transaction report.  Filters come before transactions are formed, so a leader epoch may leave some without data or end."""
    kinds, several = facts(s.files)
    guard_txn_stat(kinds)
    tests = {"pid": pid, "producer_epoch": producer_epoch, "leader_epoch": leader_epoch}
    chosen = filters.filter_batches(s.placed, **tests)
    if strict:
        predicate = filters.batch_predicate(**tests)
        checks.require_valid(checks.violations(s, F.lit(True) if predicate is None else predicate))
    txns = transactions.transactions(chosen)
    if wrap_int32:
        txns = txns.withColumn("duration_ms", transactions.wrap_int32())
    return render.report_lines(transactions.located(txns, s.lines), transactions.summary(txns), several, line_numbers)


def txn_info(s: Segments) -> DataFrame:
    """The whole transaction result as one text."""
    txns = transactions.transactions(s.placed)
    return render.info_text(transactions.located(txns, s.lines), transactions.summary(txns), transactions.first_last(s.placed, s.lines))


def snapshot_cat(s: Snapshots, line_numbers: bool = False, pid: int | None = None, producer_epoch: int | None = None, strict: bool = True, colour: bool = False) -> DataFrame:
    """Lines of all producer states that pass the filters."""
    if strict:
        checks.require_valid(checks.snapshot_violations(s))
    return render.state_lines(s.lines.add(filters.filter_states(s.placed, pid, producer_epoch)), s.files.count() > 1, line_numbers, colour)


def abort_cmd(s: Snapshots, pid: int, producer_epoch: int, strict: bool = True, only_open: bool = False) -> DataFrame:
    """Abort commands for the states of one producer session."""
    if strict:
        checks.require_valid(checks.snapshot_violations(s))
    return render.abort_lines(s.lines.add(filters.filter_states(s.placed, pid, producer_epoch)), only_open)


def partition_of(spark: SparkSession, identifier: str, num_partitions: int = 50) -> int:
    """Coordinating partition of one transactional or group id."""
    return spark.range(1).select(coordinating_partition(F.lit(identifier), num_partitions)).first()[0]


def unknown_paths(spark: SparkSession, files: Iterable[str]) -> DataFrame:
    """Warnings for dumps that do not tell where their segment was."""
    return checks.lint_unknown_path(read_segments(spark, files).files)


def run(spark: SparkSession, command: tuple[str, ...], files: Iterable[str], **options) -> DataFrame:
    """A command over files: ('segment', 'cat'), ('segment', 'txn-stat'), ('snapshot', 'cat') or ('snapshot', 'abort-cmd')."""
    reader, plan = {("segment", "cat"): (read_segments, segment_cat), ("segment", "txn-stat"): (read_segments, txn_stat), ("snapshot", "cat"): (read_snapshots, snapshot_cat), ("snapshot", "abort-cmd"): (read_snapshots, abort_cmd)}[command]
    return plan(reader(spark, files), **options)
