"""Filters of batches and producer states.  A filter selects whole batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.dumps import CONSUMER_OFFSETS, STATE_TOPIC, TRANSACTION_STATE


def _both(tests: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, tests) if tests else None


def batch_predicate(pid: int | None = None, producer_epoch: int | None = None, leader_epoch: int | None = None, transactional_id: str | None = None) -> Column | None:
    """Conjunction of the given tests, or None.

    In a state log, pid and epoch look at the state changes of a batch, each by
    itself: two messages may satisfy one each.  The transactional id looks at changes and deletions.
    """
    state = F.col("segment_type") == TRANSACTION_STATE
    changed = lambda name, value: F.exists("messages", lambda m: (m["kind"] == "STATE_CHANGE") & (m[name] == F.lit(value)))
    tests = []
    for name, value in (("producer_id", pid), ("producer_epoch", producer_epoch)):
        if value is not None:
            tests.append(F.when(state, changed(f"txn_{name}", value)).otherwise(F.col(name) == F.lit(value)))
    if leader_epoch is not None:
        tests.append(F.col("partition_leader_epoch") == F.lit(leader_epoch))
    if transactional_id is not None:
        tests.append(F.exists("messages", lambda m: m["transaction_id"] == F.lit(transactional_id)))
    return _both(tests)


def check_kinds(kinds: set[str], pid: int | None = None, producer_epoch: int | None = None, transactional_id: str | None = None) -> None:
    """Raise where a filter does not apply to a kind of file."""
    if transactional_id is not None and kinds - {TRANSACTION_STATE}:
        raise ValueError(f"a transactional id can only be used on partitions of {STATE_TOPIC}")
    if (pid is not None or producer_epoch is not None) and CONSUMER_OFFSETS in kinds:
        raise ValueError("producer filters do not apply to partitions of consumer offsets")


def check_filters(files: DataFrame, **tests) -> None:
    """``check_kinds`` of a file table."""
    check_kinds({r[0] for r in files.select("segment_type").distinct().collect()}, **tests)


def filter_batches(batches: DataFrame, **tests) -> DataFrame:
    predicate = batch_predicate(**tests)
    return batches if predicate is None else batches.where(predicate)


def filter_states(states: DataFrame, pid: int | None = None, producer_epoch: int | None = None) -> DataFrame:
    """Rows of a producer snapshot by producer id and epoch."""
    tests = [F.col(n) == F.lit(v) for n, v in (("producer_id", pid), ("producer_epoch", producer_epoch)) if v is not None]
    predicate = _both(tests)
    return states if predicate is None else states.where(predicate)
