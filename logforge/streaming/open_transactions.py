"""Continuous tracking of transactions over a stream of log events.

The stream carries the events that ``operators.transactions.events`` gives for a
batch of dumps, in log order from micro-batch to micro-batch.  Each producer
session keeps the number of data batches and the time of the first one of its open
transaction; an end marker emits the transaction and clears the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "producer_id bigint, producer_epoch smallint, txn_seq bigint, status string, n_data bigint, duration_ms bigint"
STATE = "n_data bigint, first_time bigint, txn_seq bigint"
#: The state store that keyed processors need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def closed(events: pd.DataFrame, n: int, first: int, seq: int) -> tuple[pd.DataFrame, tuple[int, int, int]]:
    """Transactions that the events of one session (in log order) close, and the state after them.

    ``n``, ``first`` and ``seq`` are the open transaction's data batches, the time of the first one, and its number.
    """
    ctl, time = events["ctl"].to_numpy(bool), events["create_time"].to_numpy(np.int64)
    ends = np.flatnonzero(ctl)
    before = np.append(-1, ends)  # the marker (or nothing) in front of each transaction, the open one at last
    counts = np.append(ends, len(ctl)) - before - 1
    counts[0] += n
    at = np.minimum(before + 1, max(len(time) - 1, 0))
    begun = time[at] if len(time) else np.zeros(1, np.int64)
    if n:
        begun[0] = first
    done = counts[:-1]
    status = np.where(done == 0, "EMPTY", np.where(events["commit"].to_numpy()[ends].astype(bool), "COMMITTED", "ABORTED"))
    took = pd.array(time[ends] - begun[:-1], "Int64")
    took[done == 0] = pd.NA
    out = pd.DataFrame({"txn_seq": seq + np.arange(len(ends)), "status": status, "n_data": done, "duration_ms": took})
    return out, (int(counts[-1]), int(begun[-1]), seq + len(ends))


class _Sessions(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, first, seq = self.state.get() if self.state.exists() else (0, 0, 0)
        # a micro-batch's rows of one session, numbers alone
        events = pd.concat(list(rows)).sort_values(["file_ord", "split", "place", "nth"], kind="stable")
        out, state = closed(events, n, first, seq)
        self.state.update(state)
        out.insert(0, "producer_id", key[0])
        out.insert(1, "producer_epoch", key[1])
        yield out

    def close(self) -> None:
        pass


def track(events: DataFrame) -> DataFrame:
    """Closed transactions of a stream with file_ord, split, place, nth, producer_id, producer_epoch, create_time, ctl and commit.

    Open transactions are state, not output.  The session needs ``STORE``.
    """
    keyed = events.select("file_ord", "split", "place", "nth", "producer_id", "producer_epoch", "create_time", "ctl", "commit").groupBy("producer_id", "producer_epoch")
    return keyed.transformWithStateInPandas(statefulProcessor=_Sessions(), outputStructType=SCHEMA, outputMode="Append", timeMode="None")
