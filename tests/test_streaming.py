import random

import pandas as pd
import pytest
from dumptext import random_log
from pyspark.sql import functions as F

from logforge.operators import transactions as T
from logforge.sources.dumps import parse_segments
from logforge.streaming import open_transactions


def test_equals_batch(spark, tmp_path):
    texts, _ = random_log(8)
    s = parse_segments(spark, texts)
    events = T.events(s.batches).select("file_ord", "split", "place", "nth", "producer_id", "producer_epoch", "create_time", "ctl", "commit")
    rows = events.orderBy("file_ord", "line").collect()
    for k in range(4):  # micro-batches in log order
        part = rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4]
        spark.createDataFrame(part, events.schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    spark.conf.set(*open_transactions.STORE)
    try:
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        try:
            out = open_transactions.track(stream)
        except ImportError as e:
            pytest.skip(str(e))
        q = out.writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        got = sorted(map(tuple, spark.sql("select * from closed").collect()), key=repr)
    finally:
        spark.conf.unset(open_transactions.STORE[0])
    want = T.transactions(s.batches).where(F.col("status") != "OPEN").select("producer_id", "producer_epoch", "txn_seq", "status", "n_data", "duration_ms")
    assert got == sorted(map(tuple, want.collect()), key=repr) and got


def plain(rows, n, first, seq):
    out = []
    for ctl, commit, time in rows:
        if ctl:
            out.append((seq, "EMPTY" if not n else "COMMITTED" if commit else "ABORTED", n, time - first if n else None))
            n, seq = 0, seq + 1
        else:
            first, n = time if not n else first, n + 1
    return out, (n, first, seq)


def test_closing_equals_plain_loop():
    r = random.Random(1)
    for _ in range(500):
        rows = [(ctl := r.random() < 0.4, r.random() < 0.5 if ctl else None, r.randint(0, 99)) for _ in range(r.randint(0, 7))]
        start = r.choice([0, 0, 1, 3]), r.randint(0, 99), r.randint(0, 5)
        got, state = open_transactions.closed(pd.DataFrame(rows, columns=["ctl", "commit", "create_time"]), *start)
        want, after = plain(rows, *start)
        assert [(*x[:3], None if pd.isna(x[3]) else int(x[3])) for x in got.itertuples(index=False)] == want
        assert (state[0], state[2]) == (after[0], after[2]) and (not state[0] or state[1] == after[1])
