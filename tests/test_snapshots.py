import pytest
from dumptext import state
from pyspark.sql import functions as F

from logforge.functions.scalars import coordinating_partition, iso_instant, string_hash
from logforge.operators import checks
from logforge.plans import commands
from logforge.sources.snapshots import parse_snapshots, read_snapshots

HEAD = "Dumping /logs/orders-0/00000000000000000041.snapshot"


def text(*lines):
    return "\n".join([HEAD, *lines, ""])


@pytest.mark.parametrize("last", [None, 1700000000456])
def test_generations(spark, tmp_path, last):
    (tmp_path / "s.dump").write_text(text(state(1, last=last), state(2, first="Some(40)", last=last), state(3, last=last)))
    s = read_snapshots(spark, [str(tmp_path / "s.dump")])
    got = s.states.orderBy("line").select("line", "producer_id", "current_txn_first_offset", "last_timestamp").collect()
    assert [tuple(r) for r in got] == [(2, 1, 0, last or 0), (3, 2, 40, last or 0), (4, 3, 0, last or 0)]
    assert checks.snapshot_violations(s).count() == 0 and s.files.first()["topic"] == "orders"


def test_filters_and_lines(spark):
    s = parse_snapshots(spark, [("a", text(state(1, epoch=0), state(1, epoch=1, first="Some(4)"), state(2, epoch=1)))])
    line = commands.snapshot_cat(s, line_numbers=True, pid=2).first()["line_out"]
    assert line == "4: ProducerState(producerId=2, producerEpoch=1, coordinatorEpoch=3, currentTxnFirstOffset=0, lastTimestamp=1970-01-01T00:00:00Z, firstSequence=8, lastSequence=9, lastOffset=41, offsetDelta=1, timestamp=2023-11-14T22:13:20.123Z)"
    out = [r["line_out"] for r in commands.abort_cmd(s, 1, 1).collect()]
    assert out == ["$KAFKA_HOME/bin/kafka-transactions.sh --bootstrap-server $BOOTSTRAP_URL abort --topic $TOPIC_NAME --partition $PART_NUM --producer-id 1 --producer-epoch 1 --coordinator-epoch 3"]
    assert commands.abort_cmd(s, 1, 0).count() == 1 and commands.abort_cmd(s, 1, 0, only_open=True).count() == 0


def test_bad_rows(spark):
    s = parse_snapshots(spark, [("a", text(state(1), "odd", state(-1))), ("b", "x\n")])
    got = [tuple(r) for r in checks.snapshot_violations(s).orderBy("file_ord", "line").select("file_name", "line", "check").collect()]
    assert got == [("a", 3, "record"), ("a", 4, "record"), ("b", 1, "dumping_line")]
    with pytest.raises(ValueError, match="a:3"):
        commands.snapshot_cat(s)


def java_hash(s):
    h = 0
    data = s.encode("utf-16-be")
    for i in range(0, len(data), 2):
        h = (h * 31 + int.from_bytes(data[i : i + 2], "big")) % 2**32
    return h - 2**32 if h >= 2**31 else h


def test_coordinators(spark):
    ids = ["", "a", "my-txn-id", "polygenelubricants", "naïve", "\U0001f600x", "z" * 500]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = {r[0]: (r[1], r[2]) for r in df.select("id", string_hash(F.col("id")), coordinating_partition(F.col("id"))).collect()}
    for i in ids:
        h = java_hash(i)
        assert got[i] == (h, (0 if h == -(2**31) else abs(h)) % 50)
    assert commands.partition_of(spark, "polygenelubricants") == 0


def test_instants(spark):
    df = spark.createDataFrame([(0,), (1,), (-1,), (1700000000120,)], "ms bigint")
    assert [r[0] for r in df.select(iso_instant(F.col("ms"))).collect()] == ["1970-01-01T00:00:00Z", "1970-01-01T00:00:00.001Z", "1969-12-31T23:59:59.999Z", "2023-11-14T22:13:20.120Z"]


def test_cli(spark, tmp_path, capsys):
    from logforge import cli

    (tmp_path / "s.dump").write_text(text(state(1, first="Some(4)")))
    assert cli.main(["snapshot", "abort-cmd", "--pid", "1", "--producer-epoch", "1", str(tmp_path / "s.dump")], spark) == 0
    assert "--producer-id 1 " in capsys.readouterr().out
    assert cli.main(["txn-coordinating-partition", "polygenelubricants"], spark) == 0
    assert capsys.readouterr().out == "0\n"
