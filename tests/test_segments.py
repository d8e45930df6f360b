import pytest
from dumptext import batch, change, control, data, delete, dump, headers, random_log
from pyspark.sql import functions as F

from logforge.operators import checks, filters
from logforge.operators import transactions as T
from logforge.plans import commands
from logforge.sources.dumps import LEAD, ordered_files, parse_segments, read_segments, scan


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def messages(s):
    return rows(s.batches.select("line", F.explode("messages").alias("m")).orderBy("m.line"), "m.line", "m.kind")


def found(s):
    return [(r["line"], r["check"], r["message"]) for r in checks.violations(s).orderBy("file_ord", "line", "check_order").collect()]


def totals(s):
    return T.summary(T.transactions(s.batches)).first()


def test_shallow(spark):
    s = parse_segments(spark, [("a", dump(*[batch(i, txn=False) for i in (0, 1, 2)], path="./00000000000000000000.log"))])
    f = s.files.first()
    assert (f["segment_type"], f["topic"], f["deep_iteration"]) == ("DATA", None, False)
    assert rows(s.batches.orderBy("line"), "line") == [(3,), (4,), (5,)]
    assert found(s) == [] and totals(s)["num_committed"] == 0


def test_deep_lines_and_payloads(spark):
    s = parse_segments(spark, [("a", dump(batch(0, 2), data(0), data(1, tail=""), batch(2), data(2), batch(3), data(3, keys="] payload: [1,2")))])
    assert rows(s.batches.orderBy("line"), "line", F.size("messages")) == [(3, 2), (6, 1), (8, 1)]
    assert [m[0] for m in messages(s)] == [4, 5, 7, 9] and found(s) == []
    last = s.batches.orderBy(F.desc("line")).select(F.get("messages", F.lit(0))["header_keys"]).first()[0]
    assert last == "] payload: [1,2"


def test_control_records(spark):
    s = parse_segments(spark, [("a", dump(batch(0, time=1), data(0), batch(1, time=5), data(1), batch(2, time=7), data(2), batch(3, control=True, time=1100), control(3), batch(4, time=2000), data(4), batch(5, control=True, time=2504), control(5)))])
    t = totals(s)
    assert (t["num_committed"], t["num_aborted"], t["num_open"], t["num_empty"]) == (2, 0, 0, 0)
    assert rows(T.transactions(s.batches).orderBy("txn_seq"), "n_data", "duration_ms") == [(3, 1099), (1, 504)]


STATE = "/logs/__transaction_state-5/00000000000000000000.log"


def state_log(states, **more):
    lines = [x for i, st in enumerate(states) for x in (batch(i, pid=-1, epoch=-1, txn=False, **more), change(i, st))]
    return dump(*lines, path=STATE)


def test_state_log(spark):
    legal = ["Ongoing", "PrepareCommit", "CompleteCommit", "Ongoing", "PrepareAbort", "CompleteAbort", "Empty", "Dead"]
    s = parse_segments(spark, [("a", state_log(legal))])
    assert s.files.first()["segment_type"] == "TRANSACTION_STATE" and found(s) == []
    assert totals(s)["num_committed"] == 0


def test_illegal_change(spark):
    s = parse_segments(spark, [("input", state_log(["Ongoing", "Ongoing", "PrepareCommit", "CompleteAbort"]))])
    assert found(s) == [(10, "state_machine", "input:10: Illegal state change from PrepareCommit to CompleteAbort")]
    with pytest.raises(ValueError, match="input:10: Illegal"):
        checks.require_valid(checks.violations(s))


@pytest.mark.parametrize("old", [True, False])
def test_generations(spark, old):
    s = parse_segments(spark, [("a", dump(batch(0, 2, horizon="" if old else " deleteHorizonMs: OptionalLong.empty"), data(0, old=old), data(1, old=old), old=old))])
    assert [m[0] for m in messages(s)] == [4, 5] and found(s) == []


def test_record_errors(spark):
    bad = parse_segments(spark, [("a", dump(batch(0), data(0, tail=" key: y")))])
    assert found(bad) == [(4, "record", "Expected 1 data records in batch, but this doesn't look like a data record")]
    early = parse_segments(spark, [("a", dump(batch(0, 3), data(0), batch(3), data(3)))])
    assert found(early) == [(5, "record", "Expected 2 data records in batch, but this doesn't look like a data record")]
    extra = parse_segments(spark, [("a", dump(batch(0), data(0), data(1), batch(2), data(2)))])
    assert found(extra) == [(5, "batch", "Expected a message batch")]
    payload = parse_segments(spark, [("a", dump(batch(0, pid=-1, epoch=-1, txn=False), change(0, "Odd"), path=STATE))])
    assert found(payload) == [(4, "payload", "Didn't match expected pattern")]
    blank = parse_segments(spark, [("a", dump(batch(0), data(0), "", batch(1), data(1)))])
    assert found(blank) == [(5, "batch", "Expected a message batch")]


def test_truncated_and_empty_batches(spark):
    s = parse_segments(spark, [("a", dump(batch(0, 0), batch(0), data(0), batch(1, 2), data(1)))])
    assert rows(s.batches.orderBy("line"), "line", "count") == [(3, 0), (4, 1)] and found(s) == []
    assert rows(checks.lint_truncated(s), "line") == [(6,)]


def test_headers(spark):
    texts = [("a", ""), ("b", "Dumping /x-1/00000000000000000000.log\n"), ("c", "Nothing\nStarting offset: 0\n"), ("d", "Dumping /x-1/0.log\nNo offset\n"), ("e", "Dumping /x-1/5.log\nStarting offset: 4\n"), ("f", "Dumping /x-1/odd\nStarting offset: 4\n"), ("g", "Dumping /x-1/7.log\nlog STARTING OFFSET: 7\n")]
    s = parse_segments(spark, texts)
    got = {(r["file_name"], r["check"]) for r in checks.violations(s).collect()}
    assert got == {("a", "lines"), ("b", "lines"), ("c", "dumping_line"), ("d", "offset_line"), ("e", "offset_name"), ("f", "file_name")}


def test_identities(spark):
    s = parse_segments(spark, [("a", dump(batch(0, pid=-1), data(0), batch(1, epoch=-1), data(1), batch(2, pid=-1, epoch=-1, txn=False), data(2), batch(3, valid=False), data(3)))])
    assert [(x[0], x[1]) for x in found(s)] == [(3, "data_pid"), (5, "data_epoch"), (9, "valid")]
    t = parse_segments(spark, [("a", dump(batch(0, pid=1, epoch=-1, txn=False), change(0, "Ongoing"), batch(1, pid=-1, epoch=0, txn=True), delete(1), path=STATE))])
    assert [(x[0], x[1]) for x in found(t)] == [(3, "state_pid"), (5, "state_epoch"), (5, "transactional")]


def test_wide_numbers(spark):
    s = parse_segments(spark, [("a", dump(batch(0, pid=5_000_000_000, crc=3_000_000_001), data(0)))])
    assert rows(s.batches, "producer_id", "crc") == [(5_000_000_000, 3_000_000_001 - 2**32)]


def test_filters_select_whole_batches(spark):
    body = [change(0, "Ongoing", pid=1, epoch=2), change(1, "Ongoing", pid=3, epoch=4, tid="b")]
    s = parse_segments(spark, [("a", dump(batch(0, 2, pid=-1, epoch=-1, txn=False), *body, batch(2, pid=-1, epoch=-1, txn=False), delete(2, "c"), path=STATE))])
    lines = lambda **t: [r[0] for r in rows(filters.filter_batches(s.batches, **t).orderBy("line"), "line")]
    assert lines(pid=1, producer_epoch=4) == [3] and lines(pid=2) == [] and lines(transactional_id="c") == [6] and lines(transactional_id="b") == [3]
    assert lines(leader_epoch=5) == [3, 6] and lines() == [3, 6] and lines(leader_epoch=4) == []
    d = parse_segments(spark, [("a", dump(batch(0), data(0)))])
    with pytest.raises(ValueError):
        filters.check_filters(d.files, transactional_id="c")
    o = parse_segments(spark, [("a", dump(batch(0), data(0), path="/x/__consumer_offsets-1/0.log"))])
    with pytest.raises(ValueError):
        filters.check_filters(o.files, pid=1)


def test_non_transactional_marker_closes(spark):
    s = parse_segments(spark, [("a", dump(batch(0, time=5), data(0), batch(1, 2, txn=False, control=True, time=3), control(1), control(2, False)))])
    assert rows(T.transactions(s.batches).orderBy("txn_seq"), "status", "n_data", "duration_ms") == [("COMMITTED", 1, -2), ("EMPTY", 0, None)]
    assert checks.control_count_violations(s.batches).count() == 0
    t = parse_segments(spark, [("a", dump(batch(1, 2, control=True), control(1), control(2, False)))])
    assert rows(checks.control_count_violations(t.batches), "line") == [(3,)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_sequential_reader(spark, tmp_path, seed):
    texts, expected = random_log(seed)
    for name, text in texts:
        (tmp_path / name).write_text(text if seed == 1 else text.replace("\n", "\r\n"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        s = read_segments(spark, [str(tmp_path)])
        got = rows(T.transactions(s.batches), "producer_id", "producer_epoch", "status", "n_data", "duration_ms")
        assert sorted(got, key=repr) == expected
        assert found(s) == []
        for k, (name, text) in enumerate(texts):
            assert rows(s.batches.where(F.col("file_ord") == k).orderBy("line"), "line", "base_offset") == headers(text)
        pieces = scan(spark, ordered_files(spark, [str(tmp_path)]), "\n" + LEAD)
        assert pieces.select("file_ord", "split").distinct().count() > len(texts)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_same_base_name_keeps_order(spark, tmp_path):
    for d, off in (("b", 9), ("a", 4)):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.dump").write_text(dump(batch(off), data(off)))
    s = read_segments(spark, [str(tmp_path / "b" / "x.dump"), str(tmp_path / "a" / "x.dump")])
    assert rows(s.batches.orderBy("file_ord"), "base_offset") == [(9,), (4,)]


def test_cat_lines(spark):
    s = parse_segments(spark, [("a", dump(batch(0, time=1_700_000_000_000), data(0, 1_700_000_000_123)))])
    out = [r["line_out"] for r in commands.segment_cat(s, line_numbers=True).collect()]
    assert out[0] == "3: Batch(baseOffset=0, lastOffset=0, count=1, baseSequence=0, lastSequence=1, producerId=7, producerEpoch=1, partitionLeaderEpoch=5, isTransactional=true, isControl=false, position=0, createTime=2023-11-14T22:13:20Z, size=61, magic=2, compressCodec='none', crc=1, isValid=true)"
    assert out[1] == "4:   DataMessage(offset=0, createTime=2023-11-14T22:13:20.123Z, keySize=4, valueSize=10, sequence=0, headerKeys='h1,h2')"
    assert "\033[1m" in commands.segment_cat(s, colour=True).first()["line_out"]


def test_txn_stat_report(spark):
    s = parse_segments(spark, [("a", dump(batch(0), data(0), batch(1, pid=9, control=True), control(1, False)))])
    out = [r["line_out"] for r in commands.txn_stat(s, line_numbers=True).collect()]
    assert out[:2] == ["num_committed: 0", "num_aborted: 1"]
    assert out[2] == "txn_size_stats: IntSummaryStatistics{count=0, sum=0, min=2147483647, average=0.000000, max=-2147483648}"
    assert out[4].startswith("empty_txn:6: EmptyTransaction[closingBatch=Batch(baseOffset=1") and "commit=false" in out[4]
    assert out[5].startswith("open_txn:3: ProducerSession[producerId=7, producerEpoch=1]->FirstBatchInTxn[firstBatchInTxn=Batch(") and out[5].endswith("numDataBatches=1]")


def test_txn_stat_guards(spark):
    with pytest.raises(ValueError, match="do not contain transactional"):
        commands.txn_stat(parse_segments(spark, [("a", state_log(["Ongoing"]))]))
    two = [("a", dump(batch(0), data(0))), ("b", dump(batch(0), data(0), path="/x/t-1/00000000000000000000.log"))]
    with pytest.raises(ValueError, match="multiple different topics"):
        commands.txn_stat(parse_segments(spark, two))


def test_long_duration(spark):
    s = parse_segments(spark, [("a", dump(batch(0, time=0), data(0), batch(1, control=True, time=2**31 + 5), control(1)))])
    t = T.transactions(s.batches)
    assert rows(t, "duration_ms") == [(2**31 + 5,)] and rows(t, T.wrap_int32()) == [(-(2**31) + 5,)]


def test_lints(spark):
    s = parse_segments(spark, [("a", dump(batch(0, leader=5, position=10), data(0), batch(0, leader=4, position=10), data(0)))])
    assert [rows(f(s.batches), "line") for f in (checks.lint_position, checks.lint_leader_epoch, checks.lint_offsets)] == [[(5,)]] * 3
    assert sorted(rows(T.first_last(s.batches.drop("line"), s.lines), "which", "line")) == [("first", 3), ("last", 5)]
    for lint in (checks.lint_position, checks.lint_leader_epoch, checks.lint_offsets):
        assert rows(lint(s.placed, s.lines), "line", "message") == rows(lint(s.batches), "line", "message")
    assert checks.transactional_violations(s.batches, False).count() == 2


def test_large_numbers_are_violations(spark):
    large = batch(0, pid=10**20), data(0), batch(1).replace("count: 1", "count: 99999999999"), data(1), batch(2), data(10**20)
    s = parse_segments(spark, [("a", dump(*large))])
    want = [(3, "number", f'For input string: "{10**20}"'), (5, "number", 'For input string: "99999999999"'), (8, "number", f'For input string: "{10**20}"')]
    assert found(s) == want
    assert rows(s.batches.orderBy("line"), "line", "producer_id", "count", F.size("messages")) == [(3, None, 1, 1), (5, 7, None, 1), (7, 7, 1, 1)]
    with pytest.raises(ValueError, match="a:3: For input"):
        commands.txn_stat(s)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_move_no_text(spark, tmp_path):
    for name, text in random_log(3)[0]:
        (tmp_path / name).write_text(text)
    s = read_segments(spark, [str(tmp_path)])
    plan = plan_of(filters.filter_batches(s.placed, pid=2))
    assert plan.count("FileScan text") == 1 and "hashpartitioning" not in plan
    numbers = plan_of(s.lines.numbers())
    assert not [x for x in numbers.split("\n") if "Exchange" in x and "value" in x]
    # adaptive plans share exchanges as they run, so scans are counted without those below an exchange that is met again
    checked = checks.violations(s)
    checked.collect()
    final = plan_of(checked).split("== Initial Plan ==")[0]
    assert final.count("FileScan text") <= 3


def test_sessions_and_lints_over_many_splits(spark, tmp_path):
    texts, expected = random_log(5, files=1, batches=150)
    (tmp_path / texts[0][0]).write_text(texts[0][1])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        s = read_segments(spark, [str(tmp_path)])
        assert s.lines.splits().count() > 10
        got = rows(T.transactions(s.placed), "producer_id", "producer_epoch", "status", "n_data", "duration_ms")
        assert sorted(got, key=repr) == expected
        assert checks.lint_offsets(s.placed, s.lines).count() == 0
        assert checks.lint_position(s.placed, s.lines).count() == s.placed.count() - 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_deep_dump_that_begins_with_empty_batches(spark, tmp_path):
    lines = [batch(i, 0) for i in range(200)] + [batch(200, 2), data(200), data(201)]
    (tmp_path / "a").write_text(dump(*lines))
    s = read_segments(spark, [str(tmp_path)])
    assert s.files.first()["deep_iteration"] and s.batches.agg(F.sum(F.size("messages"))).first()[0] == 2 and found(s) == []


def test_unknown_path(spark):
    s = parse_segments(spark, [("a", dump(batch(0), data(0), path="00000000000000000000.log"))])
    assert rows(checks.lint_unknown_path(s.files), "file_name") == [("a",)] and found(s) == []
