"""Registered queries of the dump engine, and the same results as SQL over ``events``, ``customer`` and ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import coordinating_partition
from ..operators import checks, filters, render
from ..operators import transactions as T
from ..sources.dumps import parse_segments, read_segments
from . import commands, dumpfiles, synthetic
from .commands import txn_stat

PID, EPOCH, LEADER = 7, 1, 1
_BATCH = [c for c in T.BATCH_FIELDS if c != "file_name"]


def _batches(df: DataFrame) -> DataFrame:
    return df.select("file_ord", "file_name", *_BATCH)


def _messages(df: DataFrame, kind: str, *names: str) -> DataFrame:
    m = df.select("file_ord", F.explode_outer(F.filter("messages", lambda m: m["kind"] == kind)).alias("m")).where("m is not null")
    return m.select("file_ord", *[F.col(f"m.{n}").alias(n) for n in ("line", "offset", "create_time", "key_size", "value_size", "sequence", "header_keys", *names)])


def _data(build, flawed: bool = False):
    return lambda spark, sf_dir: build(synthetic.data_segments(spark, sf_dir, flawed))


def _state(build, flawed: bool = False):
    return lambda spark, sf_dir: build(synthetic.state_segments(spark, sf_dir, flawed))


def _snapshot(build, newer: bool = True):
    return lambda spark, sf_dir: build(synthetic.snapshot(spark, sf_dir, newer))


def _txn_list(t: DataFrame) -> DataFrame:
    return t.select("producer_id", "producer_epoch", "txn_seq", "status", "n_data", "duration_ms")


def _coordinator(table: str, column: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(column).alias("id"), coordinating_partition(F.col(column)).alias("partition"), coordinating_partition(F.col(column), 7).alias("partition_of_7"))

    return query


def _first_last(s) -> DataFrame:
    r = T.first_last(s.placed, s.lines)
    return r.agg(*[F.max(F.when(F.col("which") == w, F.col(c))).alias(f"{w}_{c}") for w in ("first", "last") for c in ("file_name", "line", "base_offset", "producer_id", "create_time")])


def _chosen(s, **tests) -> DataFrame:
    return _batches(s.numbered(filters.filter_batches(s.placed, **tests)))


def _summary(s, **tests) -> DataFrame:
    return T.summary(T.transactions(filters.filter_batches(s.placed, **tests)))


def _file_columns(s) -> DataFrame:
    files = s.files.join(s.lines.edges().select("file_ord", "n_lines"), "file_ord")
    return files.select("file_ord", "file_name", "segment_type", "topic", "partition", "topic_suffix", "starting_offset", "deep_iteration", F.col("n_lines").cast("bigint").alias("n_lines"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dump text to transaction summary."""
    return _summary(synthetic.data_segments(spark, sf_dir))


def _txn_stat(s) -> DataFrame:
    return txn_stat(s, line_numbers=True)


def _files(build, write=dumpfiles.data_dumps):
    """A query over dump files on disk."""
    return lambda spark, sf_dir: build(read_segments(spark, [write(spark, sf_dir)]))


def _command(write, *command: str, **options):
    """A command over dump files on disk, strict."""
    return lambda spark, sf_dir: commands.run(spark, command, [write(spark, sf_dir)], **options)


def _headers(build):
    return lambda spark, sf_dir: build(parse_segments(spark, synthetic.header_dumps(spark, sf_dir)))


def _refused(build):
    """The error that a command raises before it plans anything."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        try:
            build(spark, sf_dir)
        except ValueError as e:
            return spark.createDataFrame([(str(e),)], "message string")
        return spark.createDataFrame([], "message string")

    return query


def _two_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.txn_stat(parse_segments(spark, [(n, f"Dumping /x/t-{n}/1.log\nStarting offset: 1\n") for n in ("0", "1")]))


def _no_producers(s) -> DataFrame:
    fifth = F.col("producer_id") % 5 == 0
    return checks.lint_producers(s.placed.withColumns({"producer_epoch": F.when(fifth, -1).otherwise(F.col("producer_epoch")), "producer_id": F.when(fifth, -1).otherwise(F.col("producer_id"))}), s.lines)


_STATES = [n for n in ("producer_id", "producer_epoch", "coordinator_epoch", "current_txn_first_offset", "last_timestamp", "first_sequence", "last_sequence", "last_offset", "offset_delta", "timestamp")]

QUERIES = {
    "txn_summary": flagship,
    "parse_batches": _data(lambda s: _batches(s.batches)),
    "parse_data_records": _data(lambda s: _messages(s.batches, "DATA")),
    "parse_control_records": _data(lambda s: _messages(s.batches, "CONTROL", "commit", "coordinator_epoch")),
    "parse_txn_state": _state(lambda s: _messages(s.batches, "STATE_CHANGE", "transaction_id", "txn_producer_id", "txn_producer_epoch", "state", "partitions", "txn_last_update_timestamp", "txn_timeout_ms")),
    "parse_txn_deletes": _state(lambda s: _messages(s.batches, "STATE_DELETE", "transaction_id")),
    "parse_snapshot_old": _snapshot(lambda s: s.states.select("line", *_STATES), newer=False),
    "parse_snapshot_new": _snapshot(lambda s: s.states.select("line", *_STATES)),
    "assemble_batches": _data(lambda s: s.batches.select("file_ord", "line", F.size("messages").alias("n_messages"), F.get("messages", F.lit(0))["line"].alias("message_line"), F.get("messages", F.lit(0))["kind"].alias("kind"))),
    "segment_types": _data(_file_columns),
    "segment_types_state": _state(_file_columns),
    "distinct_topics": _data(lambda s: T.topics(s.files)),
    "filter_pid": _data(lambda s: _chosen(s, pid=PID)),
    "filter_producer_epoch": _data(lambda s: _chosen(s, producer_epoch=EPOCH)),
    "filter_leader_epoch": _data(lambda s: _chosen(s, leader_epoch=LEADER)),
    "filter_all": _data(lambda s: _chosen(s, pid=PID, producer_epoch=EPOCH, leader_epoch=LEADER)),
    "filter_state_pid_epoch": _state(lambda s: _chosen(s, pid=PID, producer_epoch=EPOCH)),
    "filter_transactional_id": _state(lambda s: _chosen(s, transactional_id=f"txn-{PID}")),
    "snapshot_filter": _snapshot(lambda s: s.lines.add(filters.filter_states(s.placed, PID, EPOCH)).select("line", *_STATES)),
    "txn_list": _data(lambda s: _txn_list(T.transactions(s.placed))),
    "empty_txns": _data(lambda s: T.empty_transactions(T.transactions(s.placed), s.lines).select("producer_id", "producer_epoch", "commit", "file_ord", "line")),
    "open_txns": _data(lambda s: T.open_transactions(T.transactions(s.placed), s.lines).select("producer_id", "producer_epoch", "n_data", "file_ord", "line")),
    "first_last_batch": _data(_first_last),
    "txn_summary_filtered_leader": _data(lambda s: _summary(s, leader_epoch=LEADER)),
    "state_violations": _state(lambda s: checks.state_violations(s)),
    "identity_violations_data": _data(lambda s: checks.identity_violations(s.placed, s.lines), flawed=True),
    "identity_violations_state": _state(lambda s: checks.identity_violations(s.placed, s.lines), flawed=True),
    "validity_violations_data": _data(lambda s: checks.validity_violations(s.placed, s.lines), flawed=True),
    "validity_violations_state": _state(lambda s: checks.validity_violations(s.placed, s.lines), flawed=True),
    "record_violations": _data(lambda s: checks.grammar_violations(s), flawed=True),
    "lint_position": _data(lambda s: checks.lint_position(s.placed.withColumn("position", F.col("position") % 1000), s.lines)),
    "lint_leader_epoch": _data(lambda s: checks.lint_leader_epoch(s.placed.withColumn("partition_leader_epoch", F.col("producer_epoch").cast("int")), s.lines)),
    "txn_coord_partition": _coordinator("customer", "c_name"),
    "group_coord_partition": _coordinator("part", "p_name"),
    "cat_render": _data(lambda s: render.segment_lines(s.batches, True, True)),
    "cat_render_state": _state(lambda s: render.segment_lines(s.batches, False, False)),
    "snapshot_render": _snapshot(lambda s: render.state_lines(s.states, False, True)),
    "abort_cmd": _snapshot(lambda s: render.abort_lines(s.lines.add(filters.filter_states(s.placed, PID, EPOCH)))),
    "abort_cmd_all_open": _snapshot(lambda s: render.abort_lines(s.states, only_open=True)),
    "txn_stat_report": _data(_txn_stat),
    "cat_strict": _data(lambda s: commands.segment_cat(s, line_numbers=True)),
    "txn_info": _data(commands.txn_info),
    "broken_violations": lambda spark, sf_dir: checks.violations(synthetic.broken_data(spark, sf_dir), F.lit(True)),
    "broken_state_violations": lambda spark, sf_dir: checks.violations(synthetic.broken_state(spark, sf_dir)),
    "broken_batches": lambda spark, sf_dir: synthetic.broken_data(spark, sf_dir).batches.select("file_ord", "line", "base_offset", "producer_id", "count", F.size("messages").alias("n_messages")),
    "number_violations": lambda spark, sf_dir: checks.violations(synthetic.broken_data(spark, sf_dir)).where("check = 'number'"),
    "header_violations": _headers(lambda s: checks.file_violations(s.files)),
    "lint_unknown_path": _headers(lambda s: checks.lint_unknown_path(s.files)),
    "lint_topics": _headers(lambda s: checks.lint_topics(s.files)),
    "snapshot_violations": lambda spark, sf_dir: checks.snapshot_violations(synthetic.snapshot(spark, sf_dir, flawed=True)),
    "lint_producers": _snapshot(_no_producers),
    "transactional_violations": _state(lambda s: checks.transactional_violations(s.placed, True, s.lines), flawed=True),
    "lint_offsets": _data(lambda s: checks.lint_offsets(s.placed.withColumn("last_offset", F.col("last_offset") + F.col("last_offset") % 3), s.lines)),
    "lint_truncated": lambda spark, sf_dir: checks.lint_truncated(synthetic.broken_data(spark, sf_dir)),
    "control_count_violations": lambda spark, sf_dir: (lambda s: checks.control_count_violations(s.placed, s.lines))(synthetic.broken_data(spark, sf_dir)),
    "guard_not_data": _refused(lambda spark, sf_dir: commands.txn_stat(synthetic.state_segments(spark, sf_dir))),
    "guard_topics": _refused(_two_topics),
    "guard_transactional_id": _refused(lambda spark, sf_dir: commands.segment_cat(synthetic.data_segments(spark, sf_dir), transactional_id="txn-7")),
    "snapshot_render_colour": _snapshot(lambda s: render.state_lines(s.states, False, True, colour=True)),
    "snapshot_record_render": _snapshot(lambda s: s.states.select("line", render.snapshot_record_text().alias("line_out"))),
    "cat_render_state_colour": _state(lambda s: render.segment_lines(s.batches, False, False, colour=True)),
    "file_facts": _files(_file_columns),
    "file_shallow_facts": _files(_file_columns, lambda spark, sf_dir: dumpfiles.data_dumps(spark, sf_dir, deep=False)),
    "file_batches": _files(lambda s: _batches(s.batches)),
    "file_filter_pid": _files(lambda s: _chosen(s, pid=PID)),
    "file_txn_list": _files(lambda s: _txn_list(T.transactions(s.placed))),
    "file_cat": _command(dumpfiles.data_dumps, "segment", "cat", line_numbers=True),
    "file_shallow_cat": _command(lambda spark, sf_dir: dumpfiles.data_dumps(spark, sf_dir, deep=False), "segment", "cat", line_numbers=True),
    "file_txn_stat": _command(dumpfiles.data_dumps, "segment", "txn-stat", line_numbers=True),
    "file_state_cat": _command(dumpfiles.state_dumps, "segment", "cat", line_numbers=True, transactional_id=f"txn-{PID}"),
    "file_snapshot_cat": _command(dumpfiles.snapshot_dumps, "snapshot", "cat", line_numbers=True),
    "file_abort_cmd": _command(dumpfiles.snapshot_dumps, "snapshot", "abort-cmd", pid=PID, producer_epoch=EPOCH),
}

# --- the same as SQL -------------------------------------------------------

_E = """e AS (
  SELECT event_id, user_id, event_type, CASE event_type WHEN 'signup' THEN 'COMMIT' WHEN 'error' THEN 'ABORT' ELSE 'DATA' END AS kind,
    epoch_us(ts) // 1000 AS ms, coalesce(length(props), 0) AS props, (event_id // 2500)::INT AS file_ord, event_id % 2500 AS i FROM events)"""


def _b(pid: str = "user_id", epoch: str = "user_id % 3", txn: str = "TRUE", control: str = "kind <> 'DATA'", valid: str = "TRUE") -> str:
    return f"""{_E},
b AS (
  SELECT file_ord, printf('%020d.dump', file_ord) AS file_name, (2 * i + 3)::INT AS line, event_id AS base_offset, event_id AS last_offset, 1::INT AS count,
    (event_id % 1000)::INT AS base_sequence, (event_id % 1000)::INT AS last_sequence, ({pid})::BIGINT AS producer_id, ({epoch})::SMALLINT AS producer_epoch,
    (event_id // 4000)::INT AS partition_leader_epoch, {txn} AS is_transactional, {control} AS is_control, i * 100 AS position, ms AS create_time, (props + 61)::INT AS size,
    2::TINYINT AS magic, 'none' AS compress_codec, ((event_id::HUGEINT * 2654435761 + 2147483648) % 4294967296 - 2147483648)::INT AS crc, {valid} AS is_valid,
    event_id, user_id, event_type, kind, ms, props, i FROM e)"""


_STATE_BATCH = _b("-1", "-1", "FALSE", "FALSE")
_BAD_DATA = _b("CASE WHEN event_id % 89 = 0 THEN -1 ELSE user_id END", "CASE WHEN event_id % 83 = 0 THEN -1 ELSE user_id % 3 END", valid="event_id % 97 <> 0")
_BAD_STATE = _b("CASE WHEN event_id % 89 = 0 THEN user_id ELSE -1 END", "CASE WHEN event_id % 83 = 0 THEN 0 ELSE -1 END", "event_id % 97 = 0", "FALSE")
_COLUMNS = "file_ord, file_name, " + ", ".join(_BATCH)
_MESSAGE = "file_ord, (line + 1)::INT AS line, event_id AS \"offset\", ms AS create_time, 4::INT AS key_size, (props % 50)::INT AS value_size, (event_id % 1000)::INT AS sequence, 'h' || (event_id % 7) AS header_keys"
_STATE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in synthetic.STATE_OF.items()) + " ELSE 'Dead' END"
_ISO = "strftime(make_timestamp({0} * 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {0} % 1000 = 0 THEN '' ELSE printf('.%03d', {0} % 1000) END || 'Z'"


def _row(check_order: int, check: str, message: str, where: str, line: str = "line") -> str:
    return f"SELECT file_ord, file_name, ({line})::INT AS line, {check_order}::INT AS check_order, '{check}' AS \"check\", {message} AS message FROM b WHERE {where}"


_TXN = """t0 AS (SELECT *, sum(CASE WHEN is_control THEN 1 ELSE 0 END) OVER (PARTITION BY producer_id, producer_epoch ORDER BY file_ord, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seq FROM {0}),
t AS (
  SELECT producer_id, producer_epoch, coalesce(seq, 0)::BIGINT AS txn_seq, count(*) FILTER (NOT is_control) AS n_data, bool_or(is_control) AS closed, bool_or(kind = 'COMMIT') AS is_commit,
    arg_min(create_time, event_id) FILTER (NOT is_control) AS begun, max(create_time) FILTER (is_control) AS ended, arg_min(file_ord, event_id) FILTER (NOT is_control) AS first_file,
    arg_min(line, event_id) FILTER (NOT is_control) AS first_line, max(file_ord) FILTER (is_control) AS closed_file, max(line) FILTER (is_control) AS closed_line,
    min(event_id) FILTER (NOT is_control) AS first_event, max(event_id) FILTER (is_control) AS closed_event
  FROM t0 GROUP BY 1, 2, 3),
x AS (SELECT *, CASE WHEN NOT closed THEN 'OPEN' WHEN n_data = 0 THEN 'EMPTY' WHEN is_commit THEN 'COMMITTED' ELSE 'ABORTED' END AS status, CASE WHEN closed AND n_data > 0 THEN ended - begun END AS duration_ms FROM t)"""
_FULL = "FILTER (closed AND n_data > 0)"
_TOTALS = f"""SELECT count(*) FILTER (closed AND is_commit) AS num_committed, count(*) FILTER (closed AND NOT is_commit) AS num_aborted,
  count(n_data) {_FULL} AS size_count, (sum(n_data) {_FULL})::BIGINT AS size_sum, min(n_data) {_FULL} AS size_min, max(n_data) {_FULL} AS size_max, avg(n_data) {_FULL} AS size_avg,
  count(duration_ms) AS duration_count, sum(duration_ms)::BIGINT AS duration_sum, min(duration_ms) AS duration_min, max(duration_ms) AS duration_max, avg(duration_ms) AS duration_avg,
  count(*) FILTER (status = 'EMPTY') AS num_empty, count(*) FILTER (status = 'OPEN') AS num_open FROM x"""


def _snap(newer: bool) -> str:
    return f"""{_E},
u AS (SELECT user_id, count(*) FILTER (kind <> 'DATA') AS markers, min(event_id) AS lo, max(event_id) AS hi, max(ms) AS ms FROM e GROUP BY 1),
s AS (
  SELECT (row_number() OVER (ORDER BY user_id) + 1)::INT AS line, user_id AS producer_id, (user_id % 3)::SMALLINT AS producer_epoch, markers::INT AS coordinator_epoch,
    CASE WHEN user_id % 4 = 0 THEN 0 ELSE lo END AS current_txn_first_offset, {"ms" if newer else "0::BIGINT"} AS last_timestamp, (lo % 1000)::INT AS first_sequence,
    (hi % 1000)::INT AS last_sequence, hi AS last_offset, (hi - lo)::INT AS offset_delta, ms AS timestamp FROM u)"""


_RENDER_BATCH = "'Batch(' || " + " || ', ' || ".join(f"'{label}=' || " + (_ISO.format("create_time") if f[0] == "@" else f"'''' || {f[1:]} || ''''" if f[0] == "'" else f"{f}::VARCHAR") for label, f in render.BATCH_NAMES) + " || ')'"
_RENDER_SHARED = f"'offset=' || event_id || ', createTime=' || {_ISO.format('ms')} || ', keySize=4, valueSize=' || (props % 50) || ', sequence=' || (event_id % 1000)"
_KEYS = "'''h' || (event_id % 7) || ''''"
_RENDER_CONTROL = f"'ControlMessage(' || {_RENDER_SHARED} || ', headers=' || {_KEYS} || ', commit=' || {{0}} || ', coordinatorEpoch=' || (user_id % 5) || ')'"
_RENDER_DATA = f"'DataMessage(' || {_RENDER_SHARED} || ', headerKeys=' || {_KEYS} || ')'"
_RENDER_CHANGE = (
    f"'TransactionStateMessage(' || {_RENDER_SHARED} || ', headerKeys=' || {_KEYS} || ', transactionId=''txn-' || user_id || ''', producerId=' || user_id || ', producerEpoch=' || (user_id % 3) "
    f"|| ', state=' || {_STATE} || ', partitions=''orders-' || (user_id % 9) || ''', txnLastUpdateTimestamp=' || {_ISO.format('ms')} || ', txnTimeoutMs=60000)'"
)
_RENDER_DELETE = f"'TransactionStateDeletion(' || {_RENDER_SHARED} || ', headerKeys=' || {_KEYS} || ', transactionId=''txn-' || user_id || ''')'"
_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(id, ''), lambda c: unicode(c)::BIGINT)), lambda h, u: (h * 31 + u) % 4294967296)"
_ABORT = "printf('" + render.ABORT.replace("%d", "{}").replace("{}", "%d") + "', producer_id, producer_epoch, coordinator_epoch) AS line_out"
_LEGAL = " OR ".join(f"(state = '{s}' AND previous IN ({', '.join(repr(p) for p in before)}))" for s, before in checks.PREVIOUS_STATES.items())


def _coordinator_sql(table: str, column: str) -> str:
    return f"""WITH n AS (SELECT {column} AS id FROM {table}), h AS (SELECT id, CASE WHEN id = '' THEN 0 ELSE {_HASH} END AS u FROM n),
g AS (SELECT id, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS s FROM h)
SELECT id, (CASE WHEN s = -2147483648 THEN 0 ELSE abs(s) END % 50)::INT AS partition, (CASE WHEN s = -2147483648 THEN 0 ELSE abs(s) END % 7)::INT AS partition_of_7 FROM g"""


def _stat_text(name: str) -> str:
    return f"'IntSummaryStatistics{{count=' || {name}_count || ', sum=' || coalesce({name}_sum, 0) || ', min=' || {name}_min || ', average=' || printf('%.6f', {name}_avg) || ', max=' || {name}_max || '}}'"


def _where(batch: str, test: str) -> str:
    return f"WITH {batch} SELECT {_COLUMNS} FROM b WHERE {test}"


def _files(kind: str, topic: str, partition: int) -> str:
    return f"""WITH {_E} SELECT file_ord, printf('%020d.dump', file_ord) AS file_name, '{kind}' AS segment_type, '{topic}' AS topic, {partition}::INT AS partition, '-{partition}' AS topic_suffix,
  file_ord::BIGINT AS starting_offset, TRUE AS deep_iteration, (2 + 2 * count(*))::BIGINT AS n_lines FROM e GROUP BY file_ord"""


_SEGMENT_FIRST = "SELECT file_ord, line, {0} || " + _RENDER_BATCH + " AS line_out FROM b"

ORACLE_SQL = {
    "txn_summary": f"WITH {_b()}, {_TXN.format('b')} {_TOTALS}",
    "parse_batches": _where(_b(), "TRUE"),
    "parse_data_records": f"WITH {_b()} SELECT {_MESSAGE} FROM b WHERE NOT is_control",
    "parse_control_records": f"WITH {_b()} SELECT {_MESSAGE}, kind = 'COMMIT' AS \"commit\", (user_id % 5)::INT AS coordinator_epoch FROM b WHERE is_control",
    "parse_txn_state": f"""WITH {_STATE_BATCH} SELECT {_MESSAGE}, 'txn-' || user_id AS transaction_id, user_id AS txn_producer_id, (user_id % 3)::SMALLINT AS txn_producer_epoch, {_STATE} AS state,
  'orders-' || (user_id % 9) AS partitions, ms AS txn_last_update_timestamp, 60000::BIGINT AS txn_timeout_ms FROM b WHERE event_id % 50 <> 49""",
    "parse_txn_deletes": f"WITH {_STATE_BATCH} SELECT {_MESSAGE}, 'txn-' || user_id AS transaction_id FROM b WHERE event_id % 50 = 49",
    "parse_snapshot_old": f"WITH {_snap(False)} SELECT * FROM s",
    "parse_snapshot_new": f"WITH {_snap(True)} SELECT * FROM s",
    "assemble_batches": f"WITH {_b()} SELECT file_ord, line, 1::INT AS n_messages, (line + 1)::INT AS message_line, CASE WHEN is_control THEN 'CONTROL' ELSE 'DATA' END AS kind FROM b",
    "segment_types": _files("DATA", "orders", 3),
    "segment_types_state": _files("TRANSACTION_STATE", "__transaction_state", 7),
    "distinct_topics": "SELECT '-3' AS topic_suffix FROM events LIMIT 1",
    "filter_pid": _where(_b(), f"producer_id = {PID}"),
    "filter_producer_epoch": _where(_b(), f"producer_epoch = {EPOCH}"),
    "filter_leader_epoch": _where(_b(), f"partition_leader_epoch = {LEADER}"),
    "filter_all": _where(_b(), f"producer_id = {PID} AND producer_epoch = {EPOCH} AND partition_leader_epoch = {LEADER}"),
    "filter_state_pid_epoch": _where(_STATE_BATCH, f"event_id % 50 <> 49 AND user_id = {PID} AND user_id % 3 = {EPOCH}"),
    "filter_transactional_id": _where(_STATE_BATCH, f"user_id = {PID}"),
    "snapshot_filter": f"WITH {_snap(True)} SELECT * FROM s WHERE producer_id = {PID} AND producer_epoch = {EPOCH}",
    "txn_list": f"WITH {_b()}, {_TXN.format('b')} SELECT producer_id, producer_epoch, txn_seq, status, n_data, duration_ms FROM x",
    "empty_txns": f"WITH {_b()}, {_TXN.format('b')} SELECT producer_id, producer_epoch, is_commit AS \"commit\", closed_file AS file_ord, closed_line AS line FROM x WHERE status = 'EMPTY'",
    "open_txns": f"WITH {_b()}, {_TXN.format('b')} SELECT producer_id, producer_epoch, n_data, first_file AS file_ord, first_line AS line FROM x WHERE status = 'OPEN'",
    "first_last_batch": f"WITH {_b()} SELECT " + ", ".join(f"{f}({c}, event_id) AS {w}_{c}" for w, f in (("first", "arg_min"), ("last", "arg_max")) for c in ("file_name", "line", "base_offset", "producer_id", "create_time")) + " FROM b",
    "txn_summary_filtered_leader": f"WITH {_b()}, b1 AS (SELECT * FROM b WHERE partition_leader_epoch = {LEADER}), {_TXN.format('b1')} {_TOTALS}",
    "state_violations": f"""WITH {_STATE_BATCH}, m AS (SELECT file_ord, file_name, (line + 1)::INT AS line, {_STATE} AS state, lag({_STATE}) OVER (PARTITION BY file_ord, user_id ORDER BY line) AS previous FROM b WHERE event_id % 50 <> 49)
SELECT file_ord, file_name, line, 7::INT AS check_order, 'state_machine' AS "check", file_name || ':' || line || ': Illegal state change from ' || previous || ' to ' || state AS message FROM m
WHERE previous IS NOT NULL AND NOT ({_LEGAL})""",
    "identity_violations_data": f"WITH {_BAD_DATA} " + _row(5, "data_pid", "'Transactional batch with producerId == -1'", "producer_id = -1") + " UNION ALL " + _row(5, "data_epoch", "'Transactional batch with producerEpoch == -1'", "producer_id <> -1 AND producer_epoch = -1"),
    "identity_violations_state": f"WITH {_BAD_STATE} " + _row(5, "state_pid", "'Segment of __transaction_state with producerId != -1'", "producer_id <> -1") + " UNION ALL " + _row(5, "state_epoch", "'Segment of __transaction_state with producerEpoch != -1'", "producer_id = -1 AND producer_epoch <> -1"),
    "validity_violations_data": f"WITH {_BAD_DATA} " + _row(6, "valid", "file_name || ':' || line || ': Batch is not valid'", "NOT is_valid"),
    "validity_violations_state": f"WITH {_BAD_STATE} " + _row(8, "transactional", "file_name || ':' || line || ': Batch was transactional'", "is_transactional"),
    "record_violations": f"WITH {_BAD_DATA} " + _row(4, "record", "'Expected 1 data records in batch, but this doesn''t look like a data record'", "NOT is_control AND event_id % 101 = 0", "line + 1"),
    "lint_position": f"""WITH {_b()}, q AS (SELECT file_ord, file_name, line, position % 1000 AS here FROM b), p AS (SELECT *, lag(here) OVER (PARTITION BY file_ord ORDER BY line) AS previous FROM q)
SELECT file_ord, file_name, line, 20::INT AS check_order, 'position' AS "check", file_name || ':' || line || ': Batch position ' || here || ' is not above the previous batch position ' || previous AS message FROM p WHERE previous >= here""",
    "lint_leader_epoch": f"""WITH {_b()}, p AS (SELECT *, lag(producer_epoch) OVER (PARTITION BY file_ord ORDER BY line) AS previous FROM b)
SELECT file_ord, file_name, line, 21::INT AS check_order, 'leader_epoch' AS "check", file_name || ':' || line || ': Batch leader epoch ' || producer_epoch || ' is below the previous batch leader epoch ' || previous AS message FROM p WHERE previous > producer_epoch""",
    "txn_coord_partition": _coordinator_sql("customer", "c_name"),
    "group_coord_partition": _coordinator_sql("part", "p_name"),
    "cat_render": f"WITH {_b()} " + _SEGMENT_FIRST.format("file_name || ':' || line || ': '") + f" UNION ALL SELECT file_ord, (line + 1)::INT, file_name || ':' || (line + 1) || ':   ' || CASE WHEN is_control THEN {_RENDER_CONTROL.format('lower(kind)')} ELSE {_RENDER_DATA} END FROM b",
    "cat_render_state": f"WITH {_STATE_BATCH} " + _SEGMENT_FIRST.format("''") + f" UNION ALL SELECT file_ord, (line + 1)::INT, '  ' || CASE WHEN event_id % 50 = 49 THEN {_RENDER_DELETE} ELSE {_RENDER_CHANGE} END FROM b",
    "snapshot_render": f"WITH {_snap(True)} SELECT 0::INT AS file_ord, line, line || ': ProducerState(' || " + " || ', ' || ".join(f"'{label}=' || " + (_ISO.format(f[1:]) if f[0] == "@" else f) for label, f in render.STATE_NAMES) + " || ')' AS line_out FROM s",
    "abort_cmd": f"WITH {_snap(True)} SELECT 0::INT AS file_ord, line, {_ABORT} FROM s WHERE producer_id = {PID} AND producer_epoch = {EPOCH}",
    "abort_cmd_all_open": f"WITH {_snap(True)} SELECT 0::INT AS file_ord, line, {_ABORT} FROM s WHERE current_txn_first_offset > 0",
    "txn_stat_report": f"""WITH {_b()}, {_TXN.format('b')}, y AS ({_TOTALS}), f AS (SELECT count(DISTINCT file_ord) > 1 AS many FROM e)
SELECT 0::INT AS part, 0::INT AS file_ord, 0::INT AS line, 'num_committed: ' || num_committed AS line_out FROM y
UNION ALL SELECT 1, 0, 0, 'num_aborted: ' || num_aborted FROM y
UNION ALL SELECT 2, 0, 0, 'txn_size_stats: ' || {_stat_text('size')} FROM y
UNION ALL SELECT 3, 0, 0, 'txn_duration_stats_ms: ' || {_stat_text('duration')} FROM y
UNION ALL SELECT 4, closed_file, closed_line, 'empty_txn:' || CASE WHEN many THEN file_name || ':' ELSE '' END || closed_line || ': EmptyTransaction[closingBatch=' || {_RENDER_BATCH} || ', controlMessage=' || {_RENDER_CONTROL.format("(kind = 'COMMIT')::VARCHAR")} || ']'
  FROM (SELECT b.*, x.closed_file, x.closed_line + 1 AS closed_line FROM x JOIN b ON b.event_id = x.closed_event WHERE status = 'EMPTY'), f
UNION ALL SELECT 5, 0, 0, 'open_txn:' || CASE WHEN many THEN file_name || ':' ELSE '' END || line || ': ProducerSession[producerId=' || producer_id || ', producerEpoch=' || producer_epoch || ']->FirstBatchInTxn[firstBatchInTxn=' || {_RENDER_BATCH} || ', numDataBatches=' || n || ']'
  FROM (SELECT b.*, x.n_data AS n FROM x JOIN b ON b.event_id = x.first_event WHERE status = 'OPEN'), f""",
}
_BROKEN = f"""{_E},
p AS (SELECT *, event_id % 50 AS f, CASE WHEN event_id % 50 = 6 THEN 1 WHEN event_id % 50 IN (4, 5, 8, 9) THEN 3 ELSE 2 END AS n FROM e),
b AS (SELECT *, printf('%020d.dump', file_ord) AS file_name, (3 + coalesce(sum(n) OVER (PARTITION BY file_ord ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS line FROM p)"""
_SAYS = lambda raw: f"'For input string: \"{raw}\"'"
_DUE = lambda n, kind: f"'Expected {n} {kind} records in batch, but this doesn''t look like a {kind} record'"
_NUMBERS = " UNION ALL ".join([_row(4, "number", _SAYS(synthetic.LARGE_LONG), "f = 0"), _row(4, "number", _SAYS(synthetic.LARGE_INT), "f = 1"), _row(4, "number", _SAYS(synthetic.LARGE_LONG), "f = 2", "line + 1")])
_CONTROLS = _row(9, "control_count", f"'{checks.CONTROL_COUNT}'", "f = 8")
_NATIONS = "n AS (SELECT n_nationkey AS k, (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS file_ord, printf('%03d', n_nationkey) AS file_name FROM nation), b AS (SELECT *, 1 AS line FROM n)"
_ESC = "chr(27)"
_PAINT = lambda code, text: f"{_ESC} || '[{code}m' || {text} || {_ESC} || '[0m'"
_PAINTED = {"producer_id", "producer_epoch", "coordinator_epoch"}


def _state_list(paint: bool, times: bool, opened: str, close: str) -> str:
    value = lambda f: _ISO.format(f[1:]) if f[0] == "@" and times else f"{_ESC} || '[1m' || {_ESC} || '[34m' || {f} || {_ESC} || '[0m'" if paint and f in _PAINTED else f.lstrip("@")
    return f"'{opened}' || " + " || ', ' || ".join(f"'{label}=' || " + value(f) for label, f in render.STATE_NAMES) + f" || '{close}'"


def _on_disk(count: str, deep: bool = True) -> str:
    """Batches of the dump files: ``count`` records each, 5000 batches a file."""
    e = _E.replace("event_id // 2500", f"event_id // {dumpfiles.PER_FILE}").replace("event_id % 2500", f"event_id % {dumpfiles.PER_FILE}")
    lines = f"1 + {count}" if deep else "1"
    b = _b().split("b AS (", 1)[1].replace("(2 * i + 3)::INT AS line", "at_line AS line").replace("1::INT AS count", f"({count})::INT AS count").replace("FROM e)", "FROM l)")
    return f"{e}, l AS (SELECT *, (3 + coalesce(sum({lines}) OVER (PARTITION BY file_ord ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS at_line FROM e),\nb AS ({b}"


_COUNT = "CASE WHEN kind = 'DATA' THEN event_id % 3 + 1 ELSE 1 END"
_DISK, _SHALLOW = _on_disk(_COUNT), _on_disk(_COUNT, deep=False)
_MANY = "f AS (SELECT count(DISTINCT file_ord) > 1 AS many FROM e)"
_HERE = "CASE WHEN many THEN file_name || ':' ELSE '' END || line || ': '"


def _disk_facts(deep: bool) -> str:
    return f"""WITH {_DISK if deep else _SHALLOW} SELECT file_ord, file_name, 'DATA' AS segment_type, 'orders' AS topic, 3::INT AS partition, '-3' AS topic_suffix, file_ord::BIGINT AS starting_offset, {deep} AS deep_iteration,
  (2 + sum({"1 + count" if deep else "1"}))::BIGINT AS n_lines FROM b GROUP BY file_ord, file_name"""


ORACLE_SQL |= {
    "cat_strict": ORACLE_SQL["cat_render"].replace(f"WITH {_b()} ", f"WITH {_b()}, {_MANY} ").replace("file_name || ':' || line ||", "CASE WHEN many THEN file_name || ':' ELSE '' END || line ||").replace("file_name || ':' || (line + 1) ||", "CASE WHEN many THEN file_name || ':' ELSE '' END || (line + 1) ||").replace("FROM b", "FROM b, f"),
    "txn_info": f"""WITH {_b()}, {_TXN.format('b')}, y AS ({_TOTALS}),
r AS (SELECT *, {_RENDER_BATCH} AS text, {_RENDER_CONTROL.format("(kind = 'COMMIT')::VARCHAR")} AS marker
  FROM (SELECT b.*, x.status, x.n_data AS n FROM x JOIN b ON b.event_id = CASE x.status WHEN 'EMPTY' THEN x.closed_event ELSE x.first_event END WHERE x.status IN ('EMPTY', 'OPEN')))
SELECT 'SegmentInfo[openTransactions={{' || coalesce((SELECT string_agg('ProducerSession[producerId=' || producer_id || ', producerEpoch=' || producer_epoch || ']=FirstBatchInTxn[firstBatchInTxn=' || text || ', numDataBatches=' || n || ']', ', ' ORDER BY producer_id, producer_epoch) FROM r WHERE status = 'OPEN'), '')
  || '}}, firstBatch=' || (SELECT {_RENDER_BATCH} FROM b ORDER BY event_id LIMIT 1) || ', lastBatch=' || (SELECT {_RENDER_BATCH} FROM b ORDER BY event_id DESC LIMIT 1)
  || ', emptyTransactions=[' || coalesce((SELECT string_agg('EmptyTransaction[closingBatch=' || text || ', controlMessage=' || marker || ']', ', ' ORDER BY file_ord, line) FROM r WHERE status = 'EMPTY'), '')
  || '], committed=' || num_committed || ', aborted=' || num_aborted || ', txnSizeStats=' || {_stat_text('size')} || ', txnDurationStats=' || {_stat_text('duration')} || ']' AS info_out FROM y""",
    "broken_violations": f"WITH {_BROKEN} " + " UNION ALL ".join([_NUMBERS, _CONTROLS, _row(4, "record", _DUE(1, "data"), "f = 3", "line + 2"), _row(4, "batch", "'Expected a message batch'", "f IN (4, 5)", "line + 2"), _row(4, "batch", "'Expected a message batch'", "f = 6"), _row(4, "record", _DUE(1, "control"), "f = 7", "line + 1")]),
    "broken_state_violations": f"WITH {_STATE_BATCH}, b1 AS (SELECT *, event_id % 50 AS f FROM b) " + " UNION ALL ".join([_row(4, "payload", "'Didn''t match expected pattern'", "f = 0", "line + 1"), _row(4, "record", _DUE(1, "txn"), "f = 1", "line + 1"), _row(4, "number", _SAYS(synthetic.LARGE_LONG), "f = 2", "line + 1")]).replace("FROM b ", "FROM b1 "),
    "broken_batches": f"WITH {_BROKEN} SELECT file_ord, line, event_id AS base_offset, CASE WHEN f <> 0 THEN user_id END AS producer_id, CASE WHEN f = 1 THEN NULL WHEN f IN (8, 9) THEN 2 ELSE 1 END::INT AS count, CASE WHEN f IN (8, 9) THEN 2 ELSE 1 END::INT AS n_messages FROM b WHERE f NOT IN (3, 6) AND i <> {synthetic.PER_FILE - 1}",
    "number_violations": f"WITH {_BROKEN} {_NUMBERS}",
    "control_count_violations": f"WITH {_BROKEN} {_CONTROLS}",
    "lint_truncated": f"WITH {_BROKEN} " + _row(23, "truncated", "file_name || ':' || line || ': Batch has 1 of 2 records'", f"i = {synthetic.PER_FILE - 1}"),
    "header_violations": f"WITH {_NATIONS} " + " UNION ALL ".join([
        _row(0, "lines", "'Expected > 0 lines'", "k % 7 = 0"), _row(1, "lines", "'Expected > 1 lines'", "k % 7 = 1", "2"), _row(0, "dumping_line", f"'{checks.NO_DUMPING}'", "k % 7 = 2"), _row(1, "offset_line", f"'{checks.NO_OFFSET}'", "k % 7 = 3", "2"),
        _row(3, "offset_name", "'Segment file name /x-1/' || k || '.log implies starting offset of ' || k || ' but 2nd line says offset is 4' || k", "k % 7 = 4", "2"), _row(2, "file_name", f"'{checks.NO_NAME}'", "k % 7 = 5", "2"), _row(4, "batch", "'Expected a message batch'", "k % 7 = 6", "3"),
    ]),
    "lint_unknown_path": f"WITH {_NATIONS} " + _row(26, "unknown_path", f"'{checks.NO_PARENT.replace(chr(39), chr(39) * 2)}'", "k % 7 = 6"),
    "lint_topics": f"WITH {_NATIONS} " + _row(25, "topic", "'Dump of another topic partition than the first'", "k % 7 IN (1, 3, 4, 5)"),
    "snapshot_violations": f"WITH {_snap(True)}, b AS (SELECT *, 0::INT AS file_ord, '0.snapshot' AS file_name FROM s) " + _row(4, "record", "'This doesn''t look like a data record'", "producer_id % 7 = 0") + " UNION ALL " + _row(4, "number", _SAYS(synthetic.LARGE_LONG), "producer_id % 7 <> 0 AND producer_id % 11 = 0"),
    "lint_producers": f"WITH {_snap(True)}, b AS (SELECT *, 0::INT AS file_ord, '0.snapshot' AS file_name FROM s) " + _row(24, "producer", "file_name || ':' || line || ': Not a transactional producer'", "producer_id % 5 = 0"),
    "transactional_violations": f"WITH {_BAD_STATE} " + _row(8, "transactional", "file_name || ':' || line || ': Batch was not transactional'", "NOT is_transactional"),
    "lint_offsets": f"""WITH {_b()}, p AS (SELECT *, lag(last_offset + last_offset % 3) OVER (PARTITION BY file_ord ORDER BY line) AS previous FROM b)
SELECT file_ord, file_name, line, 22::INT AS check_order, 'offsets' AS "check", file_name || ':' || line || ': Batch base offset ' || base_offset || ' is not above the previous last offset ' || previous AS message FROM p WHERE previous >= base_offset""",
    "guard_not_data": "SELECT '__transaction_state partitions do not contain transactional messages' AS message",
    "guard_topics": "SELECT 'Segment dumps come from multiple different topics [''-0'', ''-1'']' AS message",
    "guard_transactional_id": "SELECT 'a transactional id can only be used on partitions of __transaction_state' AS message",
    "snapshot_render_colour": f"WITH {_snap(True)} SELECT 0::INT AS file_ord, line, line || ': ' || {_state_list(True, True, 'ProducerState(', ')')} AS line_out FROM s",
    "snapshot_record_render": f"WITH {_snap(True)} SELECT line, {_state_list(False, False, 'ProducerSnapshot{', '}')} AS line_out FROM s",
    "cat_render_state_colour": f"WITH {_STATE_BATCH} SELECT file_ord, line, regexp_replace({_RENDER_BATCH}, '^(.*isValid=)(.*)\\)$', {_ESC} || '[1m\\1' || {_ESC} || '[0m\\2' || {_ESC} || '[1m)' || {_ESC} || '[0m') AS line_out FROM b"
    + f" UNION ALL SELECT file_ord, (line + 1)::INT, '  ' || CASE WHEN event_id % 50 = 49 THEN {_RENDER_DELETE} ELSE {_RENDER_CHANGE.replace('|| ' + _STATE + ' ||', '|| ' + _PAINT('34', _STATE) + ' ||')} END FROM b",
    "file_facts": _disk_facts(True),
    "file_shallow_facts": _disk_facts(False),
    "file_batches": _where(_DISK, "TRUE"),
    "file_filter_pid": _where(_DISK, f"producer_id = {PID}"),
    "file_txn_list": f"WITH {_DISK}, {_TXN.format('b')} SELECT producer_id, producer_epoch, txn_seq, status, n_data, duration_ms FROM x",
    "file_cat": f"WITH {_DISK}, {_MANY} SELECT file_ord, line, {_HERE} || {_RENDER_BATCH} AS line_out FROM b, f UNION ALL SELECT file_ord, line, {_HERE} || '  ' || CASE WHEN is_control THEN {_RENDER_CONTROL.format('lower(kind)')} ELSE {_RENDER_DATA} END FROM (SELECT * REPLACE ((line + k)::INT AS line) FROM b, range(1, 4) r(k) WHERE k <= count), f",
    "file_shallow_cat": f"WITH {_SHALLOW}, {_MANY} SELECT file_ord, line, {_HERE} || {_RENDER_BATCH} AS line_out FROM b, f",
    "file_txn_stat": ORACLE_SQL["txn_stat_report"].replace(_b(), _DISK),
    "file_state_cat": f"WITH {_on_disk('1').replace('kind <> ' + chr(39) + 'DATA' + chr(39) + ' AS is_control', 'FALSE AS is_control').replace('(user_id)::BIGINT AS producer_id, (user_id % 3)::SMALLINT AS producer_epoch', '(-1)::BIGINT AS producer_id, (-1)::SMALLINT AS producer_epoch').replace('TRUE AS is_transactional', 'FALSE AS is_transactional')}, {_MANY} "
    + f"SELECT file_ord, line, {_HERE} || {_RENDER_BATCH} AS line_out FROM b, f WHERE user_id = {PID} UNION ALL SELECT file_ord, line, {_HERE} || '  ' || {_RENDER_CHANGE.replace(_STATE, 'CASE WHEN user_id % 2 = 0 THEN ' + chr(39) + 'Ongoing' + chr(39) + ' ELSE ' + chr(39) + 'Empty' + chr(39) + ' END')} FROM (SELECT * REPLACE ((line + 1)::INT AS line) FROM b WHERE user_id = {PID}), f",
    "file_snapshot_cat": ORACLE_SQL["snapshot_render"],
    "file_abort_cmd": ORACLE_SQL["abort_cmd"],
}
# a marker's line is the one below its batch
ORACLE_SQL["empty_txns"] = ORACLE_SQL["empty_txns"].replace("closed_line AS line FROM x", "(closed_line + 1)::INT AS line FROM x")
