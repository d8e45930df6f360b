"""Segment dumps as DataFrames.

A dump file is scanned with a record separator that begins a batch line, so each
Spark row is one whole batch and the scan stays splittable.  Batches are parsed and
filtered straight on the scan: (file_ord, split, place) is their place in the log,
and no text is shuffled.  Line numbers are made only for rows that are shown: the
numbers of lines of all rows (integers, no text) are summed within each split, and
the splits' totals are prefix-summed, so no file needs to fit one task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import grammar as G
from ..functions.scalars import base_name, parent_name

#: A batch line begins so.
LEAD = "baseOffset: "
DATA, TRANSACTION_STATE, CONSUMER_OFFSETS = "DATA", "TRANSACTION_STATE", "CONSUMER_OFFSETS"
#: Internal topics.
STATE_TOPIC, OFFSETS_TOPIC = "__transaction_state", "__consumer_offsets"

MESSAGE = (
    "struct<kind: string, line: int, offset: bigint, create_time: bigint, key_size: int, value_size: int, sequence: int, header_keys: string, commit: boolean, coordinator_epoch: int, "
    "transaction_id: string, txn_producer_id: bigint, txn_producer_epoch: smallint, state: string, partitions: string, txn_last_update_timestamp: bigint, txn_timeout_ms: bigint, bad_number: string>"
)
#: Place of a row in the log.
PLACE = ["file_ord", "split", "place"]
#: So many bytes of a file's beginning are read, and twice as many each time while they do not tell what kind of dump it is, up to the
#: second number (a dump that begins with as much of batches without records counts as shallow); files are read by so many threads.
PEEK_BYTES, MOST_BYTES, PEEK_THREADS = 1 << 14, 1 << 24, 32
#: What the beginning of a file tells; file_ord int and file_name string come before it.
FACTS = "lead string, deep_iteration boolean"


def ordered_files(spark: SparkSession, paths: Iterable[str]) -> list[tuple[int, str, str]]:
    """(file_ord, file_name, path) of files, directories or globs, ordered by base name; equal names keep their order."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        store = path.getFileSystem(conf)
        matches = store.globStatus(path)
        if not matches:
            raise FileNotFoundError(p)
        for status in matches:
            inside = store.listStatus(status.getPath()) if status.isDirectory() else [status]
            found += [(s.getPath().getName(), s.getPath().toUri().toString()) for s in inside if s.isFile()]
    found.sort(key=lambda f: f[0])
    return [(i, n, u) for i, (n, u) in enumerate(found)]


def _uri(path: Column) -> Column:
    return F.regexp_replace(path, r"^([a-z0-9]+):/+", "$1:/")


def scan(spark: SparkSession, files: list[tuple[int, str, str]], separator: str) -> DataFrame:
    """(file_ord, file_name, split, place, value): the pieces of every file between separators."""
    if not files:
        return spark.createDataFrame([], "file_ord int, file_name string, split bigint, place bigint, value string")
    text = spark.read.option("lineSep", separator).text([f[2] for f in files])
    value = F.when(F.contains("value", F.lit("\r")), F.regexp_replace("value", r"\r(?=\n|\z)", "")).otherwise(F.col("value"))
    rows = text.select(_uri(F.col("_metadata.file_path")).alias("uri"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), value.alias("value"))
    table = spark.createDataFrame(files, "file_ord int, file_name string, file_path string")
    return rows.join(F.broadcast(table.withColumn("uri", _uri(F.col("file_path")))), "uri").select("file_ord", "file_name", "split", "place", "value")


def in_memory(spark: SparkSession, texts: Iterable[tuple[str, str]], separator: str) -> DataFrame:
    """As ``scan``, from (file name, whole text), ordered by name."""
    rows = [(i, n, t.replace("\r\n", "\n").removesuffix("\n")) for i, (n, t) in enumerate(sorted(texts, key=lambda x: x[0])) if t]
    df = spark.createDataFrame(rows, "file_ord int, file_name string, text string")
    parts = F.posexplode(F.split("text", F.lit(separator.replace("|", r"\|"))))
    return df.select("file_ord", "file_name", F.lit(0).cast("bigint").alias("split"), parts.alias("place", "value")).withColumn("place", F.col("place").cast("bigint"))


_FIRST_FULL = re.compile(rf"^{LEAD}[^\n]* count: 0*[1-9][^\n]*\n(\| )?", re.M)


def told(text: str, ended: bool) -> tuple[str, bool] | None:
    """(header lines, whether the dump is deep) if the beginning of a dump tells: by what follows the first batch line that counts records."""
    text = text.replace("\r\n", "\n")
    m = _FIRST_FULL.search(text)
    if not ended and (m is None or len(text) < m.end() + 2):
        return None
    at = 0 if text.startswith(LEAD) else text.find("\n" + LEAD)
    return (text if at < 0 else text[:at]).removesuffix("\n"), bool(m and m[1])


def _first_line(text: str, ended: bool) -> tuple[str, bool] | None:
    return (text.replace("\r\n", "\n").split("\n", 1)[0], False) if ended or "\n" in text else None


def peek(spark: SparkSession, files: list[tuple[int, str, str]], tells: Callable = told) -> DataFrame:
    """``FACTS`` of every file, from its first few KB; files without a line have no lead."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def facts(file: tuple[int, str, str]) -> tuple:
        path = jvm.org.apache.hadoop.fs.Path(file[2])
        stream = path.getFileSystem(conf).open(path)
        raw, size = b"", PEEK_BYTES
        try:
            while True:
                part = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
                raw, ended, size = raw + part, len(part) < size, len(raw) + len(part)
                found = tells(raw.decode("utf-8", "replace"), ended or len(raw) >= MOST_BYTES or not raw.startswith(b"Dumping "))
                if found:
                    return (*file[:2], found[0] if raw else None, found[1])
        finally:
            stream.close()

    with ThreadPoolExecutor(PEEK_THREADS) as pool:
        return spark.createDataFrame(list(pool.map(facts, files)), f"file_ord int, file_name string, {FACTS}")


def facts_of(spark: SparkSession, texts: Iterable[tuple[str, str]], tells: Callable = told) -> DataFrame:
    """As ``peek``, of texts in memory."""
    rows = [(i, n, tells(t, True)[0] if t else None, tells(t, True)[1]) for i, (n, t) in enumerate(sorted(texts, key=lambda x: x[0]))]
    return spark.createDataFrame(rows, f"file_ord int, file_name string, {FACTS}")


def found_facts(rows: DataFrame) -> DataFrame:
    """As ``peek``, of rows whose files cannot be opened: one aggregation, with one piece held for each file."""
    at = F.struct("split", "place")
    counted = F.when(F.col("value").rlike(r"\A[^\n]* count: 0*[1-9]"), at)
    return rows.groupBy("file_ord", "file_name").agg(F.min_by("value", at).alias("lead"), F.coalesce(F.min_by(F.contains("value", F.lit("\n| ")), counted), F.lit(False)).alias("deep_iteration"))


class Lines:
    """Line numbers of ``rows(file_ord, split, place, value)``, from one shuffle of integers."""

    def __init__(self, rows: DataFrame) -> None:
        n = F.length("value") - F.length(F.replace("value", F.lit("\n"), F.lit(""))) + 1
        # dealt once; the windows and sums below need no other exchange of it
        self.counts = rows.select(*PLACE, n.cast("bigint").alias("n"), F.endswith("value", F.lit("\n")).alias("blank")).repartition("file_ord", "split")

    def splits(self) -> DataFrame:
        """A row for each split: lines before it in its file (base), its lines, its first and last place, and whether its last row ends in a line end."""
        t = self.counts.groupBy("file_ord", "split").agg(F.sum("n").alias("n"), F.min("place").alias("lo"), F.max("place").alias("hi"), F.max_by("blank", "place").alias("blank"))
        before = W.partitionBy("file_ord").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
        return t.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))

    def edges(self) -> DataFrame:
        """A row for each file: its first and last row, and its number of lines."""
        last = F.max_by("blank", "split").cast("int")
        ends = F.min(F.struct("split", F.col("lo").alias("place"))).alias("head"), F.max(F.struct("split", F.col("hi").alias("place"))).alias("tail")
        # always true, but with the same columns as in ``numbers`` the two share one scan and exchange
        return self.splits().groupBy("file_ord").agg(*ends, F.sum("n").alias("n_all"), (F.sum("n") - last).alias("n_lines")).where("n_all > 0").drop("n_all")

    def numbers(self) -> DataFrame:
        """(file_ord, split, place, line): the number of the first line of every row."""
        before = F.coalesce(F.sum("n").over(W.partitionBy("file_ord", "split").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        inside = self.counts.select(*PLACE, before.alias("before"))
        return inside.join(self.splits().select("file_ord", "split", "base"), ["file_ord", "split"]).select(*PLACE, (F.col("base") + F.col("before") + 1).cast("int").alias("line"))

    def add(self, df: DataFrame) -> DataFrame:
        """``df``, which has the columns of ``PLACE``, with its line numbers."""
        return df.join(self.numbers(), PLACE)


def segment_type(path: Column) -> Column:
    parent = parent_name(path)
    return F.when(parent.rlike(rf"\A{STATE_TOPIC}-[0-9]+\z"), TRANSACTION_STATE).when(parent.rlike(rf"\A{OFFSETS_TOPIC}-[0-9]+\z"), CONSUMER_OFFSETS).otherwise(DATA)


def topic_columns(path: Column) -> list[Column]:
    """topic and partition of a log directory, and the suffix from its last hyphen that the one-topic guard compares."""
    parent = parent_name(path)
    form = r"\A([a-zA-Z0-9_.-]+)-([0-9]+)\z"
    part = lambda k: F.when(parent.rlike(form), F.regexp_extract(parent, form, k))
    return [part(1).alias("topic"), part(2).try_cast("int").alias("partition"), F.concat(F.lit("-"), part(2)).alias("topic_suffix")]


@dataclass
class Segments:
    """Dump files: ``files``, a row for each; ``pieces``, all records with what they parse to; ``lines``, their numbers on demand.

    ``placed`` are the assembled batches by their place in the log; their messages'
    lines are counted from the batch line.  ``batches`` and ``raw`` are batches and
    pieces with line numbers.
    """

    files: DataFrame
    pieces: DataFrame
    lines: Lines

    @property
    def placed(self) -> DataFrame:
        return self.pieces.where("whole").select(*PLACE, "file_name", *[n for _, n, _, _ in G.BATCH], "messages", "segment_type", "deep_iteration")

    @property
    def batches(self) -> DataFrame:
        return self.numbered(self.placed)

    @property
    def raw(self) -> DataFrame:
        """Records after the header, with line numbers, and whether each is the last of its file."""
        edges = F.broadcast(self.lines.edges().select("file_ord", "head", "tail"))
        at = F.struct("split", "place")
        r = self.numbered(self.pieces).join(edges, "file_ord").where(at != F.col("head"))
        return r.withColumn("last", at == F.col("tail")).drop("head", "tail")

    def numbered(self, batches: DataFrame) -> DataFrame:
        """Any of these batches with line numbers."""
        return self.lines.add(batches).withColumn("messages", F.transform("messages", lambda m: m.withField("line", F.col("line") + m["line"])))


def _parsed(line: Column, control: Column, state: Column) -> Column:
    """Groups of one body line under the grammar that applies to it."""
    return F.when(control, G.fields(line, G.CONTROL_PATTERN)).when(state, G.fields(line, G.STATE_PATTERN)).otherwise(G.fields(line, G.DATA_PATTERN))


def _message(p: Column, change: Column, number: Column, control: Column, state: Column) -> Column:
    """One message; kind is null if the line does not fit the grammar, BAD_PAYLOAD if only its state payload does not."""
    at = lambda k: F.get(p, F.lit(k))
    size = F.size(p)
    fits = F.when(control | state, size == 9).otherwise(size == 7)
    gone = at(8) == G.DELETED
    changed = state & ~gone & G.matched(change, G.STATE_PAYLOAD)
    kind = F.when(~fits, F.lit(None)).when(control, "CONTROL").when(~state, "DATA").when(gone, "STATE_DELETE").when(changed, "STATE_CHANGE").otherwise("BAD_PAYLOAD")
    epoch = at(8).try_cast("int")
    numbers = {k: F.get(change, F.lit(k)).try_cast(t) for k, t in ((1, "bigint"), (2, "smallint"), (5, "bigint"), (6, "bigint"))}
    of = lambda k: F.when(changed, numbers.get(k, F.get(change, F.lit(k))))
    bad = [G.bad_number(p, G.RECORD), F.when(control & epoch.isNull(), at(8)), *[F.when(changed & n.isNull(), F.get(change, F.lit(k))) for k, n in numbers.items()]]
    values = [kind, number.cast("int"), *G.typed(p, G.RECORD), at(6), F.when(control, at(7) == "COMMIT"), F.when(control, epoch), F.when(state, at(7)), *[of(k) for k in range(1, 7)], F.when(fits, F.coalesce(*bad))]
    return F.struct(*[v.alias(f"c{i}") for i, v in enumerate(values)]).cast(MESSAGE)


def assemble(rows: DataFrame, facts: DataFrame | None = None) -> Segments:
    """Segments of dump pieces (``scan`` or ``in_memory``), with the ``FACTS`` of their files if these are known.

    A number that its type cannot hold is null, and named in bad_number; its batch stays.
    """
    f = facts if facts is not None else found_facts(rows)
    line = lambda k: F.get(F.split("lead", "\n"), F.lit(k))
    form = r"(?i)\A.*starting offset: ([0-9]+)\z"
    path = F.when(line(0).rlike(r"\ADumping (.*)\z"), F.regexp_extract(line(0), r"\ADumping (.*)\z", 1))
    f = f.select("*", path.alias("path"), F.when(line(1).rlike(form), F.regexp_extract(line(1), form, 1).try_cast("bigint")).alias("starting_offset"))
    f = f.select(
        "file_ord", "file_name", "path", segment_type(F.col("path")).alias("segment_type"), *topic_columns(F.col("path")), "starting_offset",
        F.regexp_extract(base_name(F.col("path")), r"\A([0-9]+)\.log\z", 1).try_cast("bigint").alias("name_offset"), "deep_iteration", F.when(F.col("lead").isNull(), 0).otherwise(F.size(F.split("lead", "\n"))).alias("header_lines"),
    )
    # a row for each file, as the table of files that every scan broadcasts
    b = rows.join(F.broadcast(f.select("file_ord", "segment_type", "deep_iteration")), "file_ord")
    blank = F.endswith("value", F.lit("\n"))
    text = F.when(blank, F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    b = b.select(*PLACE, "file_name", "segment_type", "deep_iteration", blank.alias("blank"), F.split(text, "\n").alias("lines"))
    header = F.concat(F.lit(LEAD), F.get("lines", F.lit(0)))
    b = b.select(*PLACE, "file_name", "segment_type", "deep_iteration", "blank", G.fields(header, G.BATCH_PATTERN).alias("_h"), F.slice("lines", F.lit(2), F.size("lines")).alias("_body"))
    b = b.withColumns(dict(zip([n for _, n, _, _ in G.BATCH], G.typed(F.col("_h"), G.BATCH), strict=True)))
    b = b.withColumn("fits", G.matched(F.col("_h"), G.BATCH_PATTERN)).withColumn("bad_number", F.when(F.col("fits"), G.bad_number(F.col("_h"), G.BATCH))).drop("_h")
    due = F.coalesce("count", F.size("_body"))
    wanted = F.when(F.col("fits") & F.col("deep_iteration"), F.slice("_body", F.lit(1), due)).otherwise(F.array().cast("array<string>"))
    control, state = F.col("is_control"), ~F.col("is_control") & (F.col("segment_type") == TRANSACTION_STATE)
    # each line is matched once: its groups are an array before the fields are picked
    groups = F.transform(wanted, lambda x: _parsed(x, control, state))
    groups = F.transform(groups, lambda p: F.struct(p.alias("p"), F.when(state, G.fields(F.get(p, F.lit(8)), G.STATE_PAYLOAD)).alias("c")))
    b = b.withColumn("messages", F.transform(groups, lambda g, i: _message(g["p"], g["c"], i + 1, control, state))).withColumn("n_body", F.size("_body"))
    return Segments(f, b.withColumn("whole", F.col("fits") & (~F.col("deep_iteration") | (F.col("n_body") >= due))).drop("_body"), Lines(rows))


def read_segments(spark: SparkSession, paths: Iterable[str]) -> Segments:
    """Segments of dump files."""
    files = ordered_files(spark, paths)
    return assemble(scan(spark, files, "\n" + LEAD), peek(spark, files))


def parse_segments(spark: SparkSession, texts: Iterable[tuple[str, str]]) -> Segments:
    """Segments of (file name, text) in memory."""
    texts = list(texts)
    return assemble(in_memory(spark, texts, "\n" + LEAD), facts_of(spark, texts))
