"""Producer-snapshot dumps as DataFrames: a header line, then one producer state a line."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grammar as G
from .dumps import PLACE, Lines, _first_line, facts_of, found_facts, in_memory, ordered_files, peek, scan, topic_columns


@dataclass
class Snapshots:
    """Dump files: ``files``, a row for each; ``pieces``, all lines with what they parse to; ``lines``, their numbers on demand.

    ``placed`` are the states by their place in the file; ``states`` have line
    numbers too, as has ``raw``: all lines after the header.
    """

    files: DataFrame
    pieces: DataFrame
    lines: Lines

    @property
    def placed(self) -> DataFrame:
        return self.pieces.where("fits").select(*PLACE, "file_name", *[n for _, n, _, _ in G.SNAPSHOT])

    @property
    def states(self) -> DataFrame:
        return self.lines.add(self.placed)

    @property
    def raw(self) -> DataFrame:
        heads = F.broadcast(self.lines.edges().select("file_ord", "head"))
        return self.lines.add(self.pieces).join(heads, "file_ord").where(F.struct("split", "place") != F.col("head")).drop("head")


def assemble(rows: DataFrame, facts: DataFrame | None = None) -> Snapshots:
    """Snapshots of dump lines, with the facts of their files if these are known.  A number that its type cannot hold is null, and named in bad_number."""
    f = facts if facts is not None else found_facts(rows)
    form = r"\ADumping (.*)\z"
    f = f.select("file_ord", "file_name", F.when(F.col("lead").rlike(form), F.regexp_extract("lead", form, 1)).alias("path"), F.col("lead").isNull().alias("is_empty"))
    f = f.select("*", *topic_columns(F.col("path")))
    p = rows.select(*PLACE, "file_name", "value", G.fields(F.col("value"), G.SNAPSHOT_PATTERN).alias("_p"))
    p = p.withColumn("fits", G.matched(F.col("_p"), G.SNAPSHOT_PATTERN))
    values = dict(zip([n for _, n, _, _ in G.SNAPSHOT], G.typed(F.col("_p"), G.SNAPSHOT), strict=True))
    values["last_timestamp"] = F.when(F.get("_p", F.lit(5)) == "", F.lit(0).cast("bigint")).otherwise(values["last_timestamp"])
    bad = F.when(F.col("fits"), G.bad_number(F.col("_p"), G.SNAPSHOT))
    return Snapshots(f, p.select(*PLACE, "file_name", "value", "fits", *[v.alias(n) for n, v in values.items()], bad.alias("bad_number")), Lines(rows))


def read_snapshots(spark: SparkSession, paths: Iterable[str]) -> Snapshots:
    """Snapshots of dump files."""
    files = ordered_files(spark, paths)
    return assemble(scan(spark, files, "\n"), peek(spark, files, _first_line))


def parse_snapshots(spark: SparkSession, texts: Iterable[tuple[str, str]]) -> Snapshots:
    """Snapshots of (file name, text) in memory."""
    texts = list(texts)
    return assemble(in_memory(spark, texts, "\n"), facts_of(spark, texts, _first_line))
