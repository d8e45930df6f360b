"""Scalar functions: instants, string hash, coordinator partitions, statistics text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_instant(millis: Column) -> Column:
    """Epoch milliseconds as an ISO-8601 UTC instant; the fraction is left out where it is zero."""
    second = F.floor(millis / 1000).cast("bigint")
    # built from the day number and the second of the day, so the session's time zone has no say
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(second / 86400).cast("int")), "yyyy-MM-dd")
    rest = F.pmod(second, F.lit(86400))
    clock = F.format_string("T%02d:%02d:%02d", F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60)
    ms = F.pmod(millis, F.lit(1000))
    return F.concat(day, clock, F.when(ms == 0, "").otherwise(F.format_string(".%03d", ms)), F.lit("Z"))


def string_hash(text: Column) -> Column:
    """Sum of UTF-16 units times powers of 31, in 32-bit signed arithmetic."""
    code = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(0), (F.length(code) / 4).cast("int") - 1), lambda i: F.conv(F.substring(code, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint"))
    folded = F.aggregate(units, F.lit(0).cast("bigint"), lambda h, u: (h * 31 + u) % F.lit(4294967296))
    signed = F.when(folded >= 2147483648, folded - F.lit(4294967296)).otherwise(folded)
    return F.when(F.length(text) == 0, 0).otherwise(signed).cast("int")


def coordinating_partition(identifier: Column, num_partitions: int | Column = 50) -> Column:
    """Partition of the internal topic that coordinates a transactional or group id: the least integer counts as 0."""
    h = string_hash(identifier).cast("bigint")
    return (F.when(h == -2147483648, 0).otherwise(F.abs(h)) % num_partitions).cast("int")


def int_statistics(count: Column, total: Column, least: Column, average: Column, most: Column) -> Column:
    """Text of integer statistics; without values the extremes are those of an empty accumulator."""
    zero = F.coalesce(count, F.lit(0)) == 0
    return F.format_string(
        "IntSummaryStatistics{count=%d, sum=%d, min=%d, average=%s, max=%d}",
        F.coalesce(count, F.lit(0)),
        F.coalesce(total, F.lit(0)),
        F.when(zero, F.lit(2147483647)).otherwise(least),
        F.format_string("%.6f", F.coalesce(average, F.lit(0.0))),
        F.when(zero, F.lit(-2147483648)).otherwise(most),
    )


def parent_name(path: Column) -> Column:
    """Name of the directory that holds the file of a path; null if the path has no parent."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)
