"""Temporal URL lists: every capture is judged by the entries active when it was fetched.

Dated list changes become validity intervals.  Rules are suffixes of a host,
with or without a path prefix, so they are matched for each distinct host only;
the intervals that concern a host travel as one array.  Captures then meet their
host's array in one join, and the as-of test is an expression on the row.  Native
functions only; captures are never grouped, so a host with a third of all
captures costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import folder, save

#: Hosts with their rules are broadcast up to this many bytes; beyond, the join shuffles.
BROADCAST_BYTES = 20 << 20


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def path_of(url: Column) -> Column:
    """Path of a URL, '' if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals ``(domain, prefix, since, until)`` of list changes ``(domain, prefix, listed, day)``.

    A rule is a domain and a path prefix.  It is active from a change with
    ``listed`` true up to its next change, exclusive; until is null if there is
    none.  Of several changes on one day delisting wins.  Changes without domain,
    day or listed are void; a null prefix is ''.
    """
    e = entries.select(F.lower("domain").alias("domain"), F.coalesce("prefix", F.lit("")).alias("prefix"), "listed", "day").where("domain <> '' and day is not null and listed is not null")
    e = e.groupBy("domain", "prefix", "day").agg(F.min("listed").alias("listed"))
    # consecutive listings are one interval
    by_rule = W.partitionBy("domain", "prefix").orderBy("day")
    e = e.withColumn("was", F.coalesce(F.lag("listed").over(by_rule), F.lit(False))).where("was <> listed")
    return e.withColumn("until", F.lead("day").over(by_rule)).where("listed").select("domain", "prefix", F.col("day").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures(page_id, url, fetched)`` with the rule that listed each at its fetch date.

    Returns page_id, url, host, fetched, blocked, rule (domain and prefix of the
    most specific active rule: longest domain, then longest prefix), listed_since.

    A null url has host '' and is not blocked; neither is a capture without a date.
    Repeated captures are judged alike; of rules that tie none is left, as a rule is its domain and
    prefix; urls of any length are read as a whole; other columns are ignored; an empty list
    blocks nothing; empty captures give an empty result.
    """
    where = folder(captures.sparkSession)
    c = captures.select("page_id", "url", host_of(F.col("url")).alias("host"), "fetched")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))
    hosts = c.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n")).select("host", F.explode(suffixes).alias("domain"))
    active = F.struct((-F.length("domain")).alias("a"), (-F.length("prefix")).alias("b"), "domain", "prefix", "since", "until")
    rules = save(hosts.join(intervals(entries), "domain").groupBy("host").agg(F.sort_array(F.collect_list(active)).alias("rules")), where, "rules").withColumnRenamed("host", "rule_host")
    each = F.aggregate("rules", F.lit(0), lambda n, r: n + 64 + F.length(r["domain"]) + F.length(r["prefix"]))
    if (rules.agg(F.sum(F.length("rule_host") + each)).first()[0] or 0) <= BROADCAST_BYTES:
        rules = F.broadcast(rules)
    path = path_of(F.col("url"))
    now = lambda r: (r["since"] <= F.col("fetched")) & (r["until"].isNull() | (F.col("fetched") < r["until"])) & F.startswith(F.col("path"), r["prefix"])
    t = c.withColumn("path", path).join(rules, F.col("host") == F.col("rule_host"), "left")
    t = t.withColumn("hit", F.get(F.filter("rules", now), F.lit(0)))
    return t.select("page_id", "url", "host", "fetched", F.col("hit").isNotNull().alias("blocked"), F.concat("hit.domain", "hit.prefix").alias("rule"), F.col("hit.since").alias("listed_since"))


def example_captures(pages: DataFrame) -> DataFrame:
    """Captures of ``pages``, which have no fetch date: a day of 2024 by page_id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7, F.lit(366)).cast("int")).alias("fetched"))


def example_list(pages: DataFrame) -> DataFrame:
    """A list drawn from the hosts of ``pages`` by their MD5: about a third of the hosts, a fifth of their parent domains, and a path on a quarter, with later delistings and relistings."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    both = hosts.select(F.col("host").alias("domain"), F.lit("").alias("prefix"), F.lit(3).alias("every")).unionByName(
        hosts.where("host like '%.%.%'").select(F.regexp_replace("host", r"^[^.]+\.", "").alias("domain"), F.lit("").alias("prefix"), F.lit(5).alias("every")).distinct()
    )
    both = both.unionByName(hosts.select(F.col("host").alias("domain"), F.lit("/en/").alias("prefix"), F.lit(4).alias("every")))
    k = F.conv(F.substring(F.md5(F.concat("domain", "prefix")), 1, 6), 16, 10).cast("long")
    both = both.withColumn("k", k).where("k % every = 1")
    day = lambda plus: F.date_add(F.lit("2024-01-01").cast("date"), (F.col("k") % 200 + plus).cast("int"))
    change = lambda listed, plus: both.select("domain", "prefix", F.lit(listed).alias("listed"), day(plus).alias("day"))
    return change(True, F.lit(0)).unionByName(change(False, 30 + F.col("k") % 90)).unionByName(change(True, F.lit(150)))
