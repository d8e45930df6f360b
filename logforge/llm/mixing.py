"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the key ``-ln(u) / quality``, u fixed by its doc_id, so reruns
agree.  Within a source, whole epochs come first; what is left of the target is
filled in key order up to a word budget.  No source is sorted as a whole: keys
fall into bins of equal ratio, whatever the scale of the weights, bin sums are
prefix-summed, the bin where the budget ends is cut into buckets of about two
thousand documents, and only the bucket where the budget ends is sorted.  Equal
draws (repeated rows) are counted there, not listed, so that a budget may end among
them.  The outcome is one plan row for each source, which any scan of the documents can apply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import folder, save

#: Plan rows are broadcast up to this many sources (about 100 bytes each); beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 100_000
BUCKET_DOCUMENTS = 2000
#: Bins of the keys in each power of two.
GRID = 64
_WORD = r"[^\x20\x09-\x0D]+"


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({_WORD})"), F.lit(1))), F.lit(0)).cast("long")


def quality_of(text: Column) -> Column:
    """Quality weight, 0.5 to 1.5: a half plus the share of letters and white space in the text (null or empty: 0.5)."""
    other = F.length(F.regexp_replace(text, r"[\p{L}\x20\n]+", ""))
    return F.coalesce(F.lit(1.5) - other.cast("double") / F.nullif(F.length(text), F.lit(0)), F.lit(0.5))


def _keyed(docs: DataFrame, quality: str | None) -> DataFrame:
    """``docs`` with the columns of the draw in one struct ``_draw``, so that no other column clashes."""
    number = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double")
    u = (number + F.lit(0.5)) / F.lit(4503599627370496.0)
    given = F.col(quality).cast("double") if quality else quality_of(F.col("text"))
    weight = F.least(F.greatest(F.nanvl(given, F.lit(0.0)), F.lit(1e-6)), F.lit(1e9))
    draw = F.struct(
        size_of(F.col("text")).alias("size"),
        (-F.log(u) / weight).alias("key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"),
        F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("tie"),
    )
    return docs.withColumn("_draw", draw)


def targets(totals: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``totals(source, source_size, documents)`` with ``target``: one row for each source.

    Sources by code point, null last, take the weights in turn.  They share
    ``share`` times all words; a target above ``cap`` times its source stops
    there, and the excess goes to the others by weight until none is above.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    all_ = W.partitionBy()
    t = totals.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    t = t.withColumn("ratio", F.col("most") / F.col("w"))
    upto = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumns({"c": F.sum("most").over(upto), "v": F.sum("w").over(upto), "total": F.sum("source_size").over(all_) * F.lit(float(share)), "all_w": F.sum("w").over(all_)})
    t = t.withColumn("full", F.col("c") + F.col("ratio") * (F.col("all_w") - F.col("v")) <= F.col("total"))
    t = t.withColumns({"used": F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(all_), F.lit(0.0)), "gone": F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(all_), F.lit(0.0))})
    level = (F.col("total") - F.col("used")) / F.nullif(F.col("all_w") - F.col("gone"), F.lit(0.0))
    return t.select("source", "source_size", "documents", F.when(F.col("full"), F.col("most")).otherwise(level * F.col("w")).alias("target"))


def _bin(key: Column) -> Column:
    return F.floor(F.log2(key) * GRID).cast("int")


def _bucket(key: Column, bin_: Column, parts: Column) -> Column:
    """Place of a key among ``parts`` equal pieces of its bin."""
    low = F.pow(F.lit(2.0), bin_ / GRID)
    return F.greatest(F.least(F.floor((key - low) / (F.pow(F.lit(2.0), (bin_ + 1) / GRID) - low) * parts), parts - 1), F.lit(0))


def _end(sums: DataFrame, place: str) -> DataFrame:
    """The row of ``sums(from, place, rest, before, words)`` of each source in which its budget ends, ``before`` counting all words before it."""
    upto = W.partitionBy("from").orderBy(place).rowsBetween(W.unboundedPreceding, 0)
    s = sums.withColumn("upto", F.col("before") + F.sum("words").over(upto)).where("upto - words <= rest and rest < upto")
    return s.withColumn("before", F.col("upto") - F.col("words")).drop("upto", "words")


def plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, quality: str | None = None) -> tuple[DataFrame, DataFrame, int, str]:
    """(drawn documents, one plan row for each source, number of sources, folder of the tables)."""
    spark = docs.sparkSession
    where = folder(spark)
    drawn = save(_keyed(docs, quality).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "_draw.*"), where, "drawn")
    totals = drawn.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    goal = targets(totals, weights, share, cap)
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = save(goal.withColumnRenamed("source", "from").drop("documents"), where, "goal")
    number = goal.count()
    binned = drawn.select("source", "size", "key", "id", "tie", _bin(F.col("key")).alias("bin"))
    sums = binned.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    sums = sums.join(_small(goal, number), F.col("source").eqNullSafe(F.col("from"))).select("from", "bin", "rest", F.lit(0).cast("long").alias("before"), "words", F.ceil(F.col("n") / BUCKET_DOCUMENTS).alias("parts"))
    ends = save(_end(sums, "bin").withColumnRenamed("bin", "end_bin"), where, "bins")
    inside = binned.join(_small(ends, number), F.col("source").eqNullSafe(F.col("from")) & (F.col("bin") == F.col("end_bin"))).withColumn("bucket", _bucket(F.col("key"), F.col("bin"), F.col("parts")))
    sums = inside.groupBy("from", "end_bin", "parts", "rest", "before", "bucket").agg(F.sum("size").alias("words"))
    ends = save(_end(sums, "bucket").select(F.col("from").alias("end_from"), "end_bin", "parts", F.col("bucket").alias("end_bucket"), F.col("before").alias("end_before")), where, "ends")
    last = inside.drop("end_bin", "parts").join(_small(ends, number), F.col("from").eqNullSafe(F.col("end_from")) & (F.col("bucket") == F.col("end_bucket")))
    # equal draws are one row here, so that a group of them is no load for the task that sorts
    last = last.groupBy("from", "rest", "end_before", "key", "id", "tie", "size").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum(F.col("size") * F.col("n")).over(W.partitionBy("from").orderBy("key", "id", "tie").rowsBetween(W.unboundedPreceding, 0))
    left = F.col("rest") - (F.col("end_before") + upto - F.col("size") * F.col("n"))
    whole = F.when(F.col("size") > 0, F.floor(left / F.col("size") + 0.5)).otherwise(F.when(left >= 0, F.col("n")).otherwise(0))
    last = last.withColumn("picks", F.greatest(F.least(whole, F.col("n")), F.lit(0)).cast("long")).where("picks > 0")
    cuts = last.groupBy(F.col("from").alias("cut_from")).agg(F.max(F.struct("key", "id", "tie", "picks", "n")).alias("cut"))
    joined = goal.join(ends, F.col("from").eqNullSafe(F.col("end_from")), "left").join(cuts, F.col("from").eqNullSafe(F.col("cut_from")), "left")
    return drawn, save(joined.select("from", "source_size", "target", "epochs", "parts", "end_bin", "end_bucket", "cut"), where, "plan"), number, where


#: Whether a draw comes before the place where its source's budget ends; -1, 0 or 1 beside the draw that it ends at.
_BEFORE = "bin < end_bin or (bin = end_bin and bucket < end_bucket)"
_SIDE = "case when key < cut.key then -1 when key > cut.key then 1 when id < cut.id then -1 when id > cut.id then 1 when tie < cut.tie then -1 when tie > cut.tie then 1 else 0 end"


def _planned(rows: DataFrame, goal: DataFrame, number: int) -> DataFrame:
    """``rows(source, key, id, tie, ...)`` with their plan row; copies; and ties: of so many equal draws some get one copy more."""
    t = rows.join(_small(goal, number), F.col("source").eqNullSafe(F.col("from"))).withColumn("bin", _bin(F.col("key")))
    t = t.withColumn("bucket", F.when(F.col("bin") == F.col("end_bin"), _bucket(F.col("key"), F.col("bin"), F.col("parts"))))
    side = F.when(F.expr(_BEFORE), -1).when((F.col("bin") == F.col("end_bin")) & (F.col("bucket") == F.col("end_bucket")) & F.col("cut").isNotNull(), F.expr(_SIDE)).otherwise(1)
    t = t.withColumn("side", side)
    tied = (F.col("side") == 0) & (F.col("cut.picks") < F.col("cut.n"))
    return t.withColumn("tied", F.coalesce(tied, F.lit(False))).withColumn("copies", F.col("epochs") + (F.col("side") <= 0).cast("long"))


def _with_ties(planned: DataFrame, goal: DataFrame, where: str, row: Column) -> DataFrame:
    """``row`` and copies of each planned row.

    Where a budget ends among equal draws, the rows of each partition are counted
    by value, and the copies that are left go to the first of them.
    """
    out = planned.where(~F.col("tied")).select(row.alias("row"), "copies")
    if goal.where("cut.picks < cut.n").isEmpty():
        return out
    same = planned.where("tied").select(row.alias("row"), "from", "epochs", F.col("cut.picks").alias("picks"), F.spark_partition_id().alias("part"))
    same = same.groupBy("row", "from", "epochs", "picks", "part").agg(F.count(F.lit(1)).alias("n"))
    same = save(same.withColumn("k", F.monotonically_increasing_id()), where, "ties")
    before = F.coalesce(F.sum("n").over(W.partitionBy("from").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    more = same.select("k", "from", "n", "picks", before.alias("before")).select("k", F.greatest(F.least(F.col("picks") - F.col("before"), F.col("n")), F.lit(0)).cast("int").alias("more"))
    each = F.concat(F.array_repeat(F.col("epochs") + 1, F.col("more")), F.array_repeat("epochs", (F.col("n") - F.col("more")).cast("int")))
    return out.unionByName(same.join(more, "k").select("row", F.explode(each).alias("copies")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, quality: str | None = None) -> DataFrame:
    """How often each row of ``docs(doc_id, text, source)`` enters the mix.

    Returns doc_id, size (words), source_size, target (of its source), taken
    (words the mix takes, repeats counted), copies.  ``quality`` names a column of
    weights (1e-6 to 1e9; null and NaN count as the least); without it the share
    of letters in the text serves.

    Null and empty texts have size 0 and take no words.  A null source is one
    source, last in order.  Rows of equal key, doc_id and text (repeated rows) are
    taken one by one: as many as the budget has room for.  Very long texts are one row as any
    other, and the budget may be missed by half of the last one's size.  Other
    columns are ignored.  An empty table gives an empty result.
    """
    drawn, goal, number, where = plan(docs, weights, share, cap, quality)
    rows = _with_ties(_planned(drawn, goal, number), goal, where, F.struct("doc_id", "size", "source_size", "target"))
    return rows.select("row.*", (F.col("row.size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of the mix with all columns of ``docs``, each as often as the mix takes it; nothing is shuffled but plan rows and ties at the end of a budget.

    Nulls, empty and long texts, repeated rows, clashing columns and empty tables as in ``mix``.
    """
    _, goal, number, where = plan(docs, **settings)
    slim = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", F.col("source").cast("string").alias("source"), *({settings["quality"]} - {"doc_id", "text", "source"} if settings.get("quality") else ()))
    keyed = _keyed(slim, settings.get("quality")).select("_row", "source", "_draw.*")
    rows = _with_ties(_planned(keyed, goal, number), goal, where, F.col("_row"))
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
