"""N-gram Jaccard self-join by MinHash banding, with exact verification.

Plan
    1. One Arrow pass hashes the word shingles of each whole text, and gives a
       128-bit digest of the shingle set and one hash for each band.
    2. Texts with equal sets form one copy class, a node; only its representative goes on,
       named by its doc_id and a hash of its text, as rows may share or lack a doc_id.
    3. A shuffle on band hashes finds buckets of two classes or more.
    4. Candidates are dealt to blocks of bounded rows and bytes: the block key
       is the least node met in any bucket, and a large key is split
       by a hash.  Two blocks are compared only if some bucket spans them.
    5. Each block pair is one group: full shingle sets meet in a blocked matrix
       product that counts every intersection.  It returns link counts and
       spanning edges for each class, never the pairs, so a group of thousands of
       near copies costs rows in proportion to its blocks.
    6. Connected components over the spanning edges give the group of each class.

Band and row counts follow from the threshold and the target recall: for 0.8
and 0.9999 they are 18 bands of 4 rows.  Verification is exact, so precision is 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .components import components
from .storage import folder, save, ship

#: Above so many candidate classes their texts are found by a shuffle join, not a broadcast of (id, block); 24 bytes a row.
BROADCAST_ROWS = 400_000


def choose_bands(threshold: float, recall: float, most: int = 96) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands reach ``recall`` at ``threshold`` within ``most`` permutations."""
    best = (max(1, math.ceil(math.log1p(-recall) / math.log1p(-min(threshold, 1 - 1e-9)))), 1)
    for rows in range(2, 17):
        hit = threshold**rows
        bands = max(1, math.ceil(math.log1p(-recall) / math.log1p(-min(hit, 1 - 1e-9))))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _signer(n: int, bands: int, rows: int, seed: int):
    rng = np.random.default_rng(seed)
    mul = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    salt = rng.integers(0, 1 << 63, 2, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                hashes, counts = textbuf.word_hashes(batch.column("text"))
                grams, number = textbuf.unique_by_row(*textbuf.shingle_hashes(hashes, counts, n))
                live = np.flatnonzero(number)
                size = batch.num_rows
                none = np.ones(size, bool)
                none[live] = False
                digest = np.zeros((2, size), np.uint64)
                keys = np.zeros((size, bands), np.uint64)
                if len(live):
                    at = (np.cumsum(number) - number)[live]
                    for k in range(2):
                        digest[k, live] = np.add.reduceat(textbuf.mix(grams ^ salt[k]), at)
                    work = np.empty_like(grams)
                    for b in range(bands):
                        key = np.full(len(live), b + 1, np.uint64)
                        for r in range(b * rows, b * rows + rows):
                            np.multiply(grams, mul[r], out=work)
                            np.add(work, add[r], out=work)
                            key = textbuf.mix(key ^ np.minimum.reduceat(work, at))
                        keys[live, b] = key
                width = pa.array(np.arange(0, (size + 1) * bands, bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("h"),
                        pa.array(digest[0].view(np.int64), mask=none),
                        pa.array(digest[1].view(np.int64), mask=none),
                        pa.array((np.diff(textbuf.buffer(batch.column("text"))[1])).astype(np.int64)),
                        pa.ListArray.from_arrays(width, pa.array(keys.view(np.int64).reshape(-1))),
                    ],
                    ["doc_id", "h", "d1", "d2", "n_bytes", "bands"],
                )

    return sign


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets: products of 0/1 matrices over slices of the shared values."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    ra, rb = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right))
    shared = np.intersect1d(a, b)
    pa_, pb = np.searchsorted(shared, a), np.searchsorted(shared, b)
    ka = np.flatnonzero((pa_ < len(shared)) & (shared[np.minimum(pa_, max(len(shared) - 1, 0))] == a)) if len(shared) else np.zeros(0, int)
    kb = np.flatnonzero((pb < len(shared)) & (shared[np.minimum(pb, max(len(shared) - 1, 0))] == b)) if len(shared) else np.zeros(0, int)
    step = 8192
    for lo in range(0, len(shared), step):
        size = min(step, len(shared) - lo)
        x, y = np.zeros((len(left), size), np.float32), np.zeros((len(right), size), np.float32)
        i, j = ka[(pa_[ka] >= lo) & (pa_[ka] < lo + size)], kb[(pb[kb] >= lo) & (pb[kb] < lo + size)]
        x[ra[i], pa_[i] - lo] = 1
        y[rb[j], pb[j] - lo] = 1
        out += x @ y.T
    return out


def _verifier(n: int, threshold: float):
    schema = pa.schema([("node", pa.int64()), ("low", pa.int64()), ("texts", pa.int64()), ("documents", pa.int64())])
    over, under = (threshold * 1000).__round__(), 1000

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by([("node", "ascending"), ("text", "ascending")])
        rep = table.column("node").to_numpy()
        keep = np.ones(len(rep), bool)
        keep[1:] = rep[1:] != rep[:-1]
        table, rep = table.filter(pa.array(keep)), rep[keep]
        side = table.column("side").to_numpy()
        copies = table.column("copies").to_numpy()
        sets: list[np.ndarray] = []
        for batch in table.combine_chunks().to_batches():
            for part in textbuf.slices(batch, "text"):
                grams, number = textbuf.unique_by_row(*textbuf.shingle_hashes(*textbuf.word_hashes(part.column("text")), n))
                sets += np.split(grams, np.cumsum(number)[:-1])
        size = np.array([len(s) for s in sets], np.int64)
        cross = side.min() != side.max()
        at = [np.flatnonzero(side == k) for k in (0, 1)] if cross else [np.arange(len(rep))] * 2
        both = _intersections([sets[i] for i in at[0]], [sets[i] for i in at[1]]).astype(np.int64)
        link = both * under >= over * (size[at[0]][:, None] + size[at[1]][None, :] - both)
        if not cross:
            np.fill_diagonal(link, False)
        texts, documents = np.zeros(len(rep), np.int64), np.zeros(len(rep), np.int64)
        texts[at[0]] = link.sum(1)
        documents[at[0]] = link @ copies[at[1]]
        if cross:
            texts[at[1]] = link.sum(0)
            documents[at[1]] = copies[at[0]] @ link
        root = np.arange(len(rep))
        x, y = (at[0][np.nonzero(link)[0]], at[1][np.nonzero(link)[1]])
        while len(x):  # hook the higher root on the lower, then halve paths
            low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
            if (low == high).all():
                break
            np.minimum.at(root, high, low)
            while (root != root[root]).any():
                root = root[root]
        live = np.flatnonzero(texts)
        return pa.table([rep[live], rep[root[live]], texts[live], documents[live]], schema=schema)

    return verify


def _joined(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999, block_rows: int = 256, block_bytes: int = 4 << 20, seed: int = 17) -> DataFrame:
    """doc_id and h (hash of the text) of every row, with group (a number), class_id, copy_id, texts, documents, and the row of its group that stands for it."""
    spark = docs.sparkSession
    ship(spark)
    where = folder(spark)
    bands, rows = choose_bands(threshold, recall)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = source.withColumn("h", F.xxhash64("text"))
    signed = save(source.mapInArrow(_signer(n, bands, rows, seed), "doc_id long, h long, d1 long, d2 long, n_bytes long, bands array<long>"), where, "signed")

    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "bands", "n_bytes")).alias("one")
    sets = signed.where("d1 is not null").groupBy("d1", "d2").agg(first, F.count(F.lit(1)).alias("copies"))
    # written with its node numbers, which never change after that
    sets = save(sets.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "copies", F.col("one.doc_id").alias("rep"), F.col("one.h").alias("h"), F.col("one.bands").alias("bands"), F.col("one.n_bytes").alias("n_bytes")), where, "sets")

    banded = sets.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("band", "lo")
    members = save(banded.join(buckets, "band"), where, "members")

    lead = members.groupBy("node").agg(F.min("lo").alias("lead"))
    lead = sets.select("node", "rep", "h", "copies", "n_bytes").join(lead, "node")
    parts = lead.groupBy("lead").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_rows), F.ceil(F.sum("n_bytes") / block_bytes)).alias("parts"))
    dealt = lead.join(parts, "lead").select("node", "rep", "h", "copies", F.xxhash64("lead", F.pmod(F.xxhash64("node"), "parts")).alias("block"))
    dealt = save(dealt, where, "dealt")

    spans = members.join(dealt, "node").select("band", "block").distinct()
    wide = spans.groupBy("band").agg(F.min("block").alias("x"), F.max("block").alias("y")).where("x <> y").select("band")
    spans = spans.join(wide, "band")
    cross = spans.select("band", F.col("block").alias("a")).join(spans.select("band", F.col("block").alias("b")), "band").where("a < b").select("a", "b").distinct()
    inner = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("block").alias("a"), F.col("block").alias("b"))
    units = cross.unionByName(inner).withColumn("unit", F.xxhash64("a", "b"))
    sides = save(units.select("unit", F.col("a").alias("block"), F.lit(0).alias("side")).unionByName(units.where("a <> b").select("unit", F.col("b").alias("block"), F.lit(1).alias("side"))), where, "units")

    few = dealt.count() <= BROADCAST_ROWS
    chosen = lambda rows: F.broadcast(rows) if few else rows
    named = dealt.where("rep is not null").select(F.col("rep").alias("doc_id"), "h", "node", "copies", "block")
    texts = source.where("doc_id is not null").join(chosen(named), ["doc_id", "h"]).select("node", "copies", "block", "text")
    # of rows without doc_id, which may be many of one text, one of each text goes on
    bare = source.where("doc_id is null").groupBy("h").agg(F.min("text").alias("text"))
    texts = texts.unionByName(bare.join(chosen(dealt.where("rep is null").select("h", "node", "copies", "block")), "h").select("node", "copies", "block", "text"))
    verified = texts.join(sides, "block").select("unit", "side", "node", "copies", "text")
    links = save(verified.groupBy("unit").applyInArrow(_verifier(n, threshold), "node long, low long, texts long, documents long"), where, "links")

    groups = components(links.select(F.col("node").alias("a"), F.col("low").alias("b")), where)
    counts = links.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    known = sets.select("d1", "d2", "node", "rep", "h", "copies").join(counts, "node", "left").join(groups, "node", "left")
    known = known.withColumn("group", F.coalesce("component", "node"))
    stands = known.groupBy("group").agg(F.min(F.struct(F.col("rep").isNull().alias("no_id"), F.col("rep"), F.col("h"))).alias("kept"))
    known = known.join(stands, "group").select(
        "d1", "d2", "group", F.col("kept.rep").alias("class_id"), F.col("rep").alias("copy_id"), F.struct(F.col("kept.rep").alias("doc_id"), F.col("kept.h").alias("h")).alias("kept"),
        F.coalesce("texts", F.lit(0)).alias("texts"), (F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).alias("documents"),
    )
    return signed.select("doc_id", "h", "d1", "d2").join(known, ["d1", "d2"], "left").drop("d1", "d2")


def jaccard_join(docs: DataFrame, **settings) -> DataFrame:
    """Near-duplicate self-join of ``docs(doc_id, text)`` on shingles of ``n`` words.

    Settings: ``threshold`` (0.8), ``n`` (5), ``recall`` of the bands at the
    threshold (0.9999), ``block_rows`` and ``block_bytes`` of a verified block, ``seed``.

    Returns one row for each input row: ``doc_id``; ``class_id``, the least
    doc_id of its group of texts connected by links of ``threshold`` or more;
    ``copy_id``, the least doc_id with the same shingle set; ``n_links``, other
    rows it links to, copies counted; ``n_text_links``, other shingle sets.

    Words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer than ``n`` words has one
    shingle.  A similarity of exactly ``threshold`` is a link.  Null and empty texts have
    no shingles: they are alone in their class.  Every row counts by its own text, whether
    or not others share its doc_id; rows without doc_id link as others do, and where
    a whole group has none its class_id is null.  Texts of any length are compared as a
    whole; one above ``block_bytes`` makes a block of its own.  Other columns are
    ignored.  An empty table gives an empty result.
    """
    return _joined(docs, **settings).select(
        "doc_id",
        F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("documents", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("texts", F.lit(0).cast("long")).alias("n_text_links"),
    )


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` without near copies: of each group one row stays, with all its columns: that of the least doc_id, then of the least hash of its text.

    Null and empty texts all stay.  Rows without doc_id stay only where no row of
    their group has one.  Of repeated rows one stays.  Ties, long texts, clashing
    columns and empty tables as in ``jaccard_join``.
    """
    spark = docs.sparkSession
    found = save(_joined(docs, **settings).where("group is not null").select("doc_id", "h", "group", "kept"), folder(spark), "joined")
    row = F.struct("doc_id", "h")
    gone = found.where(~row.eqNullSafe(F.col("kept"))).select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).distinct()
    twice = found.where(row.eqNullSafe(F.col("kept"))).groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("doc_id").alias("twice_id"), F.col("h").alias("twice_h"))
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    id_, h = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    kept = docs.join(gone, id_.eqNullSafe(F.col("gone_id")) & (h == F.col("gone_h")), "left_anti")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    again = id_.eqNullSafe(F.col("twice_id")) & (h == F.col("twice_h"))
    # one of each: rows that repeat as a whole are counted, of others (in columns beside doc_id and text) the least hash counts
    repeated = kept.join(twice, again, "left_semi").select(F.struct(*docs.columns).alias("_row"), id_.alias("_id"), h.alias("_h"))
    repeated = repeated.groupBy("_id", "_h").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return kept.join(twice, again, "left_anti").select(*docs.columns).unionByName(repeated.select("_row.*"))
