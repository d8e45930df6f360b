"""Toxicity by non-negative positive-unlabelled learning of a sparse linear model.

Training texts are confirmed toxic documents, a bounded sample of the labelled
rows in hash order with one of each family of copies, and all unlabelled
documents of the training fold; the class prior is the toxic share of all labels
of that fold.  Features are the words present in a text, hashed to 64 bits, that
positive texts hold significantly more often than unlabelled ones do; words are counted on the
executors over all texts.  The risk is pi * R_p+ + max(0, R_u- - pi * R_p-),
minimised by Adam; where the inner term falls below zero its gradient is turned
round, so the model cannot fit the unlabelled texts below what the prior allows.

Unlabelled texts are dealt to shards of a fixed size by a hash of doc_id.  Each
shard, a task of its own, fits all positive texts against its unlabelled ones, and the
weights of the shards are averaged, so the fit covers all texts within bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .storage import folder, save, ship

#: Letters in lower case, digits and bytes of non-ASCII characters make words; all else parts them.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def word_set(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes of each text, ascending, and their number."""
    raw, at = textbuf.buffer(column)
    raw = _FOLD[raw]
    start, end, counts = textbuf.words(raw, at)
    return textbuf.unique_by_row(textbuf.span_hashes(raw, start, end), counts)


def _families(words: np.ndarray, counts: np.ndarray, bands: int = 8, rows: int = 5) -> np.ndarray:
    """MinHash band keys of word sets: near copies share one at least, other texts hardly ever do."""
    key = np.zeros((len(counts), bands), np.uint64)
    live = np.flatnonzero(counts)
    if len(live):
        at = (np.cumsum(counts) - counts)[live]
        for r in range(bands * rows):
            least = np.minimum.reduceat(words * np.uint64(2 * (r * 7919 + 13) + 1) ^ np.uint64(r * 0x9E3779B97F4A7C15 % (1 << 64)), at)
            key[live, r // rows] = textbuf.mix(key[live, r // rows] ^ least)
    return key


@dataclass
class Model:
    """``words`` ascending with their ``weights``, and a bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability of the toxic class for each text, whole texts only."""
        raw, at = textbuf.buffer(column)
        raw = _FOLD[raw]
        start, end, counts = textbuf.words(raw, at)
        total = np.full(len(counts), self.bias)
        if len(self.words) and len(start):
            found = textbuf.span_hashes(raw, start, end)
            place = np.minimum(np.searchsorted(self.words, found), len(self.words) - 1)
            hit = np.flatnonzero(self.words[place] == found)
            row = np.repeat(np.arange(len(counts)), counts)[hit]
            pair = np.unique(row * np.int64(len(self.words)) + place[hit])  # a word counts once
            total += np.bincount(pair // len(self.words), self.weights[pair % len(self.words)], len(counts))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def select(positive: list[np.ndarray], other: np.ndarray, n_unlabelled: int, lift: float) -> np.ndarray:
    """Which words the positive texts hold ``lift`` times as often as the unlabelled texts, and more often than chance explains.

    ``other`` counts the unlabelled texts with each word.  The Chernoff bound of the
    Poisson tail must be below 1/3 over all words together.
    """
    c = np.bincount(np.concatenate(positive), minlength=len(other))
    scale = len(positive) / max(n_unlabelled, 1)
    expected = (other + np.sqrt(other) + 1) * scale
    tail = c * np.log(np.maximum(c, 1) / expected) - c + expected
    return (c > expected) & (tail > np.log(3 * max(len(other), 1))) & (c > lift * (other + 0.5) * scale)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], width: int, prior: float, number: np.ndarray | None = None, rounds: int = 300, rate: float = 0.1, l2: float = 1e-6) -> tuple[np.ndarray, float]:
    """(weights, bias) of a linear model by non-negative PU learning on texts given as sets of feature numbers; ``number`` counts the texts of each unlabelled set."""
    number = np.ones(len(unlabelled)) if number is None else number
    groups: dict[bytes, list[float]] = {}
    for k, (sets, counts) in enumerate(((positive, np.ones(len(positive))), (unlabelled, number))):
        for s, n in zip(sets, counts.tolist(), strict=True):
            groups.setdefault(np.asarray(s, np.int64).tobytes(), [0.0, 0.0])[k] += n
    keys = sorted(groups)
    sets = [np.frombuffer(g, np.int64) for g in keys]
    p, u = (np.array([groups[g] for g in keys]).reshape(-1, 2) / [max(len(positive), 1), max(number.sum(), 1)]).T
    column = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    n = len(sets)
    theta = np.zeros(width + 1)  # the last is the bias
    theta[-1] = np.log(0.5 * prior / (1 - 0.5 * prior))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        s = 1 / (1 + np.exp(-np.clip(np.bincount(row, theta[column], n) + theta[-1], -30, 30)))
        minus = -np.log1p(-np.minimum(s, 1 - 1e-12))
        if (u - prior * p) @ minus >= 0:
            grad = u * s - prior * p  # of pi * R_p+ + R_u- - pi * R_p-
        else:
            grad = prior * p * s - u * s
        g = np.append(np.bincount(column, grad[row], width), grad.sum())
        g[:-1] += l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
    return theta[:-1], float(theta[-1])


def _packed(words: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The items of each row as one binary value."""
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32) * np.int32(words.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(words))])


def _among(known: np.ndarray, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's words those in ``known`` (ascending), as numbers."""
    place = np.minimum(np.searchsorted(known, words), len(known) - 1)
    hit = known[place] == words
    return place[hit].astype(np.int32), np.bincount(np.repeat(np.arange(len(counts)), counts)[hit], minlength=len(counts))


def _one_of_each(families: pa.Table) -> list[int]:
    """Rows (by their key) that share no family key with one before, in the order of their keys."""
    seen: set[int] = set()
    out = []
    for family, key in sorted(zip(families.column("family").to_pylist(), families.column("key").to_pylist(), strict=True)):
        keys = [hash((i, k)) for i, k in enumerate(np.frombuffer(family, np.int64).tolist())]
        if seen.isdisjoint(keys):
            out.append(key)
        seen.update(keys)
    return sorted(set(out))


def train(docs: DataFrame, labels: DataFrame, fold: int = 5, most_positive: int = 8000, shard_texts: int = 40000, least_texts: int = 4, least_share: float = 0.005) -> Model:
    """Model of ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    Only rows with crc32(doc_id as text) mod ``fold`` other than 0 take part.
    ``most_positive`` bounds the sample of labelled toxic rows, taken in hash order; unlabelled
    rows all take part, about ``shard_texts`` in a shard.  Words that at least ``least_texts``
    positive texts hold, and ``least_share`` of them, are candidates: about as many whatever the size of the sample.  Without toxic labels the model scores every text near 0.
    """
    spark = docs.sparkSession
    ship(spark)
    where = folder(spark)
    fit_fold = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % fold != 0)
    known = labels.where(fit_fold & F.col("toxic").isNotNull())
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    key = F.col("doc_id").cast("long").alias("doc_id")
    source = docs.where(fit_fold).select(key, F.col("text").cast("string").alias("text"))
    ids = known.where("toxic = 1").select(key).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_positive)

    def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                words, counts = word_set(batch.column("text"))
                family = _families(words, counts)
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(family.shape[1] * 8), len(counts), [None, pa.py_buffer(family)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([keys, _packed(words, counts)], ["family", "words"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("words").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(packed, np.int64))], ["word"])

    positives = source.join(F.broadcast(ids), "doc_id").select("text").mapInArrow(families, "family binary, words binary").withColumn("key", F.xxhash64("words"))
    positives = save(positives, where, "positives")
    kept = _one_of_each(positives.select("family", "key").toArrow())  # 72 bytes a text
    chosen = positives.dropDuplicates(["key"]).where(F.col("key").isin(kept)).select("words")
    counted = chosen.mapInArrow(listed, "word long").groupBy("word").count().where(F.col("count") >= max(least_texts, least_share * len(kept)))
    words = np.sort(counted.select("word").toArrow().column("word").to_numpy().astype(np.uint64))
    if not len(words):
        return Model(words, np.zeros(0), -6.0)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        candidates = shared.value
        for batch in batches:
            sets = [np.frombuffer(x, np.uint64) for x in batch.column("words").to_pylist()]
            if sets:
                yield pa.RecordBatch.from_arrays([_packed(*_among(candidates, np.concatenate(sets), np.array([len(s) for s in sets])))], ["words"])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        candidates = shared.value
        total, texts = np.zeros(len(candidates), np.int64), 0
        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                total += np.bincount(_among(candidates, *word_set(batch.column("text")))[0], minlength=len(candidates))
                texts += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], texts))], ["word", "texts"])

    shared = spark.sparkContext.broadcast(words)
    numbered = [np.frombuffer(x, np.int32) for x in sorted(chosen.mapInArrow(numbers, "words binary").toArrow().column("words").to_pylist())]
    table = source.select("text").mapInArrow(held, "word long, texts long").groupBy("word").agg(F.sum("texts").alias("texts")).toArrow()
    at, texts = table.column("word").to_numpy(), table.column("texts").to_numpy()
    other, n_unlabelled = np.zeros(len(words), np.int64), int(texts[at < 0].sum())
    other[at[at >= 0]] = texts[at >= 0]
    prior = min(max(prior, 1e-4), 0.9)
    picked = select(numbered, other, n_unlabelled, 0.4 / prior)
    new = np.cumsum(picked) - 1
    positive = [new[s[picked[s]]] for s in numbered]
    fixed = spark.sparkContext.broadcast((words[picked], positive))
    width = int(picked.sum())

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words = fixed.value[0]
        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                items, counts = word_set(batch.column("text"))
                items, counts = _among(known_words, items, counts) if len(known_words) else (np.zeros(0, np.int32), np.zeros(len(counts), np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("shard"), _packed(items, counts)], ["shard", "words"])

    def fit_shard(part: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.int32).astype(np.int64) for x in part.column("words").to_pylist()]
        weights, bias = fit(fixed.value[1], sets, width, prior, part.column("count").to_numpy().astype(float))
        return pa.table({"place": pa.array(np.arange(width + 1)), "weight": pa.array(np.append(weights, bias))})

    shard = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n_unlabelled // shard_texts))))
    dealt = source.select(shard.alias("shard"), "text").mapInArrow(patterns, "shard long, words binary").groupBy("shard", "words").count()
    fitted = dealt.groupBy("shard").applyInArrow(fit_shard, "place long, weight double").groupBy("place").agg(F.avg("weight").alias("weight")).toArrow().sort_by("place")
    weights = fitted.column("weight").to_numpy()
    return Model(words[picked], weights[:-1], float(weights[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row; a null or empty text has the score of no words, and texts of any length are read as a whole."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(batch.column("text")))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, fold: int = 5, **settings) -> DataFrame:
    """Train on the fold's labels, then score all ``docs``.

    Returns doc_id, held_out (crc32(doc_id as text) mod ``fold`` is 0; null
    doc_id: false), score, predicted (1 if score >= 0.5).  Rows that share a
    doc_id, and repeated rows, are scored each by its text; a null or empty text has the
    score of no words; texts of any length are read as a whole.  Other columns are ignored; an empty table gives an
    empty result.
    """
    model = train(docs, labels, fold, **settings)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, fold: int = 5, **settings) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns.

    Null, empty, long and repeated texts are scored as in ``toxicity``, and a score of exactly 0.5 is toxic; an empty table stays empty.
    """
    model = train(docs, labels, fold, **settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                yield batch.filter(pa.array(model.score(batch.column("text")) < 0.5))

    return docs.mapInArrow(run, docs.schema)
