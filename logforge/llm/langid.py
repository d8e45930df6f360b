"""Language identification with bit-sliced Bloom filters of byte n-grams.

One table of bit masks serves all languages: bit l of a slot (in words of 64 bits)
belongs to the filter of language l, so one probe sequence answers for all of them.  The masks of an
n-gram's slots, ANDed, name every language that (as far as the filters tell) has
it among its frequent n-grams.  For each text the hits of each language are
counted, freed of the share that false positives explain, and the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .storage import folder, save, ship

N = 5
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True


def fold(raw: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters; other ASCII characters become spaces."""
    out = _FOLD[raw]
    if len(raw) > 1:
        upper = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
        out[upper] |= 0x20
    return out


def grams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte n-grams inside each text as 40-bit integers, and their number; those with a space in the middle are left out."""
    raw = fold(raw).astype(np.uint64)
    if len(raw) < N:
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    size = len(raw) - N + 1
    key = np.zeros(size, np.uint64)
    for k in range(N):
        key <<= np.uint64(8)
        key |= raw[k : k + size]
    live = raw[N // 2 : N // 2 + size] != 0x20
    for k in range(1, N):
        over = at[1:-1] - k
        live[over[(over >= 0) & (over < size)]] = False
    place = np.flatnonzero(live)
    return key[place], np.diff(np.searchsorted(place, at))


def padded(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with two blanks on both sides, so that a single letter has an n-gram too."""
    rows = np.arange(len(at))
    out = np.full(len(raw) + 4 * (len(at) - 1), 0x20, np.uint8)
    out[np.arange(len(raw)) + np.repeat(4 * rows[:-1] + 2, np.diff(at))] = raw
    return out, at + 4 * rows


def known_grams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of padded texts, and those that their words of one or two bytes have as texts of their own."""
    keys, counts = grams(raw, at)
    raw = fold(raw).astype(np.uint64)
    space = raw == 0x20
    one = np.flatnonzero(space[:-2] & ~space[1:-1] & space[2:]) + 1
    two = np.flatnonzero(space[:-3] & ~space[1:-2] & ~space[2:-1] & space[3:]) + 1
    mid, low = np.uint64(16), np.uint64(8)
    keys = np.concatenate((keys, np.uint64(0x2020002020) | raw[one] << mid, np.uint64(0x2020000020) | raw[two] << mid | raw[two + 1] << low))
    owner = np.concatenate((np.repeat(np.arange(len(counts)), counts), np.searchsorted(at, np.concatenate((one, two)), "right") - 1))
    return keys[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(counts))


@dataclass
class Filters:
    """``masks``: a bit for each language in each slot, in one column for each 64 languages; ``rates``: false-positive rate of each language."""

    languages: list[str]
    masks: np.ndarray
    rates: np.ndarray
    default: int
    probes: int = 3

    @staticmethod
    def slots(keys: np.ndarray, size: int, probes: int) -> list[np.ndarray]:
        h = textbuf.mix(keys)
        step = (h >> np.uint64(32)) | np.uint64(1)
        return [((h + step * np.uint64(k)) & np.uint64(size - 1)).astype(np.int64) for k in range(probes)]

    @classmethod
    def build(cls, languages: list[str], sets: list[np.ndarray], default: int, bits: int = 21, probes: int = 3) -> Filters:
        size = 1 << bits
        masks = np.zeros((size, -(-len(languages) // 64)), np.uint8 if len(languages) <= 8 else np.uint64)
        for k, keys in enumerate(sets):
            for slot in cls.slots(keys, size, probes):
                masks[slot, k // 64] |= masks.dtype.type(1 << k % 64)
        fill = np.array([np.count_nonzero(masks[:, k // 64] & masks.dtype.type(1 << k % 64)) / size for k in range(len(languages))])
        return cls(languages, masks, fill**probes, default, probes)

    def languages_of(self, keys: np.ndarray) -> np.ndarray:
        """Bit masks (one row each) of all languages whose filter holds each n-gram."""
        out = None
        for slot in self.slots(keys, len(self.masks), self.probes):
            found = self.masks.take(slot, 0)
            out = found if out is None else out & found
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        raw, at = textbuf.buffer(column)
        keys, counts = grams(*padded(raw, at))
        n = len(counts)
        owner = np.repeat(np.arange(n), counts)
        found = self.languages_of(keys)
        hits = np.zeros((n, len(self.languages)))
        for k in range(len(self.languages)):
            hits[:, k] = np.bincount(owner, (found[:, k // 64] >> found.dtype.type(k % 64)) & found.dtype.type(1), n)
        right = np.maximum(hits - counts[:, None] * self.rates, 0) / (1 - self.rates)
        best = right.argmax(1)
        top = right[np.arange(n), best]
        best[top <= 0] = self.default
        score = np.minimum(top / np.maximum(counts, 1), 1.0)
        letters = np.bincount(np.searchsorted(at, np.flatnonzero(_ASCII_LETTER[raw]), "right") - 1, minlength=n)[:n] > 0
        names = [self.languages[b] for b in best.tolist()]
        for i in np.flatnonzero(~letters).tolist():
            if not any(c.isalpha() for c in column[i].as_py() or ""):
                names[i], score[i] = "und", 0.0
        return names, score


def train(docs: DataFrame, fold_: int = 4, held: int = 2, most_texts: int = 4000, least_share: float = 0.005) -> Filters | None:
    """Filters from ``docs(doc_id, text, lang)``; None without a labelled text.

    Only rows with crc32(doc_id as text) mod ``fold_`` other than ``held`` and a lang
    take part; of a language with more than ``most_texts`` of them that share is taken, by a hash of doc_id.
    A filter holds the n-grams in ``least_share`` or more of its language's texts.
    Every language with a labelled text gets a filter.
    """
    ship(docs.sparkSession)
    in_fold = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % fold_ != held)
    sizes = docs.where(in_fold).groupBy(F.col("lang").cast("string").alias("lang")).count().collect()  # a row for each language
    if not sizes:
        return None
    languages = sorted(r["lang"] for r in sizes)
    # a text takes part if its hash is below its language's share
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, most_texts / r["count"])) for r in sizes], "of string, share double")
    rows = docs.where(in_fold & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = rows.join(F.broadcast(shares), F.col("lang") == F.col("of")).where(place < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                names = np.array(batch.column("lang").to_pylist(), object)
                keys, number = textbuf.unique_by_row(*known_grams(*padded(*textbuf.buffer(batch.column("text")))))
                owner = np.repeat(np.arange(len(number)), number)
                for name in sorted(set(names)):
                    mine, seen = np.unique(keys[(names == name)[owner]], return_counts=True)
                    texts = int((names == name).sum())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * (len(mine) + 1)), pa.array(np.append(mine.astype(np.int64), -1)), pa.array(np.append(seen, texts).astype(np.int64))], ["lang", "gram", "texts"])

    counted = rows.mapInArrow(count, "lang string, gram long, texts long").groupBy("lang", "gram").agg(F.sum("texts").alias("texts"))
    counted = save(counted, folder(docs.sparkSession), "grams")
    least = F.broadcast(counted.where("gram = -1").select("lang", F.greatest(F.lit(1.0), F.lit(least_share) * F.col("texts")).alias("least")))
    table = counted.where("gram >= 0").join(least, "lang").where("texts >= least").select("lang", "gram").toArrow()
    of, all_grams = pc.index_in(table.column("lang"), pa.array(languages, pa.string())).to_numpy(), table.column("gram").to_numpy().astype(np.uint64)
    top = max(sizes, key=lambda r: (r["count"], r["lang"]))["lang"]
    return Filters.build(languages, [np.sort(all_grams[of == k]) for k in range(len(languages))], languages.index(top))


def identify(docs: DataFrame, fold_: int = 4, held: int = 2, **settings) -> DataFrame:
    """Train on the fold, then predict every row of ``docs(doc_id, text, lang)``.

    Returns doc_id, held_out (crc32(doc_id as text) mod ``fold_`` is ``held``; null
    doc_id: false), lang_pred and score (0 to 1, the share of n-grams that the
    language explains).  A null text, or one without a letter, is ``und`` with
    score 0, as is every text if no row has a lang; letters of which
    no filter holds an n-gram give the most frequent language with score 0.  Of
    languages with equal hits the first by code point is taken; texts of any length are read as a whole; repeated
    rows are predicted alike.  Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    model = train(docs, fold_, held, **settings)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                column = textbuf.filled(batch.column("text"))
                names, score = filters.predict(column) if filters else (["und"] * len(column), np.zeros(len(column)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold_ == held, F.lit(False))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
