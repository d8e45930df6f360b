"""Chroma audio fingerprints and the alignment of recordings.

PCM audio becomes pitch-class frames (windowed spectra folded on twelve classes).
Sixteen filters compare rectangles of the time-pitch image, summed by an integral
image; each gives two bits, so every frame position packs into one 32-bit integer.
Two recordings align where the histogram of offsets between equal halves of integers peaks,
if the bit errors over the whole overlap at that offset are few.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .storage import folder, save, ship

RATE, WINDOW, HOP = 4000, 512, 128
#: Queries that one scan of all fingerprints serves; their codes (bounded by length) are broadcast.
QUERY_BLOCK = 2048
WIDTH = 16
#: Rectangles (first frame, frames, first class, classes) whose sums each filter compares, by rule: thin and wide, early against late and low against high.
FILTERS = tuple(((k % 4) * 2, 4 + 2 * (k // 8), (5 * k) % 12 // 2, 2 + k % 3, k // 2 % 2) for k in range(16))
#: Steps between the four levels of a filter's log ratio; the code of a level has one changed bit from level to level.
LEVELS = np.array([-0.35, 0.0, 0.35])
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: Code of a window without sound: no filter tells its two sides apart.
SILENT = np.uint32(0x55555555)
#: Votes counted at a time.
VOTES = 1 << 20


def wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    """16-bit mono PCM in a RIFF container."""
    data = np.clip(np.round(samples * 32767), -32768, 32767).astype("<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", len(data)) + data


def samples_of(media: bytes | None) -> np.ndarray:
    """Mono samples (-1 to 1) of 16-bit PCM RIFF audio at any rate, brought to ``RATE`` by linear interpolation; nothing for null or other bytes."""
    if not media or len(media) < 44 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return np.zeros(0)
    at, channels, rate, bits, out = 12, 1, RATE, 16, np.zeros(0)
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        body = media[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            channels, rate, bits = int.from_bytes(body[2:4], "little"), int.from_bytes(body[4:8], "little"), int.from_bytes(body[14:16], "little")
        elif name == b"data" and bits == 16 and channels and rate:
            x = np.frombuffer(body[: len(body) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels).mean(1) / 32768
            out = x if rate == RATE or not len(x) else np.interp(np.arange(0, len(x) * RATE // rate) * rate / RATE, np.arange(len(x)), x)
        at += 8 + size + size % 2
    return out


def _fold_matrix() -> np.ndarray:
    """Spectrum bins to pitch classes: each bin from 55 to 1760 Hz goes to its nearest semitone."""
    hz = np.arange(WINDOW // 2 + 1) * RATE / WINDOW
    out = np.zeros((len(hz), 12))
    live = (hz >= 55) & (hz <= 1760)
    out[np.flatnonzero(live), np.round(12 * np.log2(hz[live] / 440)).astype(int) % 12] = 1
    return out


_FOLDS = _fold_matrix()
_HANN = np.hanning(WINDOW)


def chroma(audio: np.ndarray) -> np.ndarray:
    """Pitch-class frames of recordings of one length: (recordings, frames, 12), each frame of norm 1 (silence: 0)."""
    n = audio.shape[1]
    if n < WINDOW:
        return np.zeros((len(audio), 0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(audio, WINDOW, 1)[:, ::HOP]
    power = np.abs(np.fft.rfft(frames * _HANN, axis=2)) ** 2 @ _FOLDS
    norm = np.sqrt((power**2).sum(2, keepdims=True))
    return np.where(norm > 1e-6, power / np.maximum(norm, 1e-12), 0)


def codes(frames: np.ndarray) -> np.ndarray:
    """Packed 32-bit codes of pitch-class frames: (recordings, frames - WIDTH + 1)."""
    size = frames.shape[1] - WIDTH + 1
    if size <= 0:
        return np.zeros((len(frames), 0), np.uint32)
    image = np.zeros((frames.shape[0], frames.shape[1] + 1, 13))
    image[:, 1:, 1:] = frames.cumsum(1).cumsum(2)
    box = lambda t, w, c, h: image[:, t + w : t + w + size, c + h] - image[:, t : t + size, c + h] - image[:, t + w : t + w + size, c] + image[:, t : t + size, c]
    out = np.zeros((len(frames), size), np.uint32)
    for t, w, c, h, kind in FILTERS:
        if kind:  # the same classes later, or earlier where no room is left
            b = box(t + w if t + 2 * w <= WIDTH else t - w, w, c, h)
        else:  # higher classes at the same time, or lower ones
            b = box(t, w, c + h if c + 2 * h <= 12 else c - h, h)
        level = np.searchsorted(LEVELS, np.log((box(t, w, c, h) + 0.1) / (b + 0.1)))
        out = (out << np.uint32(2)) | GRAY[level]
    return out


def fingerprint_media(media: list[bytes | None]) -> list[np.ndarray]:
    """Codes of each recording; recordings of one length are computed together."""
    audio = [samples_of(m) for m in media]
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(audio)
    groups: dict[int, list[int]] = {}
    for i, x in enumerate(audio):
        groups.setdefault(len(x), []).append(i)
    for n, at in groups.items():
        step = max(1, (1 << 19) // max(n, 1))
        for lo in range(0, len(at), step):
            part = at[lo : lo + step]
            for i, c in zip(part, codes(chroma(np.stack([audio[j] for j in part]))), strict=True):
                out[i] = c
    return out


def fingerprint(media: DataFrame) -> DataFrame:
    """id and codes (packed little-endian unsigned 32-bit integers) of ``media(id, audio)``, one row for each; null, other formats and clips below a window have no codes.

    Repeated rows give equal rows; other columns are ignored; an empty table gives an empty result.
    """
    ship(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textbuf.slices(whole, "audio", 8 << 20):
                found = fingerprint_media(batch.column("audio").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([c.astype("<u4").tobytes() for c in found], pa.binary())], ["id", "codes"])

    return media.select(F.col("id").cast("long").alias("id"), F.col("audio").cast("binary").alias("audio")).mapInArrow(run, "id long, codes binary")


_BITS = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def align(query: np.ndarray, other: np.ndarray, offset: int) -> tuple[int, float]:
    """Codes in the overlap of ``other`` shifted by ``offset`` against ``query``, and their share of wrong bits."""
    a, b = max(0, -offset), max(0, offset)
    n = min(len(query) - a, len(other) - b)
    if n <= 0:
        return 0, 1.0
    x = query[a : a + n] ^ other[b : b + n]
    return n, float(_BITS[x & 0xFFFF].sum() + _BITS[x >> 16].sum()) / (32 * n)


def align_all(q_code: np.ndarray, q_start: np.ndarray, q_size: np.ndarray, d_code: np.ndarray, d_start: np.ndarray, d_size: np.ndarray, offset: np.ndarray, least_overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """``align`` of many pairs, whose codes lie end to end: overlaps and errors, the error of an overlap below ``least_overlap`` or 1 is 1."""
    a, b = np.maximum(0, -offset), np.maximum(0, offset)
    n = np.maximum(np.minimum(q_size - a, d_size - b), 0)
    x_at, y_at, error = q_start + a, d_start + b, np.ones(len(n))
    live = np.flatnonzero(n >= max(least_overlap, 1))
    total = np.cumsum(n[live])
    # about a million codes at a time
    cuts = [0, *(np.flatnonzero(np.diff((total - 1) >> 20)) + 1).tolist(), len(live)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = live[lo:hi]
        if not len(part):
            continue
        first = np.cumsum(n[part]) - n[part]
        step = np.arange(n[part].sum()) - np.repeat(first, n[part])
        x = q_code[np.repeat(x_at[part], n[part]) + step] ^ d_code[np.repeat(y_at[part], n[part]) + step]
        error[part] = np.add.reduceat(_BITS[x & 0xFFFF].astype(np.int64) + _BITS[x >> 16], first) / (32 * n[part])
    return n, error


def match_block(queries: list[tuple[int, np.ndarray]], others: list[tuple[int, np.ndarray]], least_hits: int = 3, most_error: float = 0.2, least_overlap: int = 16, tries: int | None = None) -> list[tuple[int, int, int, int, int, float]]:
    """(query, other, offset, hits, overlap, bit_error) of the recordings that align.

    Equal halves of codes vote for an offset (hits counts them), but those of silence, which tell nothing.  All offsets of each pair that have
    ``least_hits`` votes are tested (with ``tries`` only so many, the fullest),
    and the one of least error counts (of equal errors the least offset).
    """
    q_code = np.concatenate([c for _, c in queries]) if queries else np.zeros(0, np.uint32)
    d_code = np.concatenate([c for _, c in others]) if others else np.zeros(0, np.uint32)
    if not len(q_code) or not len(d_code):
        return []
    q_size, d_size = (np.array([len(c) for _, c in side], np.int64) for side in (queries, others))
    q_start, d_start = np.cumsum(q_size) - q_size, np.cumsum(d_size) - d_size
    # each code votes by its two halves, so that a few wrong bits leave one of them whole
    half = lambda c: np.stack([c & np.uint32(0xFFFF), c >> np.uint32(16) | np.uint32(0x10000)], 1).reshape(-1)
    q_key, d_key = half(q_code), half(d_code)
    q_own, d_own = (np.repeat(np.arange(len(size)), 2 * size) for size in (q_size, d_size))
    q_at, d_at = np.arange(len(q_key)) // 2 - q_start[q_own], np.arange(len(d_key)) // 2 - d_start[d_own]
    sound = np.flatnonzero(np.repeat(q_code != SILENT, 2))
    order = sound[np.argsort(q_key[sound], kind="stable")]
    low, high = np.searchsorted(q_key[order], d_key, "left"), np.searchsorted(q_key[order], d_key, "right")
    high = np.where(np.repeat(d_code == SILENT, 2), low, high)
    out = []
    # whole recordings for each test of offsets; a recording of many votes is counted in parts
    total = np.cumsum(high - low)
    runs = np.searchsorted(total, np.arange(0, total[-1], VOTES), "left") if len(total) and total[-1] else []
    cuts = sorted({0, len(d_key), *(np.searchsorted(d_own, d_own[r]) for r in runs)})
    for a, b in zip(cuts, cuts[1:], strict=False):
        found, hits = np.zeros((3, 0), np.int64), np.zeros(0, np.int64)
        before = total[a] - (high[a] - low[a])
        parts = [a, *(a + np.unique(np.searchsorted(total[a:b] - before, np.arange(VOTES, total[b - 1] - before, VOTES), "right"))).tolist(), b]
        for lo, hi in zip(parts, parts[1:], strict=False):
            number = high[lo:hi] - low[lo:hi]
            if not number.sum():
                continue
            d = np.repeat(np.arange(lo, hi), number)
            at = order[np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(low[lo:hi], number)]
            key, count = np.unique(np.stack([q_own[at], d_own[d], d_at[d] - q_at[at]]), axis=1, return_counts=True)
            if not len(hits):
                found, hits = key, count
            else:
                found, place = np.unique(np.concatenate((found, key), axis=1), axis=1, return_inverse=True)
                hits = np.bincount(place.reshape(-1), np.concatenate((hits, count)), found.shape[1]).astype(np.int64)
        if not len(hits):
            continue
        (q, o, offset), hits = found[:, hits >= least_hits], hits[hits >= least_hits]
        if tries is not None:
            fullest = np.lexsort((offset, -hits, o, q))
            q, o, offset, hits = q[fullest], o[fullest], offset[fullest], hits[fullest]
            first = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (o[1:] != o[:-1]))[: len(q)])
            rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
            q, o, offset, hits = (v[rank < tries] for v in (q, o, offset, hits))
        size, error = align_all(q_code, q_start[q], q_size[q], d_code, d_start[o], d_size[o], offset, least_overlap)
        good = np.flatnonzero((size >= least_overlap) & (error <= most_error))
        good = good[np.lexsort((offset[good], error[good], o[good], q[good]))]
        best = good[np.append(True, (q[good][1:] != q[good][:-1]) | (o[good][1:] != o[good][:-1]))[: len(good)]]
        rows = zip(*(v[best].tolist() for v in (q, o, offset, hits, size, error)), strict=True)
        out += [(queries[i][0], others[j][0], f, n, m, e) for i, j, f, n, m, e in rows]
    return out


_MATCH = "query long, class_id long, offset int, hits int, overlap int, bit_error double"


def search(fingerprints: DataFrame, query_every: int = 100) -> DataFrame:
    """Align every recording whose id is a multiple of ``query_every`` with all recordings.

    ``fingerprints(id, codes)`` gives a row for each recording: id; class_id, the
    least id with equal codes; n_codes; is_query; n_matches, for queries; and null in the other columns.
    Copies share a class and are searched once: for a class with a query the rows
    of its least id have match_class, offset, hits, overlap and bit_error instead,
    one row for each class that aligns.  A class always matches itself, unless it
    has too few codes or is silent.  Recordings without codes are their own class; a
    null id is no query.  Recordings of any length are compared as a whole; other columns
    are ignored; an empty table gives an empty result.  Queries
    are taken in blocks of ``QUERY_BLOCK``; each block scans all classes once, and
    nothing else is held.
    """
    spark = fingerprints.sparkSession
    ship(spark)
    where = folder(spark)
    known = save(fingerprints, where, "fingerprints")
    key = F.sha2("codes", 256)
    keyed = known.withColumn("key", F.when(F.length("codes") > 0, key))
    asks = F.coalesce(F.pmod("id", F.lit(query_every)) == 0, F.lit(False))
    classes = save(keyed.where("key is not null").groupBy("key").agg(F.min("id").alias("class_id"), F.max(asks).alias("asks")), where, "classes")
    one = save(known.join(classes.select("class_id", "asks"), F.col("id") == F.col("class_id")).dropDuplicates(["class_id"]).select("class_id", "asks", "codes"), where, "representatives")
    number = one.where("asks").count()
    found = None
    for block in range(-(-number // QUERY_BLOCK)):
        blocks = -(-number // QUERY_BLOCK)
        mine = one.where("asks").where(F.pmod(F.xxhash64("class_id"), F.lit(blocks)) == block).select("class_id", "codes").toArrow()
        shared = spark.sparkContext.broadcast([(i, np.frombuffer(c, "<u4")) for i, c in zip(mine.column(0).to_pylist(), mine.column(1).to_pylist(), strict=True)])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, whole.num_rows, 2000):
                    batch = whole.slice(lo, 2000)
                    others = [(i, np.frombuffer(c, "<u4")) for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                    rows = match_block(shared.value, others)
                    columns = list(zip(*rows, strict=True)) or [()] * 6
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query", "class_id", "offset", "hits", "overlap", "bit_error"])

        part = save(one.select("class_id", "codes").mapInArrow(run, _MATCH), where, f"matches-{block}")
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    out = keyed.join(classes.select("key", "class_id"), "key", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), (F.length("codes") / 4).cast("int").alias("n_codes"), asks.alias("is_query"))
    if found is None:
        found = spark.createDataFrame([], _MATCH)
    pairs = found.select(F.col("query").alias("of"), F.col("class_id").alias("match_class"), "offset", "hits", "overlap", "bit_error")
    counts = pairs.groupBy(F.col("of").alias("counted")).agg(F.count(F.lit(1)).alias("n"))
    out = out.join(counts, F.col("class_id") == F.col("counted"), "left").withColumn("n_matches", F.when(F.col("is_query"), F.coalesce("n", F.lit(0)))).drop("counted", "n")
    return out.join(pairs, (F.col("id") == F.col("of")) & (F.col("id") == F.col("class_id")), "left").drop("of")


def sonify(vectors: DataFrame, note: int = 128) -> DataFrame:
    """A media column for ``vectors(vec_id, embedding)``, which have none: each number plays a note of ``note`` samples.

    Returns id and audio (RIFF).  The note's pitch is the number's place among 36
    semitones from 110 Hz, its loudness is even.  A null or empty vector is silence.  Repeated rows give equal rows.
    """
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        time = np.arange(note) / RATE
        fade = np.minimum(1, np.minimum(np.arange(note), np.arange(note)[::-1]) / 12)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                audio = []
                for v in batch.column("embedding").to_pylist():
                    x = np.array([y if y is not None and np.isfinite(y) else 0 for y in v or []], float)
                    hz = 110 * 2 ** (np.clip(np.round(18 + 60 * x), 0, 35) / 12)
                    audio.append(wav((np.sin(2 * np.pi * hz[:, None] * time) * fade * 0.5).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(audio, pa.binary())], ["id", "audio"])

    return vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(run, "id long, audio binary")
