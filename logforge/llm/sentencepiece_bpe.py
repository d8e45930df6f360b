"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Texts are cut where no piece of the vocabulary can cross (before a run of word
marks, at characters that no piece joins, and between two characters that no
piece holds side by side).  Each distinct word is encoded once for each worker: the
symbols of all new words lie in one flat numpy array; every round finds the
least pair rank of each segment, merges its leftmost occurrences in all
segments at once, and drops the segments that have no pair left.

A round may merge all occurrences of a segment's best pair at once only if no
better pair can arise from the merged piece.  Where one can, the round merges the
leftmost occurrence alone, so that results equal the sequential algorithm.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .storage import ship

MARK = "▁"
#: A worker keeps the ids of words it has met; beyond so many words, or ids of all of them together, it starts anew.
CACHE_WORDS, CACHE_IDS = 100_000, 1 << 20
_NEVER = np.int64(1 << 40)
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of one protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 1:
            value, i = data[i : i + 8], i + 8
        elif kind == 5:
            value, i = data[i : i + 4], i + 4
        else:
            size, i = varint(i)
            value, i = data[i : i + size], i + size
        yield key >> 3, value


class Model:
    """A BPE model with byte fallback and no text normalisation."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[str] = []
        scores, kinds = [], []
        self.dummy_prefix = True
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                if trainer.get(3) != 2 or not trainer.get(35):
                    raise ValueError("only BPE models with byte fallback are supported")
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only models without normalisation are supported")
                self.dummy_prefix = bool(spec.get(3, 1))
        if USER in kinds or UNUSED in kinds:
            raise ValueError("user-defined and unused pieces are not supported")
        self.kinds = np.array(kinds)
        self.size = len(self.pieces)
        self.bos, self.eos = (next(i for i, p in enumerate(self.pieces) if p == name) for name in ("<s>", "</s>"))
        self.byte_id = np.array([self.pieces.index(f"<0x{b:02X}>") for b in range(256)], np.int64)
        known = {p: i for i, p in enumerate(self.pieces) if kinds[i] == NORMAL}
        # symbols: piece ids, then size + code point for characters that are no piece
        self.symbol = np.arange(self.size, self.size + 0x110000, dtype=np.int64)
        for p, i in known.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in known.values()}, reverse=True))}
        rank = {i: order[scores[i]] for i in known.values()}
        of = lambda s: known.get(s, self.size + ord(s) if len(s) == 1 else None)
        keys, ranks, merged, bigrams = [], [], [], set()
        alone = np.ones(len(order), bool)  # ranks whose occurrences may merge at once
        holders = np.zeros(len(order), np.int64)
        joined: set[str] = set()
        for p, i in known.items():
            if len(p) < 2:
                continue
            holders[rank[i]] += 1
            joined.update(p)
            bigrams.update(zip(p, p[1:], strict=False))
            for k in range(1, len(p)):
                a, b = of(p[:k]), of(p[k:])
                if a is None or b is None:
                    continue
                keys.append((a << 21) | b)
                ranks.append(rank[i])
                merged.append(i)
                for part in (a, b):
                    if part in rank and len(self.pieces[part]) > 1 and rank[i] <= rank[part]:
                        alone[rank[part]] = False
        alone[holders > 1] = False
        at = np.argsort(np.array(keys))
        self.keys, self.ranks, self.merged = (np.array(x, np.int64)[at] for x in (keys, ranks, merged))
        self.alone = np.append(alone, True)
        self.bigrams = np.array(sorted((ord(a) << 21) | ord(b) for a, b in bigrams), np.int64)
        if any(a != MARK and b == MARK for a, b in bigrams):
            raise ValueError("a piece has a word mark inside")
        bare = "".join(c for c in "\n\t\r" if c not in joined)
        word = f"{MARK}*[^{MARK}{bare}]+|{MARK}+" + (f"|[{bare}]+" if bare else "")
        self._split = re.compile(word).findall
        self._reset()
        chunk = [self.pieces.index(MARK * 16)] if MARK * 16 in known else []
        run = MARK * 100
        whole = self._merge([run + "x", MARK * 52 + "x", MARK * 101, MARK * 53])
        if chunk and whole[0] == chunk * 3 + whole[1] and whole[2] == chunk * 3 + whole[3]:
            # long runs of marks split off sixteen at a time, as shown just now
            self._split = re.compile(f"{MARK}{{16}}(?={MARK}{{40}})|{word}").findall
        text = [p.replace(MARK, " ").encode() if kinds[i] == NORMAL else b"" for i, p in enumerate(self.pieces)]
        for b, i in enumerate(self.byte_id):
            text[i] = bytes([b])
        text[kinds.index(UNKNOWN)] = " ⁇ ".encode()
        self._bytes = np.frombuffer(b"".join(text), np.uint8)
        self._width = np.array([len(t) for t in text], np.int64)
        self._at = np.cumsum(self._width) - self._width
        self._marked = np.array([p.startswith(MARK) and kinds[i] == NORMAL for i, p in enumerate(self.pieces)])

    def _reset(self) -> None:
        self._seen: dict[str, int] = {}
        self._ids: list[np.ndarray] = [np.zeros(0, np.int32)]
        self._flat = np.zeros(0, np.int32)
        self._start = np.zeros(0, np.int64)
        self._count = np.zeros(0, np.int64)

    def _rank(self, sym: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of the pair that begins at each symbol; ``last``: no pair begins there."""
        key = np.empty(len(sym), np.int64)
        key[:-1] = (sym[:-1] << 21) | sym[1:]
        key[-1] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & ~last
        return np.where(hit, self.ranks[at], _NEVER), self.merged[at]

    def _merge(self, words: list[str]) -> list[list[int]]:
        flat, count = self._merge_flat(words)
        return [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])]

    def _merge_flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and the number of each word's ids."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        length = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words)), length)
        last = np.ones(len(chars), bool)
        pair = (chars[:-1] << 21) | chars[1:]
        at = np.minimum(np.searchsorted(self.bigrams, pair), len(self.bigrams) - 1)
        last[:-1] = (word[:-1] != word[1:]) | (self.bigrams[at] != pair)
        place = np.arange(len(chars))
        sym = self.symbol[chars]
        done_place, done_sym = [], []
        while len(sym):
            rank, merged = self._rank(sym, last)
            starts = np.flatnonzero(np.append(True, last[:-1]))
            least = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(sym)))
            open_ = least < _NEVER
            if not open_.all():  # compaction: segments without a pair leave
                stay = np.repeat(open_, size)
                done_place.append(place[~stay])
                done_sym.append(sym[~stay])
                sym, last, place, rank, merged = (x[stay] for x in (sym, last, place, rank, merged))
                size, least = size[open_], least[open_]
                if not len(sym):
                    break
                starts = np.cumsum(size) - size
            pick = rank == np.repeat(least, size)
            where = np.flatnonzero(pick)
            fresh = np.append(True, np.diff(where) != 1)  # in a run of overlapping pairs every second one counts
            keep = (where - where[fresh][np.cumsum(fresh) - 1]) % 2 == 0
            segment = np.repeat(np.arange(len(starts)), size)[where]
            leftmost = np.append(True, segment[1:] != segment[:-1])
            where = where[keep & (self.alone[least[segment]] | leftmost)]
            sym = sym.copy()
            sym[where] = merged[where]
            last = last.copy()
            last[where] = last[where + 1]
            stay = np.ones(len(sym), bool)
            stay[where + 1] = False
            sym, last, place = sym[stay], last[stay], place[stay]
        place, sym = np.concatenate(done_place), np.concatenate(done_sym)
        order = np.argsort(place)
        place, sym = place[order], sym[order]
        other = sym >= self.size
        owner = word[place]
        if other.any():  # characters that are no piece become their UTF-8 bytes
            raw = [np.frombuffer(chr(c).encode(), np.uint8) for c in (sym[other] - self.size).tolist()]
            wide = np.ones(len(sym), np.int64)
            wide[other] = [len(r) for r in raw]
            out = np.repeat(sym, wide)
            out[np.repeat(other, wide)] = self.byte_id[np.concatenate(raw)]
            sym, owner = out, np.repeat(owner, wide)
        return sym.astype(np.int32), np.bincount(owner, minlength=len(words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, with begin and end ids, and the number of each text's ids."""
        if len(self._seen) > CACHE_WORDS or len(self._flat) > CACHE_IDS:
            self._reset()
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                mine = self._split((MARK if self.dummy_prefix else "") + text.replace(" ", MARK))
                counts[i] = len(mine)
                words += mine
        seen = self._seen
        new = list(dict.fromkeys(w for w in words if w not in seen))
        if new:
            flat, count = self._merge_flat(new)
            base = len(seen)
            seen.update(zip(new, range(base, base + len(new)), strict=True))
            self._start = np.append(self._start, len(self._flat) + np.cumsum(count) - count)
            self._count = np.append(self._count, count)
            self._flat = np.append(self._flat, flat)
        index = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
        wide = self._count[index]
        body = self._flat[np.repeat(self._start[index] - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())]
        number = np.zeros(len(texts), np.int64)
        full = np.flatnonzero(counts)
        if len(full):
            number[full] = np.add.reduceat(wide, (np.cumsum(counts) - counts)[full])
        total = number + 2
        end = np.cumsum(total)
        out = np.empty(end[-1] if len(end) else 0, np.int32)
        inner = np.ones(len(out), bool)
        inner[end - total] = inner[end - 1] = False
        out[end - total], out[end - 1] = self.bos, self.eos
        out[inner] = body
        return out, total

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the texts of flat ``ids``, and the number of each text's bytes.

        Byte pieces give their bytes as they are; the word mark that begins the first piece gives nothing.
        """
        wide = self._width[ids]
        start = self._at[ids].copy()
        owner = np.repeat(np.arange(len(counts)), counts)
        body = np.flatnonzero(self.kinds[ids] != CONTROL)
        head = body[np.append(True, owner[body][1:] != owner[body][:-1])] if len(body) else body
        if self.dummy_prefix:
            head = head[self._marked[ids[head]]]
            start[head] += 1
            wide[head] -= 1
        raw = self._bytes[np.repeat(start - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())]
        return raw, np.bincount(owner, wide, len(counts)).astype(np.int64)

    def decode_text(self, ids: list[int]) -> str:
        """One text; each byte that is no valid UTF-8 gives U+FFFD."""
        raw = bytes(self.decode(np.array(ids, np.int64), np.array([len(ids)]))[0])
        out = []
        while raw:
            try:
                return "".join(out) + raw.decode()
            except UnicodeDecodeError as e:
                out.append(raw[: e.start].decode() + "�")
                raw = raw[e.start + 1 :]
        return "".join(out)


_models: dict[int, Model] = {}


def _model(data: bytes) -> Model:
    key = hash(data)
    if key not in _models:
        _models[key] = Model(data)
    return _models[key]


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs(doc_id, text)`` encoded with the model, and decoded again.

    Returns for each row: doc_id; n_tokens; ids, packed little-endian unsigned
    32-bit integers, begin and end ids included; decoded, the text of these ids.
    A null text counts as empty: its ids are begin and end, its decoded text is
    empty.  Texts and words of any length are encoded as a whole.  Repeated rows give equal rows.  Other columns are ignored; an empty table gives an empty result.

    ``model_path`` is read by the driver; the executors get the model's bytes.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                ids, counts = model.encode(textbuf.filled(batch.column("text")).to_pylist())
                raw, sizes = model.decode(ids, counts)
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                cuts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends * np.int32(4)), pa.py_buffer(ids.astype("<u4"))])
                text = pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(cuts), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), packed, text], ["doc_id", "n_tokens", "ids", "decoded"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the packed ids and of the decoded text."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
