"""Personal data with offset-preserving deobfuscation.

Base rules find plain emails, IP addresses, card and phone numbers.  Then a
cascade of transducers rewrites disguises - homoglyphs, spelled digits, "at" and
"dot" in words or brackets - into plain characters.  Every output character keeps
the source span it came from, so identifiers found in the rewritten text map back
to the source.  A found span counts as added if it covers a rewritten character.
Spelled digits have more than one reading, and what any of them shows counts.

Only texts with a cue reach Python strings: a vectorised pass over the Arrow
buffer looks for digits, at signs, non-Latin characters, and the hashes of the
words that disguises use.
"""

from __future__ import annotations

import copy
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .storage import ship

KINDS = ("email", "ip", "card", "phone")

# Digit words (English, German, French, Spanish).
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Words for the at sign, the dot and the plus sign.
AT_WORDS = ("at", "arroba", "arobase", "klammeraffe", "ät")
DOT_WORDS = ("dot", "punkt", "point", "punto")
PLUS_WORDS = ("plus", "más")
# Cyrillic and Greek letters that look like Latin ones, and signs that look like ASCII ones.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТХУаеоѕіјрсухԁԛԝһӏɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧοινρυαкт․。｡﹒‐‑‒–—−﹣﹢⁺﹫⁠",
        "ABESIJKMHOPCTXYaeosijpcyxdqwhlgABEZHIKMNOPTYXoivpuakt....-------++@\0",
        strict=True,
    )
)
LOOKALIKES |= dict.fromkeys("​‌‍⁠﻿­", "\0")

_AT_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried from its start alone, and given back by no rule
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules: leftmost, non-overlapping for each kind, failing matches dropped."""
    out: list[tuple[int, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _AT_LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            out.append((start, 0, done))
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p := g.lstrip("0")) < 4 and int(p or 0) <= 255 for g in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


class Tape:
    """A text under rewriting: for each character its source span, and whether a rule made it."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.first = np.arange(len(text))
        self.past = self.first + 1
        self.made = np.zeros(len(text), bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans (ascending, disjoint) of the present text; every new character stands for its whole span."""
        if not edits:
            return
        text, at, size = [], 0, 0
        source = np.zeros(len(self.text) + sum(len(e[2]) for e in edits), np.int64)  # for each new character the old one, or -1 - the edit
        for k, (a, b, new) in enumerate(edits):
            text += [self.text[at:a], new]
            source[size : size + a - at] = np.arange(at, a)
            size += a - at
            source[size : size + len(new)] = -1 - k
            size, at = size + len(new), b
        rest = len(self.text) - at
        source[size : size + rest] = np.arange(at, len(self.text))
        source = source[: size + rest]
        old, edit = np.maximum(source, 0), np.maximum(-1 - source, 0)
        begin, end = (np.array([e[i] for e in edits])[edit] for i in (0, 1))
        made = source < 0
        top = len(self.first) - 1
        self.first = np.where(made, self.first[np.minimum(begin, top)], self.first[np.minimum(old, top)])
        self.past = np.where(made, self.past[end - 1], self.past[np.minimum(old, top)])
        self.made = made | self.made[np.minimum(old, top)]
        self.text = "".join(text) + self.text[at:]


_OPEN, _CLOSE = r"[\[({<]\s*", r"\s*[\])}>]"
_DIGIT = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_AT, _DOT, _PLUS = "|".join(AT_WORDS), "|".join(DOT_WORDS), "|".join(PLUS_WORDS)
_RUN = re.compile(rf"(?i)(?<!\w)(?:(?:{_PLUS})\s+)?(?:(?:{_DIGIT})(?:[\s,.-]+|(?=$|[^\w]))|[0-9](?:[\s,.-]+)){{3,}}")
_PART = re.compile(rf"(?i)\b({_DIGIT})\b|\b(?:{_PLUS})\b")
_GAP = re.compile(r"(?<=[0-9])[\s,.-]+(?=[0-9])|(?<=\+)\s+(?=[0-9])")
#: A digit word (digits may touch it, letters not), a word for plus, plain digits, a plus sign.
_ITEM = re.compile(rf"(?i)(?<![^\W\d_])(?:({_DIGIT})|({_PLUS}))(?![^\W\d_])|[0-9]+|\+")
#: What the phone and IP rules allow between digits.
_BETWEEN = re.compile(r"[ \t().-]*")
_BLANK = re.compile(r"(?<=[0-9])[ \t-]+(?=[0-9])|(?<=\+)[ \t]+(?=[0-9])")
#: White space is taken from its start alone, as a whole.
_SPACES = r"(?:(?<!\s)\s++)?+"
_BRACKET_AT = re.compile(rf"(?i){_SPACES}{_OPEN}(?:{_AT}|@){_CLOSE}\s*")
_BRACKET_DOT = re.compile(rf"(?i){_SPACES}{_OPEN}(?:{_DOT}|\.){_CLOSE}\s*")
_WORD_DOT = re.compile(rf"(?i)(?<=[A-Za-z0-9])\s+(?:{_DOT})\s+(?=[A-Za-z0-9])")
#: " at " needs a spelled dot after the next word.
_WORD_AT = re.compile(rf"(?i)(?<=[A-Za-z0-9])\s+(?:{_AT})\s+(?=[A-Za-z0-9-]+(?:\s+(?:{_DOT})\s+|\s*{_OPEN}(?:{_DOT}|\.){_CLOSE}\s*)[A-Za-z0-9])")


def _lookalike(c: str) -> str | None:
    """ASCII form of one character, NUL for characters without width, None if it has none."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    plain = unicodedata.normalize("NFKC", c)
    if plain != c and len(plain) == 1 and plain.isascii():
        return plain
    digit = unicodedata.digit(c, None) if not plain.isascii() else None
    return str(digit) if digit is not None else None


def _digit(word: str) -> str:
    return DIGIT_WORDS[word.translate({0x130: "i", 0x131: "i"}).lower()]


def _spelled_out(tape: Tape) -> None:
    """Runs of three digit words or more: every separator becomes one blank."""
    words = []
    for run in _RUN.finditer(tape.text):
        parts = list(_PART.finditer(run[0]))
        if sum(bool(p[1]) for p in parts) >= 3:
            words += [(run.start() + p.start(), run.start() + p.end(), _digit(p[1]) if p[1] else "+") for p in parts]
    if words:
        tape.rewrite(words)
        gaps = [m for m in _GAP.finditer(tape.text) if tape.made[m.start() - 1] or tape.made[m.end()]]
        tape.rewrite([(m.start(), m.end(), "" if tape.text[m.start() - 1] == "+" else " ") for m in gaps])


def _partly_spelled(tape: Tape) -> None:
    """Every digit word next to digits, a plus or another digit word: dots stay, blanks and hyphens around it go."""
    items = list(_ITEM.finditer(tape.text))
    near = [bool(_BETWEEN.fullmatch(tape.text, x.end(), y.start())) for x, y in zip(items, items[1:], strict=False)]
    words = []
    for m, before, after in zip(items, [False, *near], [*near, False], strict=False):
        if m[1] and (before or after) or m[2] and after:
            words.append((m.start(), m.end(), _digit(m[1]) if m[1] else "+"))
    if words:
        tape.rewrite(words)
        tape.rewrite([(m.start(), m.end(), "") for m in _BLANK.finditer(tape.text) if tape.made[m.start() - 1] or tape.made[m.end()]])


def deobfuscate(text: str) -> list[Tape]:
    """The cascade: homoglyphs, disguised at and dot, spelled digits; one tape for each reading of the digits."""
    tape = Tape(text)
    glyphs = {c: g for c in set(text) if ord(c) > 127 and (g := _lookalike(c)) is not None}
    if glyphs:
        edits = [(i, i + 1, glyphs[c].replace("\0", "")) for i, c in enumerate(text) if c in glyphs]
        # a removed character belongs to none; letters around it count as rewritten
        tape.rewrite(edits)
        if any(not e[2] for e in edits):
            gap = tape.past[:-1] != tape.first[1:]
            tape.made[:-1] |= gap
            tape.made[1:] |= gap
    for rule, new in ((_WORD_AT, "@"), (_BRACKET_AT, "@"), (_BRACKET_DOT, "."), (_WORD_DOT, ".")):
        tape.rewrite([(m.start(), m.end(), new) for m in rule.finditer(tape.text)])
    out = [tape]
    for reading in (_spelled_out, _partly_spelled):
        read = copy.copy(tape)
        reading(read)
        if read.text != tape.text:
            out.append(read)
    return out


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) in source characters of what only the rewritten text shows."""
    have, out = set(base), set()
    for tape in deobfuscate(text):
        if not tape.made.any():
            continue
        for start, kind, end in base_spans(tape.text):
            if tape.made[start:end].any():
                span = (int(tape.first[start]), kind, int(tape.past[end - 1]))
                if span not in have:
                    out.add(span)
    return sorted(out)


def _table(words) -> np.ndarray:
    raw = [np.frombuffer(w.encode(), np.uint8) for w in words]
    flat = np.concatenate(raw)
    end = np.cumsum([len(r) for r in raw])
    return np.sort(textbuf.span_hashes(flat, end - [len(r) for r in raw], end))


_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_CUE_BYTE = np.zeros(256, bool)
_CUE_BYTE[0xC2] = True
_CUE_BYTE[0xC4:] = True
_BRACKET_BYTE = np.zeros(256, bool)
_BRACKET_BYTE[list(b"[({<")] = True
_PLAIN_BYTE = np.zeros(256, bool)
_PLAIN_BYTE[[0x40, *range(0x30, 0x3A)]] = True


def cues(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: can a base rule match; can a transducer rewrite it; is there a bracket, so that one may."""
    raw, at = textbuf.buffer(column)
    n = len(at) - 1
    row_of = lambda hits: np.bincount(np.searchsorted(at, hits, "right") - 1, minlength=n)[:n] > 0
    plain = row_of(np.flatnonzero(_PLAIN_BYTE[raw]))
    odd = row_of(np.flatnonzero(_CUE_BYTE[raw]))
    bracket = row_of(np.flatnonzero(_BRACKET_BYTE[raw]))
    digits = np.concatenate(([0], np.cumsum((raw >= 0x30) & (raw <= 0x39))))
    raw = _FOLD[raw]
    if n:  # capital Latin-1 letters
        raw[1:][(raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)] |= 0x20
    start, end, counts = textbuf.words(raw, at)
    short = np.flatnonzero(end - start <= 12)
    found = textbuf.span_hashes(raw, start[short], end[short])
    is_in = lambda table: table[np.minimum(np.searchsorted(table, found), len(table) - 1)] == found
    digit, link = short[is_in(_DIGIT_TABLE)], start[short[is_in(_LINK_TABLE)]]
    if len(digit):  # next to digits or another digit word
        spelled = np.zeros(len(start) + 2, bool)
        spelled[digit + 1] = True
        before, after = np.append(0, end)[digit], np.append(start, len(raw))[digit + 1]
        near = spelled[digit] | spelled[digit + 2] | (digits[start[digit]] > digits[before]) | (digits[after] > digits[end[digit]])
        odd |= row_of(start[digit[near]])
    return plain, odd | row_of(link), bracket


_DIGIT_TABLE = _table([*DIGIT_WORDS, *PLUS_WORDS])
_LINK_TABLE = _table([*DOT_WORDS, *(w for w in AT_WORDS if w != "at")])
_BRACKETS = re.compile(rf"(?i){_OPEN}(?:{_AT}|@|\.){_CLOSE}")


def spans_of(column: pa.Array) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base and added spans of every text of an Arrow column."""
    plain, odd, bracket = cues(column)
    for i, live in enumerate((plain | odd | bracket).tolist()):
        text = column[i].as_py() if live else ""
        base = base_spans(text) if plain[i] else []
        odd[i] |= bracket[i] and bool(_BRACKETS.search(text))
        yield base, added_spans(text, base) if odd[i] else []


_SPAN = "array<struct<start: long, kind: int, end: long, added: boolean>>"


def find(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every whole text of ``docs(doc_id, text)``.

    Returns doc_id and spans: structs of start and end (code points, end
    exclusive), kind (index in KINDS) and added, sorted by start, kind, end.  A
    null text counts as empty and has no spans.  Every row is treated by itself,
    repeated ones too.  Texts of any length are read as a whole, in time in proportion
    to them.  Other columns are ignored; an empty table gives an empty
    result.
    """
    ship(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("added", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                spans = []
                for base, added in spans_of(textbuf.filled(batch.column("text"))):
                    both = sorted([(s, False) for s in base] + [(s, True) for s in added])
                    spans.append([{"start": a, "kind": k, "end": b, "added": new} for (a, k, b), new in both])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, spans {_SPAN}")


def digests(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, digest of the base spans, and all spans as text."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    text = lambda spans: f"array_join(transform({spans}, s -> concat_ws(':', element_at(array({names}), s.kind + 1), s.start, s.end)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, s -> not s.added and s.kind = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.expr(text("filter(spans, s -> not s.added)")), 256).alias("base_sha256"),
        F.expr(text("spans")).alias("spans"),
        F.expr("cast(size(filter(spans, s -> s.added)) as long)").alias("n_added"),
    )


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each run of overlapping spans becomes the name of its first kind in brackets."""
    out, at, upto = [], 0, -1
    for start, kind, end in sorted(spans, key=lambda s: (s[0], -s[2], s[1])):
        if start >= max(upto, 0) or upto < 0:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        upto = max(upto, end)
        at = upto
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind, and ``n_chars`` (if there) set to the new length.

    All rows (repeated ones too) and columns stay; a null or empty text stays as it
    is; texts of any length are read as a whole; of spans that overlap the first
    names the run; an empty table gives an empty result.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.schema.get_field_index("text")
            for batch in textbuf.slices(whole, "text"):
                column = batch.column(at)
                changed = {i: base + added for i, (base, added) in enumerate(spans_of(textbuf.filled(column))) if base or added}
                if changed:
                    texts = column.to_pylist()
                    for i, spans in changed.items():
                        texts[i] = redact_text(texts[i], spans)
                    columns = list(batch.columns)
                    columns[at] = pa.array(texts, column.type)
                    batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
                yield batch

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out
