import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from logforge.llm import textbuf as T

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b", max_size=30)), min_size=1, max_size=8)


@given(texts)
def test_words_and_hashes(values):
    column = pa.array(values, pa.string())
    raw, at = T.buffer(column)
    start, end, counts = T.words(raw, at)
    got = [bytes(raw[a:b]).decode() for a, b in zip(start, end)]
    want = [re.findall(r"[^\x20\x09-\x0D]+", v or "") for v in values]
    assert got == [w for ws in want for w in ws] and counts.tolist() == [len(w) for w in want]
    hashes = T.span_hashes(raw, start, end)
    by_word = {}
    for w, h in zip(got, hashes.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


@given(texts)
def test_shingles(values):
    column = pa.array(values, pa.string())
    grams, number = T.shingle_hashes(*T.word_hashes(column), 3)
    at, seen = 0, {}
    for v, n in zip(values, number.tolist()):
        w = re.findall(r"[^\x20\x09-\x0D]+", v or "")
        want = [tuple(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [tuple(w)] * bool(w)
        assert n == len(want)
        for g, h in zip(want, grams[at : at + n].tolist()):
            assert seen.setdefault(g, h) == h
        at += n
    assert len(set(seen.values())) == len(seen)


def test_slices_keep_every_row():
    batch = pa.record_batch([pa.array(["a" * 10, None, "b" * 100, "", "c"])], ["t"])
    assert sum(s.num_rows for s in T.slices(batch, "t", 8)) == 5
    sliced = batch.slice(1, 3)
    raw, at = T.buffer(sliced.column("t"))
    assert len(raw) == 100 and at.tolist() == [0, 0, 100, 100]


def test_unique_by_row():
    values, counts = T.unique_by_row(np.array([3, 1, 3, 2, 2], np.uint64), np.array([3, 0, 2]))
    assert values.tolist() == [1, 3, 2] and counts.tolist() == [2, 0, 1]
