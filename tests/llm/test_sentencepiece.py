import hashlib
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from logforge.llm.sentencepiece_bpe import Model, digests, encode_decode  # noqa: E402

PATH = P.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = Model(open(PATH, "rb").read())


def same(texts):
    ids, counts = MODEL.encode(texts)
    raw, sizes = MODEL.decode(ids, counts)
    a = b = 0
    for t, n, m in zip(texts, counts.tolist(), sizes.tolist()):
        want = LIBRARY.encode(t, add_bos=True, add_eos=True)
        assert ids[a : a + n].tolist() == want
        assert bytes(raw[b : b + m]).decode() == LIBRARY.decode(want)
        a, b = a + n, b + m


@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_any_text(texts):
    same(texts)


def test_runs_and_code():
    r = random.Random(2)
    alphabets = ["ab ", "the in of and sprintf\n\t", "0123.,-+() ", "{}[]();= \n\tint return", "éèüßñ ae", " "]
    texts = ["".join(r.choice(a) for _ in range(r.randint(1, 300))) for a in alphabets for _ in range(150)]
    same([*texts, " " * 1000 + "ab", "x" + " " * 137 + "\n" + " " * 77, "a" * 3000, "=" * 900, "<s></s><unk><0x0A>", "▁▁ ▁x", "\x00"])


def test_decode_of_any_ids():
    r = random.Random(3)
    for _ in range(300):
        ids = [r.choice([0, 1, 2, r.randint(3, 258), r.randint(259, 31999)]) for _ in range(r.randint(1, 8))]
        assert MODEL.decode_text(ids) == LIBRARY.decode(ids)


def test_query_columns(odd, none):
    got = digests(encode_decode(odd, PATH)).collect()
    for row, source in zip(sorted(got, key=lambda x: (x["doc_id"] or 0, x["n_tokens"])), sorted(odd.collect(), key=lambda x: (x["doc_id"] or 0, len(x["text"] or "")))):
        ids = LIBRARY.encode(source["text"] or "", add_bos=True, add_eos=True)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    assert encode_decode(none, PATH).count() == 0
