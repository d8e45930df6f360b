import hashlib
import random
import re
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logforge.llm import pii


def luhn(d):
    s = [int(c) for c in d][::-1]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def brute(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[\x20-]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@given(st.text(alphabet="a.@%+-0123456789 ()é", max_size=60))
@settings(max_examples=600, deadline=None)
def test_base_rules(t):
    assert pii.base_spans(t) == brute(t)
    assert next(iter(pii.spans_of(pa.array([t]))))[0] == brute(t)


@given(st.lists(st.sampled_from([*"aé5.+@ -(", "FÜNF ", "fünf", "ÄT ", " At ", "[at]", "(ÄT)", " dot ", "{Punkt}", "one ", "SİX ", "ſeven ", "\u212a", "４", "о", "Plus ", "más ", "MÁS ", "zéro ", "12 dot 3", "\u200b"]), max_size=30).map("".join))
@settings(max_examples=600, deadline=None)
def test_prefilter_hides_nothing(t):
    base = pii.base_spans(t)
    assert list(pii.spans_of(pa.array(["x", t, None])))[1] == (base, pii.added_spans(t, base))


@pytest.mark.parametrize("part", ["5", " ", "1.", "1.1.1.1", "(", "( ", " (at) ", "one ", "one.", "@", "a@", "+1", "+1 ", "plus ", "at ", " dot ", "５", "\u200b"])
def test_long_texts_take_linear_time(part):
    text = f"a{part * (300_000 // len(part))} five 5 [at] x"
    start = time.perf_counter()
    list(pii.spans_of(pa.array([text])))
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("write john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("john dot doe at example dot com please", "email", "john dot doe at example dot com"),
        ("to jоhn@example.com.", "email", "jоhn@example.com"),
        ("user＠ｅxample．com", "email", "user＠ｅxample．com"),
        ("max (at) firma (punkt) de", "email", "max (at) firma (punkt) de"),
        ("x​y@ex​ample.com", "email", "x​y@ex​ample.com"),
        ("call plus one four one five five five five two six seven one now", "phone", "plus one four one five five five five two six seven one"),
        ("card four one one one one one one one one one one one one one one one ok", "card", "four one one one one one one one one one one one one one one one"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("ip 192 dot 168 dot 1 dot 20", "ip", "192 dot 168 dot 1 dot 20"),
        ("ip 10[.]0[.]0[.]1", "ip", "10[.]0[.]0[.]1"),
    ],
)
def test_disguises_map_back(text, kind, source):
    base = pii.base_spans(text)
    added = pii.added_spans(text, base)
    assert (pii.KINDS.index(kind), source) in [(k, text[a:b]) for a, k, b in added]
    assert next(iter(pii.spans_of(pa.array([text])))) == (base, added)


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("call +1 415 five five 5 2671 now", "phone", "+1 415 five five 5 2671"),
        ("call +1 415 five55 2671 now", "phone", "+1 415 five55 2671"),
        ("call +one 415-555-2671 now", "phone", "+one 415-555-2671"),
        ("call plus 1 (415) 555 267 one now", "phone", "plus 1 (415) 555 267 one"),
        ("call +49 30 FÜNF 5 5 2 6 7 1 now", "phone", "+49 30 FÜNF 5 5 2 6 7 1"),
        ("card 4111 1111 1111 one one 11 ok", "card", "4111 1111 1111 one one 11"),
        ("card 4111-1111-1111-111one ok", "card", "4111-1111-1111-111one"),
        ("ip one nine two dot one six eight dot one dot two zero ok", "ip", "one nine two dot one six eight dot one dot two zero"),
        ("ip 192.one.2.3 ok", "ip", "192.one.2.3"),
        ("ip one.two.three.four ok", "ip", "one.two.three.four"),
        ("ip 192 dot 16 eight dot one dot 20 ok", "ip", "192 dot 16 eight dot one dot 20"),
    ],
)
def test_partly_spelled_numbers(text, kind, source):
    added = pii.added_spans(text, pii.base_spans(text))
    assert (pii.KINDS.index(kind), source) in [(k, text[a:b]) for a, k, b in added]
    texts = ["", "no cue", text, "one", "5"]
    assert list(pii.spans_of(pa.array(texts)))[2] == (pii.base_spans(text), added)
    assert source not in pii.redact_text(text, pii.base_spans(text) + added)


def test_words_beside_numbers_hide_none():
    for text in ("４１１１ １１１１ １１１１ １１１１ one", "four. one. one. one. one. one. one. one. one. one. one. one. one. one. one. one"):
        assert 2 in [k for _, k, _ in pii.added_spans(text, [])]
    for text in ("sıx 5 and SİX 5", "take one 5 or two", "page one ... 7", "plus 5 or un 6", "+1 two 3", "999.one.2.3", "", "4111 1111 1111 one one 12"):
        assert next(iter(pii.spans_of(pa.array([text])))) == ([], [])


@pytest.mark.parametrize("text", ["meet at example.com at noon", "one two three go", "un deux trois soleil", "a dot b", "at home (at) work", "zero one two three four", "Straße été niño at last"])
def test_clean_texts_stay(text):
    assert next(iter(pii.spans_of(pa.array([text])))) == ([], [])


def test_query_and_redaction(spark, odd, none):
    rows = [(1, "+1 (456) 555-2186 or a@b.c and é 4111111111111111"), (2, None), (3, "plain")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digests(pii.find(df)).collect()}
    want = "phone:0:17,email:21:26,card:33:49"
    assert got[1]["spans"] == want and got[1]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert (got[1]["n_email"], got[1]["n_ip"], got[1]["n_card"], got[1]["n_phone"], got[1]["n_added"]) == (1, 0, 1, 1, 0)
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    masked = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert masked == {1: "[PHONE] or [EMAIL] and é [CARD]", 2: None, 3: "plain"}
    assert pii.find(odd).count() == odd.count() and pii.redact(odd).columns == odd.columns
    assert pii.find(none).count() == 0 and pii.redact(none).count() == 0
    changed = spark.createDataFrame([(1, "a@b.cd", 6)], "doc_id long, text string, n_chars long")
    assert pii.redact(changed).first()["n_chars"] == 7


def test_overlapping_spans_mask_once():
    assert pii.redact_text("jоhn@example.com x", [(2, 0, 16), (0, 0, 16)]) == "[EMAIL] x"


WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]


def disguised(r):
    """(text, kind, start, end) of a random identifier, written in a random disguise."""
    spelled = lambda digits, share: " ".join(WORDS[int(d)] if r.random() < share else d for d in digits)
    kind = r.choice(pii.KINDS)
    if kind == "email":
        dot = r.choice([" [dot] ", " (dot) ", " dot ", "[.]", " {punkt} ", " (PUNTO) "])
        at = r.choice([" [at] ", "(at)", "[@]", " <arroba> ", *([" at ", " AT "] if dot != "[.]" else [])])
        said = f"{r.choice(['john', 'x', 'a.b-c', 'm_9'])}{at}{r.choice(['firm', 'my-site', 'a1'])}{dot}{r.choice(['com', 'de', 'co.uk'])}"
    elif kind == "ip":
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        k = r.randrange(4)
        if r.random() < 0.5:
            parts[k] = WORDS[r.randint(1, 9)]
        dots = [r.choice([" dot ", "[.]", ".", " (dot) "]) for _ in range(3)]
        if all(p.isdigit() for p in parts) and set(dots) == {"."}:
            dots[r.randrange(3)] = " dot "
        said = "".join(x for pair in zip(parts, [*dots, ""], strict=True) for x in pair)
    elif kind == "card":
        digits = "4" + "".join(str(r.randint(0, 9)) for _ in range(14))
        digits = next(digits + c for c in "0123456789" if luhn(digits + c))
        at = r.randint(1, 12)
        said = f"{digits[:at]} {WORDS[int(digits[at])]} {spelled(digits[at + 1 : at + 3], 0.5)} {digits[at + 3 :]}"
    else:
        digits = "".join(str(r.randint(0, 9)) for _ in range(r.randint(9, 13)))
        said = f"{r.choice(['+', 'plus ', '+ '.strip()])}{r.randint(1, 9)} {spelled(digits, r.choice([0.2, 0.6, 1.0]))} {WORDS[r.randint(0, 9)]}"
    glyphs = str.maketrans({"o": "о", "0": "０", "a": "а", "@": "＠"})
    if kind == "email" and r.random() < 0.3 and "(at" not in said and "[at" not in said and "arroba" not in said and "dot" not in said and "punkt" not in said:
        said = said.translate(glyphs)
    lead = r.choice(["", "so: ", "é, ", "Naïve words; "])
    return f"{lead}{said}{r.choice(['', ', ok', ' | 漢字', '; end'])}", kind, len(lead), len(lead) + len(said)


def test_random_disguises_map_back():
    r = random.Random(12)
    for _ in range(1500):
        text, kind, start, end = disguised(r)
        added = pii.added_spans(text, pii.base_spans(text))
        assert (start, pii.KINDS.index(kind), end) in added, (text, kind, [(text[a:b], k) for a, k, b in added])
        masked = pii.redact_text(text, pii.base_spans(text) + added)
        assert text[start:end] not in masked
