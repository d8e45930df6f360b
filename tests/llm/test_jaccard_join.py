import random
import re

from logforge.llm.jaccard_join import choose_bands, jaccard_join, keep_one


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    links = {i: {j for j in sets if j != i and sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])} for i in sets}
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        copy = min([i] + [j for j in links[i] if sets[j] == sets[i]])
        others = {frozenset(sets[j]) for j in links[i]} - {frozenset(sets[i])}
        out[i] = (min(seen), copy, len(links[i]), len(others))
    return out


def family(r, n, size, edits):
    words = [f"w{r.randint(0, 5000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        mine = list(words)
        for _ in range(r.randint(0, edits)):
            mine[r.randrange(size)] = f"e{r.randint(0, 10**6)}"
        out.append(" ".join(mine))
    return out


def test_bands_reach_recall():
    for s in (0.5, 0.8, 0.9):
        b, rows = choose_bands(s, 0.9999)
        assert 1 - (1 - s**rows) ** b >= 0.9999
    assert choose_bands(0.8, 0.9999) == (18, 4)


def test_equals_brute_force(spark):
    r = random.Random(5)
    texts = [t for k in range(12) for t in family(r, r.choice([1, 2, 3, 40]), r.choice([30, 200]), 4)]
    texts += ["", None, "a b", "a  b", "a b c", texts[0], texts[0] + "\n", texts[3]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (256, 8):
        got = {x["doc_id"]: (x["class_id"], x["copy_id"], x["n_links"], x["n_text_links"]) for x in jaccard_join(df, block_rows=block).collect()}
        assert got == brute(rows)


def test_odd_rows(odd, none):
    got = jaccard_join(odd).collect()
    assert len(got) == odd.count()
    assert {x["class_id"] for x in got if x["doc_id"] in (1, 2, 3)} == {1, 2, 3}
    assert [x["n_links"] for x in got if x["doc_id"] == 4] == [1, 1]
    assert jaccard_join(none).collect() == []


def test_keep_one(spark, odd, none):
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((x["doc_id"] or 0) for x in kept.collect())
    assert ids == [0, 1, 2, 3, 4, 7, 8, 9]
    assert keep_one(none).count() == 0
    rows = [(5, "a b c d e f"), (2, "a b c d e f"), (9, "other words here now yes"), (3, None), (4, None)]
    assert sorted(x["doc_id"] for x in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [2, 3, 4, 9]


def test_shared_and_missing_ids(spark):
    r = random.Random(8)
    a, b, c = ([f"{k}{r.randint(0, 9999)}" for _ in range(60)] for k in "xyz")
    a, b, c = " ".join(a), " ".join(b), " ".join(c)
    rows = [(5, a), (5, b), (7, b + " one"), (None, c), (None, c), (None, c + " one"), (8, a + " two"), (8, a + " two"), (None, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links = sorted((x["doc_id"] or 0, x["class_id"] or 0, x["n_links"], x["n_text_links"]) for x in jaccard_join(df).collect())
    assert links == sorted([(5, 5, 2, 1), (8, 5, 2, 1), (8, 5, 2, 1), (5, 5, 2, 1), (7, 5, 2, 1), (0, 5, 2, 1), (0, 0, 2, 1), (0, 0, 2, 1), (0, 0, 2, 1)])
    kept = sorted((x["doc_id"] or 0, x["text"][0]) for x in keep_one(df).collect())
    assert kept == [(0, "z"), (5, "x"), (5, "y")]
