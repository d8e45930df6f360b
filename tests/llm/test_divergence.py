import random
import re
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from logforge.llm import divergence, queries


def brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed


TEXTS = ["a b c d e f g h i j k", "a b c d e " * 4, "x\ny\nx\n\n \nx", "#|<> $% é ü 漢字", "the quick brown fox jumps over the quick brown fox jumps over it", None, "", " \t\n"]


def test_base_counts(spark):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string")
    for r in divergence.judge(df).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert got == brute(TEXTS[r["doc_id"]]), TEXTS[r["doc_id"]]
        assert not (r["base_failed"] and r["kept"])


@given(st.lists(st.text(alphabet="ab \n", max_size=60), min_size=1, max_size=3))
def test_brute_force_is_sane(texts):
    for t in texts:
        assert brute(t)[4] <= brute(t)[0]


def test_random_texts(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("abc  \n#") for _ in range(r.randint(0, 200))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for x in divergence.judge(df).collect():
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == brute(texts[x["doc_id"]])


def test_divergent_texts_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = divergence.judge(docs).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    good, bad = got.where("quality = 1"), got.where("quality = 0")
    assert good.where("kept").count() >= 0.99 * good.count()
    assert bad.where("not kept").count() >= 0.5 * bad.count()


def test_odd_rows(odd, none):
    assert divergence.judge(odd).count() == odd.count()
    assert divergence.judge(none).count() == 0


def test_words_of_other_languages_are_learned(spark):
    r = random.Random(3)
    usual = [f"u{k}" for k in range(40)]
    words = lambda: [r.choice(usual[: 1 + int(40 * r.random() ** 2)]) if r.random() < 0.6 else f"r{r.randint(0, 5000)}" for _ in range(150)]
    texts = [" ".join(words()) for _ in range(80)] + [" ".join(f"junk{r.randint(0, 9999)}" for _ in range(150))]
    rows = [(i, t, lang) for lang, base in (("xx", 0), (None, 1000)) for i, t in enumerate(texts, base)] + [(5000, None, "yy"), (5001, "", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    count = Counter(w for t in texts for w in t.split())
    top = sorted(count, key=lambda w: (-count[w], w))[:16]
    assert {x["of"]: x["learned"] for x in divergence.learned_words(df).collect()} == {"xx": top, None: top}
    got = {x["doc_id"]: x for x in divergence.judge(df).collect()}
    assert len(got) == len(rows)
    for base in (0, 1000):
        assert not got[base + 80]["kept"] and got[base + 80]["word_distance"] > 0.4 > max(got[base + k]["word_distance"] for k in range(80))


def test_equals_sql(spark, sf, tmp_path):
    """The registered query on documents of other and no language, against its SQL."""
    duckdb = pytest.importorskip("duckdb")
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "case when lang = 'es' then 'xx' when lang <> 'fr' then lang end as lang")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_divergence(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(queries.ORACLE_SQL["op1_divergence"])
    names = [d[0] for d in want.description]
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
