import math

import numpy as np
import pyarrow as pa

from logforge.llm import langid, toxicity


def test_language_on_held_out(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count() > 100
    mixed = docs.select("doc_id", "text", "lang").unionByName(odd.select("doc_id", "text", "lang").where("doc_id < 4"))
    assert langid.identify(mixed).where("lang_pred = 'und' and score = 0").count() >= 3
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert langid.identify(none).count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}


def test_filters_name_every_language():
    sets = [np.arange(0, 500, dtype=np.uint64), np.arange(250, 900, dtype=np.uint64)]
    f = langid.Filters.build(["a", "b"], sets, 0, bits=14)
    masks = f.languages_of(np.arange(0, 900, dtype=np.uint64))
    assert all(masks[i] & 1 for i in range(500)) and all(masks[i] & 2 for i in range(250, 900))
    other = f.languages_of(np.arange(10**6, 10**6 + 50_000, dtype=np.uint64))
    for k in range(2):
        assert abs(((other >> np.uint8(k)) & 1).mean() - f.rates[k]) < 0.02


def test_more_languages_than_one_word_of_bits(spark):
    rng = np.random.default_rng(3)
    syllables = [a + b for a in "bcdfghjklmnprst" for b in "aeiou"]
    own = [["".join(rng.choice(syllables, 4)) for _ in range(30)] for _ in range(130)]
    rows = [(i, " ".join(rng.choice(own[i % 130], 20)), f"l{i % 130:03}") for i in range(130 * 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most_texts in (4000, 11):  # 11: some languages have more texts, some fewer
        got = langid.identify(docs, most_texts=most_texts).join(docs.select("doc_id", "lang"), "doc_id")
        assert got.where("lang = lang_pred").count() >= 0.99 * len(rows)
        assert got.where("held_out and lang = lang_pred").select("lang").distinct().count() == got.where("held_out").select("lang").distinct().count() > 100


def test_grams_stay_inside_texts():
    raw = np.frombuffer(b"abcdeFGHIJ\xc3\x89xyz", np.uint8)
    keys, counts = langid.grams(raw, np.array([0, 5, 10, 15]))
    assert counts.tolist() == [1, 1, 1]
    assert int(keys[1]).to_bytes(5, "big") == b"fghij" and int(keys[2]).to_bytes(5, "big") == "éxyz".encode()


def test_short_texts_are_decided():
    texts = {"de": "und der, mit und ein", "en": "the of, and the a", "es": "los y, con los el", "fr": "une et, des une le"}
    sets = [np.unique(langid.known_grams(*langid.padded(*langid.textbuf.buffer(pa.array([t]))))[0]) for t in texts.values()]
    f = langid.Filters.build(list(texts), sets, 0)
    names, score = f.predict(pa.array(["und", "the", "los", "une", "", "y", "le", "--", "a", None, "The", "el"]))
    assert names == ["de", "en", "es", "fr", "und", "es", "fr", "und", "en", "und", "en", "es"]
    assert [i for i, x in enumerate(score) if not x] == [4, 7, 9]
    raw, at = langid.padded(np.frombuffer(b"abc", np.uint8), np.array([0, 1, 1, 3]))
    assert raw.tobytes() == b"  a  " + b"    " + b"  bc  " and at.tolist() == [0, 5, 9, 15]


def words(*names):
    column = pa.array([" ".join(names)])
    return toxicity.word_set(column)[0]


def test_non_negative_risk_learns_the_positive_words():
    rng = np.random.default_rng(0)
    bad, common = 0, list(range(1, 30))
    positive = [np.array(sorted({bad, *rng.choice(common, 8)})) for _ in range(200)]
    unlabelled = [np.array(sorted({*rng.choice(common, 8)} | ({bad} if i % 10 == 0 else set()))) for i in range(800)]
    weights, bias = toxicity.fit(positive, unlabelled, 30, 0.1)
    assert weights[bad] + bias > 0 > bias and np.abs(weights[1:]).max() < weights[bad]


def test_toxicity_on_held_out(spark, odd, none):
    rows, labels = [], []
    rng = np.random.default_rng(1)
    for i in range(1500):
        toxic = i % 8 == 0
        text = [f"word{k}" for k in rng.integers(0, 300, 40)]
        if toxic:
            text[int(rng.integers(0, 40))] = ["Vile,", "vile", "nasty!"][i % 3]
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, known).join(known, "doc_id").where("held_out")
    assert got.where("toxic = predicted").count() >= 0.98 * got.count() > 100
    assert got.where("toxic = 1 and predicted = 0").count() <= 2
    sharded = toxicity.train(docs, known, shard_texts=300)
    assert sharded.words.tolist() == toxicity.train(docs, known).words.tolist() and (sharded.weights > 0).all()
    kept = toxicity.reject(docs, known)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    for labelled in (known, known.where("doc_id < 0")):
        scored = toxicity.toxicity(odd, labelled).collect()
        assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.toxicity(none, known).count() == 0


def plain_fit(positive, unlabelled, width, prior, rounds, rate=0.1, l2=1e-6):
    """The same descent with loops over single texts."""
    theta = [0.0] * width + [math.log(0.5 * prior / (1 - 0.5 * prior))]
    m, v = [0.0] * (width + 1), [0.0] * (width + 1)
    for t in range(1, rounds + 1):
        score = lambda s: 1 / (1 + math.exp(-(sum(theta[k] for k in s) + theta[-1])))
        loss = lambda s: -math.log(1 - score(s))
        inner = sum(map(loss, unlabelled)) / len(unlabelled) - prior * sum(map(loss, positive)) / len(positive)
        g = [l2 * w for w in theta[:-1]] + [0.0]
        for sets, share, is_positive in ((positive, prior / len(positive), True), (unlabelled, 1 / len(unlabelled), False)):
            for s in sets:
                p = score(s)
                if inner >= 0:  # of pi R_p+ + R_u- - pi R_p-
                    d = share * ((p - 1) - p) if is_positive else share * p
                else:  # ascent of the inner term alone
                    d = share * p if is_positive else -share * p
                for k in [*s, width]:
                    g[k] += d
        for k in range(width + 1):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * v[k] + 0.01 * g[k] ** 2
            theta[k] -= rate * (m[k] / (1 - 0.9**t)) / (math.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
    return theta


def test_risk_equals_plain_loops():
    rng = np.random.default_rng(4)
    positive = [sorted({0, *rng.choice(6, 2).tolist()}) for _ in range(12)]
    unlabelled = [sorted(set(rng.choice(range(1, 6), 2).tolist()) | ({0} if i % 6 == 0 else set())) for i in range(40)]
    for prior in (0.1, 0.6):
        weights, bias = toxicity.fit([np.array(s) for s in positive], [np.array(s) for s in unlabelled], 6, prior, rounds=60)
        assert np.allclose([*weights, bias], plain_fit(positive, unlabelled, 6, prior, 60), atol=1e-6)
    twice = toxicity.fit([np.array(s) for s in positive], [np.array(s) for s in unlabelled], 6, 0.1, np.full(40, 2.0), rounds=60)
    assert np.allclose(twice[0], toxicity.fit([np.array(s) for s in positive], [np.array(s) for s in unlabelled], 6, 0.1, rounds=60)[0])


def test_filters_decide_as_exact_sets_do(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").toPandas()
    known = docs[docs.doc_id % 3 > 0]
    grams_of = lambda texts: langid.grams(*langid.padded(*langid.textbuf.buffer(pa.array(list(texts), pa.string()))))
    names = sorted(known.lang.dropna().unique())
    sets = [np.unique(grams_of(known[known.lang == n].text)[0]) for n in names]
    exact = [set(s.tolist()) for s in sets]
    f = langid.Filters.build(names, sets, 0)
    texts = [" ".join(t.split()[k : k + 6]) for t in docs[docs.doc_id % 3 == 0].text.dropna() for k in (0, 20) if any(c.isalpha() for c in t)]
    got, _ = f.predict(pa.array(texts))
    sure = same = 0
    for text, name in zip(texts, got, strict=True):
        mine = grams_of([text])[0].tolist()
        hits = sorted(((sum(g in s for g in mine), n) for n, s in zip(names, exact, strict=True)), reverse=True)
        if mine and hits[0][0] - hits[1][0] >= 2:  # false positives may turn closer calls
            sure, same = sure + 1, same + (hits[0][1] == name)
    assert sure > 100 and same >= 0.995 * sure

