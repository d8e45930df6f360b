import re

import pytest

from logforge.llm import mixing


def brute_targets(sizes):
    """Repeated resharing, as the contract words it."""
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        share = (total - sum(target.values())) / sum(weight[n] for n in open_)
        over = {n for n in open_ if share * weight[n] > 2 * sizes[n]}
        if not over:
            target |= {n: share * weight[n] for n in open_}
            break
        target |= {n: 2.0 * sizes[n] for n in over}
        open_ -= over
    return target


@pytest.fixture()
def docs(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), None, [None, "a", "b", "é", "c", "a", "a"][i % 7]) for i in range(900)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_contract(docs):
    got = mixing.mix(docs).collect()
    source = {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in docs.collect()}
    sizes = {}
    for s, n in source.values():
        sizes[s] = sizes.get(s, 0) + n
    want, taken = brute_targets(sizes), {}
    for r in got:
        s, n = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, sizes[s]) and r["target"] == pytest.approx(want[s]) and r["taken"] == n * r["copies"] <= 2 * n
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 40 for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_small_buckets_agree(docs, monkeypatch):
    whole = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BUCKET_DOCUMENTS", 10)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == whole
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == whole


def test_better_documents_come_sooner(spark):
    rows = [(i, "w " * 10, s, q) for s, q0 in (("a", 0), ("b", 1)) for i, q in ((i + 1000 * q0, 5.0 if i % 2 else 0.2) for i in range(500))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, q double"), quality="q", share=1.2)
    total = {r["good"]: r["n"] for r in got.selectExpr("doc_id % 2 = 1 as good", "copies").groupBy("good").agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "n").collect()}
    assert total[True] > total[False]


def test_mixed_rows_follow_the_plan(docs, odd, none):
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {i: n for i, n in copies.items() if n}
    assert mixing.mix(odd).count() == odd.count() and mixing.mixed(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_budget_ends_among_repeated_rows(spark):
    rows = [(i, "w " * 10, "a") for i in range(300)] + [(1000 + i, "w " * 10, "b") for i in range(300)] + [(5000, "w " * 10, "c")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df).collect()
    assert len(got) == 900
    for low, high in ((0, 1000), (1000, 5000), (5000, 6000)):
        mine = [r for r in got if low <= r["doc_id"] < high]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 5 and max(r["taken"] for r in mine) <= 20
    assert mixing.mixed(df).where("source = 'c'").count() == sum(r["copies"] for r in got if r["doc_id"] == 5000)


@pytest.mark.parametrize("quality", ["1000.0", "1e-3 + doc_id % 7 * 100", "if(doc_id % 3 = 0, null, 'NaN')"])
def test_any_scale_of_weights(docs, monkeypatch, quality):
    monkeypatch.setattr(mixing, "BUCKET_DOCUMENTS", 10)
    weighed = docs.selectExpr("*", f"cast({quality} as double) as q")
    out = mixing.mix(weighed, quality="q").collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    taken, target = {}, {}
    for r in out:
        s = source[r["doc_id"]]
        taken[s], target[s] = taken.get(s, 0) + r["taken"], r["target"]
    assert all(abs(taken[s] - target[s]) <= 40 for s in taken)
    drawn, goal, number, _ = mixing.plan(weighed, quality="q")
    ends = mixing._planned(drawn, goal, number).where("bin = end_bin and bucket = end_bucket").groupBy("source").count().collect()
    assert max(r["count"] for r in ends) < 60
