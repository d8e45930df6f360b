import datetime as dt
import random

from logforge.llm import url_lists

DAY = dt.date(2024, 1, 1)


def brute(captures, entries):
    rules = {}
    for domain, prefix, listed, day in entries:
        if domain and day and listed is not None:
            rules.setdefault((domain.lower(), prefix or ""), {}).setdefault(day, []).append(listed)
    out = []
    for i, url, t in captures:
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = rest.split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower()
        path = "/" + rest.split("/", 1)[1].split("?")[0].split("#")[0] if "/" in rest else ""
        hits = []
        for (domain, prefix), changes in rules.items():
            past = [d for d in sorted(changes) if t and d <= t]
            if past and all(changes[past[-1]]) and (host == domain or host.endswith("." + domain)) and path.startswith(prefix):
                hits.append((-len(domain), -len(prefix), domain, prefix))
        best = min(hits) if hits else None
        out.append((i, bool(best), best[2] + best[3] if best else None))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    r = random.Random(6)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "A.com", "aa.com"]
    entries = [(r.choice(["a.com", "x.a.com", "b.org", "B.org", "com"]), r.choice(["", "/p", "/p/q", None]), r.random() < 0.6, DAY + dt.timedelta(r.randint(0, 20))) for _ in range(60)]
    entries += [(None, "", True, DAY), ("a.com", "", True, None), ("", "", True, DAY), ("b.org", "", None, DAY)]
    captures = [(i, f"http://{r.choice(['', 'u:p@'])}{r.choice(hosts)}{r.choice(['', ':80'])}{r.choice(['', '/', '/p', '/p/q?x#y', '/z'])}", DAY + dt.timedelta(r.randint(-2, 24))) for i in range(400)]
    captures += [(900, None, DAY), (901, "no url", DAY), (902, "http://a.com/p", None), (3, "http://a.com/", DAY), (3, "http://a.com/", DAY)]
    c = spark.createDataFrame([(*x, "z") for x in captures], "page_id long, url string, fetched date, rule string")
    e = spark.createDataFrame(entries, "domain string, prefix string, listed boolean, day date")
    for rows in (200_000, 0):
        url_lists.BROADCAST_BYTES, before = rows, url_lists.BROADCAST_BYTES
        try:
            got = sorted(((x["page_id"], x["blocked"], x["rule"]) for x in url_lists.judge(c, e).collect()), key=repr)
        finally:
            url_lists.BROADCAST_BYTES = before
        assert got == brute(captures, entries)
    assert url_lists.judge(c.where("page_id < 0"), e).count() == 0
    assert url_lists.judge(c, e.where("domain = 'none'")).where("blocked").count() == 0
