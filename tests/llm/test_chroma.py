import numpy as np

from logforge.llm import chroma


def song(seed, notes=200):
    r = np.random.default_rng(seed)
    t = np.arange(128) / chroma.RATE
    return np.concatenate([0.5 * np.sin(2 * np.pi * h * t) for h in 110 * 2 ** (r.integers(0, 36, notes) / 12)])


def test_integral_image_sums_rectangles():
    frames = np.random.default_rng(0).random((2, 40, 12))
    got = chroma.codes(frames)
    assert got.shape == (2, 25)
    for k, (t, w, c, h, kind) in enumerate(chroma.FILTERS):
        t2, c2 = (t + w if t + 2 * w <= chroma.WIDTH else t - w, c) if kind else (t, c + h if c + 2 * h <= 12 else c - h)
        for row in range(2):
            for i in range(25):
                a, b = frames[row, i + t : i + t + w, c : c + h].sum(), frames[row, i + t2 : i + t2 + w, c2 : c2 + h].sum()
                level = int(np.searchsorted(chroma.LEVELS, np.log((a + 0.1) / (b + 0.1))))
                assert (int(got[row, i]) >> (2 * (15 - k))) & 3 == chroma.GRAY[level]


def test_clip_aligns_at_its_offset():
    a, b = song(1), song(2)
    clip = a[6400:19200] + np.random.default_rng(3).normal(0, 0.01, 12800)
    f = chroma.fingerprint_media([chroma.wav(x) for x in (a, b, clip, 0.3 * a)])
    got = {o: (offset, error) for _, o, offset, _, _, error in chroma.match_block([(2, f[2])], list(enumerate(f)))}
    assert set(got) == {0, 2, 3} and got[0][0] == got[3][0] == 50 and got[2] == (0, 0.0) and got[0][1] < 0.05


def votes(x, y):
    """Offsets by the number of equal halves of codes, one by one."""
    out = {}
    for i, a in enumerate(x.tolist()):
        for j, b in enumerate(y.tolist()):
            n = (a & 0xFFFF == b & 0xFFFF) + (a >> 16 == b >> 16)
            if n and a != chroma.SILENT and b != chroma.SILENT:
                out[j - i] = out.get(j - i, 0) + n
    return out


def few_codes(r, kinds, size):
    """Random codes of a few kinds, some of which share a half."""
    some = r.integers(0, 1 << 32, kinds).astype(np.uint32)
    some[::3] = some[::3] & np.uint32(0xFFFF) | some[0] & np.uint32(0xFFFF0000)
    return r.choice(some, size)


def test_offsets_equal_brute_force():
    r = np.random.default_rng(5)
    some = np.random.default_rng(50)
    sets = [few_codes(np.random.default_rng(50), 6, 40)[: r.integers(0, 40)] for _ in range(4)] + [few_codes(some, 6, r.integers(0, 40)) for _ in range(4)]
    got = {(q, o): e for q, o, _, _, _, e in chroma.match_block(list(enumerate(sets)), list(enumerate(sets)), least_hits=1, most_error=1.0, least_overlap=1, tries=1000)}
    for q, x in enumerate(sets):
        for o, y in enumerate(sets):
            shifts = set(votes(x, y))
            want = min((chroma.align(x, y, s)[1] for s in shifts), default=None)
            assert got.get((q, o)) == want


def test_defaults_equal_brute_force():
    r = np.random.default_rng(6)
    x, y = r.integers(1, 1 << 32, (2, 300)).astype(np.uint32)
    y[200:240] = x[20:60]
    x[100:200], y[20:170] = 7, 7
    sets = [x, y, *(r.integers(0, 6, r.integers(0, 60)).astype(np.uint32) for _ in range(8))]
    got = {(q, o): (f, h, n, e) for q, o, f, h, n, e in chroma.match_block(list(enumerate(sets)), list(enumerate(sets)))}
    for q, x in enumerate(sets):
        for o, y in enumerate(sets):
            tests = [(e, f, h, n) for f, h in votes(x, y).items() if h >= 3 for n, e in [chroma.align(x, y, f)] if n >= 16 and e <= 0.2]
            want = min(tests, default=None)
            assert got.get((q, o)) == (want and (want[1], want[2], want[3], want[0]))


def test_match_behind_a_constant_run():
    r = np.random.default_rng(7)
    x, y = r.integers(0, 1 << 32, (2, 340)).astype(np.uint32)
    y[300:] = x[:40]  # overlap of the true offset: 40 equal codes
    x[100:200], y[20:170] = 7, 7
    assert [m[2:] for m in chroma.match_block([(0, x)], [(1, y)])] == [(300, 80, 40, 0.0)]


def test_formats():
    a = song(4)
    stereo = np.repeat(np.round(a * 32767).astype("<i2"), 2).tobytes()
    head = bytearray(chroma.wav(np.zeros(len(a) * 2)))
    head[22:24] = (2).to_bytes(2, "little")
    assert np.allclose(chroma.samples_of(bytes(head[:44]) + stereo), chroma.samples_of(chroma.wav(a)))
    assert len(chroma.samples_of(chroma.wav(a, 8000))) == len(a) // 2
    for bad in (None, b"", b"x" * 100, chroma.wav(a)[:50]):
        assert len(chroma.fingerprint_media([bad])[0]) == 0


def test_search(spark):
    a = [chroma.wav(song(s, 80)) for s in range(5)]
    rows = [(0, a[0]), (1, a[1]), (5, a[0]), (100, a[2]), (7, chroma.wav(song(2, 80)[1280:])), (8, None), (200, b"bad"), (None, a[3]), (300, a[0])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, audio binary, class_id string")
    found = chroma.search(chroma.fingerprint(df)).collect()
    got = {r["id"]: r for r in found}
    assert len(got) == len(rows) and len(found) == len(rows) + 1
    assert [got[i]["class_id"] for i in (0, 5, 300)] == [0, 0, 0] and got[8]["class_id"] == 8 and got[8]["n_codes"] == 0
    assert got[0]["match_class"] == 0 and got[300]["match_class"] is None and got[300]["n_matches"] == 1
    assert {r["match_class"]: r["offset"] for r in found if r["id"] == 100} == {100: 0, 7: -10}
    assert got[1]["n_matches"] is None and got[200]["n_matches"] == 0
    assert chroma.search(chroma.fingerprint(df.where("id < 0"))).count() == 0


def test_votes_in_parts_agree(monkeypatch):
    r = np.random.default_rng(9)
    sets = list(enumerate(r.integers(0, 9, r.integers(0, 90)).astype(np.uint32) for _ in range(12)))
    whole = sorted(chroma.match_block(sets, sets))
    monkeypatch.setattr(chroma, "VOTES", 40)
    assert sorted(chroma.match_block(sets, sets)) == whole


def test_silence_tells_nothing():
    quiet = np.zeros(60 * chroma.RATE)
    (codes,) = chroma.fingerprint_media([chroma.wav(quiet)])
    assert len(codes) > 1800 and (codes == chroma.SILENT).all()
    begin = song(1)
    mixed = chroma.fingerprint_media([chroma.wav(np.concatenate([begin, quiet])), chroma.wav(np.concatenate([quiet, begin]))])
    found = {(q, o): f for q, o, f, *_ in chroma.match_block([(i, c) for i, c in enumerate([codes, *mixed] * 700)][: chroma.QUERY_BLOCK], [(0, codes), (2, mixed[1])])}
    assert all(o == 2 and q % 3 for q, o in found) and (2, 2) in found


def test_recall_of_noisy_clips():
    r = np.random.default_rng(10)
    songs = [song(s, 120) for s in range(12)]
    clips = []
    for k in range(60):
        a = songs[k % 12]
        start = int(r.integers(0, 80)) * 64
        clips.append((0.2 + 0.8 * r.random()) * a[start : start + 5120] + r.normal(0, 0.004 * (1 + k % 3), 5120))
    f, g = (chroma.fingerprint_media([chroma.wav(x) for x in side]) for side in (songs, clips))
    brute = {(q, o) for q, y in enumerate(g) for o, x in enumerate(f) if any(n >= 16 and e <= 0.2 for d in range(-len(y), len(x)) for n, e in [chroma.align(y, x, d)])}
    found = {m[:2] for m in chroma.match_block(list(enumerate(g)), list(enumerate(f)))}
    assert found <= brute and len(found) >= 0.9 * len(brute) > 40


def test_sonified_vectors(spark):
    df = spark.createDataFrame([(1, [0.1] * 64), (2, None), (3, []), (4, [float("nan"), None])], "vec_id long, embedding array<float>")
    got = {r["id"]: len(r["audio"]) for r in chroma.sonify(df).collect()}
    assert got[1] == 44 + 64 * 256 and got[2] == got[3] == 44


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chroma, "QUERY_BLOCK", 3)
    r = np.random.default_rng(11)
    songs = [r.integers(0, 1 << 32, 120).astype(np.uint32) for _ in range(6)]
    sets = {}
    for k in range(40):
        a = int(r.integers(0, 80))
        part = songs[k % 6][a : a + 40].copy()
        part[r.integers(0, len(part), 6)] ^= np.uint32(1) << r.integers(0, 32, 6).astype(np.uint32)
        sets[25 * k + 1 if k % 2 else 100 * k] = part
    sets |= {5000: sets[0], 5001: sets[0], 900: np.zeros(0, np.uint32)}
    df = spark.createDataFrame([(i, c.astype("<u4").tobytes()) for i, c in sets.items()], "id long, codes binary").repartition(4)
    got = {(x["id"], x["match_class"]): (x["offset"], x["hits"], x["overlap"], round(x["bit_error"], 9)) for x in chroma.search(df).collect() if x["match_class"] is not None}
    reps = {i: min(j for j in sets if np.array_equal(sets[j], c)) for i, c in sets.items() if len(c)}
    want = {}
    for q in {reps[i] for i in reps if i % 100 == 0}:
        for o in set(reps.values()):
            tests = [(e, f, h, n) for f, h in votes(sets[q], sets[o]).items() if h >= 3 for n, e in [chroma.align(sets[q], sets[o], f)] if n >= 16 and e <= 0.2]
            if tests:
                e, f, h, n = min(tests)
                want[q, o] = (f, h, n, round(e, 9))
    assert got == want and len(want) > len(set(reps.values())) // 2
