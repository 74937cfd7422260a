"""Pruned similarity joins, clusters that keep decisions, boxes and places, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.operators import boxes, clustering, geocode, similarity
from heliograph.plans import vectors


def _clustered(rnd, groups, each, spread, size=16):
    middles = rnd.normal(size=(groups, size))
    x = (middles[:, None, :] / np.linalg.norm(middles, axis=1)[:, None, None] + rnd.normal(size=(groups, each, size)) * spread).reshape(-1, size)
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


def _cosines(rows):
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x @ x.T


def _components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_pruned_join_finds_all_and_compares_less(spark):
    rows = _clustered(np.random.default_rng(4), 40, 50, 0.02)
    df = spark.createDataFrame(rows, "id long, v array<double>")
    s = _cosines(rows)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(s >= 0.8, 1)))}
    got = clustering.similar_pairs(df, "id", "v", 0.8, block=50)
    assert {(r["a"], r["b"]) for r in got.collect()} == want
    directed = similarity.directed(df, "id", "v")
    assert similarity.compared(directed, 0.8, block=50) * 5 < len(rows) * (len(rows) - 1) / 2
    links = similarity.forest(directed, 0.8, block=50).collect()
    assert len(links) < len(want) / 5 and {(r["a"], r["b"]) for r in links} <= want
    found = {r["id"]: r["cluster"] for r in clustering.clusters(df, "id", "v", 0.8, block=50).collect()}
    assert [found[i] for i in range(len(rows))] == _components(len(rows), want)


def test_pruned_join_on_anything(spark):
    rnd = np.random.default_rng(9)
    rows = [(i, [float(c) for c in rnd.normal(size=4)], "ab"[i % 2]) for i in range(150)]
    rows += [(150 + i, rows[0][1], "a") for i in range(60)]  # copies
    rows += [(300, None, "a"), (301, [], "a"), (302, [0.0] * 4, "a"), (303, [1.0, None, 0.0, 0.0], "a"), (304, [float("nan")] * 4, "b"), (305, [1.0, 0.0], "a"), (306, [1.0, 0.1], None), (307, [1.0, 0.1], None)]
    df = spark.createDataFrame(rows, "id long, v array<double>, kind string")
    good = [r for r in rows if r[0] < 300]
    s = _cosines([r[:2] for r in good])
    links = {(i, j) for i, j in zip(*np.nonzero(np.triu(s >= 0.5, 1))) if good[i][2] == good[j][2]}
    got = clustering.similar_pairs(df, "id", "v", 0.5, within="kind", block=20).collect()
    assert {(r["a"], r["b"]) for r in got} == links | {(306, 307)} and len(got) == len(links) + 1
    found = {r["id"]: r["cluster"] for r in clustering.clusters(df, "id", "v", 0.5, within="kind", block=20).collect()}
    assert [found[i] for i in range(210)] == _components(210, links)
    assert {i: found[i] for i in range(301, 308)} == {301: 301, 302: 302, 303: 303, 304: 304, 305: 305, 306: 306, 307: 306} and 300 not in found


def test_a_vector_is_sent_a_fixed_number_of_times(spark, monkeypatch):
    monkeypatch.setattr(similarity, "GRID", 4)
    rows = _clustered(np.random.default_rng(3), 4, 150, 0.3)
    df = similarity.directed(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    sent = similarity.meetings(df, 0.1, block=20).selectExpr("sum(length(ids)) / 8 AS n").first()["n"]
    assert len(rows) <= sent <= 4 * len(rows)
    s = _cosines(rows)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(s >= 0.5, 1)))}
    assert {(r["a"], r["b"]) for r in similarity.pairs(df, 0.5, block=20).collect()} == want
    for most in (10, 10**6):
        monkeypatch.setattr(similarity, "MOST_EDGES", most)
        links = similarity.forest(df, 0.5, block=20).collect()
        assert {(r["a"], r["b"]) for r in links} <= want and _components(len(rows), [(r["a"], r["b"]) for r in links]) == _components(len(rows), want)
    assert _components(len(rows), [(r["u"], r["v"]) for r in similarity.linked(df, 0.5, block=20).collect()]) == _components(len(rows), want)


def test_spanning_forest_is_the_heaviest():
    rnd = np.random.default_rng(6)
    for _ in range(20):
        n = 25
        s = np.round(rnd.uniform(-1, 1, (n, n)), 1)  # many ties
        s = np.maximum(s, s.T)
        np.fill_diagonal(s, -9)
        edges = sorted((-s[i, j], i, j) for i in range(n) for j in range(i + 1, n) if s[i, j] >= 0.3)
        root, want = list(range(n)), []
        for w, i, j in edges:
            if root[i] != root[j]:
                want.append((i, j, -w))
                root = [root[i] if r == root[j] else r for r in root]
        assert sorted(similarity.spanning_forest(s, 0.3)) == sorted(want)


def _kept_apart(n, edges, pins):
    """Links in order, unless they would join two groups."""
    part, pin = list(range(n)), [pins.get(i) for i in range(n)]
    for g in set(pins.values()):
        members = [i for i in range(n) if pins.get(i) == g]
        for i in members:
            part[i] = members[0]
    for _, a, b in edges:
        pa, pb = part[a], part[b]
        if pa != pb and (pin[a] is None or pin[b] is None):
            to = pin[a] if pin[a] is not None else pin[b]
            for i in range(n):
                if part[i] in (pa, pb):
                    part[i], pin[i] = min(pa, pb), to
    return {i: (min(j for j in range(n) if part[j] == part[i]), pin[i]) for i in range(n)}


def test_decisions_survive_passes(spark):
    rows = _clustered(np.random.default_rng(8), 5, 30, 0.12)
    rows += [(150, rows[0][1]), (151, rows[0][1])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    s = np.round(_cosines(rows), similarity.DECIMALS)
    first = clustering.clusters(df, "id", "v", 0.7, block=40)
    groups = {r["id"]: r["cluster"] for r in first.collect()}
    pins = {i: 2 * groups[i] + i % 2 for i in range(150) if i % 3 == 0} | {150: 2 * groups[150]}
    table = spark.createDataFrame([*pins.items(), (None, 5), (7, None)], "id long, pin long")
    got = clustering.constrained_clusters(df, "id", "v", 0.7, table, block=40)
    edges = sorted((-s[i, j], i, j) for i in range(152) for j in range(i + 1, 152) if s[i, j] >= 0.7)
    want = _kept_apart(152, edges, pins)
    result = {r["id"]: (r["cluster"], r["pin"]) for r in got.collect()}
    assert result == want and len({c for c, _ in want.values()}) > len(set(groups.values()))
    again = clustering.constrained_clusters(df, "id", "v", 0.7, got.select("id", "pin"), block=40)
    assert {r["id"]: (r["cluster"], r["pin"]) for r in again.collect()} == result
    free = clustering.constrained_clusters(df, "id", "v", 0.7, table.where("false"), block=40)
    assert {r["id"]: r["cluster"] for r in free.collect()} == groups
    joined = clustering.constrained_clusters(df.where("id in (0, 31)"), "id", "v", 0.99, spark.createDataFrame([(0, 1), (31, 1), (99, 1)], "id long, pin long"))
    assert {r["id"]: (r["cluster"], r["pin"]) for r in joined.collect()} == {0: (0, 1), 31: (0, 1), 99: (0, 1)}


def test_copies_follow_the_first_of_equal_links(spark):
    rnd = np.random.default_rng(2)
    axes = np.linalg.qr(rnd.normal(size=(3, 3)))[0]
    rows = [(i, [float(c) * int(scale) for c in axes[axis]]) for i, (axis, scale) in enumerate(zip(rnd.integers(0, 3, 48), rnd.integers(1, 4, 48)))]
    pins = {int(i): k % 7 for k, i in enumerate(rnd.permutation(48)[:20])}
    df, table = spark.createDataFrame(rows, "id long, v array<double>"), spark.createDataFrame([*pins.items()], "id long, pin long")
    s = np.round(_cosines(rows), similarity.DECIMALS)
    want = _kept_apart(48, sorted((-s[i, j], i, j) for i in range(48) for j in range(i + 1, 48) if s[i, j] >= 0.7), pins)
    got = clustering.constrained_clusters(df, "id", "v", 0.7, table, block=5).collect()
    assert {r["id"]: (r["cluster"], r["pin"]) for r in got} == want


def test_two_passes_compare_once(spark, monkeypatch):
    compared, meetings = [], similarity.meetings
    monkeypatch.setattr(similarity, "meetings", lambda *a: compared.append(1) or meetings(*a))
    assert vectors.split_kept_clusters(spark, "/root/testdata/sf0.001").count() == 500 and len(compared) == 1


def test_blocks_of_one_square_meet_once(spark, monkeypatch):
    monkeypatch.setattr(similarity, "GRID", 3)
    rows = _clustered(np.random.default_rng(12), 4, 60, 0.3)
    df = similarity.directed(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    s = _cosines(rows)
    got = [(r["a"], r["b"]) for r in similarity.pairs(df, 0.3, block=20).collect()]
    assert sorted(got) == [(i, j) for i, j in zip(*(c.tolist() for c in np.nonzero(np.triu(s >= 0.3, 1))))]
    assert similarity.compared(df, -1.0, block=20) == len(rows) * (len(rows) - 1) // 2


@pytest.mark.parametrize("spread", [100, 0.3, 1e-12])  # few links, many, all equal
@pytest.mark.parametrize("most", [10, 300])
def test_links_that_join_nothing_new_are_not_held(spread, most):
    rnd = np.random.default_rng(5)
    x, ids = 1 + rnd.normal(size=(240, 4)) * spread, rnd.permutation(240)
    row = lambda k: {"ids": ids[k : k + 40].tobytes(), "single": False, "vs": x[k : k + 40].tobytes(), "cell": 0, "targets": [0]}
    parts, found, links = [similarity._Block(row(k)) for k in range(0, 240, 40)], similarity._Forest(most), {}
    for at, a in enumerate(parts):
        for b in parts[at:]:
            i, j, s = similarity._close(a, b, 0.3)
            found.add(a, b, i, j, s)
            links |= {(min(p), max(p)): w for *p, w in zip(a.ids[i].tolist(), b.ids[j].tolist(), np.round(s, similarity.DECIMALS).tolist())}
            assert found.held <= max(most, 2 * 239)
    root, want = list(range(240)), []
    for (i, j), w in sorted(links.items(), key=lambda e: (-e[1], e[0])):
        if root[i] != root[j]:
            want.append((i, j, w))
            root = [root[i] if r == root[j] else r for r in root]
    assert sorted(zip(*(c.tolist() for c in found.forest()))) == sorted(want)


# --- boxes


def _iou(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    shared = max(w, 0) * max(h, 0)
    return shared, a[2] * a[3] + b[2] * b[3] - shared


def _greedy(rows, limit):
    number = lambda s: s is not None and not np.isnan(s)
    good = lambda r: all(c is not None and np.isfinite(c) for c in r[2:6]) and r[4] > 0 and r[5] > 0
    kept = {}
    for r in sorted(filter(good, rows), key=lambda r: (-r[6] if number(r[6]) else np.inf, r[1], r[2:6])):
        mine = kept.setdefault(r[0], [])
        if not any(s > limit * u for s, u in (_iou(r[2:6], k[2:6]) for k in mine)):
            mine.append(r)
    return sorted([r[:2] for k in kept.values() for r in k] + [r[:2] for r in rows if not good(r)], key=str)


BOX = "image string, id long, x double, y double, w double, h double, score double"


@pytest.mark.parametrize("limit", [0.1, 0.4, 0.8])
def test_suppression_against_greedy(spark, limit):
    rnd = np.random.default_rng(int(limit * 10))
    rows = []
    for i in range(700):
        size = float(np.exp(rnd.uniform(0, 6)))
        rows.append((["a", "b", None][i % 3], i, *(float(c) for c in rnd.uniform(-300, 300, 2)), size, size * float(rnd.uniform(0.3, 3)), float(rnd.integers(0, 50))))
    rows += [("chain", 1000 + i, 3.0 * i, 0.0, 10.0, 10.0, float(-i)) for i in range(60)]
    rows += [("copies", 2000 + i, 1.0, 1.0, 8.0, 8.0, 0.5) for i in range(50)] + [("copies", 2100, 8.0, 1.0, 8.0, 8.0, 0.4)]
    rows += [("odd", 3000, 0.0, 0.0, 0.0, 5.0, 1.0), ("odd", 3001, None, 0.0, 1.0, 1.0, 1.0), ("odd", 3002, float("nan"), 0.0, 1.0, 1.0, 1.0), ("odd", 3003, 0.0, 0.0, 4.0, 4.0, None), ("odd", 3004, 0.0, 0.0, 4.0, 4.1, float("nan")), ("odd", 3005, 0.0, 0.0, 4.0, 4.2, -1e9), ("odd", 3006, 0.0, 0.0, -4.0, 4.0, 3.0)]
    df = spark.createDataFrame(rows, BOX).withColumn("tile", F.lit("clash")).withColumn("stays", F.lit(1)).repartition(4)
    got = boxes.suppress(df, "image", limit)
    assert got.columns == df.columns
    assert sorted(((r["image"], r["id"]) for r in got.collect()), key=str) == _greedy(rows, limit)


def test_suppression_of_small_pictures_takes_one_round(spark, monkeypatch):
    names = []
    monkeypatch.setattr(boxes, "cut", lambda df, name, inner=boxes.cut: (names.append(name), inner(df, name))[1])
    rows = [(p, i, 3.0 * i, 0.0, 10.0, 10.0, float(-i)) for p in ("a", "b", None) for i in range(700)]  # a chain over several tiles
    df = spark.createDataFrame(rows, BOX)
    assert sorted(((r["image"], r["id"]) for r in boxes.suppress(df, "image").collect()), key=str) == _greedy(rows, 0.4)
    assert names.count("decided") == 1


@pytest.mark.parametrize("chunk", [3, 128])
def test_suppression_of_pictures_cut_into_tiles(spark, monkeypatch, chunk):
    monkeypatch.setattr(boxes, "WHOLE", 100)
    monkeypatch.setattr(boxes, "PIECE", 50)
    monkeypatch.setattr(boxes, "CHUNK", chunk)
    rnd = np.random.default_rng(chunk)
    rows = [(["a", "b", None][i % 3], i, *(float(c) for c in rnd.uniform(-300, 300, 2)), *(float(c) for c in np.exp(rnd.uniform(2, 6, 2))), float(rnd.integers(0, 50))) for i in range(900)]
    rows += [("small", 2000 + i, 3.0 * i, 0.0, 10.0, 10.0, float(-i)) for i in range(90)]
    rows += [("chain", 1000 + i, 3.0 * i, 0.0, 10.0, 10.0, float(-i)) for i in range(300)]
    got = boxes.suppress(spark.createDataFrame(rows, BOX).repartition(4), "image", 0.3)
    assert sorted(((r["image"], r["id"]) for r in got.collect()), key=str) == _greedy(rows, 0.3)


def test_suppression_of_nothing(spark):
    assert boxes.suppress(spark.createDataFrame([], BOX), "image").count() == 0
    with pytest.raises(ValueError):
        boxes.suppress(spark.createDataFrame([], BOX), "image", 0.0)


# --- places

PLACE = "name string, lat double, lon double, feature_code string, population long, country_code string"


def _best(points, places):
    def km(a, b, c, d):
        a, b, c, d = map(np.radians, (a, b, c, d))
        h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
        return 2 * 6371.0 * np.arcsin(np.sqrt(min(h, 1.0)))

    weights = {"PPLC": 10.0, "PPL": 1.0, "PPLX": 0.05}
    out = []
    for i, lat, lon in points:
        found = [(km(lat, lon, p[1], p[2]), p) for p in places] if lat is not None else []
        near = min((d for d, _ in found), default=1e9)
        if near > 315:
            out.append((i, None))
            continue
        radius = min(max(near * 2.5, near + 5), near + 12)
        out.append((i, min((-round(weights.get(p[3], 0.5) * (max(p[4] or 0, 0) + 1) / (1 + d), 6), round(d, 6), p[0]) for d, p in found if d <= radius)[2]))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowded", [256, 4])
def test_places_everywhere(spark, monkeypatch, crowded):
    monkeypatch.setattr(geocode, "CROWDED", crowded)
    rnd = np.random.default_rng(12)
    spots = [(float(np.degrees(np.arcsin(rnd.uniform(-1, 1)))), float(rnd.uniform(-180, 180))) for _ in range(150)]
    spots += [(float(rnd.uniform(48.8, 48.9)), float(rnd.uniform(2.2, 2.4))) for _ in range(150)]  # a city
    spots += [(float(rnd.uniform(89.5, 90)), float(rnd.uniform(-180, 180))) for _ in range(40)] + [(-90.0, 0.0), (0.0, 180.0), (0.01, -180.0)]
    spots += [(10.0, 10.0)] * 30  # one spot
    places = [(f"p{i:03}", a, b, ["PPLC", "PPL", "PPLX", None][i % 4], None if i % 17 == 0 else int(rnd.integers(-5, 10**6)), "XX") for i, (a, b) in enumerate(spots)]
    points = [(i, float(np.degrees(np.arcsin(rnd.uniform(-1, 1)))), float(rnd.uniform(-180, 180))) for i in range(100)]
    points += [(100 + i, a + float(rnd.normal() * 0.05), b + float(rnd.normal() * 0.05)) for i, (a, b) in enumerate(spots) if abs(a) < 89.8 and abs(b) < 179.8]
    points += [(1000, 89.99, 100.0), (1001, 90.0, -80.0), (1002, -89.95, 55.0), (1003, 0.0, 179.999), (1004, 0.0, -179.999), (1005, None, None), (1006, 10.0, 10.0), (1006, 52.5, 10.0), (None, 10.0, 10.0), (None, 10.0, 10.0)]
    bad = [("bad", 95.0, 0.0, "PPL", 1, "XX"), ("none", None, 0.0, "PPL", 1, "XX")]
    got = geocode.nearest_place(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(places + bad, PLACE).withColumn("leaf", F.lit("clash")))
    rows = got.collect()
    assert sorted(((r["id"], r["place"]) for r in rows), key=str) == _best(points, places)


def test_places_of_nothing(spark):
    none = spark.createDataFrame([], PLACE)
    points = spark.createDataFrame([(1, 1.0, 1.0)], "id long, lat double, lon double")
    assert [tuple(r) for r in geocode.nearest_place(points, none).collect()] == [(1, 1.0, 1.0, None, None, None)]
    assert geocode.nearest_place(points.where("false"), none).count() == 0
    berlin = [("Tiergarten", 52.5145, 13.3501, "PPLX", 12000, "DE"), ("Berlin", 52.5244, 13.4105, "PPLC", 3426354, "DE"), ("Village", 10.0, 10.0, "PPL", 800, "XX"), ("Metropolis", 10.4, 10.0, "PPLA", 2000000, "XX")]
    asked = spark.createDataFrame([(1, 52.5146, 13.3502), (2, 10.01, 10.0), (4, -45.0, -130.0), (5, 10.39, 10.0)], "id long, lat double, lon double")
    assert {r["id"]: r["place"] for r in geocode.nearest_place(asked, spark.createDataFrame(berlin, PLACE)).collect()} == {1: "Berlin", 2: "Village", 4: None, 5: "Metropolis"}
