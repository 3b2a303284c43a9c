import numpy as np

from pressloom.llm import density as D

LENGTHS = {"m": 24, "k": 16}
SCHEMA = "id long, v array<float>, model string, rep long, q string"


def brute(rows, threshold=0.8):
    good = {}
    for i, v, m, *_ in rows:
        if i is None or v is None or m not in LENGTHS or len(v) != LENGTHS[m] or any(x is None for x in v):
            continue
        x = np.array(v, np.float64)
        if np.isfinite(x).all() and (x != 0).any():
            good[i] = (m, x / np.linalg.norm(x))
    label = {i: i for i in good}
    changed = True
    while changed:
        changed = False
        for a in good:
            for b in good:
                if good[a][0] == good[b][0] and good[a][1] @ good[b][1] >= threshold and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    sizes = {}
    for x in label.values():
        sizes[x] = sizes.get(x, 0) + 1
    return {(i, x) for i, x in label.items() if sizes[x] > 1}


def planted(seed, clusters=25):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for m, d in LENGTHS.items():
        for _ in range(clusters):
            c = rng.normal(size=d)
            for _ in range(rng.integers(1, 7)):
                v = c + rng.normal(size=d) * rng.uniform(0.1, 0.6)
                rows.append((n, [float(x) for x in v * rng.uniform(0.5, 3)], m, 0, "x"))
                n += 1
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return D.similarity_clusters(df, "id", "v", "model", LENGTHS, **kw)


def test_clusters_equal_brute_force(spark):
    rows = planted(6)
    got = {(r["id"], r["cluster_id"]) for r in run(spark, rows).collect()}
    assert got == brute(rows)


def test_tiles_give_the_same(spark, monkeypatch):
    rows = planted(7)
    monkeypatch.setattr(D, "TILE", 20)
    monkeypatch.setattr(D, "FEW_LINKS", 10)
    got = {(r["id"], r["cluster_id"]) for r in run(spark, rows).collect()}
    assert got == brute(rows)


def test_recall_of_blocks_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(400):
        centre = rng.normal(size=24)
        for k in range(4):
            rows.append((c * 4 + k, [float(x) for x in centre + rng.normal(size=24) * 0.3], "m", 0, ""))
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(v @ v.T >= 0.8, 1))
    label = {r["id"]: r["cluster_id"] for r in run(spark, rows).collect()}
    together = np.mean([label.get(a, -1) == label.get(b, -2) for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    assert together >= 0.99


def test_bad_vectors_nulls_copies_and_empty(spark):
    one = [1.0] + [0.0] * 15
    rows = [
        (1, one, "k", 0, ""), (2, [2.0] + [0.0] * 15, "k", 0, ""), (2, [2.0] + [0.0] * 15, "k", 0, ""), (3, [0.0] * 16, "k", 0, ""), (4, one[:8], "k", 0, ""),
        (5, None, "k", 0, ""), (6, one, None, 0, ""), (7, [float("nan")] + one[1:], "k", 0, ""), (8, [float("inf")] + one[1:], "k", 0, ""),
        (9, one, "other", 0, ""), (None, one, "k", 0, ""), (10, [None, *one[1:]], "k", 0, ""), (11, [1e-30] + [0.0] * 15, "k", 0, ""),
    ]
    got = {(r["id"], r["cluster_id"]) for r in run(spark, rows).collect()}
    assert got == {(1, 1), (2, 1), (11, 1)}
    assert run(spark, rows[2:3] * 0 + [(5, None, "k", 0, "")]).count() == 0


def test_description_names_the_densest(spark):
    rows = planted(9)
    clusters = run(spark, rows)
    told = D.describe(clusters, typical=2).collect()
    members = {}
    for r in clusters.collect():
        members.setdefault(r["cluster_id"], []).append((-r["density"], r["id"]))
    assert {r["cluster_id"]: (r["size"], r["typical"]) for r in told} == {c: (len(m), [i for _, i in sorted(m)[:2]]) for c, m in members.items()}


def test_copies_of_one_vector_make_one_pivot_and_lose_no_link(spark, monkeypatch):
    """A third of the rows equal, the others at 0.81-0.9 to them and below the threshold to each other."""
    rng = np.random.default_rng(10)
    n, d = 1800, 96
    hot = rng.normal(size=d)
    hot /= np.linalg.norm(hot)
    away = rng.normal(size=(n, d))
    away -= np.outer(away @ hot, hot)
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    c = rng.uniform(0.81, 0.9, (n, 1))
    v = np.concatenate([np.tile(hot, (n // 2, 1)), c * hot + np.sqrt(1 - c**2) * away])
    rows = [(i, x, "m", 0, "") for i, x in enumerate(v.tolist())]
    monkeypatch.setattr(D, "PIVOTS", 14.0)  # some 600 pivots
    chosen, choose = {}, D.choose_pivots
    monkeypatch.setattr(D, "choose_pivots", lambda *a: chosen.update(choose(*a)) or chosen)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r["id"], r["cluster_id"]) for r in D.similarity_clusters(df, "id", "v", "model", {"m": d}).collect()}
    assert len(chosen["m"]) > 500 and len(np.unique(chosen["m"], axis=0)) == len(chosen["m"])
    assert got == {(i, 0) for i in range(len(v))}


def test_density_counts_all_neighbours(spark, monkeypatch):
    """Hot clusters over many pivots, copies, and pairs near the threshold, against brute force."""
    rng = np.random.default_rng(11)
    v = [rng.normal(size=24) + rng.normal(size=24) * 0.1 for _ in range(3)]
    rows = [x + rng.normal(size=24) * rng.uniform(0.2, 0.6) for x in v for _ in range(250)]
    rows += [rows[5]] * 40 + [rows[300] * 2] * 10
    rows = [(i, [float(x) for x in r.astype(np.float32)], "m", 0, "") for i, r in enumerate(rows)]
    monkeypatch.setattr(D, "PIVOTS", 4.0)
    monkeypatch.setattr(D, "BUCKET", 100, raising=False)
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near, whole = (unit @ unit.T >= 0.8).sum(axis=1), brute(rows)
    for tile in (D.TILE, 120):
        monkeypatch.setattr(D, "TILE", tile)
        clusters = run(spark, rows)
        assert {r["id"]: r["density"] for r in clusters.collect()} == {i: float(near[i]) for i, _ in whole}
        typical = {r["cluster_id"]: r["typical"] for r in D.describe(clusters).collect()}
        assert typical == {c: sorted((i for i, x in whole if x == c), key=lambda i: (-near[i], i))[:3] for _, c in whole}


def test_peaks_and_distances(spark):
    """Three bundles: each has a peak, and every other point is told how far its nearest denser neighbour is."""
    rng = np.random.default_rng(8)
    centres = np.eye(96)[:3]
    rows = []
    for k in range(150):
        v = centres[k % 3] + rng.normal(0, 0.03, 96)
        rows.append((k, "sentence", v.tolist()))
    rows.append((150, "sentence", rows[0][2]))  # equal to another
    df = spark.createDataFrame(rows, "id long, model string, v array<double>").repartition(3)
    got = {r["id"]: r for r in D.similarity_clusters(df, "id", "v", "model", {"sentence": 96}).collect()}
    assert set(got) == set(range(151)) and {r["cluster_id"] for r in got.values()} == {0, 1, 2}
    unit = np.array([v for _, _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    sims = unit @ unit.T
    for i, r in got.items():
        assert 0 < r["distance"] <= 1
        if not r["peak"] and i != 150 and r["distance"] < 1:  # it is the distance of some neighbour
            assert np.abs(1 - sims[i] - r["distance"]).min() < 1e-3
    told = {r["cluster_id"]: r for r in D.describe(spark.createDataFrame(list(got.values()))).collect()}
    assert all(1 <= t["peaks"] < 25 and got[t["chief"]]["peak"] and got[t["chief"]]["cluster_id"] == c for c, t in told.items())
    assert {c: t["size"] for c, t in told.items()} == {0: 51, 1: 50, 2: 50}
