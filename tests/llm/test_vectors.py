"""The searches and clusters over vectors against brute force, and on empty, null, tied, repeated and odd input."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storynet.llm import centroids, hard_negatives, hash_forest

ROWS = "vec_id long, v array<double>, label int, score int, h string, row string"


def vectors(seed, n, size, spread=4):
    """Integer vectors with copies, ties, repeated rows and ids, and columns whose names clash with inner ones."""
    rng = random.Random(seed)
    rows = [(i, [float(rng.randint(-spread, spread)) for _ in range(size)], rng.choice([0, 0, 0, 1, 2]), 1, "x", "y") for i in range(n)]
    rows += [(n + i, rows[7][1], 0, 1, "x", "y") for i in range(n // 4)]  # copies of one vector
    rows += [rows[3], (5, [float(spread)] * size, 1, 1, "x", "y")]  # a repeated row, and another row with an id that is there
    return rows


def odd(size):
    """Rows that take no part in a search."""
    good = [1.0] * size
    return [(900, None, 1), (901, [], 1), (902, [None, *good[1:]], 1), (903, [float("nan"), *good[1:]], 1), (904, [float("inf"), *good[1:]], 1), (905, [*good, 1.0], 1)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], ROWS).repartition(3)


# --- clusters


def brute_clusters(rows, k, rounds, size, seed=1):
    kept = [(i, np.array(v, np.int64)) for i, v in rows]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1].tolist()))
    c = [v for _, v in order[:k]]
    for at in range(rounds + 1):
        near = [min((int(((v - x) ** 2).sum()), j) for j, x in enumerate(c)) for _, v in kept]
        if at < rounds:
            for j in range(len(c)):
                own = [v for (_, v), (_, o) in zip(kept, near, strict=True) if o == j]
                c[j] = sum(own) // len(own) if own else c[j]
    inertia = {j: sum(d for d, o in near if o == j) for j in range(len(c))}
    digest = [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in c]
    return sorted(((-1 if i is None else i), j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (d, j) in zip(kept, near, strict=True))


@pytest.mark.parametrize(("size", "k", "spread"), [(8, 5, 2), (8, 16, 1), (3, 4, 40)])
def test_clusters_equal_brute_force(spark, size, k, spread):
    rows = vectors(size + k, 120, size, spread)
    whole = centroids.whole(frame(spark, [*rows, (None, [1.0] * size, 1), *odd(size)]), scale=1)
    got = centroids.cluster(whole, k=k, size=size).collect()
    want = brute_clusters([*((r[0], r[1]) for r in rows), (None, [1.0] * size)], k, 3, size)
    assert sorted((-1 if r.vec_id is None else r.vec_id, *r[1:]) for r in got) == want


def test_clusters_scale_and_floor(spark):
    whole = centroids.whole(frame(spark, [(1, [0.99, -0.01], 1), (2, [1.5, -3.0], 1)]), scale=64)
    assert {r.vec_id: r.v for r in whole.collect()} == {1: [63, -1], 2: [96, -192]}


def test_clusters_of_few_and_of_nothing(spark):
    assert centroids.cluster(centroids.whole(frame(spark, []))).count() == 0
    assert centroids.cluster(centroids.whole(frame(spark, odd(64)))).count() == 0
    few = centroids.cluster(centroids.whole(frame(spark, [(1, [0.0] * 3, 1), (2, [5.0] * 3, 1)])), size=3).collect()
    assert all(r.distance == 0 and r.inertia == 0 for r in few) and len({r.cluster for r in few}) == 2
    with pytest.raises(Exception, match="in absolute value"):
        centroids.cluster(centroids.whole(frame(spark, [(1, [1e30], 1)])), size=1).collect()


def test_threshold_walk_stops_early_and_breaks_ties_by_number():
    rng = np.random.default_rng(5)
    near = rng.integers(-1000, 1000, (40, 6))
    x = near[rng.integers(0, 40, 500)] + rng.integers(-3, 4, (500, 6))
    who, distance, taken = centroids.Lists(near).nearest(x)
    exact = ((x[:, None] - near[None]) ** 2).sum(2)
    assert (who == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert taken < exact.size / 4  # most distances are never computed
    who, _, _ = centroids.Lists(np.array([[4, 0], [0, 4], [0, 0], [0, 0]])).nearest(np.array([[2, 2], [0, 0], [4, 0]]))
    assert who.tolist() == [0, 2, 0]


# --- hard negatives


def brute_negatives(rows, positives=5, negatives=3):
    rows, out = [(i, np.array(v), x) for i, v, x in rows], []
    for a, (i, q, own) in enumerate(rows):
        if i % 5:
            continue
        score = [float(v @ q) for _, v, _ in rows]
        same = sorted((j for j, r in enumerate(rows) if j != a and r[2] == own), key=lambda j: (-score[j], rows[j][0]))[:positives]
        for p in same:
            fits = [j for j, r in enumerate(rows) if r[2] != own and 50 * score[p] <= 100 * score[j] <= 95 * score[p]]
            for rank, j in enumerate(sorted(fits, key=lambda j: (-score[j], rows[j][0]))[:negatives], 1):
                out.append((i, rows[p][0], rank, rows[j][0], score[p], score[j]))
    return sorted(out)


@pytest.mark.parametrize(("size", "spread", "cell"), [(6, 3, 1 << 22), (20, 9, 2000), (11, 1, 700)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, size, spread, cell):
    monkeypatch.setattr("storynet.llm.cells.CELL_BYTES", cell)
    rows = vectors(size, 150, size, spread)
    extra = [*odd(size), (None, [1.0] * size, 1), (910, [1.0] * size, None)]
    got = hard_negatives.mine(frame(spark, [*rows, *extra]), "vec_id % 5 = 0").collect()
    assert sorted(tuple(r) for r in got) == brute_negatives([r[:3] for r in rows])


def test_hard_negatives_without_positives_and_of_nothing(spark):
    assert hard_negatives.mine(frame(spark, []), "vec_id % 5 = 0").count() == 0
    alone = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 2)]
    assert hard_negatives.mine(frame(spark, alone), "vec_id % 5 = 0").count() == 0
    against = [(0, [1.0, 2.0], 1), (1, [-1.0, -2.0], 1), (2, [-0.7, -1.4], 2)]  # a negative product leaves no window
    assert hard_negatives.mine(frame(spark, against), "vec_id % 5 = 0").count() == 0
    none = [(0, [0.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 3.0], 2)]  # a product of 0 has the window 0 to 0
    assert [tuple(r) for r in hard_negatives.mine(frame(spark, none), "vec_id % 5 = 0").collect()] == [(0, 1, 1, 2, 0.0, 0.0)]


def test_vertical_scan_leaves_columns_unread():
    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal((2000, 64)) * np.geomspace(400, 1, 64))
    import pyarrow as pa

    cell = hard_negatives.Columns(pa.table({"row": np.arange(2000), "vec_id": np.arange(2000), "label": np.zeros(2000, np.int64), "v": list(x)}))
    looks = []

    def stay(low, high, slack):
        looks.append(len(low))
        return high >= np.partition(low, len(low) - 5)[len(low) - 5] - slack

    rows, product = cell.scan(x[0], np.arange(1, 2000), stay)
    assert set(np.argsort(-(x[1:] @ x[0]))[:5] + 1) <= set(rows)
    assert looks[0] == 1999 and sum(looks) < 4 * 1999  # eight looks at all rows would be 15,992


# --- forest


def brute_nearest(rows, k, step):
    out = {}
    for a, (i, q) in enumerate(rows):
        if i % step == 0:
            score = [(-float((np.array(v) * np.array(q)).sum()), j, b) for b, (j, v) in enumerate(rows) if b != a]
            out.setdefault(i, []).append([(r, j, -s) for r, (s, j, _) in enumerate(sorted(score)[:k], 1)])
    return out


def clustered(n, size, seed):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((30, size)) * 3
    x = middle[rng.integers(0, 30, n)] + rng.standard_normal((n, size))
    return [(i, (row * rng.uniform(0.5, 2)).tolist()) for i, row in enumerate(x)]


@pytest.mark.parametrize("cell", [1 << 22, 4000])
def test_forest_finds_nine_of_ten(spark, monkeypatch, cell):
    monkeypatch.setattr("storynet.llm.cells.CELL_BYTES", cell)
    rows = clustered(3000, 24, 1)
    got = hash_forest.search(frame(spark, rows), "vec_id % 20 = 0").collect()
    want = {i: {j for _, j, _ in found[0]} for i, found in brute_nearest(rows, 20, 20).items()}
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    by = dict(rows)
    for i, near in found.items():
        order = [(-near[n][1], near[n][0]) for n in range(1, 21)]
        assert order == sorted(order) and i not in {j for j, _ in near.values()} and len({j for j, _ in near.values()}) == 20
        assert all(s == pytest.approx(float(np.dot(by[i], by[j])), abs=1e-9) for j, s in near.values())
    assert np.mean([len(want[i] & {j for j, _ in found[i].values()}) / 20 for i in want]) >= 0.9


def test_forest_does_not_scan_clustered_rows_whole(spark):
    rows = clustered(3000, 24, 1)
    fitted = []
    plain = hash_forest._fit

    def fit(entries, forest, *rest):
        plain(entries, forest, *rest)
        fitted.append(forest)

    hash_forest._fit, before = fit, hash_forest._fit
    try:
        hash_forest.search(frame(spark, rows), "vec_id % 20 = 0").count()
    finally:
        hash_forest._fit = before
    assert fitted[0].enough < len(rows) * len(fitted[0].planes) / 2


def test_forest_with_copies_ties_and_few_rows_is_exact(spark):
    rows = [(i, v) for i, v, *_ in vectors(9, 30, 5, 1)]
    zero = [(950, [0.0] * 5, 1)]
    got = {}
    for r in hash_forest.search(frame(spark, [*rows, *zero, *odd(5), (None, [1.0] * 5, 1)]), "vec_id % 5 = 0", recall=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_nearest([r for r in rows if any(r[1])], 20, 5)
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(y for x in found for y in x) for i, found in want.items()}


def test_forest_of_nothing_and_of_one(spark):
    assert hash_forest.search(frame(spark, []), "vec_id % 20 = 0").count() == 0
    assert hash_forest.search(frame(spark, [(0, [1.0, 2.0])]), "vec_id % 20 = 0").count() == 0
    two = hash_forest.search(frame(spark, [(0, [1.0, 2.0]), (1, [-1.0, -2.0])]), "vec_id % 20 = 0").collect()
    assert [tuple(r) for r in two] == [(0, 1, 1, -5.0)]


def test_queries_equal_their_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    for module in (centroids, hard_negatives):
        got = module.query(spark, sf)
        want = con.execute(module.SQL).fetchall()
        names = [c[0] for c in con.description]
        assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want)
    raw = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, hits = brute_nearest(raw, 20, 20), 0
    for r in hash_forest.query(spark, sf).groupBy("query_id").agg(F.collect_set("vec_id").alias("found")).collect():
        hits += len(set(r.found) & {j for _, j, _ in want[r.query_id][0]})
    assert hits >= 0.9 * 20 * len(want)
