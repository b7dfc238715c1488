"""Clusters and product codes against full scans in plain numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from paperlode.llm import centroids, codes

EXTRA = "cluster int, distance long, code string, error long, state string, plain string, own string, own_label string"
CLASH = (7, 7, "x", 7, "x", "x", "x", "x")


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def floors(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def lloyd(rows, books, rounds):
    """Codes and codebook after the rounds, by full scans; rows are lists of whole numbers."""
    books = [list(b) for b in books]

    def assigned():
        return [min(range(len(books)), key=lambda c: (far(r, books[c]), c)) for r in rows]

    for _ in range(rounds):
        who = assigned()
        for c in range(len(books)):
            own = [r for r, w in zip(rows, who) if w == c]
            if own:
                books[c] = [sum(x) // len(own) for x in zip(*own)]
    return assigned(), books


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    made = [(i, [rng.gauss(0, 0.3) for _ in range(64)], rng.randint(0, 4)) for i in range(150)]
    same = [0.25 if j % 2 else -0.5 for j in range(64)]
    made += [(200 + i, same, None) for i in range(90)]  # one vector holds a third of all rows
    made += [(300, None, 1), (301, [0.1] * 63, 1), (302, [0.1] * 63 + [None], 1), (303, [math.nan] * 64, 2)]
    made += [(304, [0.1] * 63 + [math.inf], 2), (305, [], 1), (306, [0.0] * 64, 3), (306, [0.0] * 64, 3)]
    made += [(None, [0.5] * 64, 1), (307, [-0.01] * 64, None), (308, [0.01] * 64, None)]
    return made


@pytest.fixture(scope="module")
def frame(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, " + EXTRA
    return spark.createDataFrame([(*r, *CLASH) for r in rows], schema).repartition(5).cache()


@pytest.mark.parametrize("k", [1, 5, 16])
def test_threshold_walk_finds_the_nearest(k):
    rng = np.random.default_rng(k)
    centres = rng.integers(-9, 9, (k, 6))
    centres[k // 2] = centres[0]  # equal centroids, and equal distances
    x = rng.integers(-12, 12, (3_000, 6))
    who, best, measured = centroids.Lists(centres).nearest(x)
    every = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (who == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert measured <= x.shape[0] * k


def test_threshold_walk_stops_early():
    centres = np.array([[1000 * c, 1000 * c] for c in range(50)])
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50_000, (500, 1)) + rng.integers(-300, 300, (500, 2))
    who, best, measured = centroids.Lists(centres).nearest(x)
    assert (best == ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)).all()
    assert measured < 500 * 4


@pytest.mark.parametrize("k", [16, 400])
def test_clusters_equal_full_scans(frame, rows, k):
    found, centres = centroids.cluster(frame, k=k)
    out = centroids.with_inertia(found, centres).collect()
    kept = [(i, floors(v, 64)) for i, v, _ in rows if usable(v) and len(v) == 64]
    name = lambda r: ("g" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    first = [v for _, v in sorted(kept, key=name)[:k]]
    who, books = lloyd([v for _, v in kept], first, 3)
    assert centres.tolist() == books
    want = sorted((str(i), c, far(v, books[c])) for (i, v), c in zip(kept, who))
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in out) == want
    total = sum(d for _, _, d in want)
    for r in out:
        assert r["inertia"] == total and r["plain"] == "x" and r["own"] == "x"
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        line = ",".join(map(str, books[r["cluster"]]))
        assert r["centroid_sha256"] == hashlib.sha256(line.encode()).hexdigest()


@pytest.mark.parametrize("entries", [1, 16, 256])
def test_codes_equal_full_scans(frame, rows, entries):
    got = codes.compress(frame, entries=entries)
    out = codes.with_label_error(got.rows, "label").collect()
    kept = [(i, floors(v, 4096), y) for i, v, y in rows if usable(v) and len(v) == 64]
    smallest = sorted(kept, key=lambda r: (r[0] is None, r[0]))[:entries]
    text, error, books = ["" for _ in kept], [0 for _ in kept], []
    for p in range(8):
        own = [v[8 * p : 8 * p + 8] for _, v, _ in kept]
        who, book = lloyd(own, [v[8 * p : 8 * p + 8] for _, v, _ in smallest], 6)
        books += [x for e in book for x in e]
        for i, c in enumerate(who):
            text[i] += f"{c:02x}"
            error[i] += far(own[i], book[c])
    want = sorted((str(i), t, e) for (i, _, _), t, e in zip(kept, text, error))
    coded = [r for r in out if r["code"] is not None]
    assert sorted((str(r["vec_id"]), r["code"], r["error"]) for r in coded) == want
    assert got.digest() == hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    by_label = {}
    for (_, _, y), e in zip(kept, error):
        by_label[y] = by_label.get(y, 0) + e
    assert all(r["label_error"] == by_label[r["label"]] for r in coded)
    assert sorted(r["vec_id"] for r in out if r["code"] is None) == [301, 305]


def test_bounds_settle_most_parts_and_are_tighter_than_drifts():
    rng = np.random.default_rng(2)
    groups = rng.integers(-900, 900, (16, 8))
    x = groups[rng.integers(0, 16, 4_000)] + rng.integers(-250, 250, (4_000, 8))
    history, state, shares, tighter = [[x[:16].copy()]], None, [], []
    for _ in range(7):
        bounds = codes.Bounds(history)
        state, measured = codes.advanced(state, x, bounds, [0, 8])
        full = ((x[:, None] - history[-1][0][None]) ** 2).sum(axis=2)
        assert (state.code[:, 0] == full.argmin(axis=1)).all()
        shares.append(measured / len(x))
        steps = [np.sqrt(((b[0] - a[0]) ** 2).sum(axis=1)) for a, b in zip(history, history[1:])]
        if len(steps) > 1:
            tighter.append((sum(steps) - bounds.own[0, 0]).sum())
            assert (bounds.own[0, 0] <= sum(steps) + 1e-9).all()
        new = history[-1][0].copy()
        for e in range(16):
            if (state.code[:, 0] == e).any():
                new[e] = x[state.code[:, 0] == e].sum(axis=0) // (state.code[:, 0] == e).sum()
        history.append([new])
    assert shares[0] == 1 and shares[-1] < 0.9 and max(tighter) > 0


def test_empty_and_unusable_tables(spark, frame):
    for none in (frame.limit(0), frame.filter("vec_id = 300")):
        rows, centres = centroids.cluster(none)
        assert centroids.with_inertia(rows, centres).count() == 0 and not len(centres)
        got = codes.compress(none)
        assert codes.with_label_error(got.rows, "label").count() == 0
    few = codes.compress(frame.filter("vec_id in (1, 2, 301)"))
    assert sorted((r["vec_id"], r["code"] is None) for r in few.rows.collect()) == [(1, False), (2, False), (301, True)]


def test_uneven_parts_and_large_components(spark):
    rows = spark.createDataFrame([(i, [float(i), 2.0, 3.0]) for i in range(4)], "vec_id long, embedding array<double>")
    got = codes.compress(rows, parts=2, entries=2, scale=10)
    assert [b.shape for b in got.books] == [(2, 2), (2, 1)] and got.rows.count() == 4
    back = got.rows.select(codes.decoded(got.rows["code"], got.books, 10).alias("v")).first()["v"]
    assert len(back) == 3
    huge = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="squared"):
        codes.compress(huge)
