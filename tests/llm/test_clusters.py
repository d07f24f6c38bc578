"""Walsh-Hadamard clustering against plain loops over whole numbers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from parcelwise.llm import walsh_clusters as wc


def slow_clusters(rows, k, rounds):
    kept = [
        (i, [math.floor(256 * float(x)) for x in v])
        for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    if not kept:
        return []
    centres = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign():
        out = []
        for _, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        got = assign()
        for c in range(len(centres)):
            mine = [v for (_, v), (g, _) in zip(kept, got) if g == c]
            if mine:
                centres[c] = [sum(col) // len(mine) for col in zip(*mine)]
    got = assign()
    fits = lambda x: x if x < 1 << 63 else None
    by = {c: fits(sum(d for g, d in got if g == c)) for c, _ in got}
    total = fits(sum(d for _, d in got))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, g, fits(d), by[g], total, digest[g]) for (i, _), (g, d) in zip(kept, got)), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, cluster int")


def vectors(n, seed=1, spread=1.0):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(5, 64))
    return [(i, (middle[i % 5] + spread * draw.normal(size=64)).tolist()) for i in range(n)]


@pytest.mark.parametrize("k,rounds", [(1, 1), (7, 5), (40, 2)])
def test_equals_plain_loops(spark, k, rounds):
    rows = vectors(150) + [(3, None), (None, [0.5] * 64), (900, [0.1] * 63), (901, [None] + [0.1] * 63), (902, [float("nan")] * 64),
                           (903, [float("inf")] * 64), (904, [])] + [(1000 + i, [0.25] * 64) for i in range(60)] + vectors(20)
    got = wc.clustered(table(spark, rows).repartition(5), clusters=k, rounds=rounds)
    assert sorted(map(tuple, got.collect()), key=repr) == slow_clusters(rows, k, rounds)


def test_huge_components(spark):
    rows = [*vectors(30), (100, [3e38] * 64), (101, [-1e300] * 64), (102, [70000.5] * 64)]
    got = wc.clustered(table(spark, rows), clusters=6, rounds=2)
    assert sorted(map(tuple, got.collect()), key=repr) == slow_clusters(rows, 6, 2)


def test_small_tables(spark):
    assert wc.clustered(table(spark, [])).collect() == []
    assert wc.clustered(table(spark, [(1, None)])).collect() == []
    rows = vectors(3)
    assert sorted(map(tuple, wc.clustered(table(spark, rows)).collect()), key=repr) == slow_clusters(rows, 40, 5)


def test_transform_is_exact_and_prunes():
    draw = np.random.default_rng(5)
    vectors, centres = draw.integers(-300, 300, (200, 64)), draw.integers(-300, 300, (40, 64))
    vectors[:40] = centres + draw.integers(-3, 3, (40, 64))
    a, b = wc.walsh(vectors), wc.walsh(centres)
    plain = ((vectors[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (((a[:, None] - b[None]) ** 2).sum(axis=2) == 64 * plain).all()
    number, distance = wc.nearest(a, b)
    assert (number == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()
    # near centroids everything else is gone after four of 64 coefficients
    coarse = ((a[:40, None, :4] - b[None, :, :4]) ** 2).sum(axis=2)
    assert (coarse <= ((a[:40] - b[number[:40]]) ** 2).sum(axis=1)[:, None]).sum() < 100
