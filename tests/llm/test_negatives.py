"""Hard negatives against all pairs, and the trees' bounds."""

import math
import random

import numpy as np
import pytest

from quarrylens.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, cell long, score double, Bound string, v long, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, k, 1, 2.0, "x", 3, 4) for i, v, k in rows], SCHEMA)


def expected(rows):
    fine = [(i, (k + 1) % 10 if i is not None and i % 7 == 0 else k, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, k in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = max([len(v) for _, _, v in fine], default=0)
    x = np.array([v + [0] * (dim - len(v)) for _, _, v in fine], np.int64).reshape(len(fine), dim)
    out = []
    for a, (i, label, _) in enumerate(fine):
        if i is None or i % 100:
            continue
        score = (x @ x[a]).tolist()
        order = sorted((b for b in range(len(fine)) if b != a), key=lambda b: (-score[b], fine[b][0] is None, fine[b][0] or 0))
        for p in [b for b in order if fine[b][1] == label][:5]:
            bad = [b for b in order if fine[b][1] != label and 80 * score[p] <= 100 * score[b] <= 100 * score[p]][:5]
            out += [(i, fine[p][0], r, fine[b][0], score[p], score[b]) for r, b in enumerate(bad, 1)]
    return sorted(out, key=str)


def vectors(rng, n, centres, spread, dim=12, labels=4):
    middle = rng.normal(0, 1, (centres, dim))
    out = []
    for i in range(n):
        c = rng.integers(centres)
        v = middle[c] + rng.normal(0, spread, dim)
        out.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), int((c + (rng.random() < 0.3)) % labels)))
    return out


@pytest.mark.parametrize("n,centres,spread,block,group", [(2500, 12, 0.15, 64, 4), (1500, 1, 1.0, 4096, 512), (1200, 40, 0.02, 32, 3)])
def test_equals_all_pairs(spark, n, centres, spread, block, group):
    rows = vectors(np.random.default_rng(n), n, centres, spread)
    rows += [(5000 + i, rows[300][1], i % 3) for i in range(200)]  # one vector very often, with keys that are anchors among them
    got = negatives.hard_negatives(table(spark, rows).repartition(5), block=block, group=group).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
    assert len(got) > 100


def test_odd_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], i % 2) for i in range(300)]
    rows += [(400, None, 1), (500, [1.0, None, 0.0, 0.0], 1), (600, [float("nan")] * 4, 0), (700, [float("inf"), 0.0, 0.0, 0.0], 0), (800, [0.5] * 4, None), (None, [0.6] * 4, 1), (None, [0.6] * 4, 0), (900, [0.5, 0.5], 1), (1000, [], 1), (100, rows[100][1], 0), (200, [0.9] * 4, 0), (1100, [0.0] * 4, 0), (1200, [0.0] * 4, 1), (1300, [0.0] * 4, 1)]
    rows += [rows[0], rows[0], rows[3]]
    got = negatives.hard_negatives(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
    for few in (rows[:0], rows[1:50], rows[:1], [(100, [1.0], 1), (101, [1.0], 1)], [(100, None, None)]):
        assert [tuple(r) for r in negatives.hard_negatives(table(spark, few)).collect()] == expected(few)


def test_bounds_prune_and_never_cut(spark):
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.normal(c, 3, (300, 8)) for c in rng.normal(0, 100, (8, 8))])
    tree, over = negatives.Tree(rows[::3], 4), negatives.Tree(rows[::10], 3)
    leaf, own = tree.leaf(rows), over.leaf(rows[::10])
    reach = {int(k): float(np.sqrt(((rows[leaf == k] - tree.centre[k]) ** 2).sum(axis=1).max())) for k in np.unique(leaf)}
    radius = {int(k): float(np.sqrt(((rows[::10][own == k] - over.centre[k]) ** 2).sum(axis=1).max())) for k in np.unique(own)}
    score = rows[::10] @ rows.T
    want = {int(k): (float(np.sort(score[own == k], axis=1)[:, -5].min()), float(np.sort(score[own == k], axis=1)[:, -2].max())) for k in np.unique(own)}
    kept = {(a, c): b for a, c, b in negatives.dual_walk(over, radius, want, tree, reach)}
    assert 0 < len(kept) < 0.7 * len(radius) * len(reach)
    for a, k in enumerate(own.tolist()):
        for c, cell in enumerate(leaf.tolist()):
            if want[k][0] <= score[a, c] <= want[k][1]:
                assert score[a, c] <= kept[k, cell]


def test_first_of_very_large_scores():
    score = np.array([[2.0**61, 2.0**61, 5.0, 2.0**62], [1.0, 1.0, 1.0, 1.0]])
    got = negatives._best(score, np.array([[True, True, True, False], [False, True, True, True]]), np.array([3, 1, 0, 2]), 3)
    assert got.tolist() == [[1, 0, 2], [2, 1, 3]]
    assert negatives._best(score[:, :2], np.zeros((2, 2), bool), np.array([0, 1]), 3).tolist() == [[-1] * 3] * 2
