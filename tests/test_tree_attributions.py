"""Shapley values of trees against enumeration of all subsets."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_trees import SCHEMA, _rows

from reviewlens.models import trees
from reviewlens.models.tree_attributions import add_values, leaf_paths, mean_value, tree_attributions


def _known(tree, row, features, node=0):
    """The tree's value when only some features are known."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    sides = tree.left[node], tree.right[node]
    if f in features:
        return _known(tree, row, features, sides[0] if row[f] <= tree.bin[node] else sides[1])
    return sum(tree.cover[s] / tree.cover[node] * _known(tree, row, features, s) for s in sides)


def _enumerated(tree, row, n):
    out = np.zeros(n)
    for j in range(n):
        rest = [i for i in range(n) if i != j]
        for k in range(n):
            for some in combinations(rest, k):
                weight = factorial(k) * factorial(n - k - 1) / factorial(n)
                out[j] += weight * (_known(tree, row, {*some, j}) - _known(tree, row, set(some)))
    return out


def _random_tree(rng, depth, features):
    tree, level = trees.Tree(value=[0.0], cover=[64.0]), [0]
    for _ in range(depth):
        below = []
        for node in level:
            if rng.random() < 0.8:
                share = rng.uniform(0.1, 0.9) * tree.cover[node]
                values = tuple(rng.normal(size=2))
                below += tree.split(node, int(rng.integers(features)), int(rng.integers(0, 5)), values, (share, tree.cover[node] - share))
        level = below
    return tree.arrays()


def test_values_equal_the_enumeration():
    rng = np.random.default_rng(3)
    for depth in (0, 1, 2, 3, 4, 5):
        for _ in range(6):
            tree, dense = _random_tree(rng, depth, 5), rng.integers(0, 7, (4, 5))
            out = np.zeros((4, 5))
            add_values(tree, dense, out)
            wanted = [_enumerated(tree, row, 5) for row in dense]
            assert np.allclose(out, wanted)
            assert np.allclose(out.sum(axis=1), [_known(tree, row, set(range(5))) - mean_value(tree) for row in dense])


@pytest.mark.parametrize("kind", ["forest", "boosting", "levels"])
def test_values_add_up_to_the_prediction(spark, kind):
    dense, label, rows = _rows(250)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if kind == "forest":
        model = trees.fit_forest(frame, 12, trees=6, depth=5)
        mean, link = np.mean([mean_value(t) for t in model.trees]), lambda p: p
    else:
        model = trees.fit_boosting(frame, 12, rounds=4, depth=3, in_memory_rows=0 if kind == "levels" else 4_096)
        mean = model.start + model.rate * sum(mean_value(t) for t in model.trees)
        link = lambda p: np.log(p / (1 - p))
    names = [f"f{i}" for i in range(12)]
    sums = tree_attributions(model, frame, names, 12).groupBy("row_id").agg(F.sum("contribution").alias("s"), F.max("rank").alias("n"))
    got = {r.row_id: r.s for r in sums.collect()}
    for r in model.transform(frame).collect():
        assert got.get(r.row_id, 0.0) == pytest.approx(link(r.probability) - mean, abs=1e-6)
    assert tree_attributions(model, frame, names, 2).where("rank > 2").count() == 0


def test_repeated_features_and_shared_paths_give_the_sums_of_single_leaves():
    """Against one product per leaf, on a deep tree in which features split again."""
    rng = np.random.default_rng(4)
    dense = rng.integers(0, 9, (200, 4)).astype("uint8")
    tree = trees.Tree()
    tree.cover[0] = 200.0
    todo = [(0, np.arange(200), 0)]
    while todo:
        node, rows, depth = todo.pop()
        feature = int(rng.integers(4))
        least, most = (int(x) for x in (dense[rows, feature].min(), dense[rows, feature].max()))
        if depth < 8 and least < most:
            cut = int(rng.integers(least, most))
            low = dense[rows, feature] <= cut
            sides = tree.split(node, feature, cut, tuple(rng.normal(size=2)), (float(low.sum()), float((~low).sum())))
            todo += [(sides[0], rows[low], depth + 1), (sides[1], rows[~low], depth + 1)]
    tree, want, found = tree.arrays(), np.zeros((200, 4)), np.zeros((200, 4))
    assert any(len(p) < 4 for _, p in leaf_paths(tree)) and len(tree.feature) > 40
    for value, path in leaf_paths(tree):
        names = np.array(list(path))
        least, most, share = (np.array(x) for x in zip(*path.values()))
        known = ((dense[:, names] >= least) & (dense[:, names] <= most)).astype("float64")
        points, weights = np.polynomial.legendre.leggauss(4)
        points, weights = (points + 1) / 2, weights / 2
        factors = share * (1 - points[:, None, None]) + known * points[:, None, None]
        want[:, names] += value * (known - share) * np.einsum("q,qr,qrj->rj", weights, factors.prod(axis=2), 1 / factors)
    add_values(tree, dense, found)
    assert np.allclose(found, want, atol=1e-12)


def test_leaves_along_a_path_reach_the_rows_once():
    """A chain of splits: what its leaves give is handed down and added to each feature's column once."""

    class Counted(np.ndarray):
        def __setitem__(self, at, value):
            written.append(at)
            super().__setitem__(at, value)

    written, n = [], 8
    left = [2 * i + 1 for i in range(n)]  # a leaf each; the next split lies to the right
    feature = np.full(2 * n + 1, -1)
    lefts, rights = np.zeros(2 * n + 1, "int64"), np.zeros(2 * n + 1, "int64")
    nodes = [0, *(2 * i + 2 for i in range(n))]
    for i in range(n):
        feature[nodes[i]], lefts[nodes[i]], rights[nodes[i]] = i, left[i], nodes[i + 1]
    cover = np.ones(2 * n + 1)
    for i in reversed(range(n)):
        cover[nodes[i]] = cover[left[i]] + cover[nodes[i + 1]]
    tree = trees.Arrays(feature, np.zeros(2 * n + 1, "int64"), lefts, rights, np.arange(2 * n + 1) / 7, cover)
    dense = np.random.default_rng(1).integers(0, 2, (50, n)).astype("uint8")
    out = np.zeros((50, n)).view(Counted)
    add_values(tree, dense, out)
    assert len(written) == n
    wanted = tree.value[tree.leaves(dense)] - mean_value(tree)
    assert np.allclose(np.asarray(out).sum(axis=1), wanted)
