"""Shapley values of the features of tree models, by the paths of the trees.

What a tree gives when only some features are known is the mean over its leaves, in which an unknown split sends a row both ways by
the share of the training rows. A leaf then counts by a product with one factor for each feature on its path, and the mean over all orders
in which features become known is the integral of that product over the share of known features, a polynomial that few points give exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.models.trees import Arrays, BoostingModel, ForestModel, binned

#: Contributions that are added up at once: a column of rows for each feature.
OUT_BYTES = 192 << 20
MOST_ROWS, TOP_ROWS = 8_192, 256
OUT = "row_id long, rank int, feature string, contribution double"


def leaf_paths(tree: Arrays) -> Iterator[tuple[float, dict[int, tuple[int, int, float]]]]:
    """Each leaf's value, and for each feature on its path the bins (least, most) that lead to it and the share of the training
    rows that went the same way."""
    stack: list[tuple[int, dict]] = [(0, {})]
    while stack:
        node, path = stack.pop()
        feature = int(tree.feature[node])
        if feature < 0:
            yield float(tree.value[node]), path
            continue
        least, most, share = path.get(feature, (-1, 1 << 15, 1.0))
        cut = int(tree.bin[node])
        for child, bounds in ((tree.left[node], (least, min(most, cut))), (tree.right[node], (max(least, cut + 1), most))):
            stack.append((int(child), path | {feature: (*bounds, share * tree.cover[child] / tree.cover[node])}))


def mean_value(tree: Arrays) -> float:
    """The value when no feature is known."""
    return sum(value * float(np.prod([x[2] for x in path.values()])) for value, path in leaf_paths(tree))


def add_values(tree: Arrays, dense: np.ndarray, out: np.ndarray) -> None:
    """Add the Shapley values of binned rows to ``out``, a column for each feature. Both are best laid out by columns.

    What a leaf gives to a row depends only on which of the features on its path would send the row there. Rows that agree in this are
    counted as one: their patterns are refined at each split, the products carried down at the points of the integral, and each feature of
    a leaf's path takes its own factor out. Where a feature splits again, its new factor replaces the old one.
    """
    most = max((len(path) for _, path in leaf_paths(tree)), default=0)
    if not most or not len(dense):
        return
    points, weights = np.polynomial.legendre.leggauss((most + 1) // 2)
    points, weights = ((points + 1) / 2)[:, None], (weights / 2)[:, None]
    both = np.array([0.0, 1.0])
    factors = lambda share: share * (1 - points) + both * points  # noqa: E731  of patterns that do not go this way, and that do

    def refined(code: np.ndarray, patterns: int, now: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's new pattern, and for each of these the one it comes from and whether it goes this way."""
        fine = code * 2
        fine += now
        there = np.bincount(fine, minlength=2 * patterns) > 0
        kept = np.flatnonzero(there)
        return (np.cumsum(there) - 1)[fine], kept >> 1, (kept & 1).astype(bool)

    def of_leaf(node: int, products: np.ndarray, bits: np.ndarray, path: dict[int, tuple[int, int, float]]) -> np.ndarray:
        """What a leaf gives to each feature of its path, a row each, by pattern."""
        shares = np.array([x[2] for x in path.values()])[:, None]
        scaled, absent = float(tree.value[node]) * weights.T, shares * (1 - points.T)
        return np.where(bits, ((1 - shares) * scaled / (absent + points.T)) @ products, (-shares * scaled / absent) @ products)

    def below(node: int, code: np.ndarray, products: np.ndarray, bits: np.ndarray, path: dict, given: np.ndarray) -> None:
        """``code`` has each row's pattern; ``bits`` has a row for each feature of the path, in its order, and a column for each pattern, and so
        has ``given``, what leaves beside the path gave. It is handed on to one child and reaches the rows where no split is left."""
        feature = int(tree.feature[node])
        least, high, share = path.get(feature, (-1, 1 << 15, 1.0))
        place = list(path).index(feature) if feature in path else None
        bins, cut, parts = dense[:, feature], int(tree.bin[node]), []
        if place is None:  # rows go one way or the other: both children have the same patterns
            now, above, bit = refined(code, products.shape[1], bins <= cut)
            given = np.concatenate([given[:, above], np.zeros((1, len(above)))])
        for child, low, top in ((int(tree.left[node]), least, min(high, cut)), (int(tree.right[node]), max(least, cut + 1), high)):
            own = share * float(tree.cover[child] / tree.cover[node])
            if place is None:
                known = np.concatenate([bits[:, above], bit[None]])
                part = given
            else:
                now, above, bit = refined(code, products.shape[1], (bins >= low) & (bins <= top))
                known, part = bits[:, above], given[:, above]
                given = np.zeros_like(given)
            grown = products[:, above] * factors(own)[:, bit.astype("int64")]
            if place is not None:
                grown /= factors(share)[:, known[place].astype("int64")]
                known[place] = bit
            longer = path | {feature: (low, top, own)}
            if tree.feature[child] < 0:
                part += of_leaf(child, grown, known, longer)
            if place is not None or tree.feature[child] >= 0:
                parts.append((child, now, grown, known, longer, part))
            if place is None:
                bit = ~bit
        for i, (child, now, grown, known, longer, part) in enumerate(parts):
            if tree.feature[child] >= 0:
                below(child, now, grown, known, longer, np.zeros_like(part) if i and place is None else part)
            else:
                give(now, longer, part)
        if not parts:
            give(now, longer, given)

    def give(code: np.ndarray, path: dict, given: np.ndarray) -> None:
        for f, own in zip(path, given, strict=True):
            out[:, f] += own[code]

    start = np.zeros(len(dense), "int64")
    below(0, start, np.ones((len(points), 1)), np.zeros((0, 1), bool), {}, np.zeros((0, 1)))


def _largest(values: np.ndarray, ids: np.ndarray, names: list[str], k: int) -> pa.RecordBatch:
    size = np.round(np.abs(values), 9)
    top = np.argsort(-size, axis=1, kind="stable")[:, :k]
    row, rank = np.nonzero(np.take_along_axis(size, top, 1) > 0)
    feature = top[row, rank]
    columns = {
        "row_id": pa.array(ids[row]), "rank": pa.array((rank + 1).astype("int32")),
        "feature": pa.array([names[f] for f in feature], pa.string()), "contribution": pa.array(values[row, feature]),
    }
    return pa.RecordBatch.from_pydict(columns)


def tree_attributions(model: ForestModel | BoostingModel, df: DataFrame, names: list[str], k: int = 5) -> DataFrame:
    """The ``k`` largest Shapley values of each row (row_id, label, indices, values): row_id, rank, feature, contribution. Over all features
    they add up to the prediction minus its mean: the probability of a forest, the log-odds of boosting. Sizes are compared
    to nine digits, ties go to the lower feature, and features without any contribution are left out. One narrow pass."""
    scale = 1 / len(model.trees) if isinstance(model, ForestModel) else model.rate
    shared = df.sparkSession.sparkContext.broadcast((model.trees, model.bins, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from reviewlens.models.trees import _whole

        trees, bins, names = shared.value
        for batch in batches:
            step = min(MOST_ROWS, max(1, OUT_BYTES // (8 * max(1, len(bins)))))
            for at in range(0, batch.num_rows, step):
                chunk = _whole(batch.slice(at, step), bins)
                out = np.zeros((len(bins), len(chunk.ids))).T
                dense = np.asfortranarray(chunk.dense())
                for tree in trees:
                    add_values(tree, dense, out)
                for start in range(0, len(out), TOP_ROWS):
                    yield _largest(np.ascontiguousarray(out[start : start + TOP_ROWS]) * scale, chunk.ids[start : start + TOP_ROWS], names, k)

    return binned(df.withColumn("label", F.coalesce("label", F.lit(0))), model.bins).mapInArrow(run, OUT)
