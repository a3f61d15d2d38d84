"""Operator 5: near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import arrow_by_bytes, components
from reviewlens.storage import materialize

COSINE = 0.9
PASSES = 32
HASH_BITS = 48
WINDOW = 64
RECALL = 0.97
ROUND = 4096
CELL_ROWS = 4096
CELL_BYTES = 16 << 20


def _units(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)


def _keys(passes: int, seed: int):
    """The pass keys of each vector: signs of ``HASH_BITS`` random projections per pass, first projection highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(HASH_BITS - 1, -1, -1)).astype("int64")
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy()
            keys: list = [None] * batch.num_rows
            for size in np.unique(sizes):
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).standard_normal((passes, size, HASH_BITS))
                at = np.flatnonzero(sizes == size)
                units = _units(_matrix(batch.column("vector").take(pa.array(at))))
                signs = np.stack([(units @ p > 0) @ weights for p in planes[size]], axis=1)
                for i, row in zip(at, signs, strict=True):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(keys, pa.list_(pa.int64()))], names=["node", "size", "vector", "keys"]
            )

    return run


def _near(nodes: np.ndarray, groups: np.ndarray, units: np.ndarray, new: int, window: int, cosine: float) -> list[tuple]:
    """Linked pairs of rows at most ``window`` apart whose later row is one of the last ``new``."""
    out, n = [], len(nodes)
    for d in range(1, min(window, n - 1) + 1):
        low = max(0, n - new - d)
        a, b = slice(low, n - d), slice(low + d, n)
        cos = np.einsum("ij,ij->i", units[a], units[b])
        hit = np.flatnonzero((cos >= cosine) & (groups[a] == groups[b]))
        out.append((nodes[a][hit], nodes[b][hit]))
    return out


def _miss(cosine: float, bits: int) -> float:
    """Log of the chance that two vectors of that cosine differ in the first ``bits`` signs of a pass."""
    return math.log1p(-((1 - math.acos(cosine) / math.pi) ** bits)) if bits > 0 else -math.inf


def _plan(n: int, cosine: float, passes: int, window: int) -> tuple[int, int]:
    """The leading signs that ``window`` of n evenly spread rows share at most, and the passes, at least ``passes``, in which
    a pair at the threshold agrees in that many with a chance of ``RECALL``."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / window))) + 1
    return bits, max(passes, math.ceil(math.log(1 - RECALL) / _miss(cosine, bits)))


def _crowded(nodes: np.ndarray, groups: np.ndarray, keys: np.ndarray, new: int, window: int, bits: int) -> tuple:
    """(node, pass, signs) of the rows that share ``bits`` leading signs or more with the row ``window`` places away: what agrees in one
    sign more with such a row is met, what agrees in fewer may not be. The later row is one of the last ``new``."""
    n = len(nodes)
    low = max(0, n - new - window)
    a, b = slice(low, max(low, n - window)), slice(low + window, max(low + window, n))
    shared = HASH_BITS - np.frexp((keys[a] ^ keys[b]).astype("float64"))[1]
    at = np.flatnonzero((shared >= bits) & (groups[a] == groups[b]))
    return np.concatenate([nodes[a][at], nodes[b][at]]), np.tile(groups[a][at], 2), np.tile(shared[at], 2)


def _windows(window: int, cosine: float, bits: int):
    """Pairs within each sorted partition, its crowded rows (with the signs as place and no part), and the partition's first and
    last rows for the windows across borders."""
    names = ["a", "b", "part", "place", "grp", "key", "vector"]

    def pairs(found: list[tuple]) -> pa.RecordBatch:
        a, b = (np.concatenate([x[i] for x in found]) if found else np.empty(0, "int64") for i in (0, 1))
        low, high = np.minimum(a, b), np.maximum(a, b)
        frame = pd.DataFrame({"a": low, "b": high}).drop_duplicates()
        none = [pa.nulls(len(frame), k) for k in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays([pa.array(frame["a"]), pa.array(frame["b"]), *none], names=names)

    def crowds(nodes, turns, signs) -> pa.RecordBatch:
        n = len(nodes)
        arrays = [pa.array(nodes, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(signs, pa.int32())]
        arrays += [pa.array(turns, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def border(nodes, groups, units, keys, part: int, first: int) -> pa.RecordBatch:
        n = len(nodes)
        arrays = [pa.array(nodes, pa.int64()), pa.nulls(n, pa.int64()), pa.array([part] * n, pa.int32())]
        arrays += [pa.array(range(first, first + n), pa.int32()), pa.array(groups, pa.int64()), pa.array(keys, pa.int64())]
        arrays += [pa.array(list(units), pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tail: tuple | None = None
        head = 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROUND):
                batch = whole.slice(at, ROUND)
                for size in pa.compute.unique(batch.column("size")).to_pylist():  # sorted by size: mostly one
                    own = batch.filter(pa.compute.equal(batch.column("size"), size))
                    nodes, groups = own.column("node").to_numpy(), own.column("grp").to_numpy()
                    units, keys = _units(_matrix(own.column("vector"))), own.column("key").to_numpy()
                    if head < window:
                        yield border(*(x[: window - head] for x in (nodes, groups, units, keys)), part, head)
                        head += min(window - head, len(nodes))
                    new = len(nodes)
                    if tail is not None and tail[2].shape[1] == units.shape[1]:
                        both = zip(tail, (nodes, groups, units, keys), strict=True)
                        nodes, groups, units, keys = (np.concatenate(x) for x in both)
                    yield pairs(_near(nodes, groups, units, new, window, cosine))
                    yield crowds(*_crowded(nodes, groups, keys, new, window, bits))
                    tail = (nodes[-window:], groups[-window:], units[-window:], keys[-window:])
        if tail is not None:
            yield border(*tail, part, -len(tail[0]))

    return run


def _across(window: int, cosine: float, bits: int):
    """Pairs between the last rows of a partition and the first rows of the next, and the crowded rows (b is null)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["part", "place"])
        before, after = frame[frame["place"] < 0], frame[frame["place"] >= 0]
        found, crowd = [], ([], [], [])
        if len(before) and len(after) and len(before["vector"].iloc[-1]) == len(after["vector"].iloc[0]):
            size = len(after["vector"].iloc[0])
            both = pd.concat([before, after])
            both = both[both["vector"].map(len) == size]
            new = int((both["place"] >= 0).sum())
            nodes, groups = both["a"].to_numpy(), both["grp"].to_numpy()
            found = _near(nodes, groups, np.stack(both["vector"]), new, window, cosine)
            crowd = _crowded(nodes, groups, both["key"].to_numpy().astype("int64"), new, window, bits)
        a, b = (np.concatenate([x[i] for x in found]) if found else np.empty(0, "int64") for i in (0, 1))
        linked = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()
        crowded = pd.DataFrame(dict(zip(("a", "grp", "place"), crowd, strict=True)))
        kinds = {"a": "Int64", "b": "Int64", "place": "Int32", "grp": "Int64"}
        return pd.concat([f.reindex(columns=list(kinds)).astype(kinds) for f in (linked, crowded)])

    return run


def _forest(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and the columns of a matrix of links, the first row that links lead to; -1 for a column without."""
    row, col = np.full(hits.shape[0], -1), np.full(hits.shape[1], -1)
    for x in range(len(row)):
        if row[x] >= 0:
            continue
        row[x], front = x, np.array([x])
        while len(front):
            cols = np.flatnonzero(hits[front].any(axis=0) & (col < 0))
            col[cols] = x
            front = np.flatnonzero(hits[:, cols].any(axis=1) & (row < 0))
            row[front] = x
    return row, col


def _compared(cosine: float):
    """All links of a cell, between its two stripes or within its one: (node, other, n), n the copies of what a node links with and other
    a node that these links lead to, so that the rows connect what the links connect."""

    def run(rows: pa.Table) -> pa.Table:
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        nodes, copies, stripes = (rows.column(c).to_numpy() for c in ("node", "copies", "stripe"))
        units = _units(_matrix(rows.column("vector").combine_chunks()))
        a, b = np.flatnonzero(stripes == i), np.flatnonzero(stripes == j)
        hits = np.zeros((len(a), len(b)), dtype=bool)
        for at in range(0, len(a), 512):
            hits[at : at + 512] = units[a[at : at + 512]] @ units[b].T >= cosine
        if i == j:
            np.fill_diagonal(hits, False)
        row, col = _forest(hits)
        n = np.zeros(len(nodes), dtype="int64")
        for at in range(0, len(a), 512):
            part = hits[at : at + 512]
            n[a[at : at + 512]] += (part @ copies[b].astype("float64")).astype("int64")
            if i != j:
                n[b] += (copies[a[at : at + 512]].astype("float64") @ part).astype("int64")
        other = nodes.copy()
        other[a] = nodes[a[row]]
        if i != j and len(a):
            other[b] = np.where(col < 0, nodes[b], nodes[a[col]])
        keep = n > 0
        return pa.table({"node": pa.array(nodes[keep]), "other": pa.array(other[keep]), "n": pa.array(n[keep])})

    return run


def crowded_links(crowded: DataFrame, *, cosine: float = COSINE) -> DataFrame:
    """(node, other, n), several rows a node, of all links among the vectors (node, copies, vector), each compared with each: n adds up to the
    copies of the vectors that a node links with, and (node, other) connects what the links connect. The vectors of a
    length are cut into stripes of a bounded size, and each two stripes meet in a cell."""
    sized = crowded.withColumn("size", F.size("vector"))
    fit = F.greatest(F.lit(1), F.least(F.lit(CELL_ROWS), F.floor(F.lit(CELL_BYTES) / (8 * F.col("size")))))
    stripes = sized.groupBy("size").agg(F.count("*").alias("rows")).select("size", F.ceil(F.col("rows") / fit).cast("int").alias("stripes"))
    rows = sized.join(stripes, "size").withColumn("stripe", F.pmod(F.xxhash64("node"), "stripes").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)))
    cells = rows.select("size", F.least("stripe", "other").alias("i"), F.greatest("stripe", "other").alias("j"), "stripe", "node", "copies", "vector")
    return cells.groupBy("size", "i", "j").applyInArrow(_compared(cosine), "node long, other long, n long")


def linked_pairs(
    nodes: DataFrame, *, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW, seed: int = 7
) -> tuple[DataFrame, DataFrame]:
    """(a, b), a < b, of distinct vectors (node, vector) that meet in a window of some pass and have at least that cosine; and (node) of
    the vectors that lie dense: those with more than half a window of links, and those for which a link at the threshold is
    met with an estimated chance under ``RECALL``, going by the signs that fill their window in each pass."""
    bits, passes = _plan(nodes.count(), cosine, passes, window)
    arrow_by_bytes(nodes.sparkSession)
    kind = nodes.schema["vector"].dataType.simpleString()
    sized = nodes.select("node", F.size("vector").alias("size"), "vector")
    keyed = sized.mapInArrow(_keys(passes, seed), f"node long, size int, vector {kind}, keys array<long>")
    rows = keyed.select("node", "size", "vector", F.posexplode("keys").alias("turn", "key"))
    order = ["size", "turn", "key", "node"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = dealt.select("node", "size", F.col("turn").cast("long").alias("grp"), "key", "vector").mapInArrow(
        _windows(window, cosine, bits), "a long, b long, part int, place int, grp long, key long, vector array<double>"
    )
    found = materialize(found, "windows")
    borders = found.where("b IS NULL AND part IS NOT NULL").withColumn("cut", F.when(F.col("place") < 0, F.col("part")).otherwise(F.col("part") - 1))
    across = borders.groupBy("cut").applyInPandas(_across(window, cosine, bits), "a long, b long, place int, grp long")
    met = found.where("part IS NULL").select("a", "b", "place", "grp").union(across)
    signs = met.where("b IS NULL").groupBy("a", "grp").agg(F.max("place").alias("signs"))
    more = F.element_at(F.array(*[F.lit(_miss(cosine, k) - _miss(cosine, bits)) for k in range(1, HASH_BITS + 2)]), F.col("signs") + 1)
    bound = math.log(1 - RECALL) - passes * _miss(cosine, bits)
    crowded = signs.groupBy(F.col("a").alias("node")).agg(F.sum(more).alias("more")).where(F.col("more") > bound + 1e-9)
    pairs = materialize(met.where("b IS NOT NULL").select("a", "b").distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    many = ends.groupBy("node").count().where(F.col("count") > window // 2)
    return pairs, materialize(crowded.select("node").union(many.select("node")).distinct(), "crowded")


def near_vectors(
    vectors: DataFrame, *, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW, seed: int = 7
) -> DataFrame:
    """Groups of vectors (vec_id, embedding) linked by a cosine of at least ``cosine``.

    Equal vectors are one node. In each of ``passes`` passes, or more if a table of that many nodes needs them, the nodes are ordered by the concatenated signs of
    random projections, and each is compared, in double precision, with the ``window`` nodes after it; pairs of all
    passes are united. A pass is dealt by ranges of its order, so equal keys can be split; windows across borders
    are compared from the partitions' first and last rows. Nodes with more than half a window of links, and those whose
    windows are too full for an estimated recall of ``RECALL`` at the threshold, are compared with each other in full.

    Returns vec_id, n_links (other rows linked directly, among the pairs found), component_id (least vec_id that links
    lead to, itself included), kept (vec_id = component_id). Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, as do vectors of different length; a null vec_id never names a
    group unless it has no other id; repeated rows are copies of each other; an empty table gives no rows; other
    columns are ignored.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))  # null and NaN are not
    usable = x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0)
    plain = F.transform(x, lambda v: v + F.lit(0).cast("float"))  # one zero
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, plain).alias("vector"))
    rows = rows.withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))
    counted = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("vector").alias("vector")
    )
    nodes = materialize(counted, "vectors")
    pairs, crowded = linked_pairs(nodes.select("node", "vector"), cosine=cosine, passes=passes, window=window, seed=seed)
    whole = materialize(crowded_links(nodes.select("node", "copies", "vector").join(crowded, "node"), cosine=cosine), "crowded-links")
    labels = components(pairs.union(whole.select("node", "other")))
    met, dense = pairs, crowded.withColumn("dense", F.lit(True))
    for end in ("a", "b"):
        met = met.join(dense.toDF(end, f"dense_{end}"), end, "left")
    pairs = met.where("dense_a IS NULL OR dense_b IS NULL").select("a", "b")
    sizes = nodes.select("node", "copies")
    both = pairs.union(pairs.select("b", "a")).toDF("node", "other")
    links = both.join(sizes.toDF("other", "n"), "other").select("node", "n").union(whole.select("node", "n"))
    links = links.groupBy("node").agg(F.sum("n").alias("others"))
    named = nodes.drop("vector").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    out = materialize(
        named.join(links, "node", "left").join(least, "component").select(
            "node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"
        ),
        "nodes",
    )
    return rows.drop("vector").join(out, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
