"""Operator 12: a Merkle tree over a table, whose parents keep the hash state before each child."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewlens.llm.common import ascii_lower
from reviewlens.storage import materialize

FANOUT = 16
#: Levels that one task builds at once: a block holds at most FANOUT ** LEVELS nodes.
LEVELS = 3
DIGEST = 64  # a digest as hex text is one block of the hash function
TAMPERED = 5
PARTITION_BITS = 33  # of monotonically_increasing_id, below the partition's number

NODES = "tree string, place long, size long, digest binary"
PATH = "array<struct<left: binary, right: binary>>"
PATH_TYPE = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


class Parent:
    """A node over at most ``FANOUT`` digests. It keeps a copy of the hash state before each of them, so that a changed
    child costs hashing of that child and of its right siblings only."""

    __slots__ = ("children", "digest", "states")

    def __init__(self, children: list[bytes]) -> None:
        self.children = b"".join(children)
        self.states = []
        state = sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def beside(self, slot: int) -> tuple[bytes, bytes]:
        """The left and the right siblings of a child."""
        return self.children[: DIGEST * slot], self.children[DIGEST * (slot + 1) :]

    def fold(self, slot: int, child: bytes) -> bytes:
        """The digest that the node would have with another child."""
        return resumed(self.states[slot], child, self.children[DIGEST * (slot + 1) :])


def resumed(state, child: bytes, right: bytes) -> bytes:
    state = state.copy()
    state.update(child)
    state.update(right)
    return state.hexdigest().encode()


def grown(digests: list[bytes], size: int, most: int) -> tuple[list[list[Parent]], list[bytes], int]:
    """The parents of a block level by level, what stays on top, and how many nodes its whole tree then has.
    ``size`` is how many it has now: up to ``most`` levels are built while a tree has several nodes, also over a single node."""
    levels: list[list[Parent]] = []
    while size > 1 and len(levels) < most:
        parents = [Parent(digests[i : i + FANOUT]) for i in range(0, len(digests), FANOUT)]
        levels.append(parents)
        digests, size = [p.digest for p in parents], -(-size // FANOUT)
    return levels, digests, size


def leaf_digest(text: Column | None = None) -> Column:
    """The leaf of a row of documents: the hash of its fields, each '-' if null, else its length in bytes, ':' and itself."""
    fields = [F.col(x).cast("string") for x in LEAF_FIELDS[:-1]] + [F.col("text") if text is None else text]
    parts = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in fields]
    return F.sha2(F.concat(*parts), 256)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds place (from 0) in the order of ``order`` within each tree, and size, the tree's number of rows. ``rows`` is a
    written table; it is dealt by ranges, so a tree of any size spreads over many tasks, also if all its keys are equal."""
    numbered = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = ["tree", *order, "tie"]
    spread = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    stored = materialize(spread.withColumn("part", F.shiftright("at", PARTITION_BITS)).drop("tie"), "placed")
    runs = stored.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    tree = W.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(
        "tree", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(tree).alias("size")
    )
    return stored.join(runs, ["tree", "part"]).withColumn("place", F.col("at") - F.col("first") + F.col("base")).drop(
        "at", "part", "first", "base"
    )


def _tops(levels: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        _, digests, size = grown(group["digest"].to_pylist(), group["size"][0].as_py(), levels)
        return pa.table({"tree": [key[0].as_py()], "place": [key[1].as_py()], "size": [size], "digest": digests})

    return run


def _siblings(levels: list[list[Parent]], at: int) -> Iterator[tuple[bytes, bytes]]:
    for parents in levels:
        yield parents[at // FANOUT].beside(at % FANOUT)
        at //= FANOUT


def _paths(levels: int):
    def run(group: pa.Table, above: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        parents, _, _ = grown(group["digest"].to_pylist(), group["size"][0].as_py(), levels)
        upper = [(x["left"], x["right"]) for x in above["path"][0].as_py()]
        paths = [[{"left": a, "right": b} for a, b in [*_siblings(parents, i), *upper]] for i in range(len(group))]
        same = {x: pa.repeat(above[x][0], len(group)) for x in ("subroot", "root")}
        return pa.table({"tree": group["tree"], "block": group["place"], "path": pa.array(paths, PATH_TYPE), **same})

    return run


PATHS = f"tree string, block long, path {PATH}, subroot string, root string"


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"place div {FANOUT**levels}"))


def grow(leaves: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The tables (tree, place, size, digest) of the nodes of many trees, each ``levels`` levels above the one before, from the
    leaves to one node a tree. ``leaves`` is a written table. A task works on blocks of at most ``FANOUT ** levels`` nodes, so
    time and memory of a task do not depend on the size of a tree. A tree that is complete is carried on unchanged."""
    tables = [leaves.select("tree", "place", "size", "digest")]
    size = leaves.agg(F.max("size")).first()[0] or 0
    while size > 1:
        raised = _blocks(tables[-1], levels).groupBy("tree", "block").applyInArrow(_tops(levels), NODES)
        tables.append(materialize(raised, "nodes"))
        size = -(-size // FANOUT**levels)
    return tables


def descend(tables: list[DataFrame], above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """From the paths above the tops of trees (tree, block 0, path, subroot, root) those above each block of leaves."""
    for nodes in reversed(tables[1:]):
        groups = _blocks(nodes, levels).groupBy("tree", "block")
        above = materialize(groups.cogroup(above.groupBy("tree", "block")).applyInArrow(_paths(levels), PATHS), "paths")
    return above


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proved(levels: int):
    def run(group: pa.Table, above: pa.Table) -> pa.Table:
        """One block of leaves with the path above it."""
        group = group.sort_by("place")
        leaves = group["digest"].to_pylist()
        rows, _, _ = grown(leaves, group["size"][0].as_py(), levels)
        path = [(x["left"], x["right"]) for x in above["path"][0].as_py()]
        upper = b"".join(a + b for a, b in path)
        states = [(sha256(left), right) for left, right in path]
        root = above["root"][0].as_py()
        proofs, folded = [], []
        for i, (leaf, other) in enumerate(zip(leaves, group["replacement"].to_pylist(), strict=True)):
            proof, digest, at = sha256(), other or leaf, i
            for parents in rows:
                parent, slot = parents[at // FANOUT], at % FANOUT
                for siblings in parent.beside(slot):
                    proof.update(siblings)
                digest, at = parent.fold(slot, digest), at // FANOUT
            proof.update(upper)
            for state, right in states:
                digest = resumed(state, digest, right)
            proofs.append(proof.hexdigest())
            folded.append(digest.decode())
        columns = {
            "doc_id": group["doc_id"],
            "leaf": [x.decode() for x in leaves],
            "subroot": pa.repeat(above["subroot"][0], len(leaves)),
            "root": pa.repeat(above["root"][0], len(leaves)),
            "proof_sha256": proofs,
            "folded_root": folded,
            "verified": [x == root for x in folded],
        }
        return pa.table(columns)

    return run


def manifest(leaves: DataFrame, levels: int = LEVELS) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """The trees of a table of leaves (source, doc_id, digest, replacement): the node tables of all sources' trees, those of the tree
    over the sources' tops, and the placed leaves. Leaves ascend by doc_id (null first; among equal ones by digest), sources
    by their bytes (null first)."""
    keyed = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))).drop("source")
    stored = materialize(placed(materialize(keyed, "leaves"), ["doc_id", "digest"]), "leaves")
    by_source = grow(stored, levels)
    tops = materialize(by_source[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), "subroots")
    subroots = materialize(placed(tops, ["source"]), "subroots")
    return by_source, [subroots, *grow(subroots, levels)[1:]], stored


def prove(leaves: DataFrame, *, levels: int = LEVELS) -> DataFrame:
    """A proof for each leaf (source, doc_id, digest, replacement), and the root recomputed with its replacement (null: itself).

    Returns doc_id, leaf, subroot, root, proof_sha256 (the hash of all siblings from the leaf to the root), folded_root, verified
    (folded_root equals root). Folding resumes, level by level, the state kept before the leaf's slot. An empty table gives no rows;
    a lone leaf is its source's subroot and a lone subroot the root; repeated rows are leaves of their own.
    """
    by_source, over, stored = manifest(leaves, levels)
    summit = over[-1].select(
        "tree", F.col("place").alias("block"), F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"),
        F.col("digest").cast("string").alias("root"),
    )
    blocks = descend(over, summit, levels)
    named = _blocks(over[0], levels).groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block"))
    paths = descend(by_source, materialize(named.applyInArrow(_source_paths(levels), PATHS), "paths"), levels)
    groups = _blocks(stored, levels).groupBy("tree", "block")
    return groups.cogroup(paths.groupBy("tree", "block")).applyInArrow(_proved(levels), RESULT)


def _source_paths(levels: int):
    def run(group: pa.Table, above: pa.Table) -> pa.Table:
        """The paths above the subroots, each under the name of its own tree."""
        group = group.sort_by("place")
        found = _paths(levels)(group, above)
        subroots = group["digest"].cast(pa.string())
        first = pa.array([0] * len(group), pa.int64())
        return pa.table({"tree": group["source"], "block": first, "path": found["path"], "subroot": subroots, "root": found["root"]})

    return run


def document_leaves(docs: DataFrame) -> DataFrame:
    """The leaves of documents (doc_id, source, lang, n_chars, text), with a replacement for one document in ``TAMPERED``, by the
    crc32 of its doc_id: that of its text with A-Z in lower case. Other columns are ignored; a null doc_id is not replaced."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        leaf_digest().cast("binary").alias("digest"),
        F.when(chosen, leaf_digest(ascii_lower(F.col("text")))).cast("binary").alias("replacement"),
    )


def document_proofs(docs: DataFrame, *, levels: int = LEVELS) -> DataFrame:
    return prove(document_leaves(docs), levels=levels)
