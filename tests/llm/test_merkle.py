"""Operator 12 against a plain tree."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from reviewlens.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def _hash(raw):
    return sha256(raw).hexdigest().encode()


def _leaf(row, text):
    fields = ["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (*row[:4], text)]
    return _hash("".join(fields).encode())


def _levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_hash(b"".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def _brute(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, _leaf(row, row[4]), row))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for rows_of in trees.values():
        rows_of.sort(key=lambda x: x[:3])
    grown = {s: _levels([x[2] for x in trees[s]]) for s in names}
    over = _levels([grown[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, leaf, row) in enumerate(trees[s]):
            folded, proof = leaf, b""
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                folded = _leaf(row, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4]))
            for levels, at in ((grown[s], i), (over, k)):
                for level in levels[:-1]:
                    run, slot = level[at // 16 * 16 : at // 16 * 16 + 16], at % 16
                    proof += b"".join(run[:slot] + run[slot + 1 :])
                    folded = _hash(b"".join([*run[:slot], folded, *run[slot + 1 :]]))
                    at //= 16
            root = over[-1][0]
            out.append((row[0], leaf.decode(), grown[s][-1][0].decode(), root.decode(), _hash(proof).decode(), folded.decode(), folded == root))
    return out


def _key(row):
    return tuple((x is not None, x) for x in row)


def _check(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("tree", "place", "size", "digest", "replacement"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = [tuple(r) for r in merkle.document_proofs(docs.repartition(3), **options).collect()]
    assert sorted(got, key=_key) == sorted(_brute(rows), key=_key)
    return got


def test_small_trees(spark):
    assert merkle.document_proofs(spark.createDataFrame([], SCHEMA)).collect() == []
    _check(spark, [(1, None, None, None, None)])
    rows = [
        (None, "a", "x", 1, "AB"), (5, None, None, None, None), (5, None, None, None, None), (5, "", "é", 3, "É B"),
        (2, "a", None, 0, ""), (7, "é", "", 2, "X" * 100_000), (7, "z", "", 2, "Ab"), *[(i % 30, "b", "y", i % 2, "Zz") for i in range(40)],
    ]
    got = _check(spark, rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_trees_of_every_depth_over_many_sources(spark):
    rows = [(i, "deep", "x", i, "Text") for i in range(300)] + [(i, f"s{i % 19}", "x", i, "Text") for i in range(19 * 17)]
    _check(spark, rows, levels=1)


def test_trees_beyond_one_block(spark):
    _check(spark, [(i, "deep", "x", i, f"Text {i}") for i in range(4_200)])


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    got = [tuple(r) for r in merkle.document_proofs(docs).collect()]
    assert sorted(got) == sorted(_brute([tuple(r) for r in docs.collect()]))


@pytest.mark.parametrize("n", [1, 2, 16])
def test_fold_resumes_the_state_before_the_slot(n):
    children = [_hash(bytes([i])) for i in range(n)]
    parent = merkle.Parent(children)
    assert parent.digest == _hash(b"".join(children))
    for slot in range(n):
        other = _hash(b"other")
        assert parent.fold(slot, other) == _hash(b"".join([*children[:slot], other, *children[slot + 1 :]]))
        assert parent.fold(slot, children[slot]) == parent.digest
        assert parent.states[slot].hexdigest() == sha256(b"".join(children[:slot])).hexdigest()
