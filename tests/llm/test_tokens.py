"""Operators 2, 3 and 6 against brute force."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewlens.llm import packing, token_counts, token_files
from reviewlens.llm.tokens import ChunkEncoder, default_vocabulary
from reviewlens.storage import scratch_path

TEXTS = [
    (5, "The quick brown fox's den.\nÉtude\t nº 5 <|endoftext|>"),
    (3, None),
    (1, ""),
    (3, "aaa bbb"),
    (None, " \n\n "),
    (3, "aaa bbb"),
    (9, "word " * 5000),
    (7, "́x é   İstanbul ΣΑΣ 12345 🙂🙂 x" + "y" * 3000),
]
SCHEMA = "doc_id long, text string"


def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def _ids(text):
    return _tokenizer().encode(text or "", add_special_tokens=False).ids


def _crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def _docs(spark, rows=None):
    docs = spark.createDataFrame(TEXTS if rows is None else rows, SCHEMA)
    return docs.withColumn("ids", F.lit("clash")).withColumn("part", F.lit(1.5))


def test_chunks_encode_as_whole_texts():
    texts = [t for _, t in TEXTS]
    ids, bounds = ChunkEncoder(default_vocabulary()).encode(pa.array(texts), 7)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [[*_ids(t), 7] for t in texts]


def test_chunks_of_any_characters_encode_as_whole_texts():
    rng = np.random.default_rng(4)
    bits = [*"aBc'’.,;12 \n\t\r-<|>é́ẞİΣσ🙂日", "'s", "'LL", "don't", "<|endoftext|>", "<|EndOfText|>", "The", "x1.5e-3", "\u00a0", "it's."]
    texts = ["".join(rng.choice(bits, rng.integers(0, 25))) for _ in range(3000)]
    plain = [t for t in texts if "<|" not in t]
    for some in (texts, plain):
        ids, bounds = ChunkEncoder(default_vocabulary()).encode(pa.array(some), 7)
        coded = _tokenizer().encode_batch(some, add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [[*e.ids, 7] for e in coded]


def test_token_files_round_trip(spark):
    path = scratch_path(spark, "files")
    token_files.write_token_files(_docs(spark).repartition(3), path)
    read = token_files.read_token_files(spark, path).collect()
    assert sorted((r.doc_id or -1, r.ids) for r in read) == sorted((d or -1, [*_ids(t), 2]) for d, t in TEXTS)
    rows = sorted(token_files.token_file_digest(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d for d, _ in TEXTS), key=lambda d: (d is not None, d or 0))
    at = 0
    for row in rows:
        assert row.start == at
        at += row.n_tokens
    assert sorted(r.ids_crc32 for r in rows) == sorted(_crc([*_ids(t), 2]) for _, t in TEXTS)


def test_token_files_are_pruned_by_document(spark):
    path = scratch_path(spark, "files")
    token_files.write_token_files(_docs(spark), path)
    some = token_files.read_token_files(spark, path, F.col("doc_id") == 5)
    assert [r.ids for r in some.collect()] == [[*_ids(TEXTS[0][1]), 2]]
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in some._jdf.queryExecution().toString()


def test_empty_tables(spark):
    path = scratch_path(spark, "files")
    token_files.write_token_files(_docs(spark, []), path)
    assert token_files.token_file_digest(spark, path).collect() == []
    assert packing.pack_documents(_docs(spark, [])).collect() == []
    assert token_counts.token_counts(_docs(spark, [])).collect() == []


def test_packing_holds_every_token_once(spark):
    rows = packing.pack_documents(_docs(spark), capacity=64, group_pieces=50).collect()
    wanted = []
    for doc, text in TEXTS:
        ids = [*_ids(text), 0]
        wanted += [(doc or -1, i // 64, i, len(ids[i : i + 64]), _crc(ids[i : i + 64])) for i in range(0, len(ids), 64)]
    assert sorted((r.doc_id if r.doc_id is not None else -1, *r[1:5]) for r in rows) == sorted(wanted)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_respects_every_capacity_and_is_close_to_the_bound(rule):
    rng = np.random.default_rng(1)
    length = rng.integers(1, 2048, 3000).astype("float64")
    demands = np.stack([length, np.ones_like(length), length**2], axis=1)
    capacities = np.array([2048.0, 5.0, 3e6])
    bins = packing.best_fit(demands, capacities, np.array([1.0, 0.01, 0.01]), rule)
    for k in range(3):
        load = np.bincount(bins, demands[:, k])
        alone = np.bincount(bins) == 1
        assert ((load <= capacities[k] + 1e-6) | alone).all()
    loose = packing.best_fit(demands[:, :1], capacities[:1], np.ones(1), rule)
    assert loose.max() + 1 <= 1.03 * length.sum() / 2048 + 1


def test_sequences_hold_the_packed_ids(spark):
    docs = _docs(spark, [(i, "a b c " * i) for i in range(1, 30)])
    packed = packing.pack_documents(docs, capacity=64)
    out = packing.sequences(docs, packed, capacity=64).collect()
    assert sum(len(r.ids) for r in out) == sum(len(_ids("a b c " * i)) + 1 for i in range(1, 30))
    assert max(len(r.ids) for r in out) <= 64


def test_packing_under_binding_document_and_attention_capacities(spark):
    docs = _docs(spark, [(i, "a b c " * (i % 9)) for i in range(80)])
    rows = packing.pack_documents(docs, capacity=64, documents=3, attention=900.0).collect()
    assert sorted(r.doc_id for r in rows) == list(range(80))
    loads = {}
    for r in rows:
        loads.setdefault(r.sequence_id, []).append(r.length)
    assert all(sum(x) <= 64 and len(x) <= 3 and (len(x) == 1 or sum(n * n for n in x) <= 900) for x in loads.values())
    assert max(map(len, loads.values())) == 3 and max(sum(x) for x in loads.values()) < 64


def _greedy(word, pieces):
    at = count = 0
    while at < len(word):
        size = next((n for n in range(len(word) - at, 0, -1) if tuple(word[at : at + n]) in pieces), 0)
        if not size:
            return 1
        at, count = at + size, count + 1
    return count


def test_automaton_counts_as_greedy_matching():
    rng = np.random.default_rng(2)
    for _ in range(200):
        pieces = {tuple(rng.integers(0, 3, rng.integers(1, 5))) for _ in range(8)}
        machine = token_counts.LongestMatch(pieces)
        for _ in range(30):
            word = tuple(rng.integers(0, 3, rng.integers(1, 12)))
            assert machine.count(word) == _greedy(word, pieces)


def test_token_counts(spark):
    import json

    vocabulary = json.load(open(default_vocabulary(), encoding="utf-8"))["model"]["vocab"]
    symbols = token_counts.byte_symbols()
    pieces = set()
    for p in vocabulary:
        body = p.removesuffix("</w>")
        if body and all(c in symbols for c in body):
            pieces.add((*(symbols[c] for c in body), *[256] * (body != p)))
    spaced = (11, "hello\tworld\r\ngood\u00a0morning\u3000to\x0byou")
    texts = [*TEXTS, spaced]
    rows = {(r.doc_id, r.n_words, r.n_tokens) for r in token_counts.token_counts(_docs(spark, texts)).collect()}
    assert (11, 6, 6) in rows
    words = lambda t: (t or "").lower().split()
    short = [(d, t) for d, t in texts if len(t or "") < 1000]
    for d, t in short:
        assert (d, len(words(t)), sum(_greedy((*w.encode(), 256), pieces) for w in words(t))) in rows
