"""Operator 11 against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewlens.llm import sentence_pieces

SCHEMA = "doc_id long, text string"
TEXTS = [
    None, "", " ", "   a  b ", "a\tb\n\nc \n x", "▁▁x ▁", "🙂🙂 x é́ 日本語テキスト", "<s> </s> <unk> <0x0A>",
    " " * 100 + "x" + " " * 37, "a\x00b", "İstanbul ΣΑΣ\r\n\x0b", "x" * 30_000, "the end. " * 9_000, "�▁",
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.pieces(sentence_pieces.default_model())


def _merged(text, scores):
    """Merging in the plain way: the highest score first, the leftmost among equal ones."""
    symbols = list(text)
    while True:
        pairs = [(-scores[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in scores]
        if not pairs:
            return symbols
        _, i = min(pairs)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def test_table_gives_what_merging_gives_with_any_scores():
    rng = random.Random(5)
    for _ in range(60):
        words = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(12)}
        names = [*"ab", *sorted(words)]  # c is no piece of its own
        pieces = {x: (i, float(rng.randint(-8, 0))) for i, x in enumerate(names)}
        table = sentence_pieces.PrefixTable(pieces)
        scores = {x: s for x, (_, s) in pieces.items()}
        for _ in range(40):
            text = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 14)))
            wanted = [pieces[x][0] if x in pieces else -1 - ord(x) for x in _merged(text, scores)]
            assert table.tokens(text) == wanted, (pieces, text)


def test_encoding_and_decoding_equal_the_library(pieces, library):
    rng = random.Random(1)
    texts = [x or "" for x in TEXTS] + [" " * i for i in range(60)]
    texts += ["".join(rng.choice(" ▁abtheinré日🙂\n.\t0") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    ids = pieces.encode(pa.array(texts)).to_pylist()
    assert ids == library.encode(texts, num_threads=1)
    assert pieces.decode(pa.array(ids, pa.list_(pa.int32()))).to_pylist() == [library.decode(x) for x in ids]


def test_decoding_of_any_ids(pieces, library):
    rng = np.random.default_rng(1)
    lists = [rng.integers(0, 262 if i % 2 else 32_000, rng.integers(0, 9)).tolist() for i in range(6000)]
    assert pieces.decode(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == [library.decode(x) for x in lists]
    with pytest.raises(IndexError):
        pieces.decode(pa.array([[32_000]], pa.list_(pa.int32())))
    with pytest.raises(IndexError):
        pieces.decode(pa.array([[-1]], pa.list_(pa.int32())))


def test_documents(spark, library):
    rows = [(i % 9 or None, x) for i, x in enumerate([*TEXTS, *TEXTS])]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit("clash")).withColumn("batch", F.lit(1)).repartition(3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    wanted = []
    for doc, text in rows:
        ids = library.encode(text or "")
        wanted.append((doc or -1, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    got = [(r[0] or -1, *r[1:]) for r in sentence_pieces.piece_digest(docs).collect()]
    assert sorted(got) == sorted(wanted)
    assert sentence_pieces.piece_digest(docs.limit(0)).collect() == []


def test_round_trip(spark):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS) if "▁" not in (x or "")], SCHEMA)
    back = sentence_pieces.decode_documents(sentence_pieces.encode_documents(docs))
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.text or "" for r in docs.collect()}
