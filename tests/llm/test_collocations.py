"""Operator 13 against counting in plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewlens.llm import collocations

SCHEMA = "lang string, text string"


def _brute(rows, longest=3, least=10, top=2000, percent=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    gone = {
        (lang, p[i : i + k])
        for (lang, p), a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
        if 100 * a >= percent * f[lang, p[i : i + k]]
    }
    out = {}
    for (lang, p), a in found.items():
        if (lang, p) not in gone:
            cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top])
    )


def _rows(seed=3, n=150):
    rng = random.Random(seed)
    bits = ["a ", "b\t", "A", "c d e f ", "é  ", ". ", "\n", " ", "x y z ", " ", "\r"]
    rows = [(rng.choice([None, "en", "und", "é"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 50)))) for _ in range(n)]
    return [*rows, (None, None), ("en", ""), *[("en", "one two three four five six. seven eight")] * 5, ("long", "w v " * 20_000)]


@pytest.mark.parametrize("longest, least, percent, top", [(2, 2, 50, 9), (3, 2, 50, 2000), (4, 2, 50, 50), (5, 3, 70, 1000)])
def test_collocations(spark, longest, least, percent, top):
    docs = spark.createDataFrame(_rows(), SCHEMA)
    for name in ("gram", "n", "phrase", "f", "rank", "path"):
        docs = docs.withColumn(name, F.lit("clash"))
    found = collocations.collocations(
        docs.repartition(3), max_words=longest, min_count=least, absorbed_percent=percent, top=top
    )
    assert sorted(tuple(r) for r in found.collect()) == _brute(_rows(), longest, least, top, percent)


def test_rare_words_that_pass_the_filter_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(_rows(), SCHEMA)
    everything = collocations.np.full(1 << (collocations.FILTER_BITS - 3), 255, "uint8")
    monkeypatch.setattr(collocations, "frequent_words", lambda rows, least: everything)
    found = collocations.collocations(docs, min_count=2)
    assert sorted(tuple(r) for r in found.collect()) == _brute(_rows(), 3, 2)


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_counts_are_exact(spark):
    a, big = 9 * 10**13 + 7, 9 * 10**14
    rows = [("x", "", 10**14), ("x", "p q", a), ("x", "p", big + 1), ("x", "q", big + 3)]
    row = collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, f long")).first()
    assert row.score == 10**6 * a * a // ((big + 1) * (big + 3))


def test_unary_paths_are_compact(spark):
    docs = spark.createDataFrame(_rows(), SCHEMA)
    counts = collocations.flows(collocations.edges(docs, 3, 2), 3, 2)
    paths = collocations.path_phrases(collocations.compact(counts, 3))
    rows = {(r.lang, r.phrase): (r.f, r.words) for r in paths.collect()}
    assert rows["en", "one two three four five six"] == (5, 6)
    edges = counts.where("phrase != ''").collect()
    assert sum(words - 2 for _, words in rows.values()) == sum(len(r.phrase.split(" ")) == 3 for r in edges)
