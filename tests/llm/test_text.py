"""Operators 1, 8 and 10, and the pipeline."""

import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reviewlens.llm import language, licenses, packing, personal

DATA = "/root/testdata/sf0.001"


def _docs(spark, rows):
    docs = spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, lang string")
    return docs.withColumn("key", F.lit("clash")).withColumn("score", F.lit("clash"))


def test_licenses(spark):
    mit = licenses.TEMPLATES[4][1]
    rows = [
        (1, "Intro.\nLICENSED under the apache license - version 2.0!\nMore."),
        (2, "Some words.\n\n" + mit.replace("free of charge", "free of any charge").replace(". ", ".\n") + "\n\nEnd."),
        (3, "The license of this text is not said."),
        (4, None), (5, ""), (None, "Released under the MIT License."), (6, "x" * 100_000),
        (7, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (7, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."),
    ]
    # In document 2 both the paragraph and the whole text, which is hardly longer, match.
    found = sorted((r.doc_id or 0, r.n_matches, r.licenses) for r in licenses.scan_licenses(_docs(spark, rows)).collect())
    assert found == [
        (0, 1, "MIT"), (1, 1, "Apache-2.0"), (2, 2, "MIT"), (3, 0, ""), (4, 0, ""), (5, 0, ""), (6, 0, ""),
        (7, 2, "CC-BY-NC-4.0,MIT"), (7, 2, "CC-BY-NC-4.0,MIT"),
    ]
    assert licenses.scan_licenses(_docs(spark, [])).collect() == []


LEAD = """Copyright (c) 2021, A. Author
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """
3. Neither the name of Example Corp nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MIT_FILE = """The MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""


def test_whole_license_files(spark):
    apache = "#!/bin/sh\n\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n\n"
    rows = [(1, MIT_FILE), (2, LEAD), (3, LEAD + THIRD), (4, apache), (5, "Redistribution of wealth and use of binary forms.")]
    found = {r.doc_id: r.licenses for r in licenses.scan_licenses(_docs(spark, rows)).collect()}
    assert found == {1: "MIT", 2: "BSD-2-Clause", 3: "BSD-3-Clause", 4: "Apache-2.0", 5: ""}


def test_forward_backward_sums_over_all_labellings():
    from itertools import product

    rng = np.random.default_rng(0)
    lengths, moves = np.array([4, 3, 3, 1]), rng.standard_normal((3, 3))
    emissions = rng.standard_normal((lengths.sum(), 3))
    places, by_length = language.time_major(lengths)
    found = np.zeros((len(emissions), 3))
    major = np.zeros_like(found)
    for _, rows, gamma, _ in language.forward_backward(emissions[places], lengths[by_length], moves):
        major[rows] = gamma
    found[places] = major
    at = 0
    for n in lengths:
        total = np.zeros((n, 3))
        for y in product(range(3), repeat=int(n)):
            p = np.exp(sum(emissions[at + t, k] for t, k in enumerate(y)) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            total[range(n), y] += p
        assert np.allclose(found[at : at + n], total / total.sum(axis=1, keepdims=True))
        at += n


def test_features_of_words_in_slices(monkeypatch):
    words = ["a", "bc", "straße", "q", "zz", "héllo", "x" * 30]
    word, feature, value = language.word_features(words)
    monkeypatch.setattr(language, "SLICE_WORDS", 3)
    starts, features, values = language.features_by_word(words)
    for i in range(len(words)):
        at = slice(starts[i], starts[i + 1])
        assert features[at].tolist() == feature[word == i].tolist() and values[at].tolist() == value[word == i].tolist()


def test_training_holds_each_word_once():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), 8)) for _ in range(20_000)]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(1_000)]
    samples = pd.DataFrame({"text": texts, "lang": ["en", "de"] * 500})
    tracemalloc.start()
    language.train(samples, steps=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6, peak


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = language.identify(docs, per_language=40, steps=120).join(docs.select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark):
    learn = [(i, t, k) for i, (t, k) in enumerate([("the cat and dog", "aa"), ("le chat et chien", "bb")] * 12)]
    docs = spark.createDataFrame([*learn, (90, None, "aa"), (91, "", None), (92, "12 - ²", "aa"), (None, "the dog", None)], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language.identify(docs, steps=60).collect()}
    assert [found[k].lang_pred for k in (90, 91, 92, None)] == ["und", "und", "und", "aa"]
    assert found[90].score == 0 and found[None].held_out is False
    assert language.identify(docs.limit(0)).collect() == []
    unknown = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unknown} == {"und"}


#: The patterns as the contract states them.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and personal.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_language_sample_of_heavy_copies_and_many_languages(spark):
    copies = spark.range(4_000).select(F.lit("the same words again").alias("text"), F.lit("en").alias("lang"))
    others = spark.range(250).selectExpr("concat('texte numéro ', id) AS text", "concat('l', id) AS lang")
    rows = language.labelled_sample(copies.union(others), per_language=5).collect()
    assert len(rows) == language.MAX_LANGUAGES
    assert [r.text for r in rows if r.lang == "en"] == ["the same words again"]


def test_base_spans_are_those_of_the_plain_patterns():
    rng = np.random.default_rng(4)
    for _ in range(4000):
        text = "".join(rng.choice(list("ab1290.@-+_ ()é%"), rng.integers(0, 40)))
        assert personal.base_spans(text) == _base(text), text
    assert personal.base_spans("a@b.c_d@e.f 4111 1111 1111 1111 1.2.3.4.5.6.7.8 999.1.1.1") == _base(
        "a@b.c_d@e.f 4111 1111 1111 1111 1.2.3.4.5.6.7.8 999.1.1.1"
    )
    assert personal.base_spans("a" * 300_000 + "1" * 300_000) == []


def test_segment_marginals_sum_over_all_segmentations():
    rng = np.random.default_rng(1)
    text = "ab 12 c3 @x"
    lattice = personal.Lattice(text, [m.span() for m in personal.TOKENS.finditer(text)])
    n, outside = len(lattice.tokens), len(personal.KINDS)
    scores, moves = rng.standard_normal((len(lattice.spans), outside)), rng.standard_normal((outside + 1, outside + 1))
    total, best, sums = 0.0, (-np.inf, None), np.zeros_like(scores)

    def walk(t, label, score, chosen):
        nonlocal total, best
        if t == n:
            total += np.exp(score)
            best = max(best, (score, chosen), key=lambda x: x[0])
            for s, k in chosen:
                sums[s, k] += np.exp(score)
            return
        walk(t + 1, outside, score + moves[label, outside], chosen)
        for s, (i, j) in enumerate(lattice.spans):
            if i == t:
                for k in range(outside):
                    walk(j, k, score + moves[label, k] + scores[s, k], [*chosen, (s, k)])

    walk(0, outside, 0.0, [])
    seg, _ = personal.marginals(lattice, scores, moves)
    assert np.allclose(seg, sums / total)
    assert personal.decode(lattice, scores, moves) == best[1]


def test_personal_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = [(-1, None), (-2, ""), (-3, "no data here"), (-4, 'x token = "0123456789abcdef0123456789abcdef01234567" y')]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    found = {r.doc_id: r for r in personal.find_personal(docs, rounds=3).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for k, r in found.items():
        base = _base(texts[k])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == x for b in base) for x in personal.BASE_KINDS]
        spans = r.spans.split(",") if r.spans else []
        assert {f"{x}:{a}:{b}" for x, a, b in base} <= set(spans)
        if not re.search("[0-9@]", texts[k]):
            assert not spans
    assert found[-4].spans == "secret:11:51" and found[-1].spans == found[-3].spans == ""
    assert personal.find_personal(docs.limit(0)).collect() == []


def test_personal_data_of_chunks_without_candidates(spark):
    """An @ that no letter follows is active but begins and ends no segment; superscripts are digits without a decimal value."""
    for text in ("@", "mail foo@, or", "a@ b 7", "v 1.2.3.\u00b2 x", "1.2.3.\u2460"):
        field = personal.train([text, "mail a@b.cd now"], rounds=1)
        assert personal.all_spans(text, [], field, 2.0) == []
    docs = spark.createDataFrame([(i, "@" if i else "to x@y.zz or 1.2.3.\u00b2") for i in range(3)], "doc_id long, text string")
    found = {r.doc_id: r for r in personal.find_personal(docs, rounds=1).collect()}
    assert [found[i].n_email for i in range(3)] == [1, 0, 0] and found[1].spans == found[2].spans == ""


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")).union(
        spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 34", None, None, None)], docs.schema)
    )
    docs = docs.union(extra).withColumn("__k1", F.lit(1)).withColumn("removed", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        before, after = docs.count(), out.count()
        assert 0 < after <= before
        docs = out.persist()
    assert docs.where("doc_id >= 9001").count() == 0
    packed = corpus_pipeline.packed(spark, docs, DATA)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(f"n > {packing.SEQUENCE_TOKENS}").count() == 0
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


@pytest.mark.parametrize("at", range(5))
def test_stages_on_an_empty_table(spark, at):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[at][1](spark, docs, DATA).collect() == []
