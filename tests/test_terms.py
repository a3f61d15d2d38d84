"""Terms counted in slices of Arrow batches against plain counts."""

import re
from collections import Counter

import pyarrow as pa
import pytest

from reviewlens.operators import features

TEXTS = ["ab cd ab cd ab", "", None, "x y z", "cd ab", "ab, ab! AB", "éé ab éé ab", "a b1 cd ef", "ef"]


def _terms(text):
    words = re.findall(r"\w{2,}", (text or "").lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@pytest.fixture()
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "row_id long, review_text string")


def test_totals_add_up_over_slices_and_tasks(spark, texts):
    counts = [Counter(_terms(t)) for t in TEXTS]
    total, df = sum(counts, Counter()), Counter(t for c in counts for t in c)
    for parts in (1, 4):
        found = features.term_totals(texts.repartition(parts)).collect()
        assert {r["term"]: (r["df"], r["total"]) for r in found} == {t: (df[t], total[t]) for t in total}
        assert len(found) == len(total)
    top = features.vocabulary(texts, 3, 2).collect()
    best = sorted((t for t in total if df[t] >= 2), key=lambda t: (-total[t], t))[:3]
    assert [r["term"] for r in top] == sorted(best)


def test_slices_hold_whole_rows(monkeypatch):
    monkeypatch.setattr(features, "SLICE_TOKENS", 4)
    words = pa.array([_terms(t) for t in TEXTS])
    parts = list(features._slices(words))
    assert [r for p in parts for r in p.to_pylist()] == words.to_pylist()
    assert all(len(p) == 1 or len(p.flatten()) <= 4 for p in parts)


def test_terms_are_counted_in_batches_not_by_lambdas(spark, texts):
    model = features.TfidfModel.fit(texts, min_df=1)
    rows = model.counts(texts).select("row_id", "_tf.*").collect()
    for r, text in zip(sorted(rows), TEXTS):
        want = sorted((model.terms.index(t), n) for t, n in Counter(_terms(text)).items())
        assert list(zip(r["indices"], r["values"])) == [(i, float(n)) for i, n in want]
    for df in (features.term_totals(texts), model.transform(texts)):
        assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_encoding_makes_no_object_of_a_word(texts, monkeypatch):
    """Words are looked up as Arrow arrays; ids are those of a plain lookup."""
    words = features.token_vocabulary(texts, 3)
    with monkeypatch.context() as patch:  # a lookup by Python objects would ask for a pandas function
        patch.setattr(features.F, "pandas_udf", None)
        rows = features.encode_fixed(texts, words, 6)
    for r in rows.collect():
        plain = [t for t in _terms(TEXTS[r["row_id"]]) if " " not in t][:4]
        ids = [features.START, *[words.index(w) + features.END + 1 if w in words else features.UNK for w in plain], features.END]
        assert r["input_ids"] == ids + [features.PAD] * (6 - len(ids)) and sum(r["attention_mask"]) == len(ids)
