"""Operator 8: language of code-switched text by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import arrow_by_bytes, give_back
from reviewlens.storage import collect_small

PER_LANGUAGE = 300
SAMPLE_CHARS = 3_000
MAX_LANGUAGES = 200
FEATURE_BITS = 17
STEPS = 250
SEQUENCES = 64
SEGMENT_WORDS = (6, 24)
WORDS = re.compile(r"[^\W\d_]+")
SLICE_CHARS = 4_000_000
CACHE_WORDS = 100_000
SLICE_WORDS = 2_000
UND = "und"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, feature, value) of every feature of every word: its character n-grams of one to three characters, with marks for
    the word's ends, which share a weight of 1; its prefixes and suffixes of two to four; and itself, as in a lexicon."""
    marked = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64")
    sizes = np.array([len(w) + 2 for w in words], dtype="int64")
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    left = ends[owner] - np.arange(len(codes))  # characters from here to the word's end
    out, h = [], np.zeros(len(codes), dtype="uint64")
    for n in (1, 2, 3):
        h[: len(codes) - n + 1] = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
        at = np.flatnonzero(left >= n)
        out.append((owner[at], _mix(h[at] * np.uint64(2 * n + 1)), 1.0 / (3 * (sizes[owner[at]] - n + 1))))
    for n in (2, 3, 4):
        long = np.flatnonzero(sizes - 2 >= n)
        for k, first in ((0, starts[long] + 1), (1, ends[long] - 1 - n)):
            h = np.zeros(len(long), dtype="uint64")
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + codes[first + j]
            out.append((long, _mix(h + np.uint64(1_000_003 * (10 * n + k))), np.ones(len(long))))
    lexicon = np.add.reduceat(_mix(codes + np.uint64(77) * (np.arange(len(codes)) - starts[owner]).astype("uint64")), starts)
    out.append((np.arange(len(words)), _mix(lexicon + np.uint64(999)), np.ones(len(words))))
    word, feature, value = (np.concatenate([x[i] for x in out]) for i in range(3))
    return word, (feature & np.uint64((1 << FEATURE_BITS) - 1)).astype("int64"), value.astype("float32")


def features_by_word(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, features, values): those of word i lie from starts[i] to starts[i + 1]. Made for ``SLICE_WORDS`` words at a time, as
    ``word_features`` takes many times the memory of its result."""
    counts, features, values = [], [], []
    for at in range(0, len(words), SLICE_WORDS):
        part = words[at : at + SLICE_WORDS]
        word, feature, value = word_features(part)
        order = np.argsort(word, kind="stable")
        counts.append(np.bincount(word, minlength=len(part)))
        features.append(feature[order].astype("int32"))
        values.append(value[order])
    return np.append(0, np.cumsum(np.concatenate(counts))), np.concatenate(features), np.concatenate(values)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages
    transitions: np.ndarray  # from x to

    def emissions(self, words: list[str]) -> np.ndarray:
        word, feature, value = word_features(words)
        out = np.empty((len(words), len(self.languages)), dtype="float32")
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(word, self.weights[feature, k] * value, len(words))
        return out


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray):
    """Marginals of chains in time-major order. ``lengths`` must not increase; at time t the first n_t chains are active and
    their emissions (not yet exponentials) lie together. Yields, from the last time to the first, (t, rows, marginals of
    the labels, marginals of the pairs with the label before or None)."""
    steps = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    at = np.concatenate([[0], np.cumsum(active)])
    scores = np.exp(emissions - emissions.max(axis=1, keepdims=True)).astype("float64")
    move = np.exp(transitions - transitions.max())
    alpha = np.empty_like(scores)
    alpha[: active[0]] = scores[: active[0]] / scores[: active[0]].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        rows = slice(at[t], at[t + 1])
        x = (alpha[at[t - 1] : at[t - 1] + active[t]] @ move) * scores[rows] + 1e-300
        alpha[rows] = x / x.sum(axis=1, keepdims=True)
    beta = np.ones((active[0], scores.shape[1]))
    for t in range(steps - 1, -1, -1):
        rows, n = slice(at[t], at[t + 1]), active[t]
        gamma = alpha[rows] * beta[:n]
        gamma /= gamma.sum(axis=1, keepdims=True)
        pair, back = None, scores[rows] * beta[:n]
        if t:
            pair = (alpha[at[t - 1] : at[t - 1] + n], back)
        yield t, rows, gamma, pair
        if t:
            x = back @ move.T
            beta[:n] = x / x.sum(axis=1, keepdims=True)


def time_major(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For chains of these lengths stored one after the other: (order, by_length), the places of the words in time-major order
    of the chains sorted by falling length."""
    by_length = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[by_length]
    sizes = lengths[by_length]
    t = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    places = np.repeat(starts, sizes) + t
    return places[np.argsort(t, kind="stable")], by_length


def train(samples: pd.DataFrame, *, steps: int = STEPS, seed: int = 5) -> Model:
    """Fit the field to labelled texts (text, lang) by stochastic gradients of the log-likelihood.

    Its chains are made code-switched: one to three segments of ``SEGMENT_WORDS`` words from random texts, each word labelled by
    its text's language, so that the transitions learn how rarely the language changes."""
    languages = sorted(samples["lang"].unique())
    place = {x: i for i, x in enumerate(languages)}
    vocabulary: dict[str, int] = {}
    by_language: list[list[np.ndarray]] = [[] for _ in languages]  # texts as numbers of words, so that each word is held once
    for text, lang in zip(samples["text"], samples["lang"], strict=True):
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in WORDS.findall(text.lower())]
        if ids:
            by_language[place[lang]].append(np.array(ids, dtype="int32"))
    known = [i for i, x in enumerate(by_language) if x]
    size = len(languages)
    weights = np.zeros((1 << FEATURE_BITS, size), dtype="float32")
    moves = np.zeros((size, size))
    squares, move_squares = np.full_like(weights, 1e-2), np.full_like(moves, 1e-2)
    rng = np.random.default_rng(seed)
    if not known:
        return Model([], weights, moves)
    starts, feature, value = features_by_word(list(vocabulary))
    for _ in range(steps):
        chains, labels = [], []
        for _ in range(SEQUENCES):
            chain, label = [], []
            for _ in range(rng.integers(1, 4)):
                k = known[rng.integers(len(known))]
                words = by_language[k][rng.integers(len(by_language[k]))]
                n = int(rng.integers(*SEGMENT_WORDS))
                first = int(rng.integers(max(1, len(words) - n + 1)))
                part = words[first : first + n]
                chain.append(part)
                label += [k] * len(part)
            chains.append(np.concatenate(chain).astype("int64"))
            labels.append(np.array(label))
        lengths = np.array([len(c) for c in chains])
        places, by_length = time_major(lengths)
        ids, gold = np.concatenate(chains)[places], np.concatenate(labels)[places]
        counts = starts[ids + 1] - starts[ids]
        flat = np.repeat(starts[ids] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        word, f, v = np.repeat(np.arange(len(ids)), counts), feature[flat], value[flat]
        emissions = np.stack([np.bincount(word, weights[f, k] * v, len(ids)) for k in range(size)], axis=1)
        gradient, move_gradient = np.zeros_like(emissions), np.zeros_like(moves)
        move = np.exp(moves - moves.max())
        before = None
        for t, rows, gamma, pair in forward_backward(emissions, lengths[by_length], moves):
            gradient[rows] = -gamma
            if before is not None:
                np.add.at(move_gradient, (gold[rows][: len(before)], before), 1.0)
            if pair is not None:
                joint = pair[0][:, :, None] * move[None] * pair[1][:, None, :]
                move_gradient -= (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            before = gold[rows]
        gradient[np.arange(len(ids)), gold] += 1
        touched, where = np.unique(f, return_inverse=True)
        for k in range(size):
            g = np.bincount(where, gradient[word, k] * v, len(touched)) - 1e-3 * weights[touched, k]
            squares[touched, k] += g * g
            weights[touched, k] += 0.5 * g / np.sqrt(squares[touched, k])
        move_gradient -= 1e-2 * moves
        move_squares += move_gradient**2
        moves += 0.2 * move_gradient / np.sqrt(move_squares)
    return Model(languages, weights, moves)


def labelled_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """About ``per_language`` different texts (text, lang) of each language, chosen by a hash of the text, each a stretch of
    ``SAMPLE_CHARS`` characters from its middle. However often a text is repeated, it is drawn once. Texts are counted over all
    rows. Of more than ``MAX_LANGUAGES`` languages the most frequent are learned (ties by name)."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL").withColumn("k", F.xxhash64("text"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("k").alias("texts"))
    counts = counts.orderBy(F.desc("rows"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return docs.sparkSession.createDataFrame([], "text string, lang string")
    shares = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["texts"])))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(draw < F.element_at(shares, F.col("lang")))
    first = F.greatest(F.lit(1), F.floor((F.length("text") - SAMPLE_CHARS) / 2) + 1).cast("int")
    return chosen.select(F.substring("text", first, F.lit(SAMPLE_CHARS)).alias("text"), "lang").distinct()


def fit(docs: DataFrame, *, per_language: int = PER_LANGUAGE, steps: int = STEPS) -> Model:
    """A model from labelled documents (text, lang); the bounded sample is all that comes to the driver."""
    rows = collect_small(labelled_sample(docs, per_language), 3 * per_language * MAX_LANGUAGES, "training sample")
    rows.sort(key=lambda r: (r["lang"], r["text"]))
    return train(pd.DataFrame([tuple(r) for r in rows], columns=["text", "lang"]), steps=steps)


class Labeller:
    """Labels texts, with the emissions of frequent words kept between batches."""

    def __init__(self, model: Model) -> None:
        self.model, self.index = model, {}
        self.table = np.empty((0, len(model.languages)), dtype="float32")

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words into the table, number of words per text)."""
        if len(self.index) > CACHE_WORDS:
            self.index, self.table = {}, self.table[:0]
        index, ids, lengths, known = self.index, [], [], len(self.index)
        for text in texts:
            found = WORDS.findall(text.lower()) if text else []
            if not any(c.isalpha() for w in found for c in w):
                found = []
            ids.extend([index.setdefault(w, len(index)) for w in found])
            lengths.append(len(found))
        if len(index) > known:
            new = list(index)[known:]
            parts = [self.model.emissions(new[i : i + 50_000]) for i in range(0, len(new), 50_000)]
            self.table = np.concatenate([self.table, *parts])
        return np.array(ids, dtype="int64"), np.array(lengths, dtype="int64")

    def label(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language with the largest sum of word marginals, and its share of the words."""
        languages = self.model.languages
        if not languages:
            return [UND] * len(texts), np.zeros(len(texts))
        ids, lengths = self.words(texts)
        sums = np.zeros((len(texts), len(languages)))
        if len(ids):
            places, by_length = time_major(lengths)
            total = np.zeros_like(sums)
            for _, rows, gamma, _ in forward_backward(self.table[ids[places]], lengths[by_length], self.model.transitions):
                total[: rows.stop - rows.start] += gamma
            sums[by_length] = total
        best = sums.argmax(axis=1)
        shares = sums[np.arange(len(texts)), best] / np.maximum(lengths, 1)
        return [languages[k] if n else UND for k, n in zip(best, lengths, strict=True)], np.clip(shares, 0.0, 1.0)


def language_of(model: Model, docs: DataFrame, text: Column) -> Column:
    """A column (lang string, score double) of the whole text's language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    arrow_by_bytes(docs.sparkSession)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        give_back()
        labeller = Labeller(shared.value)
        for texts in batches:
            texts = [t if isinstance(t, str) else None for t in texts]
            names, scores, at = [], [], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size < SLICE_CHARS):
                    size += len(texts[to] or "")
                    to += 1
                part, score = labeller.label(texts[at:to])
                names += part
                scores.append(score)
                at = to
            yield pd.DataFrame({"lang": names, "score": np.concatenate(scores) if scores else []})

    return predict(text.cast("string"))


def learners(docs: DataFrame) -> DataFrame:
    """The documents to learn from: those whose crc32 of doc_id as text is not 1 modulo 3. A null doc_id is not among them."""
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def identify(docs: DataFrame, *, per_language: int = PER_LANGUAGE, steps: int = STEPS) -> DataFrame:
    """The language of every document (doc_id, text, lang), learned from ``learners``.

    Words are runs of letters of the lower-cased text. The field is fitted to a sample of about ``per_language`` learners of each
    language; forward-backward over each whole text gives every word's marginals, computed for many texts at once, and
    the language with the largest sum wins. Predictions see the text alone.

    Returns doc_id, held_out (crc32(doc_id) mod 3 = 1), lang_pred, score (mean marginal of that language). Null texts and texts
    without a letter give ``und`` and 0, as does every text if nothing could be learned; a null doc_id is not held out;
    repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
    """
    model = fit(learners(docs), per_language=per_language, steps=steps)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    found = docs.select("doc_id", held_out.alias("held_out"), language_of(model, docs, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
