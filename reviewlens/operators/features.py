"""Aspect scores, TF-IDF and fixed-length token encoding.

Statistics (vocabulary, document frequencies) are fitted on the training rows with one aggregation
by term. Applying them is narrow: terms are looked up inside each row, so features need no shuffle,
no join and no regrouping, whatever the number of rows. A feature row is held as two arrays,
``indices`` and ``values``; the long form is their ``explode``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.config import LEXICON, Config
from reviewlens.functions import tokenize, with_terms
from reviewlens.storage import collect_small

# A fitted vocabulary goes through the driver and to every executor, so its size has a limit.
MAX_VOCABULARY = 1_000_000

#: Tokens that are counted at once.
SLICE_TOKENS = 2_000_000
#: Parts into which terms are dealt to be added up, each by one task at a time.
TERM_PARTS = 512

PAD, UNK, START, END = 0, 1, 2, 3


# ---- aspects ----


def aspect_columns(
    lexicon: dict[str, list[str]] | None = None, text: str = "review_text", lowered: str | None = None
) -> dict[str, Column]:
    """Share of each aspect's keywords that occur in the lowered text, each counted once. ``lowered`` names a column that
    has it already."""
    lowered = F.lower(F.coalesce(F.col(text), F.lit(""))) if lowered is None else F.col(lowered)
    columns = {}
    for aspect, words in (LEXICON if lexicon is None else lexicon).items():
        hits = sum((lowered.contains(w).cast("int") for w in words), F.lit(0))
        columns[f"asp_{aspect}"] = hits.cast("double") / max(len(words), 1)
    return columns


def aspect_scores(df: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """Add the aspect columns. The text is lowered once, in a column of its own."""
    lowered = df.withColumn("_lowered", F.lower(F.coalesce(F.col("review_text"), F.lit(""))))
    return lowered.withColumns(aspect_columns(lexicon, lowered="_lowered")).drop("_lowered")


def aspect_sentiment(df: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """Per aspect and sentiment: reviews, reviews that mention the aspect and the mean score; the
    rows with a null sentiment hold the totals. The table is aggregated to one row per sentiment
    first and turned into the long form after that."""
    columns = aspect_columns(lexicon)
    names = list(columns)
    grouped = (
        df.select("sentiment", *[c.alias(n) for n, c in columns.items()])
        .rollup("sentiment")
        .agg(
            F.count(F.lit(1)).alias("reviews"),
            *[F.sum((F.col(n) > 0).cast("long")).alias(f"m_{n}") for n in names],
            *[F.avg(n).alias(f"s_{n}") for n in names],
        )
    )
    entries = [
        F.struct(
            F.lit(n.removeprefix("asp_")).alias("aspect"),
            F.col(f"m_{n}").alias("mentions"),
            (F.col(f"m_{n}") / F.col("reviews")).alias("mention_share"),
            F.col(f"s_{n}").alias("mean_score"),
        )
        for n in names
    ]
    return grouped.select("sentiment", "reviews", F.inline(F.array(*entries))).select(
        "aspect", "sentiment", "reviews", "mentions", "mention_share", "mean_score"
    )


# ---- terms and vocabulary ----


def term_counts(df: DataFrame, text: str = "review_text", key: str = "row_id") -> DataFrame:
    """Long form ``(key, term, tf)``. Equal terms of a row are counted inside the row, as runs of
    its sorted terms, so no shuffle by (row, term) is needed."""
    rows = with_terms(df.select(key, text), text).withColumn("_s", F.sort_array("terms"))
    positions = F.when(F.size("_s") > 0, F.sequence(F.lit(0), F.size("_s") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    starts = F.filter(positions, lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1)))
    rows = rows.select(key, "_s", starts.alias("_p"))
    ends = F.slice(F.concat("_p", F.array(F.size("_s"))), F.lit(2), F.size("_p"))
    runs = F.zip_with(
        F.col("_p"),
        ends,
        lambda a, b: F.struct(F.get("_s", a).alias("term"), (b - a).cast("long").alias("tf")),
    )
    return rows.select(key, F.inline(runs))


def _slices(words: pa.ListArray) -> Iterator[pa.ListArray]:
    """Rows of token lists, few enough at a time that their tokens number about ``SLICE_TOKENS``."""
    ends = np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(words):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_TOKENS, "right")))
        yield words.slice(at, to - at)
        at = to


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, "int64")


def _slice_totals(words: pa.ListArray) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Per term of some rows: how many of them hold it, and its count; dealt to ``TERM_PARTS`` by a hash of the term. A term is a number
    until it is known to be a different one: the place of its word, or of both words, among the different words."""
    encoded = words.flatten().dictionary_encode()
    ids, names = encoded.indices.to_numpy(zero_copy_only=False).astype("int64"), encoded.dictionary
    if not len(ids):
        return
    row = np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    near = row[1:] == row[:-1]
    size = len(names)
    key = np.concatenate([ids, size + (ids[:-1] * size + ids[1:])[near]])
    held = np.sort(np.concatenate([row, row[1:][near]]) * (size + size * size) + key)
    terms, total = np.unique(key, return_counts=True)
    found = np.sort(held[_runs(held)] % (size + size * size))
    df = np.diff(np.append(_runs(found), len(found)))
    first, second = np.divmod(np.maximum(terms - size, 0), size)
    hashes = np.array([zlib.crc32(w.encode()) for w in names.to_pylist()], "int64")
    single = terms < size
    part = np.where(single, hashes[np.where(single, terms, 0)], hashes[first] * 31 + hashes[second]) % TERM_PARTS
    order = np.argsort(part.astype("int16"), kind="stable")
    single, first, second, part = single[order], np.where(single, terms, first)[order], second[order], part[order]
    # a single word is joined with nothing
    tails = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar("", names.type), names, pa.scalar(" ", names.type)), pa.array([""], names.type)])
    spelled = pc.binary_join_element_wise(names.take(pa.array(first)), tails.take(pa.array(np.where(single, size, second))), pa.scalar("", names.type))
    whole = pa.RecordBatch.from_pydict({"term": spelled.cast(pa.large_string()), "df": pa.array(df[order], pa.int64()), "total": pa.array(total[order], pa.int64())})
    begin = _runs(part)
    for k, at, to in zip(part[begin], begin, np.append(begin[1:], len(part))):
        yield int(k), whole.slice(at, to - at)


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def term_totals(df: DataFrame, text: str = "review_text", min_df: int = 1, most: int | None = None) -> DataFrame:
    """Per term: documents that hold it and total count; terms of at least ``min_df`` documents. Tasks count their rows' terms and
    send the counts in blocks, one for each part of the terms; each part is then added up by itself. With ``most``
    a part leaves out what cannot be among the ``most`` terms of the largest counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in _slices(batch.column("words")):
                blocks = [(k, _packed(x)) for k, x in _slice_totals(words)]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([k for k, _ in blocks], pa.int32()), "block": pa.array([x for _, x in blocks], pa.binary())
                })

    def added(group: pa.Table) -> pa.Table:
        blocks = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in group["block"]])
        sums = blocks.group_by("term", use_threads=False).aggregate([("df", "sum"), ("total", "sum")]).rename_columns(["term", "df", "total"])
        sums = sums.filter(pc.greater_equal(sums["df"], min_df))
        if most is not None and len(sums) > most:
            sums = sums.take(pc.sort_indices(sums, [("total", "descending"), ("term", "ascending")])[:most])
        return sums.set_column(0, "term", sums["term"].cast(pa.string()))

    words = df.select(tokenize(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    blocks = words.mapInArrow(run, "part int, block binary")
    return blocks.groupBy("part").applyInArrow(added, "term string, df long, total long")


def vocabulary(df: DataFrame, max_features: int = 5_000, min_df: int = 2) -> DataFrame:
    """The ``max_features`` most frequent terms found in at least ``min_df`` documents, numbered in
    term order. Ties in the count go to the earlier term."""
    totals = term_totals(df, min_df=min_df, most=max_features)
    top = totals.orderBy(F.desc("total"), F.asc("term")).limit(max_features)
    # The chosen terms are a short list; they are numbered as one sorted array.
    numbered = top.agg(F.sort_array(F.collect_list(F.struct("term", "df", "total"))).alias("v"))
    return numbered.select(F.posexplode("v").alias("term_idx", "t")).select(
        "t.term", "term_idx", "t.df", "t.total"
    )


def smoothed_idf(n_docs: int | Column, doc_freq: Column) -> Column:
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return F.log((1 + n) / (1 + doc_freq)) + 1


def double_array(values: list[float]) -> Column:
    """A constant array. It enters the plan as one text literal, which Catalyst folds once; thousands
    of separate literals would slow down every analysis step."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def l2_normalized(values: Column) -> Column:
    """Values over their length. The norm is an argument, not part of the lambda, where it would be
    worked out again for every element."""
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.zip_with(values, F.array_repeat(norm, F.size(values)), lambda x, n: x / n)


@dataclass(frozen=True)
class TfidfModel:
    """Fitted TF-IDF: terms in index order, their weights, and the number of training rows."""

    terms: list[str]
    idf: list[float]
    n_docs: int

    @staticmethod
    def fit(train: DataFrame, max_features: int = 5_000, min_df: int = 2) -> TfidfModel:
        if max_features > MAX_VOCABULARY:
            raise ValueError(f"max_features is limited to {MAX_VOCABULARY}")
        n_docs = train.count()
        rows = collect_small(vocabulary(train, max_features, min_df), max_features, "vocabulary")
        rows.sort(key=lambda r: r["term_idx"])
        if not rows:
            raise ValueError("empty vocabulary")
        idf = [math.log((1 + n_docs) / (1 + r["df"])) + 1 for r in rows]
        return TfidfModel([r["term"] for r in rows], idf, n_docs)

    @property
    def size(self) -> int:
        return len(self.terms)

    def counts(self, df: DataFrame) -> DataFrame:
        """Add ``_tf``: the term counts of the row as a sparse struct (indices, values)."""
        return self._with_struct(df, "_tf", lambda row, term, tf: tf.astype("float64"))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``indices`` and ``values``: (1 + ln tf) · idf, scaled to length one."""
        idf = np.array(self.idf)

        def weighted(row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
            different, where = np.unique(tf, return_inverse=True)
            weight = np.array([1 + math.log(x) for x in different])[where] * idf[term]
            return weight / np.sqrt(np.bincount(row, weight * weight))[row] if len(row) else weight

        rows = self._with_struct(df, "_vec", weighted)
        return rows.withColumns({"indices": F.col("_vec.indices"), "values": F.col("_vec.values")}).drop("_vec")

    def _with_struct(self, df: DataFrame, out: str, values: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        """Add the struct (indices, values) of the row's terms; ``values`` gets the arrays (row, term, count)."""
        shared = df.sparkSession.sparkContext.broadcast(self.terms)

        @F.arrow_udf("indices array<int>, values array<double>")
        def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            lookup = TermLookup(shared.value)
            for batch in batches:
                parts = [lookup.counted(words) for words in _slices(batch)]
                columns = []
                for sizes, term, tf in parts:
                    row = np.repeat(np.arange(len(sizes)), sizes)
                    columns.append((sizes, term, values(row, term, tf)))
                sizes, term, value = (np.concatenate([c[i] for c in columns]) if columns else np.zeros(0, "int64") for i in range(3))
                offsets = pa.array(np.append(0, np.cumsum(sizes)).astype("int32"))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((term, pa.int32()), (value, pa.float64()))]
                yield pa.StructArray.from_arrays(lists, ["indices", "values"])

        # the tokens are a column of their own: they are made by Spark and read by the function as they are
        return df.withColumn("_words", tokenize(F.coalesce(F.col("review_text"), F.lit("")))).withColumn(out, found("_words")).drop("_words")


class TermLookup:
    """Finds the terms of a vocabulary, single words and pairs of neighbours, in lists of tokens."""

    def __init__(self, terms: list[str]) -> None:
        parts = [t.split(" ") for t in terms]
        words = sorted({w for p in parts for w in p})
        place = {w: i for i, w in enumerate(words)}
        self.size, self.words = len(terms), pa.array(words, pa.string())
        self.single = np.full(len(words) + 1, -1)  # the last one stands for words of no term
        pairs = sorted((place[p[0]] * len(words) + place[p[1]], i) for i, p in enumerate(parts) if len(p) == 2)
        for i, p in enumerate(parts):
            if len(p) == 1:
                self.single[place[p[0]]] = i
        self.keys, self.pairs = (np.array([x[i] for x in pairs], "int64") for i in range(2))

    def counted(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of terms of each row, terms in order within the row, their counts)."""
        flat = words.flatten()
        ids = pc.index_in(flat, value_set=self.words.cast(flat.type)).fill_null(len(self.words)).to_numpy(zero_copy_only=False).astype("int64")
        row = np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        term = self.single[ids]
        known = ids < len(self.words)
        near = np.flatnonzero((row[1:] == row[:-1]) & known[1:] & known[:-1])
        key = ids[near] * len(self.words) + ids[near + 1]
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        both = np.concatenate([row[term >= 0] * self.size + term[term >= 0], row[near[hit]] * self.size + self.pairs[at[hit]]])
        both.sort()
        first = _runs(both)
        tf = np.diff(np.append(first, len(both)))
        return np.bincount(both[first] // self.size, minlength=len(words)), both[first] % self.size, tf


def long_form(df: DataFrame, *keep: str) -> DataFrame:
    """One row per non-zero feature: the kept columns, ``idx`` and ``weight``."""
    pairs = F.arrays_zip(F.col("indices").alias("idx"), F.col("values").alias("weight"))
    return df.select(*keep, F.inline(pairs))


def append_aspects(df: DataFrame, size: int, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """Append the aspect scores behind the ``size`` TF-IDF positions; zeros stay implicit."""
    names = list(aspect_columns(lexicon))
    extra = F.filter(
        F.array(
            *[F.struct(F.lit(size + j).alias("i"), F.col(n).alias("v")) for j, n in enumerate(names)]
        ),
        lambda e: e["v"] != 0,
    )
    rows = aspect_scores(df, lexicon).withColumn("_extra", extra)
    return (
        rows.withColumn("indices", F.concat("indices", F.transform("_extra", lambda e: e["i"])))
        .withColumn("values", F.concat("values", F.transform("_extra", lambda e: e["v"])))
        .drop("_extra", *names)
    )


def absolute_values(df: DataFrame) -> DataFrame:
    """Absolute feature values, as naive Bayes needs them."""
    return df.withColumn("values", F.transform("values", F.abs))


def pack_vectors(df: DataFrame, size: int, out: str = "features") -> DataFrame:
    """Add the arrays as a Spark ML sparse vector. Whole Arrow batches are passed on as the parts
    of the vector type; there is no work per row."""

    @F.pandas_udf(VectorUDT())
    def pack(indices: pd.Series, values: pd.Series) -> pd.DataFrame:
        n = len(indices)
        return pd.DataFrame(
            {
                "type": pd.Series([0] * n, dtype="int8"),
                "size": pd.Series([size] * n, dtype="int32"),
                "indices": indices,
                "values": values,
            }
        )

    return df.withColumn(out, pack("indices", "values"))


# ---- fixed-length encoding ----


def token_vocabulary(train: DataFrame, max_size: int = Config.max_tokens) -> list[str]:
    """The most frequent tokens of the training rows; the first one gets the id after ``END``."""
    if max_size > MAX_VOCABULARY:
        raise ValueError(f"max_size is limited to {MAX_VOCABULARY}")
    tokens = train.select(F.explode(tokenize(F.col("review_text"))).alias("token"))
    top = (
        tokens.groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("token"))
        .limit(max_size)
    )
    rows = collect_small(top, max_size, "token vocabulary")
    return [r["token"] for r in sorted(rows, key=lambda r: (-r["n"], r["token"].encode()))]


def encode_fixed(df: DataFrame, tokens: list[str], max_length: int = 256) -> DataFrame:
    """Add ``input_ids`` and ``attention_mask`` of exactly ``max_length`` entries: start, token ids
    cut to fit, end, padding. Each Arrow batch is looked up as one flat array, as it is: no word becomes an object."""
    shared = df.sparkSession.sparkContext.broadcast(tokens)

    @F.arrow_udf("array<int>")
    def lookup(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = None
        for words in batches:
            flat = words.flatten()
            if known is None:
                known = pa.array(shared.value, flat.type)
            found = pc.index_in(flat, value_set=known)
            ids = pc.fill_null(pc.add(found, END + 1), UNK).cast(pa.int32())
            yield pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(words.value_lengths().fill_null(0))).astype("int32")), ids)

    words = F.slice(tokenize(F.coalesce(F.col("review_text"), F.lit(""))), 1, max_length - 2)
    ids = F.concat(F.array(F.lit(START)), F.col("_ids"), F.array(F.lit(END)))
    return (
        df.withColumn("_words", words)
        .withColumn("_ids", lookup("_words"))
        .withColumn("_ids", ids)
        .withColumn("_n", F.size("_ids"))
        .withColumn("input_ids", F.concat("_ids", F.array_repeat(F.lit(PAD), max_length - F.col("_n"))))
        .withColumn(
            "attention_mask",
            F.concat(F.array_repeat(F.lit(1), F.col("_n")), F.array_repeat(F.lit(0), max_length - F.col("_n"))),
        )
        .drop("_words", "_ids", "_n")
    )
