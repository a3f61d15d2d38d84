"""Operator 3: documents packed into sequences by vector best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import arrow_by_bytes, give_back
from reviewlens.llm.tokens import default_vocabulary, encoded
from reviewlens.storage import materialize

SEQUENCE_TOKENS = 2048
SEPARATOR_ID = 0
GROUP_PIECES = 20_000
WEIGHTS = (1.0, 0.01, 0.01)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(capacity: int, separator: int, vocabulary: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, ids, bounds in encoded(batch, vocabulary, separator):
                ids = ids.astype("<u4")
                pieces = -(-np.diff(bounds) // capacity)
                row = np.repeat(np.arange(rows.num_rows), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                begin = bounds[row] + piece * capacity
                end = np.minimum(begin + capacity, bounds[row + 1])
                columns = {
                    "doc_id": rows.column("doc_id").take(pa.array(row)),
                    "piece": pa.array(piece.astype("int32")),
                    "start": pa.array(piece * capacity),
                    "length": pa.array(end - begin),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(begin, end, strict=True)], pa.int64()),
                }
                if with_ids:
                    offsets = pa.array(np.append(begin, end[-1:]).astype("int32"))
                    columns["ids"] = pa.ListArray.from_arrays(offsets, pa.array(ids.astype("int32")))
                yield pa.RecordBatch.from_pydict(columns)
        give_back()

    return run


def cut_documents(
    docs: DataFrame,
    *,
    capacity: int = SEQUENCE_TOKENS,
    separator: int = SEPARATOR_ID,
    vocabulary: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every document (doc_id, text), each text ended by
    ``separator``. A null text counts as empty: one piece of one token."""
    arrow_by_bytes(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = PIECES + ", ids array<int>" * with_ids
    return rows.mapInArrow(_cut(capacity, separator, vocabulary or default_vocabulary(), with_ids), schema)


def best_fit(
    demands: np.ndarray, capacities: np.ndarray, weights: np.ndarray, rule: str = "norm"
) -> np.ndarray:
    """Bin of each item. Items come in decreasing order of their weighted size; each goes to the open bin that
    can hold it in every dimension and has the smallest weighted norm of what stays free (``norm``), or the
    largest weighted dot product of demand and free space (``dot``); where none can, a bin is opened. An item
    over a capacity gets a bin of its own. Ties go to the bin opened first."""
    scaled = demands / capacities
    weighted = scaled * weights
    order = np.argsort(-weighted.sum(axis=1), kind="stable")
    least = np.minimum.accumulate(scaled[order][::-1])[::-1]  # what any item from here on needs at least
    out = np.empty(len(demands), dtype="int64")
    free = np.empty((1024, demands.shape[1]))
    ids = np.empty(1024, dtype="int64")
    n = made = 0
    for turn, i in enumerate(order):
        need = scaled[i]
        room = free[:n]
        fits = np.flatnonzero((room >= need - 1e-12).all(axis=1))
        if len(fits):
            rest = room[fits] - need
            score = -((rest * weights) ** 2).sum(axis=1) if rule == "norm" else room[fits] @ (need * weights**2)
            at = fits[score.argmax()]
            free[at] -= need
        else:
            if n == len(ids):
                free, ids = np.resize(free, (2 * n, free.shape[1])), np.resize(ids, 2 * n)
            at, free[n], ids[n] = n, 1.0 - need, made
            n, made = n + 1, made + 1
        out[i] = ids[at]
        if turn + 1 < len(order) and (free[at] < least[turn + 1] - 1e-12).any():  # full for all that follow
            ids[at:n - 1], free[at:n - 1] = ids[at + 1 : n].copy(), free[at + 1 : n].copy()
            n -= 1
    return out


def _pack(capacities: tuple[float, float, float], weights: tuple[float, float, float], rule: str, names: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, group = TaskContext.get().partitionId(), pd.concat([*frames, pd.DataFrame()])
        if not len(group):
            return
        length = group["length"].to_numpy("float64")
        demands = np.stack([length, np.ones_like(length), length**2], axis=1)
        bins = best_fit(demands, np.array(capacities), np.array(weights), rule)
        group["sequence_id"] = (part << 32) + bins
        group["offset"] = group.groupby("sequence_id")["length"].cumsum() - group["length"]
        group["doc_id"] = group["doc_id"].astype("Int64")
        yield group[names]

    return run


def pack_pieces(
    pieces: DataFrame,
    *,
    capacity: int = SEQUENCE_TOKENS,
    documents: int | None = None,
    attention: float | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = "norm",
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Adds sequence_id and offset to pieces (with a column length): every sequence holds at most ``capacity`` tokens,
    ``documents`` pieces and ``attention`` squared tokens (by default what ``capacity`` allows at most).

    Pieces are dealt evenly into groups of about ``group_pieces`` rows whatever their ids, so no key can make a
    group large; every group is packed alone, which leaves at most about one sequence in part empty per group.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    capacities = (float(capacity), float(documents or capacity), float(attention or capacity**2))
    rows = pieces.select(*PIECE_COLUMNS)
    names = [*PIECE_COLUMNS, "sequence_id", "offset"]
    return rows.repartition(groups).mapInPandas(
        _pack(capacities, weights, rule, names), PIECES + ", sequence_id long, offset long"
    )


PIECE_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pack_documents(docs: DataFrame, *, vocabulary: str | None = None, capacity: int = SEQUENCE_TOKENS, **options) -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is one piece of one
    token; a null doc_id stays null; repeated rows are packed as often as they come; an empty table gives no rows;
    other columns are ignored. The tokens are computed once; packing moves only the pieces' lengths.
    """
    pieces = materialize(cut_documents(docs, capacity=capacity, vocabulary=vocabulary), "pieces")
    return materialize(pack_pieces(pieces, capacity=capacity, **options), "packed")


def sequences(docs: DataFrame, packed: DataFrame, *, vocabulary: str | None = None, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """The sequences themselves: sequence_id, doc_ids, ids. For documents with distinct ids."""
    ids = cut_documents(docs, capacity=capacity, vocabulary=vocabulary, with_ids=True).select("doc_id", "piece", "ids")
    rows = packed.select("doc_id", "piece", "sequence_id", "offset").join(ids, ["doc_id", "piece"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return rows.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.col("parts.doc_id").alias("doc_ids"), F.flatten("parts.ids").alias("ids")
    )
