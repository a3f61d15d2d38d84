"""Operator 2: token ids of documents in ORC files that can be read by stripe and pruned by document id."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewlens.llm.common import arrow_by_bytes
from reviewlens.llm.tokens import default_vocabulary, encoded
from reviewlens.storage import materialize

END_ID = 2
STRIPE_BYTES = 64 << 20
ROW_INDEX_STRIDE = 1_000
FILE_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
READ_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long"


def _encode(end_id: int, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, ids, bounds in encoded(batch, vocabulary, end_id):
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        pa.array(np.full(rows.num_rows, part, dtype="int32")),
                        pa.array(start + bounds[:-1]),
                        pa.array(np.diff(bounds)),
                        pa.ListArray.from_arrays(pa.array(bounds.astype("int32")), pa.array(ids.astype("int32"))),
                    ],
                    names=["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                start += len(ids)

    return run


def write_token_files(
    docs: DataFrame, path: str, *, end_id: int = END_ID, vocabulary: str | None = None, stripe_bytes: int = STRIPE_BYTES
) -> None:
    """Write the token ids of every document (doc_id, text) as ORC in ascending doc_id order.

    Texts are dealt by ranges of doc_id (equal ids by a hash of the text, so that a repeated id can be
    split), sorted, encoded as they stream by, and written. Integers are run-length encoded, every
    ``ROW_INDEX_STRIDE`` rows have minima and maxima, and each stripe has Bloom filters on doc_id.

    A null text counts as empty and gives the end id alone; a null doc_id comes first; repeated rows are
    written as often as they come; an empty table gives no rows; other columns are ignored.
    """
    arrow_by_bytes(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    mixed = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", mixed).sortWithinPartitions("doc_id", mixed)
    coded = ordered.mapInArrow(_encode(end_id, vocabulary or default_vocabulary()), FILE_SCHEMA)
    (
        coded.write.option("compression", "zstd")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROW_INDEX_STRIDE))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """(doc_id, part, part_start, n_tokens, ids) from the files. A condition on doc_id goes to the reader,
    which skips stripes and row groups by their minima, maxima and Bloom filters; stripes are read in
    parallel, as every row holds its own place within its part."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    return rows if where is None else rows.where(where)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        sizes = ids.value_lengths().to_numpy(zero_copy_only=False).astype("int64")
        ends = np.cumsum(sizes)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("part"),
                batch.column("part_start"),
                pa.array(sizes),
                pa.array([zlib.crc32(flat[a:b]) for a, b in zip(ends - sizes, ends, strict=True)], pa.int64()),
            ],
            names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"],
        )


def token_file_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.
    The parts' sizes are added up from the rows read; there is one row for each part."""
    arrow_by_bytes(spark)
    read = read_token_files(spark, path).select("doc_id", "part", "part_start", "ids")
    rows = materialize(read.mapInArrow(_checksums, READ_SCHEMA), "token-digest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    offsets = materialize(
        parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")), "token-parts"
    )
    return rows.join(offsets, "part").select(
        "doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32"
    )
