"""Running sums along an order, over tables of any size.

Rows are dealt by ranges of the order and sorted within their part. Each task sums its own part as it streams by; the totals of the
parts, one row for each group and part, give what lies before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.storage import materialize

PART, PLACE, _GROUP = "_part", "_place", "_group"


def _summed(batches: Iterator[pa.RecordBatch], sums: list[str], ahead: list[str]) -> Iterator[pa.RecordBatch]:
    part, group, held = TaskContext.get().partitionId(), None, None
    carried = np.zeros(len(sums) + 1, "int64")

    def out(rows: pa.Table, following: pa.Table | None) -> Iterator[pa.RecordBatch]:
        """Rows whose next rows are known: those after them, then ``following``, if any."""
        nonlocal group, carried
        groups = rows[_GROUP].to_numpy()
        begins = np.append(groups[0] != group, groups[1:] != groups[:-1])
        values = np.stack([np.ones(len(groups), "int64"), *(rows[x].to_numpy() for x in sums)], axis=1).astype("int64")
        values[0] += 0 if begins[0] else carried
        run = np.cumsum(values, axis=0)
        starts = np.flatnonzero(np.append(True, begins[1:]))
        run -= np.repeat(run[starts] - values[starts], np.diff(np.append(starts, len(groups))), axis=0)
        group, carried = groups[-1], run[-1]
        after = rows.slice(1) if following is None else pa.concat_tables([rows.slice(1), following])
        same = after[_GROUP].to_numpy() == groups[: len(after)]
        columns = {x: rows[x] for x in rows.column_names if x != _GROUP}
        columns[PART] = pa.array(np.full(len(groups), part, "int32"))
        columns[PLACE] = pa.array(run[:, 0])
        for k, x in enumerate(sums):
            columns[f"run_{x}"] = pa.array(run[:, k + 1])
        for x in ahead:
            known = np.append(after[x].to_numpy(), np.zeros(len(groups) - len(after), "int64"))
            columns[f"next_{x}"] = pa.array(known, pa.int64(), mask=~np.append(same, np.zeros(len(groups) - len(after), bool)))
        yield from pa.table(columns).to_batches()

    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            held = rows.slice(len(rows) - 1)
            if len(rows) > 1:
                yield from out(rows.slice(0, len(rows) - 1), held)
    if held is not None:
        yield from out(held, None)


def within_parts(
    df: DataFrame, group: list[str], order: list[Column], sums: list[str], ahead: list[str] = (), parts: int | None = None
) -> DataFrame:
    """Adds to each row its part, its place in it (from 1), ``run_x`` for each of ``sums`` (not negative whole numbers) up to the row, and
    ``next_x``, what the following row of the part has, for each of ``ahead``; all within ``group``. ``parts`` is their number (by default that of shuffles)."""
    longs = [*[F.col(x).cast("long").alias(x) if x in (*sums, *ahead) else F.col(x) for x in df.columns]]
    marked = df.select(*longs, F.xxhash64(*group).alias(_GROUP) if group else F.lit(0).cast("long").alias(_GROUP))
    keys = [*group, *order]
    ordered = marked.repartitionByRange(*([parts] if parts else []), *keys).sortWithinPartitions(*keys)
    kept = [f for f in marked.schema.fields if f.name != _GROUP]
    more = [T.StructField(PART, T.IntegerType()), T.StructField(PLACE, T.LongType())]
    more += [T.StructField(x, T.LongType()) for x in [*(f"run_{x}" for x in sums), *(f"next_{x}" for x in ahead)]]
    names = (list(sums), list(ahead))
    return ordered.mapInArrow(lambda batches: _summed(batches, *names), T.StructType([*kept, *more]))


def running(
    df: DataFrame, group: list[str], order: list[Column], sums: list[str], ahead: list[str] = (), parts: int | None = None
) -> DataFrame:
    """Adds along ``order`` within ``group``: rank (from 1), rows (the group's number), ``run_x`` up to the row and ``all_x`` of the group for
    each of ``sums``, and ``next_x`` of the following row (null at the end) for each of ``ahead``.

    Rows that are equal in ``order`` come in any sequence. The scanned rows are written once; the totals of the parts are joined.
    ``df`` is read twice, for the ranges' bounds and for the rows.
    """
    stored = materialize(within_parts(df, group, order, sums, ahead, parts), "scan")
    keys = [*group, PART]
    first = F.max(F.when(F.col(PLACE) == 1, F.struct(*ahead))) if ahead else F.lit(None)
    totals = stored.groupBy(*keys).agg(
        F.max(PLACE).alias(PLACE), *[F.max(f"run_{x}").alias(f"run_{x}") for x in sums], first.alias("_first")
    )
    along = Window.partitionBy(*(group or [F.lit(0)])).orderBy(PART)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    names = [PLACE, *(f"run_{x}" for x in sums)]
    offsets = totals.select(
        *keys, *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"_before{x}") for x in names],
        F.sum(PLACE).over(whole).alias("rows"), *[F.sum(f"run_{x}").over(whole).alias(f"all_{x}") for x in sums],
        F.lead("_first").over(along).alias("_following"),
    )
    joined = stored.join(offsets, keys)
    return joined.select(
        *df.columns, (F.col(PLACE) + F.col(f"_before{PLACE}")).alias("rank"), "rows",
        *[(F.col(f"run_{x}") + F.col(f"_beforerun_{x}")).alias(f"run_{x}") for x in sums], *[f"all_{x}" for x in sums],
        *[F.coalesce(f"next_{x}", F.col(f"_following.{x}")).alias(f"next_{x}") for x in ahead],
    )
