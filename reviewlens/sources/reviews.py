"""Review sources: tolerant CSV, header normalisation, canonical names, the test-table view."""

from __future__ import annotations

import csv
import io
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.config import ALIASES, CSV_NULL_TOKENS, REQUIRED_COLUMNS
from reviewlens.sources import csv_blocks
from reviewlens.storage import materialize

_FLAGGED, _FILE, _PLACE = "_flagged", "_file", "_place"
CSV_OPTIONS = {
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "mode": "PERMISSIVE",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "maxCharsPerColumn": "-1",
}
#: A cell of a CSV line, quoted or not, as a regular expression.
_CELL = r'(?:"(?:[^"]++|"")*+"[^,]*+|[^,"][^,]*+|)'


def _unique(names: list[str]) -> list[str]:
    """Number repeated names as ``a``, ``a.1``, ``a.2``; name blank ones by position."""
    seen: dict[str, int] = {}
    out = []
    for position, name in enumerate(names):
        name = name or f"unnamed: {position}"
        count = seen.get(name, 0)
        seen[name] = count + 1
        out.append(name if count == 0 else f"{name}.{count}")
    return out


def _names(header: str) -> tuple[str, ...]:
    return tuple(_unique(next(csv.reader(io.StringIO(header.removesuffix("\r"), newline="")))))


def _cells(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The cells of records under a header, with their file and place. Spark flags a record whose number of fields is not that of the
    header; of these the ones with more are dropped, empty cells or not."""
    plain = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"{x} string" for x in [*plain, _FLAGGED])
    parsed = rows.withColumn("_cells", F.from_csv("record", schema, {**CSV_OPTIONS, "columnNameOfCorruptRecord": _FLAGGED}))
    too_many = F.col(f"_cells.{_FLAGGED}").rlike(f"^(?:{_CELL},){{{len(names)}}}")
    parsed = parsed.filter(F.col(f"_cells.{_FLAGGED}").isNull() | ~too_many)
    found = [F.col(f"_cells.{x}") for x in plain]
    cells = [F.when(~x.isin(*CSV_NULL_TOKENS), x).alias(n) for x, n in zip(found, names)]
    return parsed.select(*cells, F.col("file").alias(_FILE), F.col("place").alias(_PLACE))


def read_reviews_csv(spark: SparkSession, path: str, *, multi_line: bool = True, row_id: bool = False) -> DataFrame:
    """All-string CSV scan of a file or folder. Each file is read by its own header; columns that a file lacks are null.
    Lines with too many fields are skipped, also where the cells beyond the header are empty; short lines are padded
    with nulls, and the usual missing-value tokens become nulls. Outer whitespace is kept.

    Quoted cells, those of the header too, may hold line breaks. A file of any size is read by as many tasks as it has blocks, in two
    scans: one for the state at the begin of each block and the headers of all files, one for the records. With
    ``multi_line=False`` every line is a record. Records end with a line feed, after a carriage return or not.
    ``row_id`` adds the input order, by file name and then by line, unless the files have such a column.
    The driver gets the name and header of each file, nothing more.
    """
    listed = sorted(spark.read.text(path).inputFiles())
    states = csv_blocks.blocks(spark, [unquote(f) for f in listed], multi_line)
    order = spark.createDataFrame([(f, i) for i, f in enumerate(listed)], "path string, _rank long")
    order = order.select(csv_blocks.file_key(F.col("path")).alias(_FILE), "_rank")
    firsts = materialize(csv_blocks.first_records(states).join(order.withColumnRenamed(_FILE, "file"), "file"), "csv-headers")
    groups: dict[tuple[str, ...], list[int]] = {}
    for row in firsts.select("record", "_rank").orderBy("_rank").collect():  # one row for each file
        groups.setdefault(_names(row["record"]), []).append(row["_rank"])
    if not groups:
        raise ValueError(f"no header line in {path}")
    begin = firsts.select("file", F.col("place").alias("_first"))
    scans = []
    for names, ranks in groups.items():
        files = order.join(spark.createDataFrame([(i,) for i in ranks], "_rank long"), "_rank").select(F.col(_FILE).alias("file"))
        own = states.join(F.broadcast(files), "file") if len(groups) > 1 else states
        rows = csv_blocks.records(spark, [unquote(listed[i]) for i in ranks], own, multi_line)
        scans.append(_cells(rows.join(F.broadcast(begin), "file").where("place > _first"), names))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
    if row_id and "row_id" not in {n.strip().lower() for n in rows.columns}:
        place = F.shiftleft("_rank", csv_blocks.PLACE_BITS).bitwiseOR(F.col(_PLACE))
        rows = rows.join(F.broadcast(order), _FILE).withColumn("row_id", place).drop("_rank")
    return rows.drop(_FILE, _PLACE)


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip().lower() for name in df.columns])


def canonicalize(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Rename aliases to canonical names. When several aliases of one name are present, the first
    non-null value in alias order is taken. Other columns keep their names."""
    aliases = ALIASES if aliases is None else aliases
    targets: dict[str, list[str]] = {}
    for alias, target in aliases.items():
        if alias in df.columns:
            targets.setdefault(target, []).append(alias)
    for name in REQUIRED_COLUMNS:
        if name not in targets:
            raise ValueError(f"no '{name}' column found")
    columns = []
    done = set()
    for name in df.columns:
        target = aliases.get(name)
        if target is None:
            columns.append(F.col(f"`{name}`"))
        elif target not in done:
            done.add(target)
            columns.append(F.coalesce(*[F.col(f"`{a}`") for a in targets[target]]).alias(target))
    return df.select(*columns)


def reviews_from_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents as raw reviews, with messy ratings, blank summaries, missing texts
    and outer whitespace. Both inputs are keyed by doc_id; Spark picks the join by their sizes."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("_labelled", F.lit(True))
    doc_id, text = F.col("doc_id"), F.col("text")
    stars = (
        F.when((F.col("quality") == 0) & (F.col("toxic") == 1), F.lit(1))
        .when(F.col("quality") == 0, F.lit(2))
        .when(F.col("toxic") == 1, F.lit(3))
        .otherwise(4 + doc_id % 2)
    )
    suffix = (
        F.when(doc_id % 3 == 0, F.lit("")).when(doc_id % 3 == 1, F.lit(".0")).otherwise(F.lit(" stars"))
    )
    return documents.join(labels, "doc_id", "left").select(
        doc_id.alias("row_id"),
        F.when(doc_id % 97 == 5, F.lit(None).cast("string"))
        .when(doc_id % 89 == 7, F.concat(F.lit("\t"), text, F.lit(" \n")))
        .otherwise(text)
        .alias("review_text"),
        F.when(F.col("_labelled"), F.concat(stars.cast("string"), suffix)).alias("rating"),
        F.when(doc_id % 5 == 0, F.lit(None).cast("string"))
        .when(doc_id % 5 == 1, F.lit("nan"))
        .when(doc_id % 5 == 2, F.lit(""))
        .otherwise(F.substring(text, 1, 20))
        .alias("summary"),
        (doc_id % 2 == 0).alias("verified_purchase"),
        (doc_id % 17).alias("helpful_votes"),
        F.concat(F.lit("P"), (doc_id % 50).cast("string")).alias("product_id"),
        F.col("source").alias("reviewer_id"),
    )
