"""Quoted CSV files cut into blocks anywhere."""

import csv
import io
import random

import pytest

from reviewlens.sources import csv_blocks, read_reviews_csv

SPLIT = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}


@pytest.fixture
def small_blocks(spark):
    before = {k: spark.conf.get(k, None) for k in SPLIT}
    for k, v in SPLIT.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _cell(rng):
    n = rng.choice([0, 1, 3, 8, 30, 400])
    return "".join(rng.choice(['"', ",", "\n", "\r\n", "a", "b", " ", "é", '""', "x,y\n"]) for _ in range(rng.randint(0, n)))


def _write(rows, rng, ends):
    out = io.StringIO(newline="")
    quote = lambda x: '"' + x.replace('"', '""') + '"'
    plain = lambda x: not set(x) & set(',\n\r"') and rng.random() < 0.7
    for row in rows:
        out.write(",".join(x if plain(x) else quote(x) for x in row) + ends)
        if rng.random() < 0.1:
            out.write(ends)  # a blank line
    return out.getvalue()


@pytest.mark.parametrize("seed, ends", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_blocks_give_the_records_of_the_whole_file(spark, tmp_path, small_blocks, seed, ends):
    rng = random.Random(seed)
    rows = [[f"r{i}", _cell(rng), f"5{ends}" if seed == 3 else "5\" tv", _cell(rng)] for i in range(150)]
    text = _write([["id", "text", "size", "more"], *rows], rng, ends)
    if seed != 3:
        text = text.replace('"5"" tv"', '5" tv')  # a quote within an unquoted cell
    path = tmp_path / "r.csv"
    path.write_bytes(("﻿" * (seed == 2) + text).encode())
    found = read_reviews_csv(spark, str(path), row_id=True)
    assert found.rdd.getNumPartitions() > 20
    got = [tuple(r)[:-1] for r in found.orderBy("row_id").collect()]
    wanted = [x for x in csv.reader(io.StringIO(text, newline="")) if x][1:]
    assert len(wanted) == 150
    assert got == [tuple(c or None for c in row) for row in wanted]


def test_a_record_longer_than_many_blocks_and_one_that_never_ends(spark, tmp_path, small_blocks):
    long = "line with a comma, and more\n" * 100
    (tmp_path / "a.csv").write_text(f'text,rating\n"{long}",4\nb,5\n"never, ends\n' + "c,3\n" * 200)
    rows = [tuple(r) for r in read_reviews_csv(spark, str(tmp_path / "a.csv"), row_id=True).orderBy("row_id").collect()]
    assert [r[:2] for r in rows[:2]] == [(long, "4"), ("b", "5")]
    assert len(rows) == 3 and rows[2][0].startswith("never, ends\nc,3\n")
    states = csv_blocks.blocks(spark, [str(tmp_path / "a.csv")])
    assert states.where("inside").count() > 10


def test_header_with_line_breaks_after_blank_blocks(spark, tmp_path, small_blocks):
    wide = "a\n" * 300
    (tmp_path / "a.csv").write_text("\n" * 700 + f'"te\nxt","{wide}",rating\nx,y,5\n')
    (tmp_path / "b.csv").write_text("\n\r\n")
    frame = read_reviews_csv(spark, str(tmp_path))
    assert frame.columns == ["te\nxt", wide, "rating"]
    assert [tuple(r) for r in frame.collect()] == [("x", "y", "5")]


def test_lines_as_records(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text('text,rating\n"open,1\n' + "b,2\n" * 300)
    assert read_reviews_csv(spark, str(tmp_path), multi_line=False).where("text = 'b'").count() == 300
    assert read_reviews_csv(spark, str(tmp_path)).where("text = 'b'").count() == 0


def test_files_without_a_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n\n")
    with pytest.raises(ValueError, match="no header"):
        read_reviews_csv(spark, str(tmp_path))
