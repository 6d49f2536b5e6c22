"""Quoted CSV cut at true record ends, whatever split a line falls into."""
import csv
import random

import pytest

from statproof.sources import split_csv
from statproof.sources.articles import read_articles


def _write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(["title", "date", "body"])
        w.writerows(rows)


def _rows(seed, n=300):
    rng = random.Random(seed)
    parts = ['"', '""', "\n", "\r\n", ",", "가나다", "text ", "' ", "\n\n", "x" * 40]
    return [(f"t{i}", "2024-01-02", "b" + "".join(rng.choice(parts) for _ in range(rng.randrange(12))) + "e") for i in range(n)]


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_splits_of_a_few_lines_give_the_rows_of_the_writer(small_splits, tmp_path, end):
    folder = tmp_path / "csv"
    folder.mkdir()
    rows = _rows(1), _rows(2) + [("long", "2024-01-02", "line\n" * 300)]
    for i, part in enumerate(rows):
        _write(folder / f"p{i}.csv", part, end)
    assert split_csv._lines(small_splits, str(folder)).rdd.getNumPartitions() > 20
    assert split_csv._starts(split_csv._lines(small_splits, str(folder))).count() > 5
    got = split_csv.read_csv_splits(small_splits, str(folder)).orderBy("row_no").collect()
    assert [(r.title, r.date, r.body) for r in got] == list(rows[0] + rows[1])


def test_beyond_the_broadcast_limit_rows_are_the_same(small_splits, tmp_path, monkeypatch):
    path = tmp_path / "a.csv"
    _write(path, _rows(3, 120))
    want = [tuple(r) for r in split_csv.read_csv_splits(small_splits, str(path)).orderBy("row_no").collect()]
    monkeypatch.setattr(split_csv, "_LIMIT", -1)
    assert [tuple(r) for r in split_csv.read_csv_splits(small_splits, str(path)).orderBy("row_no").collect()] == want


def test_same_articles_as_the_whole_file_reader(small_splits, tmp_path):
    path = tmp_path / "a.csv"
    _write(path, _rows(4) + [("", "", ""), ("only title", "", "")])
    whole, parts = (read_articles(small_splits, str(path), kind).drop("row_no") for kind in ("csv", "csv_splits"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_header_alone_and_blank_lines(spark, tmp_path):
    (tmp_path / "h.csv").write_text("title,date,body\n\n\r\n")
    assert split_csv.read_csv_splits(spark, str(tmp_path / "h.csv")).count() == 0
    (tmp_path / "g.csv").write_text('﻿title,date,body\n"a\nb",,\n\nc')
    got = split_csv.read_csv_splits(spark, str(tmp_path / "g.csv")).orderBy("row_no").collect()
    assert [(r.title, r.date, r.body) for r in got] == [("a\nb", None, None), ("c", None, None)]
