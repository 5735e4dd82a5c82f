"""Quoted CSV scanned in parallel splits: equal to the one-task reader wherever the splits fall."""

import random

import pytest
from hypothesis import given, settings, strategies as st

from farewatch.sources import uploads as UPL

PIECES = ['"', '""', ",", "\n", "\r\n", "\r", "a", "bc", " ", "é", "\n\n", '"x"', 'y"z', " "]


def rows_of(cells):
    return sorted(((r["upload_id"], r["row_num"], tuple(r["cells"])) for r in cells.collect()), key=str)


@pytest.fixture()
def splits_of(spark):
    """Sets the size of file splits and puts the old one back."""
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    yield lambda size: spark.conf.set(key, size)
    spark.conf.set(key, old)


def write(folder, contents):
    for i, text in enumerate(contents):
        with open(f"{folder}/{i + 1}.csv", "wb") as f:
            f.write(text.encode())


@pytest.mark.parametrize("size, seed", [(45, 2), (400, 3)])
def test_splits_give_the_rows_of_the_one_task_reader(spark, tmp_dir, splits_of, size, seed):
    rng = random.Random(seed)
    contents = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(200))) for _ in range(5)]
    contents = [c + ("" if c.count('"') % 2 == 0 else '"') + "\n" for c in contents]
    contents += ["﻿\"first, cell\",b\nc,d", "", "\n", '"' + "long\ncell " * 30 + '",end\n1,2\n', "a,b\r\n\"c\r\nd\",e\r\n",
                 "plain,1\n" * 30, ",".join(f'"{i}""\n"' for i in range(20)) + "\nlast,row"]
    write(tmp_dir, contents)
    want = rows_of(UPL.read_csv_uploads(spark, tmp_dir))
    splits_of(size)
    assert rows_of(UPL.read_csv_lines(spark, tmp_dir)) == want
    assert len(want) > 60


def test_many_splits_are_joined_without_a_broadcast(spark, tmp_dir, splits_of, monkeypatch):
    write(tmp_dir, ['x,"a\nb"\n' * 12, '"q\n' * 11 + '"\nz,1\n'])
    want = rows_of(UPL.read_csv_uploads(spark, tmp_dir))
    splits_of(40)
    monkeypatch.setattr(UPL, "BROADCAST_MAX_ROWS", 3)
    assert rows_of(UPL.read_csv_lines(spark, tmp_dir)) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40))
def test_line_scanner_agrees_with_the_csv_module(pieces):
    text = "".join(pieces)
    quoted, rows = False, 0
    for line in text.split("\n"):
        quoted, n, start = UPL.scan_line(line, quoted, ",")
        rows += n
        assert not start or line[start - 1] == "\r"
    if not quoted:
        assert rows == len(UPL._parse_csv(text, ","))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40), st.booleans())
def test_row_counter_agrees_with_the_line_scanner(pieces, quoted):
    lines = "".join(pieces).split("\n")
    got = UPL._count_rows(lines, quoted, ",")
    rows = 0
    for line in lines:
        while True:
            quoted, n, start = UPL.scan_line(line, quoted, ",")
            rows += n
            if not (quoted and n):
                break
            line = line[start:]
            quoted = False
    assert got == (rows, quoted)


@pytest.mark.parametrize("ends", [[(0, 1), (1, 0), (0, 0), (1, 0), (1, 1), (1, 0), (1, 0), (0, 1)], [(1, 0)] * 5, [(0, 1)] * 3])
def test_prefix_scan_composes_the_states(spark, ends):
    """Every kind of split function: keeps, swaps, always outside, always inside."""
    rows = [("p", i * 10, bool(a), bool(b), 2 * i + 1, i) for i, (a, b) in enumerate(ends)]
    table = spark.createDataFrame(rows, "path string, block long, end_out boolean, end_in boolean, rows_out long, rows_in long")
    got = {r["block"]: (r["quoted"], r["before"]) for r in UPL.split_starts(table).collect()}
    quoted, before = False, 0
    for _, block, end_out, end_in, rows_out, rows_in in rows:
        assert got[block] == (quoted, before)
        before += rows_in if quoted else rows_out
        quoted = end_in if quoted else end_out
