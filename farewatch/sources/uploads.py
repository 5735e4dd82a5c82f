"""Upload sources (S1-S4): sheet cells -> header discovery -> alias mapping ->
typed rows with a row-error side output.

Input shape everywhere: ``(upload_id LONG, row_num LONG, cells ARRAY<STRING>)``
where ``row_num`` is the 1-based sheet position.  File readers that produce it
(CSV, xlsx, Parquet) are at the bottom.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from farewatch import constants as K
from farewatch.functions import text as X
from farewatch.session import BROADCAST_MAX_ROWS, bounded_broadcast, cut_lineage
from farewatch.sources.xlsx import read_sheet_rows, sheet_bytes

CELLS_SCHEMA = "upload_id long, row_num long, cells array<string>"


def sheet_rows(cells: DataFrame) -> DataFrame:
    """S1 row filter: fully empty rows are skipped; row numbers stay positions."""
    return cells.filter(~F.forall("cells", lambda c: c.isNull()))


def _alias_map() -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(K.HEADER_ALIASES.items())])


def header_candidates(rows: DataFrame, search_rows: int = K.HEADER_SEARCH_ROWS) -> DataFrame:
    """(upload_id, row_num, canonical, idx): first index of every canonical name
    in each of the first ``search_rows`` sheet rows."""
    head = rows.filter(F.col("row_num") <= search_rows)
    exploded = head.select("upload_id", "row_num", F.posexplode("cells").alias("idx", "h"))
    norm = F.lower(X.trim_ws(F.coalesce(F.col("h"), F.lit(""))))
    canon = F.coalesce(F.element_at(_alias_map(), norm), norm)
    return (exploded.withColumn("canonical", canon)
            .groupBy("upload_id", "row_num", "canonical").agg(F.min("idx").alias("idx")))


def discover_headers(rows: DataFrame, search_rows: int = K.HEADER_SEARCH_ROWS) -> DataFrame:
    """Per upload the first row (of the first 20) whose names cover the
    required columns.  Uploads without one get ``header_row`` null and an error
    naming the columns missing from the first row."""
    cand = header_candidates(rows, search_rows)
    req = F.array(*[F.lit(c) for c in K.REQUIRED_COLUMNS])
    per_row = (cand.groupBy("upload_id", "row_num")
               .agg(F.collect_set("canonical").alias("names")))
    ok = per_row.filter(F.size(F.array_intersect("names", req)) == len(K.REQUIRED_COLUMNS))
    hdr = ok.groupBy("upload_id").agg(F.min("row_num").alias("header_row"))
    first = (per_row.groupBy("upload_id")
             .agg(F.min_by("names", "row_num").alias("first_names")))
    uploads = rows.select("upload_id").distinct()
    missing = F.array_sort(F.array_except(req, F.coalesce("first_names", F.array().cast("array<string>"))))
    return (uploads.join(hdr, "upload_id", "left").join(first, "upload_id", "left")
            .select("upload_id", "header_row",
                    F.when(F.col("header_row").isNull(),
                           F.concat(F.lit("missing required columns: "), F.array_join(missing, ", ")))
                    .alias("header_error")))


def validate_columns(cells: DataFrame) -> DataFrame:
    """S2 quick check: (upload_id, valid) -- whether a header row with the
    required columns exists among the first rows; no data row is typed."""
    rows = sheet_rows(cells.filter(F.col("row_num") <= K.HEADER_SEARCH_ROWS))
    return discover_headers(rows).select("upload_id", F.col("header_row").isNotNull().alias("valid"))


def column_map(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """S3: (upload_id, canonical, idx) of the header row; first match wins.

    ``rows`` only needs to contain the header rows (e.g. the stored heads of
    each upload in streaming)."""
    cand = header_candidates(rows)
    return (cand.join(headers.filter(F.col("header_row").isNotNull()),
                      (cand.upload_id == headers.upload_id) & (cand.row_num == headers.header_row))
            .select(cand.upload_id, "canonical", "idx"))


def map_columns(rows: DataFrame, headers: DataFrame, head_rows: DataFrame | None = None) -> DataFrame:
    """S3 applied: data rows (after the header) as named string columns.

    The per-upload column indexes (one row per upload) are broadcast after a
    size check, so data rows are never shuffled by upload id (an upload may
    hold a third of all rows).
    ``head_rows`` supplies the header rows when ``rows`` may lack them.
    """
    cmap = column_map(rows if head_rows is None else head_rows, headers)
    idx = (cmap.filter(F.col("canonical").isin(*K.SHEET_COLUMNS))
           .groupBy("upload_id").pivot("canonical", list(K.SHEET_COLUMNS)).agg(F.first("idx")))
    h = bounded_broadcast(headers.filter(F.col("header_row").isNotNull()).join(idx, "upload_id"))
    data = rows.join(h, "upload_id").filter(F.col("row_num") > F.col("header_row"))
    cols = [F.try_element_at("cells", (F.col(f"`{c}`") + 1).cast("int")).alias(c) if c in idx.columns
            else F.lit(None).cast("string").alias(c) for c in K.SHEET_COLUMNS]
    return data.select("upload_id", "row_num", *cols)


def pick_columns(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """S3 applied from settled headers (upload_id, header_row, columns: name -> index): data rows as named columns."""
    data = rows.join(bounded_broadcast(headers), "upload_id").filter(F.col("row_num") > F.col("header_row"))
    cols = [F.try_element_at("cells", F.try_element_at("columns", F.lit(c)) + 1).alias(c) for c in K.SHEET_COLUMNS]
    return data.select("upload_id", "row_num", *cols)


def type_rows(wide: DataFrame) -> DataFrame:
    """P1-P8 + S4: typed columns and ``error`` (the first failure, or null).

    Values are parsed once; the error text is derived from the parsed
    columns in the original check order: op_type, op_datetime,
    dep_datetime, amount, fee.
    """
    parsed = wide.select(
        "*",
        X.parse_datetime("op_datetime").alias("_op_dt"),
        X.parse_datetime("dep_datetime").alias("_dep_dt"),
    )
    op_err = F.when(F.col("op_type").isNull(), F.lit("op_type is empty"))
    err = F.coalesce(
        op_err,
        X.datetime_error_from("op_datetime", "_op_dt", "op_datetime", required=True),
        X.datetime_error_from("dep_datetime", "_dep_dt", "dep_datetime", required=False),
        X.amount_error("amount", "amount"),
        X.amount_error("fee", "fee"),
    )
    return parsed.select(
        "upload_id", "row_num",
        X.op_type("op_type").alias("op_type"),
        F.col("_op_dt").alias("op_datetime"),
        F.col("_dep_dt").alias("dep_datetime"),
        X.parse_amount("amount").alias("amount"),
        X.parse_amount("fee").alias("fee"),
        X.trim_or_null("train_no").alias("train_no"),
        X.trim_or_null("channel").alias("channel"),
        X.trim_or_null("aggregator").alias("aggregator"),
        X.trim_or_null("terminal").alias("terminal"),
        X.trim_or_null("cashdesk").alias("cashdesk"),
        X.trim_or_null("point_of_sale").alias("point_of_sale"),
        X.trim_or_null("fio").alias("fio"),
        X.extract_iin("iin", "fio").alias("iin"),
        X.trim_or_null("doc_no").alias("doc_no"),
        X.trim_or_null("order_no").alias("order_no"),
        X.trim_or_null("dep_station").alias("dep_station"),
        X.trim_or_null("arr_station").alias("arr_station"),
        X.derive_route("route", "dep_station", "arr_station").alias("route"),
        X.trim_or_null("phone").alias("phone"),
        X.source_default("source").alias("source"),
        F.when(err.isNotNull(), F.concat(F.lit("row "), F.col("row_num").cast("string"), F.lit(": "), err)).alias("error"),
    )


def split_errors(typed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, error rows)."""
    good = typed.filter(F.col("error").isNull()).drop("error")
    bad = typed.filter(F.col("error").isNotNull()).select("upload_id", "row_num", "error")
    return good, bad


def typed_from_cells(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S1-S4 end to end: (typed rows incl. error column, headers, wide rows)."""
    rows = sheet_rows(cells)
    headers = discover_headers(rows)
    wide = map_columns(rows, headers)
    return type_rows(wide), headers, wide


# ---------------------------------------------------------------------------
# File readers -> cells.
# ---------------------------------------------------------------------------

# Decoded rows that leave a task together.
CHUNK_ROWS = 20_000


def _csv_rows(content: bytes, delimiter: str):
    """(row_num, cells) of a file; empty cells are empty texts."""
    import csv
    import io
    import sys

    csv.field_size_limit(sys.maxsize)
    return enumerate(csv.reader(io.TextIOWrapper(io.BytesIO(content), encoding="utf-8-sig", newline=""), delimiter=delimiter), start=1)


def _cells_array(flat: list[str | None], ends: list[int], empty_is_null: bool):
    """Rows of cells as an Arrow array: all cells in a row, and where each row ends."""
    import pyarrow as pa
    import pyarrow.compute as pc

    values = pa.array(flat, pa.string())
    if empty_is_null:
        values = pc.if_else(pc.equal(values, ""), pa.scalar(None, pa.string()), values)
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), values)


def _decode(batches, rows_of, empty_is_null: bool = False):
    """Cells of whole files in chunks of bounded size; ``rows_of(content)`` yields (row_num, cells)."""
    from itertools import islice

    import pyarrow as pa

    for batch in batches:
        for content, upload_id in zip(batch.column("content"), batch.column("upload_id").to_pylist(), strict=True):
            rows = iter(rows_of(content.as_py()))
            while chunk := list(islice(rows, CHUNK_ROWS)):
                flat, ends = [], []
                for _, cells in chunk:
                    flat.extend(cells)
                    ends.append(len(flat))
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(upload_id, pa.int64()), len(chunk)), pa.array([n for n, _ in chunk], pa.int64()),
                     _cells_array(flat, ends, empty_is_null)], ["upload_id", "row_num", "cells"])


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """One row per file; upload_id is the first number in the file name."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return df.select("path", "content", _upload_id(F.col("path")).alias("upload_id"))


def _upload_id(path: Column) -> Column:
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\d+)", 1).cast("long")


def read_csv_uploads(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """S1 (CSV): each file is one upload; rows keep their line positions.

    A file is decoded by one task (sheet-sized inputs); many files spread
    over all tasks.  For large files see ``read_csv_lines``.
    """
    return _files(spark, path, "*.csv").mapInArrow(lambda it: _decode(it, lambda c: _csv_rows(c, delimiter), True), CELLS_SCHEMA)


def scan_line(line: str, quoted: bool, delimiter: str) -> tuple[bool, int, int]:
    """Whether the end of a CSV line lies inside a quoted cell, how many rows end in the line, and where the last row starts.

    ``line`` is text between two line feeds, ``quoted`` says that it starts inside a
    quoted cell.  Quotes count at the start of a cell only; a carriage return
    outside quotes ends a row.
    """
    at, rows, start = 0, 0, 0
    while True:
        if not quoted and line.startswith('"', at):
            quoted, at = True, at + 1
        if quoted:
            close = line.find('"', at)
            while close >= 0 and line.startswith('"', close + 1):
                close = line.find('"', close + 2)
            if close < 0:
                return True, rows, start
            quoted, at = False, close + 1
        cell, ret = line.find(delimiter, at), line.find("\r", at)
        if ret >= 0 and (cell < 0 or ret < cell):
            rows += 1
            if ret == len(line) - 1:
                return False, rows, start
            at = start = ret + 1
        elif cell >= 0:
            at = cell + 1
        else:
            return False, rows + 1, start


def _parse_csv(text: str, delimiter: str) -> list[list[str | None]]:
    import csv
    import io
    import sys

    csv.field_size_limit(sys.maxsize)
    return [[c if c != "" else None for c in rec] for rec in csv.reader(io.StringIO(text + "\n", newline=""), delimiter=delimiter)]


def _records(line: str):
    """A line between two line feeds as the csv module wants it: a carriage return ends a part of its own."""
    import io

    return io.StringIO(f"{line}\n", newline="") if "\r" in line else (f"{line}\n",)


def _count_rows(lines: list[str], quoted: bool, delimiter: str) -> tuple[int, bool]:
    """Rows that end in lines, the first of which starts inside a quoted cell or not, and whether their end lies inside one."""
    import csv

    rows, inside, ended, opening = 0, quoted, False, '"' * quoted

    def feed():
        nonlocal rows, inside, ended, opening
        for line in lines:
            if inside:
                if '"' not in line or '"' not in line.replace('""', ""):  # no quote that ends the cell
                    continue
            elif '"' not in line and "\r" not in line:
                rows += 1
                continue
            for part in _records(line):
                inside = True  # until the reader gives a row
                yield opening + part
                opening = ""
        ended = True

    for _ in csv.reader(feed(), delimiter=delimiter):
        if ended and inside:  # the open row
            break
        rows, inside = rows + 1, False
    return rows, inside


def _split_states(delimiter: str):
    """Per file split: for each state it may start in, the state it ends in and the rows that end in it."""
    def run(batches):
        import csv
        import sys

        import pyarrow as pa

        csv.field_size_limit(sys.maxsize)
        for (path, block, *_), pieces in _split_lines(batches):
            ends, rows = [False, True], [0, 0]
            for lines in pieces:
                known = {s: _count_rows(lines, s, delimiter) for s in set(ends)}
                rows = [n + known[s][0] for n, s in zip(rows, ends)]
                ends = [known[s][1] for s in ends]
            yield pa.RecordBatch.from_pylist(
                [{"path": path, "block": block, "end_out": ends[0], "end_in": ends[1], "rows_out": rows[0], "rows_in": rows[1]}])
    return run


def _split_lines(batches):
    """(its key columns, lists of its lines) for each file split of a task, without the byte order mark.

    The key columns are all but the last: path, block and what a split has besides.
    """
    from itertools import chain, groupby

    import numpy as np
    import pyarrow.compute as pc

    def pieces():
        for b in batches:
            if not b.num_rows:
                continue
            paths, blocks = b.column(0), b.column(1).to_numpy()
            cuts = (blocks[1:] != blocks[:-1]) | pc.not_equal(paths[1:], paths[:-1]).to_numpy(zero_copy_only=False)
            lines = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            for i, j in zip(chain([0], at := (np.flatnonzero(cuts) + 1).tolist()), chain(at, [b.num_rows])):
                yield tuple(b.column(k)[i].as_py() for k in range(b.num_columns - 1)), lines[i:j].tolist()

    def unmarked(key, own):
        for i, (_, lines) in enumerate(own):
            if i == 0 and key[1] == 0:
                lines[0] = lines[0].removeprefix("\ufeff")
            yield lines

    for key, own in groupby(pieces(), key=lambda p: p[0]):
        yield key, unmarked(key, own)


def _split_rows(delimiter: str):
    """Rows that lie in one split, and the pieces of those that cross its ends (cells null, text set)."""
    def run(batches):
        import csv
        import sys
        from itertools import chain

        import pyarrow as pa

        csv.field_size_limit(sys.maxsize)

        def frame(path, block, first, flat, ends):
            n = len(ends)
            return pa.RecordBatch.from_arrays(
                [pa.repeat(path, n), pa.repeat(pa.scalar(block, pa.int64()), n), pa.array(range(first, first + n), pa.int64()),
                 _cells_array(flat, ends, True), pa.nulls(n, pa.string())], ["path", "block", "row_num", "cells", "text"])

        def piece(path, block, row_num, text):
            return pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([block], pa.int64()), pa.array([row_num], pa.int64()),
                 pa.nulls(1, pa.list_(pa.string())), pa.array([text], pa.string())], ["path", "block", "row_num", "cells", "text"])

        for (path, block, quoted, number), pieces in _split_lines(batches):
            lines = chain.from_iterable(pieces)
            held = []
            if quoted:  # the row that an earlier split began, with others that end in its last line
                for line in lines:
                    quoted, rows, start = scan_line(line, quoted, delimiter)
                    if quoted and rows:  # rows end at carriage returns, and the line goes on in a new one
                        held.append(line[:start])
                        lines = chain([line[start:]], lines)
                    else:
                        held.append(line)
                    if rows:
                        break
                yield piece(path, block, number + 1, "\n".join(held))
                if quoted and not rows:
                    continue
                number, held = number + rows, []
            ended, flat, ends = False, [], []

            def feed():
                nonlocal ended
                for line in lines:
                    for part in _records(line):
                        held.append(part)
                        yield part
                ended = True

            for cells in csv.reader(feed(), delimiter=delimiter):
                if ended and held:  # the row that goes on in a later split
                    break
                held.clear()
                flat.extend(cells)
                ends.append(len(flat))
                if len(ends) >= CHUNK_ROWS:
                    yield frame(path, block, number + 1, flat, ends)
                    number, flat, ends = number + len(ends), [], []
            if ends:
                yield frame(path, block, number + 1, flat, ends)
            if held:
                yield piece(path, block, number + len(ends) + 1, "".join(held).removesuffix("\n"))
    return run


def read_csv_lines(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """S1 (CSV): files of any size, scanned in parallel splits; cells may hold line breaks, quotes and delimiters.

    Whether a split starts inside a quoted cell depends on all splits before it.
    Each split is first read as a function from the state it starts in to the
    state it ends in and its number of rows; a prefix scan over the splits of
    a file (one row each) composes the functions: the last split that ends in
    one state whatever its start, then the parity of those that swap the states
    since.  A second scan cuts the rows; pieces of a row that crosses splits
    are put together by its number.  Row numbers are those of ``read_csv_uploads``.
    """
    lines = (spark.read.option("pathGlobFilter", "*.csv").option("lineSep", "\n").text(path)
             .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value"))
    states = cut_lineage(lines.mapInArrow(
        _split_states(delimiter), "path string, block long, end_out boolean, end_in boolean, rows_out long, rows_in long"), "csv-states")
    starts = cut_lineage(split_starts(states), "csv-starts")
    if starts.count() <= BROADCAST_MAX_ROWS:
        placed = lines.join(F.broadcast(starts), ["path", "block"])
    else:  # a shuffle loses the order of the lines
        placed = (lines.withColumn("at", F.monotonically_increasing_id()).join(starts, ["path", "block"])
                  .sortWithinPartitions("path", "block", "at").drop("at"))
    found = cut_lineage(placed.select("path", "block", "quoted", "before", "value").mapInArrow(
        _split_rows(delimiter), "path string, block long, row_num long, cells array<string>, text string"), "csv-rows")

    def whole(frames):
        import pandas as pd

        for f in frames:
            rows = [(p, n + i, cells) for p, n, t in zip(f["path"], f["row_num"], f["text"], strict=True)
                    for i, cells in enumerate(_parse_csv(t, delimiter))]
            yield pd.DataFrame(rows, columns=["path", "row_num", "cells"])

    crossing = (found.where("text IS NOT NULL").groupBy("path", "row_num")
                .agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("pieces"))
                .select("path", "row_num", F.array_join(F.col("pieces.text"), "\n").alias("text"))
                .mapInPandas(whole, "path string, row_num long, cells array<string>"))
    rows = found.where("text IS NULL").select("path", "row_num", "cells").unionByName(crossing)
    return rows.select(_upload_id(F.col("path")).alias("upload_id"), "row_num", "cells")


def split_starts(states: DataFrame) -> DataFrame:
    """(path, block, quoted, before): the state in which each split starts and the rows that end before it."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("end_out") == F.col("end_in"), F.struct(F.col("end_out").alias("state"), F.col("swaps").alias("at")))
    base = F.last(fixed, ignorenulls=True).over(before)
    composed = (states.withColumn("swaps", F.sum((F.col("end_out") & ~F.col("end_in")).cast("long")).over(
                    Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
                .withColumn("base", base)
                .withColumn("earlier", F.coalesce(F.lag("swaps").over(Window.partitionBy("path").orderBy("block")), F.lit(0))))
    odd = (F.col("earlier") - F.coalesce("base.at", F.lit(0))) % 2 == 1
    composed = composed.withColumn("quoted", F.coalesce("base.state", F.lit(False)) != odd)
    rows = F.when(F.col("quoted"), F.col("rows_in")).otherwise(F.col("rows_out"))
    return composed.withColumn("ended", rows).select(
        "path", "block", "quoted", F.coalesce(F.sum("ended").over(before), F.lit(0)).alias("before"))


def read_xlsx_uploads(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """S1 (xlsx): first sheet by default, or one by position or name; decoded with the standard library.

    A missing sheet is an error that lists the workbook's sheets.
    """
    return _files(spark, path, "*.xlsx").mapInArrow(lambda it: _decode(it, lambda c: read_sheet_rows(c, sheet)), CELLS_SCHEMA)


# Rows of one written file; the number in its name is upload_id * FILE_PARTS + part.
FILE_ROWS = 50_000
FILE_PARTS = 1_000_000


def _csv_bytes(rows) -> bytes:
    import csv
    import io

    out, at = io.StringIO(newline=""), 0
    writer = csv.writer(out, lineterminator="\n")
    for row_num, cells in rows:
        out.write("\n" * (row_num - at - 1))
        writer.writerow(cells)
        at = row_num
    return out.getvalue().encode("utf-8")


def _write_file(uri: str, content: bytes) -> None:
    import re

    from pyarrow import fs

    store, target = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri) if ":/" in uri else f"file://{uri}")
    store.create_dir(target.rpartition("/")[0], recursive=True)
    with store.open_output_stream(target, compression=None) as f:
        f.write(content)


def write_uploads(cells: DataFrame, path: str, *kinds: str) -> DataFrame:
    """Sheet cells as ``csv`` or ``xlsx`` files in a shared folder; rows keep their positions.

    A file holds ``FILE_ROWS`` positions of one upload, so no task sees a whole
    upload.  A repeated task attempt writes the same file again.  Several kinds
    are written by one job, from one shuffle of the cells.  Returns the files
    (upload_id, part, rows); ``whole_uploads`` undoes the cut on reading.
    """
    if not kinds or set(kinds) - {"csv", "xlsx"}:
        raise ValueError(f"uploads are written as csv or xlsx, not {', '.join(map(repr, kinds)) or 'as nothing'}")
    parts = cells.withColumn("part", F.expr(f"(row_num - 1) div {FILE_ROWS}"))
    files = (parts.groupBy("upload_id", "part").applyInArrow(_file_writer(path, kind), "upload_id long, part long, rows long") for kind in kinds)
    return cut_lineage(reduce(DataFrame.unionByName, files), "upload-files")


def _file_writer(path: str, kind: str):
    file_parts, file_rows = FILE_PARTS, FILE_ROWS

    def write(key, group):
        import pyarrow as pa

        upload_id, part = (k.as_py() for k in key)
        group = group.select(["row_num", "cells"]).sort_by("row_num").combine_chunks()
        numbers, cells = (group.column(c).combine_chunks() for c in ("row_num", "cells"))
        flat, ends = cells.values.to_numpy(zero_copy_only=False).tolist(), cells.offsets.to_pylist()
        rows = ((n - part * file_rows, flat[i:j]) for n, i, j in zip(numbers.to_pylist(), ends[:-1], ends[1:], strict=True))
        _write_file(f"{path}/{upload_id * file_parts + part}.{kind}", sheet_bytes(rows) if kind == "xlsx" else _csv_bytes(rows))
        return pa.table({"upload_id": pa.array([upload_id], pa.int64()), "part": pa.array([part], pa.int64()),
                         "rows": pa.array([len(numbers)], pa.int64())})
    return write


def whole_uploads(cells: DataFrame) -> DataFrame:
    """Cells read from the files of ``write_uploads`` under their upload's id and positions."""
    return cells.select(F.expr(f"upload_id div {FILE_PARTS}").alias("upload_id"),
                        (F.col("row_num") + F.col("upload_id") % FILE_PARTS * FILE_ROWS).alias("row_num"), "cells")


def read_parquet_uploads(spark: SparkSession, path: str) -> DataFrame:
    """S1 (Parquet): already in cells shape; fully parallel scan."""
    return spark.read.schema(CELLS_SCHEMA).parquet(path)
