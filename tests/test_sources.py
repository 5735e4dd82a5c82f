"""Upload file readers (CSV, xlsx, Parquet) and the ingest/scoring jobs."""

import csv
import os
import zipfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from farewatch.plans import jobs as JB
from farewatch.plans.store import TableStore
from farewatch.sources import fixtures as FX
from farewatch.sources import uploads as UPL

HEADER = ["Тип операции", "Дата операции", "Сумма", "ФИО", "Номер документа"]
DATA = [["Продажа", "05.01.2024 10:20", "1 234,50", "Иванов Иван", "N1"],
        [None, None, None, None, None],
        ["возврат", "2024-01-06", "10", "Иванов Иван", "N1"],
        ["гашение", "garbage", "5", "Петров", "N2"]]


def _write_csv(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        for r in rows:
            w.writerow(["" if c is None else c for c in r])


def _col(i):
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def _write_xlsx(path, rows):
    from xml.sax.saxutils import escape
    sheet_rows = []
    for ri, r in enumerate(rows, start=1):
        cells = "".join(f'<c r="{_col(ci)}{ri}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
                        for ci, v in enumerate(r) if v is not None)
        if cells:
            sheet_rows.append(f'<row r="{ri}">{cells}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rns}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml" '
                   'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{"".join(sheet_rows)}</sheetData></worksheet>')


def _check_typed(cells):
    typed, headers, _ = UPL.typed_from_cells(cells)
    good, bad = UPL.split_errors(typed)
    h = {r["upload_id"]: r["header_row"] for r in headers.collect()}
    g = sorted((r["upload_id"], r["row_num"], r["op_type"], r["amount"]) for r in good.collect())
    b = sorted((r["upload_id"], r["row_num"]) for r in bad.collect())
    return h, g, b


def test_csv_and_xlsx_readers_agree(spark, tmp_dir):
    rows = [["Отчёт"], [None]] + [HEADER] + DATA
    _write_csv(os.path.join(tmp_dir, "upload_7.csv"), rows)
    _write_xlsx(os.path.join(tmp_dir, "upload_8.xlsx"), rows)
    csv_cells = UPL.read_csv_uploads(spark, tmp_dir)
    xlsx_cells = UPL.read_xlsx_uploads(spark, tmp_dir)
    hc, gc, bc = _check_typed(csv_cells)
    hx, gx, bx = _check_typed(xlsx_cells)
    assert hc == {7: 3} and hx == {8: 3}
    assert [x[1:] for x in gc] == [x[1:] for x in gx] == [(4, "sale", 1234.5), (6, "refund", 10.0)]
    assert [x[1] for x in bc] == [x[1] for x in bx] == [7]


def test_csv_lines_keep_positions_over_many_splits(spark, tmp_dir):
    rows = [["Отчёт"], [], HEADER] + [[f"строка {i}", 'a "b", c', "", f"{i}"] if i % 7 else [] for i in range(900)]
    for upload in (1, 2):
        with open(os.path.join(tmp_dir, f"upload_{upload}.csv"), "w", newline="", encoding="utf-8-sig") as f:
            csv.writer(f, lineterminator="\r\n" if upload == 1 else "\n").writerows(rows[:upload * 450])
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = sorted(map(tuple, UPL.read_csv_lines(spark, tmp_dir).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    assert got == sorted(map(tuple, UPL.read_csv_uploads(spark, tmp_dir).collect()))
    assert [r[1] for r in got if r[0] == 1] == list(range(1, 451))


def test_written_uploads_read_back(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(UPL, "FILE_ROWS", 100)
    cells = spark.createDataFrame([(u, n, [f"<r {n}>", None, 'q"&, ', "Ж"][:n % 4 + 1]) for u in (3, 4) for n in range(1, 350) if n % 5],
                                  UPL.CELLS_SCHEMA)
    want = sorted(map(tuple, cells.collect()))
    for kind, read in (("csv", UPL.read_csv_uploads), ("csv", UPL.read_csv_lines), ("xlsx", UPL.read_xlsx_uploads)):
        files = UPL.write_uploads(cells, f"{tmp_dir}/{kind}", kind)
        assert files.count() == 8 and files.agg(F.sum("rows")).first()[0] == len(want)
        # A sheet reader does not return trailing empty cells.
        got = UPL.whole_uploads(UPL.sheet_rows(read(spark, f"{tmp_dir}/{kind}"))).collect()
        assert sorted((u, n, _trimmed(c)) for u, n, c in got) == [(u, n, _trimmed(c)) for u, n, c in want]


def _trimmed(cells):
    return cells[:max((i for i, c in enumerate(cells) if c is not None), default=-1) + 1]


def test_missing_header_is_reported(spark):
    cells = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["x", "y"])], UPL.CELLS_SCHEMA)
    h = UPL.discover_headers(UPL.sheet_rows(cells)).first()
    assert h["header_row"] is None
    assert h["header_error"] == "missing required columns: amount, op_datetime, op_type"


def test_jobs_end_to_end_idempotent(spark):
    store = TableStore(spark)
    cells = FX.events_sheet_cells(spark, SF_SMALL)
    JB.ingest_cells(store, cells)
    n1 = store.read_log("transactions").count()
    JB.ingest_cells(store, cells)  # re-upload of the same sheets
    assert store.read_log("transactions").count() == n1
    assert store.read("passengers").count() == store.read_log("transactions").select("passenger_id").distinct().count()
    JB.scoring_run(store, with_ml=True)
    scores = store.read("passenger_scores")
    assert scores.count() == store.read("passengers").count()
    assert scores.filter((F.col("ml_score") < 0) | (F.col("ml_score") > 100)).count() == 0
    # a manual override survives the next scoring run
    pid = scores.first()["passenger_id"]
    ovr = spark.createDataFrame([(pid, "critical", "checked", 1)],
                                "passenger_id long, new_band string, reason string, actor_user_id long")
    JB.override(store, ovr)
    JB.scoring_run(store, with_ml=False)
    row = store.read("passenger_scores").filter(F.col("passenger_id") == pid).first()
    assert row["risk_band"] == "critical" and row["is_manual"]
    ev = store.read_log("job_events")
    assert ev.filter(F.col("status") == "done").count() == 2


def test_streaming_equals_batch(spark):
    import __spark_entry__ as E
    from farewatch.operators import risk as RK
    from farewatch.plans.pipeline import events_state

    st = events_state(spark, SF_SMALL)
    batch_trend = sorted(tuple(r) for r in RK.risk_trend(st.transactions, st.scores).collect())
    stream_trend = sorted(tuple(r) for r in E.queries()["stream_trend"](spark, SF_SMALL).collect())
    assert batch_trend == stream_trend
    dedup = E.queries()["stream_dedup"](spark, SF_SMALL)
    assert dedup.count() == st.transactions.count() == dedup.select("id").distinct().count()


def test_validate_columns_and_exports(spark, tmp_dir):
    cells = FX.events_sheet_cells(spark, SF_SMALL)
    assert {r["upload_id"]: r["valid"] for r in UPL.validate_columns(cells).collect()} == {1: True, 2: True, 3: True}
    store = TableStore(spark)
    out = JB.ingest_cells(store, cells)
    assert out["rows_read"] > out["parse_errors"] > 0
    JB.scoring_run(store, with_ml=False, rule_weight=1.0, ml_weight=0.0)
    paths = JB.export_reports(store, tmp_dir + "/reports")
    sus = spark.read.option("header", True).csv(paths["suspicious"])
    assert sus.columns == ["id", "op_type", "op_datetime", "dep_datetime", "train_no", "amount", "channel", "route",
                           "fio", "risk_band"]
    assert set(r[0] for r in sus.select("risk_band").distinct().collect()) <= {"HIGH", "CRITICAL"}
    sections = spark.read.option("header", True).csv(paths["concentration"])
    assert {r[0] for r in sections.select("dimension_type").distinct().collect()} == {"channel", "aggregator",
                                                                                      "terminal", "cashdesk"}
    dos = spark.read.json(paths["dossiers"])
    assert dos.count() == store.read("passengers").count()


def test_job_ledgers_and_audit(spark):
    from farewatch.operators import ledger as LG
    from farewatch import schemas as S

    store = TableStore(spark)
    JB.ingest_cells(store, FX.events_sheet_cells(spark, SF_SMALL), user_id=5)
    JB.scoring_run(store, with_ml=False, user_id=5)
    ups = {r["upload_id"]: r for r in LG.upload_status(store.read_log("upload_events", S.UPLOAD_EVENTS)).collect()}
    assert set(ups) == {1, 2, 3} and all(r["status"] == "done" and r["illegal_transitions"] == 0 for r in ups.values())
    jobs = LG.job_status(store.read_log("job_events", S.JOB_EVENTS)).collect()
    assert len(jobs) == 1 and jobs[0]["status"] == "done" and jobs[0]["duration_sec"] >= 0
    actions = {r["action"]: r["n"] for r in LG.audit_summary(store.read_log("audit_logs", S.AUDIT_LOGS))
               .groupBy("action").agg(F.sum("n").alias("n")).collect()}
    assert actions == {"UPLOAD_STARTED": 3, "UPLOAD_COMPLETED": 3, "SCORING_STARTED": 1, "SCORING_COMPLETED": 1}


def _workbook(path, sheets, book=""):
    """A workbook of {name: sheetData xml}."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        entries = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}">{book}<sheets>{entries}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
                   + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}><si><t>Анна</t><rPh sb="0" eb="1"><t>x</t></rPh></si>'
                                           f'<si><r><t>two</t></r><r><t> runs</t></r></si></sst>')
        for i, data in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{data}</sheetData></worksheet>")


def test_xlsx_sheets_references_and_dates(spark, tmp_dir):
    import pytest

    from farewatch.sources.xlsx import read_sheet_rows

    first = '<row><c t="s"><v>0</v></c><c><v>2.50</v></c><c t="s"><v>1</v></c></row><row/><row><c r="C3" s="1"><v>10.5</v></c><c><v>7</v></c></row>'
    second = '<row r="5"><c r="B5" t="b"><v>1</v></c></row><row><c t="str"><v>x</v></c></row>'
    path = os.path.join(tmp_dir, "upload_1.xlsx")
    _workbook(path, {"Main": first, "Other": second})
    with open(path, "rb") as f:
        content = f.read()
    assert list(read_sheet_rows(content)) == [(1, ["Анна", "2.5", "two runs"]), (3, [None, None, "1900-01-09 12:00:00", "7"])]
    assert list(read_sheet_rows(content, "Other")) == [(5, [None, "True"]), (6, ["x"])]
    with pytest.raises(ValueError, match="the workbook has: Main, Other"):
        list(read_sheet_rows(content, "None"))
    with pytest.raises(ValueError, match="the workbook has: Main, Other"):
        list(read_sheet_rows(content, 2))
    got = UPL.read_xlsx_uploads(spark, tmp_dir, "Other").collect()
    assert [(r["upload_id"], r["row_num"], r["cells"]) for r in got] == [(1, 5, [None, "True"]), (1, 6, ["x"])]
    _workbook(path, {"Main": first}, '<workbookPr date1904="1"/>')
    with open(path, "rb") as f:
        assert list(read_sheet_rows(f.read()))[1] == (3, [None, None, "1904-01-11 12:00:00", "7"])


PLAIN_ROW = '<row r="2" spans="1:3"><c r="A2" t="inlineStr"><is><t>x &amp;amp; &lt;y&gt;</t></is></c><c r="C2" s="1"><v>10.5</v></c><c r="D2" s="1"/></row>'


def test_plain_sheets_are_read_without_a_tree(tmp_dir, monkeypatch):
    """One element tree of a sheet cost most of the time of `src_upload_files`; only rows of other forms need it."""
    from farewatch.sources import xlsx as XL

    parts = []
    monkeypatch.setattr(XL, "_elements", lambda z, name, tag, f=XL._elements: parts.append(name) or f(z, name, tag))
    path = os.path.join(tmp_dir, "upload_1.xlsx")
    other = ["<row><!-- a note --><c><v>7</v></c></row>", '<row><c t="inlineStr"><is><r><t>two</t></r><r><t> runs</t></r></is></c></row>',
             "<row><c t='str'><v>&#65;</v></c></row>"]
    want = (2, ["x &amp; <y>", None, "1900-01-09 12:00:00"])
    for rows, more, parsed in (([PLAIN_ROW], [], False), ([PLAIN_ROW, other[0]], [(3, ["7"])], True),
                               ([PLAIN_ROW, other[1]], [(3, ["two runs"])], True), ([PLAIN_ROW, other[2]], [(3, ["A"])], True)):
        _workbook(path, {"Main": "".join(rows)})
        parts.clear()
        with open(path, "rb") as f:
            assert list(XL.read_sheet_rows(f.read())) == [want, *more]
        assert ("xl/worksheets/sheet1.xml" in parts) == parsed
    content = XL.sheet_bytes([(3, ["<a&b>", None, "", 'q"'])])
    parts.clear()
    assert list(XL.read_sheet_rows(content)) == [(3, ["<a&b>", None, "", 'q"'])] and not parts


def test_csv_and_xlsx_files_are_written_from_one_shuffle(spark, tmp_dir):
    """The cells are computed once for both kinds of files."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    cells = spark.createDataFrame([(u, n, [f"r {n}", None, "Ж"]) for u in (3, 4) for n in range(1, 40)], UPL.CELLS_SCHEMA)
    files = UPL.write_uploads(cells.mapInArrow(counted, UPL.CELLS_SCHEMA), tmp_dir, "csv", "xlsx")
    assert files.count() == 4 and seen.value == 78
    for read in (UPL.read_csv_uploads, UPL.read_csv_lines, UPL.read_xlsx_uploads):
        got = UPL.whole_uploads(read(spark, tmp_dir)).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, cells.collect()))


def test_sheets_wider_than_usual_are_rendered_whole(spark, monkeypatch):
    from farewatch import registry as R

    wide = spark.createDataFrame([(1, 1, [str(i) if i % 3 else None for i in range(25)]), (1, 2, ["a", None, "b"]), (1, 3, [None])], UPL.CELLS_SCHEMA)
    monkeypatch.setattr(R.FX, "events_sheet_cells", lambda *_: wide)
    got = {(r["reader"], r["row_num"]): (r["n_values"], r["text"]) for r in R.q_src_upload_files(spark, SF_SMALL).collect()}
    text = "|".join(f'{i}="{i}' for i in range(25) if i % 3)
    assert got == {(reader, n): x for reader in ("csv", "csv_lines", "xlsx") for n, x in ((1, (16, text)), (2, (2, "0=a|2=b")))}
