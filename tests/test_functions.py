"""Hand-written rows with expected values (FIXTURES.md section 5)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from farewatch.functions import identity as I
from farewatch.functions import names as N
from farewatch.functions import text as X
from farewatch.functions import timeflags as TF
from farewatch.operators import risk as RK
from farewatch.operators import scoring as SC

NAMES = [
    ("ИВАНОВ  Иван  Иванович", "ИВАНОВ ИВАН ИВАНОВИЧ", 0.0),
    ("г-н Петров", "Н ПЕТРОВ", 0.0),
    ("mr. John O'Neil 2", "JOHN O NEIL", 0.0),
    ("test user", "TEST USER", 0.8),
    ("Иванов", "ИВАНОВ", 0.4),
    ("Анна Анна", "АННА АННА", 1.0),
    ("Li", "LI", 1.0),
    (None, "", 1.0),
    ("12345", "", 1.0),
    ("null", "", 1.0),
    ("Mr  DR   Smith-Jones", "SMITH JONES", 0.0),
    ("ЙЙё", "ЙЙЁ", 1.0),
]


def test_clean_and_fake(spark):
    df = spark.createDataFrame([(r,) for r, _, _ in NAMES], "raw string")
    out = df.select("raw", N.clean_name("raw").alias("c")).select("raw", "c", N.fake_name_score("c").alias("f"))
    got = {r["raw"]: (r["c"], r["f"]) for r in out.collect()}
    for raw, clean, fake in NAMES:
        assert got[raw] == (clean, pytest.approx(fake)), raw


def test_clean_literals(spark):
    want = {"  a-b  c ": "A B C", "Ж.Қ. Әлі": "Ж Қ ӘЛІ", "x y": "X Y", "mr-mr mr": "", "Ёлка\tелка": "ЁЛКА ЕЛКА",
            "null Null": "", "- - -": "", "гр. Ли": "ЛИ", "": ""}
    df = spark.createDataFrame([(s,) for s in want], "s string")
    assert {r["s"]: r["c"] for r in df.select("s", N.clean_name("s").alias("c")).collect()} == want


def test_translit(spark):
    df = spark.createDataFrame([("Щукин Әлихан Жұмабек",)], "s string")
    assert df.select(N.clean_name("s", translit=True)).first()[0] == "SCHUKIN AELIKHAN ZHUMABEK"


def test_identity_keys(spark):
    rows = [
        ("1234567890", "ИВАНОВ", None, None, "iin:1234567890"),
        ("123456789", "ИВАНОВ", "N1", None, "fio_doc:ИВАНОВ|N1"),
        (None, "ИВАНОВ", None, "777", "fio_ph:ИВАНОВ|777"),
        (None, "ИВАНОВ", None, None, "fio:ИВАНОВ"),
        (None, "", None, None, None),
    ]
    df = spark.createDataFrame(rows, "iin string, fio string, doc string, phone string, expected string")
    for r in df.select("expected", I.identity_key("iin", "fio", "doc", "phone").alias("k")).collect():
        assert r["k"] == r["expected"]


def test_passenger_ids_literal(spark):
    want = {"iin:123456789012": 7973838215521658255, "fio:ИВАНОВ": 6897725302658770998,
            "fio_doc:A|B": 7347441624539104144, "": 2638860938215039796, "x" * 300: 2756656155053136948}
    df = spark.createDataFrame([(k,) for k in want], "k string")
    assert {r["k"]: r["p"] for r in df.select("k", I.passenger_id_from_key("k").alias("p")).collect()} == want
    other = df.select("k", I.passenger_id_from_key("k", "other").alias("p")).collect()
    assert all(r["p"] != want[r["k"]] for r in other)


def test_transaction_ids_literal(spark):
    ts = dt.datetime(2024, 1, 5, 10, 20, 30, 123000)
    ts0 = dt.datetime(2024, 1, 5, 10, 20, 30)
    rows = [(2, 15, ts, 1234.5, "ИВАНОВ"), (1, 3, ts0, 10.0, "X"), (1, 4, ts0, 12345678.9, "Y")]
    df = spark.createDataFrame(rows, "u long, r long, t timestamp_ntz, a double, n string")
    assert [r[0] for r in df.select(I.transaction_id("u", "r", "t", "a", "n")).collect()] == [
        5359361515229694420, 2020529728192196286, 4281441840657089037]


def test_numbers(spark):
    rows = [("1 234,50", 1234.5, False), ("1 000", 1000.0, False), (None, 0.0, False), ("1,234.50", None, True),
            ("abc", None, True), ("", None, True), ("1 000,5", 1000.5, False), ("12f", None, True)]
    df = spark.createDataFrame([(r[0],) for r in rows], "s string")
    got = df.select("s", X.parse_amount("s").alias("v"), X.amount_error("s", "amount").isNotNull().alias("e")).collect()
    for (s, v, e), r in zip(rows, got):
        assert (r["v"], r["e"]) == (v, e), s


def test_dates(spark):
    rows = [("2024-01-05 10:20:30", dt.datetime(2024, 1, 5, 10, 20, 30)), ("05.01.2024 10:20", dt.datetime(2024, 1, 5, 10, 20)),
            ("05.01.2024", dt.datetime(2024, 1, 5)), ("2024-01-05", dt.datetime(2024, 1, 5)),
            ("5.1.2024", dt.datetime(2024, 1, 5)), ("05/01/2024", None), ("   ", None), ("31.02.2024", None), (None, None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "s string")
    got = [r[0] for r in df.select(X.parse_datetime("s")).collect()]
    assert got == [r[1] for r in rows]
    errs = [r[0] for r in df.select(X.datetime_error("s", "dep_datetime", required=False)).collect()]
    assert [e is not None for e in errs] == [False] * 5 + [True, True, True, False]


def test_op_types(spark):
    rows = [(" Продажа ", "sale"), ("возврат", "refund"), ("гашение", "redeem"), ("xyz", "other"), ("  ", "other"),
            (None, None), ("ОПЛАТА", "sale")]
    df = spark.createDataFrame([(r[0],) for r in rows], "s string")
    assert [r[0] for r in df.select(X.op_type("s")).collect()] == [r[1] for r in rows]


def test_extract_iin_and_route(spark):
    rows = [(None, "Иванов ИИ123456789012", "123456789012"), (None, "x 123456789012 y", "123456789012"),
            (None, "abc123456789012345", "123456789012"), ("  ", "no digits", None), ("555", "Иванов 123456789012", "555")]
    df = spark.createDataFrame(rows, "iin string, fio string, e string")
    for r in df.select("e", X.extract_iin("iin", "fio").alias("g")).collect():
        assert r["g"] == r["e"]
    df2 = spark.createDataFrame([(None, "A", "B"), ("R", "A", "B"), (None, "A", None)], "r string, d string, a string")
    assert [x[0] for x in df2.select(X.derive_route("r", "d", "a")).collect()] == ["A -> B", "R", None]


def test_late_refund_and_night(spark):
    base = dt.datetime(2024, 1, 1, 12, 0)
    rows = [("refund", 0.0, True), ("refund", 23.99, True), ("refund", 24.0, False), ("refund", -0.01, False),
            ("refund", None, False), ("sale", 1.0, False)]
    df = spark.createDataFrame([(o, base, None if h is None else base + dt.timedelta(hours=h)) for o, h, _ in rows],
                               "op_type string, op_datetime timestamp_ntz, dep_datetime timestamp_ntz")
    got = [r[0] for r in df.select(TF.late_refund_flag(hours=TF.hours_to_departure())).collect()]
    assert got == [r[2] for r in rows]
    times = [dt.datetime(2024, 1, 1, h, m) for h, m in [(0, 0), (5, 59), (6, 0), (23, 0)]]
    d2 = spark.createDataFrame([(t,) for t in times], "op_datetime timestamp_ntz")
    assert [r[0] for r in d2.select(TF.night_flag()).collect()] == [True, True, False, False]
    assert [r[0] for r in d2.select(TF.night_flag(definition="entity")).collect()] == [True, True, False, True]


def test_rules_bands_reasons(spark):
    rows = [(20, 0.0, 0, 0.0, 0.0, 0.0), (21, 0.0, 0, 0.0, 0.0, 20.0), (0, 0.51, 0, 0.0, 0.0, 25.0),
            (0, 0.5, 0, 0.0, 0.0, 0.0), (0, 0.0, 6, 0.0, 0.0, 30.0), (0, 0.0, 5, 0.0, 0.0, 0.0),
            (0, 0.0, 0, 0.51, 0.0, 25.0), (0, 0.0, 0, 0.0, 0.51, 10.0), (0, 0.0, 0, 0.0, 0.5, 0.0),
            (99, 0.9, 9, 0.9, 0.9, 100.0)]
    df = spark.createDataFrame(rows, "total_tickets long, refund_share double, late_refunds long, fake_fio double, "
                                     "night_share double, expected double")
    for r in df.select("expected", SC.rule_score().alias("s")).collect():
        assert r["s"] == r["expected"]
    bands = [(30.0, "low"), (30.01, "medium"), (50.0, "medium"), (50.01, "high"), (75.0, "high"), (75.01, "critical")]
    d2 = spark.createDataFrame(bands, "final_score double, b string")
    assert [r[0] for r in d2.select(SC.risk_band()).collect()] == [b for _, b in bands]
    d3 = df.withColumn("ml_score", F.lit(81.0)).select(SC.top_reasons()).collect()
    assert d3[-1][0] == ["High ticket count", "High refund share", "Multiple late refunds", "Suspicious name pattern",
                         "ML anomaly detected"]
    assert d3[7][0] == ["ML anomaly detected"]  # the night rule has no reason text


def test_minmax(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 3.0)], "k int, x double")
    got = {r["k"]: r["n"] for r in SC.minmax_normalise(df, "x", "n").collect()}
    assert got == {1: 0.0, 2: 100.0, 3: 50.0}
    flat = spark.createDataFrame([(1, 2.0), (2, 2.0)], "k int, x double")
    assert {r["n"] for r in SC.minmax_normalise(flat, "x", "n").collect()} == {0.0}


def test_lift_and_labels(spark):
    tx = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "b", False), (4, "b", False)],
                               "id long, channel string, suspicious boolean")
    c = {r["dimension_value"]: r for r in RK.risk_concentration(tx, dims=("channel",)).collect()}
    assert c["a"]["share_highrisk_ops"] == 0.5 and c["a"]["lift_vs_base"] == 2.0
    none = tx.withColumn("suspicious", F.lit(False))
    assert {r["lift_vs_base"] for r in RK.risk_concentration(none, dims=("channel",)).collect()} == {1.0}
    lifts = spark.createDataFrame([(1.49,), (1.5,), (2.0,), (3.0,)], "lift_vs_base double")
    assert [r[0] for r in lifts.select(RK.hotspot_label()).collect()] == ["normal", "elevated", "hotspot", "critical_hotspot"]


def test_wide_spaces_and_underscores(spark):
    rows = [("\u2003x\u3000", "1_000", "05.01.2024 \u2003 10:20"), ("\x1cx\x85", "1__0", "05.01.2024\t10:20"), ("\xa0x ", "_1", None)]
    df = spark.createDataFrame(rows, "s string, n string, d string")
    got = df.select(X.trim_or_null("s"), X.parse_amount("n"), X.amount_error("n", "n").isNotNull(), X.parse_datetime("d")).collect()
    when = dt.datetime(2024, 1, 5, 10, 20)
    assert [tuple(r) for r in got] == [("x", 1000.0, False, when), ("x", None, True, when), ("x", None, True, None)]
