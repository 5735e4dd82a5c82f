"""Upsert semantics (S5-S9, R8) and their properties."""

import datetime as dt

from pyspark.sql import functions as F

from farewatch.operators import upsert as UP

T0 = dt.datetime(2024, 1, 1)
SCORE_SCHEMA = ("passenger_id long, rule_score double, ml_score double, final_score double, risk_band string, "
                "top_reasons array<string>, seat_blocking_flag boolean, is_manual boolean, scored_at timestamp_ntz")


def _scores(spark, rows):
    return spark.createDataFrame(rows, SCORE_SCHEMA)


def test_score_upsert_manual_guard(spark):
    old = _scores(spark, [(1, 10.0, 0.0, 10.0, "critical", ["MANUAL OVERRIDE: x"], False, True, T0),
                          (2, 10.0, 0.0, 10.0, "low", [], False, False, T0)])
    new = _scores(spark, [(1, 90.0, 0.0, 90.0, "low", [], False, False, T0),
                          (2, 60.0, 0.0, 60.0, "high", ["a"], False, False, T0),
                          (3, 5.0, 0.0, 5.0, "low", [], False, False, T0)])
    got = {r["passenger_id"]: r for r in UP.score_upsert(old, new).collect()}
    assert got[1]["risk_band"] == "critical" and got[1]["is_manual"] and got[1]["final_score"] == 10.0
    assert got[2]["risk_band"] == "high" and got[2]["final_score"] == 60.0
    assert got[3]["risk_band"] == "low"
    # idempotent: applying the same update twice changes nothing
    once = UP.score_upsert(old, new)
    twice = UP.score_upsert(once, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_insert_ignore(spark):
    schema = "id long, upload_id long, row_num long, v string"
    old = spark.createDataFrame([(1, 2, 1, "a"), (3, 1, 1, "z")], schema)
    new = spark.createDataFrame([(1, 2, 5, "b"), (2, 2, 7, "c"), (2, 2, 6, "d"), (3, 2, 9, "y")], schema)
    # default: stored ids are looked up only in the incoming uploads (ids hash the upload id)
    got = sorted(tuple(r) for r in UP.insert_ignore(old, new).collect())
    assert got == [(2, 2, 6, "d"), (3, 2, 9, "y")]
    # scope=None compares against every stored id
    got_all = sorted(tuple(r) for r in UP.insert_ignore(old, new, scope=None).collect())
    assert got_all == [(2, 2, 6, "d")]


def test_passenger_upsert_keeps_first_sight(spark):
    schema = "id long, fio_clean string, fake_fio_score double, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"
    old = spark.createDataFrame([(1, "A", 0.0, T0, T0)], schema)
    new = spark.createDataFrame([(1, "B", 1.0, T0 + dt.timedelta(days=3), T0 + dt.timedelta(days=5)),
                                 (2, "C", 0.4, T0, T0)], schema)
    got = {r["id"]: r for r in UP.passenger_upsert(old, new).collect()}
    assert (got[1]["fio_clean"], got[1]["fake_fio_score"], got[1]["first_seen_at"]) == ("A", 0.0, T0)
    assert got[1]["last_seen_at"] == T0 + dt.timedelta(days=5)
    assert got[2]["fio_clean"] == "C"


def test_concentration_upsert_prune(spark):
    schema = "id long, dimension_type string, dimension_value string, total_ops long"
    old = spark.createDataFrame([(1, "channel", "a", 5), (2, "channel", "gone", 1)], schema)
    new = spark.createDataFrame([(1, "channel", "a", 9)], schema)
    kept = {r["id"]: r["total_ops"] for r in UP.concentration_upsert(old, new).collect()}
    assert kept == {1: 9, 2: 1}
    pruned = {r["id"]: r["total_ops"] for r in UP.concentration_upsert(old, new, prune=True).collect()}
    assert pruned == {1: 9}


def test_manual_override(spark):
    scores = _scores(spark, [(1, 10.0, 0.0, 10.0, "low", ["High ticket count"], False, False, T0)])
    ovr = spark.createDataFrame([(1, "critical", "checked", 7), (9, "high", "new", 7)],
                                "passenger_id long, new_band string, reason string, actor_user_id long")
    merged, audit = UP.apply_override(scores, ovr, T0)
    got = {r["passenger_id"]: r for r in merged.collect()}
    assert got[1]["risk_band"] == "critical" and got[1]["is_manual"]
    assert got[1]["top_reasons"] == ["MANUAL OVERRIDE: checked", "High ticket count"]
    assert got[9]["risk_band"] == "high" and got[9]["final_score"] == 0.0 and got[9]["top_reasons"] == ["MANUAL OVERRIDE: new"]
    # same reason again is listed once
    merged2, _ = UP.apply_override(merged, ovr, T0)
    assert {r["passenger_id"]: r for r in merged2.collect()}[1]["top_reasons"] == got[1]["top_reasons"]
    metas = {r["entity_id"]: r["meta"] for r in audit.collect()}
    assert '"old_band":"low"' in metas["1"] and '"new_band":"critical"' in metas["1"]
    assert audit.filter(F.col("action") != "PASSENGER_RISK_OVERRIDE").count() == 0


def test_store_versions_are_crash_safe(spark):
    """A version whose data exists but whose marker was never written (a job
    that died in between) is not current; earlier markers stay valid."""
    from farewatch.plans.store import TableStore

    store = TableStore(spark)
    store.write("t", spark.createDataFrame([(1,)], "x int"))
    store.write("t", spark.createDataFrame([(2,)], "x int"))
    # simulate a crash after writing v=3 data, before its marker
    spark.createDataFrame([(3,)], "x int").write.parquet(store._path("t", "v=3"))
    fresh = TableStore(spark, store.root)  # a new process reading the same store
    assert fresh.version("t") == 2
    assert [r[0] for r in fresh.read("t").collect()] == [2]
    # the next successful write supersedes the orphaned data
    fresh.write("t", spark.createDataFrame([(4,)], "x int"))
    assert TableStore(spark, store.root).version("t") == 3
    assert [r[0] for r in TableStore(spark, store.root).read("t").collect()] == [4]


def test_upsert_rewrites_touched_buckets_only(spark):
    """A small batch rewrites its own buckets; the others stay where they are; old versions can expire."""
    from farewatch.plans.store import BUCKET, TableStore

    def merge(old, new):
        return UP.replace_on_key(old, new, ["k"])

    store = TableStore(spark, buckets=8)
    schema = "k long, x int"
    store.upsert("t", spark.createDataFrame([(i, 0) for i in range(100)], schema), "k", merge)
    before = store._layout("t", 1)["at"]
    assert len(before) == 8 and set(before.values()) == {1}
    store.upsert("t", spark.createDataFrame([(3, 7), (3000, 8)], schema), "k", merge)
    after = store._layout("t", 2)["at"]
    assert 1 <= sum(v == 2 for v in after.values()) <= 2
    assert {b for b, v in after.items() if v == 1} < set(before)
    got = dict(map(tuple, TableStore(spark, store.root).read("t").collect()))
    assert got == {i: 0 for i in range(100)} | {3: 7, 3000: 8} and BUCKET not in store.read("t").columns
    # nothing new: no version; a crash before the marker leaves the version current
    assert store.upsert("t", spark.createDataFrame([], schema), "k", merge) == 2
    spark.createDataFrame([(1, 1)], schema).write.parquet(store._path("t", "v=3", f"{BUCKET}=0"))
    assert TableStore(spark, store.root).version("t") == 2
    for step in range(3):  # every key: all buckets move, so the first versions are not used any more
        store.upsert("t", spark.createDataFrame([(i, step) for i in range(100)], schema), "k", merge)
    assert store.expire("t", keep=1) == [1, 2, 3, 4]
    got = dict(map(tuple, TableStore(spark, store.root).read("t").collect()))
    assert got == {i: 2 for i in range(100)} | {3000: 8}


def test_upsert_of_empty_and_undivided_tables(spark):
    from farewatch.plans.store import TableStore

    def merge(old, new):
        return UP.replace_on_key(old, new, ["k"])

    store, schema = TableStore(spark, buckets=4), "k long, x int"
    store.upsert("e", spark.createDataFrame([], schema), "k", merge)
    assert store.read("e").count() == 0
    store.upsert("e", spark.createDataFrame([(1, 1), (None, 2)], schema), "k", merge)
    assert sorted(map(str, store.read("e").collect())) == ["Row(k=1, x=1)", "Row(k=None, x=2)"]
    store.write("w", spark.createDataFrame([(1, 1), (2, 2)], schema))
    store.upsert("w", spark.createDataFrame([(2, 5)], schema), "k", merge)
    assert sorted(map(tuple, store.read("w").collect())) == [(1, 1), (2, 5)]
