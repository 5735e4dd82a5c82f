"""Physical-plan checks: no cartesian products, no row-at-a-time Python,
group-limited windows for top-n per passenger, pushed filters."""

from conftest import SF_SMALL
from farewatch.operators import lookups as LK
from farewatch.operators import risk as RK
from farewatch.plans.pipeline import RUN_TIME, events_state


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_or_row_udf(spark):
    st = events_state(spark, SF_SMALL)
    flagged = st.flagged()
    conc = RK.risk_concentration(flagged, calculated_at=RUN_TIME)
    for df in (RK.risk_trend(st.transactions, st.scores), RK.dimension_stats(flagged), conc,
               RK.dashboard_summary(st.passengers, st.scores, flagged, conc), st.features):
        p = _plan(df)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, p
        assert "BatchEvalPython" not in p


def test_top_n_uses_group_limit(spark):
    st = events_state(spark, SF_SMALL)
    plan = _plan(LK.latest_n(st.transactions, 20))
    assert "WindowGroupLimit" in plan


def test_filters_reach_scan(spark, tmp_dir):
    st = events_state(spark, SF_SMALL)
    st.transactions.write.mode("overwrite").partitionBy("upload_id").parquet(tmp_dir + "/tx")
    tx = spark.read.parquet(tmp_dir + "/tx")
    df = LK.upload_transactions(tx, 2).select("id", "op_datetime")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(upload_id" in plan or "upload_id#" in plan
    assert "ReadSchema: struct<id:bigint,op_datetime:timestamp_ntz>" in plan


def test_rows_are_enriched_once(spark):
    """Transactions, passengers and features read the enriched rows; none of them hashes ids or cleans names again."""
    from farewatch import registry as R
    st = events_state(spark, SF_SMALL)
    for df in (RK.risk_trend(st.transactions, st.scores), st.passengers, st.features, R._cells_state(spark, SF_SMALL).scores):
        plan = _plan(df)
        assert "sha2" not in plan and "get_json_object" not in plan and "try_to_timestamp" not in plan, plan


def test_streamed_parts_are_written_by_several_tasks(spark, monkeypatch):
    """The three parts of ``stream_outcome`` come as many files, not through one task each."""
    from farewatch import registry as R
    from farewatch.streaming import ingest as ST
    files, plain = [], ST.stream_ingest

    def counted(spark, src, store, **kw):
        files.append(len(spark.read.parquet(src).inputFiles()))
        return plain(spark, src, store, **kw)

    monkeypatch.setattr(ST, "stream_ingest", counted)
    out = R.QUERIES["stream_outcome"](spark, SF_SMALL)
    assert out.count() == 5
    assert len(files) == 3 and files[0] > 1 and files[0] < files[1] < files[2], files


def test_dossier_operations_reach_the_output(spark):
    """``export_dossier`` returns the operations it collects: newest first, as many as it counts, none pruned from its plan."""
    from farewatch import registry as R
    df = R.QUERIES["export_dossier"](spark, SF_SMALL)
    assert "collect_list" in _plan(df)
    rows = df.collect()
    assert rows
    for r in rows:
        ops = [o.split("|") for o in r["operations"].split("; ")]
        assert [int(o[0]) for o in ops] == list(range(1, r["n_transactions"] + 1))
        assert ops[0][1] == str(r["last_op_datetime"])
        assert [o[1] for o in ops] == sorted((o[1] for o in ops), reverse=True)
        assert all(len(o) == 6 and o[2] and float(o[4]) >= 0 for o in ops)


def test_dossier_operations_of_odd_passengers(spark):
    """More operations than a dossier holds, equal times (the id decides), missing fields, and no operation at all."""
    import datetime as dt
    from farewatch import registry as R
    from farewatch.plans import exports as EX
    day = dt.datetime(2024, 1, 1)
    tx = [(100 + i, 1, day + dt.timedelta(days=i // 2), None, "sale", "T1", float(i), "A -> B") for i in range(23)]
    tx.append((1, 2, day, "12", "refund", None, 12345678.25, None))
    tx = spark.createDataFrame(tx, "id long, passenger_id long, op_datetime timestamp_ntz, iin string, op_type string, "
                                   "train_no string, amount double, route string")
    people = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id long, fio_clean string")
    scores = spark.createDataFrame([], "passenger_id long, risk_band string, final_score double, top_reasons array<string>")
    d = EX.dossiers(people, tx, scores).select("passenger_id", "n_transactions", R._operations_text())
    got = {r[0]: (r[1], r[2]) for r in d.collect()}
    newest = sorted(range(23), key=lambda i: (-(i // 2), i))[:20]
    assert got[1] == (20, "; ".join(f"{n}|{day + dt.timedelta(days=i // 2)}|sale|T1|{float(i)}|A -> B"
                                    for n, i in enumerate(newest, 1)))
    assert got[2] == (1, "1|2024-01-01 00:00:00|refund||12345678.25|")
    assert got[3] == (0, None)
