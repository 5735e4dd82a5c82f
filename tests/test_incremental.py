"""Delta-maintained concentrations, window-free ledgers, uploads that trigger scoring."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from farewatch import constants as K
from farewatch import schemas as S
from farewatch.operators import ledger as LG
from farewatch.operators import risk as RK
from farewatch.operators import upsert as UP
from farewatch.plans import incremental as INC
from farewatch.plans import jobs as JB
from farewatch.plans.pipeline import RUN_TIME, events_state
from farewatch.plans.store import TableStore
from farewatch.sources import fixtures as FX


@pytest.fixture(scope="module")
def state(spark):
    st = events_state(spark, SF_SMALL)
    return st.transactions.cache(), st.scores.cache()


def add_scores(store, scores):
    store.upsert("passenger_scores", scores, "passenger_id", lambda old, new: UP.replace_on_key(old, new, ["passenger_id"]))


def with_bands(scores, seed):
    bands = F.array(*[F.lit(b) for b in ("low", "medium", "high", "critical")])
    return scores.withColumn("risk_band", F.get(bands, F.pmod(F.xxhash64("passenger_id", F.lit(seed)), F.lit(4)).cast("int")))


def rows(conc):
    return sorted((r["dimension_type"], r["dimension_value"], r["total_ops"], r["highrisk_ops"], round(r["share_highrisk_ops"], 9),
                   round(r["lift_vs_base"], 9)) for r in conc.collect())


def recount(store, dims=K.DIMENSIONS):
    return rows(RK.concentration(store.read_log("transactions", S.TRANSACTIONS), store.read("passenger_scores", S.PASSENGER_SCORES), dims, RUN_TIME))


def test_deltas_equal_a_recount(spark, state, monkeypatch):
    """Uploads, rows added to an old upload, scorings, overrides, a failed refresh, expired versions, other dimensions."""
    tx, scores = state
    store, opened = TableStore(spark), []
    real = INC.new_rows
    monkeypatch.setattr(INC, "new_rows", lambda *a: opened.append(real(*a)) or opened[-1])

    def check(dims=K.DIMENSIONS):
        got = rows(INC.refresh_concentration(store, dims, RUN_TIME))
        assert got == recount(store, dims)
        return opened[-1].count()

    store.append("transactions", tx.where("upload_id = 1"), partition_by="upload_id")
    assert rows(INC.refresh_concentration(store, calculated_at=RUN_TIME))  # nobody is scored yet
    add_scores(store, with_bands(scores, 1))
    assert check() == 0
    store.append("transactions", tx.where("upload_id = 2 AND row_num % 2 = 0"), partition_by="upload_id")
    add_scores(store, with_bands(scores, 2))
    assert check() == tx.where("upload_id = 2 AND row_num % 2 = 0").count()
    store.append("transactions", tx.where("upload_id = 2 AND row_num % 2 = 1 OR upload_id = 3"), partition_by="upload_id")
    failing = TableStore.write

    def lost(self, name, *a, **kw):
        if name == "counted_files":
            raise OSError("lost")
        return failing(self, name, *a, **kw)

    monkeypatch.setattr(TableStore, "write", lost)
    with pytest.raises(OSError):
        INC.refresh_concentration(store, calculated_at=RUN_TIME)
    monkeypatch.setattr(TableStore, "write", failing)
    assert check() > 0
    one = spark.createDataFrame([(r["passenger_id"], "critical", "x", 1) for r in scores.limit(3).collect()],
                                "passenger_id long, new_band string, reason string, actor_user_id long")
    JB.override(store, one, RUN_TIME)
    assert check() == 0
    for seed in (3, 4):
        add_scores(store, with_bands(scores, seed))
    store.expire("passenger_scores", keep=1)  # the version counted last is gone
    assert check() == 0
    assert check(("channel", "cashdesk")) == tx.count()


def test_refresh_of_an_empty_store(spark):
    assert INC.refresh_concentration(TableStore(spark), calculated_at=RUN_TIME).collect() == []


# -- ledgers ------------------------------------------------------------------

def naive_fold(events, transitions):
    out, by = [], {}
    for e in events:
        by.setdefault(e[0], []).append(e)
    for key, own in by.items():
        own.sort(key=lambda e: (e[2], e[4]))
        # A null status is neither allowed nor illegal after a status that has successors.
        bad = sum(a[1] is not None and (b[1] not in transitions[a[1]] and b[1] is not None if a[1] in transitions else True)
                  for a, b in zip(own, own[1:]))
        out.append((key, own[-1][1], len(own), bad, own[0][2], own[-1][2]))
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_events", [1, 3, 4096])
def test_fold_equals_a_walk_over_the_events(spark, monkeypatch, slice_events):
    """One upload holds most events; ties in time are ordered by seq; unknown and null statuses."""
    monkeypatch.setattr(LG, "SLICE_EVENTS", slice_events)
    rng, t0 = random.Random(slice_events), datetime.datetime(2024, 1, 1)
    status = ["pending", "processing", "done", "failed", "odd", None]
    events = [(rng.choice([1, 1, 1, 1, 2, 3]), rng.choice(status), t0 + datetime.timedelta(seconds=rng.randrange(40)), None, i)
              for i in range(300)]
    frame = spark.createDataFrame(events, S.UPLOAD_EVENTS).repartition(5)
    got = sorted((tuple(r) for r in LG.fold_status(frame, "upload_id", K.UPLOAD_TRANSITIONS).collect()), key=str)
    assert got == naive_fold(events, K.UPLOAD_TRANSITIONS)


def test_ledgers_have_no_window(spark):
    for df in (LG.upload_status(FX.upload_events(spark, SF_SMALL)), LG.job_status(FX.job_events(spark, SF_SMALL))):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


# -- uploads that trigger scoring -----------------------------------------------

def statuses(store, table):
    return [r["status"] for r in store.read_log(table).orderBy("seq").collect()]


def test_upload_triggers_scoring(spark):
    store = TableStore(spark)
    out = JB.upload_job(store, FX.events_sheet_cells(spark, SF_SMALL), job_id="j1", scoring={"with_ml": False})
    assert out["scoring"] == "j1" and statuses(store, "job_events") == ["running", "done"]
    assert store.read("passenger_scores").count() == store.read("passengers").count()


def test_failed_scoring_leaves_the_upload_done(spark, monkeypatch):
    def broken(*a, **kw):
        raise ValueError("no model")

    monkeypatch.setattr(JB.SC, "score_features", broken)
    store = TableStore(spark)
    out = JB.upload_job(store, FX.events_sheet_cells(spark, SF_SMALL), job_id="j1", scoring={"with_ml": False})
    assert out["scoring_error"] == "no model" and "scoring" not in out
    assert statuses(store, "job_events") == ["running", "failed"]
    ended = LG.upload_status(store.read_log("upload_events", S.UPLOAD_EVENTS)).collect()
    assert {r["status"] for r in ended} == {"done"} and store.read_log("transactions").count() > 0


def test_nothing_loaded_is_not_scored(spark):
    store = TableStore(spark)
    cells = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["x", "y"])], "upload_id long, row_num long, cells array<string>")
    assert "scoring" not in JB.upload_job(store, cells) and store.read_log("job_events") is None


# -- features -------------------------------------------------------------------

def feature_rows(df):
    return sorted(str(r) for r in df.select(sorted(c for c in df.columns if c != "calculated_at")).collect())


def test_features_after_many_loads_equal_one_pass(spark, state, monkeypatch):
    """Loads that add to old uploads and to known passengers, one with a failure, one with nothing new."""
    from farewatch.operators import features as FT

    tx, _ = state
    passengers = events_state(spark, SF_SMALL).passengers
    store, real, failed = TableStore(spark), TableStore.write, []
    store.upsert("passengers", passengers, "id", UP.passenger_upsert)

    def flaky(self, name, *a, **kw):
        if name == "feature_files" and len(failed) == 1:
            failed.append(name)
            raise OSError("lost")
        return real(self, name, *a, **kw)

    monkeypatch.setattr(TableStore, "write", flaky)
    for k in range(3):
        store.append("transactions", tx.where(F.pmod("row_num", F.lit(3)) == k), partition_by="upload_id")
        if k == 1:
            failed.append(k)
            with pytest.raises(OSError):
                INC.refresh_features(store, RUN_TIME)
        got = INC.refresh_features(store, RUN_TIME)
        stored = store.read_log("transactions", S.TRANSACTIONS)
        assert feature_rows(got) == feature_rows(FT.full_features(stored, passengers))
    assert feature_rows(INC.refresh_features(store, RUN_TIME)) == feature_rows(got)


def test_incremental_scoring_equals_full_scoring(spark):
    cells, results = FX.events_sheet_cells(spark, SF_SMALL), []
    for incremental in (True, False):
        store = TableStore(spark)
        for uploads in ([2], [1, 3]):
            JB.upload_job(store, cells.where(F.col("upload_id").isin(uploads)), job_id=f"j{uploads[0]}",
                          scoring={"with_ml": False, "incremental": incremental, "run_time": RUN_TIME})
        assert statuses(store, "job_events") == ["running", "done"] * 2
        scores = store.read("passenger_scores", S.PASSENGER_SCORES)
        results.append((feature_rows(store.read("passenger_features")), sorted(map(str, scores.collect())),
                        rows(store.read("risk_concentrations"))))
    assert results[0] == results[1]


# -- pages ------------------------------------------------------------------------

@pytest.mark.parametrize("seed", [1, 2])
def test_deep_pages_equal_slices_of_the_order(spark, monkeypatch, seed):
    """Few cells and small slices: many rounds, an instant that holds half of the rows, rows without a time."""
    from farewatch.operators import lookups as LK

    monkeypatch.setattr(LK, "SHALLOW_OFFSET", 5)
    monkeypatch.setattr(LK, "PAGE_CELLS", 4 if seed == 1 else 1024)
    rng, t0 = random.Random(seed), datetime.datetime(2024, 1, 1)
    table = [(rng.randrange(10**12), rng.choice([None, t0, t0, t0, t0 + datetime.timedelta(microseconds=rng.randrange(10**rng.randrange(1, 13)))]))
             for _ in range(400)]
    want = sorted(table, key=lambda r: (r[1] is None, -(r[1] - t0).total_seconds() if r[1] else 0, r[0]))
    df = spark.createDataFrame(table, "id long, op_datetime timestamp_ntz").repartition(4).cache()
    for offset, limit in ((0, 3), (6, 1), (70, 9), (200, 30), (320, 50), (395, 20), (399, 1), (400, 5), (6, 400)):
        got = LK.page(df, limit, offset)
        assert [tuple(r) for r in got.collect()] == want[offset:offset + limit], (offset, limit)
        assert got.columns == df.columns


def test_deep_page_plan_takes_no_more_than_its_slice(spark):
    from farewatch.operators import lookups as LK

    df = spark.range(100_000).select("id", F.timestamp_micros(F.col("id") * 1_000_000).cast("timestamp_ntz").alias("op_datetime"))
    plan = LK.page(df, 20, 50_000)._jdf.queryExecution().optimizedPlan().toString()
    taken = [int(n) for n in re.findall(r"(?:LocalLimit|GlobalLimit|Offset) (\d+)", plan)]
    assert taken and max(taken) < 20_000
    assert [r["id"] for r in LK.page(df, 3, 50_000).collect()] == [49_999, 49_998, 49_997]


def test_known_ids_are_looked_up_in_the_folders_of_the_batch(spark):
    store = TableStore(spark)
    rows_ = spark.range(60).select("id", (F.col("id") % 6).alias("upload_id"), F.col("id").alias("row_num"))
    store.append("t", rows_, partition_by="upload_id")
    stored = store.read_log("t", "id long, upload_id long, row_num long")
    batch = rows_.where("upload_id IN (2, 4)").unionByName(rows_.where("id = 8").withColumn("id", F.lit(999).cast("long")))
    fresh = UP.insert_ignore(stored, batch)
    assert [r["id"] for r in fresh.collect()] == [999]
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [upload_id" in plan.replace("isnotnull(", "")
