"""Streams drained in several calls, with new and repeated files in between."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from farewatch import constants as K
from farewatch import schemas as S
from farewatch.operators import risk as RK
from farewatch.plans import jobs as JB
from farewatch.plans.pipeline import events_state
from farewatch.plans.store import TableStore
from farewatch.sources import uploads as UPL
from farewatch.streaming import ingest as ST


def test_dedup_and_trend_go_on_where_they_ended(spark):
    st = events_state(spark, SF_SMALL)
    store, tx = TableStore(spark), st.transactions
    path = store._path("src_tx")
    for part in (F.col("upload_id") >= 2, F.col("upload_id") <= 2):  # late days and repeats of upload 2 in the second call
        tx.filter(part).write.mode("append").parquet(path)
        ids = ST.stream_dedup(spark, path, tx.schema, store, max_files=1).select("id")
    assert ids.count() == ids.distinct().count() == tx.count()
    src = store._path("src_once")
    for upload in (3, 1, 2):
        tx.filter(F.col("upload_id") == upload).write.mode("append").parquet(src)
        trend = ST.stream_trend(spark, src, tx.schema, st.scores, store, max_files=1)
    assert sorted(map(tuple, trend.collect())) == sorted(map(tuple, RK.risk_trend(tx, st.scores).collect()))


# -- upload lifecycle ---------------------------------------------------------

def _names():
    """The required columns and a few more, as canonical names (which are their own aliases)."""
    return [*K.REQUIRED_COLUMNS, *[c for c in ("amount", "fio", "iin", "channel") if c not in K.REQUIRED_COLUMNS]]


def _sheet(upload, header_rows, rows, first=1):
    """Cells of one upload: ``rows`` positions, header at ``header_rows``, empty rows in between."""
    names, out = _names(), []
    values = {"op_type": "sale", "op_datetime": "2024-01-{:02d} 10:00:00", "amount": "1{}", "fio": "Ann Lee{}", "iin": "99010{:07d}"}
    for n in range(first, rows + 1):
        if n in header_rows:
            cells = names
        elif n % 7 == 0:
            cells = [None] * len(names)
        else:
            cells = [(values.get(c) or "x{}").format(n % 27 + 1) for c in names]
            if n % 5 == 0:
                cells[names.index("op_datetime")] = "not a date"
        out.append((upload, n, cells))
    return out


def _uploads():
    cells = _sheet(1, {5}, 30) + _sheet(2, {2, 9}, 26) + _sheet(3, set(), 25) + _sheet(4, {22}, 40) + _sheet(5, {20}, 24, first=3)
    cells += [(6, n, [None, None]) for n in (1, 2, 3)]
    cells += [(7, 1, _names()), *((7, n, ["x"] * len(_names())) for n in (2, 3))] + _sheet(8, {1}, 8)
    return cells


def _state(store):
    tx = store.read_log("transactions", S.TRANSACTIONS)
    bad = store.read_log("row_errors", "upload_id long, row_num long, error string")
    events = store.read_log("upload_events", S.UPLOAD_EVENTS)
    audit = store.read_log("audit_logs", S.AUDIT_LOGS)
    passengers = store.read("passengers", S.PASSENGERS)
    return {"tx": sorted(map(str, tx.select(sorted(tx.columns)).collect())), "bad": sorted(map(tuple, bad.collect())),
            "events": sorted((r["upload_id"], r["status"], r["error"]) for r in events.collect() if r["status"] != "processing"),
            "audit": sorted((r["action"], r["entity_id"]) for r in audit.collect()),
            "passengers": sorted(map(str, passengers.select("id", "fio_clean", "last_seen_at", "min_op_datetime").collect()))}


@pytest.fixture(scope="module")
def batch_state(spark):
    store = TableStore(spark)
    JB.ingest_cells(store, spark.createDataFrame(_uploads(), UPL.CELLS_SCHEMA))
    return _state(store)


def test_batch_state_has_every_outcome(batch_state):
    assert {(u, s) for u, s, _ in batch_state["events"]} == {(1, "done"), (2, "done"), (3, "failed"), (4, "failed"), (5, "done"),
                                                             (6, "failed"), (7, "failed"), (8, "done")}


@pytest.mark.parametrize("seed", [2, 3])
def test_any_order_of_arrival_gives_the_batch_result(spark, batch_state, seed):
    rng = random.Random(seed)
    cells = _uploads()
    rng.shuffle(cells)
    if seed == 2:  # backwards: headers come after the rows
        cells.sort(key=lambda c: -c[1])
    store, n = TableStore(spark), 2
    src = store._path("src")
    for i in range(n):
        part = cells[len(cells) * i // n:len(cells) * (i + 1) // n]
        repeated = rng.sample(cells, 10) if seed == 3 else []
        spark.createDataFrame(part + repeated, UPL.CELLS_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        if i == 0 or i == n - 1:  # the first call leaves the uploads open
            ST.stream_ingest(spark, src, store, max_files=1, complete=i == n - 1)
    assert _state(store) == batch_state
    outcomes = store.read("upload_outcomes", ST.OUTCOMES).collect()
    assert {(r["upload_id"], r["status"], r["error"]) for r in outcomes} == set(batch_state["events"])


@pytest.mark.parametrize("step", ["upload_lifecycle", "upload_outcomes"])
def test_a_failed_batch_or_closing_is_repeated(spark, batch_state, monkeypatch, step):
    """The write of one table fails once, in the second batch or in the closing; the step is run again."""
    cells, store = _uploads(), TableStore(spark)
    parts = [[c for c in cells if c[1] % 2 == k] for k in (1, 0)]
    real, failed = TableStore.upsert, []

    def flaky(self, name, *args, **kw):
        if name == step and armed and not failed:
            failed.append(name)
            raise OSError("lost")
        return real(self, name, *args, **kw)

    monkeypatch.setattr(TableStore, "upsert", flaky)
    armed = False
    for epoch, part in enumerate(parts):
        frame = spark.createDataFrame(part, UPL.CELLS_SCHEMA)
        armed = epoch == 1 and step != "upload_outcomes"
        for _ in range(2):
            try:
                ST.ingest_cells_batch(store, frame, epoch)
                break
            except OSError:
                pass
    armed = True
    for _ in range(2):
        try:
            ST.close_uploads(store)
            break
        except OSError:
            pass
    assert failed == [step] and _state(store) == batch_state


def test_open_uploads_wait_for_their_patience(spark):
    store, now = TableStore(spark), datetime.datetime(2024, 1, 1)
    frame = spark.createDataFrame(_sheet(3, set(), 25), UPL.CELLS_SCHEMA)
    ST.ingest_cells_batch(store, frame, 0, now=now)
    ST.close_uploads(store, before=now)
    assert store.read("upload_outcomes") is None
    ST.close_uploads(store, before=now + datetime.timedelta(seconds=1))
    assert [r["status"] for r in store.read("upload_outcomes", ST.OUTCOMES).collect()] == ["failed"]
    ST.close_uploads(store)  # nothing is open
    assert store.read_log("upload_events").count() == 2


def test_batch_ingest_can_be_repeated(spark, batch_state):
    store, cells = TableStore(spark), spark.createDataFrame(_uploads(), UPL.CELLS_SCHEMA)
    JB.ingest_cells(store, cells)
    headers = store.read_log("upload_headers").count()
    JB.ingest_cells(store, cells)
    again = _state(store)
    assert (again["tx"], again["bad"], again["passengers"]) == tuple(batch_state[k] for k in ("tx", "bad", "passengers"))
    assert store.read_log("upload_headers").count() == headers
