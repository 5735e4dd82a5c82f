"""The oracle fixtures reach every branch the queries are named for."""

from conftest import SF_SMALL
from pyspark.sql import functions as F

from farewatch import constants as K
from farewatch.operators import risk as RK
from farewatch.plans.ingest import enrich_rows
from farewatch.plans.pipeline import RUN_TIME, lineitem_state
from farewatch.sources import fixtures as FX
from farewatch.sources import uploads as UPL


def _values(df, col):
    return {r[0] for r in df.select(col).distinct().collect()}


def test_volume_fixture_reaches_every_rule_band_and_label(spark):
    st = lineitem_state(spark, SF_SMALL)
    fired = st.features.agg(*[F.count_if(F.col(f) > th).alias(f) for f, th, _, _ in K.RULES]).first()
    assert all(0 < n < st.features.count() for n in fired)
    assert _values(st.scores, "risk_band") == {"low", "medium", "high", "critical"}
    assert _values(st.scores, "seat_blocking_flag") == {True, False}
    conc = RK.concentration(st.transactions, st.scores, calculated_at=RUN_TIME)
    assert _values(conc.select(RK.hotspot_label().alias("x")), "x") == {label for _, label in K.HOTSPOT_LABELS} | {K.HOTSPOT_DEFAULT}


def test_sheet_fixture_reaches_every_key_kind_and_cell_form(spark):
    typed, _, _ = UPL.typed_from_cells(FX.events_sheet_cells(spark, SF_SMALL))
    good, bad = UPL.split_errors(typed)
    kinds = _values(enrich_rows(good).select(F.substring_index("identity_key", ":", 1).alias("x")), "x")
    assert kinds == {"iin", "fio_doc", "fio_ph", "fio"}
    assert _values(good, "source") == {K.DEFAULT_SOURCE, "partner"}
    assert good.where("route LIKE 'line%'").count() and good.where("route LIKE '% -> %'").count()
    assert good.where(F.col("fio").contains("\u0301")).count() and good.where(F.col("fio").contains("\u0306")).count()
    assert good.where("amount = 1000").count() and bad.count()
    assert _values(FX.upload_events(spark, SF_SMALL), "status") == {"pending", "processing", "done", "failed"}
    assert _values(FX.job_events(spark, SF_SMALL), "status") == {"pending", "running", "done", "failed"}
