"""Search by trigram postings equals the scan, and opens the folders of its trigrams only."""

import random
import re

import pytest
from pyspark.sql import functions as F

from farewatch import schemas as S
from farewatch.operators import lookups as LK
from farewatch.plans import search as SE
from farewatch.plans.store import TableStore


@pytest.fixture(scope="module")
def store(spark):
    rng, out = random.Random(5), TableStore(spark)
    parts = ["AN", "NA", "lee", "ЖАН", "жан", " ", "İ", "ß", "_", "99", "01", "x", "%", "Ann", ""]
    names = ["".join(rng.choice(parts) for _ in range(rng.randrange(5))) for _ in range(120)]
    people = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(500, None)], "id long, fio_clean string")
    out.upsert("passengers", people.select("id", "fio_clean", *[F.lit(None).cast(t).alias(c) for c, t in (
        ("fake_fio_score", "double"), ("first_seen_at", "timestamp_ntz"), ("last_seen_at", "timestamp_ntz"),
        ("min_op_datetime", "timestamp_ntz"))]), "id", lambda old, new: new)
    iins = [(rng.choice([*range(120), 500]), rng.choice([None, "990101", "0199x", "77Ab77", "12"]), k % 3) for k in range(300)]
    tx = spark.createDataFrame(iins, "passenger_id long, iin string, upload_id long")
    others = [f.split() for f in S.TRANSACTIONS.split(", ") if f.split()[0] not in ("passenger_id", "iin", "upload_id")]
    tx = tx.select("*", *[F.lit(None).cast(t).alias(c) for c, t in others])
    for upload in range(3):
        out.append("transactions", tx.where(F.col("upload_id") == upload), partition_by="upload_id")
        SE.refresh_search_index(out)
    SE.refresh_search_index(out)  # nothing new
    scores = people.select(F.col("id").alias("passenger_id"), F.when(F.col("id") % 2 == 0, "high").otherwise("low").alias("risk_band"))
    scores = scores.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in S.PASSENGER_SCORES.split(", ")) if c not in scores.columns])
    out.upsert("passenger_scores", scores, "passenger_id", lambda old, new: new)
    return out


@pytest.mark.parametrize("term, band", [("ANNA", None), ("leelee", None), ("жан", "high"), ("990101", "high"), ("7ab7", None), ("9", None),
                                        ("", "high"), ("zzz", None), ("n%a", None), ("   ", None)])
def test_search_equals_the_scan(store, term, band):
    # Passengers without transactions are not in the index.
    with_tx = store.read_log("transactions", S.TRANSACTIONS).select(F.col("passenger_id").alias("id")).distinct()
    scan = LK.passenger_search(store.read("passengers", S.PASSENGERS), store.read_log("transactions", S.TRANSACTIONS), term, band,
                               store.read("passenger_scores", S.PASSENGER_SCORES))
    want = sorted(map(str, scan.join(with_tx, "id", "left_semi").collect()))
    got = sorted(map(str, SE.search(store, term, band).join(with_tx, "id", "left_semi").collect()))
    assert got == want


def test_search_opens_the_folders_of_its_trigrams(store):
    plan = SE.matching(store, "990101")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "PushedFilters: [" in plan
    assert [f for f in SE.matching(store, "990101").inputFiles()]


def test_search_without_an_index_finds_nothing(spark):
    assert SE.matching(TableStore(spark), "abc").collect() == []
