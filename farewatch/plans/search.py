"""F2 by an index: substring search of names and iins through trigram postings.

A posting is (trigram, value, passenger): the lower-cased name or iin and who has
it.  Postings lie in folders by a hash of the trigram and are sorted by it, so
a search opens the folders of its term's trigrams only; it reads the postings
of the rarest one and checks the whole term on their values.  The index grows
by what was loaded since it was last refreshed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from farewatch import schemas as S
from farewatch.operators import lookups as LK
from farewatch.plans.incremental import FILES, log_files, new_rows, read_state
from farewatch.plans.store import TableStore
from farewatch.session import cut_lineage

GRAM = 3
# Folders of the postings (an index keeps its number).
GRAM_BUCKETS = 64
POSTINGS = "gram string, value string, passenger_id long, bucket int"


def gram_bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_BUCKETS)).cast("int")


def postings(values: DataFrame) -> DataFrame:
    """POSTINGS of (passenger_id, value); values shorter than a trigram have none."""
    grams = F.transform(F.sequence(F.lit(1), F.char_length("value") - (GRAM - 1)), lambda i: F.substring(F.col("value"), i, F.lit(GRAM)))
    rows = values.where(F.char_length("value") >= GRAM).select("passenger_id", "value", F.explode(F.array_distinct(grams)).alias("gram"))
    return rows.select("gram", "value", "passenger_id", gram_bucket(F.col("gram")).alias("bucket"))


def refresh_search_index(store: TableStore) -> None:
    """Add the postings of the names and iins in transactions that the index does not cover yet.

    A refresh that fails may leave postings behind; the next one adds them
    again, and a search finds each passenger once.
    """
    state = read_state(store, "search_state")
    files = cut_lineage(log_files(store, "transactions", S.TRANSACTIONS), "log-files")
    seen = store.read("search_files", FILES, state["files"]) if state else None
    fresh = cut_lineage(new_rows(store, "transactions", S.TRANSACTIONS, files, seen).select("passenger_id", F.lower("iin").alias("iin")).distinct(), "search-fresh")
    ids = fresh.select(F.col("passenger_id").alias("id")).distinct()
    names = store.read_keys("passengers", ids, "id", S.PASSENGERS).select(F.col("id").alias("passenger_id"), F.lower("fio_clean").alias("value"))
    rows = postings(names.unionByName(fresh.select("passenger_id", F.col("iin").alias("value"))).distinct())
    store.append("search_postings", rows.repartition("bucket").sortWithinPartitions("bucket", "gram"), partition_by="bucket")
    files_at = store.write("search_files", files)
    store._mark("search_state", (store.version("search_state") or 0) + 1, json.dumps({"files": files_at}))


def search(store: TableStore, term: str, band: str | None = None) -> DataFrame:
    """F2 + J6: passengers whose name or iin holds ``term``, whatever the case; optional band.

    Terms under three characters, and terms with the pattern's own signs
    (``%``, ``_``, a backslash), are searched by a scan.  Equal to
    ``lookups.passenger_search`` for everything the index covers.
    """
    passengers, scores = store.read("passengers", S.PASSENGERS), None
    if band is not None:
        scores = store.read("passenger_scores", S.PASSENGER_SCORES)
    if len(term) < GRAM or any(c in term for c in "%_\\"):
        return LK.passenger_search(passengers, store.read_log("transactions", S.TRANSACTIONS), term, band, scores)
    hits = store.read_keys("passengers", matching(store, term).withColumnRenamed("passenger_id", "id"), "id", S.PASSENGERS)
    return hits if band is None else LK.passengers_by_band(hits, scores, band)


def matching(store: TableStore, term: str) -> DataFrame:
    """(passenger_id) of the postings whose value holds ``term``; opens the folders of its trigrams."""
    index = store.read_log("search_postings", POSTINGS)
    if index is None:
        return store.spark.createDataFrame([], "passenger_id long")
    whole = F.lower(F.lit(term))
    # The term's trigrams, lower-cased as the values were, and their folders: a few short strings.
    grams = postings(store.spark.range(1).select(F.lit(0).cast("long").alias("passenger_id"), whole.alias("value"))).select("gram", "bucket").collect()
    near = index.where(F.col("bucket").isin([g["bucket"] for g in grams]) & F.col("gram").isin([g["gram"] for g in grams]))
    counts = {r["gram"]: r["n"] for r in near.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
    rarest = min(grams, key=lambda g: (counts.get(g["gram"], 0), g["gram"]))
    return (index.where((F.col("bucket") == rarest["bucket"]) & (F.col("gram") == rarest["gram"]) & F.contains("value", whole))
            .select("passenger_id").distinct())
