"""Upload ingest (typed sheet rows -> transactions + passengers), section 3.1.

One lazy plan: clean names, build identities and ids, then two outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farewatch import constants as K
from farewatch.functions import identity as I
from farewatch.functions import names as N

TRANSACTION_COLUMNS: tuple[str, ...] = (
    "id", "upload_id", "row_num", "source", "op_type", "op_datetime", "dep_datetime", "train_no",
    "channel", "aggregator", "terminal", "cashdesk", "point_of_sale", "amount", "fee", "fio", "iin",
    "doc_no", "order_no", "dep_station", "arr_station", "route", "passenger_id",
)


def enrich_rows(rows: DataFrame, anonymous_scope: str = "upload",
                iin_min_length: int = K.IIN_MIN_LENGTH) -> DataFrame:
    """Add fio_clean, identity_key, passenger_id and transaction id.

    The fake-name score is not computed per row: only the passenger's first
    row supplies it, so ``passenger_rollup`` scores one name per passenger.

    ``anonymous_scope='upload'`` keys anonymous rows by upload, row and time;
    ``'row'`` uses row and time only (two uploads may then share an id).
    """
    clean = N.clean_name("fio")
    df = rows.withColumn("_fio0", clean)
    df = df.withColumn("identity_key", I.identity_key("iin", "_fio0", "doc_no", "phone", iin_min_length))
    anon_key = I.anonymous_key("row_num", "op_datetime",
                               "upload_id" if anonymous_scope == "upload" else None)
    df = (df.withColumn("is_anonymous", F.col("identity_key").isNull())
          .withColumn("passenger_id", I.passenger_id_from_key(F.coalesce("identity_key", anon_key)))
          .withColumn("fio_clean", F.when(F.col("is_anonymous") & (F.col("_fio0") == ""), F.lit(K.ANONYMOUS_NAME))
                      .otherwise(F.col("_fio0")))
          .drop("_fio0"))
    return df.withColumn("id", I.transaction_id("upload_id", "row_num", "op_datetime", "amount", "fio_clean"))


def transactions_from(enriched: DataFrame) -> DataFrame:
    """Canonical transactions (plus row_num, kept for first-row ordering)."""
    return enriched.select(*TRANSACTION_COLUMNS)


def row_fake_score(fio_clean, is_anonymous) -> F.Column:
    """Fake-name score of a row: an anonymous row scored its empty name (1.0)."""
    return F.when(is_anonymous, F.lit(1.0)).otherwise(N.fake_name_score(fio_clean))


def passenger_rollup(enriched: DataFrame) -> DataFrame:
    """A4: per passenger, the first row in file order supplies name, fake score
    and first_seen_at; last_seen_at is the latest operation time.

    ``min_by`` is a partial aggregate, so a passenger holding a third of all rows
    is reduced map-side before the shuffle.
    """
    order = F.struct("upload_id", "row_num")
    first = F.min_by(F.struct("fio_clean", "is_anonymous", "op_datetime"), order)
    return (enriched.groupBy(F.col("passenger_id").alias("id"))
            .agg(first.alias("_f"), F.max("op_datetime").alias("last_seen_at"),
                 F.min("op_datetime").alias("min_op_datetime"))
            .select("id", F.col("_f.fio_clean").alias("fio_clean"),
                    row_fake_score(F.col("_f.fio_clean"), F.col("_f.is_anonymous")).alias("fake_fio_score"),
                    F.col("_f.op_datetime").alias("first_seen_at"), "last_seen_at", "min_op_datetime"))


def ingest(rows: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """Typed rows -> (transactions, passengers).  Both lazy; the caller writes."""
    enriched = enrich_rows(rows, **kw)
    return transactions_from(enriched), passenger_rollup(enriched)
