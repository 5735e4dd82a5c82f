"""Driver tables -> canonical inputs (the mappings of FIXTURES.md).

M1  events                       -> typed sheet rows (main oracle fixture)
M1s events                       -> untyped sheet cells with header rows (source path)
M2  lineitem x orders x supplier -> typed sheet rows (volume fixture)
M3  events                       -> upload / job / audit ledgers

All mappings are lazy DataFrame expressions over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from farewatch import constants as K


# Fact tables whose scans feed row-wise work (typing, cleaning, hashing).
FACT_TABLES = ("events", "lineitem", "orders")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in FACT_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """Give a scan at least the cluster's parallelism.

    A file that is a single Parquet row group is read by one task, and all
    row-wise work before the first shuffle would run on one core.  When the
    scan has fewer partitions than the default parallelism the rows are
    spread round-robin (deterministic: Spark sorts before round-robin
    repartitioning, so a retried task gets the same rows).  With many input
    files -- the normal case at scale -- nothing is added.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def _event_op_type() -> F.Column:
    e = F.col("event_type")
    return (F.when(e.isin("purchase", "signup"), "sale").when(e == "error", "refund")
            .when(e == "click", "redeem").otherwise("other"))


def _event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id -> passenger name (part name, 'test ' prefix for every 4th user)."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("user_id"), "p_name")
    return part


def events_typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: one typed sheet row per event."""
    ev = table(spark, sf_dir, "events")
    names = _event_names(spark, sf_dir)
    k = F.col("k")
    rows = (
        ev.withColumn("k", _k())
        .join(names, "user_id", "left")
        .select(
            (F.lit(1) + F.floor((F.dayofmonth("ts") - 1) / 10)).cast("long").alias("upload_id"),
            F.col("event_id").alias("row_num"),
            _event_op_type().alias("op_type"),
            F.col("ts").alias("op_datetime"),
            (F.col("ts") + F.make_dt_interval(hours=k)).alias("dep_datetime"),
            F.col("value").alias("amount"),
            F.round(F.col("value") * 0.05, 2).alias("fee"),
            F.concat(F.lit("T"), (k % 13).cast("string")).alias("train_no"),
            F.concat(F.lit("ch"), (k % 5).cast("string")).alias("channel"),
            F.when(k % 7 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("ag"), (k % 3).cast("string"))).alias("aggregator"),
            F.concat(F.lit("t"), (k % 17).cast("string")).alias("terminal"),
            F.concat(F.lit("cd"), (k % 11).cast("string")).alias("cashdesk"),
            F.concat(F.lit("pos"), (k % 4).cast("string")).alias("point_of_sale"),
            F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("test "), F.col("p_name")))
             .otherwise(F.col("p_name")).alias("fio"),
            F.lit(None).cast("string").alias("iin"),
            F.col("user_id").cast("string").alias("doc_no"),
            F.lit(None).cast("string").alias("order_no"),
            F.lit(None).cast("string").alias("dep_station"),
            F.lit(None).cast("string").alias("arr_station"),
            F.lit(None).cast("string").alias("route"),
            F.lit(None).cast("string").alias("phone"),
            F.lit(K.DEFAULT_SOURCE).alias("source"),
        )
    )
    return rows


def lineitem_typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: one typed sheet row per line item (volume fixture)."""
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    # Stable row number within an order: order by every lineitem column.
    w = Window.partitionBy("l_orderkey").orderBy(*[F.col(c) for c in li.columns])
    rf = F.col("l_returnflag")
    pk = F.col("l_partkey")
    # Customers by c8: 0 reaches every rule, 1 the refund rules, 2 the name rule.
    c8 = F.col("o_custkey") % 8
    op_time = F.col("o_orderdate") + F.make_dt_interval(hours=(pk % F.when(c8 == 0, 8).otherwise(24)).cast("int"))
    # Channels with about 4, 2.7 and 1.6 times the base share of suspicious operations.
    channel = (F.when((c8 <= 1) & (pk % 5 == 0), "hot").when((c8 <= 2) & (pk % 5 == 1), "warm")
               .when((c8 <= 4) & (pk % 5 == 2), "mild").otherwise(F.col("o_orderpriority")))
    customer = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    return (
        li.withColumn("rn", F.row_number().over(w))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supp, F.col("l_suppkey") == F.col("s_suppkey"), "left")
        .select(
            F.year("o_orderdate").cast("long").alias("upload_id"),
            (F.col("l_orderkey") * 100 + F.col("rn")).alias("row_num"),
            F.when((c8 <= 1) & (pk % 4 != 0), "refund").when(rf == "R", "refund").when(rf == "A", "redeem").otherwise("sale").alias("op_type"),
            op_time.alias("op_datetime"),
            F.when(c8 <= 1, op_time + F.make_dt_interval(hours=(pk % 40).cast("int"))).otherwise(F.col("l_shipdate")).alias("dep_datetime"),
            F.col("l_extendedprice").alias("amount"),
            F.round(F.col("l_extendedprice") * F.col("l_tax"), 2).alias("fee"),
            F.concat(F.lit("T"), (pk % 50).cast("string")).alias("train_no"),
            channel.alias("channel"),
            F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("aggregator"),
            F.concat(F.lit("t"), (pk % 97).cast("string")).alias("terminal"),
            F.col("s_name").alias("cashdesk"),
            F.lit(None).cast("string").alias("point_of_sale"),
            F.when(c8.isin(0, 2), F.concat(F.lit("test "), customer)).otherwise(customer).alias("fio"),
            F.lpad(F.col("o_custkey").cast("string"), 12, "0").alias("iin"),
            F.lit(None).cast("string").alias("doc_no"),
            F.col("l_orderkey").cast("string").alias("order_no"),
            F.lit(None).cast("string").alias("dep_station"),
            F.lit(None).cast("string").alias("arr_station"),
            F.lit(None).cast("string").alias("route"),
            F.lit(None).cast("string").alias("phone"),
            F.lit(K.DEFAULT_SOURCE).alias("source"),
        )
    )


# ---------------------------------------------------------------------------
# M1s: events rendered as untyped sheet cells, with title and header rows.
# ---------------------------------------------------------------------------

# Header rows per upload (1, 2, 3): Russian, English, and a mixed sheet with an
# unknown column and the duplicated alias "pos".
SHEET_HEADERS: dict[int, list[str]] = {
    1: ["Тип операции", "Дата операции", "Дата отправления", "Поезд", "Канал продаж", "Агрегатор",
        "Терминал", "Касса", "Точка продажи", "Сумма", "Комиссия", "ФИО", "ИИН", "Номер документа",
        "Номер заказа", "Станция отправления", "Станция назначения", "Маршрут", "Телефон", "Источник"],
    2: ["op_type", "datetime", "departure", "train_no", "channel", "aggregator", "terminal",
        "cashdesk", "point_of_sale", "amount", "fee", "fio", "iin", "doc_no", "order_no",
        "dep_station", "arr_station", "route", "phone", "source"],
    3: ["Операция", "Дата транзакции", "Дата/время отправления", "Номер поезда", "Канал", "Aggregator",
        "Terminal", "Касса", "POS", "Стоимость", "Сбор", "Данные пассажира", "Примечание", "Документ",
        "Номер заказа", "Станция отправ", "Станция назна", "Маршрут", "Контакт", "Источник"],
}
# Sheet row of the header per upload (rows above it are a title and blanks).
SHEET_HEADER_ROW: dict[int, int] = {1: 2, 2: 3, 3: 1}
SHEET_TITLE = "Выгрузка операций"
# Data rows start after this offset so that header rows never collide.
SHEET_ROW_OFFSET = 10


def _fmt(ts: F.Column, pattern: str) -> F.Column:
    return F.date_format(ts, pattern)


def events_sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1s: (upload_id, row_num, cells ARRAY<STRING>) incl. title/header rows.

    Cell renderings vary with the event id so that every parsing branch
    (four date layouts, comma decimals, unparsable values, missing
    operation types, ids inside names) is hit on every scale.
    """
    ev = table(spark, sf_dir, "events").withColumn("k", _k())
    names = _event_names(spark, sf_dir)
    e = F.col("event_id")
    k = F.col("k")
    ts = F.col("ts")
    et = F.col("event_type")
    op_txt = (F.when(e % 97 == 0, F.lit(None).cast("string"))
              .when(et == "purchase", "Продажа").when(et == "signup", "\u2003покупка\u3000")
              .when(et == "error", "ВОЗВРАТ").when(et == "click", "гашение").otherwise(et))
    m4 = e % 4
    dt_txt = (F.when(e % 89 == 0, F.lit("31.02.2024"))
              .when(m4 == 0, _fmt(ts, "yyyy-MM-dd HH:mm:ss")).when((m4 == 1) & (e % 5 == 0), _fmt(ts, "dd.MM.yyyy  HH:mm"))
              .when(m4 == 1, _fmt(ts, "dd.MM.yyyy HH:mm"))
              .when(m4 == 2, _fmt(ts, "dd.MM.yyyy")).otherwise(_fmt(ts, "yyyy-MM-dd")))
    dep = ts + F.make_dt_interval(hours=k)
    dep_txt = F.when(k % 10 == 0, F.lit(None).cast("string")).otherwise(_fmt(dep, "dd.MM.yyyy HH:mm"))
    v = F.col("value").cast("string")
    m3 = e % 3
    amt_txt = (F.when(e % 101 == 0, F.lit("n/a")).when(e % 103 == 0, F.lit("1_000")).when(m3 == 0, v)
               .when(m3 == 1, F.replace(v, F.lit("."), F.lit(","))).otherwise(F.concat(F.lit("\u2003"), v)))
    fee_txt = F.when(e % 2 == 0, F.concat((e % 50).cast("string"), F.lit(".5")))
    uid = F.col("user_id")
    name = F.when(uid % 4 == 0, F.concat(F.lit("test "), F.col("p_name"))).otherwise(F.col("p_name"))
    # Decomposed accents: some compose to a kept letter, some to a foreign one.
    name = (F.when(uid % 10 == 3, F.replace(name, F.lit("e"), F.lit("e\u0301")))
            .when(uid % 10 == 7, F.concat(name, F.lit(" Андреи\u0306"))).otherwise(name))
    fio_txt = F.when(uid % 5 == 0, F.concat(name, F.lit(" "), F.lpad(uid.cast("string"), 12, "7"))).otherwise(name)
    # Rows without a document: identified by phone, or by the name alone.
    by_phone, by_name = e % 7 == 0, e % 11 == 0
    upload = (F.lit(1) + F.floor((F.dayofmonth(ts) - 1) / 10)).cast("long")
    cells = F.array(
        op_txt, dt_txt, dep_txt,
        F.concat(F.lit("T"), (k % 13).cast("string")),
        F.concat(F.lit("ch"), (k % 5).cast("string")),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("ag"), (k % 3).cast("string"))),
        F.concat(F.lit("t"), (k % 17).cast("string")),
        F.concat(F.lit("cd"), (k % 11).cast("string")),
        F.concat(F.lit("pos"), (k % 4).cast("string")),
        amt_txt, fee_txt, fio_txt,
        F.lit(None).cast("string"),
        F.when(~by_phone & ~by_name, uid.cast("string")),
        F.concat(F.lit("ord"), e.cast("string")),
        F.concat(F.lit("st"), (k % 6).cast("string")),
        F.concat(F.lit("st"), ((k + 1) % 6).cast("string")),
        F.when(e % 6 == 0, F.concat(F.lit("line "), (k % 4).cast("string"))),
        F.when(by_phone, F.concat(F.lit("+7701"), F.lpad(uid.cast("string"), 7, "0"))),
        F.when(e % 9 == 0, F.lit("partner")),
    )
    data = (ev.join(names, "user_id", "left")
            .select(upload.alias("upload_id"), (e + SHEET_ROW_OFFSET).alias("row_num"), cells.alias("cells")))
    # Title, blank and header rows for the uploads that occur in the data.
    frame_rows = []
    for up, hdr_row in SHEET_HEADER_ROW.items():
        for r in range(1, hdr_row):
            frame_rows.append((up, r, [SHEET_TITLE] if r == 1 else [None]))
        frame_rows.append((up, hdr_row, SHEET_HEADERS[up]))
    frame = spark.createDataFrame(frame_rows, "upload_id long, row_num long, cells array<string>")
    present = data.select("upload_id").distinct()
    return data.unionByName(frame.join(present, "upload_id", "left_semi"))


def with_bad_uploads(cells: DataFrame) -> DataFrame:
    """M1s plus upload 90 (upload 1's data rows without a header) and upload 91
    (upload 2 with every data cell made unreadable)."""
    headless = (cells.filter((F.col("upload_id") == 1) & (F.col("row_num") > SHEET_HEADER_ROW[1]))
                .withColumn("upload_id", F.lit(90).cast("long")))
    junk = F.transform("cells", lambda c: F.when(c.isNotNull(), F.lit("x")))
    spoilt = (cells.filter(F.col("upload_id") == 2).withColumn("upload_id", F.lit(91).cast("long"))
              .withColumn("cells", F.when(F.col("row_num") > SHEET_HEADER_ROW[2], junk).otherwise(F.col("cells"))))
    return cells.unionByName(headless).unionByName(spoilt)


# ---------------------------------------------------------------------------
# M3: ledgers.
# ---------------------------------------------------------------------------

def upload_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload status events: upload = event_id div 20."""
    ev = table(spark, sf_dir, "events")
    et = F.col("event_type")
    status = (F.when(et == "signup", "pending").when(et == "purchase", "done").when(et == "error", "failed")
              .otherwise("processing"))
    return ev.select(F.floor(F.col("event_id") / 20).cast("long").alias("upload_id"),
                     status.alias("status"), F.col("ts"), F.col("event_id").alias("seq"),
                     F.when(et == "error", F.col("props")).alias("error"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring job events: job = 'job-' || event_id div 20."""
    ev = table(spark, sf_dir, "events")
    et = F.col("event_type")
    status = (F.when(et == "signup", "pending").when(et == "purchase", "done").when(et == "error", "failed")
              .otherwise("running"))
    return (ev.select(F.concat(F.lit("job-"), F.floor(F.col("event_id") / 20).cast("string")).alias("job_id"),
                      F.floor(F.col("event_id") / 20).cast("long").alias("upload_id"),
                      status.alias("status"), F.col("ts"), F.col("event_id").alias("seq"),
                      F.when(et == "error", F.col("props")).alias("error")))


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.concat(F.lit("a-"), F.col("event_id").cast("string")).alias("id"),
        F.col("user_id"),
        F.upper("event_type").alias("action"),
        F.lit("event").alias("entity_type"),
        F.col("event_id").cast("string").alias("entity_id"),
        F.col("props").alias("meta"),
        F.col("ts").alias("created_at"),
    )
