"""Registered queries (one per operator of the inventory) and their oracles.

Every query reads the driver's tables under ``sf_dir`` (whole tables) and
returns a lazy DataFrame; column names equal those of the oracle SQL.
Arrays are compared as joined text.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from farewatch import constants as K
from farewatch import oracle as O
from farewatch.functions import identity as I
from farewatch.functions import names as N
from farewatch.functions import timeflags as TF
from farewatch.operators import features as FT
from farewatch.operators import ledger as LG
from farewatch.operators import lookups as LK
from farewatch.operators import risk as RK
from farewatch.operators import scoring as SC
from farewatch.operators import upsert as UP
from farewatch.plans import exports as EX
from farewatch.plans.ingest import enrich_rows, transactions_from
from farewatch.plans.pipeline import RUN_TIME, build_state, events_state
from farewatch.session import configure, cut_lineage, scratch_path
from farewatch.sources import fixtures as FX
from farewatch.sources import uploads as UPL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


SUSP = O.SUSP_SQL
M1 = O.with_m1
FLAGGED = O.FLAGGED
CONC = O.CONC
RT = O.RUN_TIME_SQL
DATE_FROM = _dt.datetime(2024, 1, 5)
DATE_TO = _dt.datetime(2024, 1, 25, 23, 59, 59)
D_FROM_SQL = "TIMESTAMP '2024-01-05 00:00:00'"
D_TO_SQL = "TIMESTAMP '2024-01-25 23:59:59'"


def _cells_typed(spark, sf_dir):
    configure(spark)
    typed, headers, wide = UPL.typed_from_cells(FX.events_sheet_cells(spark, sf_dir))
    return typed, headers, wide


def _cells_state(spark, sf_dir):
    typed, _, _ = _cells_typed(spark, sf_dir)
    # Cut as in the ingest job: a filter on the error that is pushed below the typing types every row twice.
    good, _ = UPL.split_errors(cut_lineage(typed, "typed"))
    return build_state(good)


def _reasons_text(col="top_reasons"):
    return F.array_join(F.col(col), "; ").alias("reasons")


def _operations_text(col="operations"):
    """The operations of a dossier, newest first, every field of each (nothing for a null)."""
    def text(o):
        parts = (o["rn"].cast("string"), I.py_datetime_str(o["op_datetime"]), o["op_type"], o["train_no"],
                 I.py_float_str(o["amount"]), o["route"])
        return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.array_join(F.transform(F.col(col), text), "; ").alias("operations")


# ==========================================================================
# A6 risk trend (flagship)
# ==========================================================================

@register("risk_trend", M1(FLAGGED) + f"""
SELECT date_trunc('day', op_datetime) AS day, count(*) AS total_ops, CAST(count_if(suspicious) AS BIGINT) AS highrisk_ops,
       {O.rnd("count_if(suspicious) * 100.0::DOUBLE / count(*)", 2)} AS share
FROM flagged GROUP BY 1""")
def q_risk_trend(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return RK.risk_trend(st.transactions, st.scores)


@register("risk_trend_range", M1(FLAGGED) + f"""
SELECT date_trunc('day', op_datetime) AS day, count(*) AS total_ops, CAST(count_if(suspicious) AS BIGINT) AS highrisk_ops,
       {O.rnd("count_if(suspicious) * 100.0::DOUBLE / count(*)", 2)} AS share
FROM flagged WHERE op_datetime >= {D_FROM_SQL} AND op_datetime <= {D_TO_SQL} GROUP BY 1""")
def q_risk_trend_range(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return RK.risk_trend(st.transactions, st.scores, DATE_FROM, DATE_TO)


# ==========================================================================
# S1-S4 sources, P1-P8 typing (sheet cells rendered from events)
# ==========================================================================

@register("src_upload_rows", O.with_cells() + """
SELECT upload_id, row_num, CAST(len(list_filter(cells, lambda c: c IS NOT NULL)) AS INTEGER) AS n_values,
       array_to_string(list_transform(cells, lambda c: coalesce(c, '')), '|') AS text
FROM srows""")
def q_src_upload_rows(spark, sf_dir):
    configure(spark)
    rows = UPL.sheet_rows(FX.events_sheet_cells(spark, sf_dir))
    return rows.select("upload_id", "row_num", F.size(F.filter("cells", lambda c: c.isNotNull())).alias("n_values"),
                       F.array_join("cells", "|", "").alias("text"))


@register("src_upload_files", O.with_cells() + """
SELECT reader, upload_id, row_num, CAST(len(list_filter(cells, lambda c: c <> '')) AS INTEGER) AS n_values,
       array_to_string(list_transform(cells, lambda c, i: CASE WHEN c <> '' THEN (i - 1) || '=' || c END), '|') AS text
FROM (SELECT upload_id, row_num, list_transform(cells, lambda c: CASE WHEN c <> '' AND row_num % 5 = 0 THEN c || '"' || chr(10) || ',x'
    WHEN c <> '' AND row_num % 5 = 1 THEN '"' || c ELSE c END) AS cells FROM srows)
  CROSS JOIN (VALUES ('csv'), ('csv_lines'), ('xlsx')) AS r(reader)
WHERE len(list_filter(cells, lambda c: c <> '')) > 0""")
def q_src_upload_files(spark, sf_dir):
    """The sheets written as CSV and xlsx files and read back by each reader (empty and null cells are one there).

    Some cells get quotes, delimiters and line breaks first.
    """
    configure(spark)
    folder, n = scratch_path(spark, f"upload-files-{uuid.uuid4().hex[:12]}"), F.col("row_num") % 5

    def marked(c):
        return F.when((c != "") & (n == 0), F.concat(c, F.lit('"\n,x'))).when((c != "") & (n == 1), F.concat(F.lit('"'), c)).otherwise(c)

    cells = FX.events_sheet_cells(spark, sf_dir)
    UPL.write_uploads(cells.withColumn("cells", F.transform("cells", marked)), folder, "xlsx", "csv")
    # The longest tasks first.
    readers = {"xlsx": UPL.read_xlsx_uploads, "csv": UPL.read_csv_uploads, "csv_lines": UPL.read_csv_lines}
    rows = reduce(DataFrame.unionByName, (UPL.whole_uploads(read(spark, folder)).withColumn("reader", F.lit(name))
                                          for name, read in readers.items()))
    # Cells of the usual width are rendered by generated code; a lambda is interpreted, cell by cell.
    width = max(map(len, FX.SHEET_HEADERS.values()))
    filled = F.array_join(F.transform("cells", lambda c, i: F.when(c != "", F.concat(i.cast("string"), F.lit("="), c))), "|")
    usual = F.concat_ws("|", *(F.when(c != "", F.concat(F.lit(f"{i}="), c)) for i, c in ((i, F.get("cells", F.lit(i))) for i in range(width))))
    return (rows.where(F.exists("cells", lambda c: c != ""))
            .select("reader", "upload_id", "row_num", F.size(F.filter("cells", lambda c: c != "")).alias("n_values"),
                    F.when(F.size("cells") <= width, usual).otherwise(filled).alias("text")))


@register("header_discovery", O.with_cells() + "SELECT upload_id, header_row, header_error FROM headers")
def q_header_discovery(spark, sf_dir):
    _, headers, _ = _cells_typed(spark, sf_dir)
    return headers


@register("column_aliases", O.with_cells() + "SELECT upload_id, canonical, CAST(idx AS INTEGER) AS idx FROM colmap")
def q_column_aliases(spark, sf_dir):
    configure(spark)
    rows = UPL.sheet_rows(FX.events_sheet_cells(spark, sf_dir))
    return UPL.column_map(rows, UPL.discover_headers(rows))


@register("row_errors", O.with_cells() + "SELECT upload_id, row_num, error FROM typed WHERE error IS NOT NULL")
def q_row_errors(spark, sf_dir):
    typed, _, _ = _cells_typed(spark, sf_dir)
    return UPL.split_errors(typed)[1]


@register("typed_rows", O.with_cells() + "SELECT * FROM good")
def q_typed_rows(spark, sf_dir):
    typed, _, _ = _cells_typed(spark, sf_dir)
    return UPL.split_errors(typed)[0]


@register("op_type_map", O.with_cells() + f"""
SELECT op_type AS raw, {O._op('op_type')} AS op_type, count(*) AS n FROM wide GROUP BY ALL""")
def q_op_type_map(spark, sf_dir):
    from farewatch.functions import text as X
    _, _, wide = _cells_typed(spark, sf_dir)
    return (wide.select(F.col("op_type").alias("raw"), X.op_type("op_type").alias("op_type"))
            .groupBy("raw", "op_type").agg(F.count("*").alias("n")))


@register("parse_datetime", O.with_cells() + "SELECT upload_id, row_num, op_datetime, dep_datetime FROM typed")
def q_parse_datetime(spark, sf_dir):
    typed, _, _ = _cells_typed(spark, sf_dir)
    return typed.select("upload_id", "row_num", "op_datetime", "dep_datetime")


@register("parse_amount", O.with_cells() + f"""
SELECT upload_id, row_num, {O._num('amount')} AS amount, {O._num('fee')} AS fee,
       {O._num_err('amount', 'amount')} AS amount_error FROM wide""")
def q_parse_amount(spark, sf_dir):
    from farewatch.functions import text as X
    _, _, wide = _cells_typed(spark, sf_dir)
    return wide.select("upload_id", "row_num", X.parse_amount("amount").alias("amount"),
                       X.parse_amount("fee").alias("fee"), X.amount_error("amount", "amount").alias("amount_error"))


@register("extract_iin", O.with_cells() + "SELECT upload_id, row_num, iin FROM typed")
def q_extract_iin(spark, sf_dir):
    typed, _, _ = _cells_typed(spark, sf_dir)
    return typed.select("upload_id", "row_num", "iin")


@register("derive_route", O.with_cells() + "SELECT upload_id, row_num, route FROM typed")
def q_derive_route(spark, sf_dir):
    typed, _, _ = _cells_typed(spark, sf_dir)
    return typed.select("upload_id", "row_num", "route")


# ==========================================================================
# P9-P15 names and identities
# ==========================================================================

@register("fio_clean", O.with_cells() + f"SELECT DISTINCT fio, {O.clean_name('fio')} AS fio_clean FROM typed")
def q_fio_clean(spark, sf_dir):
    typed, _, _ = _cells_typed(spark, sf_dir)
    return typed.select("fio").distinct().select("fio", N.clean_name("fio").alias("fio_clean"))


def _translit_sql(expr: str) -> str:
    s = expr
    for k, v in K.TRANSLIT_PAIRS:
        if len(v) != 1:
            s = f"replace({s}, '{k}', '{v}')"
    src = "".join(k for k, v in K.TRANSLIT_PAIRS if len(v) == 1)
    dst = "".join(v for k, v in K.TRANSLIT_PAIRS if len(v) == 1)
    return f"translate({s}, '{src}', '{dst}')"


@register("fio_translit", O.with_cells() + f"""
SELECT DISTINCT fio, upper({_translit_sql("lower(" + O.clean_name('fio') + ")")}) AS fio_latin FROM typed""")
def q_fio_translit(spark, sf_dir):
    typed, _, _ = _cells_typed(spark, sf_dir)
    return typed.select("fio").distinct().select("fio", N.clean_name("fio", translit=True).alias("fio_latin"))


@register("fake_fio_score", O.with_cells() + f"""
SELECT DISTINCT fio_clean, {O.fake_score('fio_clean')} AS fake_fio_score
FROM (SELECT {O.clean_name('fio')} AS fio_clean FROM typed)""")
def q_fake_fio_score(spark, sf_dir):
    typed, _, _ = _cells_typed(spark, sf_dir)
    return (typed.select(N.clean_name("fio").alias("fio_clean")).distinct()
            .select("fio_clean", N.fake_name_score("fio_clean").alias("fake_fio_score")))


@register("identity_key", O.with_cells(ingest=True) + "SELECT upload_id, row_num, identity_key FROM en")
def q_identity_key(spark, sf_dir):
    typed, _, _ = _cells_typed(spark, sf_dir)
    return enrich_rows(UPL.split_errors(typed)[0]).select("upload_id", "row_num", "identity_key")


@register("passenger_id", O.with_cells(ingest=True) + "SELECT upload_id, row_num, passenger_id, fio_clean FROM en")
def q_passenger_id(spark, sf_dir):
    typed, _, _ = _cells_typed(spark, sf_dir)
    return enrich_rows(UPL.split_errors(typed)[0]).select("upload_id", "row_num", "passenger_id", "fio_clean")


_ANON_ROWS_SQL = """
m1_anon AS (
  SELECT * REPLACE (CASE WHEN k9 THEN NULL ELSE fio END AS fio, CASE WHEN k9 THEN NULL ELSE doc_no END AS doc_no)
  FROM (SELECT r.*, (CAST(json_extract_string(e.props, '$.k') AS INTEGER) % 9 = 0) AS k9
        FROM m1_rows r JOIN events e ON e.event_id = r.row_num)
)"""


@register("anonymous_identity",
          "WITH " + O.M1_ROWS.strip() + "," + _ANON_ROWS_SQL.strip() + "," + O.enriched_cte("(SELECT * EXCLUDE (k9) FROM m1_anon)").strip()
          + "\nSELECT upload_id, row_num, passenger_id, fio_clean, is_anonymous, fake_fio_score FROM en")
def q_anonymous_identity(spark, sf_dir):
    configure(spark)
    rows = FX.events_typed_rows(spark, sf_dir)
    ev = FX.table(spark, sf_dir, "events").select(F.col("event_id").alias("row_num"),
                                                  (F.get_json_object("props", "$.k").cast("int") % 9 == 0).alias("k9"))
    rows = (rows.join(ev, "row_num")
            .withColumn("fio", F.when(F.col("k9"), F.lit(None)).otherwise(F.col("fio")))
            .withColumn("doc_no", F.when(F.col("k9"), F.lit(None)).otherwise(F.col("doc_no"))).drop("k9"))
    from farewatch.plans.ingest import row_fake_score
    return enrich_rows(rows).select("upload_id", "row_num", "passenger_id", "fio_clean", "is_anonymous",
                                    row_fake_score(F.col("fio_clean"), F.col("is_anonymous")).alias("fake_fio_score"))


@register("transaction_id", O.with_cells(ingest=True) + "SELECT upload_id, row_num, id FROM tx")
def q_transaction_id(spark, sf_dir):
    typed, _, _ = _cells_typed(spark, sf_dir)
    return transactions_from(enrich_rows(UPL.split_errors(typed)[0])).select("upload_id", "row_num", "id")


# ==========================================================================
# P16-P18 time features
# ==========================================================================

_H = "(epoch_us(dep_datetime) - epoch_us(op_datetime)) / 1e6::DOUBLE / 3600.0::DOUBLE"


@register("hours_to_departure", M1() + f"SELECT id, {_H} AS hours_to_departure FROM tx")
def q_hours(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return st.transactions.select("id", TF.hours_to_departure().alias("hours_to_departure"))


@register("night_flag", M1() + """
SELECT id, hour(op_datetime) BETWEEN 0 AND 5 AS is_night,
       (hour(op_datetime) >= 23 OR hour(op_datetime) < 6) AS is_night_entity FROM tx""")
def q_night(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return st.transactions.select("id", TF.night_flag().alias("is_night"),
                                  TF.night_flag(definition="entity").alias("is_night_entity"))


@register("late_refund_flag", M1() + f"""
SELECT id, coalesce(op_type = 'refund' AND {_H} < 24 AND {_H} >= 0, false) AS late_refund,
       coalesce(op_type = 'refund' AND {_H} >= 0 AND {_H} <= 1, false) AS last_minute_refund FROM tx""")
def q_late(spark, sf_dir):
    st = events_state(spark, sf_dir)
    t = st.transactions.withColumn("h", TF.hours_to_departure())
    return t.select("id", TF.late_refund_flag(hours="h").alias("late_refund"),
                    TF.late_refund_flag(hours="h", definition="entity").alias("last_minute_refund"))


# ==========================================================================
# F1-F8 filters and lookups, J1-J6 joins
# ==========================================================================

_SUSP_COLS = "id, passenger_id, op_datetime, train_no, terminal, cashdesk, risk_band"


@register("suspicious_ops", M1() + f"""
SELECT {", ".join("t." + c if c != "risk_band" else "s.risk_band" for c in _SUSP_COLS.split(", "))}
FROM tx t JOIN scores s USING (passenger_id)
WHERE s.risk_band IN ({SUSP}) AND t.op_datetime >= {D_FROM_SQL} AND t.op_datetime <= {D_TO_SQL}""")
def q_suspicious_ops(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return RK.suspicious_operations(st.transactions, st.scores, date_from=DATE_FROM, date_to=DATE_TO) \
        .select(*_SUSP_COLS.split(", "))


@register("suspicious_ops_filtered", M1() + f"""
SELECT t.id, t.passenger_id, t.train_no, t.cashdesk, t.terminal, s.risk_band FROM tx t JOIN scores s USING (passenger_id)
WHERE s.risk_band IN ({SUSP}) AND t.cashdesk IN ('cd5', 'cd6') AND t.train_no = 'T' || right(t.cashdesk, 1)
  AND t.terminal = 't' || right(t.cashdesk, 1)""")
def q_suspicious_ops_filtered(spark, sf_dir):
    st = events_state(spark, sf_dir)
    parts = [RK.suspicious_operations(st.transactions, st.scores, train_no=f"T{d}", cashdesk=f"cd{d}", terminal=f"t{d}")
             for d in (5, 6)]
    return parts[0].unionByName(parts[1]).select("id", "passenger_id", "train_no", "cashdesk", "terminal", "risk_band")


@register("counts_filtered", M1(FLAGGED) + """
SELECT f.name AS filter, count(t.id) AS total_ops, CAST(count_if(suspicious) AS BIGINT) AS suspicious_ops
FROM (VALUES ('train'), ('cashdesk'), ('terminal'), ('all')) f(name) LEFT JOIN flagged t
  ON CASE f.name WHEN 'train' THEN train_no = 'T5' WHEN 'cashdesk' THEN cashdesk = 'cd5' WHEN 'terminal' THEN terminal = 't5'
     ELSE train_no = 'T5' AND cashdesk = 'cd5' AND terminal = 't5' END
GROUP BY 1""")
def q_counts_filtered(spark, sf_dir):
    st = events_state(spark, sf_dir)
    train, desk, terminal = {"train_no": "T5"}, {"cashdesk": "cd5"}, {"terminal": "t5"}
    out = None
    for name, filters in (("train", train), ("cashdesk", desk), ("terminal", terminal), ("all", train | desk | terminal)):
        one = RK.counts(st.transactions, st.scores, **filters).select(F.lit(name).alias("filter"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@register("passenger_page", M1() + """,
hits AS (
  SELECT p.id, p.fio_clean, p.last_seen_at, s.risk_band, s.final_score, f.total_tickets, f.refund_share, count(*) OVER () AS total
  FROM pass p JOIN scores s ON s.passenger_id = p.id LEFT JOIN feat f ON f.passenger_id = p.id
  WHERE s.risk_band = 'medium' AND (p.fio_clean ILIKE '%TE%' OR p.id IN (SELECT passenger_id FROM tx WHERE iin ILIKE '%TE%'))
)
SELECT * FROM hits ORDER BY last_seen_at DESC, id LIMIT 10 OFFSET 1""")
def q_passenger_page(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return LK.passenger_page(st.passengers, st.transactions, st.scores, st.features, term="TE", band="medium",
                             limit=10, offset=1).select(
        "id", "fio_clean", "last_seen_at", "risk_band", "final_score", "total_tickets", "refund_share", "total")


@register("passenger_search", O.with_cells(ingest=True) + """
SELECT p.id, p.fio_clean FROM pass p
WHERE p.fio_clean ILIKE '%test%' OR p.id IN (SELECT passenger_id FROM tx WHERE iin ILIKE '%test%')
UNION
SELECT p.id, p.fio_clean FROM pass p WHERE p.id IN (SELECT passenger_id FROM tx WHERE iin ILIKE '%77700%')""")
def q_passenger_search(spark, sf_dir):
    st = _cells_state(spark, sf_dir)
    a = LK.passenger_search(st.passengers, st.transactions, "test")
    b = LK.passenger_search(st.passengers, st.transactions, "77700")
    return a.unionByName(b).select("id", "fio_clean").distinct()


@register("upload_transactions", M1() + """
SELECT id, upload_id, op_datetime FROM tx WHERE upload_id = 2 ORDER BY op_datetime DESC, id LIMIT 500""")
def q_upload_transactions(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return LK.upload_transactions(st.transactions, 2, limit=500).select("id", "upload_id", "op_datetime")


@register("passenger_history", M1() + f"""
SELECT id, passenger_id, op_datetime, CAST(rn AS INTEGER) AS rn FROM (
  SELECT t.id, t.passenger_id, t.op_datetime,
         row_number() OVER (PARTITION BY t.passenger_id ORDER BY t.op_datetime DESC, t.id) AS rn
  FROM tx t WHERE t.passenger_id IN (SELECT passenger_id FROM scores WHERE risk_band IN ({SUSP}))
) WHERE rn <= 30""")
def q_passenger_history(spark, sf_dir):
    st = events_state(spark, sf_dir)
    ids = st.scores.filter(RK.is_suspicious()).select("passenger_id")
    return LK.passenger_history(st.transactions, ids, limit=30).select("id", "passenger_id", "op_datetime", "rn")


@register("page_topk", M1() + f"""
SELECT t.id, t.op_datetime FROM tx t JOIN scores s USING (passenger_id) WHERE s.risk_band IN ({SUSP})
ORDER BY t.op_datetime DESC, t.id LIMIT 200 OFFSET 100""")
def q_page_topk(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return LK.page(RK.suspicious_operations(st.transactions, st.scores), limit=200, offset=100).select("id", "op_datetime")


@register("page_deep", M1() + f""",
ranked AS (SELECT t.id, t.op_datetime, row_number() OVER (ORDER BY t.op_datetime DESC, t.id) AS rn, count(*) OVER () AS n
  FROM tx t JOIN scores s USING (passenger_id) WHERE s.risk_band IN ({SUSP}))
SELECT id, op_datetime FROM ranked WHERE rn > n // 2 AND rn <= n // 2 + 200""")
def q_page_deep(spark, sf_dir):
    """A page that starts at half of the suspicious operations, found by rank."""
    st = events_state(spark, sf_dir)
    ops = RK.suspicious_operations(st.transactions, st.scores)
    return LK.deep_page(ops, limit=200, offset=ops.count() // 2).select("id", "op_datetime")


@register("upload_outcome", O.with_cells() + f"""
SELECT upload_id, 'done' AS status, CAST(NULL AS VARCHAR) AS error, count(*) AS rows_read, count(error) AS parse_errors
FROM typed GROUP BY upload_id
UNION ALL SELECT 90, 'failed', 'missing required columns: ' || '{", ".join(sorted(K.REQUIRED_COLUMNS))}', 0, 0
UNION ALL SELECT 91, 'failed', '{LG.NO_GOOD_ROWS}', count(*), count(*) FROM typed WHERE upload_id = 2""")
def q_upload_outcome(spark, sf_dir):
    configure(spark)
    cells = FX.with_bad_uploads(FX.events_sheet_cells(spark, sf_dir))
    typed, headers, _ = UPL.typed_from_cells(cells)
    return LG.upload_outcomes(cells.select("upload_id").distinct(), headers, typed)


@register("audit_filter", """
SELECT 'a-' || event_id AS id, upper(event_type) AS action, ts AS created_at FROM events
WHERE upper(event_type) = 'PURCHASE' AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'
ORDER BY ts DESC, id DESC""")
def q_audit_filter(spark, sf_dir):
    configure(spark)
    a = FX.audit_rows(spark, sf_dir)
    return LG.audit_filter(a, action="PURCHASE", date_from=_dt.datetime(2024, 1, 10), date_to=_dt.datetime(2024, 1, 20),
                           limit=None).select("id", "action", "created_at")


@register("point_lookup", M1() + f"""
SELECT id, fio_clean, first_seen_at, last_seen_at FROM pass
WHERE id IN (SELECT passenger_id FROM scores WHERE risk_band IN ({SUSP}))""")
def q_point_lookup(spark, sf_dir):
    st = events_state(spark, sf_dir)
    keys = st.scores.filter(RK.is_suspicious()).select(F.col("passenger_id").alias("id"))
    return LK.lookup(st.passengers, keys, "id").select("id", "fio_clean", "first_seen_at", "last_seen_at")


@register("derived_flags", M1() + f"""
SELECT f.passenger_id, f.refund_share >= {K.REFUND_RATE_HIGH} AS refund_rate_high,
  p.fake_fio_score >= {K.LIKELY_FAKE_IDENTITY} AS likely_fake_identity,
  coalesce(s.risk_band = 'critical', false) AS is_critical,
  coalesce(s.risk_band IN ({SUSP}), false) AS is_suspicious,
  s.passenger_id IS NOT NULL AS is_scored,
  coalesce(s.seat_blocking_flag, false) AS has_seat_blocking
FROM feat f JOIN pass p ON p.id = f.passenger_id LEFT JOIN scores s USING (passenger_id)""")
def q_derived_flags(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return LK.derived_flags(st.features, st.passengers, st.scores)


@register("scoring_input", M1() + """
SELECT t.id, t.passenger_id, p.fio_clean, p.fake_fio_score AS p_fake_fio
FROM tx t JOIN pass p ON t.passenger_id = p.id WHERE t.upload_id = 2""")
def q_scoring_input(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return LK.scoring_input(st.transactions, st.passengers, 2).select("id", "passenger_id", "fio_clean", "p_fake_fio")


@register("dimension_stats", M1(FLAGGED) + f"""
SELECT dimension_type, dimension_value, count(*) AS total_ops, CAST(count_if(suspicious) AS BIGINT) AS highrisk_ops
FROM ({O.dims_unpivot()}) GROUP BY 1, 2""")
def q_dimension_stats(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return RK.dimension_stats_pre(st.transactions, st.scores)


@register("passenger_profile", M1() + """
SELECT p.id, p.fio_clean, coalesce(s.risk_band, 'low') AS risk_band, coalesce(s.final_score, 0.0::DOUBLE) AS final_score,
  f.total_tickets, f.refund_share, f.night_share, f.max_tickets_month
FROM pass p LEFT JOIN scores s ON s.passenger_id = p.id LEFT JOIN feat f ON f.passenger_id = p.id""")
def q_passenger_profile(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return LK.passenger_profile(st.passengers, st.scores, st.features).select(
        "id", "fio_clean", "risk_band", "final_score", "total_tickets", "refund_share", "night_share", "max_tickets_month")


@register("passengers_by_band", M1() + """
SELECT p.id, p.fio_clean FROM pass p JOIN scores s ON s.passenger_id = p.id WHERE s.risk_band = 'medium'""")
def q_passengers_by_band(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return LK.passengers_by_band(st.passengers, st.scores, "medium").select("id", "fio_clean")


# ==========================================================================
# A1-A11 aggregations
# ==========================================================================

_FEAT_COLS = ("passenger_id, total_tickets, refund_cnt, night_tickets, late_refunds, fake_fio, refund_share, "
              "night_share, refund_close_ratio")


@register("passenger_features", M1() + f"SELECT {_FEAT_COLS} FROM feat")
def q_passenger_features(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return FT.passenger_features(st.transactions, st.passengers).select(*_FEAT_COLS.split(", "))


@register("passenger_features_upload", M1(scope="upload") + f"SELECT upload_id, {_FEAT_COLS} FROM feat")
def q_passenger_features_upload(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return FT.passenger_features(st.transactions, st.passengers, scope="upload") \
        .select("upload_id", *_FEAT_COLS.split(", "))


@register("peak_features", M1() + """
SELECT passenger_id, max_tickets_month, max_tickets_same_depday, tickets_per_train_peak FROM feat""")
def q_peak_features(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return FT.peak_features(st.transactions)


@register("seat_blocking", M1(scope="upload") + f"""
SELECT upload_id, passenger_id,
  max_tickets_same_depday >= {K.SEAT_SAME_DEPDAY_MIN} AND refund_close_ratio >= {K.SEAT_CLOSE_RATIO_MIN} AS seat_blocking_feature,
  refund_close_ratio > {K.SEAT_CLOSE_RATIO_MIN} AS seat_blocking_flag
FROM feat""")
def q_seat_blocking(spark, sf_dir):
    st = events_state(spark, sf_dir, scope="upload")
    return st.features.select("upload_id", "passenger_id", "seat_blocking_feature", "seat_blocking_flag")


@register("passenger_rollup", M1() + "SELECT * FROM pass")
def q_passenger_rollup(spark, sf_dir):
    return events_state(spark, sf_dir).passengers


@register("counts", M1(FLAGGED) + """
SELECT (SELECT count(*) FROM flagged) AS total_ops,
       (SELECT CAST(count_if(suspicious) AS BIGINT) FROM flagged) AS suspicious_ops,
       (SELECT count(*) FROM pass) AS total_passengers,
       CAST(count_if(s.risk_band = 'low') AS BIGINT) AS low_count, CAST(count_if(s.risk_band = 'medium') AS BIGINT) AS medium_count,
       CAST(count_if(s.risk_band = 'high') AS BIGINT) AS high_count, CAST(count_if(s.risk_band = 'critical') AS BIGINT) AS critical_count
FROM pass p LEFT JOIN scores s ON s.passenger_id = p.id""")
def q_counts(spark, sf_dir):
    st = events_state(spark, sf_dir)
    ops = RK.counts(st.transactions, st.scores)
    pc = RK.passenger_counts(st.passengers, st.scores)
    return pc.select(ops.select("total_ops").scalar().alias("total_ops"),
                     ops.select("suspicious_ops").scalar().alias("suspicious_ops"), "*")


_CONC_COLS = "id, dimension_type, dimension_value, total_ops, highrisk_ops, share_highrisk_ops, lift_vs_base, calculated_at"


@register("risk_concentration", M1(FLAGGED, CONC) + f"SELECT {_CONC_COLS} FROM conc")
def q_risk_concentration(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return RK.concentration(st.transactions, st.scores, calculated_at=RUN_TIME)


@register("risk_concentration_flagged", M1(FLAGGED, CONC) + f"SELECT {_CONC_COLS} FROM conc")
def q_risk_concentration_flagged(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return RK.risk_concentration(st.flagged(), calculated_at=RUN_TIME)


def _label_sql(c: str) -> str:
    whens = " ".join(f"WHEN {c} >= {cut} THEN '{lab}'" for cut, lab in K.HOTSPOT_LABELS)
    return f"CASE {whens} ELSE '{K.HOTSPOT_DEFAULT}' END"


@register("hotspot_label", M1(FLAGGED, CONC) + f"""
SELECT dimension_type, dimension_value, lift_vs_base, {_label_sql('lift_vs_base')} AS risk_label,
       lift_vs_base >= {K.HOTSPOT_LIFT} AS is_hotspot FROM conc""")
def q_hotspot_label(spark, sf_dir):
    st = events_state(spark, sf_dir)
    c = RK.risk_concentration(st.flagged(), calculated_at=RUN_TIME)
    return c.select("dimension_type", "dimension_value", "lift_vs_base", RK.hotspot_label().alias("risk_label"),
                    (F.col("lift_vs_base") >= K.HOTSPOT_LIFT).alias("is_hotspot"))


@register("dashboard_summary", M1(FLAGGED, CONC) + f"""
SELECT (SELECT count(*) FROM pass) AS total_passengers,
  (SELECT count(*) FROM pass p JOIN scores s ON s.passenger_id = p.id WHERE s.risk_band = 'high') AS high_risk_count,
  (SELECT count(*) FROM pass p JOIN scores s ON s.passenger_id = p.id WHERE s.risk_band = 'critical') AS critical_risk_count,
  (SELECT CASE WHEN count(*) > 0 THEN {O.rnd("count_if(suspicious) * 100.0::DOUBLE / count(*)", 2)} ELSE 0.0::DOUBLE END FROM flagged)
    AS share_suspicious_ops,
  (SELECT dimension_value FROM conc WHERE dimension_type = 'channel' ORDER BY lift_vs_base DESC, dimension_value LIMIT 1)
    AS top_risk_channel,
  (SELECT dimension_value FROM conc WHERE dimension_type = 'terminal' ORDER BY lift_vs_base DESC, dimension_value LIMIT 1)
    AS top_risk_terminal""")
def q_dashboard_summary(spark, sf_dir):
    st = events_state(spark, sf_dir)
    conc = RK.concentration(st.transactions, st.scores, calculated_at=RUN_TIME)
    return RK.dashboard_summary(st.passengers, st.scores, st.transactions, conc)


@register("upload_summary", O.with_cells(ingest=True) + """
SELECT t.upload_id, count(*) AS rows_read, CAST(count_if(t.error IS NOT NULL) AS BIGINT) AS parse_errors,
  coalesce(max(l.n), 0) AS transactions_loaded, coalesce(max(l.p), 0) AS passengers_upserted
FROM typed t LEFT JOIN (SELECT upload_id, count(*) AS n, count(DISTINCT passenger_id) AS p FROM tx GROUP BY 1) l
  USING (upload_id)
GROUP BY t.upload_id""")
def q_upload_summary(spark, sf_dir):
    typed, _, _ = _cells_typed(spark, sf_dir)
    good, _ = UPL.split_errors(typed)
    tx = transactions_from(enrich_rows(good))
    return LG.upload_summary(typed, tx)


# ==========================================================================
# R1-R8 scoring
# ==========================================================================

@register("rule_score", M1() + "SELECT passenger_id, rule_score FROM sc0")
def q_rule_score(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return st.features.select("passenger_id", SC.rule_score().alias("rule_score"))


def _c_sql(n: str) -> str:
    return (f"(CASE WHEN {n} > 2 THEN 2.0::DOUBLE * (ln({n} - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE)"
            f" - 2.0::DOUBLE * ({n} - 1) / {n} WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")


def _forest_sql() -> str:
    """CTEs that draw the samples, grow the trees level by level and walk every passenger down them."""
    d, trees, sample, seed = len(K.IFOREST_FEATURES), K.IFOREST_TREES, K.IFOREST_SAMPLE, K.IFOREST_SEED
    vector = ", ".join(f"CAST({c} AS DOUBLE)" for c in K.IFOREST_FEATURES)

    def digits(text, start, n):
        return f"('0x' || substr({text}, {start}, {n}))::BIGINT"

    sql = f"""
x AS (SELECT passenger_id AS key, [{vector}] AS v, md5('{seed}:' || passenger_id) AS m FROM feat),
sizes AS (SELECT count(*) AS n, least({sample}, count(*)) AS psi,
  CAST(floor(least(1.0::DOUBLE, 4.0::DOUBLE * least({sample}, count(*)) / count(*)) * 2147483647) AS BIGINT) AS most FROM x),
drawn AS (SELECT tree, key, v, ({digits('m', 1, 7)} + tree * {digits('m', 8, 7)}) % 2147483647 AS h
  FROM x, (SELECT unnest(range(0::BIGINT, {trees})) AS tree)),
g0 AS (SELECT tree, key, v, 0 AS node FROM
  (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY h, key) AS rank FROM drawn, sizes WHERE h <= most) WHERE rank <= psi)"""
    levels = (sample - 1).bit_length()
    for k in range(levels):
        lo, hi = (", ".join(f"{f}(v[{i + 1}]) OVER w" for i in range(d)) for f in ("min", "max"))
        sql += f""",
a{k} AS (SELECT tree, key, v, node, count(*) OVER w AS size, [{lo}] AS lo, [{hi}] AS hi, md5('{seed}:' || tree || ':' || node) AS m
  FROM g{k} WINDOW w AS (PARTITION BY tree, node)),
b{k} AS (SELECT *, list_filter(range(1, {d + 1}), lambda i: hi[i] > lo[i]) AS varying FROM a{k}),
c{k} AS (SELECT *, CASE WHEN size > 1 AND len(varying) > 0 AND {k} < ceil(log2(greatest(psi, 2))) THEN varying[{digits('m', 1, 8)} % len(varying) + 1] END AS f
  FROM b{k}, sizes),
d{k} AS (SELECT *, lo[f] + (({digits('m', 9, 13)})::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE * (hi[f] - lo[f]) AS t FROM c{k}),
g{k + 1} AS (SELECT tree, key, v, CASE WHEN f IS NULL THEN node WHEN v[f] < t THEN 2 * node + 1 ELSE 2 * node + 2 END AS node FROM d{k})"""
    inner = " UNION ALL ".join(f"SELECT DISTINCT tree, node, f, t, NULL::BIGINT AS size FROM d{k} WHERE f IS NOT NULL" for k in range(levels))
    sql += f""",
nodes AS ({inner} UNION ALL SELECT tree, node, NULL, NULL, count(*) FROM g{levels} GROUP BY tree, node),
w0 AS (SELECT key, v, tree, 0 AS node FROM x, (SELECT DISTINCT tree FROM g0))"""
    for k in range(levels):
        sql += f""",
w{k + 1} AS (SELECT key, v, tree, CASE WHEN f IS NULL THEN node WHEN v[f] < t THEN 2 * node + 1 ELSE 2 * node + 2 END AS node
  FROM w{k} JOIN nodes USING (tree, node))"""
    return sql + f""",
raw AS (SELECT key AS passenger_id, pow(2.0::DOUBLE, -avg(floor(log2(node + 1.5)) + {_c_sql("size")}) / {_c_sql("any_value(psi)")}) AS s
  FROM w{levels} JOIN nodes USING (tree, node), sizes GROUP BY key)
SELECT passenger_id, round(s, 6) AS anomaly_raw, round(CASE WHEN max(s) OVER () > min(s) OVER ()
  THEN (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) * 100.0::DOUBLE ELSE 0.0::DOUBLE END, 4) AS ml_score FROM raw"""


@register("anomaly_score", M1().rstrip() + "," + _forest_sql())
def q_anomaly_score(spark, sf_dir):
    from farewatch.operators.iforest import anomaly_scores
    st = events_state(spark, sf_dir)
    # Counted, drawn from and scored: aggregated once, as in the scoring run.
    scores = anomaly_scores(cut_lineage(st.features, "features"))
    return scores.select("passenger_id", F.round("anomaly_raw", 6).alias("anomaly_raw"), F.round("ml_score", 4).alias("ml_score"))


# A forest of two trees: (tree, node, feature or -1, threshold, left, right, size, depth).  Features by
# position: total_tickets, refund_cnt, refund_share, night_share, late_refunds, fake_fio.
_FOREST = [(0, 0, 0, 65.5, 1, 2, -1, 0), (0, 1, 2, 0.2, 3, 4, -1, 1), (0, 2, -1, 0.0, -1, -1, 9, 1), (0, 3, -1, 0.0, -1, -1, 2, 2),
           (0, 4, 4, 3.0, 5, 6, -1, 2), (0, 5, -1, 0.0, -1, -1, 30, 3), (0, 6, -1, 0.0, -1, -1, 1, 3),
           (1, 0, 5, 0.5, 1, 2, -1, 0), (1, 1, 3, 0.25, 3, 4, -1, 1), (1, 2, -1, 0.0, -1, -1, 5, 1),
           (1, 3, -1, 0.0, -1, -1, 64, 2), (1, 4, -1, 0.0, -1, -1, 3, 2)]
_FOREST_PSI = 128


@register("forest_path", "WITH RECURSIVE" + M1()[len("WITH"):].rstrip() + f""",
forest AS (SELECT * FROM (VALUES {", ".join(map(str, _FOREST))}) f(tree, node, feature, threshold, l, r, size, depth)),
x AS (SELECT passenger_id, [{", ".join(f"CAST({c} AS DOUBLE)" for c in K.IFOREST_FEATURES)}] AS v FROM feat),
walk AS (
  SELECT passenger_id, v, tree, 0 AS node FROM x, (SELECT DISTINCT tree FROM forest)
  UNION ALL
  SELECT w.passenger_id, w.v, w.tree, CASE WHEN w.v[f.feature + 1] < f.threshold THEN f.l ELSE f.r END
  FROM walk w JOIN forest f USING (tree, node) WHERE f.feature >= 0
)
SELECT passenger_id, round(pow(2.0::DOUBLE, -avg(f.depth + {_c_sql("f.size")}) / {_c_sql(str(_FOREST_PSI))}), 6) AS anomaly_raw
FROM walk w JOIN forest f USING (tree, node) WHERE f.feature < 0 GROUP BY passenger_id""")
def q_forest_path(spark, sf_dir):
    import pandas as pd

    from farewatch.operators.iforest import NODE_SCHEMA, score_forest
    st = events_state(spark, sf_dir)
    forest = pd.DataFrame([(*node, _FOREST_PSI) for node in _FOREST], columns=NODE_SCHEMA.fieldNames())
    return score_forest(st.features, forest).select("passenger_id", F.round("anomaly_raw", 6).alias("anomaly_raw"))


_MM = """
mm AS (
  SELECT passenger_id, rule_score, total_tickets, refund_share, late_refunds, fake_fio,
    CASE WHEN max(refund_close_ratio) OVER () - min(refund_close_ratio) OVER () > 0
         THEN (refund_close_ratio - min(refund_close_ratio) OVER ()) / (max(refund_close_ratio) OVER () - min(refund_close_ratio) OVER ()) * 100.0::DOUBLE
         ELSE 0.0::DOUBLE END AS ml_score
  FROM sc0
),
fs AS (SELECT *, 0.5::DOUBLE * rule_score + 0.5::DOUBLE * ml_score AS final_score FROM mm)"""


def _mm_scored(spark, sf_dir):
    """Scores with a deterministic stand-in ML column: min-max of refund_close_ratio."""
    st = events_state(spark, sf_dir)
    f = SC.minmax_normalise(st.features, "refund_close_ratio", "ml_score")
    return SC.score_features(f.drop("ml_score"), ml=f.select("passenger_id", "ml_score"), rule_weight=0.5, ml_weight=0.5)


@register("minmax_normalise", M1(_MM) + "SELECT passenger_id, ml_score FROM mm")
def q_minmax(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return SC.minmax_normalise(st.features, "refund_close_ratio", "ml_score").select("passenger_id", "ml_score")


@register("final_score", M1(_MM) + "SELECT passenger_id, final_score FROM fs")
def q_final_score(spark, sf_dir):
    return _mm_scored(spark, sf_dir).select("passenger_id", "final_score")


@register("risk_band", M1(_MM) + f"SELECT passenger_id, {O.band_sql('final_score')} AS risk_band FROM fs")
def q_risk_band(spark, sf_dir):
    return _mm_scored(spark, sf_dir).select("passenger_id", "risk_band")


@register("top_reasons", M1(_MM) + f"SELECT passenger_id, array_to_string({O.reasons_sql()}, '; ') AS reasons FROM fs")
def q_top_reasons(spark, sf_dir):
    return _mm_scored(spark, sf_dir).select("passenger_id", _reasons_text())


@register("score_table", M1() + """
SELECT passenger_id, rule_score, ml_score, final_score, risk_band, array_to_string(top_reasons, '; ') AS reasons,
       seat_blocking_flag, is_manual, scored_at FROM scores""")
def q_score_table(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return st.scores.select("passenger_id", "rule_score", "ml_score", "final_score", "risk_band", _reasons_text(),
                            "seat_blocking_flag", "is_manual", "scored_at")


_OVR = f"""
ovr AS (SELECT id AS passenger_id, 'critical' AS new_band, 'name check' AS reason, 1 AS actor FROM pass
        WHERE starts_with(fio_clean, 'TEST')),
ovr_rows AS (
  SELECT o.passenger_id, coalesce(s.rule_score, 0.0) AS rule_score, coalesce(s.ml_score, 0.0) AS ml_score,
    coalesce(s.final_score, 0.0) AS final_score, o.new_band AS risk_band,
    CASE WHEN list_contains(coalesce(s.top_reasons, []::VARCHAR[]), '{K.MANUAL_REASON_PREFIX}' || o.reason)
         THEN s.top_reasons ELSE list_prepend('{K.MANUAL_REASON_PREFIX}' || o.reason, coalesce(s.top_reasons, []::VARCHAR[])) END
      AS top_reasons,
    coalesce(s.seat_blocking_flag, false) AS seat_blocking_flag, true AS is_manual, {RT} AS scored_at
  FROM ovr o LEFT JOIN scores s USING (passenger_id)
),
merged AS (
  SELECT * FROM ovr_rows
  UNION ALL SELECT * FROM scores WHERE passenger_id NOT IN (SELECT passenger_id FROM ovr_rows)
)"""


@register("manual_override", M1(_OVR) + """
SELECT passenger_id, risk_band, is_manual, array_to_string(top_reasons, '; ') AS reasons, final_score FROM merged""")
def q_manual_override(spark, sf_dir):
    st = events_state(spark, sf_dir)
    ovr = st.passengers.filter(F.col("fio_clean").startswith("TEST")).select(
        F.col("id").alias("passenger_id"), F.lit("critical").alias("new_band"), F.lit("name check").alias("reason"),
        F.lit(1).alias("actor_user_id"))
    merged, _ = UP.apply_override(st.scores, ovr, RUN_TIME)
    return merged.select("passenger_id", "risk_band", "is_manual", _reasons_text(), "final_score")


# ==========================================================================
# W1-W4 top-k and windows
# ==========================================================================

@register("top_dimension", M1(FLAGGED, CONC) + """
SELECT dimension_type, dimension_value, lift_vs_base, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY dimension_type ORDER BY lift_vs_base DESC, dimension_value) AS rank FROM conc
) WHERE rank <= 3""")
def q_top_dimension(spark, sf_dir):
    st = events_state(spark, sf_dir)
    c = RK.risk_concentration(st.flagged(), calculated_at=RUN_TIME)
    return RK.top_dimension(c, 3).select("dimension_type", "dimension_value", "lift_vs_base", "rank")


@register("concentration_list", M1(FLAGGED, CONC) + f"""
SELECT dimension_type, dimension_value, total_ops, highrisk_ops, {O.rnd('share_highrisk_ops', 2)} AS share_highrisk_ops,
       {O.rnd('lift_vs_base', 2)} AS lift_vs_base FROM conc""")
def q_concentration_list(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return RK.concentration_list(RK.risk_concentration(st.flagged(), calculated_at=RUN_TIME))


@register("latest_n", M1() + f"""
SELECT passenger_id, id, op_datetime, CAST(rn AS INTEGER) AS rn FROM (
  SELECT passenger_id, id, op_datetime, row_number() OVER (PARTITION BY passenger_id ORDER BY op_datetime DESC, id) AS rn
  FROM tx WHERE passenger_id IS NOT NULL) WHERE rn <= {K.DOSSIER_TRANSACTIONS}""")
def q_latest_n(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return LK.latest_n(st.transactions, K.DOSSIER_TRANSACTIONS).select("passenger_id", "id", "op_datetime", "rn")


@register("chart_slices", M1(FLAGGED, CONC) + f"""
SELECT slice, CAST(rank AS INTEGER) AS rank, dimension_value, value FROM (
  SELECT 'channel_share_pct' AS slice, rank, dimension_value, {O.rnd('share_highrisk_ops * 100.0::DOUBLE', 1)} AS value
  FROM (SELECT *, row_number() OVER (ORDER BY lift_vs_base DESC, dimension_value) AS rank FROM conc WHERE dimension_type = 'channel')
  WHERE rank <= {K.CHART_TOP_CHANNELS}
  UNION ALL
  SELECT 'terminal_lift_pct', rank, dimension_value, {O.rnd('(lift_vs_base - 1.0::DOUBLE) * 100.0::DOUBLE', 0)}
  FROM (SELECT *, row_number() OVER (ORDER BY lift_vs_base DESC, dimension_value) AS rank FROM conc WHERE dimension_type = 'terminal')
  WHERE rank <= {K.CHART_TOP_TERMINALS})""")
def q_chart_slices(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return RK.chart_slices(RK.risk_concentration(st.flagged(), calculated_at=RUN_TIME))


# ==========================================================================
# L1-L3 ledgers
# ==========================================================================

def _fold_sql(src: str, key: str, transitions: dict) -> str:
    cases = " ".join(f"WHEN prev = '{s}' THEN status IN ({', '.join(repr(d) for d in ds)})" for s, ds in transitions.items())
    return f"""
marked AS (
  SELECT *, lag(status) OVER (PARTITION BY {key} ORDER BY ts, seq) AS prev FROM {src}
),
folded AS (
  SELECT {key}, arg_max(status, (ts, seq)) AS status, count(*) AS n_events,
    CAST(count_if(prev IS NOT NULL AND NOT (CASE {cases} ELSE false END)) AS BIGINT) AS illegal_transitions,
    min(ts) AS first_ts, max(ts) AS last_ts
  FROM marked GROUP BY {key}
)"""


_UPLOAD_EV = """
uev AS (
  SELECT CAST(event_id // 20 AS BIGINT) AS upload_id,
    CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed'
      ELSE 'processing' END AS status, ts, event_id AS seq,
    CASE WHEN event_type = 'error' THEN props END AS error
  FROM events
)"""

_JOB_EV = """
jev AS (
  SELECT 'job-' || CAST(event_id // 20 AS VARCHAR) AS job_id,
    CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed'
      ELSE 'running' END AS status, ts, event_id AS seq,
    CASE WHEN event_type = 'error' THEN props END AS error
  FROM events
)"""


@register("upload_status", "WITH " + _UPLOAD_EV.strip() + "," + _fold_sql("uev", "upload_id", K.UPLOAD_TRANSITIONS).strip()
          + "\nSELECT * FROM folded")
def q_upload_status(spark, sf_dir):
    configure(spark)
    return LG.upload_status(FX.upload_events(spark, sf_dir))


@register("job_status", "WITH " + _JOB_EV.strip() + "," + _fold_sql("jev", "job_id", K.JOB_TRANSITIONS).strip() + """,
extra AS (
  SELECT job_id, arg_max(ts, (ts, seq)) FILTER (WHERE status IN ('done', 'failed')) AS fin,
         arg_max(error, (ts, seq)) FILTER (WHERE status = 'failed') AS error_message
  FROM jev GROUP BY job_id
)
SELECT f.job_id, f.status, f.first_ts AS started_at,
  CASE WHEN f.status IN ('done', 'failed') THEN e.fin END AS finished_at,
  CASE WHEN f.status IN ('done', 'failed') THEN (epoch_us(e.fin) - epoch_us(f.first_ts)) / 1e6::DOUBLE END AS duration_sec,
  e.error_message, f.n_events, f.illegal_transitions
FROM folded f JOIN extra e USING (job_id)""")
def q_job_status(spark, sf_dir):
    configure(spark)
    return LG.job_status(FX.job_events(spark, sf_dir))


@register("audit_summary", """
SELECT upper(event_type) AS action, date_trunc('day', ts) AS day, count(*) AS n, count(DISTINCT user_id) AS users
FROM events GROUP BY 1, 2""")
def q_audit_summary(spark, sf_dir):
    configure(spark)
    return LG.audit_summary(FX.audit_rows(spark, sf_dir))


# ==========================================================================
# S5-S9 upserts
# ==========================================================================

def _split_states(spark, sf_dir):
    """Stored state = uploads 1-2, incoming = uploads 2-3 (upload 2 overlaps)."""
    configure(spark)
    rows = FX.events_typed_rows(spark, sf_dir)
    old = build_state(rows.filter(F.col("upload_id") <= 2))
    new = build_state(rows.filter(F.col("upload_id") >= 2))
    return old, new


def _m1_split_sql(part: str, cond: str, *ctes: str) -> str:
    """The M1 state chain over a subset of uploads, names suffixed with ``part``."""
    import re
    base = O.enriched_cte(f"(SELECT * FROM m1_rows WHERE {cond})") + "," + O.features_cte() + "," + O.scores_cte()
    names = ["en0", "en1", "en", "tx", "pass", "txh", "fagg", "pk", "feat", "sc0", "sc1", "scores"]
    for n in names:
        base = re.sub(rf"\b{n}\b", f"{n}_{part}", base)
    return base.strip()


def _split_sql(*ctes: str) -> str:
    parts = [O.M1_ROWS.strip(), _m1_split_sql("o", "upload_id <= 2"), _m1_split_sql("n", "upload_id >= 2")] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(p.rstrip(",") for p in parts) + "\n"


@register("insert_ignore", _split_sql() + """
SELECT id, upload_id, row_num FROM tx_n WHERE id NOT IN (SELECT id FROM tx_o)""")
def q_insert_ignore(spark, sf_dir):
    old, new = _split_states(spark, sf_dir)
    # Every third incoming row comes twice, the repeat further down the sheet.
    again = new.transactions.filter(F.col("id") % 3 == 0).withColumn("row_num", F.col("row_num") + 1_000_000)
    return UP.insert_ignore(old.transactions, new.transactions.unionByName(again)).select("id", "upload_id", "row_num")


@register("passenger_upsert", _split_sql() + """
SELECT coalesce(o.id, n.id) AS id, coalesce(o.fio_clean, n.fio_clean) AS fio_clean,
  coalesce(o.fake_fio_score, n.fake_fio_score) AS fake_fio_score, coalesce(o.first_seen_at, n.first_seen_at) AS first_seen_at,
  greatest(o.last_seen_at, n.last_seen_at) AS last_seen_at, least(o.min_op_datetime, n.min_op_datetime) AS min_op_datetime
FROM pass_o o FULL OUTER JOIN pass_n n ON o.id = n.id""")
def q_passenger_upsert(spark, sf_dir):
    old, new = _split_states(spark, sf_dir)
    return UP.passenger_upsert(old.passengers, new.passengers)


_FU_COLS = "passenger_id, total_tickets, refund_cnt, refund_share, late_refunds, max_tickets_month, tickets_per_train_peak"


@register("feature_upsert", _split_sql() + f"""
SELECT {_FU_COLS} FROM feat_n
UNION ALL SELECT {_FU_COLS} FROM feat_o WHERE passenger_id NOT IN (SELECT passenger_id FROM feat_n)""")
def q_feature_upsert(spark, sf_dir):
    old, new = _split_states(spark, sf_dir)
    cols = _FU_COLS.split(", ")
    return UP.feature_upsert(old.features.select(*cols), new.features.select(*cols))


_SU_COLS = "passenger_id, rule_score, final_score, risk_band, is_manual"


@register("score_upsert_manual", _split_sql("""
so AS (SELECT * REPLACE (risk_band IN ('medium', 'high') AS is_manual) FROM scores_o)""") + f"""
SELECT {_SU_COLS} FROM so WHERE is_manual
UNION ALL SELECT {_SU_COLS} FROM scores_n WHERE passenger_id NOT IN (SELECT passenger_id FROM so WHERE is_manual)
UNION ALL SELECT {_SU_COLS} FROM so WHERE NOT is_manual AND passenger_id NOT IN (SELECT passenger_id FROM scores_n)""")
def q_score_upsert_manual(spark, sf_dir):
    old, new = _split_states(spark, sf_dir)
    stored = old.scores.withColumn("is_manual", F.col("risk_band").isin("medium", "high"))
    return UP.score_upsert(stored, new.scores).select(*_SU_COLS.split(", "))


def _conc_sql(part: str) -> str:
    import re
    flagged = FLAGGED
    for n in ("flagged", "tx", "scores"):
        flagged = re.sub(rf"\b{n}\b", f"{n}_{part}", flagged)
    conc = CONC
    for n in ("dstats", "base", "conc", "flagged"):
        conc = re.sub(rf"\b{n}\b", f"{n}_{part}", conc)
    return flagged.strip() + ",\n" + conc.strip()


@register("concentration_upsert", _split_sql(_conc_sql("o"), _conc_sql("n")) + f"""
SELECT {_CONC_COLS} FROM conc_n
UNION ALL SELECT {_CONC_COLS} FROM conc_o WHERE id NOT IN (SELECT id FROM conc_n)""")
def q_concentration_upsert(spark, sf_dir):
    old, new = _split_states(spark, sf_dir)
    co = RK.risk_concentration(old.flagged(), calculated_at=RUN_TIME)
    cn = RK.risk_concentration(new.flagged(), calculated_at=RUN_TIME)
    return UP.concentration_upsert(co, cn)


@register("features_incremental", ORACLE["passenger_features"])
def q_features_incremental(spark, sf_dir):
    """The feature table kept by added sums over three loads, the last of which adds to an old upload."""
    from farewatch.plans.incremental import refresh_features
    st, store = events_state(spark, sf_dir), _stream_store(spark)
    store.upsert("passengers", st.passengers, "id", UP.passenger_upsert)
    odd = F.col("row_num") % 2 == 1
    for part in ((F.col("upload_id") == 1) & odd, F.col("upload_id") != 1, (F.col("upload_id") == 1) & ~odd):
        store.append("transactions", st.transactions.where(part), partition_by="upload_id")
        out = refresh_features(store, RUN_TIME)
    return out.select(*_FEAT_COLS.split(", "))


@register("passenger_search_index", ORACLE["passenger_search"])
def q_passenger_search_index(spark, sf_dir):
    """The two searches of ``passenger_search`` through trigram postings filled by two loads."""
    from farewatch.plans.search import refresh_search_index, search
    st, store = _cells_state(spark, sf_dir), _stream_store(spark)
    store.upsert("passengers", st.passengers, "id", UP.passenger_upsert)
    for part in (F.col("upload_id") == 1, F.col("upload_id") != 1):
        store.append("transactions", st.transactions.where(part), partition_by="upload_id")
        refresh_search_index(store)
    return search(store, "test").unionByName(search(store, "77700")).select("id", "fio_clean").distinct()


@register("concentration_incremental", ORACLE["risk_concentration"])
def q_concentration_incremental(spark, sf_dir):
    """Concentrations kept by deltas over two ingests and a scoring that changes bands in between."""
    from farewatch.plans.incremental import refresh_concentration
    st, store = events_state(spark, sf_dir), _stream_store(spark)
    # The first scoring knows no band but low and critical, the second is the real one.
    first = st.scores.withColumn("risk_band", F.when(F.pmod("passenger_id", F.lit(3)) == 0, "critical").otherwise("low"))
    for part, scores in ((F.col("upload_id") == 1, first), (F.col("upload_id") != 1, st.scores)):
        store.append("transactions", st.transactions.where(part), partition_by="upload_id")
        store.upsert("passenger_scores", scores, "passenger_id", lambda old, new: UP.replace_on_key(old, new, ["passenger_id"]))
        out = refresh_concentration(store, calculated_at=RUN_TIME)
    return out


# ==========================================================================
# S10-S12 exports
# ==========================================================================

@register("export_suspicious", M1() + f"""
SELECT t.id, t.op_type, t.op_datetime, t.dep_datetime, t.train_no, t.amount, t.channel, t.route, t.fio,
       upper(s.risk_band) AS risk_band
FROM tx t JOIN scores s USING (passenger_id) WHERE s.risk_band IN ({SUSP})""")
def q_export_suspicious(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return EX.suspicious_export(st.transactions, st.scores)


@register("export_concentration", M1(FLAGGED, CONC) + f"""
SELECT CASE dimension_type WHEN 'channel' THEN 1 WHEN 'aggregator' THEN 2 WHEN 'terminal' THEN 3 ELSE 4 END AS section_order,
  dimension_type, dimension_value, total_ops, highrisk_ops, {O.rnd('share_highrisk_ops', 2)} AS share_highrisk_ops,
  {O.rnd('lift_vs_base', 2)} AS lift_vs_base, {O.rnd('share_highrisk_ops * 100.0::DOUBLE', 2)} AS share_pct
FROM conc""")
def q_export_concentration(spark, sf_dir):
    st = events_state(spark, sf_dir)
    return EX.concentration_export(RK.risk_concentration(st.flagged(), calculated_at=RUN_TIME))


@register("export_dossier", O.with_cells(O.features_cte(), O.scores_cte(), ingest=True) + f""",
last AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY passenger_id ORDER BY op_datetime DESC, id) AS rn FROM tx)
  WHERE rn <= {K.DOSSIER_TRANSACTIONS}
),
agg AS (
  SELECT passenger_id, count(*) AS n_transactions, arg_min(iin, rn) FILTER (WHERE iin IS NOT NULL) AS iin,
         max(op_datetime) AS last_op_datetime, sum(amount) AS last_amount_total,
         string_agg(concat_ws('|', rn, {O.py_dt('op_datetime')}, coalesce(op_type, ''), coalesce(train_no, ''),
                              coalesce(CAST(amount AS VARCHAR), ''), coalesce(route, '')), '; ' ORDER BY rn) AS operations
  FROM last GROUP BY passenger_id
)
SELECT p.id AS passenger_id, p.fio_clean, coalesce(a.iin, '{K.DOSSIER_NO_IIN}') AS iin, upper(s.risk_band) AS risk_band,
  {O.rnd('s.final_score', 2)} AS final_score,
  CASE WHEN s.passenger_id IS NULL THEN NULL WHEN len(s.top_reasons) = 0 THEN '{K.DOSSIER_NO_REASONS}'
       ELSE array_to_string(s.top_reasons, ', ') END AS reasons,
  coalesce(a.n_transactions, 0) AS n_transactions, a.last_op_datetime, a.operations
FROM pass p LEFT JOIN scores s ON s.passenger_id = p.id LEFT JOIN agg a ON a.passenger_id = p.id""")
def q_export_dossier(spark, sf_dir):
    st = _cells_state(spark, sf_dir)
    d = EX.dossiers(st.passengers, st.transactions, st.scores)
    return d.select("passenger_id", "fio_clean", "iin", "risk_band", "final_score", "reasons", "n_transactions",
                    "last_op_datetime", _operations_text())


# ==========================================================================
# Volume fixture (M2) queries -- same operators over lineitem/orders/supplier
# ==========================================================================

@register("volume_risk_concentration", O.with_m2(FLAGGED, CONC) + f"SELECT {_CONC_COLS} FROM conc")
def q_volume_conc(spark, sf_dir):
    from farewatch.plans.pipeline import lineitem_state
    st = lineitem_state(spark, sf_dir)
    return RK.concentration(st.transactions, st.scores, calculated_at=RUN_TIME)


@register("volume_risk_trend", O.with_m2(FLAGGED) + f"""
SELECT date_trunc('day', op_datetime) AS day, count(*) AS total_ops, CAST(count_if(suspicious) AS BIGINT) AS highrisk_ops,
       {O.rnd("count_if(suspicious) * 100.0::DOUBLE / count(*)", 2)} AS share
FROM flagged GROUP BY 1""")
def q_volume_trend(spark, sf_dir):
    from farewatch.plans.pipeline import lineitem_state
    st = lineitem_state(spark, sf_dir)
    return RK.risk_trend(st.transactions, st.scores)


@register("volume_score_table", O.with_m2() + """
SELECT passenger_id, rule_score, final_score, risk_band, array_to_string(top_reasons, '; ') AS reasons, seat_blocking_flag FROM scores""")
def q_volume_scores(spark, sf_dir):
    from farewatch.plans.pipeline import lineitem_state
    st = lineitem_state(spark, sf_dir)
    return st.scores.select("passenger_id", "rule_score", "final_score", "risk_band", _reasons_text(), "seat_blocking_flag")


@register("volume_hotspot_label", O.with_m2(FLAGGED, CONC) + f"""
SELECT dimension_type, dimension_value, {_label_sql('lift_vs_base')} AS risk_label,
       lift_vs_base >= {K.HOTSPOT_LIFT} AS is_hotspot FROM conc""")
def q_volume_hotspots(spark, sf_dir):
    from farewatch.plans.pipeline import lineitem_state
    st = lineitem_state(spark, sf_dir)
    c = RK.concentration(st.transactions, st.scores, calculated_at=RUN_TIME)
    return c.select("dimension_type", "dimension_value", RK.hotspot_label().alias("risk_label"),
                    (F.col("lift_vs_base") >= K.HOTSPOT_LIFT).alias("is_hotspot"))


@register("volume_features", O.with_m2() + """
SELECT passenger_id, total_tickets, refund_cnt, late_refunds, refund_close_ratio, max_tickets_month,
       max_tickets_same_depday, tickets_per_train_peak FROM feat""")
def q_volume_features(spark, sf_dir):
    from farewatch.plans.pipeline import lineitem_state
    st = lineitem_state(spark, sf_dir)
    return st.features.select("passenger_id", "total_tickets", "refund_cnt", "late_refunds", "refund_close_ratio",
                              "max_tickets_month", "max_tickets_same_depday", "tickets_per_train_peak")



# ==========================================================================
# T1-T3 streaming (drained with availableNow; equal to the batch results)
# ==========================================================================

# Files that one micro-batch takes at most where a part of the input is to be one.
STREAM_FILES = 10_000


def _stream_store(spark):
    from farewatch.plans.store import TableStore
    configure(spark)
    return TableStore(spark)


@register("stream_ingest", O.with_cells(ingest=True) + "SELECT id, upload_id, row_num, passenger_id FROM tx")
def q_stream_ingest(spark, sf_dir):
    from farewatch.streaming.ingest import stream_ingest
    store = _stream_store(spark)
    src = store._path("src_cells")
    # Several files, each mixing uploads and rows: header rows may arrive
    # after data rows of the same upload (those wait in the pending table).
    files = max(4, spark.sparkContext.defaultParallelism)
    FX.events_sheet_cells(spark, sf_dir).repartition(files).write.parquet(src)
    tx = stream_ingest(spark, src, store, max_files=files // 2, complete=True)
    return tx.select("id", "upload_id", "row_num", "passenger_id")


@register("stream_outcome", ORACLE["upload_outcome"])
def q_stream_outcome(spark, sf_dir):
    """Outcomes of streamed uploads whose rows arrive in three parts, none of which has whole heads."""
    from farewatch.streaming import ingest as ST
    store = _stream_store(spark)
    src = store._path("src_cells")
    cells = cut_lineage(FX.with_bad_uploads(cut_lineage(FX.events_sheet_cells(spark, sf_dir), "cells")), "cells")
    # A part is as many files as tasks wrote, and drained before the next one comes.
    for rest in (2, 0, 1):
        cells.where(F.col("row_num") % 3 == rest).write.mode("append").parquet(src)
        ST.stream_ingest(spark, src, store, max_files=STREAM_FILES, complete=rest == 1, patience=_dt.timedelta(days=365))
    return store.read("upload_outcomes", ST.OUTCOMES)


def _tx_files(spark, sf_dir, store, name, parts):
    st = events_state(spark, sf_dir)
    tx = st.transactions
    path = store._path(name)
    for cond in parts:  # one write per part: later parts arrive later
        tx.filter(cond).write.mode("append").parquet(path)
    return st, path, tx.schema


@register("stream_dedup", M1() + "SELECT id, upload_id, row_num FROM tx")
def q_stream_dedup(spark, sf_dir):
    from farewatch.streaming.ingest import stream_dedup
    store = _stream_store(spark)
    _, path, schema = _tx_files(spark, sf_dir, store, "src_tx",
                                [F.col("upload_id") <= 2, F.col("upload_id") >= 2])  # upload 2 arrives twice
    return stream_dedup(spark, path, schema, store, max_files=4).select("id", "upload_id", "row_num")


@register("stream_trend", ORACLE["risk_trend"])
def q_stream_trend(spark, sf_dir):
    from farewatch.streaming.ingest import stream_trend
    store = _stream_store(spark)
    st, path, schema = _tx_files(spark, sf_dir, store, "src_tx",
                                 [F.col("upload_id") == u for u in (1, 2, 3)])
    return stream_trend(spark, path, schema, st.scores, store, max_files=2)


# ==========================================================================
# S2 quick check, R8 audit rows
# ==========================================================================

@register("header_quick_check", O.with_cells() + "SELECT upload_id, header_row IS NOT NULL AS valid FROM headers")
def q_header_quick_check(spark, sf_dir):
    configure(spark)
    return UPL.validate_columns(FX.events_sheet_cells(spark, sf_dir))


@register("override_audit", M1(_OVR) + """
SELECT 'override-' || CAST(o.passenger_id AS VARCHAR) || '-' || substr(sha256(CAST(o.passenger_id AS VARCHAR) || '|'
    || strftime(""" + RT + """, '%Y-%m-%d %H:%M:%S.%f') || '|' || o.new_band || '|' || o.reason || '|0'), 1, 16) AS id,
  'PASSENGER_RISK_OVERRIDE' AS action,
  'passenger' AS entity_type, CAST(o.passenger_id AS VARCHAR) AS entity_id,
  CAST(json_object('old_band', coalesce(s.risk_band, 'low'), 'new_band', o.new_band, 'reason', o.reason) AS VARCHAR) AS meta
FROM ovr o LEFT JOIN scores s USING (passenger_id)""")
def q_override_audit(spark, sf_dir):
    st = events_state(spark, sf_dir)
    ovr = st.passengers.filter(F.col("fio_clean").startswith("TEST")).select(
        F.col("id").alias("passenger_id"), F.lit("critical").alias("new_band"), F.lit("name check").alias("reason"),
        F.lit(1).alias("actor_user_id"))
    _, audit = UP.apply_override(st.scores, ovr, RUN_TIME)
    return audit.select("id", "action", "entity_type", "entity_id", "meta")
