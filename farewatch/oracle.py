"""Independent DuckDB SQL for the registered queries (the correctness oracle).

The SQL recomputes everything from the driver's raw tables: fixture mapping,
name cleaning, identities, features, scores.  It shares only the fixed values
of ``constants`` with the Spark code.
"""

from __future__ import annotations

from farewatch import constants as K

RUN_TIME_SQL = "TIMESTAMP '2024-02-01 00:00:00'"


# Every character of the basic plane that counts as white space.
_BLANKS = "".join(chr(c) for c in range(0x10000) if chr(c).isspace())


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NOISE_SQL = ", ".join(_q(t) for t in K.NAME_NOISE_TOKENS)
SUSP_SQL = ", ".join(_q(b) for b in K.SUSPICIOUS_BANDS)


def rnd(expr: str, digits: int) -> str:
    """Spark's round on a double: half-up on the shortest decimal text."""
    return f"CAST(round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,20)), {digits}) AS DOUBLE)"


def fold63(expr: str) -> str:
    return f"((('0x' || substr(sha256({expr}), 1, 16))::UBIGINT & 9223372036854775807::UBIGINT)::BIGINT)"


def clean_name(expr: str) -> str:
    return (f"upper(array_to_string(list_filter(string_split_regex(regexp_replace(lower(nfc_normalize(coalesce({expr}, ''))), "
            f"'[^{K.NAME_KEEP_CLASS}\\s]', ' ', 'g'), '\\s+'), lambda x: x NOT IN ({NOISE_SQL})), ' '))")


def fake_score(s: str) -> str:
    low = f"lower({s})"
    junk = " OR ".join(f"contains({low}, {_q(t)})" for t in K.FAKE_NAME_JUNK)
    tok = f"list_filter(string_split_regex({s}, '\\s+'), lambda t: t <> '')"
    letters = f"list_distinct(list_filter(string_split({low}, ''), lambda c: regexp_full_match(c, '\\p{{L}}')))"
    z = "0.0::DOUBLE"
    return (f"CASE WHEN {s} = '' THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, {z}"
            f" + (CASE WHEN {junk} THEN {K.FAKE_JUNK_WEIGHT}::DOUBLE ELSE {z} END)"
            f" + (CASE WHEN len({letters}) <= {K.FAKE_FEW_LETTERS_MAX} THEN {K.FAKE_FEW_LETTERS_WEIGHT}::DOUBLE ELSE {z} END)"
            f" + (CASE WHEN len({tok}) < 2 THEN {K.FAKE_ONE_TOKEN_WEIGHT}::DOUBLE ELSE {z} END)"
            f" + (CASE WHEN len({tok}) > 1 AND len(list_distinct({tok})) = 1 THEN {K.FAKE_REPEATED_TOKEN_WEIGHT}::DOUBLE ELSE {z} END)"
            f" + (CASE WHEN coalesce(list_sum(list_transform({tok}, lambda t: length(t))), 0) < {K.FAKE_SHORT_TOTAL} "
            f"THEN {K.FAKE_SHORT_WEIGHT}::DOUBLE ELSE {z} END)) END")


def py_dt(expr: str, sep: str = " ") -> str:
    return (f"(strftime({expr}, '%Y-%m-%d{sep}%H:%M:%S') || CASE WHEN strftime({expr}, '%f') <> '000000' "
            f"THEN '.' || strftime({expr}, '%f') ELSE '' END)")


def _trim(expr: str) -> str:
    return f"trim({expr}, '{_BLANKS}')"


def identity_key(iin: str, fio: str, doc: str, phone: str) -> str:
    i = f"coalesce({_trim(iin)}, '')"
    n = f"upper(coalesce({_trim(fio)}, ''))"
    d = f"upper(coalesce({_trim(doc)}, ''))"
    p = f"coalesce({_trim(phone)}, '')"
    return (f"CASE WHEN length({i}) >= {K.IIN_MIN_LENGTH} THEN 'iin:' || {i} "
            f"WHEN {n} <> '' AND {d} <> '' THEN 'fio_doc:' || {n} || '|' || {d} "
            f"WHEN {n} <> '' AND {p} <> '' THEN 'fio_ph:' || {n} || '|' || {p} "
            f"WHEN {n} <> '' THEN 'fio:' || {n} END")


M1_ROWS = f"""
m1_ev AS (SELECT e.*, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events e),
m1_rows AS (
  SELECT CAST(1 + (dayofmonth(ts) - 1) // 10 AS BIGINT) AS upload_id, event_id AS row_num,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'sale' WHEN event_type = 'error' THEN 'refund'
         WHEN event_type = 'click' THEN 'redeem' ELSE 'other' END AS op_type,
    ts AS op_datetime, ts + k * INTERVAL 1 HOUR AS dep_datetime, value AS amount, {rnd('value * 0.05::DOUBLE', 2)} AS fee,
    'T' || (k % 13) AS train_no, 'ch' || (k % 5) AS channel,
    CASE WHEN k % 7 = 0 THEN NULL ELSE 'ag' || (k % 3) END AS aggregator,
    't' || (k % 17) AS terminal, 'cd' || (k % 11) AS cashdesk, 'pos' || (k % 4) AS point_of_sale,
    CASE WHEN user_id % 4 = 0 THEN 'test ' || p.p_name ELSE p.p_name END AS fio,
    NULL::VARCHAR AS iin, CAST(user_id AS VARCHAR) AS doc_no, NULL::VARCHAR AS order_no,
    NULL::VARCHAR AS dep_station, NULL::VARCHAR AS arr_station, NULL::VARCHAR AS route, NULL::VARCHAR AS phone,
    '{K.DEFAULT_SOURCE}' AS source
  FROM m1_ev LEFT JOIN part p ON p.p_partkey = m1_ev.user_id
)"""


def enriched_cte(rows: str = "m1_rows") -> str:
    return f"""
en0 AS (SELECT r.*, {clean_name('r.fio')} AS fio0 FROM {rows} r),
en1 AS (SELECT *, {fake_score('fio0')} AS fake_fio_score, {identity_key('iin', 'fio0', 'doc_no', 'phone')} AS identity_key FROM en0),
en AS (
  SELECT *, identity_key IS NULL AS is_anonymous,
    {fold63(_q(K.PASSENGER_ID_NAMESPACE + ':') + " || coalesce(identity_key, 'anonymous:' || upload_id || ':' || row_num || ':' || " + py_dt('op_datetime') + ")")} AS passenger_id,
    CASE WHEN identity_key IS NULL AND fio0 = '' THEN '{K.ANONYMOUS_NAME}' ELSE fio0 END AS fio_clean
  FROM en1
),
tx AS (
  SELECT {fold63("CAST(upload_id AS VARCHAR) || ':' || CAST(row_num AS VARCHAR) || ':' || " + py_dt('op_datetime', 'T') + " || ':' || CAST(amount AS VARCHAR) || ':' || fio_clean")} AS id,
    upload_id, row_num, source, op_type, op_datetime, dep_datetime, train_no, channel, aggregator, terminal,
    cashdesk, point_of_sale, amount, fee, fio, iin, doc_no, order_no, dep_station, arr_station, route, passenger_id
  FROM en
),
pass AS (
  SELECT passenger_id AS id,
    arg_min(fio_clean, (upload_id, row_num)) AS fio_clean,
    arg_min(fake_fio_score, (upload_id, row_num)) AS fake_fio_score,
    arg_min(op_datetime, (upload_id, row_num)) AS first_seen_at,
    max(op_datetime) AS last_seen_at, min(op_datetime) AS min_op_datetime
  FROM en GROUP BY passenger_id
)"""


def features_cte(scope: str = "all") -> str:
    keys = "passenger_id" if scope == "all" else "upload_id, passenger_id"
    return f"""
txh AS (SELECT *, (epoch_us(dep_datetime) - epoch_us(op_datetime)) / 1e6::DOUBLE / 3600.0::DOUBLE AS h FROM tx),
fagg AS (
  SELECT {keys}, count(*) AS total_tickets, CAST(count_if(lower(op_type) = 'refund') AS BIGINT) AS refund_cnt,
    CAST(count_if(hour(op_datetime) BETWEEN {K.NIGHT_HOURS[0]} AND {K.NIGHT_HOURS[1]}) AS BIGINT) AS night_tickets,
    CAST(count_if(op_type = 'refund' AND h < {K.LATE_REFUND_HOURS} AND h >= 0) AS BIGINT) AS late_refunds
  FROM txh WHERE passenger_id IS NOT NULL GROUP BY {keys}
),
pk AS (
  SELECT {keys}, max(CASE WHEN kind = 'm' THEN n END) AS m, max(CASE WHEN kind = 'd' THEN n END) AS d,
         max(CASE WHEN kind = 't' THEN n END) AS t
  FROM (
    SELECT {keys}, kind, b, count(b) AS n FROM (
      SELECT {keys}, 'm' AS kind, strftime(date_trunc('month', op_datetime), '%Y-%m') AS b FROM tx WHERE passenger_id IS NOT NULL
      UNION ALL SELECT {keys}, 'd', CAST(CAST(dep_datetime AS DATE) AS VARCHAR) FROM tx WHERE passenger_id IS NOT NULL
      UNION ALL SELECT {keys}, 't', train_no FROM tx WHERE passenger_id IS NOT NULL
    ) GROUP BY ALL
  ) GROUP BY {keys}
),
feat AS (
  SELECT f.*, p.fake_fio_score AS fake_fio,
    f.refund_cnt / f.total_tickets::DOUBLE AS refund_share,
    f.night_tickets / f.total_tickets::DOUBLE AS night_share,
    f.late_refunds / (f.refund_cnt + {K.CLOSE_RATIO_EPS}) AS refund_close_ratio,
    CAST(coalesce(pk.m, 0) AS INTEGER) AS max_tickets_month,
    CAST(coalesce(pk.d, 0) AS INTEGER) AS max_tickets_same_depday,
    CAST(coalesce(pk.t, 0) AS DOUBLE) AS tickets_per_train_peak
  FROM fagg f JOIN pass p ON p.id = f.passenger_id
  LEFT JOIN pk USING ({keys})
)"""


def rule_score_sql() -> str:
    parts = " + ".join(f"(CASE WHEN {f} > {th} THEN {pts}::DOUBLE ELSE 0.0::DOUBLE END)" for f, th, pts, _ in K.RULES)
    return f"least(0.0::DOUBLE + {parts}, {K.RULE_SCORE_CAP}::DOUBLE)"


def band_sql(score: str) -> str:
    whens = " ".join(f"WHEN {score} > {cut} THEN '{band}'" for cut, band in K.BAND_CUTS)
    return f"CASE {whens} ELSE '{K.BAND_DEFAULT}' END"


def reasons_sql() -> str:
    items = ", ".join(f"CASE WHEN {f} > {th} THEN {_q(t)} END" for f, th, _, t in K.RULES if t)
    items += f", CASE WHEN ml_score > {K.ML_REASON_THRESHOLD} THEN {_q(K.ML_REASON)} END"
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def scores_cte(scope: str = "all") -> str:
    keys = "passenger_id" if scope == "all" else "upload_id, passenger_id"
    return f"""
sc0 AS (SELECT *, {rule_score_sql()} AS rule_score, 0.0::DOUBLE AS ml_score FROM feat),
sc1 AS (SELECT *, 1.0::DOUBLE * rule_score + 0.0::DOUBLE * ml_score AS final_score FROM sc0),
scores AS (
  SELECT {keys}, rule_score, ml_score, final_score, {band_sql('final_score')} AS risk_band,
    {reasons_sql()} AS top_reasons, refund_close_ratio > {K.SEAT_CLOSE_RATIO_MIN} AS seat_blocking_flag,
    false AS is_manual, {RUN_TIME_SQL} AS scored_at
  FROM sc1
)"""


def with_m1(*ctes: str, scope: str = "all") -> str:
    """WITH clause: M1 rows -> tx/pass -> feat -> scores (+ extra CTEs)."""
    parts = [M1_ROWS, enriched_cte("m1_rows"), features_cte(scope), scores_cte(scope)]
    parts += list(ctes)
    return "WITH " + ",".join(p.strip().rstrip(",") for p in parts) + "\n"


FLAGGED = f"""
flagged AS (
  SELECT tx.*, s.risk_band, coalesce(s.risk_band IN ({SUSP_SQL}), false) AS suspicious
  FROM tx LEFT JOIN scores s USING (passenger_id)
)"""


def dims_unpivot(dims=K.DIMENSIONS, src: str = "flagged") -> str:
    return " UNION ALL ".join(
        f"SELECT '{d}' AS dimension_type, CAST({d} AS VARCHAR) AS dimension_value, suspicious FROM {src} WHERE {d} IS NOT NULL"
        for d in dims)


CONC = f"""
dstats AS (
  SELECT dimension_type, dimension_value, count(*) AS total_ops, CAST(count_if(suspicious) AS BIGINT) AS highrisk_ops
  FROM ({dims_unpivot()}) GROUP BY 1, 2
),
base AS (SELECT count_if(suspicious) / count(*) AS b FROM flagged),
conc AS (
  SELECT {fold63("dimension_type || ':' || dimension_value")} AS id, dimension_type, dimension_value, total_ops, highrisk_ops,
    CASE WHEN total_ops > 0 THEN highrisk_ops / total_ops::DOUBLE ELSE 0.0 END AS share_highrisk_ops,
    CASE WHEN (SELECT coalesce(b, 0.0) FROM base) > 0
         THEN (CASE WHEN total_ops > 0 THEN highrisk_ops / total_ops::DOUBLE ELSE 0.0 END) / (SELECT b FROM base)
         ELSE 1.0 END AS lift_vs_base,
    {RUN_TIME_SQL} AS calculated_at
  FROM dstats
)"""


# ---------------------------------------------------------------------------
# M1s: sheet cells and the source path.
# ---------------------------------------------------------------------------

def _sql_list(items) -> str:
    return "[" + ", ".join("NULL" if x is None else _q(x) for x in items) + "]::VARCHAR[]"


def m1s_cells() -> str:
    from farewatch.sources import fixtures as FX

    frame = []
    for up, hdr_row in FX.SHEET_HEADER_ROW.items():
        for r in range(1, hdr_row):
            frame.append((up, r, [FX.SHEET_TITLE] if r == 1 else [None]))
        frame.append((up, hdr_row, FX.SHEET_HEADERS[up]))
    values = ", ".join(f"({u}, {r}, {_sql_list(c)})" for u, r, c in frame)
    name = "(CASE WHEN user_id % 4 = 0 THEN 'test ' || p.p_name ELSE p.p_name END)"
    name = (f"(CASE WHEN user_id % 10 = 3 THEN replace({name}, 'e', 'e' || chr(769)) "
            f"WHEN user_id % 10 = 7 THEN {name} || ' Андреи' || chr(774) ELSE {name} END)")
    return f"""
m1s_data AS (
  SELECT CAST(1 + (dayofmonth(ts) - 1) // 10 AS BIGINT) AS upload_id, event_id + {FX.SHEET_ROW_OFFSET} AS row_num,
    [CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_type = 'purchase' THEN 'Продажа'
          WHEN event_type = 'signup' THEN chr(8195) || 'покупка' || chr(12288) WHEN event_type = 'error' THEN 'ВОЗВРАТ'
          WHEN event_type = 'click' THEN 'гашение' ELSE event_type END,
     CASE WHEN event_id % 89 = 0 THEN '31.02.2024' WHEN event_id % 4 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
          WHEN event_id % 4 = 1 AND event_id % 5 = 0 THEN strftime(ts, '%d.%m.%Y  %H:%M')
          WHEN event_id % 4 = 1 THEN strftime(ts, '%d.%m.%Y %H:%M') WHEN event_id % 4 = 2 THEN strftime(ts, '%d.%m.%Y')
          ELSE strftime(ts, '%Y-%m-%d') END,
     CASE WHEN k % 10 = 0 THEN NULL ELSE strftime(ts + k * INTERVAL 1 HOUR, '%d.%m.%Y %H:%M') END,
     'T' || (k % 13), 'ch' || (k % 5), CASE WHEN k % 7 = 0 THEN NULL ELSE 'ag' || (k % 3) END,
     't' || (k % 17), 'cd' || (k % 11), 'pos' || (k % 4),
     CASE WHEN event_id % 101 = 0 THEN 'n/a' WHEN event_id % 103 = 0 THEN '1_000' WHEN event_id % 3 = 0 THEN CAST(value AS VARCHAR)
          WHEN event_id % 3 = 1 THEN replace(CAST(value AS VARCHAR), '.', ',') ELSE chr(8195) || CAST(value AS VARCHAR) END,
     CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 50 AS VARCHAR) || '.5' END,
     CASE WHEN user_id % 5 = 0 THEN {name} || ' ' || lpad(CAST(user_id AS VARCHAR), 12, '7') ELSE {name} END,
     NULL, CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 THEN CAST(user_id AS VARCHAR) END, 'ord' || event_id,
     'st' || (k % 6), 'st' || ((k + 1) % 6), CASE WHEN event_id % 6 = 0 THEN 'line ' || (k % 4) END,
     CASE WHEN event_id % 7 = 0 THEN '+7701' || lpad(CAST(user_id AS VARCHAR), 7, '0') END,
     CASE WHEN event_id % 9 = 0 THEN 'partner' END
    ]::VARCHAR[] AS cells
  FROM m1_ev LEFT JOIN part p ON p.p_partkey = m1_ev.user_id
),
m1s_frame AS (
  SELECT * FROM (VALUES {values}) f(upload_id, row_num, cells)
  WHERE upload_id IN (SELECT DISTINCT upload_id FROM m1s_data)
),
cells AS (
  SELECT upload_id, row_num, cells FROM m1s_data
  UNION ALL SELECT CAST(upload_id AS BIGINT), CAST(row_num AS BIGINT), cells FROM m1s_frame
)"""


def _alias_values() -> str:
    return ", ".join(f"({_q(h)}, {_q(c)})" for h, c in K.HEADER_ALIASES.items())


SHEET_PATH = f"""
srows AS (SELECT * FROM cells WHERE len(list_filter(cells, lambda c: c IS NOT NULL)) > 0),
aliases AS (SELECT * FROM (VALUES {_alias_values()}) a(h, canonical)),
cand0 AS (
  SELECT upload_id, row_num, lower({_trim("coalesce(h, '')")}) AS norm, idx FROM (
    SELECT upload_id, row_num, unnest(cells) AS h, generate_subscripts(cells, 1) - 1 AS idx
    FROM srows WHERE row_num <= {K.HEADER_SEARCH_ROWS})
),
cand AS (
  SELECT upload_id, row_num, coalesce(a.canonical, norm) AS canonical, min(idx) AS idx
  FROM cand0 LEFT JOIN aliases a ON a.h = cand0.norm GROUP BY ALL
),
per_row AS (SELECT upload_id, row_num, list(DISTINCT canonical) AS names FROM cand GROUP BY ALL),
hdr_ok AS (
  SELECT upload_id, min(row_num) AS header_row FROM per_row
  WHERE len(list_intersect(names, {_sql_list(K.REQUIRED_COLUMNS)})) = {len(K.REQUIRED_COLUMNS)} GROUP BY upload_id
),
first_row AS (SELECT upload_id, arg_min(names, row_num) AS first_names FROM per_row GROUP BY upload_id),
headers AS (
  SELECT u.upload_id, h.header_row,
    CASE WHEN h.header_row IS NULL THEN 'missing required columns: ' || array_to_string(list_sort(
      list_filter({_sql_list(K.REQUIRED_COLUMNS)}, lambda r: NOT list_contains(coalesce(f.first_names, []::VARCHAR[]), r))), ', ') END
      AS header_error
  FROM (SELECT DISTINCT upload_id FROM srows) u LEFT JOIN hdr_ok h USING (upload_id) LEFT JOIN first_row f USING (upload_id)
),
colmap AS (
  SELECT c.upload_id, c.canonical, c.idx FROM cand c JOIN headers h
    ON c.upload_id = h.upload_id AND c.row_num = h.header_row
),
idxs AS (
  SELECT upload_id, {", ".join(f"max(CASE WHEN canonical = '{c}' THEN idx END) AS i_{c}" for c in K.SHEET_COLUMNS)}
  FROM colmap GROUP BY upload_id
),
wide AS (
  SELECT r.upload_id, r.row_num, {", ".join(f"r.cells[i.i_{c} + 1] AS {c}" for c in K.SHEET_COLUMNS)}
  FROM srows r JOIN headers h USING (upload_id) JOIN idxs i USING (upload_id)
  WHERE h.header_row IS NOT NULL AND r.row_num > h.header_row
)"""


NUMBER_RE = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"


def _num_text(c: str) -> str:
    plain = f"replace({_trim(f'replace(replace({c}, chr(160), ), chr(32), )')}, ',', '.')".replace(", )", ", '')")
    return f"regexp_replace({plain}, '([0-9])_([0-9])', '\\1\\2', 'g')"


def _num(c: str) -> str:
    t = _num_text(c)
    return f"(CASE WHEN {c} IS NULL THEN 0.0::DOUBLE WHEN regexp_matches({t}, '{NUMBER_RE}') THEN TRY_CAST({t} AS DOUBLE) END)"


def _num_err(c: str, name: str) -> str:
    t = _num_text(c)
    return f"(CASE WHEN {c} IS NOT NULL AND NOT coalesce(regexp_matches({t}, '{NUMBER_RE}'), false) THEN '{name}=''' || {c} || ''' is not a number' END)"


def _dt(c: str) -> str:
    s = f"regexp_replace({_trim(c)}, '\\s+', ' ', 'g')"
    fmts = ["%Y-%m-%d %H:%M:%S", "%d.%m.%Y %H:%M", "%d.%m.%Y", "%Y-%m-%d"]
    return "coalesce(" + ", ".join(f"try_strptime({s}, '{f}')" for f in fmts) + ")"


def _dt_err(c: str, name: str, required: bool) -> str:
    missing = f"'{name} is empty'" if required else "NULL"
    return f"(CASE WHEN {c} IS NULL THEN {missing} WHEN {_dt(c)} IS NULL THEN '{name}=''' || {c} || ''' is not a date' END)"


def _ton(c: str) -> str:
    return f"nullif({_trim(c)}, '')"


def _op(c: str) -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in K.OP_TYPE_WORDS.items())
    return f"(CASE WHEN {c} IS NULL THEN NULL ELSE (CASE lower({_trim(c)}) {whens} ELSE 'other' END) END)"


TYPED = f"""
typed AS (
  SELECT upload_id, row_num, {_op('op_type')} AS op_type, {_dt('op_datetime')} AS op_datetime,
    {_dt('dep_datetime')} AS dep_datetime, {_num('amount')} AS amount, {_num('fee')} AS fee,
    {", ".join(f"{_ton(c)} AS {c}" for c in ("train_no", "channel", "aggregator", "terminal", "cashdesk", "point_of_sale", "fio"))},
    coalesce({_ton('iin')}, CASE WHEN {_ton('fio')} IS NOT NULL THEN coalesce(
      nullif(regexp_extract({_ton('fio')}, '{K.IIN_PATTERN_TAGGED}', 1), ''),
      nullif(regexp_extract({_ton('fio')}, '{K.IIN_PATTERN_ANY}', 1), '')) END) AS iin,
    {", ".join(f"{_ton(c)} AS {c}" for c in ("doc_no", "order_no", "dep_station", "arr_station"))},
    coalesce({_ton('route')}, CASE WHEN {_ton('dep_station')} IS NOT NULL AND {_ton('arr_station')} IS NOT NULL
      THEN {_ton('dep_station')} || ' -> ' || {_ton('arr_station')} END) AS route,
    {_ton('phone')} AS phone, coalesce({_ton('source')}, '{K.DEFAULT_SOURCE}') AS source,
    CASE WHEN err IS NOT NULL THEN 'row ' || row_num || ': ' || err END AS error
  FROM (SELECT *, coalesce(CASE WHEN op_type IS NULL THEN 'op_type is empty' END,
      {_dt_err('op_datetime', 'op_datetime', True)}, {_dt_err('dep_datetime', 'dep_datetime', False)},
      {_num_err('amount', 'amount')}, {_num_err('fee', 'fee')}) AS err FROM wide)
),
good AS (SELECT * EXCLUDE (error) FROM typed WHERE error IS NULL)"""


def with_cells(*ctes: str, ingest: bool = False) -> str:
    parts = [M1_ROWS.split("m1_rows AS")[0].strip().rstrip(","), m1s_cells(), SHEET_PATH, TYPED]
    if ingest:
        parts.append(enriched_cte("good"))
    parts += list(ctes)
    return "WITH " + ",".join(p.strip().rstrip(",") for p in parts) + "\n"


# ---------------------------------------------------------------------------
# M2: lineitem x orders x supplier (volume fixture).
# ---------------------------------------------------------------------------

M2_ROWS = f"""
m2_li AS (
  SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber,
      l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn
  FROM lineitem l
),
m2_rows AS (
  SELECT CAST(year(o.o_orderdate) AS BIGINT) AS upload_id, l.l_orderkey * 100 + l.rn AS row_num,
    CASE WHEN c8 <= 1 AND l.l_partkey % 4 <> 0 THEN 'refund' WHEN l.l_returnflag = 'R' THEN 'refund'
         WHEN l.l_returnflag = 'A' THEN 'redeem' ELSE 'sale' END AS op_type,
    o.op_day + CAST(CASE WHEN c8 = 0 THEN l.l_partkey % 8 ELSE l.l_partkey % 24 END AS INTEGER) * INTERVAL 1 HOUR AS op_datetime,
    CASE WHEN c8 <= 1 THEN o.op_day + CAST(CASE WHEN c8 = 0 THEN l.l_partkey % 8 ELSE l.l_partkey % 24 END + l.l_partkey % 40 AS INTEGER)
         * INTERVAL 1 HOUR ELSE l.l_shipdate END AS dep_datetime,
    l.l_extendedprice AS amount, {rnd('l.l_extendedprice * l.l_tax', 2)} AS fee,
    'T' || (l.l_partkey % 50) AS train_no,
    CASE WHEN c8 <= 1 AND l.l_partkey % 5 = 0 THEN 'hot' WHEN c8 <= 2 AND l.l_partkey % 5 = 1 THEN 'warm'
         WHEN c8 <= 4 AND l.l_partkey % 5 = 2 THEN 'mild' ELSE o.o_orderpriority END AS channel, 'n' || s.s_nationkey AS aggregator,
    't' || (l.l_partkey % 97) AS terminal, s.s_name AS cashdesk, NULL::VARCHAR AS point_of_sale,
    CASE WHEN c8 IN (0, 2) THEN 'test ' ELSE '' END || 'Customer#' || lpad(CAST(o.o_custkey AS VARCHAR), 9, '0') AS fio,
    lpad(CAST(o.o_custkey AS VARCHAR), 12, '0') AS iin, NULL::VARCHAR AS doc_no, CAST(l.l_orderkey AS VARCHAR) AS order_no,
    NULL::VARCHAR AS dep_station, NULL::VARCHAR AS arr_station, NULL::VARCHAR AS route, NULL::VARCHAR AS phone,
    '{K.DEFAULT_SOURCE}' AS source
  FROM m2_li l JOIN (SELECT *, o_custkey % 8 AS c8, o_orderdate AS op_day FROM orders) o ON l.l_orderkey = o.o_orderkey LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
)"""


def with_m2(*ctes: str, scope: str = "all") -> str:
    parts = [M2_ROWS, enriched_cte("m2_rows"), features_cte(scope), scores_cte(scope)] + list(ctes)
    return "WITH " + ",".join(p.strip().rstrip(",") for p in parts) + "\n"
