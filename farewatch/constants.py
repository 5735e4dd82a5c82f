"""Fixed values.

Everything in this module is a value that must equal the behaviour being
reproduced (header aliases, operation words, name noise tokens, rule
thresholds, reason texts, hashing namespace).  They are stated plainly, in
their natural order, and every other module reads them from here.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: sheet header aliases (lower-cased, trimmed header -> canonical
# column).  Listed in their original order; where a header appears twice the
# later entry wins ("пункт продажи" and "pos" end up as cashdesk).
# ---------------------------------------------------------------------------
HEADER_ALIAS_PAIRS: list[tuple[str, str]] = [
    ("тип", "op_type"),
    ("тип операции", "op_type"),
    ("op_type", "op_type"),
    ("type", "op_type"),
    ("операция", "op_type"),
    ("дата", "op_datetime"),
    ("дата операции", "op_datetime"),
    ("op_datetime", "op_datetime"),
    ("datetime", "op_datetime"),
    ("дата транзакции", "op_datetime"),
    ("дата отправления", "dep_datetime"),
    ("дата/время отправки", "dep_datetime"),
    ("дата/время отправления", "dep_datetime"),
    ("dep_datetime", "dep_datetime"),
    ("departure", "dep_datetime"),
    ("поезд", "train_no"),
    ("train_no", "train_no"),
    ("номер поезда", "train_no"),
    ("канал", "channel"),
    ("channel", "channel"),
    ("канал продажи", "channel"),
    ("канал продаж", "channel"),
    ("агрегатор", "aggregator"),
    ("aggregator", "aggregator"),
    ("терминал", "terminal"),
    ("terminal", "terminal"),
    ("касса", "cashdesk"),
    ("cashdesk", "cashdesk"),
    ("кассовый узел", "cashdesk"),
    ("точка продажи", "point_of_sale"),
    ("пункт продажи", "point_of_sale"),
    ("pos", "point_of_sale"),
    ("point_of_sale", "point_of_sale"),
    ("сумма", "amount"),
    ("цена", "amount"),
    ("amount", "amount"),
    ("стоимость", "amount"),
    ("комиссия", "fee"),
    ("fee", "fee"),
    ("сбор", "fee"),
    ("разные сборы", "fee"),
    ("фио", "fio"),
    ("fio", "fio"),
    ("пассажир", "fio"),
    ("ф.и.о.", "fio"),
    ("ф.и.о. пассажира", "fio"),
    ("данные пассажира", "fio"),
    ("иин", "iin"),
    ("iin", "iin"),
    ("инн", "iin"),
    ("номер телефона, иин", "iin"),
    ("номер тел, иин", "iin"),
    ("документ", "doc_no"),
    ("doc_no", "doc_no"),
    ("номер документа", "doc_no"),
    ("серия и номер", "doc_no"),
    ("№ документа", "doc_no"),
    ("номер билета", "doc_no"),
    ("номер заказа", "order_no"),
    ("order_no", "order_no"),
    ("станция отправления", "dep_station"),
    ("станция отправ", "dep_station"),
    ("станция назначения", "arr_station"),
    ("станция назна", "arr_station"),
    ("маршрут", "route"),
    ("касса", "cashdesk"),
    ("cashdesk", "cashdesk"),
    ("кассовый узел", "cashdesk"),
    ("пункт продажи", "cashdesk"),
    ("pos", "cashdesk"),
    ("телефон", "phone"),
    ("номер телефона", "phone"),
    ("контакт", "phone"),
    ("phone", "phone"),
    ("источник", "source"),
    ("source", "source"),
]
# Effective mapping: later duplicates override earlier ones.
HEADER_ALIASES: dict[str, str] = dict(HEADER_ALIAS_PAIRS)

# FIXED VALUES: columns that must be present for a header row to be accepted,
# and how many leading rows are searched for it.
REQUIRED_COLUMNS: tuple[str, ...] = ("op_type", "op_datetime", "amount")
HEADER_SEARCH_ROWS = 20

# FIXED VALUES: canonical sheet columns in record order.
SHEET_COLUMNS: tuple[str, ...] = (
    "op_type", "op_datetime", "amount", "fee", "dep_datetime", "train_no",
    "channel", "aggregator", "terminal", "cashdesk", "point_of_sale", "fio",
    "iin", "doc_no", "order_no", "dep_station", "arr_station", "route",
    "phone", "source",
)
DEFAULT_SOURCE = "excel_upload"

# FIXED VALUES: operation type words (lower-cased, trimmed) -> operation type.
# Anything else, blank included, is "other"; a missing cell is a row error.
OP_TYPE_WORDS: dict[str, str] = {
    "sale": "sale",
    "продажа": "sale",
    "покупка": "sale",
    "оформление": "sale",
    "продажа-прин": "sale",
    "подтверждение оплаты": "sale",
    "оплата": "sale",
    "refund": "refund",
    "возврат": "refund",
    "redeem": "redeem",
    "гашение": "redeem",
}
OP_TYPES: tuple[str, ...] = ("sale", "refund", "redeem", "other")

# FIXED VALUES: accepted date-time layouts, tried in this order
# (strptime notation: %Y-%m-%d %H:%M:%S, %d.%m.%Y %H:%M, %d.%m.%Y, %Y-%m-%d).
DATETIME_PATTERNS_SPARK: tuple[str, ...] = (
    "yyyy-M-d H:m:s",
    "d.M.yyyy H:m",
    "d.M.yyyy",
    "yyyy-M-d",
)

# FIXED VALUES: national id patterns, tried in order (12 digits after "ИИ",
# "##" or whitespace and followed by whitespace or end; else any 12 digits).
IIN_PATTERN_TAGGED = r"(?:ИИ|##|\s)(\d{12})(?:\s|$)"
IIN_PATTERN_ANY = r"(\d{12})"
IIN_MIN_LENGTH = 10

# FIXED VALUES: name cleaning.  Letters kept: Russian Cyrillic, the Kazakh
# letters, Latin; everything else becomes a space.  Noise tokens are dropped.
NAME_KEEP_CLASS = "а-яёәғқңөұүіһa-z"
# Characters Python treats as whitespace (str.isspace), as a regex class body.
WHITESPACE_CLASS = "\\t\\n\\x0b\\f\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NAME_NOISE_TOKENS: tuple[str, ...] = (
    "г", "гр", "господин", "госпожа", "mr", "mrs", "ms", "dr", "none", "null", "-", "",
)

# FIXED VALUES: Cyrillic/Kazakh -> Latin transliteration, in original order.
TRANSLIT_PAIRS: list[tuple[str, str]] = [
    ("а", "a"), ("б", "b"), ("в", "v"), ("г", "g"), ("д", "d"),
    ("е", "e"), ("ё", "e"), ("ж", "zh"), ("з", "z"), ("и", "i"),
    ("й", "y"), ("к", "k"), ("л", "l"), ("м", "m"), ("н", "n"),
    ("о", "o"), ("п", "p"), ("р", "r"), ("с", "s"), ("т", "t"),
    ("у", "u"), ("ф", "f"), ("х", "kh"), ("ц", "ts"), ("ч", "ch"),
    ("ш", "sh"), ("щ", "sch"), ("ъ", ""), ("ы", "y"), ("ь", ""),
    ("э", "e"), ("ю", "yu"), ("я", "ya"),
    ("ә", "ae"), ("ғ", "gh"), ("қ", "q"), ("ң", "ng"), ("ө", "oe"),
    ("ұ", "u"), ("ү", "ue"), ("і", "i"), ("һ", "h"),
]

# FIXED VALUES: fake-name heuristic.
FAKE_NAME_JUNK: tuple[str, ...] = ("aaa", "иии", "test", "qwerty", "test01", "тест")
FAKE_JUNK_WEIGHT = 0.8
FAKE_FEW_LETTERS_MAX = 3          # <= 3 distinct letters
FAKE_FEW_LETTERS_WEIGHT = 0.7
FAKE_ONE_TOKEN_WEIGHT = 0.4       # fewer than 2 tokens
FAKE_REPEATED_TOKEN_WEIGHT = 0.8  # more than one token, all equal
FAKE_SHORT_TOTAL = 5              # letters in all tokens < 5
FAKE_SHORT_WEIGHT = 0.5

# FIXED VALUES: deterministic 63-bit ids.
PASSENGER_ID_NAMESPACE = "passenger_v1"  # the default; callers may pass their own
ANONYMOUS_NAME = "SYSTEM_ANONYMOUS"

# FIXED VALUES: scoring features, thresholds and weights.
NIGHT_HOURS = (0, 5)                 # scoring definition: hour 0..5
ENTITY_NIGHT_FROM, ENTITY_NIGHT_TO = 23, 6   # entity definition: >= 23 or < 6
LATE_REFUND_HOURS = 24.0             # refund with 0 <= hours < 24
LAST_MINUTE_HOURS = 1.0              # refund with 0 <= hours <= 1
CLOSE_RATIO_EPS = 1e-9

# (feature, threshold, points, reason text or None) -- rule adds points when
# feature > threshold.  The night rule has no reason text.
RULES: list[tuple[str, float, float, str | None]] = [
    ("total_tickets", 20, 20.0, "High ticket count"),
    ("refund_share", 0.5, 25.0, "High refund share"),
    ("late_refunds", 5, 30.0, "Multiple late refunds"),
    ("fake_fio", 0.5, 25.0, "Suspicious name pattern"),
    ("night_share", 0.5, 10.0, None),
]
RULE_SCORE_CAP = 100.0
ML_REASON_THRESHOLD = 80.0
ML_REASON = "ML anomaly detected"
RULE_WEIGHT = 0.5
ML_WEIGHT = 0.5

# Risk bands: score > 75 critical, > 50 high, > 30 medium, else low.
BAND_CUTS: list[tuple[float, str]] = [(75.0, "critical"), (50.0, "high"), (30.0, "medium")]
BAND_DEFAULT = "low"
SUSPICIOUS_BANDS: tuple[str, ...] = ("high", "critical")

# Isolation forest.
IFOREST_FEATURES: tuple[str, ...] = (
    "total_tickets", "refund_cnt", "refund_share", "night_share", "late_refunds", "fake_fio",
)
IFOREST_TREES = 300
IFOREST_SEED = 42
IFOREST_SAMPLE = 256
IFOREST_CONTAMINATION = 0.03   # shifts the decision function only; removed by min-max

# Seat blocking.
SEAT_SAME_DEPDAY_MIN = 3
SEAT_CLOSE_RATIO_MIN = 0.6     # feature flag uses >=, score flag uses >

# Derived predicates.
REFUND_RATE_HIGH = 0.5
LIKELY_FAKE_IDENTITY = 0.7
HOTSPOT_LIFT = 2.0
# Hotspot labels: lift >= 3 critical_hotspot, >= 2 hotspot, >= 1.5 elevated.
HOTSPOT_LABELS: list[tuple[float, str]] = [(3.0, "critical_hotspot"), (2.0, "hotspot"), (1.5, "elevated")]
HOTSPOT_DEFAULT = "normal"

# Concentration dimensions (the fifth one is optional).
DIMENSIONS: tuple[str, ...] = ("channel", "aggregator", "terminal", "cashdesk")
ALL_DIMENSIONS: tuple[str, ...] = DIMENSIONS + ("point_of_sale",)

# Reports and paging.
DOSSIER_TRANSACTIONS = 20
DOSSIER_NO_REASONS = "Нет явных причин"
DOSSIER_NO_IIN = "Н/Д"
MANUAL_REASON_PREFIX = "MANUAL OVERRIDE: "
AUDIT_PAGE_MAX = 1000
CHART_TOP_CHANNELS = 4
CHART_TOP_TERMINALS = 5

# Ledgers: allowed status transitions (from -> to).
UPLOAD_TRANSITIONS: dict[str, tuple[str, ...]] = {
    "pending": ("processing", "done", "failed"),
    "processing": ("done", "failed"),
    "done": ("failed",),
    "failed": ("failed",),
}
JOB_TRANSITIONS: dict[str, tuple[str, ...]] = {
    "pending": ("running", "done", "failed"),
    "running": ("running", "done", "failed"),
    "done": ("running", "done", "failed"),
    "failed": ("running", "done", "failed"),
}
