"""Cell cleaning and typing (P1-P8) as JVM-side column expressions.

Every function maps Column(s) to a Column; nothing here runs Python per row.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from farewatch import constants as K

# Whitespace removed by trimming: every character of the basic plane that
# Python's str.strip removes.
_WS = "".join(chr(c) for c in range(0x10000) if chr(c).isspace())


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def trim_ws(col) -> Column:
    return F.btrim(_c(col), F.lit(_WS))


def trim_or_null(col) -> Column:
    """Stripped text, empty -> null."""
    return F.nullif(trim_ws(col), F.lit(""))


def _literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def op_type(col) -> Column:
    """Operation type; null input stays null (the caller flags a row error)."""
    c = _c(col)
    looked_up = F.element_at(_literal_map(K.OP_TYPE_WORDS), F.lower(trim_ws(c)))
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(looked_up, F.lit("other")))


# Text shape of each accepted layout (digit counts as strptime accepts them),
# in the same order as DATETIME_PATTERNS_SPARK.
_DT_SHAPES = (
    r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$",
    r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4} [0-9]{1,2}:[0-9]{1,2}$",
    r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$",
    r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$",
)


def parse_datetime(col) -> Column:
    """First matching layout wins; result is a UTC wall-clock TIMESTAMP_NTZ.

    Runs of white space between date and time count as one blank.  The layout
    is chosen by the text's shape, so exactly one parse runs per
    value (a failed parse is costly); an impossible date of the right shape
    (31.02.2024) still yields null.  Null in -> null out; a non-null value
    that fits no layout -> null (the caller turns that into a row error).
    """
    s = F.regexp_replace(trim_ws(_c(col)), f"[{K.WHITESPACE_CLASS}]+", " ")
    expr = None
    for shape, pattern in zip(_DT_SHAPES, K.DATETIME_PATTERNS_SPARK):
        parsed = F.try_to_timestamp(s, F.lit(pattern))
        expr = F.when(s.rlike(shape), parsed) if expr is None else expr.when(s.rlike(shape), parsed)
    return expr.cast("timestamp_ntz")


def datetime_error_from(raw, parsed, name: str, required: bool) -> Column:
    """Error text for P3 given the raw cell and its parsed value, or null."""
    c = _c(raw)
    missing = F.lit(f"{name} is empty") if required else F.lit(None).cast("string")
    return F.when(c.isNull(), missing).when(
        _c(parsed).isNull(), F.concat(F.lit(f"{name}='"), c, F.lit("' is not a date")))


def datetime_error(col, name: str, required: bool) -> Column:
    """Error text for P3, or null."""
    return datetime_error_from(col, parse_datetime(col), name, required)


# A plain decimal number, optional sign and exponent, single underscores between
# digits, or inf/nan spellings.
_DIGITS = "[0-9](?:_?[0-9])*"
_NUMBER_RE = rf"^[+-]?(({_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})([eE][+-]?{_DIGITS})?|(?i:inf|infinity|nan))$"


def _number_text(col) -> Column:
    s = F.regexp_replace(_c(col), "[  ]", "")
    return F.regexp_replace(trim_ws(s), ",", ".")


def parse_amount(col, default: float = 0.0) -> Column:
    """Localised number; null -> default; unparsable -> null (see ``amount_error``)."""
    c = _c(col)
    s = _number_text(c)
    val = F.when(s.rlike(_NUMBER_RE), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(c.isNull(), F.lit(float(default))).otherwise(val)


def amount_error(col, name: str) -> Column:
    c = _c(col)
    s = _number_text(c)
    return F.when(c.isNotNull() & ~F.coalesce(s.rlike(_NUMBER_RE), F.lit(False)),
                  F.concat(F.lit(f"{name}='"), c, F.lit("' is not a number")))


def extract_iin(iin, fio) -> Column:
    """P5: keep the iin cell; else pull 12 digits out of the name text."""
    i, f = trim_or_null(iin), trim_or_null(fio)
    tagged = F.nullif(F.regexp_extract(f, "(?U)" + K.IIN_PATTERN_TAGGED, 1), F.lit(""))
    anywhere = F.nullif(F.regexp_extract(f, "(?U)" + K.IIN_PATTERN_ANY, 1), F.lit(""))
    return F.coalesce(i, F.when(f.isNotNull(), F.coalesce(tagged, anywhere)))


def derive_route(route, dep_station, arr_station) -> Column:
    """P6: 'dep -> arr' when the route cell is empty and both stations exist."""
    r, d, a = trim_or_null(route), trim_or_null(dep_station), trim_or_null(arr_station)
    return F.coalesce(r, F.when(d.isNotNull() & a.isNotNull(), F.concat_ws(" -> ", d, a)))


def source_default(col) -> Column:
    """P7."""
    return F.coalesce(trim_or_null(col), F.lit(K.DEFAULT_SOURCE))
