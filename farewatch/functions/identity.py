"""Deterministic identities (P12-P15): identity key, 63-bit SHA-256 fold, ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from farewatch import constants as K
from farewatch.functions.text import _c, trim_ws

_MASK63 = 0x7FFF_FFFF_FFFF_FFFF


def fold63(text) -> Column:
    """First 8 bytes of SHA-256(text), big-endian, top bit cleared -> BIGINT.

    ``conv(.., 16, -10)`` reads the 16 hex digits as a signed 64-bit value; the
    mask clears the sign bit, which equals the unsigned value mod 2^63.
    """
    hex16 = F.substring(F.sha2(_c(text), 256), 1, 16)
    return F.conv(hex16, 16, -10).cast("bigint").bitwiseAND(F.lit(_MASK63))


def identity_key(iin, fio_clean, doc_no, phone, iin_min_length: int = K.IIN_MIN_LENGTH) -> Column:
    """Iin -> 'iin:', name+doc -> 'fio_doc:', name+phone -> 'fio_ph:', name -> 'fio:'; else null."""
    i = F.coalesce(trim_ws(_c(iin)), F.lit(""))
    n = F.upper(F.coalesce(trim_ws(_c(fio_clean)), F.lit("")))
    d = F.upper(F.coalesce(trim_ws(_c(doc_no)), F.lit("")))
    p = F.coalesce(trim_ws(_c(phone)), F.lit(""))
    return (
        F.when(F.length(i) >= iin_min_length, F.concat(F.lit("iin:"), i))
        .when((n != "") & (d != ""), F.concat(F.lit("fio_doc:"), n, F.lit("|"), d))
        .when((n != "") & (p != ""), F.concat(F.lit("fio_ph:"), n, F.lit("|"), p))
        .when(n != "", F.concat(F.lit("fio:"), n))
    )


def passenger_id_from_key(key, namespace: str = K.PASSENGER_ID_NAMESPACE) -> Column:
    """Namespaced 63-bit id of an identity key."""
    return fold63(F.concat(F.lit(namespace + ":"), _c(key)))


def py_datetime_str(ts, sep: str = " ") -> Column:
    """Text of a naive datetime as Python prints it (fraction only when non-zero)."""
    t = _c(ts)
    base = F.date_format(t, f"yyyy-MM-dd'{sep}'HH:mm:ss")
    frac = F.date_format(t, "SSSSSS")
    return F.concat(base, F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")))


def py_float_str(x) -> Column:
    """Python ``repr`` of a double for values written in plain notation.

    Below 1e7 Spark's own text equals Python's; from 1e7 up Spark switches to
    exponent notation, so those are printed through an exact decimal and
    trimmed to Python's shortest form.
    """
    v = _c(x)
    plain = v.cast("string")
    dec = v.cast("decimal(38,6)").cast("string")
    dec = F.regexp_replace(F.regexp_replace(dec, "0+$", ""), r"\.$", ".0")
    return F.when(F.abs(v) < 1e7, plain).otherwise(dec)


def anonymous_key(row_num, op_datetime, upload_id=None) -> Column:
    """Fallback key when nothing identifies the passenger.

    With ``upload_id`` given the key is scoped by upload (two uploads with the
    same row number and time no longer collide); without it, the original
    row-and-time form.
    """
    parts = [F.lit("anonymous")]
    if upload_id is not None:
        parts.append(_c(upload_id).cast("string"))
    parts += [_c(row_num).cast("string"), py_datetime_str(op_datetime)]
    return F.concat_ws(":", *parts)


def transaction_id(upload_id, row_num, op_datetime, amount, fio_clean) -> Column:
    """SHA-256 fold of 'upload:row:isotime:amount:name' (no namespace)."""
    key = F.concat_ws(
        ":",
        _c(upload_id).cast("string"),
        _c(row_num).cast("string"),
        py_datetime_str(op_datetime, sep="T"),
        py_float_str(amount),
        _c(fio_clean),
    )
    return fold63(key)


def concentration_id(dimension_type, dimension_value) -> Column:
    """Concentration row id: SHA-256 fold of 'type:value' (no namespace)."""
    return fold63(F.concat(_c(dimension_type), F.lit(":"), _c(dimension_value)))
