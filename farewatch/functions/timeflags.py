"""Per-operation time features."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from farewatch import constants as K
from farewatch.functions.text import _c


def hours_to_departure(op_datetime="op_datetime", dep_datetime="dep_datetime") -> Column:
    """(dep - op) in hours; null when departure is missing.

    Seconds first, then hours, so the double matches total_seconds()/3600.
    """
    diff = F.timestamp_diff("MICROSECOND", _c(op_datetime), _c(dep_datetime))
    return (diff.cast("double") / 1e6) / 3600.0


def night_flag(op_datetime="op_datetime", definition: str = "scoring") -> Column:
    """Scoring night = hour 0..5; entity night = hour >= 23 or < 6."""
    h = F.hour(_c(op_datetime))
    if definition == "scoring":
        return h.between(K.NIGHT_HOURS[0], K.NIGHT_HOURS[1])
    return (h >= K.ENTITY_NIGHT_FROM) | (h < K.ENTITY_NIGHT_TO)


def late_refund_flag(op_type="op_type", hours="hours_to_departure", definition: str = "scoring") -> Column:
    """Scoring: refund with 0 <= hours < 24; entity: refund with 0 <= hours <= 1.

    Case-sensitive on the lower-case operation type; missing hours -> false.
    """
    h = _c(hours)
    is_refund = _c(op_type) == "refund"
    if definition == "scoring":
        cond = is_refund & (h < K.LATE_REFUND_HOURS) & (h >= 0)
    else:
        cond = is_refund & (h >= 0) & (h <= K.LAST_MINUTE_HOURS)
    return F.coalesce(cond, F.lit(False))
