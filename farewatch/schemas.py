"""

Times are TIMESTAMP_NTZ holding UTC wall-clock time (naive inputs are UTC).
"""

from __future__ import annotations

CELLS = "upload_id long, row_num long, cells array<string>"

TRANSACTIONS = (
    "id long, upload_id long, row_num long, source string, op_type string, op_datetime timestamp_ntz, "
    "dep_datetime timestamp_ntz, train_no string, channel string, aggregator string, terminal string, "
    "cashdesk string, point_of_sale string, amount double, fee double, fio string, iin string, doc_no string, "
    "order_no string, dep_station string, arr_station string, route string, passenger_id long"
)

PASSENGERS = ("id long, fio_clean string, fake_fio_score double, first_seen_at timestamp_ntz, "
              "last_seen_at timestamp_ntz, min_op_datetime timestamp_ntz")

PASSENGER_SCORES = (
    "passenger_id long, rule_score double, ml_score double, final_score double, risk_band string, "
    "top_reasons array<string>, seat_blocking_flag boolean, is_manual boolean, scored_at timestamp_ntz"
)

RISK_CONCENTRATIONS = (
    "id long, dimension_type string, dimension_value string, total_ops long, highrisk_ops long, "
    "share_highrisk_ops double, lift_vs_base double, calculated_at timestamp_ntz"
)

AUDIT_LOGS = ("id string, user_id long, action string, entity_type string, entity_id string, meta string, "
              "created_at timestamp_ntz")

UPLOAD_EVENTS = "upload_id long, status string, ts timestamp_ntz, error string, seq long"
JOB_EVENTS = "job_id string, status string, ts timestamp_ntz, error string, seq long"
