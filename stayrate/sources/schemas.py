"""Declared source schemas.

Fixed values: column names and types of the raw files the library reads.
"""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _INT, _LONG = T.StringType(), T.IntegerType(), T.LongType()
_DOUBLE, _BOOL = T.DoubleType(), T.BooleanType()


def _struct(columns: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


def text_schema(columns: list[str]) -> T.StructType:
    """Every column as text."""
    return _struct({name: _STRING for name in columns})


COHORT = _struct({"msno": _STRING, "is_churn": _INT})

ACTIVITY_LOG = _struct(
    {
        "msno": _STRING,
        "date": _STRING,
        "num_25": _LONG,
        "num_50": _LONG,
        "num_75": _LONG,
        "num_985": _LONG,
        "num_100": _LONG,
        "num_unq": _LONG,
        "total_secs": _DOUBLE,
    }
)

TRANSACTION_COLUMNS = [
    "msno",
    "payment_method_id",
    "payment_plan_days",
    "plan_list_price",
    "actual_amount_paid",
    "is_auto_renew",
    "transaction_date",
    "membership_expire_date",
    "is_cancel",
]

MEMBER_COLUMNS = [
    "msno",
    "city",
    "gender",
    "bd",
    "registered_via",
    "registration_init_time",
]

# Panel tables are read as text; the date columns below are parsed tolerantly.
PANEL_DATE_COLUMNS = {
    "account": ["account_creation_date", "acquisition_date"],
    "subscription": ["subscription_start_date", "subscription_end_date"],
    "viewing": ["viewing_timestamp"],
    "engagement": ["event_timestamp"],
    "billing": ["billing_date"],
    "outcome": ["cancellation_date", "reactivation_date", "retention_interaction_date"],
}

PANEL_TABLES = {
    "account": _struct(
        {
            "subscriber_id": _STRING,
            "household_id": _STRING,
            "account_creation_date": _STRING,
            "acquisition_date": _STRING,
            "acquisition_channel": _STRING,
            "acquisition_campaign": _STRING,
            "customer_segment": _STRING,
            "province": _STRING,
        }
    ),
    "subscription": _struct(
        {
            "subscriber_id": _STRING,
            "subscription_id": _STRING,
            "subscription_plan": _STRING,
            "subscription_start_date": _STRING,
            "subscription_end_date": _STRING,
            "subscription_status": _STRING,
            "monthly_fee": _DOUBLE,
            "discount_amount": _DOUBLE,
            "promotion_code": _STRING,
        }
    ),
    "viewing": _struct(
        {
            "subscriber_id": _STRING,
            "session_id": _STRING,
            "viewing_timestamp": _STRING,
            "content_id": _STRING,
            "content_category": _STRING,
            "content_duration": _INT,
            "viewing_duration": _INT,
            "completion_rate": _DOUBLE,
            "device_type": _STRING,
            "pause_count": _INT,
            "abandonment_indicator": _BOOL,
        }
    ),
    "engagement": _struct(
        {
            "subscriber_id": _STRING,
            "event_timestamp": _STRING,
            "event_type": _STRING,
            "search_term": _STRING,
            "search_result_count": _INT,
            "content_click_indicator": _STRING,
            "scroll_count": _INT,
        }
    ),
    "content": _struct({"content_id": _STRING, "title": _STRING, "category": _STRING}),
    "billing": _struct(
        {
            "subscriber_id": _STRING,
            "billing_date": _STRING,
            "amount_charged": _DOUBLE,
            "payment_status": _STRING,
            "payment_method": _STRING,
            "payment_failure_indicator": _BOOL,
            "payment_failure_count": _INT,
            "refund_indicator": _BOOL,
            "refund_amount": _DOUBLE,
        }
    ),
    "outcome": _struct(
        {
            "subscriber_id": _STRING,
            "cancellation_date": _STRING,
            "cancellation_reason": _STRING,
            "cancellation_channel": _STRING,
            "churn_indicator": _BOOL,
            "reactivation_indicator": _BOOL,
            "reactivation_date": _STRING,
            "retention_interaction_date": _STRING,
            "retention_offer": _STRING,
            "offer_accepted": _BOOL,
            "offer_outcome": _STRING,
        }
    ),
}

TIMESTAMP_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
]
