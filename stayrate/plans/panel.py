"""Subscriber-month panel from seven raw tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.functions.calendar import IndexCalendar
from stayrate.functions.cleaning import boolean_text, flag, normalise_categories
from stayrate.operators.joins import drop_exact_duplicates, left_one_to_one
from stayrate.operators.pointintime import (
    add_ages,
    assemble,
    eligible_spine,
    horizon_labels,
    ineligible_keys,
    lookback_features,
    spine,
    total_or_zero,
)
from stayrate.operators.profile import counters, crosstab
from stayrate.operators.quality import require_unique_key

# Index dates, window lengths, split ranges and category columns.
CALENDAR = IndexCalendar(date(2024, 4, 30), date(2026, 5, 31))
LOOKBACK_DAYS = 90
HORIZON_DAYS = 30
SPLIT_RANGES = {
    "train": (None, date(2025, 9, 30)),
    "validation": (date(2025, 10, 1), date(2026, 1, 31)),
    "test": (date(2026, 2, 1), date(2026, 5, 31)),
}
OBSERVATION = ("2024-01-01 00:00:00", "2026-06-30 23:59:59")
CATEGORY_COLUMNS = {
    "account": ["acquisition_channel", "acquisition_campaign", "customer_segment", "province"],
    "subscription": ["subscription_plan", "subscription_status", "promotion_code"],
    "viewing": ["content_category", "device_type"],
    "engagement": ["event_type"],
    "billing": ["payment_status", "payment_method"],
    "outcome": ["cancellation_reason", "cancellation_channel", "retention_offer", "offer_outcome"],
}
NON_CHURN_OUTCOMES = ["Paused", "Retained", "Downgraded"]
STATIC_COLUMNS = [
    "subscriber_id",
    "account_creation_date",
    "acquisition_date",
    "acquisition_channel",
    "acquisition_campaign",
    "customer_segment",
    "province",
]
# Keys, labels and whatever would leak the outcome into the predictors.
EXCLUDED = [
    "subscriber_id",
    "household_id",
    "index_date",
    "label_window_end",
    "target_churn_30d",
    "subscription_status",
    "subscription_end_date",
    "subscription_start_date",
    "account_creation_date",
    "acquisition_date",
    "cancellation_date",
    "cancellation_reason",
    "cancellation_channel",
    "churn_indicator",
    "reactivation_indicator",
    "reactivation_date",
    "retention_interaction_date",
    "retention_offer",
    "offer_accepted",
    "offer_outcome",
]
ID, TARGET = "subscriber_id", "target_churn_30d"

# What each predictor means: calculation, source table, unit.
FEATURE_NOTES = {
    "acquisition_channel": ("category as recorded at sign-up", "account", "category"),
    "acquisition_campaign": ("category as recorded at sign-up", "account", "category"),
    "customer_segment": ("category as recorded at sign-up", "account", "category"),
    "province": ("category as recorded at sign-up", "account", "category"),
    "account_age_days": ("index date minus account creation", "account", "days"),
    "subscriber_tenure_days": ("index date minus acquisition", "account", "days"),
    "subscription_age_days": ("index date minus subscription start, negative before it", "subscription", "days"),
    "view_sessions_90d": ("distinct sessions", "viewing", "count"),
    "viewing_seconds_90d": ("sum of viewing duration", "viewing", "seconds"),
    "mean_completion_90d": ("mean completion rate", "viewing", "proportion"),
    "mean_pause_count_90d": ("mean pauses per session row", "viewing", "count"),
    "abandonment_rate_90d": ("share of abandoned rows", "viewing", "proportion"),
    "days_since_last_viewing": ("index date minus the last event in the window", "viewing", "days"),
    "engagement_events_90d": ("event rows", "engagement", "count"),
    "distinct_event_types_90d": ("distinct event types", "engagement", "count"),
    "search_events_90d": ("search events", "engagement", "count"),
    "content_click_rate_90d": ("share of known click indicators that are true", "engagement", "proportion"),
    "scroll_count_90d": ("sum of scroll counts", "engagement", "count"),
    "days_since_last_engagement": ("index date minus the last event in the window", "engagement", "days"),
    "billing_events_90d": ("billing rows", "billing", "count"),
    "amount_charged_90d": ("sum of charges", "billing", "currency"),
    "failed_payment_events_90d": ("rows flagged as failed", "billing", "count"),
    "refunds_90d": ("rows flagged as refunded", "billing", "count"),
    "refund_amount_90d": ("sum of refunds", "billing", "currency"),
    "mean_charge_90d": ("mean charge", "billing", "currency"),
    "days_since_last_billing": ("index date minus the last event in the window", "billing", "days"),
    "view_sessions_observed_90d": ("1 when the window has viewing rows", "viewing", "flag"),
    "engagement_events_observed_90d": ("1 when the window has engagement rows", "engagement", "flag"),
    "billing_events_observed_90d": ("1 when the window has billing rows", "billing", "flag"),
}


def clean_tables(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Category columns normalised in every table."""
    return {n: normalise_categories(t, CATEGORY_COLUMNS.get(n, [])) for n, t in tables.items()}


def outcome_checks(outcome: DataFrame) -> dict[str, DataFrame]:
    """Crosstabs of the label and counters of contradictions and dates out of range."""
    low, high = (F.lit(v).cast("timestamp_ntz") for v in OBSERVATION)
    cancelled = F.col("cancellation_date")
    return {
        "by_reactivation": crosstab(outcome, "reactivation_indicator", "churn_indicator", ["false", "true"]),
        "by_offer": crosstab(outcome, "offer_outcome", "churn_indicator", ["false", "true"]),
        "checks": counters(
            outcome,
            {
                "outside_window": (cancelled < low) | (cancelled > high),
                "contradictions": F.col("offer_outcome").isin(NON_CHURN_OUTCOMES)
                & F.col("churn_indicator"),
            },
        ),
    }


def viewing_features(viewing: DataFrame, calendar: IndexCalendar, days: int) -> DataFrame:
    abandoned = F.col("abandonment_indicator").cast("int")
    return lookback_features(
        viewing,
        calendar,
        ID,
        "viewing_timestamp",
        days,
        [
            F.countDistinct("session_id").alias("view_sessions_90d"),
            total_or_zero("viewing_duration").alias("viewing_seconds_90d"),
            F.avg("completion_rate").alias("mean_completion_90d"),
            F.avg("pause_count").alias("mean_pause_count_90d"),
            F.avg(abandoned).alias("abandonment_rate_90d"),
        ],
        "days_since_last_viewing",
    )


def engagement_features(engagement: DataFrame, calendar: IndexCalendar, days: int) -> DataFrame:
    return lookback_features(
        engagement,
        calendar,
        ID,
        "event_timestamp",
        days,
        [
            F.count(F.lit(1)).alias("engagement_events_90d"),
            F.countDistinct("event_type").alias("distinct_event_types_90d"),
            F.count_if(F.col("event_type") == "Search").alias("search_events_90d"),
            F.avg(boolean_text("content_click_indicator")).alias("content_click_rate_90d"),
            total_or_zero("scroll_count").alias("scroll_count_90d"),
        ],
        "days_since_last_engagement",
    )


def billing_features(billing: DataFrame, calendar: IndexCalendar, days: int) -> DataFrame:
    return lookback_features(
        billing,
        calendar,
        ID,
        "billing_date",
        days,
        [
            F.count(F.lit(1)).alias("billing_events_90d"),
            total_or_zero("amount_charged").alias("amount_charged_90d"),
            F.sum(flag(F.col("payment_failure_indicator"))).alias("failed_payment_events_90d"),
            F.sum(flag(F.col("refund_indicator"))).alias("refunds_90d"),
            total_or_zero("refund_amount").alias("refund_amount_90d"),
            F.avg("amount_charged").alias("mean_charge_90d"),
        ],
        "days_since_last_billing",
    )


def build_panel(
    tables: Mapping[str, DataFrame],
    calendar: IndexCalendar = CALENDAR,
    lookback: int = LOOKBACK_DAYS,
    horizon: int = HORIZON_DAYS,
) -> DataFrame:
    """One row per eligible subscriber and month-end, with features and label.

    ``tables`` holds the parsed, category-normalised tables.
    """
    account = drop_exact_duplicates(tables["account"])
    started = tables["subscription"].select(ID, "subscription_start_date")
    static = left_one_to_one(account.select(*STATIC_COLUMNS), started, ID, "account and subscription")
    outcome = tables["outcome"].dropna(subset=[ID, "cancellation_date"])

    barred = ineligible_keys(
        outcome,
        calendar,
        ID,
        "cancellation_date",
        F.col("churn_indicator"),
        F.col("offer_outcome") == "Reactivated Later",
        "reactivation_date",
    )
    rows = eligible_spine(spine(static, calendar, "acquisition_date"), barred, ID)
    rows = add_ages(
        rows,
        {
            "account_age_days": "account_creation_date",
            "subscriber_tenure_days": "acquisition_date",
            "subscription_age_days": "subscription_start_date",
        },
    )
    positives = horizon_labels(
        outcome, calendar, ID, "cancellation_date", horizon, F.col("churn_indicator")
    )
    return assemble(
        rows,
        [
            viewing_features(tables["viewing"], calendar, lookback),
            engagement_features(tables["engagement"], calendar, lookback),
            billing_features(tables["billing"], calendar, lookback),
        ],
        positives,
        ID,
        TARGET,
        horizon,
        {
            "view_sessions_observed_90d": "view_sessions_90d",
            "engagement_events_observed_90d": "engagement_events_90d",
            "billing_events_observed_90d": "billing_events_90d",
        },
    )


def feature_dictionary(panel: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """One row per predictor: calculation, source, unit, time reference."""
    rows = []
    for position, name in enumerate(predictors):
        calculation, source, unit = FEATURE_NOTES.get(name, (None, None, None))
        reference = "window before the index date" if name.endswith("_90d") or "_last_" in name else "index date"
        rows.append((position, name, calculation, source, unit, reference))
    return panel.sparkSession.createDataFrame(
        rows,
        "position int, feature string, calculation string, source string, unit string, time_reference string",
    )


def panel_checks(panel: DataFrame) -> DataFrame:
    """Gate the grain; report negative tenures, durations and charges."""
    require_unique_key(panel, [ID, "index_date"], "panel grain")
    names = [
        "account_age_days",
        "subscriber_tenure_days",
        "subscription_age_days",
        "viewing_seconds_90d",
        "amount_charged_90d",
        "refund_amount_90d",
    ]
    return counters(panel, {f"negative_{c}": F.col(c) < 0 for c in names})
