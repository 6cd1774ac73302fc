"""The panel against a plain loop over subscribers and index dates."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stayrate.errors import DataQualityError
from stayrate.functions.calendar import IndexCalendar
from stayrate.operators.pointintime import horizon_labels, ineligible_keys
from stayrate.plans import panel as P

CALENDAR = IndexCalendar(date(2024, 1, 31), date(2024, 6, 30))
ENDS = [
    datetime(2024, 1, 31), datetime(2024, 2, 29), datetime(2024, 3, 31),
    datetime(2024, 4, 30), datetime(2024, 5, 31), datetime(2024, 6, 30),
]


def test_index_dates():
    recorded = IndexCalendar(date(2024, 4, 30), date(2026, 5, 31)).days()
    assert len(recorded) == 26 and recorded[0] == date(2024, 4, 30) and recorded[-1] == date(2026, 5, 31)
    assert date(2025, 2, 28) in recorded


def frame(spark, rows, schema="id string, ts timestamp_ntz"):
    return spark.createDataFrame(rows, schema)


instants = st.datetimes(datetime(2023, 9, 1), datetime(2024, 9, 1))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(instants, min_size=1, max_size=60), st.sampled_from([1, 30, 90, 100]))
def test_windows_equal_the_plain_condition(spark, times, days):
    df = frame(spark, [(str(i), t) for i, t in enumerate(times)])
    span = timedelta(days=days)
    back = {(r.id, r.index_date) for r in CALENDAR.with_lookback(df, "ts", days).collect()}
    ahead = {(r.id, r.index_date) for r in CALENDAR.with_horizon(df, "ts", days).collect()}
    assert back == {(str(i), e) for i, t in enumerate(times) for e in ENDS if e - span < t <= e}
    assert ahead == {(str(i), e) for i, t in enumerate(times) for e in ENDS if e < t <= e + span}


def test_window_edges(spark):
    idx, tick = datetime(2024, 3, 31), timedelta(microseconds=1)
    times = [
        idx, idx + tick, idx - tick, idx - timedelta(days=90), idx - timedelta(days=90) + tick,
        idx + timedelta(hours=5), datetime(2024, 2, 29), datetime(2024, 2, 28),
    ]
    df = frame(spark, [(str(i), t) for i, t in enumerate(times)])
    inside = {r.id for r in CALENDAR.with_lookback(df, "ts", 90).where(F.col("index_date") == idx).collect()}
    assert inside == {"0", "2", "4", "6", "7"}
    soon = {r.id for r in CALENDAR.with_horizon(df, "ts", 30).where(F.col("index_date") == idx).collect()}
    assert soon == {"1", "5"}


def test_march_belongs_to_the_january_horizon(spark):
    df = frame(spark, [("a", datetime(2024, 3, 1)), ("b", datetime(2024, 3, 1, 0, 0, 1)), ("c", datetime(2024, 1, 31))])
    got = {(r.id, r.index_date) for r in horizon_labels(df, CALENDAR, "id", "ts", 30, F.lit(True)).collect()}
    assert ("a", ENDS[0]) in got and ("a", ENDS[1]) in got
    assert ("b", ENDS[0]) not in got and ("b", ENDS[1]) in got
    assert not any(i == "c" for i, _ in got)


def test_eligibility(spark):
    rows = [
        ("churned", datetime(2024, 2, 15), True, "Churned", None),
        ("returned", datetime(2024, 2, 15), False, "Reactivated Later", datetime(2024, 4, 10)),
        ("waiting", datetime(2024, 2, 15), False, "Reactivated Later", None),
        ("paused", datetime(2024, 2, 15), False, "Paused", None),
        ("unknown", datetime(2024, 2, 15), None, None, None),
        ("on the day", datetime(2024, 2, 29), True, None, None),
    ]
    df = spark.createDataFrame(
        rows, "id string, cancelled timestamp_ntz, churn boolean, offer string, back timestamp_ntz"
    )
    barred = ineligible_keys(
        df, CALENDAR, "id", "cancelled", F.col("churn"), F.col("offer") == "Reactivated Later", "back"
    )
    got = {}
    for r in barred.collect():
        got.setdefault(r.id, set()).add(r.index_date)
    assert got == {
        "churned": set(ENDS[1:]),
        "returned": {ENDS[1], ENDS[2]},
        "waiting": set(ENDS[1:]),
        "on the day": set(ENDS[1:]),
    }


def make_tables(spark, seed=3, people=25):
    """Small random tables of the panel's shape; one person holds a third of all events."""
    rng = random.Random(seed)

    def moment(low=datetime(2023, 9, 1), high=datetime(2024, 8, 1)):
        return low + timedelta(seconds=rng.randrange(int((high - low).total_seconds())))

    ids = [f"s{i}" for i in range(people)]

    def someone():
        return ids[0] if rng.random() < 0.34 else rng.choice(ids)

    account = [
        (i, f"h{i}", moment(high=datetime(2024, 3, 1)), None if i == "s3" else moment(high=datetime(2024, 4, 1)),
         " web  shop", "Spring", "at-risk", None if i == "s5" else "Gauteng")
        for i in ids
    ]
    account.append(account[2][:4] + ("Web Shop", "Spring", "At-Risk", "Gauteng"))
    subscription = [
        (i, f"sub{i}", "Basic", moment(), None, "Active", 99.0, 0.0, None) for i in ids if i != "s4"
    ]
    viewing = [
        (someone(), f"v{rng.randrange(300)}", moment(), "c1", "Film", 90,
         None if rng.random() < 0.1 else rng.randrange(1, 90), rng.random(), "TV", rng.randrange(4), rng.random() < 0.3)
        for _ in range(400)
    ]
    engagement = [
        (someone(), moment(), rng.choice(["search", "Browse", " PLAY "]), None, None,
         rng.choice(["true", " FALSE", "", None]), rng.randrange(9))
        for _ in range(500)
    ]
    billing = [
        (someone(), moment(), None if rng.random() < 0.1 else float(rng.randrange(50, 200)), "Paid", "Card",
         rng.random() < 0.2, 7, rng.random() < 0.1, None if rng.random() < 0.5 else 5.0)
        for _ in range(300)
    ]
    outcome = [
        (i, None if i == "s9" else moment(datetime(2024, 1, 1)), "Price", "App", rng.random() < 0.5, False,
         moment(datetime(2024, 3, 1)) if rng.random() < 0.5 else None, None, None, None,
         rng.choice(["reactivated later", "Paused", None]))
        for i in ids[5:20]
    ]
    from stayrate.sources.schemas import PANEL_DATE_COLUMNS, PANEL_TABLES

    tables = {}
    data = {
        "account": account, "subscription": subscription, "viewing": viewing,
        "engagement": engagement, "billing": billing, "outcome": outcome,
    }
    for name, rows in data.items():
        fields = ", ".join(
            f"{f.name} {'timestamp_ntz' if f.name in PANEL_DATE_COLUMNS[name] else f.dataType.simpleString()}"
            for f in PANEL_TABLES[name].fields
        )
        tables[name] = spark.createDataFrame(rows, fields)
    return tables, data


def mean(values):
    values = [v for v in values if v is not None]
    return sum(values) / len(values) if values else None


def expected_panel(data):
    starts = {r[0]: r[3] for r in data["subscription"]}
    people = {r[0]: r for r in data["account"]}
    outcomes = [r for r in data["outcome"] if r[1] is not None]
    truth = {"true": 1.0, "false": 0.0}
    result = {}
    for i, account in people.items():
        for idx in ENDS:
            if account[3] is None or account[3] > idx:
                continue
            past = [o for o in outcomes if o[0] == i and o[1] <= idx]
            if any(o[4] for o in past):
                continue
            if any(o[10] == "reactivated later" and (o[6] is None or o[6] > idx) for o in past):
                continue
            lo = idx - timedelta(days=90)

            def days(t, idx=idx):
                return None if t is None else (idx - t).total_seconds() / 86400

            def inside(table, at, i=i, lo=lo, idx=idx):
                return [r for r in data[table] if r[0] == i and lo < r[at] <= idx]

            v, e, b = inside("viewing", 2), inside("engagement", 1), inside("billing", 1)
            kinds = [r[2].strip().title() for r in e]
            end = idx + timedelta(days=30)
            result[(i, idx)] = {
                "account_age_days": days(account[2]),
                "subscriber_tenure_days": days(account[3]),
                "subscription_age_days": days(starts.get(i)),
                "view_sessions_90d": len({r[1] for r in v}) if v else None,
                "viewing_seconds_90d": sum(r[6] or 0 for r in v) if v else None,
                "mean_completion_90d": mean([r[7] for r in v]),
                "mean_pause_count_90d": mean([r[9] for r in v]),
                "abandonment_rate_90d": mean([float(r[10]) for r in v]),
                "days_since_last_viewing": days(max(r[2] for r in v)) if v else None,
                "engagement_events_90d": len(e) if e else None,
                "distinct_event_types_90d": len(set(kinds)) if e else None,
                "search_events_90d": kinds.count("Search") if e else None,
                "content_click_rate_90d": mean([truth.get((r[5] or "").strip().lower()) for r in e]),
                "scroll_count_90d": sum(r[6] for r in e) if e else None,
                "days_since_last_engagement": days(max(r[1] for r in e)) if e else None,
                "billing_events_90d": len(b) if b else None,
                "amount_charged_90d": sum(r[2] or 0 for r in b) if b else None,
                "failed_payment_events_90d": sum(r[5] for r in b) if b else None,
                "refunds_90d": sum(r[7] for r in b) if b else None,
                "refund_amount_90d": sum(r[8] or 0 for r in b) if b else None,
                "mean_charge_90d": mean([r[2] for r in b]),
                "days_since_last_billing": days(max(r[1] for r in b)) if b else None,
                "target_churn_30d": int(any(o[0] == i and o[4] and idx < o[1] <= end for o in outcomes)),
                "label_window_end": end,
                "view_sessions_observed_90d": int(bool(v)),
                "engagement_events_observed_90d": int(bool(e)),
                "billing_events_observed_90d": int(bool(b)),
                "acquisition_channel": "Web Shop",
                "customer_segment": "At-Risk",
            }
    return result


def test_panel_equals_the_loop(spark):
    tables, data = make_tables(spark)
    panel = P.build_panel(P.clean_tables(tables), CALENDAR)
    got = {(r["subscriber_id"], r["index_date"]): r.asDict() for r in panel.collect()}
    expected = expected_panel(data)
    assert got.keys() == expected.keys() and len(expected) > 60
    assert {r["target_churn_30d"] for r in got.values()} == {0, 1}
    for key, row in expected.items():
        for name, value in row.items():
            wanted = pytest.approx(value, abs=1e-9) if isinstance(value, float) else value
            assert got[key][name] == wanted, (key, name)
    predictors = [c for c in panel.columns if c not in P.EXCLUDED]
    assert len(predictors) == 29


def test_panel_checks(spark):
    tables, _ = make_tables(spark)
    panel = P.build_panel(P.clean_tables(tables), CALENDAR).persist()
    report = {r.check_name: r.rows_found for r in P.panel_checks(panel).collect()}
    assert report["negative_viewing_seconds_90d"] == 0
    with pytest.raises(DataQualityError):
        P.panel_checks(panel.unionByName(panel))
    panel.unpersist()


def test_conflicting_accounts_are_refused(spark):
    tables, _ = make_tables(spark)
    tables = P.clean_tables(tables)
    twice = tables["account"].unionByName(tables["account"].withColumn("province", F.lit("Other")))
    with pytest.raises(DataQualityError, match="account"):
        P.build_panel({**tables, "account": twice}, CALENDAR)


def test_outcome_checks(spark):
    tables, _ = make_tables(spark)
    outcome = P.clean_tables(tables)["outcome"]
    checks = P.outcome_checks(outcome)
    by_offer = {r.offer_outcome: (r["false"], r["true"], r["missing"]) for r in checks["by_offer"].collect()}
    assert sum(sum(v) for v in by_offer.values()) == outcome.count()
    found = {r.check_name: r.rows_found for r in checks["checks"].collect()}
    assert found["contradictions"] == outcome.where("offer_outcome = 'Paused' AND churn_indicator").count()
