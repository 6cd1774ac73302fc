"""Whole flows on small files: cohort, profiles, training, comparison, panel, ingest."""

from __future__ import annotations

import csv
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from conftest import rows_of
from test_panel import CALENDAR, make_tables
from test_quality import executions

from stayrate.errors import DataQualityError
from stayrate.operators import models as L
from stayrate.plans import cohort as C
from stayrate.plans import panel as P
from stayrate.plans import profiles, training
from stayrate.plans.comparison import compare_predictions
from stayrate.sources import readers as R
from stayrate.sources import schemas as S
from stayrate.sources.sinks import load_model, read_json_document, write_parquet
from stayrate.streaming.ingest import ingest_batch, ingest_stream

PEOPLE = 200


def write_rows(path, header, rows):
    with open(path, "w", newline="") as handle:
        writer = csv.writer(handle)
        writer.writerow(header)
        writer.writerows(rows)


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    """Raw CSV files; churners pay less and listen less."""
    folder = tmp_path_factory.mktemp("raw")
    rng = random.Random(1)
    ids = [f"m{i:03d}" for i in range(PEOPLE)]
    churn = {m: int(rng.random() < 0.3) for m in ids}
    first = date(2016, 11, 1)

    def day():
        return first + timedelta(days=rng.randrange(150))

    def code(d):
        return d.strftime("%Y%m%d")

    write_rows(folder / "train.csv", ["msno", "is_churn"], churn.items())
    transactions = []
    for m in ids[:-5]:
        for _ in range(rng.randrange(1, 6)):
            when = day()
            expiry = "19700101" if rng.random() < 0.1 else code(when + timedelta(days=30))
            price = rng.choice(["99", "149.0", "n/a"])
            transactions.append(
                [m, "41", "30", price, price, str(1 - churn[m] if rng.random() < 0.8 else churn[m]),
                 code(when) if rng.random() < 0.95 else "20170230", expiry, str(int(rng.random() < 0.2))]
            )
    transactions += [["stranger", "1", "7", "10", "10", "1", "20170115", "20170122", "0"]] * 50
    write_rows(folder / "transactions.csv", S.TRANSACTION_COLUMNS, transactions)
    members = [
        [m, str(rng.randrange(5)), rng.choice(["male", "female", " ", ""]), str(rng.choice([-3, 0, 25, 31, 1000])),
         "7", code(date(2010, 1, 1) + timedelta(days=rng.randrange(2000)))]
        for m in ids[3:]
    ]
    write_rows(folder / "members.csv", S.MEMBER_COLUMNS, members)
    logs = [
        [m, code(day()), *[str(rng.randrange(5)) for _ in range(6)],
         str(round(rng.random() * (100 if churn[m] else 400), 2))]
        for m in ids[:-20] for _ in range(rng.randrange(12))
    ]
    for part in range(3):
        write_rows(folder / f"logs_{part}.csv", [f.name for f in S.ACTIVITY_LOG], logs[part::3])
    return folder, ids, churn, transactions, members, logs


@pytest.fixture(scope="module")
def built(spark, raw, tmp_path_factory):
    """All four cohort flows run once, and the split."""
    folder, *_ = raw
    out = str(tmp_path_factory.mktemp("built"))
    cohort = R.load_cohort(R.read_text_csv(spark, f"{folder}/train.csv", ["msno", "is_churn"]), "msno", "is_churn")
    totals = C.ingest_activity(spark, f"{folder}/logs_*.csv", f"{out}/logs")
    reports = {
        "behaviour": C.behaviour_flow(cohort, R.read_parquet(spark, f"{out}/logs"), f"{out}/behaviour"),
        "transactions": C.transaction_flow(
            cohort, R.read_text_csv(spark, f"{folder}/transactions.csv", S.TRANSACTION_COLUMNS), f"{out}/transactions"
        ),
        "members": C.member_flow(
            cohort, R.read_text_csv(spark, f"{folder}/members.csv", S.MEMBER_COLUMNS), f"{out}/members"
        ),
    }
    tables = [R.read_parquet(spark, f"{out}/{n}") for n in ("behaviour", "transactions", "members")]
    reports["labels"] = C.model_dataset_flow(*tables, f"{out}/dataset")
    dataset = R.read_parquet(spark, f"{out}/dataset")
    reports["split"] = training.split_flow(dataset, "msno", "is_churn", f"{out}/split")
    return out, cohort, dataset, reports, totals


def test_cohort_flows(spark, raw, built):
    _, ids, churn, transactions, members, logs = raw
    out, cohort, dataset, reports, totals = built
    assert totals.rows == len(logs) and totals.parts >= len({x[1][:6] for x in logs})
    unparsed = ingest_batch(spark, f"{raw[0]}/logs_*.csv", f"{out}/plain", S.ACTIVITY_LOG, rows_per_part=200)
    assert unparsed.rows == len(logs) and unparsed.parts >= len(logs) / 200
    plain = C.behaviour_features(cohort, C.parse_activity(R.read_parquet(spark, f"{out}/plain")))
    doubles = [n for n, t in plain.dtypes if t == "double"]
    exact = [df.withColumns({c: F.round(c, 6) for c in doubles}) for df in (plain, R.read_parquet(spark, f"{out}/behaviour"))]
    assert exact[0].exceptAll(exact[1]).count() == 0 and plain.count() == PEOPLE
    stored = C.parse_activity(C.activity_window(R.read_parquet(spark, f"{out}/logs")))
    plan = C.behaviour_features(cohort, stored)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_month" in plan
    assert len(dataset.columns) == 32 and dataset.count() == PEOPLE
    assert dict(dataset.dtypes)["total_num_unq_M1"] == "bigint"
    rows = {r["msno"]: r for r in dataset.collect()}

    def inside(code, low, high):
        return low <= code <= high

    for m in (ids[0], ids[7], ids[-1]):
        mine = [x for x in logs if x[0] == m and inside(x[1], "20170101", "20170131")]
        assert rows[m]["active_days_M2"] == len({x[1] for x in mine})
        assert rows[m]["total_song_events_M2"] == sum(int(v) for x in mine for v in x[2:7])
        assert rows[m]["total_secs_M2"] == pytest.approx(sum(float(x[8]) for x in mine))
        paid = [
            x for x in transactions
            if x[0] == m and inside(x[6], "20161201", "20170228") and x[6] != "20170230"
        ]
        assert rows[m]["transaction_count"] == len(paid)
        assert rows[m]["total_amount_paid"] == sum(float(x[4]) for x in paid if x[4] != "n/a")
        assert rows[m]["valid_expiry_count"] == sum(x[7] >= "20000101" for x in paid)
    assert rows[ids[-1]]["transaction_recency_days"] is None and rows[ids[-1]]["transaction_count"] == 0
    member = next(x for x in members if x[0] == ids[50])
    assert rows[ids[50]]["age"] == (int(member[3]) if 5 <= int(member[3]) <= 99 else None)
    assert rows[ids[50]]["gender"] == (member[2].strip() or None)
    assert rows[ids[0]]["city"] is None
    assert reports["behaviour"].first().total_rows == len(logs)
    assert reports["transactions"]["dates"].first().invalid_transaction_date == sum(
        x[6] == "20170230" for x in transactions
    )
    assert sum(r.customers for r in reports["labels"].collect()) == PEOPLE


def test_flow_refuses_bad_cohort(spark, built, tmp_path):
    _, cohort, dataset, *_ = built
    with pytest.raises(DataQualityError):
        C.member_flow(cohort.unionByName(cohort.limit(1)), spark.createDataFrame([], "msno string"), str(tmp_path))
    flipped = dataset.withColumn("is_churn", 1 - F.col("is_churn"))
    with pytest.raises(DataQualityError, match="labels differ"):
        C.model_dataset_flow(dataset, flipped, dataset, str(tmp_path))
    with pytest.raises(DataQualityError, match="size"):
        C.model_dataset_flow(dataset, dataset.limit(3), dataset, str(tmp_path))


def test_groups_stored_by_id_join_without_an_exchange(spark, raw, built, tmp_path):
    """Each flow is two jobs: its cohort by id, and the write that also checks."""
    folder, *_ = raw
    _, cohort, dataset, *_ = built
    logs = R.read_parquet(spark, f"{built[0]}/logs")
    transactions = R.read_text_csv(spark, f"{folder}/transactions.csv", S.TRANSACTION_COLUMNS)
    members = R.read_text_csv(spark, f"{folder}/members.csv", S.MEMBER_COLUMNS)
    for name, flow, source in (
        ("b", C.behaviour_flow, logs), ("t", C.transaction_flow, transactions), ("m", C.member_flow, members)
    ):
        _, jobs = executions(spark, lambda: flow(cohort, source, f"{tmp_path}/{name}", table=f"groups_{name}"))
        assert jobs == 2
    groups = [spark.table(f"groups_{n}") for n in "btm"]
    joined = C.watched_groups(groups, C.CohortNames())
    # Without runtime statistics, and with small tables kept from being broadcast.
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joined._jdf.queryExecution().executedPlan().toString()
        plain = C.watched_groups([R.read_parquet(spark, f"{tmp_path}/{n}") for n in "btm"], C.CohortNames())
        assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
    shares, jobs = executions(spark, lambda: C.model_dataset_flow(*groups, f"{tmp_path}/d", table="groups_d"))
    assert jobs == 2 and sum(r.customers for r in shares.collect()) == PEOPLE
    assert rows_of(spark.table("groups_d"), "msno") == rows_of(dataset, "msno")
    for n in "btmd":
        spark.sql(f"DROP TABLE groups_{n}")


def test_a_failed_flow_leaves_nothing(spark, built, tmp_path):
    _, cohort, dataset, *_ = built
    groups = [dataset.select("msno", "is_churn", *columns) for columns in (
        [c for c in dataset.columns if "_M" in c], ["transaction_count", "valid_expiry_count"], ["city"]
    )]
    twice = groups[2].unionByName(groups[2].limit(1))
    negative = groups[1].withColumn("transaction_count", F.lit(-1))
    for bad in ([*groups[:2], twice], [groups[0], negative, groups[2]], [groups[0], groups[1].limit(9), groups[2]]):
        with pytest.raises(DataQualityError):
            C.model_dataset_flow(*bad, f"{tmp_path}/out", table="never")
        assert list(tmp_path.iterdir()) == [] and not spark.catalog.tableExists("never")


def test_profiles(spark, raw, built):
    folder, ids, churn, transactions, *_ = raw
    _, cohort, *_ = built
    typed = R.read_csv(
        spark, f"{folder}/transactions.csv",
        "msno string, payment_method_id int, payment_plan_days int, plan_list_price string, "
        "actual_amount_paid string, is_auto_renew int, transaction_date int, membership_expire_date int, is_cancel int",
    )
    odd = [x for x in transactions if x[7] == "19700101"]
    anomalies = profiles.anomaly_reports(cohort, typed, "msno", "is_churn", "membership_expire_date", "is_cancel")
    total = anomalies["total"].first()
    assert (total.records, total.entities) == (len(odd), len({x[0] for x in odd}))
    assert sum(r.entities for r in anomalies["labels"].collect()) == len({x[0] for x in odd})
    train = profiles.training_report(
        cohort, typed, "msno", "is_churn", "transaction_date", "membership_expire_date"
    )
    assert train["coverage"].first().without_facts == 5
    assert train["ranges"].first().min_membership_expire_date == 19700101
    assert train["sample"].count() == 5 and train["schema"].count() == 9
    expiry = profiles.expiry_reports(cohort, typed, "msno", "is_churn", "membership_expire_date")
    assert sum(r.entities for r in expiry["distribution"].collect()) == sum(
        r.entities for r in expiry["last_valid"].collect()
    )
    line = profiles.timeline_reports(
        cohort, typed, "msno", "is_churn", "transaction_date", "membership_expire_date"
    )
    assert line["expiry"].first().suspicious == len(odd) and line["sample"].count() == 10
    assert sum(r.entities for r in line["summary"].collect()) == PEOPLE - 5
    log = profiles.activity_report(R.read_csv(spark, f"{folder}/logs_*.csv", S.ACTIVITY_LOG), "msno", "date")
    assert log["missing"].agg(F.sum("missing")).first()[0] == 0


def test_training_and_comparison(spark, built, tmp_path):
    out, _, dataset, reports, _ = built
    assert {r.split: r.rows for r in reports["split"].collect()} == {"train": 139, "validation": 30, "test": 31}
    split = training.attach_split(dataset, R.read_parquet(spark, f"{out}/split/split_assignments"), "msno")
    document = read_json_document(spark, f"{out}/split/preprocessing_summary")
    assert document["rows"] == PEOPLE and document["splits"]["train"]["rows"] == 139
    assert len(document["numeric"]) == 26 and document["categorical"] == training.COHORT_CATEGORIES
    linear = training.train_logistic(split, "msno", "is_churn", output=f"{tmp_path}/lr")
    boosted = training.train_boosted(
        split, "msno", "is_churn", settings={"small": L.BoostingSettings(5, 2, 0.1)}, output=f"{tmp_path}/gbt"
    )
    assert len(linear.candidates) == 3 and linear.test["positives"] + linear.test["negatives"] == 31
    assert linear.validation["f1"] > 0 and 0 <= linear.threshold <= 1
    best = max(c["average_precision"] for c in linear.candidates)
    chosen = next(c for c in linear.candidates if c["model"] == linear.model_name)
    assert chosen["average_precision"] == best
    assert read_json_document(spark, f"{tmp_path}/lr/metrics")["threshold"] == linear.threshold
    _, settings = load_model(f"{tmp_path}/gbt/model")
    assert settings["threshold"] == boosted.threshold

    columns = ["msno", "actual_is_churn", "predicted_probability", "predicted_is_churn"]
    sets = [
        R.load_predictions(R.read_text_csv(spark, f"{tmp_path}/{n}/predictions", columns), *columns)
        for n in ("lr", "gbt")
    ]
    result = compare_predictions(*sets, f"{tmp_path}/compared", replicates=100)
    differences = {r.metric: r.difference for r in result["differences"].collect()}
    assert differences["f1"] == pytest.approx(boosted.test["f1"] - linear.test["f1"])
    intervals = {r.metric: r for r in result["intervals"].collect()}
    assert intervals["f1"].observed_difference == pytest.approx(differences["f1"])
    assert intervals["roc_auc"].ci_lower <= intervals["roc_auc"].ci_upper
    assert read_json_document(spark, f"{tmp_path}/compared/settings")["observations"] == 31


def test_panel_experiment(spark, tmp_path):
    tables, _ = make_tables(spark, seed=8, people=60)
    write_parquet(P.build_panel(P.clean_tables(tables), CALENDAR), f"{tmp_path}/panel")
    panel = R.read_parquet(spark, f"{tmp_path}/panel")
    ranges = {
        "train": (None, date(2024, 3, 31)),
        "validation": (date(2024, 4, 1), date(2024, 4, 30)),
        "test": (date(2024, 5, 1), date(2024, 6, 30)),
    }
    result = training.panel_experiment(
        panel, f"{tmp_path}/run", {"boosted small": L.BoostingSettings(3, 2, 0.1, min_instances=2)}, ranges, replicates=20
    )
    assert result.model_name == "boosted small"
    assert {c["model"] for c in result.candidates} == {"boosted small", "prior"}
    for name in (
        "split_summary", "target_counts", "overlap", "test_predictions", "test_metrics", "class_report",
        "score_diagnostics", "feature_dictionary", "pr_curve", "roc_curve", "cluster_bootstrap", "attribution",
    ):
        assert spark.read.option("header", True).csv(f"{tmp_path}/run/{name}").columns, name
    written = spark.read.option("header", True).csv(f"{tmp_path}/run/test_predictions")
    assert written.count() == panel.where("index_date > timestamp_ntz'2024-04-30'").count()
    document = read_json_document(spark, f"{tmp_path}/run/experiment")
    assert len(document["features"]) == 29 and set(document["features"]) == set(P.FEATURE_NOTES)


def test_raw_audit(spark):
    tables, data = make_tables(spark)
    report = profiles.raw_audit(
        tables,
        {n: "subscriber_id" for n in tables},
        {"account": ["subscriber_id"], "viewing": ["session_id"]},
        {"account": ["acquisition_date"], "outcome": ["cancellation_date", "reactivation_date"]},
        {"viewing": ("subscriber_id", "account", "subscriber_id")},
        "account",
    )
    inventory = {r.table_name: (r.rows, r.columns, r.distinct_ids) for r in report["inventory"].collect()}
    assert inventory["account"] == (26, 8, 25) and inventory["viewing"][0] == 400
    duplicates = {r.table_name: r for r in report["duplicates"].collect()}
    assert duplicates["account"].duplicate_rows == 0 and duplicates["account"].duplicate_keys == 1
    cleaned = profiles.raw_audit(
        P.clean_tables(tables), {n: "subscriber_id" for n in tables}, {"account": ["subscriber_id"]},
        {"account": ["acquisition_date"]}, {"viewing": ("subscriber_id", "account", "subscriber_id")}, "account",
    )
    assert cleaned["duplicates"].first().duplicate_rows == 1
    assert report["orphans"].first().unmatched_rows == 0
    assert {r.table_name: r.unknown_ids for r in report["unknown_ids"].collect()}["billing"] == 0
    dates = {(r.table_name, r.column_name): (r.parsed, r.total) for r in report["dates"].collect()}
    assert dates[("account", "acquisition_date")] == (25, 26)


def test_catalogue_loads_every_row(spark, tmp_path):
    write_rows(
        tmp_path / "viewing.csv", [f.name for f in S.PANEL_TABLES["viewing"].fields],
        [["s1", "v1", "2024-01-05 10:00:00", "c", "Film", "90", "30", "0.5", "TV", "1", "true"],
         ["s1", "v2", "2024/01/06", "c", "Film", "90", "", "0.5", "TV", "1", "false"],
         ["s1", "v3", "someday", "c", "Film", "90", "30", "0.5", "TV", "1", ""]],
    )
    tables = R.load_tables(
        spark, {"viewing": str(tmp_path / "viewing.csv")}, S.PANEL_TABLES, S.PANEL_DATE_COLUMNS, register=True
    )
    assert [r.viewing_timestamp for r in tables["viewing"].orderBy("session_id").collect()] == [
        datetime(2024, 1, 5, 10), datetime(2024, 1, 6), None,
    ]
    assert R.run_sql(spark, "SELECT * FROM viewing WHERE session_id = :s", s="v2").count() == 1


def test_stream_takes_each_file_once(spark, raw, tmp_path):
    folder, *_, logs = raw
    source, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()
    for part in (0, 1):
        (source / f"{part}.csv").write_text((folder / f"logs_{part}.csv").read_text())
    totals, batches = ingest_stream(spark, str(source), target, checkpoint, S.ACTIVITY_LOG, files_per_trigger=1)
    expected = len(logs[0::3]) + len(logs[1::3])
    assert totals.rows == expected and sum(batches) == expected and len(batches) == 2
    again, nothing = ingest_stream(spark, str(source), target, checkpoint, S.ACTIVITY_LOG, files_per_trigger=1)
    assert again == totals and nothing == []
    (source / "2.csv").write_text((folder / "logs_2.csv").read_text())
    final, added = ingest_stream(spark, str(source), target, checkpoint, S.ACTIVITY_LOG, files_per_trigger=1)
    assert final.rows == len(logs) and added == [len(logs[2::3])]


def test_stream_counts_batches_beyond_the_kept_progress(spark, raw, tmp_path):
    folder, *_, logs = raw
    source = tmp_path / "many"
    source.mkdir()
    lines = (folder / "logs_0.csv").read_text().splitlines()
    for i, line in enumerate(lines[1:8]):
        (source / f"{i}.csv").write_text(lines[0] + "\n" + line + "\n")
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        totals, batches = ingest_stream(
            spark, str(source), str(tmp_path / "o"), str(tmp_path / "c"), S.ACTIVITY_LOG, files_per_trigger=1
        )
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
    assert totals.rows == 7 and batches == [1] * 7
    by_bytes, one = ingest_stream(spark, str(source), str(tmp_path / "o2"), str(tmp_path / "c2"), S.ACTIVITY_LOG)
    assert by_bytes.rows == 7 and one == [7]
