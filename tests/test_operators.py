import json

import pytest
from pyspark.sql import functions as F

from bazaarflow.operators import cleanse, cube, quality, resolve, sales, security, warehouse
from bazaarflow.sources import files
from bazaarflow.streaming import footfall

SALE = {"transaction_id": "TXN90000001", "store_id": "ST01", "customer_id": "CUST1", "product_id": "PRD1", "quantity": "2", "unit_price": "500", "payment_method": "Cash", "payment_ref": "", "transaction_timestamp": "2024-01-05 10:00:00"}


def sale_rows(spark, *changes):
    return spark.createDataFrame([tuple((SALE | c)[k] for k in sales.COLUMNS) for c in changes], ", ".join(f"{c} string" for c in sales.COLUMNS))


@pytest.mark.parametrize(
    ("change", "rule"),
    [({"product_id": "N/A"}, "VR-008"), ({"quantity": "N/A"}, "SCHEMA_TYPE"), ({"transaction_id": "TX-77"}, "VR-004"), ({"unit_price": "UGX cheap"}, "SCHEMA_TYPE"), ({"transaction_timestamp": "31/02/2024 14:08"}, "VR-005"), ({"payment_method": "Bitcoin"}, "VR-012"), ({"unit_price": "-5"}, "VALIDITY"), ({}, None)],
)
def test_first_failing_rule(spark, change, rule):
    assert sales.parse_sales(sale_rows(spark, change)).first()["rule"] == rule


def test_mobile_money_without_reference_is_kept(spark):
    row = sales.good(sales.parse_sales(sale_rows(spark, {"payment_method": "momo"}))).first()
    assert (row.payment_ref, row.reconciliation_status) == ("PENDING_RECON", "PENDING")


def test_quarantine_and_good_rows_partition_the_input(spark):
    parsed = sales.second_copies(sales.parse_sales(sale_rows(spark, {}, {}, {"quantity": "x"}, {"transaction_id": None})))
    assert sales.good(parsed).count() + sales.quarantined(parsed).count() == 4
    assert sales.good(parsed).count() == 1


def test_replay_loads_what_is_mended(spark):
    rejects = sales.quarantined(sales.parse_sales(sale_rows(spark, {"quantity": "x"})))
    assert sales.replay(rejects).first()["rule"] == "SCHEMA_TYPE"
    mended = rejects.withColumn("source_payload", F.regexp_replace("source_payload", '"x"', '"3"'))
    assert sales.good(sales.replay(mended)).first()["quantity"] == 3
    assert json.loads(rejects.first()["source_payload"])["transaction_id"] == "TXN90000001"


def test_missing_column_stops_the_load(spark):
    with pytest.raises(ValueError, match="unit_price"):
        sales.parse_sales(sale_rows(spark, {}).drop("unit_price"))


def test_idempotent_load_and_unknown_member(spark):
    facts = spark.createDataFrame([(1, 10), (2, 20)], "sale_sk long, net long")
    once = warehouse.replace_facts(facts.limit(0), facts)
    assert sorted(map(tuple, warehouse.replace_facts(once, facts).collect())) == [(1, 10), (2, 20)]
    dimension = spark.createDataFrame([(5, "a")], "sk long, name string")
    twice = warehouse.with_unknown_member(warehouse.with_unknown_member(dimension, "sk", name="Unknown"), "sk", name="Unknown")
    assert sorted(map(tuple, twice.collect())) == [(0, "Unknown"), (5, "a")]


def test_upsert_replaces_by_key(spark):
    now, new = (spark.createDataFrame(r, "k string, v int") for r in ([("a", 1), ("b", 2)], [("b", 3), ("", 4), (None, 5)]))
    assert sorted(map(tuple, warehouse.upsert(now, new, "k").collect())) == [("a", 1), ("b", 3)]


def test_scd2_keeps_one_current_version(spark):
    day = lambda x: F.lit(x).cast("timestamp")
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    first = warehouse.first_versions(rows, ["v"], day("2024-01-01"))
    merged = warehouse.scd2_merge(first, spark.createDataFrame([(1, "z"), (2, "y"), (3, "n")], "k int, v string"), "k", ["v"], day("2024-02-01"))
    assert sorted((r.k, r.v, r.is_current) for r in merged.collect()) == [(1, "x", False), (1, "z", True), (2, "y", True), (3, "n", True)]
    assert {r.v for r in warehouse.as_of(merged, day("2024-01-15")).collect()} == {"x", "y"}
    assert warehouse.version_churn(merged, "k").first()["alert"]


def test_clusters_survivor_and_golden_map(spark):
    rows = [("C1", "Ann", "+256700000001", "valid", "", "Kampala", "2020-01-01", "F"), ("C2", "Ann B", "+256700000001", "valid", "a@b.co", "Kampala", "2021-01-01", "F"), ("C3", "Zed", "12", "invalid", "", "Gulu", "", "")]
    own = spark.createDataFrame(rows, "customer_id string, full_name string, phone_e164 string, phone_status string, email string, district string, registration_date string, gender string")
    groups = resolve.clusters(own.select(F.col("customer_id").alias("id")), resolve.phone_edges(own))
    assert {r.id: r.cluster for r in groups.collect()} == {"C1": "C1", "C2": "C1", "C3": "C3"}
    kept = resolve.survivors(own, groups)
    assert {r.customer_id: r.merged_customer_ids for r in kept.collect()} == {"C2": "C1", "C3": ""}
    bought = spark.createDataFrame([("C1", 1), ("C9", 2)], "customer_id string, n int")
    assert sorted(map(tuple, resolve.remap(bought, resolve.golden_map(kept)).select("customer_id", "n").collect())) == [("C2", 1), ("C9", 2)]


def test_fuzzy_pairs(spark):
    rows = [("C1", "John Okello", "a@x.co"), ("C2", "Okello Jon", "a@x.co"), ("C3", "okello john", "b@x.co"), ("C4", "John Okelo", ""), ("C5", "Someone Else", "")]
    own = spark.createDataFrame([(*r, "Gulu", "exact") for r in rows], "customer_id string, full_name string, email string, district string, district_status string")
    got = {(r.a, r.b): r.outcome for r in resolve.fuzzy_pairs(own).collect()}
    assert got[("C1", "C2")] == "merge" and got[("C1", "C3")] == "reject" and got[("C1", "C4")] == "review"
    assert not any("C5" in k for k in got)


def test_profile_and_monitor(spark):
    raw = spark.createDataFrame([("C1", "Ann", "+256712345678", "a@b.co", "Kampala", "2024-01-05", "M"), ("C2", "", "n/a", "bad", "", "05/01/2024", "x")], "customer_id string, full_name string, phone_number string, email string, district string, registration_date string, gender string")
    got = {r.metric: r.value for r in quality.profile_customers(raw, "2026-10-05").collect()}
    assert got["present_full_name_pct"] == 50.0 and got["phone_e164_pct"] == 50.0 and got["date_formats"] == 2.0 and got["composite_pct"] == 50.0
    seen = quality.monitor(spark.createDataFrame([("DQC-01", 2.5), ("DQC-02", 98.0), ("DQC-10", 0.0)], "check_id string, value double"))
    assert {r.check_id: r.status for r in seen.collect()} == {"DQC-01": "P1", "DQC-02": "ALERT", "DQC-10": "OK"}
    before, after = (spark.createDataFrame(r, "dimension string, metric string, value double") for r in ([("a", "phone_e164_pct", 10.0), ("a", "unit_labels", 9.0)], [("a", "phone_e164_pct", 60.0), ("a", "unit_labels", 3.0)]))
    assert {r.status for r in quality.compare_profiles(before, after).collect()} == {"Improved"}


CASES = [("store_cashier", "customers", "S", False), ("store_cashier", "financial_reports", "S", False), ("store_cashier", "sales", "I", True), ("store_cashier", "sales", "U", False), ("store_manager", "sales", "U", True), ("data_analyst", "customers", "S", False), ("compliance_officer", "customers", "S", True), ("compliance_officer", "sales", "U", False), ("cdm_admin", "customers", "D", True), ("nobody", "sales", "S", False)]


@pytest.mark.parametrize(("role", "name", "operation", "allowed"), CASES)
def test_privileges(role, name, operation, allowed):
    if allowed:
        security.authorise(role, name, operation)
    else:
        with pytest.raises(security.AccessDenied):
            security.authorise(role, name, operation)


def test_rows_and_columns_by_role(spark):
    finance = spark.createDataFrame([(1, "2024-01-01", "ST01", 1, 1, 1, 9, "n"), (2, "2024-01-01", "ST17", 1, 1, 1, 9, "n")], "report_id int, report_month string, store_id string, gross_sales_ugx int, cogs_ugx int, gross_margin_ugx int, payroll_ugx int, notes string")
    assert security.secure(finance, "data_analyst", "financial_reports").columns == security.FINANCE
    with pytest.raises(security.AccessDenied):
        security.secure(finance, "data_analyst", "financial_reports", columns=["payroll_ugx"])
    assert security.secure(finance, "store_manager", "financial_reports", store="ST17").count() == 1
    assert security.secure(finance, "store_manager", "financial_reports", store="ST07").count() == 0


def test_products_split(spark):
    raw = spark.createDataFrame([("P1", "AB1", "x", "snack", "kg", "10", "5"), ("", "AB1", "y", "", "", "", "")], "product_id string, sku string, product_name string, category string, unit_of_measure string, cost_ugx string, selling_price_ugx string")
    kept, bad = cleanse.split(cleanse.cleanse_products(raw), "bad_key")
    assert (kept.count(), bad.count()) == (1, 1)
    assert kept.first()["margin_anomaly"] and kept.first()["duplicate_sku"]


EVENTS = [
    ("E1", "S1", "ST07", "K", "2026-03-07T09:00:03+03:00", "entrance", "in", 14, 12, 1, "ok"),
    ("E2", "S1", "ST07", "K", "2026-03-07T09:01:03+03:00", "exit", "out", 4, 10, 2, "ok"),
    ("E2b", "S1", "ST07", "K", "2026-03-07T09:01:04+03:00", "exit", "out", 4, 10, 2, "ok"),
    ("E3", "S1", "ST07", "K", "2026-03-07T09:20:00+03:00", "till", "in", None, 10, 3, "ok"),
    ("E4", "S2", "ST07", "K", "2026-03-07T10:00:00+03:00", "till", "in", 5, 10, 9, "suspect"),
    ("E5", "S2", "ST07", "K", "2026-03-07T10:00:00+03:00", "till", "in", 5, 10, 10, "ok"),
]


def test_footfall_batch_and_stream_agree(spark, tmp_path):
    names = [x.split()[0] for x in footfall.EVENT.split(", ")]
    records = [dict(zip(names, e, strict=True)) for e in EVENTS]
    (tmp_path / "one.json").write_text(json.dumps({"_comment": "x", "events": records}))
    batch = footfall.read_events(spark, str(tmp_path / "one.json"))
    kept = footfall.distinct_events(footfall.accepted(batch))
    assert kept.count() == 3 and footfall.rejected(batch).count() == 2
    want = sorted((r.store_id, r.events, r.entered, r.left, r.moves) for r in footfall.windows(kept).collect())
    assert want == [("ST07", 1, 0, 0, 5), ("ST07", 2, 14, 4, 18)]
    assert [(r.after_seq, r.next_seq, r.missing) for r in footfall.gaps(kept).collect()] == [(2, 10, 7)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, records)))
    stream = footfall.distinct_events(footfall.accepted(footfall.stream_events(spark, str(tmp_path / "in"))))
    footfall.run_available(stream, "kept", str(tmp_path / "cp"))
    assert spark.table("kept").count() == 3


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,\n")
    df = files.read_text_csv(spark, files.preferred(spark, str(tmp_path / "none.csv"), str(tmp_path / "a.csv")), ["x", "y"])
    assert map(tuple, df.collect()) and tuple(df.first()) == ("1", "")
    assert files.to_markdown(df).startswith("| x | y |") and json.loads(files.to_json(df)) == [{"x": "1", "y": ""}]
    files.land(df, str(tmp_path / "raw"), "r1")
    files.land(df, str(tmp_path / "raw"), "r2")
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 2
    with pytest.raises(FileNotFoundError):
        files.preferred(spark, str(tmp_path / "no"))


def test_control_total_guard(spark):
    lines = spark.sql("select cast(5 as decimal(14,4)) amount")
    cube.guarded_total(lines, "5.0000")
    with pytest.raises(ValueError, match="control total"):
        cube.guarded_total(lines, "6.0000")


def test_single_writer(tmp_path):
    with warehouse.single_writer(str(tmp_path / "lock")), pytest.raises(BlockingIOError), warehouse.single_writer(str(tmp_path / "lock")):
        pass


def test_rule_catalogue_counts_every_rule(spark):
    cols = "customer_id string, full_name string, phone_e164 string, phone_status string, email string, district_status string, registration_date string"
    good = ("valid", "a@b.co", "exact", "2024-01-01")
    people = [("C1", "Ann Lee", "+1", *good), ("C1", "Bo Lee", "+1", *good), ("C2", "X", "+2", *good), ("C3", "R2 D2", "+3", *good), ("", "Cy Lee", "+4", "invalid", "x", "unresolved", "1999-01-01"), (None, None, "", "missing", "", "exact", "2024-01-01")]
    customers = spark.createDataFrame(people, cols)
    products = spark.createDataFrame([("s1", "kg", "Snacks", False, False), ("s2", "kg", "Snacks", False, True), ("s2", "box", "Toys", True, True), ("", None, "Snacks", False, False)], "sku string, unit_of_measure string, category string, margin_anomaly boolean, duplicate_sku boolean")
    sold = spark.createDataFrame([("MTN_MOMO", "R1", "MATCHED"), ("MTN_MOMO", "", "MATCHED"), ("MTN_MOMO", "PENDING_RECON", "PENDING"), ("CASH", "", "NOT_REQUIRED")], "payment_method string, payment_ref string, reconciliation_status string")
    got = {r.rule: r.violations for r in quality.catalogue_violations(customers, products, sold, customers, "2026-01-01").collect()}
    assert got == {"VR-001": 1, "VR-002": 1, "VR-003": 1, "VR-004": 4, "VR-005": 1, "VR-006": 3, "VR-007": 2, "VR-008": 3, "VR-009": 2, "VR-010": 1, "VR-011": 1, "VR-012": 1}
    queue = spark.createDataFrame([("C1",)], "customer_id string")
    assert {r.rule: r.violations for r in quality.catalogue_violations(customers, products, sold, customers, "2026-01-01", queue).collect()}["VR-007"] == 0
    empty = quality.catalogue_violations(*(df.limit(0) for df in (customers, products, sold, customers)), "2026-01-01").collect()
    assert len(empty) == 12 and not any(r.violations for r in empty)


def test_near_labels_are_matched_once_each(spark):
    raw = spark.createDataFrame([(k, x, "unresolved") for k, x in enumerate(["Mukonno", "kampala road", "Nowhere", "Mukonno"])] + [(9, "Kampala", "exact"), (10, None, "missing")], "k int, v string, s string")
    got = {r.k: (r.v, r.s) for r in cleanse.with_near_labels(raw, "v", "s", ["Kampala", "Mukono"], 88).collect()}
    assert got == {0: ("Mukono", "fuzzy_mapped"), 1: ("Kampala", "fuzzy_mapped"), 2: ("Nowhere", "unresolved"), 3: ("Mukono", "fuzzy_mapped"), 9: ("Kampala", "exact"), 10: (None, "missing")}


def test_second_copies_leave_rejects_alone(spark):
    row = lambda t, p: (t, "ST01", "C1", "P1", "1", p, "cash", "", "2024-01-05 10:00:00")
    raw = spark.createDataFrame([row("TXN000001", "5"), row("TXN000001", "5"), row("", "5"), row("", "5")], ", ".join(f"{c} string" for c in sales.COLUMNS))
    got = sorted((r.transaction_id, r.rule or "") for r in sales.second_copies(sales.parse_sales(raw)).collect())
    assert got == [("", "VR-004"), ("", "VR-004"), ("TXN000001", ""), ("TXN000001", "DUPLICATE")]


def test_settled_rejects_can_be_loaded(spark):
    row = ("TXN000001", "ST01", "C1", "P1", "1", "cheap", "cash", "", "2024-01-05 10:00:00")
    rejects = sales.quarantined(sales.parse_sales(spark.createDataFrame([row, ("bad", *row[1:])], ", ".join(f"{c} string" for c in sales.COLUMNS))))
    mended = rejects.withColumn("source_payload", F.replace("source_payload", F.lit("cheap"), F.lit("12")))
    load, after = sales.settle(mended)
    assert [(r.transaction_id, float(r.net_amount_ugx)) for r in load.collect()] == [("TXN000001", 12.0)]
    assert sorted(r.replayed for r in after.collect()) == [False, True] and sales.settle(after)[0].count() == 0


def test_inserts_of_own_store_only(spark):
    rows = spark.createDataFrame([("ST07",), ("ST08",)], "store_id string")
    assert security.insertable(rows.where("store_id = 'ST07'"), "store_cashier", "sales", "ST07").count() == 1
    with pytest.raises(security.AccessDenied):
        security.insertable(rows, "store_cashier", "sales", "ST07")
    with pytest.raises(security.AccessDenied):
        security.insertable(rows, "data_analyst", "sales", "ST07")


def test_review_flags_and_statistics(spark):
    customers = spark.createDataFrame([("a",), ("b",), ("c",)], "customer_id string")
    surviving = spark.createDataFrame([("a", "b"), ("c", "")], "customer_id string, merged_customer_ids string")
    reviews = spark.createDataFrame([("a", "c")], "a string, b string")
    got = {r.metric: r.value for r in resolve.statistics(customers, surviving, reviews).collect()}
    assert got == {"input_rows": 3, "surviving_rows": 2, "merged_rows": 1, "clusters": 1, "open_review_pairs": 1, "rows_flagged_for_review": 2}


def test_email_pattern_and_weighted_similarity():
    import re

    from bazaarflow.functions import similarity, standardize

    assert [bool(re.fullmatch(standardize.EMAIL, x)) for x in ("a.b@x.co.ug", "a#@x.com", "é@x.com", "u@host")] == [True, False, False, False]
    assert similarity.weighted_ratio("kampala road", "kampala") == pytest.approx(90)
    assert similarity.weighted_ratio("mukonno", "mukono") == pytest.approx(1200 / 13)
    assert similarity.token_set_ratio("fort portal", "portal fort town") == 100 and similarity.weighted_ratio("", "x") == 0
