"""Quality profiles, rules and monitoring. A profile is one pass of aggregates, unpivoted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import standardize as S
from ..functions.reference_data import CATEGORIES, MOBILE_MONEY, UNITS

CUSTOMER_FIELDS = ["full_name", "phone_number", "email", "district", "registration_date", "gender"]
PRODUCT_FIELDS = ["sku", "product_name", "category", "unit_of_measure", "cost_ugx", "selling_price_ugx"]


def _filled(c: str) -> Column:
    return S.stripped(F.col(c)) != ""


def _percent(condition: Column) -> Column:
    n = F.count(F.lit(1))
    return F.coalesce(F.round(F.count_if(condition).cast("decimal(20,0)") * 100 / F.nullif(n, F.lit(0)), 2).cast("double"), F.lit(0.0))


def _long(df: DataFrame, measures: dict[tuple[str, str], Column]) -> DataFrame:
    names = {f"m{k}": key for k, key in enumerate(measures)}
    wide = df.agg(*[m.cast("double").alias(n) for n, m in zip(names, measures.values(), strict=True)])
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(m).alias("metric"), F.col(n).alias("value")) for n, (d, m) in names.items()])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def profile_customers(raw: DataFrame, today: str) -> DataFrame:
    day, phone, district = S.date(F.col("registration_date")), S.phone(F.col("phone_number")), S.district(F.col("district"))
    parsed = F.when(~day["status"].isin("missing", "unparseable"), day["value"].try_cast("date"))
    now = F.lit(today).cast("date")
    plain = {c: S.stripped(F.col(c)) for c in CUSTOMER_FIELDS}
    e164, mail = plain["phone_number"].rlike(S.E164), (plain["email"] == "") | plain["email"].rlike(S.EMAIL)
    sex = plain["gender"].isin("M", "F", "Male", "Female")
    measures = {("Uniqueness", "unique_customer_id_pct"): F.round(F.count_distinct("customer_id").cast("decimal(20,0)") * 100 / F.nullif(F.count(F.lit(1)), F.lit(0)), 2)}
    measures |= {("Completeness", f"present_{c}_pct"): _percent(_filled(c)) for c in CUSTOMER_FIELDS}
    cells = sum((F.count_if(_filled(c)) for c in CUSTOMER_FIELDS), F.lit(0))
    measures |= {
        ("Completeness", "cells_pct"): F.round(cells.cast("decimal(20,0)") * 100 / F.nullif(F.count(F.lit(1)) * len(CUSTOMER_FIELDS), F.lit(0)), 2),
        ("Consistency", "phone_formats"): F.count_distinct(F.nullif(S.phone_format(F.col("phone_number")), F.lit("missing"))),
        ("Consistency", "date_formats"): F.count_distinct(F.nullif(day["status"], F.lit("missing"))),
        ("Consistency", "iso_dates_pct"): _percent(day["status"] == "%Y-%m-%d"),
        ("Consistency", "district_labels"): F.count_distinct(F.nullif(plain["district"], F.lit(""))),
        ("Consistency", "gender_labels"): F.count_distinct(F.nullif(plain["gender"], F.lit(""))),
        ("Timeliness", "date_parseable_pct"): _percent(parsed.isNotNull()),
        ("Timeliness", "not_in_future_pct"): _percent(parsed <= now),
        ("Timeliness", "last_four_years_pct"): _percent((parsed >= F.date_sub(now, 1461)) & (parsed <= now)),
        ("Accuracy", "district_official_pct"): _percent(district["status"].isin("exact", "exact_remapped")),
        ("Accuracy", "phone_plausible_pct"): _percent(phone["status"] == "valid"),
        ("Accuracy", "gender_canonical_pct"): _percent(plain["gender"].isin("M", "F", "")),
        ("Validity", "phone_e164_pct"): _percent(e164),
        ("Validity", "email_pct"): _percent(mail),
        ("Validity", "date_pct"): _percent(day["value"] != ""),
        ("Validity", "date_strict_pct"): _percent(parsed.isNotNull()),
        ("Validity", "gender_pct"): _percent(sex),
        ("Validity", "composite_pct"): _percent(e164 & mail & (day["value"] != "") & sex),
    }
    copies = _copied(raw, CUSTOMER_FIELDS).select(F.lit("Uniqueness").alias("dimension"), F.lit("exact_duplicates_pct").alias("metric"), "value")
    main = dominant_phone_format(raw).select(F.lit("Consistency").alias("dimension"), F.lit("dominant_phone_format_pct").alias("metric"), F.coalesce("share_pct", F.lit(0.0)).alias("value"))
    return _long(raw, measures).unionByName(copies).unionByName(main)


def _copied(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows that agree with another in all columns."""
    groups = raw.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.round(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).cast("decimal(20,0)") * 100 / F.nullif(F.sum("n"), F.lit(0)), 2), F.lit(0)).cast("double").alias("value"))


def dominant_phone_format(raw: DataFrame) -> DataFrame:
    """The most frequent format and its share of all rows; missing phones are no format but count among the rows."""
    own = raw.groupBy(S.phone_format(F.col("phone_number")).alias("format")).agg(F.count(F.lit(1)).alias("n"))
    best = own.agg(F.max_by("format", F.when(F.col("format") != "missing", F.struct("n", "format"))).alias("format"), F.max(F.when(F.col("format") != "missing", F.col("n"))).alias("n"), F.sum("n").alias("total"))
    return best.select("format", F.round(F.col("n").cast("decimal(20,0)") * 100 / F.nullif("total", F.lit(0)), 2).cast("double").alias("share_pct"))


def profile_products(raw: DataFrame) -> DataFrame:
    cost, sell = S.price(F.col("cost_ugx"))["value"], S.price(F.col("selling_price_ugx"))["value"]
    plain = {c: S.stripped(F.col(c)) for c in [*PRODUCT_FIELDS, "product_id"]}
    unit, category, sku = plain["unit_of_measure"].isin(list(UNITS)), plain["category"].isin(list(CATEGORIES)), plain["sku"].rlike(S.SKU)
    measures = {("Uniqueness", "product_id_present_pct"): _percent(~plain["product_id"].isin("", "nan"))}
    measures |= {("Completeness", f"present_{c}_pct"): _percent(_filled(c)) for c in PRODUCT_FIELDS}
    measures |= {
        ("Consistency", "unit_labels"): F.count_distinct(plain["unit_of_measure"]),
        ("Consistency", "category_labels"): F.count_distinct(plain["category"]),
        ("Consistency", "currency_strings_pct"): _percent(F.coalesce(F.col("selling_price_ugx"), F.lit("")).rlike("(?i)ugx|,")),
        ("Timeliness", "refreshable_pct"): _percent(F.col("product_id").isNotNull() & (plain["sku"] != "")),
        ("Accuracy", "below_cost_pct"): _percent(sell < cost),
        ("Accuracy", "prices_numeric_pct"): _percent(sell.isNotNull() & cost.isNotNull()),
        ("Accuracy", "prices_not_negative_pct"): _percent((sell >= 0) & (cost >= 0)),
        ("Validity", "unit_pct"): _percent(unit),
        ("Validity", "category_pct"): _percent(category),
        ("Validity", "sku_pct"): _percent(sku),
        ("Validity", "composite_pct"): _percent(unit & category & sku & sell.isNotNull()),
        ("Completeness", "cells_pct"): F.round(sum((F.count_if(_filled(c)) for c in PRODUCT_FIELDS), F.lit(0)).cast("decimal(20,0)") * 100 / F.nullif(F.count(F.lit(1)) * len(PRODUCT_FIELDS), F.lit(0)), 2),
    }
    groups = raw.select(plain["sku"].alias("sku"), "product_name").groupBy("sku").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("product_name").alias("names"))
    shared = groups.agg(F.coalesce(F.sum(F.when((F.col("n") > 1) & ~F.col("sku").isin("", "nan"), F.col("n"))), F.lit(0)).cast("double").alias("a"), F.count_if((F.col("names") > 1) & (F.col("sku") != "")).cast("double").alias("b"))
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(m).alias("metric"), F.col(c).alias("value")) for d, m, c in (("Uniqueness", "duplicate_sku_rows", "a"), ("Consistency", "sku_multi_name", "b"))])
    copies = _copied(raw, PRODUCT_FIELDS).select(F.lit("Uniqueness").alias("dimension"), F.lit("exact_duplicates_pct").alias("metric"), "value")
    return _long(raw, measures).unionByName(shared.select(F.explode(rows).alias("r")).select("r.*")).unionByName(copies)


def compare_profiles(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both values, the change and what it means."""
    met = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), ["dimension", "metric"]).withColumn("delta", F.round(F.col("after") - F.col("before"), 2))
    falling = F.col("metric").rlike("labels|formats|below_cost|currency|duplicate")
    better = F.when(falling, F.col("delta") < 0).otherwise(F.col("delta") > 0)
    status = (
        F.when(F.col("metric").contains("below_cost"), "Flagged (manual)")
        .when(F.col("metric").contains("four_years"), "Monitored")
        .when(F.col("metric").contains("sku") & (F.col("delta") == 0), "Flagged (stewardship)")
        .when(F.col("delta") == 0, "No change")
        .when(~better & (F.abs("delta") < 0.5) & F.col("metric").endswith("_pct"), "Stable")
        .when(better, "Improved")
        .otherwise("Regressed")
    )
    return met.withColumn("status", status)


def customer_rules(today: str) -> dict[str, Column]:
    """What a row of cleansed customers must satisfy, by rule."""
    day = F.col("registration_date").try_cast("date")
    return {
        "VR-001": F.col("phone_status").isin("valid", "missing"),
        "VR-002": ~F.col("district_status").isin("unresolved"),
        "VR-003": (F.col("email") == "") | F.col("email").rlike(S.EMAIL),
        "VR-005": day.between(F.lit("2000-01-01").cast("date"), F.lit(today).cast("date")),
        "VR-006": (F.length(F.trim("full_name")) >= 2) & F.col("full_name").rlike(r"\A[A-Za-z .-]+\z"),
    }


def _repeats(df: DataFrame, key: str, counted: Column, missing: Column | None = None) -> DataFrame:
    """Number of counted rows whose key another counted row has too, and of rows without a key where missing is given."""
    groups = df.where(counted).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    bad = F.col("n") > 1 if missing is None else (F.col("n") > 1) | missing
    return groups.agg(F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("violations"))


def catalogue_violations(customers: DataFrame, products: DataFrame, sales: DataFrame, golden: DataFrame, today: str, reviewed: DataFrame | None = None) -> DataFrame:
    """rule, severity, violations for the whole catalogue VR-001 to VR-012, in the reference's conditions and severities.

    Cleansed customers and products, parsed sales, surviving customers; reviewed: customer_id of those in the review queue.
    """
    fails = lambda df, oks: df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(r) for r, ok in oks.items()])
    own = customer_rules(today)
    ware = {
        "VR-008": ~F.lower("sku").isin("", "nan") & ~F.col("duplicate_sku"),
        "VR-009": F.col("unit_of_measure").isin(list(UNITS)),
        "VR-010": F.col("category").isin(list(CATEGORIES)),
        "VR-011": ~F.col("margin_anomaly"),
    }
    paid = ~F.coalesce("payment_ref", F.lit("")).isin("", "nan", "None", "PENDING_RECON") | F.coalesce(F.col("reconciliation_status") == "PENDING", F.lit(False))
    parts = [(customers, own), (products, ware), (sales, {"VR-012": ~F.coalesce(F.col("payment_method").isin(MOBILE_MONEY), F.lit(False)) | paid})]
    if reviewed is not None:
        golden = golden.join(reviewed.select("customer_id").distinct(), "customer_id", "left_anti")
    missing = F.coalesce(F.col("customer_id"), F.lit("")) == ""
    found = _repeats(customers, "customer_id", F.lit(True), missing).select(F.lit("VR-004").alias("rule"), "violations")
    found = found.unionByName(_repeats(golden, "phone_e164", F.col("phone_status") == "valid").select(F.lit("VR-007").alias("rule"), "violations"))
    for df, oks in parts:
        rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations")) for r in oks])
        found = found.unionByName(fails(df, oks).select(F.explode(rows).alias("r")).select("r.*"))
    severity = F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair])
    return found.select("rule", severity[F.col("rule")].alias("severity"), "violations")


#: Severity of each rule of the reference's catalogue.
SEVERITIES = {f"VR-{k:03d}": s for k, s in enumerate(("high", "medium", "medium", "critical", "high", "medium", "critical", "critical", "high", "high", "medium", "high"), 1)}


# Monitored measures with their alert and, where there is one, incident limits.
LIMITS = {
    "DQC-01": (">", 1.0, 2.0),
    "DQC-02": ("<", 99.0, None),
    "DQC-03": ("<", 99.5, None),
    "DQC-03-label": (">", 50.0, None),
    "DQC-04-phone": ("<", 92.0, None),
    "DQC-04-email": ("<", 85.0, None),
    "DQC-04-district": ("<", 99.0, None),
    "DQC-05": ("<", 99.0, None),
    "DQC-06": (">", 0.0, None),
    "DQC-07": (">", 0.5, None),
    "DQC-07-rows": (">", 100.0, None),
    "DQC-08": (">", 0.0, 50.0),
    "DQC-09": (">", 0.0, None),
    "DQC-10": (">", 0.0, 25.0),
}


def measures(customers: DataFrame, products: DataFrame, parsed: DataFrame, surviving: DataFrame, today: str, reviewed: DataFrame | None = None) -> DataFrame:
    """check_id, value of every monitored measure: cleansed customers and products, parsed sales, surviving customers, those in review."""
    n = F.count(F.lit(1))
    share = lambda part, whole: F.coalesce(F.round(F.count_if(part).cast("decimal(20,0)") * 100 / F.nullif(F.count_if(whole), F.lit(0)), 4).cast("double"), F.lit(100.0))
    every = F.lit(True)
    pending = (F.col("reconciliation_status") == "PENDING") & (F.col("sold_at") < F.lit(today).cast("timestamp") - F.expr("INTERVAL 24 HOURS"))
    whole = {
        "DQC-02": (customers, share(F.col("phone_e164").rlike(S.E164), F.col("phone_status") != "missing")),
        "DQC-03": (customers, share(~F.col("district_status").isin("missing", "unresolved"), F.col("district_status") != "missing")),
        "DQC-04-phone": (customers, share(F.col("phone_status") != "missing", every)),
        "DQC-04-email": (customers, share(F.col("email") != "", every)),
        "DQC-04-district": (customers, share(F.col("district_status") != "missing", every)),
        "DQC-05": (products, share(F.col("unit_of_measure").isin(list(UNITS)) & F.col("category").isin(list(CATEGORIES)), every)),
        "DQC-07": (parsed, F.coalesce(F.round(F.count_if(F.col("rule").isNotNull()).cast("decimal(20,0)") * 100 / F.nullif(n, F.lit(0)), 4), F.lit(0)).cast("double")),
        "DQC-07-rows": (parsed, F.count_if(F.col("rule").isNotNull()).cast("double")),
        "DQC-08": (parsed, F.count_if(F.col("rule").isNull() & pending).cast("double")),
        "DQC-09": (customers, F.count_if(~F.coalesce(customer_rules(today)["VR-005"], F.lit(False))).cast("double")),
        "DQC-10": (products, F.count_if("margin_anomaly").cast("double")),
    }
    out = None
    for df in (customers, products, parsed):  # one pass over each
        own = {k: v for k, (d, v) in whole.items() if d is df}
        rows = F.array(*[F.struct(F.lit(k).alias("check_id"), F.col(f"`{k}`").alias("value")) for k in own])
        part = df.agg(*[v.alias(k) for k, v in own.items()]).select(F.explode(rows).alias("r")).select("r.*")
        out = part if out is None else out.unionByName(part)
    label = customers.where("district_status = 'unresolved'").groupBy("district").agg(n.alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).cast("double").alias("value"))
    skus = products.where("sku not in ('', 'nan') and product_id <> ''").groupBy("sku").agg(F.count_distinct("product_id").alias("n")).agg(F.count_if(F.col("n") > 1).cast("double").alias("value"))
    merged = customers.select(F.lit(1).alias("all"), F.lit(0).alias("left")).unionAll(surviving.select(F.lit(0), F.lit(1)))
    if reviewed is not None:
        merged = merged.unionAll(reviewed.select(F.lit(0), F.lit(-1)))
    people = merged.agg(F.coalesce(F.round((F.sum("all") - F.sum("left")).cast("decimal(20,0)") * 100 / F.nullif(F.sum("all"), F.lit(0)), 4), F.lit(0)).cast("double").alias("value"))
    for check, df in (("DQC-01", people), ("DQC-03-label", label), ("DQC-06", skus)):
        out = out.unionByName(df.select(F.lit(check).alias("check_id"), "value"))
    return out


def monitor(measures: DataFrame) -> DataFrame:
    """measures (check_id, value) with status OK, ALERT or P1."""
    limits = measures.sparkSession.createDataFrame([(k, *v) for k, v in LIMITS.items()], "check_id string, side string, alert double, incident double")
    over = lambda limit: F.when(F.col("side") == ">", F.col("value") > F.col(limit)).otherwise(F.col("value") < F.col(limit))
    return measures.join(F.broadcast(limits), "check_id").select("check_id", "value", F.when(F.coalesce(over("incident"), F.lit(False)), "P1").when(over("alert"), "ALERT").otherwise("OK").alias("status"))
