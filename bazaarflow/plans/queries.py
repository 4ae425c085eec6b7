"""One query for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masking
from ..functions import standardize as S
from ..functions.reference_data import CATEGORIES, DISTRICTS
from ..operators import analytics as A
from ..functions.keys import surrogate_key
from ..operators import board, cleanse, cube, migration, quality, resolve, sales, security, star, warehouse
from ..sources import generate
from ..streaming import footfall
from .inputs import DIRTY_CUSTOMERS, DIRTY_PRODUCTS, DIRTY_SALES, load, sale_lines
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]
TODAY = "2026-10-05"
CUSTOMER_COLUMNS = ["customer_id", "full_name", "phone_e164", "phone_status", "email", "district", "district_status", "registration_date", "date_format_original", "gender", "gender_status"]
PRODUCT_COLUMNS = ["product_id", "sku", "product_name", "unit_of_measure", "unit_status", "category", "category_status", "cost_ugx", "selling_price_ugx", "price_status", "margin_anomaly", "duplicate_sku", "bad_key"]


def on_lines(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: report(sale_lines(spark, d))


def standard(sql: str, keys: list[str], column: str, function, near: tuple[list[str], float] | None = None) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = function(F.col(column))
        done = load(spark, d, sql).select(*keys, F.col(column).alias("raw"), out["value"].alias("value"), out["status"].alias("status"))
        return cleanse.with_near_labels(done, "value", "status", *near) if near else done

    return run


def raw_customers(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, DIRTY_CUSTOMERS)


def clean_customers(spark: SparkSession, d: str) -> DataFrame:
    return cleanse.cleanse_customers(raw_customers(spark, d))


def clean_products(spark: SparkSession, d: str) -> DataFrame:
    return cleanse.cleanse_products(load(spark, d, DIRTY_PRODUCTS))


def parsed_sales(spark: SparkSession, d: str) -> DataFrame:
    return sales.parse_sales(load(spark, d, DIRTY_SALES))


def facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return sales.fact_sales(parsed_sales(spark, d), warehouse.customer_dimension(clean_customers(spark, d)), warehouse.product_dimension(cleanse.split(clean_products(spark, d), "bad_key")[0]))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def mask_all(spark: SparkSession, d: str) -> DataFrame:
    return raw_customers(spark, d).select("customer_id", masking.mask_name(F.col("full_name")).alias("name"), masking.mask_phone(F.col("phone_number")).alias("phone"), masking.mask_email(F.col("email")).alias("email"))


def load_checks(spark: SparkSession, d: str) -> DataFrame:
    customers = warehouse.with_unknown_member(warehouse.customer_dimension(clean_customers(spark, d)), "customer_sk", full_name="Walk-in")
    products = warehouse.product_dimension(cleanse.split(clean_products(spark, d), "bad_key")[0])
    loaded, orphans = facts(spark, d)
    staged = loaded.select("net_amount_ugx").unionAll(orphans.select(F.lit(0).cast("decimal(18,2)"))).agg(F.sum("net_amount_ugx"))
    return warehouse.load_checks(loaded, customers, products, staged)


def idempotent_load(spark: SparkSession, d: str) -> DataFrame:
    """Two batches that overlap, the second loaded twice: amounts of the second count where both have a transaction."""
    own = warehouse.kept(facts(spark, d)[0].select("sale_sk", "net_amount_ugx"))
    first = own.where("sale_sk % 3 <> 0")
    second = own.where("sale_sk % 3 <> 1").withColumn("net_amount_ugx", (F.col("net_amount_ugx") + 1).cast("decimal(18,2)"))
    loaded = warehouse.replace_facts(warehouse.replace_facts(first, second), second)
    return loaded.agg(F.count(F.lit(1)).alias("n"), F.sum("net_amount_ugx").alias("total"))


def denormalised(spark: SparkSession, d: str) -> DataFrame:
    customers, products = warehouse.customer_dimension(clean_customers(spark, d)), warehouse.product_dimension(cleanse.split(clean_products(spark, d), "bad_key")[0])
    return warehouse.denormalised(facts(spark, d)[0], customers, products).groupBy("category_label", "customer_district").agg(F.count(F.lit(1)).alias("n"))


def phone_clusters(spark: SparkSession, d: str) -> DataFrame:
    own = clean_customers(spark, d)
    return resolve.clusters(own.select(F.col("customer_id").alias("id")), resolve.phone_edges(own))


def survivors(spark: SparkSession, d: str) -> DataFrame:
    return resolve.survivors(clean_customers(spark, d), phone_clusters(spark, d)).select("cluster", "customer_id", "merged_customer_ids")


def surviving(customers: DataFrame) -> DataFrame:
    return resolve.survivors(customers, resolve.clusters(customers.select(F.col("customer_id").alias("id")), resolve.phone_edges(customers)))


def rule_violations(spark: SparkSession, d: str) -> DataFrame:
    own = clean_customers(spark, d)
    return quality.catalogue_violations(own, clean_products(spark, d), parsed_sales(spark, d).where("rule is null"), surviving(own), TODAY)


def monitoring(spark: SparkSession, d: str) -> DataFrame:
    own = clean_customers(spark, d)
    return quality.monitor(quality.measures(own, clean_products(spark, d), parsed_sales(spark, d), surviving(own), TODAY))


def compare_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Customers before and after cleansing, by the same profile."""
    after = clean_customers(spark, d).withColumn("phone_number", F.col("phone_e164"))
    return quality.compare_profiles(quality.profile_customers(raw_customers(spark, d), TODAY), quality.profile_customers(after, TODAY))


def fuzzy_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Per customer its class of equal names and the number of its pairs by outcome; resolve.fuzzy_pairs() has the pairs themselves."""
    return resolve.fuzzy_links(clean_customers(spark, d))


def name_pairs(spark: SparkSession, d: str) -> DataFrame:
    return resolve.near_keys(table(spark, d, "supplier"), "s_nationkey", "s_suppkey", "s_name")


def versions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    start, change = (F.lit(x).cast("timestamp") for x in ("2024-01-01", "2024-06-01"))
    now = warehouse.first_versions(rows, ["segment"], start)
    later = rows.withColumn("segment", F.when(F.col("c_custkey") % 5 == 0, F.concat(F.upper("segment"), F.lit("!"))).otherwise(F.col("segment")))
    return warehouse.scd2_merge(now, later, "c_custkey", ["segment"], change)


def scd2_apply(spark: SparkSession, d: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return versions(spark, d).select("c_custkey", "segment", day("valid_from"), day("valid_to"), "is_current")


def scd2_asof(spark: SparkSession, d: str) -> DataFrame:
    sold = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 2 == 1, F.lit("2024-08-01")).otherwise(F.lit("2024-03-01")).cast("timestamp").alias("ts"))
    return warehouse.point_in_time(sold, versions(spark, d), "c_custkey", "ts").groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


def dim_date(spark: SparkSession, d: str) -> DataFrame:
    days = warehouse.dim_date(spark, "2024-01-01", "2025-12-31", {"2024-01-01": "New Year", "2025-01-01": "New Year"})
    return days.drop("holiday_name").withColumn("calendar_date", F.col("calendar_date").cast("string"))


def role_store_rows(spark: SparkSession, d: str) -> DataFrame:
    return security.secure(security.sales_masked(sale_lines(spark, d)), "store_cashier", "sales_masked", store="ST07").groupBy("store_id").agg(F.count(F.lit(1)).alias("n"))


def sensor_events(spark: SparkSession, d: str) -> DataFrame:
    way = F.when(F.col("event_type") == "click", "in").otherwise("out")
    zone = F.when(F.col("event_id") % 3 == 0, "aisle").when(way == "in", "entrance").otherwise("exit")
    return table(spark, d, "events").select(
        F.concat(F.lit("U"), (F.col("user_id") % 24).cast("string")).alias("store_id"), F.col("ts").cast("timestamp").alias("ts"), zone.alias("zone"), way.alias("direction"), (F.col("event_id") % 4).cast("int").alias("count"), (F.col("event_id") % 90).cast("int").alias("dwell_seconds")
    )


def footfall_windows(spark: SparkSession, d: str) -> DataFrame:
    return footfall.windows(sensor_events(spark, d)).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def distinct_events(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").select(F.col("user_id").alias("sensor_id"), F.floor("value").cast("int").alias("edge_seq"), "ts", "event_id")
    return footfall.distinct_events(own.withColumn("ts", F.col("event_id"))).select(F.col("sensor_id").alias("user_id"), F.col("edge_seq").alias("v"), "event_id")


def sliding_24h(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events")
    return own.select("event_id", footfall.sliding_counts(own, "user_id", "ts", 86_400).alias("n"))


def trade_area(spark: SparkSession, d: str) -> DataFrame:
    homes = clean_customers(spark, d).select((F.substring("customer_id", 5, 12).cast("bigint") - 100_000).alias("customer_sk"), "district")
    return A.trade_area(sale_lines(spark, d), homes)


def repeated_reference_windows(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").select(F.concat(F.lit("R"), (F.col("user_id") % 300).cast("string")).alias("payment_ref"), F.concat(F.lit("U"), (F.col("event_id") % 24).cast("string")).alias("store_id"), F.col("ts").cast("timestamp").alias("ts"))
    return footfall.shared_references(own).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def on_hand(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    count, receipts = parts.select("p_partkey", F.lit(100).cast("bigint").alias("quantity")), parts.select("p_partkey", F.col("p_size").cast("bigint").alias("quantity"))
    sold = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("int").cast("bigint").alias("quantity"))
    return footfall.on_hand(count, sold, receipts, "p_partkey")


#: Regions for the district dimension of the example load.
REGIONS = {"Kampala": "Central", "Wakiso": "Central", "Jinja": "Eastern", "Mbarara": "Western", "Gulu": "Northern", "Fort Portal": "Western", "Kumi": "Eastern"}


def migration_checks(spark: SparkSession, d: str) -> DataFrame:
    districts = migration.dim_district(spark, REGIONS)
    customers = warehouse.with_unknown_member(warehouse.customer_dimension(clean_customers(spark, d)).select("customer_sk", "customer_id", "district", "district_status"), "customer_sk")
    own = migration.with_district(customers, districts).withColumn("is_current", F.lit(True))
    return migration.validate(own, districts, facts(spark, d)[0], own.select("district", "district_code"))


def customers_without_segment(spark: SparkSession, d: str) -> DataFrame:
    sold, own = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    lost = migration.unmatched(sold, own, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_mktsegment") == "BUILDING"), "c_custkey")
    return lost.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def golden_remap(spark: SparkSession, d: str) -> DataFrame:
    own = clean_customers(spark, d)
    moved = resolve.remap(sales.good(parsed_sales(spark, d)), resolve.golden_map(surviving(own)))
    return moved.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"), F.sum("net_amount_ugx").alias("total"))


def replay_settled(spark: SparkSession, d: str) -> DataFrame:
    rejects = sales.quarantined(parsed_sales(spark, d))
    mended = rejects.withColumn("source_payload", F.replace("source_payload", F.lit("UGX cheap"), F.lit("1500")))
    return sales.settle(mended)[1].groupBy("error_rule", "replayed").agg(F.count(F.lit(1)).alias("n"))


def replay_loaded(spark: SparkSession, d: str) -> DataFrame:
    rejects = sales.quarantined(parsed_sales(spark, d))
    mended = rejects.withColumn("source_payload", F.replace("source_payload", F.lit("UGX cheap"), F.lit("1500")))
    return sales.settle(mended)[0].select("transaction_id", "unit_price_ugx", "net_amount_ugx", "payment_ref")


def upsert_customers(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"), "c_custkey", F.col("c_mktsegment").alias("segment"))
    fresh = own.where("c_custkey % 3 <> 1").withColumn("segment", F.lower("segment"))
    return warehouse.upsert(own.where("c_custkey % 3 <> 0").drop("c_custkey"), fresh.drop("c_custkey"), "customer_id").groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


def role_reads(spark: SparkSession, d: str) -> DataFrame:
    """Rows, plain and masked references that each role reads of the sales it may read."""
    lines, out = sale_lines(spark, d), None
    masked = security.sales_masked(lines)
    for role, grants in security.POLICY.items():
        name = next(t for t in ("sales", "sales_masked") if "S" in grants.get(t, security.Grant("")).operations)
        own = security.secure(lines if name == "sales" else masked, role, name, store="ST07")
        row = own.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("payment_ref").rlike(r"\*")).alias("masked"), F.count_if(F.col("payment_ref").startswith("REF")).alias("plain")).select(F.lit(role).alias("role"), F.lit(name).alias("object_name"), "n", "masked", "plain")
        out = row if out is None else out.unionByName(row)
    return out


def version_churn(spark: SparkSession, d: str) -> DataFrame:
    return warehouse.version_churn(versions(spark, d), "c_custkey").select("versions", "keys", F.round("per_key", 6).alias("per_key"), "alert")


def as_of_segments(spark: SparkSession, d: str) -> DataFrame:
    return warehouse.as_of(versions(spark, d), F.lit("2024-07-01").cast("timestamp")).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


def delivery_zones(spark: SparkSession, d: str) -> DataFrame:
    homes = clean_customers(spark, d).select((F.substring("customer_id", 5, 12).cast("bigint") - 100_000).alias("customer_sk"), "district")
    return board.delivery_zones(sale_lines(spark, d), homes, migration.dim_district(spark, REGIONS))


def stock_variance(spark: SparkSession, d: str) -> DataFrame:
    """Book stock of the parts, counts of five in six of them, and returns and wrong units as causes."""
    parts = table(spark, d, "part").selectExpr("p_partkey", "cast(p_size as bigint) + 100 as quantity", "cast(p_retailprice as decimal(12, 2)) as unit_cost")
    counted = parts.where("p_partkey % 6 <> 0").selectExpr("p_partkey", "quantity - p_partkey % 7 as quantity")
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_orderkey % 50 = 0").selectExpr("l_partkey as p_partkey", "'returns' as cause", "cast(cast(l_quantity as int) as bigint) as quantity")
    units = parts.where("p_partkey % 11 = 0").selectExpr("p_partkey", "'unit of measure' as cause", "-cast(3 as bigint) as quantity")
    return board.stock_variance(parts, counted, returned.unionByName(units), "p_partkey")


def demand_potential(spark: SparkSession, d: str) -> DataFrame:
    """Nations as places: customers as population, mean balance as purchasing power, a travel time by key."""
    own = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).cast("double").alias("population"), F.avg("c_acctbal").alias("purchasing"))
    return board.demand_potential(own.withColumn("travel_minutes", F.col("c_nationkey") * 5.0), "c_nationkey")


def household_scores(spark: SparkSession, d: str) -> DataFrame:
    active = table(spark, d, "orders").select(F.concat(F.lit("CUST"), (F.col("o_custkey") + 100_000).cast("string")).alias("customer_id"), F.col("o_orderdate").alias("last_day"))
    return resolve.household_scores(clean_customers(spark, d), active, "1998-08-01")


def event_contract(spark: SparkSession, d: str) -> DataFrame:
    """Reasons to refuse events: users as sensors, numbers that run back now and then."""
    events = table(spark, d, "events").selectExpr("event_id", "user_id as sensor_id", "ts", "case when event_id % 17 = 0 then event_id - 500 else event_id end as edge_seq", "case when event_id % 13 = 0 then null else 1 end as count", "case when event_id % 19 = 0 then 'suspect' when event_id % 23 = 0 then null else 'ok' end as quality")
    return footfall.with_reason(events).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def injection_truth(spark: SparkSession, d: str) -> DataFrame:
    """What the generator injected into 5,000 customers, 1,200 products and 10,000 sales."""
    made = {"customers": generate.customers(spark, 5000, 1150), "products": generate.products(spark, 1200), "sales": generate.sales(spark, 10_000, 5000, 1200)}
    first, *rest = [generate.truth(k, v) for k, v in made.items()]
    for df in rest:
        first = first.unionByName(df)
    return first


def star_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Constraints of the star schema over the example load; its stores lack the unknown one, its dates end in July."""
    sold = facts(spark, d)[0]
    stores = spark.range(24).select(F.when(F.col("id") == 0, "ECOM01").otherwise(F.concat(F.lit("ST"), F.lpad(F.col("id").cast("string"), 2, "0"))).alias("store_bk"))
    stores = stores.select(surrogate_key(F.col("store_bk")).alias("store_sk"), "store_bk", F.when(F.col("store_bk") == "ECOM01", "ECOMMERCE").otherwise("PHYSICAL").alias("store_type"))
    payments = spark.createDataFrame([("MTN_MOMO", "MOBILE_MONEY"), ("AIRTEL_MOMO", "MOBILE_MONEY"), ("CARD", "CARD"), ("CASH", "CASH")], "payment_bk string, channel string")
    products = warehouse.product_dimension(cleanse.split(clean_products(spark, d), "bad_key")[0]).select("product_sk", "unit_of_measure")
    customers = warehouse.with_unknown_member(warehouse.customer_dimension(clean_customers(spark, d)).select("customer_sk"), "customer_sk")
    keys = {"store_sk": surrogate_key(F.col("store_id")), "payment_sk": surrogate_key(F.col("payment_method")), "date_sk": F.date_format("sold_at", "yyyyMMdd"), "event_ts": F.col("sold_at")}
    return star.violations(
        {
            "dim_customer": customers,
            "dim_product": products,
            "dim_store": stores,
            "dim_date": warehouse.dim_date(spark, "2024-01-01", "2024-07-31"),
            "dim_payment_method": payments.withColumn("payment_sk", surrogate_key(F.col("payment_bk"))),
            "fact_sales": star.conform(sold, "fact_sales", **keys),
        }
    )


RUN_AT = "2026-10-05 02:00:00"


def quarantine_summary(spark: SparkSession, d: str) -> DataFrame:
    rejects = sales.quarantined(parsed_sales(spark, d), at=RUN_AT)
    return sales.quarantine_summary(rejects).withColumns({c: F.col(c).cast("string") for c in ("first_seen", "last_seen")})


QUERIES: dict[str, Query] = {
    "kpi_block": on_lines(cube.kpi_block),
    "kpi_selection": on_lines(lambda s: cube.kpi_block(cube.Selection(months=("1996-12", "1995-01"), cities=["Kampala", "Gulu"], payments=["CARD", "CASH"]).apply(s))),
    "revenue_month_city": on_lines(lambda s: cube.dense_months(s, "city")),
    "revenue_month": on_lines(lambda s: cube.revenue_by(s, "month")),
    "revenue_category": on_lines(lambda s: cube.revenue_by(s, "category")),
    "payment_share": on_lines(lambda s: cube.with_share(cube.revenue_by(s, "payment_method"))),
    "store_table": on_lines(cube.store_table),
    "store_drill": on_lines(lambda s: cube.store_drill(s, "ST05")),
    "new_vs_returning": on_lines(cube.new_and_returning),
    "control_total": on_lines(cube.guarded_total),
    "top_categories": on_lines(lambda s: cube.revenue_by(s, "category").orderBy(F.desc("revenue"), "category").limit(3)),
    "monthly_active": on_lines(A.monthly_active),
    "retention": on_lines(A.retention),
    "revenue_at_risk": on_lines(lambda s: A.revenue_at_risk(s, "1997-06-30")),
    "rfm": on_lines(lambda s: A.rfm(s, "1999-01-01")),
    "cohorts": on_lines(A.cohorts),
    "pareto_parts": on_lines(lambda s: A.pareto(s, "l_partkey")),
    "reorder_points": on_lines(A.reorder_points),
    "location_quotient": on_lines(A.location_quotient),
    "pending_ageing": on_lines(lambda s: A.pending_ageing(s, "1997-01-01")),
    "repeated_references": on_lines(A.repeated_references),
    "unusual_amounts": on_lines(lambda s: A.unusual_amounts(s, 1.5)),
    "refund_days": on_lines(A.refund_days),
    "walk_in_high_value": on_lines(A.walk_in_high_value),
    "month_growth": on_lines(A.month_growth),
    "growth_decomposition": on_lines(A.growth_decomposition),
    "kpi_tree": on_lines(A.kpi_tree),
    "std_phone": standard(DIRTY_CUSTOMERS, ["customer_id"], "phone_number", S.phone),
    "std_district": standard(DIRTY_CUSTOMERS, ["customer_id"], "district", S.district, (DISTRICTS, cleanse.NEAR_DISTRICT)),
    "std_date": standard(DIRTY_CUSTOMERS, ["customer_id"], "registration_date", S.date),
    "std_gender": standard(DIRTY_CUSTOMERS, ["customer_id"], "gender", S.gender),
    "std_unit": standard(DIRTY_PRODUCTS, ["product_id", "product_name"], "unit_of_measure", S.unit),
    "std_category": standard(DIRTY_PRODUCTS, ["product_id", "product_name"], "category", S.category, (list(CATEGORIES), cleanse.NEAR_CATEGORY)),
    "std_price": standard(DIRTY_PRODUCTS, ["product_id", "product_name"], "selling_price_ugx", S.price),
    "mask_all": mask_all,
    "cleanse_customers": lambda spark, d: clean_customers(spark, d).select(*CUSTOMER_COLUMNS),
    "cleanse_products": lambda spark, d: clean_products(spark, d).where("not bad_key").select(*PRODUCT_COLUMNS),
    "products_quarantine": lambda spark, d: cleanse.split(clean_products(spark, d), "bad_key")[1].select("sku", "product_name"),
    "sku_multi_name": lambda spark, d: cleanse.skus_with_names(load(spark, d, DIRTY_PRODUCTS)),
    "duplicate_rows": lambda spark, d: cleanse.exact_duplicates(raw_customers(spark, d), ["phone_number", "email", "district", "gender"]),
    "dominant_phone_format": lambda spark, d: quality.dominant_phone_format(raw_customers(spark, d)),
    "profile_customers": lambda spark, d: quality.profile_customers(raw_customers(spark, d), TODAY),
    "profile_products": lambda spark, d: quality.profile_products(load(spark, d, DIRTY_PRODUCTS)),
    "rule_violations": rule_violations,
    "monitoring": monitoring,
    "compare_profiles": compare_profiles,
    "parse_sales": lambda spark, d: parsed_sales(spark, d).where("rule is null").drop("raw"),
    "quarantine_summary": quarantine_summary,
    "fact_sales": lambda spark, d: facts(spark, d)[0].select("transaction_id", "sale_sk", "customer_sk", "product_sk", "quantity", "net_amount_ugx"),
    "product_orphans": lambda spark, d: facts(spark, d)[1].select("transaction_id", "product_id"),
    "load_checks": load_checks,
    "idempotent_load": idempotent_load,
    "denormalised": denormalised,
    "phone_clusters": phone_clusters,
    "survivors": survivors,
    "fuzzy_pairs": fuzzy_pairs,
    "name_pairs_edit_distance": name_pairs,
    "scd2_apply": scd2_apply,
    "scd2_asof": scd2_asof,
    "dim_date": dim_date,
    "role_store_rows": role_store_rows,
    "role_matrix": lambda spark, d: security.matrix(spark),
    "footfall_windows": footfall_windows,
    "event_gaps": lambda spark, d: footfall.gaps(table(spark, d, "events"), "user_id", "event_id"),
    "distinct_events": distinct_events,
    "sliding_24h": sliding_24h,
    "trade_area": trade_area,
    "repeated_reference_windows": repeated_reference_windows,
    "on_hand": on_hand,
    "migration_checks": migration_checks,
    "dim_district": lambda spark, d: migration.dim_district(spark, REGIONS).select("district_code", "district_name", "region").where("region is not null"),
    "customers_without_segment": customers_without_segment,
    "golden_remap": golden_remap,
    "replay_settled": replay_settled,
    "replay_loaded": replay_loaded,
    "upsert_customers": upsert_customers,
    "role_reads": role_reads,
    "version_churn": version_churn,
    "as_of_segments": as_of_segments,
    "households": lambda spark, d: resolve.households(clean_customers(spark, d)),
    "search_payments": lambda spark, d: cube.search(load(spark, d, DIRTY_SALES).select("transaction_id", "payment_method"), "payment_method", ["MoMo", "airtel"], ["transaction_id"], 6),
    "cohort_segments": on_lines(board.cohort_segments),
    "growth_drivers": on_lines(board.growth_drivers),
    "pending_register": on_lines(lambda s: board.pending_register(s, "1998-08-01")),
    "rounding_clusters": on_lines(lambda s: board.rounding_clusters(s, 5, 0.001)),
    "kpi_targets": on_lines(lambda s: board.kpi_targets(s, "1997-03")),
    "delivery_zones": delivery_zones,
    "stock_variance": stock_variance,
    "demand_potential": demand_potential,
    "household_scores": household_scores,
    "event_contract": event_contract,
    "injection_truth": injection_truth,
    "star_constraints": star_constraints,
}


def oracles() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
