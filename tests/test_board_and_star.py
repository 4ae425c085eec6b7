"""Board analyses, star schema, generator, stream routing and audit on small inputs."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bazaarflow.operators import board, cleanse, resolve, sales, security, star, warehouse
from bazaarflow.sources import files, generate
from bazaarflow.streaming import footfall

LINE = "customer_sk long, month string, sold_at string, o_orderkey long, store_id string, city string, quantity int, amount decimal(14,4), is_return boolean, payment_method string, payment_ref string"


def lines(spark, *rows):
    base = (1, "2024-01", "2024-01-10", 1, "ST01", "Kampala", 1, Decimal(100), False, "CASH", None)
    names = [f.split()[0] for f in LINE.replace("decimal(14,4)", "decimal").split(", ")]
    return spark.createDataFrame([tuple((dict(zip(names, base, strict=True)) | r)[n] for n in names) for r in rows], LINE)


def test_cohort_segment_is_that_of_the_first_purchase(spark):
    own = lines(spark, {"store_id": "ECOM01", "city": "E-commerce"}, {"month": "2024-03", "sold_at": "2024-03-01"}, {"customer_sk": 0})
    got = {(r.cohort, r.city, r.channel, r.age, r.customers) for r in board.cohort_segments(own).collect()}
    assert got == {("2024-01", "E-commerce", "online", 0, 1), ("2024-01", "E-commerce", "online", 2, 1)}


def test_growth_drivers_add_up(spark):
    own = lines(
        spark,
        {}, {"customer_sk": 2, "amount": Decimal(300)},
        {"month": "2024-02", "quantity": 3, "amount": Decimal(360)}, {"month": "2024-02"}, {"customer_sk": 3, "month": "2024-02", "amount": Decimal(50)},
        {"customer_sk": 2, "month": "2024-03", "amount": Decimal(70)},
    )
    got = {r.month: r.asDict() for r in board.growth_drivers(own).collect()}
    assert (float(got["2024-02"]["by_new"]), float(got["2024-02"]["by_lost"]), float(got["2024-03"]["by_back"])) == (50, -300, 70)
    for month, change in (("2024-02", 110), ("2024-03", 70 - 510)):
        assert sum(float(v) for k, v in got[month].items() if k != "month") == pytest.approx(change)
    assert board.growth_drivers(own.limit(0)).count() == 0


def test_pending_register_escalates_old_lines_only(spark):
    own = lines(spark, {"payment_method": "MTN_MOMO"}, {"payment_method": "MTN_MOMO", "sold_at": "2024-01-19"}, {"payment_method": "MTN_MOMO", "payment_ref": "R"}, {"payment_method": "MTN_MOMO", "sold_at": "2024-02-01"})
    got = {r.day: r.escalated for r in board.pending_register(own, "2024-01-20").collect()}
    assert got == {"2024-01-10": 1, "2024-01-19": 0}


def test_round_amounts_and_targets(spark):
    own = lines(spark, {}, {"amount": Decimal("7.25")}, {"amount": Decimal(-50)}, {"store_id": "ST02", "amount": Decimal(3)})
    assert [(r.store_id, r.round_lines, r.line_count) for r in board.rounding_clusters(own, 50, 0.5).collect()] == [("ST01", 2, 3)]
    got = {r.measure: (r.value, r.met) for r in board.kpi_targets(own, "2024-01").collect()}
    assert got["new_customers"] == (1.0, False) and got["churn"] == (1.0, False) and got["walk_in_revenue_share"] == (0.0, True)


def test_stock_variance_closes(spark):
    book = spark.createDataFrame([(1, 10, Decimal(2)), (2, 5, Decimal(1)), (3, 9, Decimal(1))], "k int, quantity long, unit_cost decimal(12,2)")
    counted = spark.createDataFrame([(1, 7), (2, 5), (4, 2)], "k int, quantity long")
    causes = spark.createDataFrame([(1, "returns", -2), (3, "returns", -9)], "k int, cause string, quantity long")
    got = {r.step: (r.units, float(r.value)) for r in board.stock_variance(book, counted, causes, "k").collect()}
    assert got == {"book": (15, 25), "returns": (-2, -4), "unexplained": (1, -2), "physical": (14, 19)}


def test_demand_potential_without_travel_time(spark):
    places = spark.createDataFrame([("a", 10.0, 2.0, 5.0), ("b", 10.0, 2.0, 0.0), ("c", 10.0, -2.0, 5.0), ("d", 12.0, 1.0, 1.0)], "p string, population double, purchasing double, travel_minutes double")
    assert {r.p: (r.potential, r.share) for r in board.demand_potential(places, "p").collect()} == {"a": (4, 0.25), "b": (0, 0), "c": (0, 0), "d": (12, 0.75)}


def test_households_need_a_recent_purchase(spark):
    people = spark.createDataFrame([(str(i), "Kampala", f"N{i} Okello", f"+25670000000{i // 3}", "valid") for i in range(6)], "customer_id string, district string, full_name string, phone_e164 string, phone_status string")
    seen = spark.createDataFrame([("0", "2024-01-01"), ("3", "2023-01-01")], "customer_id string, last_day string")
    got = resolve.household_scores(people, seen, "2024-02-01").collect()
    assert [(r.members, r.active, r.score) for r in got] == [(3, 1, 0.6667)]


def test_star_tables_and_broken_constraints(spark, tmp_path):
    for _ in range(2):
        star.create(spark, "star_test", str(tmp_path / "star"))
    made = spark.table("star_test.fact_sales")
    assert made.columns[-1] == "sale_month" and {t.name for t in spark.catalog.listTables("star_test")} == set(star.TABLES)
    spark.sql("drop database star_test cascade")
    products = spark.createDataFrame([(1, "kg"), (1, "kg"), (2, "sack")], "product_sk long, unit_of_measure string")
    sold = spark.createDataFrame([("T1", 1, "MATCHED"), ("T1", 9, "?"), (None, 9, "PENDING")], "transaction_id string, product_sk long, reconciliation_status string")
    fact = star.conform(sold, "fact_sales", event_ts=F.lit("2024-01-01 00:00:00"))
    assert fact.columns == [c.rsplit(" ", 1)[0] for c in star.TABLES["fact_sales"].split(", ")]
    got = {(r.table_name, r.column_name, r.kind): r.n for r in star.violations({"dim_product": products, "fact_sales": fact}).collect()}
    assert got == {("dim_product", "product_sk", "unique"): 1, ("dim_product", "unit_of_measure", "within"): 1, ("fact_sales", "transaction_id", "unique"): 1, ("fact_sales", "transaction_id", "present"): 1, ("fact_sales", "reconciliation_status", "within"): 1, ("fact_sales", "product_sk", "known"): 2}


def test_generator_tells_what_it_did(spark):
    people = generate.customers(spark, 400, 90).persist()
    truth = {r.defect: r.n for r in generate.truth("customers", people).collect()}
    assert truth["rows"] == 400 and truth["duplicate_rows"] == 90 == truth["exact_copies"] + truth["fuzzy_name_variants"] + truth["phone_variants"]
    found = people.agg(F.count_if(F.col("phone_number") == ""), F.count_if(F.col("email") == ""), F.count_if(F.col("gender") == "")).first()
    assert tuple(found) == (truth["null_phone"], truth["null_email"], truth["null_gender"])
    assert people.orderBy("customer_id").collect() == generate.customers(spark, 400, 90).orderBy("customer_id").collect()
    sold = generate.sales(spark, 500, 400, 50)
    parsed = sales.parse_sales(sold)
    counts = {r.defect: r.n for r in generate.truth("sales", sold).collect()}
    assert parsed.where("rule is not null").count() == 0
    assert parsed.where("is_return").count() == counts["negative_qty_rows"] and parsed.where("customer_id = ''").count() == counts["blank_customer_rows"]
    assert generate.customers(spark, 0, 0).count() == 0
    goods = generate.products(spark, 300)
    bad = cleanse.split(cleanse.cleanse_products(goods.drop("defects")), "bad_key")[1].count()
    assert bad == {r.defect: r.n for r in generate.truth("p", goods).collect()}["null_key_rows"]


def test_refused_events_in_batch_and_stream(spark, tmp_path):
    rows = [("e1", "s1", 5, 1, "ok"), ("e2", "s1", 4, 1, "ok"), ("e3", "s1", 5, 1, "ok"), ("e4", "s1", 6, None, "ok"), ("e5", "s1", 3, 1, "suspect"), ("e6", "s2", 1, 1, "ok"), ("e7", "s2", None, 1, "ok")]
    events = [{"event_id": e, "sensor_id": s, "store_id": "ST01", "ts": f"2024-01-01T10:0{k}:00+03:00", "edge_seq": q, "count": n, "quality": x} for k, (e, s, q, n, x) in enumerate(rows)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, events)))
    want = {"e1": None, "e2": "NOT_MONOTONIC", "e3": None, "e4": "NULL_COUNT", "e5": "QUALITY", "e6": None, "e7": None}
    batch = spark.read.schema(footfall.EVENT).json(str(tmp_path / "in")).withColumn("ts", F.to_timestamp("ts"))
    assert {r.event_id: r.reason for r in footfall.with_reason(batch).collect()} == want
    run = lambda: footfall.route(footfall.with_reason(footfall.stream_events(spark, str(tmp_path / "in"))), str(tmp_path / "kept"), str(tmp_path / "refused"), str(tmp_path / "state"))
    run()
    (tmp_path / "in" / "b.json").write_text(json.dumps(events[0] | {"event_id": "e8", "edge_seq": 2, "ts": "2024-01-01T11:00:00+03:00"}))
    run()
    kept, refused = (spark.read.parquet(str(tmp_path / k)) for k in ("kept", "refused"))
    assert {r.event_id for r in kept.collect()} == {k for k, v in want.items() if v is None}
    assert {r.event_id: r.reason for r in refused.collect()} == {k: v for k, v in want.items() if v} | {"e8": "NOT_MONOTONIC"}


def test_every_attempt_is_logged(spark, tmp_path):
    own, log = spark.createDataFrame([("a", "ST01")], "x string, store_id string"), str(tmp_path / "audit")
    security.audited(own, "compliance_officer", "sales", log, "2024-01-01 10:00:00", "ann")
    with pytest.raises(security.AccessDenied):
        security.audited(own, "store_cashier", "sales", log, "2024-01-01 10:01:00", "bob", store="ST01")
    assert [(r.app_user, r.allowed) for r in spark.read.parquet(log).orderBy("event_time").collect()] == [("ann", True), ("bob", False)]


def test_latest_run_and_published_page(spark, tmp_path):
    log = spark.createDataFrame([("a", "SUCCESS", 1), ("b", "SUCCESS", 2), ("c", "FAILED", 3)], "run_id string, status string, finished_at int")
    assert warehouse.latest_run(log).first()["run_id"] == "b"
    page = str(tmp_path / "page.html")
    files.publish("<p>{{total}}</p>", {"total": "{{5}}"}, page)
    assert open(page).read() == "<p>{{5}}</p>"
    with pytest.raises(KeyError):
        files.publish("{{other}}", {}, page)
    assert open(page).read() == "<p>{{5}}</p>" and [x.name for x in tmp_path.iterdir()] == ["page.html"]
