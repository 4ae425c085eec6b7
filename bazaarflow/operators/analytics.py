"""Board analyses over sale lines. Dates and thresholds are parameters; nothing depends on the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cube import money, ratio, revenue_by
from .resolve import need_checkpoints


def _bought(lines: DataFrame) -> DataFrame:
    return lines.where("customer_sk > 0 and not is_return").select("customer_sk", "month").distinct()


def monthly_active(lines: DataFrame) -> DataFrame:
    """Known customers with a purchase, returns left out."""
    return _bought(lines).groupBy("month").agg(F.count(F.lit(1)).alias("active_customers"))


def retention(lines: DataFrame) -> DataFrame:
    """Of each month's customers: how many came back the next month, how many did not (churn)."""
    bought = _bought(lines)
    later = bought.select("customer_sk", F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), -1), "yyyy-MM").alias("month"), F.lit(1).alias("again"))
    met = bought.join(later, ["customer_sk", "month"], "left").groupBy("month").agg(F.count(F.lit(1)).alias("customers"), F.count("again").alias("retained"))
    return met.select("month", "customers", "retained", (F.col("customers") - F.col("retained")).alias("churned"), ratio(F.col("retained"), F.col("customers")).alias("retention"))


def revenue_at_risk(lines: DataFrame, as_of: str, idle_days: int = 45, trailing_days: int = 90) -> DataFrame:
    day = F.to_date(F.lit(as_of))
    sold = F.to_date("sold_at")
    own = lines.where((F.col("customer_sk") > 0) & (sold <= day)).groupBy("customer_sk").agg(F.max(sold).alias("last_day"), money(F.sum(F.when(sold > F.date_sub(day, trailing_days), F.col("amount")))).alias("trailing_revenue"))
    return own.where(F.datediff(day, "last_day") >= idle_days).agg(F.count(F.lit(1)).alias("idle_customers"), money(F.sum("trailing_revenue")).alias("revenue_at_risk"))


def rfm(lines: DataFrame, as_of: str, bands: int = 5) -> DataFrame:
    """Recency, frequency and money of each customer with band numbers, 1 the lowest; bands by rank over all customers.

    Ranks come from cut points of the value's distribution counted by distinct value, so no row is sent to one task.
    """
    day = F.to_date(F.lit(as_of))
    own = lines.where("customer_sk > 0").groupBy("customer_sk").agg(F.datediff(day, F.max(F.to_date("sold_at"))).alias("recency"), F.count_distinct("o_orderkey").alias("frequency"), money(F.sum("amount")).alias("money"))
    score = lambda c: F.least(F.floor(F.col(c) * bands) + 1, F.lit(bands)).cast("int")
    columns = (("recency", True), ("frequency", False), ("money", False))
    cuts = own.agg(*[percentiles(c) for c, _ in columns]).first()
    for (column, falling), bounds in zip(columns, cuts, strict=True):
        own = with_percent_below(own, column, f"_{column}", falling, bounds)
    return own.select("customer_sk", "recency", "frequency", "money", score("_recency").alias("r"), score("_frequency").alias("f"), score("_money").alias("m"))


def percentiles(column: str, parts: int = 64) -> Column:
    """Cut points that split a column's values into parts of about one size."""
    return F.percentile_approx(F.col(column).cast("double"), [k / parts for k in range(1, parts)], 20 * parts)


def range_of(value: Column, bounds: list[float] | None) -> Column:
    """Number of the part between cut points that a value lies in."""
    return F.size(F.filter(F.lit(sorted(set(bounds or [0.0]))), lambda b: b < value))


def with_percent_below(df: DataFrame, column: str, out: str, falling: bool = False, bounds: list[float] | None = None) -> DataFrame:
    """df with the share of rows whose value is smaller (falling: larger): an exact rank without one window over all rows."""
    value = F.col(column).cast("double")
    counted = df.groupBy(value.alias("_v")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_part", range_of(F.col("_v"), bounds))
    order = F.desc("_v") if falling else F.asc("_v")
    sums = counted.groupBy("_part").agg(F.sum("_n").alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy(F.desc("_part") if falling else F.asc("_part")).rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("_sum").over(Window.partitionBy())
    offsets = sums.select("_part", F.coalesce(before, F.lit(0)).alias("_before"), total.alias("_total"))  # one row per part
    inside = F.sum("_n").over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    ranked = counted.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(offsets), "_part").select("_v", ((F.col("_before") + F.col("_inside")) / F.col("_total")).alias(out))
    return df.withColumn("_v", value).join(ranked, "_v").drop("_v")


def cohorts(lines: DataFrame) -> DataFrame:
    """Customers by first month, and how many of them buy in each later month."""
    bought = lines.where("customer_sk > 0").select("customer_sk", "month").distinct()
    first = bought.groupBy("customer_sk").agg(F.min("month").alias("cohort"))
    months = lambda c: F.substring(c, 1, 4).cast("int") * 12 + F.substring(c, 6, 2).cast("int")
    return bought.join(first, "customer_sk").groupBy("cohort", (months(F.col("month")) - months(F.col("cohort"))).alias("age")).agg(F.count(F.lit(1)).alias("customers"))


def pareto(lines: DataFrame, key: str, share: float = 0.8, cuts: tuple[float, float] = (0.8, 0.95)) -> DataFrame:
    """Revenue by key, largest first, with running share and ABC class; vital marks the few that make up `share`.

    The running sum is taken in value order inside ranges of revenue, ranges are summed apart. The lines are read once: what they
    sum up to is checkpointed in the session's shared folder.
    """
    need_checkpoints(lines.sparkSession)
    sums = revenue_by(lines, key).where("revenue > 0").select(key, "revenue").checkpoint()
    bounds = sums.agg(percentiles("revenue")).first()[0]
    parts = sums.withColumn("_part", range_of(F.col("revenue").cast("double"), bounds))
    totals = parts.groupBy("_part").agg(F.sum("revenue").alias("_sum"))
    above = F.sum("_sum").over(Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("_part", F.coalesce(above, F.lit(0)).alias("_above"), F.sum("_sum").over(Window.partitionBy()).alias("_total"))
    inside = Window.partitionBy("_part").orderBy(F.desc("revenue"), key).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.withColumn("_run", F.sum("revenue").over(inside)).join(F.broadcast(totals), "_part")
    out = out.withColumn("running_share", ratio(F.col("_run") + F.col("_above"), F.col("_total")))
    before = F.col("running_share") - ratio(F.col("revenue"), F.col("_total"))
    grade = F.when(before < cuts[0], "A").when(before < cuts[1], "B").otherwise("C")
    return out.select(key, "revenue", F.round("running_share", 6).alias("running_share"), (before < share).alias("vital"), grade.alias("abc_class"))


def reorder_points(lines: DataFrame, lead_days: int = 7, z: float = 1.65) -> DataFrame:
    """Mean daily demand over the lead time plus z deviations, per product, over days with sales."""
    daily = lines.where("not is_return").groupBy("l_partkey", F.to_date("sold_at").alias("day")).agg(F.sum("quantity").alias("units"))
    own = daily.groupBy("l_partkey").agg(F.avg("units").alias("mean_units"), F.coalesce(F.stddev_samp("units"), F.lit(0.0)).alias("deviation"))
    return own.select("l_partkey", F.round("mean_units", 6).alias("mean_units"), F.round(F.col("mean_units") * lead_days + z * F.col("deviation") * lead_days**0.5, 4).alias("reorder_point"))


def location_quotient(lines: DataFrame) -> DataFrame:
    """A city's share of revenue over its share of customers; and over its share of stores."""
    own = lines.groupBy("city").agg(money(F.sum("amount")).alias("revenue"), F.count_distinct(F.when(F.col("customer_sk") > 0, F.col("customer_sk"))).alias("customers"), F.count_distinct("store_id").alias("stores"))
    whole = Window.partitionBy()
    share = lambda c: F.col(c).cast("double") / F.sum(c).over(whole).cast("double")
    return own.select("city", "customers", "stores", F.round(share("revenue") / share("customers"), 6).alias("quotient"), F.round(share("revenue") / share("stores"), 6).alias("productivity"))


def pending_ageing(lines: DataFrame, as_of: str) -> DataFrame:
    """Mobile-money lines without reference, by hours since the sale."""
    hours = (F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp(F.col("sold_at").cast("timestamp"))) / 3600
    pending = lines.where(F.col("payment_ref").isNull() & F.col("payment_method").isin("MTN_MOMO", "AIRTEL_MOMO"))
    bucket = F.when(hours < 24, "0-24").when(hours <= 72, "24-72").otherwise(">72")
    return pending.groupBy(bucket.alias("age_bucket")).agg(F.count(F.lit(1)).alias("line_count"), money(F.sum("amount")).alias("value"))


def repeated_references(lines: DataFrame) -> DataFrame:
    """References that more than one store has used."""
    own = lines.where("payment_ref is not null").groupBy("payment_ref").agg(F.count_distinct("store_id").alias("stores"), F.count(F.lit(1)).alias("uses"))
    return own.where("stores > 1")


def unusual_amounts(lines: DataFrame, deviations: float = 3.0) -> DataFrame:
    """Lines far above their store's and hour's mean; means are joined back, the lines are not regrouped.

    Rows that no mean can be joined to go first, from both uses of the lines alike, so that one shuffle serves both.
    """
    keyed = lines.select("store_id", F.hour("sold_at").alias("hour"), F.col("amount").cast("double").alias("x")).where("store_id is not null and hour is not null and x is not null")
    base = keyed.groupBy("store_id", "hour").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("deviation"))
    far = keyed.join(base, ["store_id", "hour"]).where(F.col("x") > F.col("mean") + deviations * F.col("deviation"))
    return far.groupBy("store_id").agg(F.count(F.lit(1)).alias("line_count"), F.round(F.max("x"), 4).alias("largest"))


def refund_days(lines: DataFrame, most: int = 3) -> DataFrame:
    """Stores and days with more refunds than usual."""
    return lines.where("is_return").groupBy("store_id", F.to_date("sold_at").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("refunds")).where(F.col("refunds") > most)


def walk_in_high_value(lines: DataFrame, least: float = 50_000) -> DataFrame:
    return lines.where((F.col("customer_sk") == 0) & (F.col("amount") >= least)).groupBy("store_id").agg(F.count(F.lit(1)).alias("line_count"), money(F.sum("amount")).alias("value"))


def month_growth(lines: DataFrame) -> DataFrame:
    """Revenue of each month against the month before; one row per month goes through the window."""
    own = revenue_by(lines, "month").select("month", "revenue")
    last = F.lag("revenue").over(Window.orderBy("month"))
    return own.withColumn("delta", (F.col("revenue") - last).cast("decimal(24,4)"))


def growth_decomposition(lines: DataFrame) -> DataFrame:
    """Change of revenue split into customers, lines per customer and revenue per line: each factor moves in turn, the earlier ones new."""
    own = lines.where("customer_sk > 0").groupBy("month").agg(F.sum("amount").cast("double").alias("rev"), F.count_distinct("customer_sk").cast("double").alias("n"), F.count(F.lit(1)).cast("double").alias("k"))
    w = Window.orderBy("month")
    own = own.withColumns({f"p_{c}": F.lag(c).over(w) for c in ("rev", "n", "k")}).where("p_n is not null")
    frequency, before = F.col("k") / F.col("n"), F.col("p_k") / F.col("p_n")
    basket, basket_before = F.col("rev") / F.col("k"), F.col("p_rev") / F.col("p_k")
    return own.select(
        "month",
        F.round((F.col("n") - F.col("p_n")) * before * basket_before, 2).alias("by_customers"),
        F.round(F.col("n") * (frequency - before) * basket_before, 2).alias("by_frequency"),
        F.round(F.col("n") * frequency * (basket - basket_before), 2).alias("by_basket"),
    )


def kpi_tree(lines: DataFrame) -> DataFrame:
    """Shares that the board tracks, one row per measure."""
    known = F.col("customer_sk") > 0
    own = lines.agg(
        ratio(F.count_if(~known), F.count(F.lit(1))).alias("walk_in_share"),
        ratio(F.count_if(F.col("payment_ref").isNull()), F.count(F.lit(1))).alias("pending_share"),
        ratio(F.count_if(F.col("is_return")), F.count(F.lit(1))).alias("return_share"),
        ratio(F.sum(F.when(F.col("city") == "E-commerce", F.col("amount"))), F.sum("amount")).alias("online_share"),
        ratio(F.sum(F.when(F.col("payment_method").isin("MTN_MOMO", "AIRTEL_MOMO"), F.col("amount"))), F.sum("amount")).alias("momo_share"),
    )
    buyers = lines.where(known).groupBy("customer_sk").agg(F.count_distinct("o_orderkey").alias("n")).agg(ratio(F.count_if(F.col("n") > 1), F.count(F.lit(1))).alias("repeat_share"))
    tall = own.unpivot([], own.columns, "measure", "value").unionByName(buyers.unpivot([], buyers.columns, "measure", "value"))
    return tall.withColumn("value", F.round("value", 6))


def trade_area(lines: DataFrame, customers: DataFrame) -> DataFrame:
    """Revenue by the customer's home district (customer_sk, district) and the store's city."""
    return lines.where("customer_sk > 0").join(customers, "customer_sk").groupBy("district", "city").agg(money(F.sum("amount")).alias("revenue"), F.count_distinct("customer_sk").alias("customers"))
