"""Further board analyses: cohorts by segment, growth by cause, registers, targets, zones, stock variance, demand potential."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cube import money, ratio

MOMO = ("MTN_MOMO", "AIRTEL_MOMO")
# Measure, direction and target of the board's tree.
TARGETS = {"new_customers": (">=", 600.0), "churn": ("<=", 0.5), "pending_share": ("<", 0.005), "walk_in_revenue_share": ("<", 0.03)}


def month_number(month: Column) -> Column:
    """Months since year 0 of a month such as 2024-07."""
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int")


def cohort_segments(lines: DataFrame) -> DataFrame:
    """Customers by month, city and channel of their first purchase, and how many of them buy in each later month.

    Of several first lines the smallest order and then store decides.
    """
    bought = lines.where("customer_sk > 0 and not is_return")
    first = F.min(F.struct("sold_at", "o_orderkey", "store_id", "city", "month"))
    months = bought.groupBy("customer_sk").agg(first.alias("f"), F.collect_set("month").alias("months"))
    channel = F.when(F.col("f.store_id") == "ECOM01", "online").otherwise("store")
    each = months.select("f.city", channel.alias("channel"), F.col("f.month").alias("cohort"), F.explode("months").alias("month"))
    age = month_number(F.col("month")) - month_number(F.col("cohort"))
    return each.groupBy("cohort", "city", "channel", age.alias("age")).agg(F.count(F.lit(1)).alias("customers"))


def growth_drivers(lines: DataFrame) -> DataFrame:
    """Change of known customers' purchases by cause: buyers new, back and lost; those who stayed by frequency, basket and price or mix.

    The causes of a month add up to the change. Frequency is lines, basket is units a line at the old price, and price or mix
    is the new units at the change of the mean price. The first month has no row.
    """
    own = lines.where("customer_sk > 0 and not is_return").groupBy("customer_sk", month_number(F.col("month")).alias("m"))
    own = own.agg(money(F.sum("amount")).alias("rev"), F.count(F.lit(1)).alias("k"), F.sum("quantity").alias("u"))
    w = Window.partitionBy("customer_sk").orderBy("m")
    seen = own.select("*", *[F.lag(c).over(w).alias(f"p_{c}") for c in ("m", "rev", "k", "u")], F.lead("m").over(w).alias("n_m"))
    stayed, fresh = F.col("p_m") == F.col("m") - 1, F.col("p_m").isNull()
    part = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    came = seen.groupBy("m").agg(
        money(part(fresh, "rev")).alias("by_new"),
        money(part(F.col("p_m") < F.col("m") - 1, "rev")).alias("by_back"),
        *[part(stayed, c).cast("double").alias(f"{c}1") for c in ("rev", "k", "u")],
        *[part(stayed, f"p_{c}").cast("double").alias(f"{c}0") for c in ("rev", "k", "u")],
    )
    gone = seen.where("n_m is null or n_m > m + 1").groupBy((F.col("m") + 1).alias("m")).agg(money(-F.sum("rev")).alias("by_lost"))
    c = F.col
    over = lambda a, b: F.coalesce(F.try_divide(c(a), c(b)), F.lit(0.0))
    by = {
        "by_frequency": (c("k1") - c("k0")) * over("rev0", "k0"),
        "by_basket": (c("u1") - c("k1") * over("u0", "k0")) * over("rev0", "u0"),
        "by_price_mix": c("rev1") - c("u1") * over("rev0", "u0"),
    }
    month = F.format_string("%04d-%02d", F.floor((c("m") - 1) / 12).cast("int"), F.pmod(c("m") - 1, F.lit(12)) + 1)
    out = came.join(gone, "m", "left").where(c("m") > came.agg(F.min("m")).scalar())
    return out.select(month.alias("month"), "by_new", "by_back", money(c("by_lost")).alias("by_lost"), *[F.round(v, 2).alias(k) for k, v in by.items()])


def pending_register(lines: DataFrame, as_of: str, most_hours: int = 48) -> DataFrame:
    """Mobile-money lines without reference by day and store, with those past the escalation limit."""
    hours = (F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp(F.col("sold_at").cast("timestamp"))) / 3600
    pending = lines.where(F.col("payment_ref").isNull() & F.col("payment_method").isin(*MOMO) & (hours >= 0))
    late = hours > most_hours
    return pending.groupBy(F.to_date("sold_at").cast("string").alias("day"), "store_id").agg(F.count(F.lit(1)).alias("line_count"), money(F.sum("amount")).alias("value"), F.count_if(late).alias("escalated"))


def rounding_clusters(lines: DataFrame, unit: int, least_share: float) -> DataFrame:
    """Stores and payment methods whose share of amounts that are multiples of unit reaches least_share."""
    whole = F.pmod(F.col("amount"), F.lit(unit)) == 0
    own = lines.groupBy("store_id", "payment_method").agg(F.count_if(whole).alias("round_lines"), F.count(F.lit(1)).alias("line_count"))
    return own.withColumn("share", F.round(ratio(F.col("round_lines"), F.col("line_count")), 6)).where(F.col("share") >= least_share)


def kpi_targets(lines: DataFrame, month: str) -> DataFrame:
    """measure, value, target, met for one month; churn counts the month's customers without a purchase in the next."""
    number, at = month_number(F.col("month")), int(month[:4]) * 12 + int(month[5:7])
    known = F.col("customer_sk") > 0
    buys = lines.where(known & ~F.col("is_return")).groupBy("customer_sk").agg(F.min(number).alias("first"), F.max(number == at).alias("now"), F.max(number == at + 1).alias("next"))
    people = buys.agg(F.count_if(F.col("first") == at).cast("double").alias("new_customers"), ratio(F.count_if(F.col("now") & ~F.col("next")), F.count_if("now")).alias("churn"))
    momo = F.col("payment_method").isin(*MOMO)
    money_of = lines.where(F.col("month") == month).agg(
        ratio(F.count_if(momo & F.col("payment_ref").isNull()), F.count_if(momo)).alias("pending_share"),
        ratio(F.sum(F.when(~known, F.col("amount"))), F.sum("amount")).alias("walk_in_revenue_share"),
    )
    tall = people.unpivot([], people.columns, "measure", "value").unionByName(money_of.unpivot([], money_of.columns, "measure", "value"))
    value = F.round("value", 6)
    test = {">=": lambda t: value >= t, "<=": lambda t: value <= t, "<": lambda t: value < t}
    goal = F.coalesce(*[F.when(F.col("measure") == k, F.lit(t)) for k, (_, t) in TARGETS.items()])
    met = F.coalesce(*[F.when(F.col("measure") == k, test[d](t)) for k, (d, t) in TARGETS.items()])
    return tall.select("measure", value.alias("value"), goal.alias("target"), met.alias("met"))


def delivery_zones(lines: DataFrame, customers: DataFrame, districts: DataFrame) -> DataFrame:
    """Revenue and customers by region of the home district (customer_sk, district; district_name, region); unknown ones are unassigned."""
    homes = customers.join(districts.select(F.col("district_name").alias("district"), "region"), "district", "left")
    met = lines.where("customer_sk > 0").join(homes.select("customer_sk", "region"), "customer_sk", "left")
    return met.groupBy(F.coalesce("region", F.lit("unassigned")).alias("zone")).agg(money(F.sum("amount")).alias("revenue"), F.count_distinct("customer_sk").alias("customers"))


def stock_variance(book: DataFrame, counted: DataFrame, causes: DataFrame, key: str) -> DataFrame:
    """step, units, value from book to physical stock: book (key, quantity, unit_cost), causes (key, cause, quantity, signed), counted (key, quantity).

    What no cause explains is the step unexplained; products that were not counted are left out and products without book start at 0.
    """
    known = counted.select(key, F.col("quantity").alias("_n")).join(book.select(key, F.col("quantity").alias("_b"), "unit_cost"), key, "left")
    known = known.select(key, "_n", F.coalesce("_b", F.lit(0)).alias("_b"), F.coalesce("unit_cost", F.lit(0)).alias("unit_cost"))
    why = causes.groupBy(key, "cause").agg(F.sum("quantity").alias("q")).join(known, key)
    worth = lambda q: money(F.sum(q * F.col("unit_cost")))
    caused = why.groupBy(F.col("cause").alias("step")).agg(F.sum("q").alias("units"), worth(F.col("q")).alias("value"))
    ends = known.agg(F.sum("_b").alias("b"), F.sum("_n").alias("n"), worth(F.col("_b")).alias("bv"), worth(F.col("_n")).alias("nv"))
    ends = ends.select(F.explode(F.array(F.struct(F.lit("book").alias("step"), F.col("b").alias("units"), F.col("bv").alias("value")), F.struct(F.lit("physical").alias("step"), F.col("n").alias("units"), F.col("nv").alias("value"))))).select("col.*")
    sign = F.when(F.col("step") == "physical", 1).otherwise(-1)
    rest = ends.unionByName(caused).agg(F.sum(sign * F.col("units")).alias("units"), money(F.sum(sign * F.col("value"))).alias("value")).select(F.lit("unexplained").alias("step"), "units", "value")
    return ends.unionByName(caused).unionByName(rest)


def demand_potential(places: DataFrame, key: str) -> DataFrame:
    """key, potential, share: population times purchasing power over travel time; places without travel time or below zero have none."""
    worth = F.try_divide(F.col("population") * F.greatest(F.col("purchasing"), F.lit(0.0)), F.when(F.col("travel_minutes") > 0, F.col("travel_minutes")))
    own = places.select(key, F.coalesce(worth, F.lit(0.0)).alias("potential"))
    total = own.agg(F.sum("potential")).scalar()
    return own.select(key, F.round("potential", 4).alias("potential"), F.round(F.try_divide(F.col("potential"), total), 6).alias("share"))
