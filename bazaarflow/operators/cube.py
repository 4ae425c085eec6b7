"""KPI queries over sale lines: one filter object, compiled to a filter and an aggregation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.standardize import is_mobile_money


@dataclass
class Selection:
    """What a report is about. Empty lists select everything; months may come in either order."""

    months: tuple[str, str] | None = None
    cities: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    payments: list[str] = field(default_factory=list)

    def condition(self) -> Column:
        keep = F.lit(True)
        if self.months:
            keep &= F.col("month").between(min(self.months), max(self.months))
        for column, values in (("city", self.cities), ("category", self.categories), ("payment_method", self.payments)):
            if values:
                keep &= F.col(column).isin(values)
        return keep

    def apply(self, lines: DataFrame) -> DataFrame:
        return lines.where(self.condition())


def money(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("decimal(24,4)")


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def search(df: DataFrame, column: str, words: list[str], order: list[str], most: int) -> DataFrame:
    """The first rows, in the given order, whose column holds one of the words in any case."""
    text = F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
    found = [text.contains(w.lower()) for w in words]
    keep = F.lit(False)
    for x in found:
        keep |= x
    return df.where(keep).orderBy(*order).limit(most)


def kpi_block(lines: DataFrame, *by: str) -> DataFrame:
    amount = F.col("amount")
    return (
        lines.groupBy(*by)
        .agg(
            money(F.sum("amount")).alias("revenue"),
            F.count(F.lit(1)).alias("line_count"),
            money(F.sum(F.when(amount > 0, amount))).alias("sales"),
            money(F.sum(F.when(~(amount > 0), amount))).alias("returns"),
            money(F.sum(F.when(is_mobile_money(F.col("payment_method")), amount))).alias("momo"),
            F.count_distinct(F.when(F.col("customer_sk") > 0, F.col("customer_sk"))).alias("active_customers"),
        )
        .withColumns({"basket": ratio(F.col("revenue"), F.col("line_count")), "momo_share": ratio(F.col("momo"), F.col("revenue")), "return_rate": ratio(F.abs("returns"), F.col("sales"))})
    )


def revenue_by(lines: DataFrame, *by: str) -> DataFrame:
    return lines.groupBy(*by).agg(money(F.sum("amount")).alias("revenue"), F.count(F.lit(1)).alias("line_count"))


def dense_months(lines: DataFrame, *by: str) -> DataFrame:
    """Revenue of every month of the table for every value of `by`, zero where nothing was sold."""
    sums = revenue_by(lines, "month", *by)
    sold = F.when(F.col("month").isNotNull(), F.struct("month", "revenue"))
    own = sums.groupBy(*by).agg(F.map_from_entries(F.collect_list(sold)).alias("_sold"), F.min("month").alias("_low"), F.max("month").alias("_high"))
    whole = Window.partitionBy()  # one row per value of `by`
    day = lambda month: F.to_date(F.concat(month, F.lit("-01")))
    calendar = F.sequence(day(F.min("_low").over(whole)), day(F.max("_high").over(whole)), F.expr("interval 1 month"))
    spine = own.withColumn("_days", calendar).select(*by, "_sold", F.explode("_days").alias("_d")).withColumn("month", F.date_format("_d", "yyyy-MM"))
    known = F.lit(True)
    for c in by:
        known &= F.col(c).isNotNull()
    return spine.select("month", *by, money(F.when(known, F.try_element_at("_sold", F.col("month")))).alias("revenue"))


def with_share(df: DataFrame, value: str = "revenue", out: str = "share") -> DataFrame:
    """df, a small report, with each row's share of the total."""
    return df.withColumn(out, ratio(F.col(value), F.sum(value).over(Window.partitionBy())))


def store_table(lines: DataFrame) -> DataFrame:
    """One row per store with sales, the online store last."""
    stores = lines.groupBy("store_id", "city").agg(money(F.sum("amount")).alias("revenue"), F.count(F.lit(1)).alias("line_count"), F.count_if("is_return").alias("return_lines"))
    return with_share(stores).orderBy(F.col("store_id") == "ECOM01", "store_id")


def store_drill(lines: DataFrame, store: str) -> DataFrame:
    return with_share(revenue_by(lines.where(F.col("store_id") == store), "category")).orderBy(F.desc("revenue"), "category")


def new_and_returning(lines: DataFrame, selection: Selection | None = None) -> DataFrame:
    """Distinct customers of each month, new or returning by their first month in the whole history."""
    first = lines.where("customer_sk > 0").groupBy("customer_sk").agg(F.min("month").alias("first_month"))
    chosen = (selection or Selection()).apply(lines).where("customer_sk > 0").select("month", "customer_sk").distinct()
    return chosen.join(first, "customer_sk").groupBy("month").agg(F.count_if(F.col("month") == F.col("first_month")).alias("new_customers"), F.count_if(F.col("month") > F.col("first_month")).alias("returning_customers"))


def guarded_total(lines: DataFrame, expected: str | None = None) -> DataFrame:
    """The control total; raises if it is not the expected one, before anything is published."""
    total = lines.agg(money(F.sum("amount")).alias("control_total"), F.count(F.lit(1)).alias("line_count"))
    if expected is not None and str(total.first()["control_total"]) != expected:
        raise ValueError("control total differs: nothing is published")
    return total
