"""Loading a star schema: upserts, slowly changing dimensions, idempotent facts, checks."""

from __future__ import annotations

import contextlib
import fcntl
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import row_hash, surrogate_key
from .resolve import need_checkpoints

OPEN_END = "9999-12-31 00:00:00"


def upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Type 1: incoming rows replace current ones of the same key; rows without key are left out."""
    fresh = incoming.where(F.col(key).isNotNull() & (F.col(key) != ""))
    return current.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(*current.columns))


def with_unknown_member(dimension: DataFrame, sk: str, **values: str) -> DataFrame:
    """dimension with member 0, once."""
    row = dimension.sparkSession.range(1).select(*[F.lit(0).cast(t).alias(c) if c == sk else F.lit(values.get(c)).cast(t).alias(c) for c, t in dimension.dtypes])
    return dimension.where(F.col(sk) != 0).unionByName(row)


def kept(rows: DataFrame) -> DataFrame:
    """rows, computed once and read again from the session's shared checkpoint folder, for what uses them several times."""
    need_checkpoints(rows.sparkSession)
    return rows.checkpoint()


def replace_facts(current: DataFrame, batch: DataFrame, key: str = "sale_sk") -> DataFrame:
    """current with the batch's rows in place of those of the same key: loading a batch twice changes nothing."""
    return current.join(batch.select(key), key, "left_anti").unionByName(batch)


def changed(current: DataFrame, incoming: DataFrame, key: str, tracked: list[str]) -> DataFrame:
    """incoming rows that are new or differ in a tracked column, with is_new."""
    now = current.where("is_current").select(F.col(key), F.col("row_hash").alias("_hash"), F.lit(True).alias("_known"))
    fresh = incoming.withColumn("row_hash", row_hash(*[F.col(c) for c in tracked]))
    met = fresh.join(now, key, "left").withColumn("is_new", F.col("_known").isNull())
    return met.where(F.col("is_new") | (F.col("row_hash") != F.col("_hash"))).drop("_hash", "_known")


def scd2_merge(current: DataFrame, incoming: DataFrame, key: str, tracked: list[str], at: Column) -> DataFrame:
    """Type 2: a changed row closes the current version at `at` and opens the next; half-open intervals, one current version per key."""
    fresh = changed(current, incoming, key, tracked).drop("is_new")
    closing = fresh.select(key).withColumn("_close", F.lit(True))
    kept = current.join(closing, key, "left")
    ends = F.col("_close") & F.col("is_current")
    kept = kept.withColumn("valid_to", F.when(ends, at).otherwise(F.col("valid_to"))).withColumn("is_current", F.col("is_current") & F.col("_close").isNull()).drop("_close")
    opened = fresh.withColumns({"valid_from": at, "valid_to": F.to_timestamp(F.lit(OPEN_END)), "is_current": F.lit(True)})
    return kept.unionByName(opened.select(*kept.columns))


def first_versions(rows: DataFrame, tracked: list[str], at: Column) -> DataFrame:
    return rows.withColumns({"row_hash": row_hash(*[F.col(c) for c in tracked]), "valid_from": at, "valid_to": F.to_timestamp(F.lit(OPEN_END)), "is_current": F.lit(True)})


def as_of(versions: DataFrame, at: Column) -> DataFrame:
    return versions.where((F.col("valid_from") <= at) & (F.col("valid_to") > at))


def point_in_time(facts: DataFrame, versions: DataFrame, key: str, ts: str) -> DataFrame:
    """Each fact with the version of its key that was valid then: an equality join with a range condition on top."""
    return facts.join(versions, [key], "inner").where((F.col(ts) >= F.col("valid_from")) & (F.col(ts) < F.col("valid_to")))


def version_churn(versions: DataFrame, key: str, most: float = 1.05) -> DataFrame:
    """Versions per key; alert when a load has made every row look changed."""
    own = versions.agg(F.count(F.lit(1)).alias("versions"), F.count_distinct(key).alias("keys"))
    rate = F.try_divide(F.col("versions").cast("double"), F.nullif("keys", F.lit(0)).cast("double"))
    return own.withColumns({"per_key": rate, "alert": rate > most})


def orphans(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    return facts.join(dimension.select(key), key, "left_anti")


def load_checks(facts: DataFrame, customers: DataFrame, products: DataFrame, staged_total: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """check, value, passed: orphans by dimension, and the loaded amount against the batch's own staged total (one row, one column).

    customers has the unknown member, which stands for walk-ins. One pass over the facts.
    """
    known = lambda d, k, n: d.select(F.col(k), F.lit(True).alias(n))
    met = facts.join(known(customers, "customer_sk", "_c"), "customer_sk", "left").join(known(products, "product_sk", "_p"), "product_sk", "left")
    amount = lambda c: c.cast("decimal(24,2)")
    own = met.agg(amount(F.count_if(F.col("_c").isNull())).alias("c"), amount(F.count_if(F.col("_p").isNull())).alias("p"), amount(F.coalesce(F.sum("net_amount_ugx"), F.lit(0))).alias("t"))
    both = own.unionByName(staged_total.toDF("staged"), allowMissingColumns=True)  # one row each
    wide = both.agg(*[F.max(k).alias(k) for k in ("c", "p", "t", "staged")])
    checks = [("customer_orphans", F.col("c"), F.col("c") == 0), ("product_orphans", F.col("p"), F.col("p") == 0), ("control_total", F.col("t"), F.abs(F.col("t") - F.coalesce("staged", F.lit(0))) <= tolerance)]
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), v.alias("value"), ok.alias("passed")) for n, v, ok in checks])).alias("r")).select("r.*")


def dim_date(spark: SparkSession, first: str, last: str, holidays: dict[str, str] | None = None) -> DataFrame:
    """One row per day; holidays by ISO date."""
    names = F.create_map(*[F.lit(x) for kv in (holidays or {"": ""}).items() for x in kv])
    day = F.col("calendar_date")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("calendar_date"))
    holiday = F.try_element_at(names, day.cast("string"))
    return days.select(
        F.date_format(day, "yyyyMMdd").cast("int").alias("date_sk"),
        "calendar_date",
        F.date_format(day, "EEEE").alias("day_of_week"),
        F.dayofmonth(day).alias("day_of_month"),
        F.weekofyear(day).alias("week_of_year"),
        F.month(day).alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.quarter(day).alias("quarter"),
        F.year(day).alias("year"),
        (F.weekday(day) >= 5).alias("is_weekend"),
        holiday.isNotNull().alias("is_public_holiday"),
        holiday.alias("holiday_name"),
    )


def customer_dimension(clean: DataFrame) -> DataFrame:
    return clean.where("customer_id <> ''").withColumn("customer_sk", surrogate_key(F.col("customer_id")))


def product_dimension(clean: DataFrame) -> DataFrame:
    return clean.where("product_id <> ''").withColumn("product_sk", surrogate_key(F.col("product_id")))


def denormalised(facts: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """The reporting view: facts with the labels of their dimensions."""
    return facts.join(products.select("product_sk", F.col("category").alias("category_label"), "product_name"), "product_sk").join(customers.select("customer_sk", F.col("district").alias("customer_district")), "customer_sk", "left")


@contextlib.contextmanager
def single_writer(path: str) -> Iterator[None]:
    """At most one load at a time on the driver's machine; a second one fails at once."""
    with open(path, "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        yield


def run_record(spark: SparkSession, run_id: str, status: str, read: int, loaded: int, rejected: int, total: str, detail: str = "") -> DataFrame:
    schema = "run_id string, status string, rows_read long, rows_loaded long, rows_quarantined long, control_total string, error_detail string"
    return spark.createDataFrame([(run_id, status, read, loaded, rejected, total, detail)], schema).withColumn("finished_at", F.current_timestamp())


def latest_run(log: DataFrame) -> DataFrame:
    """The last successful run of a log of run_record() rows."""
    return log.where("status = 'SUCCESS'").orderBy(F.desc("finished_at"), F.desc("run_id")).limit(1)
