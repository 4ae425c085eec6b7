"""Moving free-text districts to a reference dimension, and the queries that validate the move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reference_data import DISTRICTS


def dim_district(spark: SparkSession, regions: dict[str, str], valid_from: str = "2024-01-01") -> DataFrame:
    """One row per official district: code, name, region (null if the map has none), half-open validity."""
    rows = [(f"D{k:03d}", name, regions.get(name)) for k, name in enumerate(DISTRICTS, 1)]  # a fixed list
    return spark.createDataFrame(rows, "district_code string, district_name string, region string").select("*", F.lit(valid_from).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))


def with_district(customers: DataFrame, districts: DataFrame) -> DataFrame:
    """customers with district_code and region of the district that is valid now."""
    now = districts.where("valid_to is null").select(F.col("district_name").alias("district"), "district_code", "region")
    return customers.join(now, "district", "left")


def unmatched(left: DataFrame, right: DataFrame, condition: Column, present: str) -> DataFrame:
    """Rows of left for which the whole condition, filters on right included, finds no partner."""
    return left.join(right, condition, "left").where(F.col(present).isNull()).select(left["*"])


def validate(customers: DataFrame, districts: DataFrame, facts: DataFrame, raw: DataFrame, least_coverage: float = 99.5, most_versions: float = 1.05) -> DataFrame:
    """check, value, passed for V1 to V6.

    customers: customer_sk, district, district_code, region, is_current; facts: customer_sk; raw: district, district_code.
    """
    known = F.coalesce(F.col("district"), F.lit("")) != ""
    current = customers.where("is_current")
    lost = unmatched(current.where(known), districts, (F.col("district_name") == F.col("district")) & F.col("valid_to").isNull(), "district_name")
    n = F.count(F.lit(1))
    count = lambda df: df.agg(n.cast("double").alias("value"))
    share = F.coalesce(F.round(F.count_if(F.col("district_code").isNull()).cast("decimal(20,0)") * 100 / F.nullif(n, F.lit(0)), 4), F.lit(0)).cast("double")
    churn = F.round(n.cast("double") / F.nullif(F.count_distinct("customer_sk"), F.lit(0)), 6)
    members = customers.select("customer_sk").distinct()
    parts = [
        ("V1", count(lost), F.col("value") == 0),
        ("V2", current.where(known).agg(share.alias("value")), F.col("value") <= 100 - least_coverage),
        ("V3", count(current.where("region is null")), F.col("value") == 0),
        ("V4", customers.agg(churn.alias("value")), F.col("value") <= most_versions),
        ("V5", count(facts.join(members, "customer_sk", "left_anti")), F.col("value") == 0),
        ("V6", count(raw.where(known & F.col("district_code").isNull())), F.col("value") == 0),
    ]
    out = None
    for check, df, passed in parts:
        row = df.select(F.lit(check).alias("check"), "value", F.coalesce(passed, F.lit(True)).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out
