"""Cleansing: standardized columns beside the raw ones, and the split of rows that cannot be kept."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import standardize as S
from ..functions.reference_data import CATEGORIES, DISTRICTS
from ..functions.similarity import nearest

#: Least similarity of near spellings.
NEAR_DISTRICT, NEAR_CATEGORY = 88.0, 85.0


def with_near_labels(df: DataFrame, value: str, status: str, official: list[str], least: float) -> DataFrame:
    """df with unresolved labels replaced by the official name they are near enough to, as fuzzy_mapped.

    Similarity is computed once for each distinct label; its answers are joined back, broadcast by the planner while they are few.
    """

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = batch.assign(_near=[nearest(x, official, least) for x in batch["_label"]])
            yield found[found["_near"].notna()]

    unresolved = F.when(F.col(status) == "unresolved", F.col(value))
    labels = df.select(unresolved.alias("_label")).where("_label is not null").distinct()
    near = labels.mapInPandas(match, "_label string, _near string")
    met = df.withColumn("_label", unresolved).join(near, "_label", "left")
    return met.withColumns({value: F.coalesce("_near", value), status: F.when(F.col("_near").isNotNull(), "fuzzy_mapped").otherwise(F.col(status))}).select(*df.columns)


def cleanse_customers(raw: DataFrame) -> DataFrame:
    phone, district, day, gender = (f(F.col(c)) for f, c in ((S.phone, "phone_number"), (S.district, "district"), (S.date, "registration_date"), (S.gender, "gender")))
    clean = raw.select(
        S.stripped(F.col("customer_id")).alias("customer_id"),
        S.full_name(F.col("full_name")).alias("full_name"),
        F.col("phone_number").alias("phone_number_raw"),
        phone["value"].alias("phone_e164"),
        phone["status"].alias("phone_status"),
        S.email(F.col("email")).alias("email"),
        F.col("district").alias("district_raw"),
        district["value"].alias("district"),
        district["status"].alias("district_status"),
        F.col("registration_date").alias("registration_date_raw"),
        day["value"].alias("registration_date"),
        day["status"].alias("date_format_original"),
        F.col("gender").alias("gender_raw"),
        gender["value"].alias("gender"),
        gender["status"].alias("gender_status"),
    )
    return with_near_labels(clean, "district", "district_status", DISTRICTS, NEAR_DISTRICT)


def cleanse_products(raw: DataFrame) -> DataFrame:
    """With margin and duplicate-SKU flags; `bad_key` marks rows for quarantine."""
    unit, category, cost, sell = (f(F.col(c)) for f, c in ((S.unit, "unit_of_measure"), (S.category, "category"), (S.price, "cost_ugx"), (S.price, "selling_price_ugx")))
    sku = S.stripped(F.col("sku"))
    counts = raw.select(sku.alias("sku")).groupBy("sku").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 and sku not in ('', 'nan')").select("sku", F.lit(True).alias("_twice"))
    own = raw.select(
        S.stripped(F.col("product_id")).alias("product_id"),
        sku.alias("sku"),
        "product_name",
        F.col("unit_of_measure").alias("unit_raw"),
        unit["value"].alias("unit_of_measure"),
        unit["status"].alias("unit_status"),
        F.col("category").alias("category_raw"),
        category["value"].alias("category"),
        category["status"].alias("category_status"),
        cost["value"].alias("cost_ugx"),
        sell["value"].alias("selling_price_ugx"),
        sell["status"].alias("price_status"),
        F.coalesce(sell["value"] < cost["value"], F.lit(False)).alias("margin_anomaly"),
    )
    own = with_near_labels(own, "category", "category_status", list(CATEGORIES), NEAR_CATEGORY)
    return own.join(counts, "sku", "left").select(*own.columns, F.coalesce("_twice", F.lit(False)).alias("duplicate_sku"), F.lower("product_id").isin("", "nan").alias("bad_key"))


def split(df: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined): every row is in exactly one."""
    return df.where(~F.coalesce(flag, F.lit(False))).drop(flag), df.where(F.coalesce(flag, F.lit(False))).drop(flag)


def exact_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of rows in groups that agree in all columns."""
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_rows"))


def skus_with_names(df: DataFrame) -> DataFrame:
    """SKUs that stand for more than one product name."""
    return df.where("sku <> ''").groupBy("sku").agg(F.count_distinct("product_name").alias("names")).where("names > 1")
