"""Sales rows: typed or quarantined. The first rule that fails names the reason; every row has exactly one fate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import standardize as S
from ..functions.keys import surrogate_key

COLUMNS = ["transaction_id", "store_id", "customer_id", "product_id", "quantity", "unit_price", "payment_method", "payment_ref", "transaction_timestamp"]
# Timestamp formats, in the order in which they are tried, with their shapes.
TIMESTAMPS = (("yyyy-M-d H:m:s", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"), ("d/M/yyyy H:m", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$"), ("yyyy-M-d'T'H:m:s", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$"))
NO_ID = ["", "nan", "none", "n/a"]


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error before anything is loaded."""
    if lacking := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {lacking}")
    return df


def timestamp(c: Column) -> Column:
    s = S.stripped(c)
    return F.coalesce(*[F.try_to_timestamp(F.when(s.rlike(shape), s), F.lit(pattern)) for pattern, shape in TIMESTAMPS])


def whole_number(c: Column) -> Column:
    """Cut towards zero; null if not a number."""
    value = F.when(S.stripped(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), S.stripped(c).try_cast("double"))
    return value.try_cast("int")


def parse_sales(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """raw with typed columns and `rule`, the reason to quarantine the row, or null; keep: further columns to carry along."""
    require_columns(raw, COLUMNS)
    c = {k: S.stripped(F.col(k)) for k in COLUMNS}
    price, method, ref = S.price(F.col("unit_price")), S.payment(F.col("payment_method")), c["payment_ref"]
    quantity, sold_at = whole_number(F.col("quantity")), timestamp(F.col("transaction_timestamp"))
    rule = (
        F.when(~c["transaction_id"].rlike(S.TRANSACTION), "VR-004")
        .when(F.lower(c["product_id"]).isin(NO_ID), "VR-008")
        .when(quantity.isNull(), "SCHEMA_TYPE")
        .when(price["value"].isNull(), "SCHEMA_TYPE")
        .when(price["value"] < 0, "VALIDITY")
        .when(sold_at.isNull(), "VR-005")
        .when(method.isNull(), "VR-012")
    )
    momo, lacks = S.is_mobile_money(method), ref.isin("", "nan", "None")
    kept = F.when(momo & lacks, "PENDING_RECON").when(momo, ref).when(method == "CASH", F.when(ref == "", "N/A").otherwise(ref)).otherwise(F.when(ref == "", "MISSING_AUTH").otherwise(ref))
    status = F.when(momo, F.when(lacks, "PENDING").otherwise("MATCHED")).when(method == "CASH", "NOT_REQUIRED").otherwise(F.when(ref == "", "MISSING").otherwise("MATCHED"))
    return raw.select(
        F.struct(*COLUMNS).alias("raw"),
        rule.alias("rule"),
        c["transaction_id"].alias("transaction_id"),
        F.when(c["store_id"] == "", "UNKNOWN_STORE").otherwise(c["store_id"]).alias("store_id"),
        F.when(F.lower(c["customer_id"]).isin(NO_ID), "").otherwise(c["customer_id"]).alias("customer_id"),
        c["product_id"].alias("product_id"),
        quantity.alias("quantity"),
        price["value"].alias("unit_price_ugx"),
        (price["value"] * quantity).cast("decimal(18,2)").alias("net_amount_ugx"),
        (quantity < 0).alias("is_return"),
        method.alias("payment_method"),
        kept.alias("payment_ref"),
        status.alias("reconciliation_status"),
        sold_at.alias("sold_at"),
        *(keep or []),
    )


def second_copies(parsed: DataFrame) -> DataFrame:
    """parsed with rule DUPLICATE on all but one of the good rows of each transaction."""
    nth = F.row_number().over(Window.partitionBy("transaction_id").orderBy(F.xxhash64("raw"), F.to_json("raw")))
    kept = parsed.where("rule is null").withColumn("_n", nth).withColumn("rule", F.when(F.col("_n") > 1, "DUPLICATE")).drop("_n")
    return kept.unionByName(parsed.where("rule is not null"))  # rejects, often without any identifier, are not numbered


def good(parsed: DataFrame) -> DataFrame:
    return parsed.where("rule is null").drop("rule", "raw")


def quarantined(parsed: DataFrame, entity: str = "sales", run_id: str = "", at: str | None = None) -> DataFrame:
    """The rejects with their raw row as JSON, ready to be replayed; at: the time of the run."""
    return parsed.where("rule is not null").select(F.lit(run_id).alias("run_id"), F.lit(entity).alias("entity"), F.col("rule").alias("error_rule"), F.to_json("raw", {"ignoreNullFields": "false"}).alias("source_payload"), F.lit(False).alias("replayed"), F.lit(at).cast("timestamp").alias("quarantined_at"))


def quarantine_summary(rejects: DataFrame) -> DataFrame:
    """Open rejects by entity and rule, with the first and last time they were seen."""
    seen = F.col("quarantined_at")
    return rejects.where("not replayed").groupBy("entity", "error_rule").agg(F.count(F.lit(1)).alias("n"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen")).orderBy(F.desc("n"))


def replay(rejects: DataFrame) -> DataFrame:
    """Quarantined rows parsed again from their payload: those that pass now can be loaded."""
    schema = "struct<" + ",".join(f"{c}:string" for c in COLUMNS) + ">"
    return parse_sales(rejects.where("not replayed").select(F.from_json("source_payload", schema).alias("r")).select("r.*"))


def settle(rejects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to load, rejects with replayed set on those that pass now); payloads may have been corrected meanwhile."""
    schema = "struct<" + ",".join(f"{c}:string" for c in COLUMNS) + ">"
    opened = rejects.where("not replayed").withColumn("_raw", F.from_json("source_payload", schema))
    parsed = parse_sales(opened.select("_raw.*", *[F.col(c).alias(f"_{c}") for c in rejects.columns]), keep=[f"_{c}" for c in rejects.columns])
    again = parsed.select(*[F.col(f"_{c}").alias(c) for c in rejects.columns if c != "replayed"], F.col("rule").isNull().alias("replayed")).select(*rejects.columns)
    return good(parsed).drop(*[f"_{c}" for c in rejects.columns]), rejects.where("replayed").unionByName(again)


def with_keys(sales: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Sales with surrogate keys: an unknown customer is member 0, an unknown product leaves a null key (an orphan).

    The joins carry no broadcast hint: the planner broadcasts a dimension while it is small.
    """
    own = customers.select("customer_id", "customer_sk")
    met = sales.join(own, "customer_id", "left").join(products.select("product_id", "product_sk"), "product_id", "left")
    return met.withColumn("customer_sk", F.coalesce("customer_sk", F.lit(0).cast("bigint")))


def fact_sales(parsed: DataFrame, customers: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, orphans): good rows with all keys, and good rows of unknown products."""
    keyed = with_keys(good(parsed), customers, products).withColumn("sale_sk", surrogate_key(F.col("transaction_id")))
    return keyed.where("product_sk is not null"), keyed.where("product_sk is null")
