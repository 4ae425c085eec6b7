"""The star schema: tables, their constraints, and what a load breaks of them.

Parquet tables enforce no keys, so constraints are measured after a load. Facts are partitioned by month in place of indexes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_VERSION = "valid_from timestamp, valid_to timestamp, is_current boolean, row_hash string, source_system string, etl_run_id string, created_at timestamp"
_MONEY = "decimal(14,2)"
# Tables and columns.
TABLES = {
    "dim_customer": f"customer_sk bigint, customer_bk string, full_name string, phone_e164 string, email string, district string, gender string, loyalty_tier string, registration_date date, consent_marketing boolean, consent_gdpr_eu boolean, {_VERSION}",
    "dim_product": f"product_sk bigint, product_bk string, sku string, product_name string, category string, subcategory string, unit_of_measure string, cost_ugx {_MONEY}, selling_price_ugx {_MONEY}, supplier_bk string, {_VERSION}",
    "dim_store": "store_sk bigint, store_bk string, store_name string, store_type string, city string, district string, region string, opening_date date, has_pos_offline_mode boolean, store_relocation_note string, is_current boolean, etl_run_id string",
    "dim_date": "date_sk int, calendar_date date, day_of_week string, day_of_month smallint, week_of_year smallint, month smallint, month_name string, quarter smallint, year smallint, is_weekend boolean, is_public_holiday boolean, holiday_name string, trading_week smallint",
    "dim_payment_method": "payment_sk bigint, payment_bk string, payment_method string, provider string, channel string, is_mobile_money boolean, settlement_lag_days smallint, requires_payment_ref boolean, is_current boolean",
    "fact_sales": f"sale_sk bigint, transaction_id string, store_sk bigint, customer_sk bigint, product_sk bigint, date_sk int, payment_sk bigint, quantity int, unit_price_ugx {_MONEY}, gross_amount_ugx {_MONEY}, discount_ugx {_MONEY}, net_amount_ugx {_MONEY}, cost_of_goods_ugx {_MONEY}, is_return boolean, is_mobile_money boolean, payment_ref string, reconciliation_status string, source_system string, event_ts timestamp, etl_run_id string, loaded_at timestamp",
}


@dataclass(frozen=True)
class Rule:
    table: str
    column: str
    kind: str  # unique, present, within, known
    values: tuple[str, ...] = ()  # of within
    refers: str = ""  # table of known; the column has the same name there


# Constraints. Of versioned tables the surrogate key is unique.
RULES = [
    Rule("dim_customer", "customer_sk", "unique"),
    Rule("dim_product", "product_sk", "unique"),
    Rule("dim_product", "unit_of_measure", "within", ("kg", "pcs", "liters")),
    Rule("dim_store", "store_bk", "unique"),
    Rule("dim_store", "store_type", "within", ("PHYSICAL", "ECOMMERCE", "OMNICHANNEL")),
    Rule("dim_date", "calendar_date", "unique"),
    Rule("dim_payment_method", "payment_bk", "unique"),
    Rule("dim_payment_method", "channel", "within", ("MOBILE_MONEY", "CARD", "CASH")),
    Rule("fact_sales", "transaction_id", "unique"),
    Rule("fact_sales", "transaction_id", "present"),
    Rule("fact_sales", "reconciliation_status", "within", ("MATCHED", "PENDING", "MISSING", "NOT_REQUIRED")),
    Rule("fact_sales", "store_sk", "known", refers="dim_store"),
    Rule("fact_sales", "customer_sk", "known", refers="dim_customer"),
    Rule("fact_sales", "product_sk", "known", refers="dim_product"),
    Rule("fact_sales", "date_sk", "known", refers="dim_date"),
    Rule("fact_sales", "payment_sk", "known", refers="dim_payment_method"),
]


def create(spark: SparkSession, database: str, location: str | None = None) -> None:
    """Create what is missing of the star schema, in the warehouse or at location; existing tables are left as they are."""
    spark.sql(f"create database if not exists `{database}`" + (f" location '{location}'" if location else ""))
    for name, columns in TABLES.items():
        month = " partitioned by (sale_month)" if name == "fact_sales" else ""
        spark.sql(f"create table if not exists `{database}`.{name} ({columns}{', sale_month int' if month else ''}) using parquet{month}")


def conform(df: DataFrame, table: str, **values: Column) -> DataFrame:
    """df with the columns and types of a table; values fill columns, others that df lacks are null."""
    known = {c.lower() for c in df.columns}
    fields = [f.rsplit(" ", 1) for f in TABLES[table].split(", ")]
    return df.select(*[values.get(c, F.col(c) if c in known else F.lit(None)).cast(t).alias(c) for c, t in fields])


def violations(tables: dict[str, DataFrame], rules: list[Rule] = RULES) -> DataFrame:
    """table_name, column_name, kind, n: rows (unique: keys) that break each constraint of the given tables. Null keys break no reference."""
    out = None
    for r in rules:
        if r.table not in tables or (r.refers and r.refers not in tables):
            continue
        own, c = tables[r.table].select(r.column), F.col(r.column)
        if r.kind == "unique":
            broken = own.where(c.isNotNull()).groupBy(r.column).count().where("count > 1")
        elif r.kind == "present":
            broken = own.where(c.isNull() | (c.cast("string") == ""))
        elif r.kind == "within":
            broken = own.where(~F.coalesce(c.isin(*r.values), F.lit(False)))
        else:
            # keys are counted before the join: a hot key is one row of it
            broken = own.where(c.isNotNull()).groupBy(r.column).count().join(tables[r.refers].select(r.column), r.column, "left_anti")
        n = F.sum("count") if r.kind == "known" else F.count(F.lit(1))
        row = broken.agg(F.coalesce(n, F.lit(0)).alias("n")).select(F.lit(r.table).alias("table_name"), F.lit(r.column).alias("column_name"), F.lit(r.kind).alias("kind"), "n")
        out = row if out is None else out.unionByName(row)
    return out
