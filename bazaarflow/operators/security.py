"""Role-scoped views: default deny, granted columns, rows of one's own store, masked personal data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masking import mask_email, mask_name, mask_payment_ref, mask_phone

FINANCE = ["report_id", "report_month", "store_id", "gross_sales_ugx", "cogs_ugx", "gross_margin_ugx"]


@dataclass(frozen=True)
class Grant:
    operations: str  # of S, I, U, D
    columns: tuple[str, ...] = ()
    own_store: bool = False


# Role, table, granted operations. What is not listed is denied. Payment references are restricted, so store roles
# and analysts read sales through the masked view.
POLICY: dict[str, dict[str, Grant]] = {
    "store_cashier": {"sales": Grant("I", own_store=True), "sales_masked": Grant("S", own_store=True), "products": Grant("S"), "customers_masked": Grant("S")},
    "store_manager": {"sales": Grant("IU", own_store=True), "sales_masked": Grant("S", own_store=True), "products": Grant("S"), "customers_masked": Grant("S"), "financial_reports": Grant("S", own_store=True)},
    "data_analyst": {"sales_masked": Grant("S"), "products": Grant("S"), "customers_masked": Grant("S"), "financial_reports": Grant("S", columns=tuple(FINANCE))},
    "compliance_officer": {t: Grant("S") for t in ("sales", "sales_masked", "customers", "products", "financial_reports", "customers_masked")},
    "cdm_admin": {t: Grant("SIUD") for t in ("sales", "sales_masked", "customers", "products", "financial_reports", "customers_masked")},
}


class AccessDenied(PermissionError):
    pass


def authorise(role: str, table: str, operation: str = "S") -> Grant:
    grant = POLICY.get(role, {}).get(table)
    if grant is None or operation not in grant.operations:
        raise AccessDenied(f"{role} may not {operation} {table}")
    return grant


def secure(df: DataFrame, role: str, table: str, store: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """What role sees of table: granted columns (asking for others is denied), own rows where the grant says so."""
    grant = authorise(role, table)
    allowed = list(grant.columns) or df.columns
    if columns and (denied := sorted(set(columns) - set(allowed))):
        raise AccessDenied(f"{role} may not read {denied} of {table}")
    out = df.where(F.col("store_id") == F.lit(store)) if grant.own_store else df
    return out.select(*(columns or [c for c in df.columns if c in allowed]))


def insertable(rows: DataFrame, role: str, table: str, store: str | None = None) -> DataFrame:
    """rows that role may insert: of its own store where the grant says so, else the whole batch is denied."""
    grant = authorise(role, table, "I")
    if grant.own_store and not rows.where(~F.col("store_id").eqNullSafe(F.lit(store))).isEmpty():
        raise AccessDenied(f"{role} may insert rows of store {store} only")
    return rows


def customers_masked(customers: DataFrame) -> DataFrame:
    return customers.select("customer_id", mask_name(F.col("full_name")).alias("full_name"), mask_phone(F.col("phone")).alias("phone"), mask_email(F.col("email")).alias("email"), "district")


def sales_masked(sales: DataFrame) -> DataFrame:
    return sales.withColumn("payment_ref", mask_payment_ref(F.col("payment_ref")))


def matrix(df_spark) -> DataFrame:
    """role, object_name, operations: the whole policy as a table."""
    rows = [(r, t, g.operations) for r, own in POLICY.items() for t, g in own.items()]
    return df_spark.createDataFrame(rows, "role string, object_name string, operations string")


def audited(rows: DataFrame, role: str, table: str, log: str, at: str, user: str, store: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """secure(), with one row appended to the Parquet log for the attempt, allowed or denied."""
    spark, out, denied = rows.sparkSession, None, None
    try:
        out = secure(rows, role, table, store, columns)
    except AccessDenied as e:
        denied = e
    entry = [(at, user, role, table, "S", ",".join(columns or []), denied is None)]
    spark.createDataFrame(entry, "event_time string, app_user string, role string, table_name string, operation string, columns string, allowed boolean").coalesce(1).write.mode("append").parquet(log)
    if denied:
        raise denied
    return out
