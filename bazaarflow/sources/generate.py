"""Dirty extracts of any size with the truth of what was injected.

Every draw is a digest of seed, salt and row number, so rows are made in parallel, are the same at each run and need no random
numbers. Each row carries `defects`, the names of what was done to it; truth() counts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 20261005
FIRST = ["Amina", "Brian", "Cissy", "David", "Esther", "Fred", "Grace", "Henry", "Irene", "Joseph"]
LAST = ["Akello", "Byaruhanga", "Kato", "Lubega", "Mugisha", "Nakato", "Okello", "Ssemanda"]
DISTRICT = ["Kampala", "kla", "Wakiso", "Jinja City", "Mbarara", "Gulu District", "Mukono"]
CATEGORY = ["Beverages", "bevages", "Grains & Cereals", " SNACKS", "house hold", "Stationery"]
UNIT = ["kg", "KGS", "pcs", "Piece", "litre", "ML"]
PAYMENT = ["MTN MoMo", "momo", "AirtelMoney", "Cash", "CARD"]


def draw(salt: str, below: int, row: Column | str = "id", seed: int = SEED) -> Column:
    """A number from 0 to below - 1 for each row."""
    row = F.col(row) if isinstance(row, str) else row
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-{salt}-"), row.cast("string"))), 1, 8), 16, 10).cast("bigint") % below


def pick(values: list[str], salt: str, row: Column | str = "id") -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), draw(salt, len(values), row).cast("int"))


def _finish(df: DataFrame, defects: dict[str, Column], columns: dict[str, Column]) -> DataFrame:
    named = F.filter(F.array(*[F.when(F.col(f"_{k}"), F.lit(k)) for k in defects]), lambda x: x.isNotNull())
    marked = df.withColumns({f"_{k}": v for k, v in defects.items()})
    return marked.select(*[v.alias(k) for k, v in columns.items()], named.alias("defects"))


def customers(spark: SparkSession, rows: int, copies: int) -> DataFrame:
    """rows raw customers, the last `copies` of which repeat an earlier one: exactly, under a misspelt name or with its phone written otherwise."""
    base = rows - copies
    copy = F.col("id") >= base
    of = F.when(copy, draw("copied", max(base, 1))).otherwise(F.col("id"))
    made = spark.range(rows).withColumn("of", of)
    number = F.lpad(draw("phone", 10**8, "of").cast("string"), 8, "0")
    kind = draw("copy", 100)
    c = F.col
    name = F.concat_ws(" ", pick(FIRST, "first", "of"), pick(LAST, "last", "of"))
    day = F.date_add(F.lit("2019-01-01").cast("date"), draw("day", 2000, "of").cast("int"))
    style = draw("date", 100, "of")
    return _finish(
        made,
        {"duplicate_rows": copy, "exact_copies": copy & (kind < 30), "fuzzy_name_variants": copy & (kind >= 30) & (kind < 70), "phone_variants": copy & (kind >= 70), "null_phone": draw("no phone", 100, "of") < 10, "null_email": draw("no email", 100, "of") < 6, "null_gender": draw("no gender", 100, "of") < 15},
        {
            "customer_id": F.concat(F.lit("CUST"), (c("id") + 100_000).cast("string")),
            "full_name": F.when(c("_fuzzy_name_variants"), F.concat(F.substring(name, 1, 2), F.substring(name, 4, 60))).otherwise(name),
            "phone_number": F.when(c("_null_phone"), "").when(c("_phone_variants"), F.concat(F.lit("07"), number)).otherwise(F.concat(F.lit("+2567"), number)),
            "email": F.when(c("_null_email"), "").otherwise(F.concat(F.lit("user"), c("of").cast("string"), F.lit("@mail.com"))),
            "district": pick(DISTRICT, "district", "of"),
            "registration_date": F.when(style < 55, day.cast("string")).when(style < 85, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "dd-MM-yyyy")),
            "gender": F.when(c("_null_gender"), "").otherwise(pick(["Male", "M", "female ", "F"], "gender", "of")),
        },
    )


def products(spark: SparkSession, rows: int) -> DataFrame:
    price = 1000 + draw("price", 50_000)
    c = F.col
    return _finish(
        spark.range(rows),
        {"null_key_rows": draw("no key", 100) < 3, "duplicate_sku_rows": (draw("sku", 100) < 6) & (c("id") >= 10), "currency_string_price": draw("currency", 100) < 4, "price_below_cost": draw("margin", 100) < 5},
        {
            "product_id": F.when(c("_null_key_rows"), "").otherwise(F.concat(F.lit("PRD"), (c("id") + 200_000).cast("string"))),
            "sku": F.concat(F.lit("SKU"), F.when(c("_duplicate_sku_rows"), c("id") % 10).otherwise(c("id")).cast("string")),
            "product_name": F.concat(F.lit("Product "), c("id").cast("string")),
            "category": pick(CATEGORY, "category"),
            "unit_of_measure": pick(UNIT, "unit"),
            "cost_ugx": F.when(c("_price_below_cost"), price + 100).otherwise(price - 200).cast("string"),
            "selling_price_ugx": F.when(c("_currency_string_price"), F.concat(F.lit("UGX "), price.cast("string"))).otherwise(price.cast("string")),
        },
    )


def sales(spark: SparkSession, rows: int, customers: int, products: int) -> DataFrame:
    """rows raw sales of the customers and products of the given numbers."""
    c = F.col
    at = F.timestamp_seconds(F.lit(1_719_800_000) + draw("second", 15_000_000))
    price = 500 + draw("sale price", 40_000)
    return _finish(
        spark.range(rows),
        {"negative_qty_rows": draw("return", 100) < 5, "null_payment_ref_rows": draw("no ref", 1000) < 113, "currency_string_unit_price": draw("sale currency", 1000) < 67, "blank_customer_rows": draw("walk-in", 100) < 8, "slash_timestamps": draw("style", 100) < 15},
        {
            "transaction_id": F.concat(F.lit("TXN"), (c("id") + 90_000_000).cast("string")),
            "store_id": F.when(draw("store", 24) == 0, "ECOM01").otherwise(F.concat(F.lit("ST"), F.lpad(draw("store", 24).cast("string"), 2, "0"))),
            "customer_id": F.when(c("_blank_customer_rows"), "").otherwise(F.concat(F.lit("CUST"), (draw("buyer", customers) + 100_000).cast("string"))),
            "product_id": F.concat(F.lit("PRD"), (draw("item", products) + 200_000).cast("string")),
            "quantity": F.when(c("_negative_qty_rows"), -1 - draw("units", 2)).otherwise(1 + draw("units", 5)).cast("string"),
            "unit_price": F.when(c("_currency_string_unit_price"), F.concat(F.lit("UGX "), price.cast("string"))).otherwise(price.cast("string")),
            "payment_method": pick(PAYMENT, "payment"),
            "payment_ref": F.when(c("_null_payment_ref_rows"), "").otherwise(F.concat(F.lit("MP"), c("id").cast("string"))),
            "transaction_timestamp": F.when(c("_slash_timestamps"), F.date_format(at, "dd/MM/yyyy HH:mm")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss")),
        },
    )


def truth(entity: str, made: DataFrame) -> DataFrame:
    """entity, defect, n: how often each defect was injected, and the rows."""
    counted = made.select(F.explode(F.array_append("defects", F.lit("rows"))).alias("defect")).groupBy("defect").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.lit(entity).alias("entity"), "defect", "n")
