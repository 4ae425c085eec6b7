"""Retail inputs made from the star-schema tables by expressions that Spark and other SQL engines read alike.

Dirty extracts are derived from keys, so they are the same at every run and need no random numbers. The SQL texts name tables
as {lineitem} and so on; `load` fills in Parquet paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_DIGITS = "lpad(cast(c_custkey as string), 8, '0')"

#: customer_id, full_name, phone_number, email, district, registration_date, gender: all text.
DIRTY_CUSTOMERS = f"""
select concat('CUST', cast(100000 + c_custkey as string)) as customer_id,
  case when c_custkey % 40 = 4 then 'Mary O-Akello' when c_custkey % 40 = 8 then ' Q ' else case c_custkey % 4 when 0 then upper(c_name) when 1 then concat('  ', c_name, ' ') when 2 then '' else concat(c_name, '  Junior') end end as full_name,
  case c_custkey % 9 when 0 then concat('+2567', {_DIGITS}) when 1 then concat('07', {_DIGITS}) when 2 then concat('2567', {_DIGITS})
    when 3 then concat('7', {_DIGITS}) when 4 then concat('07', substr({_DIGITS}, 1, 2), ' ', substr({_DIGITS}, 3, 3), '-', substr({_DIGITS}, 6, 3))
    when 5 then concat('+256 77 ', substr({_DIGITS}, 2, 7)) when 6 then 'N/A' when 7 then '' else concat('07', lpad(cast(c_custkey % 50 as string), 8, '0')) end as phone_number,
  case when c_custkey % 35 = 9 then concat('a#', cast(c_custkey as string), '@x.com') when c_custkey % 35 = 11 then concat('é', cast(c_custkey as string), '@x.com') else case c_custkey % 5 when 0 then concat('user', cast(c_custkey as string), '@mail.com') when 1 then concat(' USER', cast(c_custkey % 40 as string), '@Shop.co.ug ')
    when 2 then 'broken.mail.com' when 3 then '' else concat('u', cast(c_custkey as string), '@host') end end as email,
  case c_custkey % 60 when 13 then 'Bushenyi District' when 14 then 'masindi district' when 15 then 'Mpigi District' when 16 then 'Mityanna' when 17 then 'kabarole district'
    when 18 then 'Nakasongolla' when 19 then 'Mukonno' when 20 then 'kampala road' else case c_custkey % 12 when 0 then 'Kampala' when 1 then 'kla' when 2 then 'KAMPALA ' when 3 then 'Jinja City' when 4 then 'Mbaraa' when 5 then 'Wakiso'
    when 6 then 'Nowhere' when 7 then '' when 8 then 'FortPortal' when 9 then 'Gulu District' when 10 then 'Kumi' else 'null' end end as district,
  case c_custkey % 6
    when 0 then concat(cast(2019 + c_custkey % 9 as string), '-', lpad(cast(1 + c_custkey % 12 as string), 2, '0'), '-', lpad(cast(1 + c_custkey % 28 as string), 2, '0'))
    when 1 then concat(lpad(cast(1 + c_custkey % 28 as string), 2, '0'), '/', lpad(cast(1 + c_custkey % 12 as string), 2, '0'), '/', cast(2019 + c_custkey % 6 as string))
    when 2 then concat(lpad(cast(1 + c_custkey % 28 as string), 2, '0'), '-', lpad(cast(1 + c_custkey % 12 as string), 2, '0'), '-', cast(2019 + c_custkey % 6 as string))
    when 3 then '31/02/2024' when 4 then '' else concat(cast(2019 + c_custkey % 6 as string), '-0', cast(1 + c_custkey % 9 as string), '-1', cast(c_custkey % 9 as string)) end as registration_date,
  case c_custkey % 7 when 0 then 'Male' when 1 then 'M' when 2 then 'female ' when 3 then 'F' when 4 then '' when 5 then 'x' else 'MALE' end as gender
from {{customer}}
"""

#: product_id, sku, product_name, category, unit_of_measure, cost_ugx, selling_price_ugx: all text.
DIRTY_PRODUCTS = """
select case when p_partkey % 33 = 0 then '' else concat('PRD', cast(200000 + p_partkey as string)) end as product_id,
  case when p_partkey % 19 = 0 then concat('SK', cast(p_partkey % 7 as string)) when p_partkey % 31 = 0 then 'bad sku' else concat('SKU', cast(p_partkey as string)) end as sku,
  p_name as product_name,
  case p_partkey % 9 when 0 then 'Beverages' when 1 then 'bevages' when 2 then 'Grains and Cereals' when 3 then ' SNACKS' when 4 then 'house hold'
    when 5 then 'personalcare' when 6 then 'Stationary' when 7 then 'Unknown' else case when p_partkey % 2 = 0 then 'Toys' else 'Stationerys' end end as category,
  case p_partkey % 10 when 0 then 'kg' when 1 then 'KGS' when 2 then 'grams' when 3 then 'Piece' when 4 then 'boxes' when 5 then 'litre' when 6 then 'ML'
    when 7 then '' when 8 then 'dozen' else 'pcs' end as unit_of_measure,
  case p_partkey % 5 when 0 then concat('UGX ', cast(1000 + p_partkey % 700 as string)) else cast(1000 + p_partkey % 700 as string) end as cost_ugx,
  case p_partkey % 7 when 0 then concat('ugx 1,', lpad(cast(p_partkey % 900 as string), 3, '0')) when 1 then 'N/A' when 2 then 'cheap' else cast(1100 + p_partkey % 500 as string) end as selling_price_ugx
from {part}
"""

#: transaction_id, store_id, customer_id, product_id, quantity, unit_price, payment_method, payment_ref, transaction_timestamp: all text.
DIRTY_SALES = """
select case when o_orderkey % 41 = 0 then concat('TX-', cast(o_orderkey as string)) else concat('TXN', cast(90000000 + o_orderkey as string)) end as transaction_id,
  case when o_orderkey % 23 = 0 then '' when o_orderkey % 24 = 0 then 'ECOM01' else concat('ST', lpad(cast(1 + o_orderkey % 23 as string), 2, '0')) end as store_id,
  case o_custkey % 12 when 0 then '' when 1 then 'NaN' else concat('CUST', cast(100000 + o_custkey as string)) end as customer_id,
  case when o_orderkey % 37 = 0 then 'N/A' else concat('PRD', cast(200000 + o_orderkey % 3000 as string)) end as product_id,
  case o_orderkey % 29 when 0 then 'N/A' when 1 then '-2' when 2 then '2.7' else cast(1 + o_orderkey % 5 as string) end as quantity,
  case o_orderkey % 31 when 0 then 'UGX cheap' when 1 then concat('UGX ', cast(1000 + o_orderkey % 9000 as string)) when 2 then '-50' else cast(500 + o_orderkey % 4000 as string) end as unit_price,
  case o_orderkey % 8 when 0 then 'MTN MoMo' when 1 then 'momo' when 2 then 'AirtelMoney' when 3 then 'Cash' when 4 then ' CARD ' when 5 then 'card' when 6 then 'MTN Mobile Money'
    else case when o_orderkey % 43 = 0 then 'Bitcoin' else 'cash' end end as payment_method,
  case when o_orderkey % 9 = 0 then '' else concat('MP', cast(o_orderkey % 700 as string)) end as payment_ref,
  case o_orderkey % 13 when 0 then '31/02/2024 14:08'
    when 1 then concat('0', cast(1 + o_orderkey % 9 as string), '/0', cast(1 + o_orderkey % 9 as string), '/2024 1', cast(o_orderkey % 9 as string), ':30')
    when 2 then concat('2024-0', cast(1 + o_orderkey % 9 as string), '-1', cast(o_orderkey % 9 as string), 'T08:15:00')
    else concat('2024-0', cast(1 + o_orderkey % 9 as string), '-1', cast(o_orderkey % 9 as string), ' 08:15:3', cast(o_orderkey % 9 as string)) end as transaction_timestamp
from {orders}
"""

#: One row per sale line with its store, city, category, payment method, month; amounts are DECIMAL(14,4), negative for returns.
SALE_LINES = """
select l_orderkey, l_partkey, l_suppkey, o_orderkey, l_shipdate as sold_at, substr(cast(l_shipdate as string), 1, 7) as month,
  case when o_custkey % 12 = 0 then 0 else o_custkey end as customer_sk, o_custkey,
  case when l_suppkey % 24 = 0 then 'ECOM01' else concat('ST', lpad(cast(l_suppkey % 24 as string), 2, '0')) end as store_id,
  case when l_suppkey % 24 = 0 then 'E-commerce' when l_suppkey % 24 <= 10 then 'Kampala' when l_suppkey % 24 <= 14 then 'Jinja'
    when l_suppkey % 24 <= 18 then 'Mbarara' else 'Gulu' end as city,
  p_type as category,
  case substr(o_orderpriority, 1, 1) when '1' then 'MTN_MOMO' when '2' then 'AIRTEL_MOMO' when '3' then 'CARD' else 'CASH' end as payment_method,
  case when l_returnflag = 'R' then -cast(l_quantity as int) else cast(l_quantity as int) end as quantity,
  l_returnflag = 'R' as is_return,
  case when l_orderkey % 9 = 0 then null else concat('REF', cast(l_orderkey % 5000 as string)) end as payment_ref,
  cast(case when l_returnflag = 'R' then -1 else 1 end * cast(l_extendedprice as decimal(12, 2)) * (1 - cast(l_discount as decimal(4, 2))) as decimal(14, 4)) as amount
from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey
"""


#: The rows of SALE_LINES, where what a line alone gives is computed before the joins: these then move few and short columns.
NARROW_LINES = """
select l_orderkey, l_partkey, l_suppkey, o_orderkey, sold_at, month, case when o_custkey % 12 = 0 then 0 else o_custkey end as customer_sk, o_custkey,
  store_id, city, p_type as category,
  case substr(o_orderpriority, 1, 1) when '1' then 'MTN_MOMO' when '2' then 'AIRTEL_MOMO' when '3' then 'CARD' else 'CASH' end as payment_method,
  quantity, is_return, payment_ref, amount
from (
  select l_orderkey, l_partkey, l_suppkey, l_shipdate as sold_at, substr(cast(l_shipdate as string), 1, 7) as month,
    case when l_suppkey % 24 = 0 then 'ECOM01' else concat('ST', lpad(cast(l_suppkey % 24 as string), 2, '0')) end as store_id,
    case when l_suppkey % 24 = 0 then 'E-commerce' when l_suppkey % 24 <= 10 then 'Kampala' when l_suppkey % 24 <= 14 then 'Jinja'
      when l_suppkey % 24 <= 18 then 'Mbarara' else 'Gulu' end as city,
    case when l_returnflag = 'R' then -cast(l_quantity as int) else cast(l_quantity as int) end as quantity,
    l_returnflag = 'R' as is_return,
    case when l_orderkey % 9 = 0 then null else concat('REF', cast(l_orderkey % 5000 as string)) end as payment_ref,
    cast(case when l_returnflag = 'R' then -1 else 1 end * cast(l_extendedprice as decimal(12, 2)) * (1 - cast(l_discount as decimal(4, 2))) as decimal(14, 4)) as amount
  from {lineitem}
) join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey
"""


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def plain(sql: str) -> str:
    """The same text over views of the tables' names."""
    return sql.format(**{t: t for t in TABLES})


def sale_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, NARROW_LINES)
