"""SQL for the queries, for another engine to check them with."""

from __future__ import annotations

from ..functions.reference_data import CONVERTED, PAYMENTS, UNITS, spellings
from .inputs import DIRTY_CUSTOMERS, DIRTY_PRODUCTS, DIRTY_SALES, SALE_LINES, plain

OFFICIAL_CATEGORIES = "('Beverages', 'Grains & Cereals', 'Snacks', 'Household', 'Personal Care', 'Stationery')"
MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
MOMO = "('MTN_MOMO', 'AIRTEL_MOMO')"


def _cte(**parts: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in parts.items()) + "\n"


def _case(key: str, table: dict[str, str]) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return f"CASE {key} " + " ".join(f"WHEN {quote(a)} THEN {quote(b)}" for a, b in table.items()) + " END"


LINES = _cte(s=plain(SALE_LINES))


def strip(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')"


def phone(c: str) -> tuple[str, str]:
    d = f"regexp_replace({strip(c)}, '\\D', '', 'g')"
    n = f"(CASE WHEN length({d}) = 12 AND {d} LIKE '256%' THEN '0' || substr({d}, 4) WHEN length({d}) = 9 AND {d} LIKE '7%' THEN '0' || {d} ELSE {d} END)"
    missing, valid = f"lower({strip(c)}) IN ('', 'nan', 'none', 'null', 'n/a')", f"regexp_full_match({n}, '07\\d{{8}}')"
    return f"CASE WHEN {missing} THEN '' WHEN {valid} THEN '+256' || substr({n}, 2) ELSE {strip(c)} END", f"CASE WHEN {missing} THEN 'missing' WHEN {valid} THEN 'valid' ELSE 'invalid' END"


def date(c: str) -> tuple[str, str]:
    s = strip(c)
    tries = [("%Y-%m-%d", "\\d{4}-\\d{1,2}-\\d{1,2}"), ("%d/%m/%Y", "\\d{1,2}/\\d{1,2}/\\d{4}"), ("%d-%m-%Y", "\\d{1,2}-\\d{1,2}-\\d{4}")]
    parsed = [f"CASE WHEN regexp_full_match({s}, '{r}') THEN try_strptime({s}, '{f}') END" for f, r in tries]
    missing = f"lower({s}) IN ('', 'nan', 'none', 'null')"
    value = f"CASE WHEN {missing} THEN '' ELSE coalesce(strftime(coalesce({', '.join(parsed)}), '%Y-%m-%d'), {s}) END"
    status = f"CASE WHEN {missing} THEN 'missing' " + " ".join(f"WHEN ({p}) IS NOT NULL THEN '{f}'" for p, (f, _) in zip(parsed, tries, strict=True)) + " ELSE 'unparseable' END"
    return value, status


def coded(c: str, table: dict[str, str], mapped: str, missing: str = "('', 'nan', 'none', 'null')") -> tuple[str, str]:
    key = f"lower({strip(c)})"
    value = _case(key, table)
    return f"CASE WHEN {key} IN {missing} THEN '' ELSE coalesce({value}, {strip(c)}) END", f"CASE WHEN {key} IN {missing} THEN 'missing' WHEN {value} IS NOT NULL THEN {mapped} ELSE 'unresolved' END"


def unit(c: str) -> tuple[str, str]:
    return coded(c, spellings(UNITS), f"CASE WHEN lower({strip(c)}) IN {tuple(CONVERTED)} THEN 'converted' ELSE 'mapped' END")


# What the labels of the dirty extracts must become; written out here, so a wrong table elsewhere shows.
DISTRICT_ANSWERS = {
    "kampala": ("Kampala", "exact"),
    "kla": ("Kampala", "variant_mapped"),
    "jinja city": ("Jinja", "exact_remapped"),
    "mbaraa": ("Mbarara", "variant_mapped"),
    "wakiso": ("Wakiso", "exact"),
    "fortportal": ("Fort Portal", "variant_mapped"),
    "gulu district": ("Gulu", "variant_mapped"),
    "kumi": ("Kumi", "exact"),
    "bushenyi district": ("Bushenyi", "variant_mapped"),
    "masindi district": ("Masindi", "variant_mapped"),
    "mpigi district": ("Mpigi", "variant_mapped"),
    "mityanna": ("Mityana", "variant_mapped"),
    "kabarole district": ("Fort Portal", "variant_mapped"),
    "nakasongolla": ("Nakasongola", "fuzzy_mapped"),
    "mukonno": ("Mukono", "fuzzy_mapped"),
    "kampala road": ("Kampala", "fuzzy_mapped"),
} | {x.lower(): (x, "exact") for x in ("Jinja", "Mbarara", "Fort Portal", "Gulu", "Bushenyi", "Masindi", "Mpigi", "Mityana", "Nakasongola", "Mukono")}
CATEGORY_ANSWERS = {
    "beverages": ("Beverages", "mapped"),
    "bevages": ("Beverages", "mapped"),
    "grains and cereals": ("Grains & Cereals", "mapped"),
    "snacks": ("Snacks", "mapped"),
    "house hold": ("Household", "mapped"),
    "personalcare": ("Personal Care", "mapped"),
    "stationary": ("Stationery", "mapped"),
    "stationerys": ("Stationery", "fuzzy_mapped"),
    "unknown": ("", "mapped"),
}


def answered(c: str, answers: dict[str, tuple[str, str]], missing: str) -> tuple[str, str]:
    key = f"lower({strip(c)})"
    value, status = (_case(key, {k: v[i] for k, v in answers.items()}) for i in (0, 1))
    return f"CASE WHEN {key} IN {missing} THEN '' ELSE coalesce({value}, {strip(c)}) END", f"CASE WHEN {key} IN {missing} THEN 'missing' ELSE coalesce({status}, 'unresolved') END"


def category(c: str) -> tuple[str, str]:
    return answered(c, CATEGORY_ANSWERS, "('')")


def district(c: str) -> tuple[str, str]:
    return answered(c, DISTRICT_ANSWERS, "('', 'nan', 'none', 'null')")


def gender(c: str) -> tuple[str, str]:
    return coded(c, {"male": "M", "m": "M", "female": "F", "f": "F"}, "'mapped'")


def price(c: str) -> tuple[str, str]:
    bare = f"regexp_replace({strip(c)}, '(?i)ugx|[,\\s]', '', 'g')"
    value = f"CASE WHEN regexp_full_match({bare}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)') THEN TRY_CAST({bare} AS DECIMAL(14, 2)) END"
    missing = f"lower({strip(c)}) IN ('', 'nan', 'none', 'null', 'n/a')"
    return f"CASE WHEN NOT {missing} THEN {value} END", f"CASE WHEN {missing} THEN 'missing' WHEN ({value}) IS NOT NULL THEN 'valid' ELSE 'invalid' END"


def standard(base: str, key: str, column: str, pair: tuple[str, str]) -> str:
    return _cte(d=plain(base)) + f"SELECT {key}, {column} AS raw, {pair[0]} AS value, {pair[1]} AS status FROM d"


CLEAN = f"""SELECT {strip("customer_id")} AS customer_id, regexp_replace({strip("full_name")}, '\\s+', ' ', 'g') AS full_name, {phone("phone_number")[0]} AS phone_e164, {phone("phone_number")[1]} AS phone_status,
  lower({strip("email")}) AS email, {district("district")[0]} AS district, {district("district")[1]} AS district_status, {date("registration_date")[0]} AS registration_date, {date("registration_date")[1]} AS date_format_original,
  {gender("gender")[0]} AS gender, {gender("gender")[1]} AS gender_status FROM d"""
CUSTOMERS = {"d": plain(DIRTY_CUSTOMERS), "c": CLEAN}
PRODUCTS_CLEAN = f"""SELECT {strip("product_id")} AS product_id, {strip("sku")} AS sku, product_name, {unit("unit_of_measure")[0]} AS unit_of_measure, {unit("unit_of_measure")[1]} AS unit_status, {category("category")[0]} AS category, {category("category")[1]} AS category_status,
  {price("cost_ugx")[0]} AS cost_ugx, {price("selling_price_ugx")[0]} AS selling_price_ugx, {price("selling_price_ugx")[1]} AS price_status, coalesce({price("selling_price_ugx")[0]} < {price("cost_ugx")[0]}, false) AS margin_anomaly,
  count(*) OVER (PARTITION BY {strip("sku")}) > 1 AND {strip("sku")} NOT IN ('', 'nan') AS duplicate_sku, lower({strip("product_id")}) IN ('', 'nan') AS bad_key FROM p"""

_QTY = f"CASE WHEN regexp_full_match({strip('quantity')}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)') THEN TRY_CAST(trunc(TRY_CAST({strip('quantity')} AS DOUBLE)) AS INT) END"
_TS = strip("transaction_timestamp")
_SOLD = f"""coalesce(CASE WHEN regexp_full_match({_TS}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}} \\d{{1,2}}:\\d{{1,2}}:\\d{{1,2}}') THEN try_strptime({_TS}, '%Y-%m-%d %H:%M:%S') END,
  CASE WHEN regexp_full_match({_TS}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}} \\d{{1,2}}:\\d{{1,2}}') THEN try_strptime({_TS}, '%d/%m/%Y %H:%M') END,
  CASE WHEN regexp_full_match({_TS}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}T\\d{{1,2}}:\\d{{1,2}}:\\d{{1,2}}') THEN try_strptime({_TS}, '%Y-%m-%dT%H:%M:%S') END)"""
_PARTS = f"""SELECT *, {strip("transaction_id")} AS txn, {strip("product_id")} AS pid, {_QTY} AS q, {price("unit_price")[0]} AS up, {_SOLD} AS sold, {_case(f"upper({strip('payment_method')})", spellings(PAYMENTS))} AS pm, {strip("payment_ref")} AS ref FROM raw"""
_PARSED = f"""SELECT CASE WHEN NOT regexp_full_match(txn, 'TXN\\d{{6,12}}') THEN 'VR-004' WHEN lower(pid) IN ('', 'nan', 'none', 'n/a') THEN 'VR-008' WHEN q IS NULL OR up IS NULL THEN 'SCHEMA_TYPE' WHEN up < 0 THEN 'VALIDITY' WHEN sold IS NULL THEN 'VR-005' WHEN pm IS NULL THEN 'VR-012' END AS rule,
  txn AS transaction_id, CASE WHEN {strip("store_id")} = '' THEN 'UNKNOWN_STORE' ELSE {strip("store_id")} END AS store_id, CASE WHEN lower({strip("customer_id")}) IN ('', 'nan', 'none', 'n/a') THEN '' ELSE {strip("customer_id")} END AS customer_id, pid AS product_id, q AS quantity, up AS unit_price_ugx,
  CAST(up * q AS DECIMAL(18, 2)) AS net_amount_ugx, q < 0 AS is_return, pm AS payment_method,
  CASE WHEN pm IN {MOMO} THEN CASE WHEN ref IN ('', 'nan', 'None') THEN 'PENDING_RECON' ELSE ref END WHEN pm = 'CASH' THEN CASE WHEN ref = '' THEN 'N/A' ELSE ref END ELSE CASE WHEN ref = '' THEN 'MISSING_AUTH' ELSE ref END END AS payment_ref,
  CASE WHEN pm IN {MOMO} THEN CASE WHEN ref IN ('', 'nan', 'None') THEN 'PENDING' ELSE 'MATCHED' END WHEN pm = 'CASH' THEN 'NOT_REQUIRED' WHEN ref = '' THEN 'MISSING' ELSE 'MATCHED' END AS reconciliation_status, sold AS sold_at FROM parts"""
SALES = {"raw": plain(DIRTY_SALES), "parts": _PARTS, "parsed": _PARSED}


def _sk(c: str) -> str:
    return f"CAST(('0x' || substr(sha1({c}), 1, 15)) AS BIGINT)"


FACTS = SALES | {
    "d": plain(DIRTY_CUSTOMERS),
    "p": plain(DIRTY_PRODUCTS),
    "f": f"SELECT s.*, coalesce(c.sk, 0) AS customer_sk, pr.sk AS product_sk, {_sk('transaction_id')} AS sale_sk FROM parsed s LEFT JOIN (SELECT {strip('customer_id')} AS id, {_sk(strip('customer_id'))} AS sk FROM d) c ON s.customer_id = c.id LEFT JOIN (SELECT {strip('product_id')} AS id, {_sk(strip('product_id'))} AS sk FROM p WHERE {strip('product_id')} <> '') pr ON s.product_id = pr.id WHERE rule IS NULL",
}
KPI = f"""sum(amount) AS revenue, count(*) AS line_count, coalesce(sum(CASE WHEN amount > 0 THEN amount END), 0) AS sales, coalesce(sum(CASE WHEN NOT amount > 0 THEN amount END), 0) AS returns,
  coalesce(sum(CASE WHEN payment_method IN {MOMO} THEN amount END), 0) AS momo, count(DISTINCT CASE WHEN customer_sk > 0 THEN customer_sk END) AS active_customers,
  coalesce(CAST(sum(amount) AS DOUBLE) / nullif(count(*), 0), 0) AS basket, coalesce(CAST(sum(CASE WHEN payment_method IN {MOMO} THEN amount END) AS DOUBLE) / nullif(CAST(sum(amount) AS DOUBLE), 0), 0) AS momo_share,
  coalesce(CAST(abs(sum(CASE WHEN NOT amount > 0 THEN amount END)) AS DOUBLE) / nullif(CAST(sum(CASE WHEN amount > 0 THEN amount END) AS DOUBLE), 0), 0) AS return_rate"""
REV = "coalesce(sum(amount), 0) AS revenue, count(*) AS line_count"
BOUGHT = "SELECT DISTINCT customer_sk, month FROM s WHERE customer_sk > 0 AND NOT is_return"
_BELOW = lambda c, order: f"least(floor((rank() OVER (ORDER BY {c} {order}) - 1) / count(*) OVER () * 5) + 1, 5)::INT"
FIRST_MONTH = "CAST(substr({0}, 1, 4) AS INT) * 12 + CAST(substr({0}, 6, 2) AS INT)"

ORACLES: dict[str, str] = {
    "kpi_block": LINES + f"SELECT {KPI} FROM s",
    "kpi_selection": LINES + f"SELECT {KPI} FROM s WHERE month BETWEEN '1995-01' AND '1996-12' AND city IN ('Kampala', 'Gulu') AND payment_method IN ('CARD', 'CASH')",
    "revenue_month_city": LINES + ", m AS (SELECT DISTINCT month FROM s), c AS (SELECT DISTINCT city FROM s) SELECT m.month, c.city, coalesce(sum(amount), 0) AS revenue FROM m CROSS JOIN c LEFT JOIN s ON s.month = m.month AND s.city = c.city GROUP BY ALL",
    "revenue_month": LINES + f"SELECT month, {REV} FROM s GROUP BY 1",
    "revenue_category": LINES + f"SELECT category, {REV} FROM s GROUP BY 1",
    "payment_share": LINES + f"SELECT payment_method, {REV}, CAST(sum(amount) AS DOUBLE) / CAST(sum(sum(amount)) OVER () AS DOUBLE) AS share FROM s GROUP BY 1",
    "store_table": LINES + "SELECT store_id, city, coalesce(sum(amount), 0) AS revenue, count(*) AS line_count, count(*) FILTER (is_return) AS return_lines, CAST(sum(amount) AS DOUBLE) / CAST(sum(sum(amount)) OVER () AS DOUBLE) AS share FROM s GROUP BY 1, 2",
    "store_drill": LINES + f"SELECT category, {REV}, CAST(sum(amount) AS DOUBLE) / CAST(sum(sum(amount)) OVER () AS DOUBLE) AS share FROM s WHERE store_id = 'ST05' GROUP BY 1",
    "new_vs_returning": LINES + ", f AS (SELECT customer_sk, min(month) AS fm FROM s WHERE customer_sk > 0 GROUP BY 1) SELECT month, count(DISTINCT CASE WHEN month = fm THEN s.customer_sk END) AS new_customers, count(DISTINCT CASE WHEN month > fm THEN s.customer_sk END) AS returning_customers FROM s JOIN f USING (customer_sk) GROUP BY 1",
    "control_total": LINES + "SELECT sum(amount) AS control_total, count(*) AS line_count FROM s",
    "top_categories": LINES + f"SELECT category, {REV} FROM s GROUP BY 1 ORDER BY revenue DESC, category LIMIT 3",
    "monthly_active": LINES + f", b AS ({BOUGHT}) SELECT month, count(*) AS active_customers FROM b GROUP BY 1",
    "retention": LINES + f", b AS ({BOUGHT}) SELECT b.month, count(*) AS customers, count(n.month) AS retained, count(*) - count(n.month) AS churned, CAST(count(n.month) AS DOUBLE) / count(*) AS retention FROM b LEFT JOIN b n ON n.customer_sk = b.customer_sk AND n.month = strftime(CAST(b.month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') GROUP BY 1",
    "revenue_at_risk": LINES + ", o AS (SELECT customer_sk, max(CAST(sold_at AS DATE)) AS last_day, coalesce(sum(CASE WHEN CAST(sold_at AS DATE) > DATE '1997-06-30' - 90 THEN amount END), 0) AS t FROM s WHERE customer_sk > 0 AND CAST(sold_at AS DATE) <= DATE '1997-06-30' GROUP BY 1) SELECT count(*) AS idle_customers, coalesce(sum(t), 0) AS revenue_at_risk FROM o WHERE DATE '1997-06-30' - last_day >= 45",
    "rfm": LINES + f", o AS (SELECT customer_sk, DATE '1999-01-01' - max(CAST(sold_at AS DATE)) AS recency, count(DISTINCT o_orderkey) AS frequency, sum(amount) AS money FROM s WHERE customer_sk > 0 GROUP BY 1) SELECT customer_sk, recency, frequency, money, {_BELOW('recency', 'DESC')} AS r, {_BELOW('frequency', 'ASC')} AS f, {_BELOW('CAST(money AS DOUBLE)', 'ASC')} AS m FROM o",
    "cohorts": LINES + f", b AS (SELECT DISTINCT customer_sk, month FROM s WHERE customer_sk > 0), f AS (SELECT customer_sk, min(month) AS cohort FROM b GROUP BY 1) SELECT cohort, {FIRST_MONTH.format('month')} - ({FIRST_MONTH.format('cohort')}) AS age, count(*) AS customers FROM b JOIN f USING (customer_sk) GROUP BY 1, 2",
    "pareto_parts": LINES + ", r AS (SELECT l_partkey, sum(amount) AS revenue FROM s GROUP BY 1 HAVING sum(amount) > 0), w AS (SELECT *, sum(revenue) OVER (ORDER BY revenue DESC, l_partkey ROWS UNBOUNDED PRECEDING) AS run, sum(revenue) OVER () AS total FROM r), x AS (SELECT *, CAST(run AS DOUBLE) / CAST(total AS DOUBLE) AS share, CAST(run AS DOUBLE) / CAST(total AS DOUBLE) - CAST(revenue AS DOUBLE) / CAST(total AS DOUBLE) AS before FROM w) SELECT l_partkey, revenue, round(share, 6) AS running_share, before < 0.8 AS vital, CASE WHEN before < 0.8 THEN 'A' WHEN before < 0.95 THEN 'B' ELSE 'C' END AS abc_class FROM x",
    "reorder_points": LINES + ", d AS (SELECT l_partkey, CAST(sold_at AS DATE) AS day, sum(quantity) AS units FROM s WHERE NOT is_return GROUP BY 1, 2) SELECT l_partkey, round(avg(units), 6) AS mean_units, round(avg(units) * 7 + 1.65 * coalesce(stddev_samp(units), 0) * sqrt(7), 4) AS reorder_point FROM d GROUP BY 1",
    "location_quotient": LINES + ", o AS (SELECT city, CAST(sum(amount) AS DOUBLE) AS rev, count(DISTINCT CASE WHEN customer_sk > 0 THEN customer_sk END) AS customers, count(DISTINCT store_id) AS stores FROM s GROUP BY 1) SELECT city, customers, stores, round((rev / sum(rev) OVER ()) / (customers / sum(customers) OVER ()), 6) AS quotient, round((rev / sum(rev) OVER ()) / (stores / sum(stores) OVER ()), 6) AS productivity FROM o",
    "pending_ageing": LINES + f", x AS (SELECT amount, (epoch(TIMESTAMP '1997-01-01 00:00:00') - epoch(sold_at)) / 3600 AS h FROM s WHERE payment_ref IS NULL AND payment_method IN {MOMO}) SELECT CASE WHEN h < 24 THEN '0-24' WHEN h <= 72 THEN '24-72' ELSE '>72' END AS age_bucket, count(*) AS line_count, sum(amount) AS value FROM x GROUP BY 1",
    "repeated_references": LINES + "SELECT payment_ref, count(DISTINCT store_id) AS stores, count(*) AS uses FROM s WHERE payment_ref IS NOT NULL GROUP BY 1 HAVING count(DISTINCT store_id) > 1",
    "unusual_amounts": LINES + ", k AS (SELECT store_id, hour(sold_at) AS h, CAST(amount AS DOUBLE) AS x FROM s), b AS (SELECT store_id, h, avg(x) AS m, stddev_samp(x) AS d FROM k GROUP BY 1, 2) SELECT store_id, count(*) AS line_count, round(max(x), 4) AS largest FROM k JOIN b USING (store_id, h) WHERE x > m + 1.5 * d GROUP BY 1",
    "refund_days": LINES + "SELECT store_id, CAST(CAST(sold_at AS DATE) AS VARCHAR) AS day, count(*) AS refunds FROM s WHERE is_return GROUP BY 1, 2 HAVING count(*) > 3",
    "walk_in_high_value": LINES + "SELECT store_id, count(*) AS line_count, sum(amount) AS value FROM s WHERE customer_sk = 0 AND amount >= 50000 GROUP BY 1",
    "month_growth": LINES + ", r AS (SELECT month, sum(amount) AS revenue FROM s GROUP BY 1) SELECT month, revenue, revenue - lag(revenue) OVER (ORDER BY month) AS delta FROM r",
    "growth_decomposition": LINES + ", o AS (SELECT month, CAST(sum(amount) AS DOUBLE) AS rev, CAST(count(DISTINCT customer_sk) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS k FROM s WHERE customer_sk > 0 GROUP BY 1), w AS (SELECT *, lag(rev) OVER z AS pr, lag(n) OVER z AS pn, lag(k) OVER z AS pk FROM o WINDOW z AS (ORDER BY month)) SELECT month, round((n - pn) * (pk / pn) * (pr / pk), 2) AS by_customers, round(n * (k / n - pk / pn) * (pr / pk), 2) AS by_frequency, round(n * (k / n) * (rev / k - pr / pk), 2) AS by_basket FROM w WHERE pn IS NOT NULL",
    "kpi_tree": LINES + f", a AS (SELECT count(*) FILTER (NOT customer_sk > 0) / count(*) AS walk_in_share, count(*) FILTER (payment_ref IS NULL) / count(*) AS pending_share, count(*) FILTER (is_return) / count(*) AS return_share, CAST(sum(CASE WHEN city = 'E-commerce' THEN amount END) AS DOUBLE) / CAST(sum(amount) AS DOUBLE) AS online_share, CAST(sum(CASE WHEN payment_method IN {MOMO} THEN amount END) AS DOUBLE) / CAST(sum(amount) AS DOUBLE) AS momo_share, (SELECT count(*) FILTER (n > 1) / count(*) FROM (SELECT count(DISTINCT o_orderkey) AS n FROM s WHERE customer_sk > 0 GROUP BY customer_sk)) AS repeat_share FROM s) SELECT measure, round(value, 6) AS value FROM (UNPIVOT a ON COLUMNS(*) INTO NAME measure VALUE value)",
    "std_phone": standard(DIRTY_CUSTOMERS, "customer_id", "phone_number", phone("phone_number")),
    "std_district": standard(DIRTY_CUSTOMERS, "customer_id", "district", district("district")),
    "std_date": standard(DIRTY_CUSTOMERS, "customer_id", "registration_date", date("registration_date")),
    "std_gender": standard(DIRTY_CUSTOMERS, "customer_id", "gender", gender("gender")),
    "std_unit": standard(DIRTY_PRODUCTS, "product_id, product_name", "unit_of_measure", unit("unit_of_measure")),
    "std_category": standard(DIRTY_PRODUCTS, "product_id, product_name", "category", category("category")),
    "std_price": standard(DIRTY_PRODUCTS, "product_id, product_name", "selling_price_ugx", price("selling_price_ugx")),
    "mask_all": _cte(d=plain(DIRTY_CUSTOMERS)) + "SELECT customer_id, CASE WHEN trim(full_name) = '' THEN NULL WHEN len(string_split_regex(trim(full_name), '\\s+')) < 2 THEN substr(trim(full_name), 1, 1) || '***' ELSE substr(trim(full_name), 1, 1) || '*** ' || substr(string_split_regex(trim(full_name), '\\s+')[2], 1, 1) || '**' END AS name, CASE WHEN trim(phone_number) = '' THEN NULL WHEN length(regexp_replace(phone_number, '\\D', '', 'g')) >= 9 THEN '+256-XXX-XX' || right(regexp_replace(phone_number, '\\D', '', 'g'), 4) ELSE '+256-XXX-XXXX' END AS phone, CASE WHEN strpos(email, '@') = 0 THEN NULL ELSE substr(trim(email), 1, 1) || '***' || substr(trim(email), strpos(trim(email), '@')) END AS email FROM d",
    "cleanse_customers": _cte(**CUSTOMERS) + "SELECT * FROM c",
    "cleanse_products": _cte(p=plain(DIRTY_PRODUCTS), c=PRODUCTS_CLEAN) + "SELECT * FROM c WHERE NOT bad_key",
    "products_quarantine": _cte(p=plain(DIRTY_PRODUCTS), c=PRODUCTS_CLEAN) + "SELECT sku, product_name FROM c WHERE bad_key",
    "sku_multi_name": _cte(p=plain(DIRTY_PRODUCTS)) + "SELECT sku, count(DISTINCT product_name) AS names FROM p WHERE sku <> '' GROUP BY 1 HAVING count(DISTINCT product_name) > 1",
    "duplicate_rows": _cte(d=plain(DIRTY_CUSTOMERS)) + "SELECT coalesce(sum(n), 0) AS n_rows FROM (SELECT count(*) AS n FROM d GROUP BY phone_number, email, district, gender HAVING count(*) > 1)",
    "dominant_phone_format": _cte(
        d=plain(DIRTY_CUSTOMERS),
        f=f"SELECT CASE WHEN {strip('phone_number')} IN ('', 'nan', 'None') THEN 'missing' WHEN regexp_full_match({strip('phone_number')}, '\\+2567\\d{{8}}') THEN 'e164' WHEN regexp_full_match({strip('phone_number')}, '07\\d{{8}}') THEN 'national' WHEN regexp_full_match({strip('phone_number')}, '2567\\d{{8}}') THEN 'no_plus' WHEN regexp_full_match({strip('phone_number')}, '7\\d{{8}}') THEN 'no_zero' WHEN regexp_full_match({strip('phone_number')}, '[\\d\\s-]+') AND regexp_matches({strip('phone_number')}, '[\\s-]') THEN 'spaced' ELSE 'other' END AS format FROM d",
    )
    + "SELECT format, CAST(round(CAST(n AS DECIMAL(20, 0)) * 100 / total, 2) AS DOUBLE) AS share_pct FROM (SELECT format, count(*) AS n, sum(count(*)) OVER () AS total FROM f GROUP BY 1) WHERE format <> 'missing' ORDER BY n DESC, format DESC LIMIT 1",
    "parse_sales": _cte(**SALES) + "SELECT * FROM parsed WHERE rule IS NULL",
    "quarantine_summary": _cte(**SALES) + "SELECT 'sales' AS entity, rule AS error_rule, count(*) AS n, '2026-10-05 02:00:00' AS first_seen, '2026-10-05 02:00:00' AS last_seen FROM parsed WHERE rule IS NOT NULL GROUP BY 2",
    "fact_sales": _cte(**FACTS) + "SELECT transaction_id, sale_sk, customer_sk, product_sk, quantity, net_amount_ugx FROM f WHERE product_sk IS NOT NULL",
    "product_orphans": _cte(**FACTS) + "SELECT transaction_id, product_id FROM f WHERE product_sk IS NULL",
    "load_checks": _cte(
        **FACTS,
        cd=f"SELECT 0 AS sk UNION ALL SELECT {_sk(strip('customer_id'))} FROM d WHERE {strip('customer_id')} <> ''",
        pd=f"SELECT {strip('product_id')} AS id FROM p WHERE lower({strip('product_id')}) NOT IN ('', 'nan')",
        staged="SELECT sum(CAST(unit_price_ugx * quantity AS DECIMAL(18, 2))) AS t FROM parsed WHERE rule IS NULL AND product_id IN (SELECT id FROM pd)",
        loaded="SELECT * FROM f WHERE product_sk IS NOT NULL",
    )
    + """SELECT 'customer_orphans' AS check, CAST(count(*) AS DECIMAL(24, 2)) AS value, count(*) = 0 AS passed FROM loaded WHERE customer_sk NOT IN (SELECT sk FROM cd)
UNION ALL SELECT 'product_orphans', count(*), count(*) = 0 FROM loaded WHERE product_id NOT IN (SELECT id FROM pd)
UNION ALL SELECT 'control_total', sum(net_amount_ugx), abs(sum(net_amount_ugx) - (SELECT t FROM staged)) <= 0.5 FROM loaded""",
    "idempotent_load": _cte(**FACTS) + "SELECT count(*) AS n, sum(net_amount_ugx + CASE WHEN sale_sk % 3 <> 1 THEN 1 ELSE 0 END) AS total FROM f WHERE product_sk IS NOT NULL",
    "denormalised": _cte(**FACTS, c=CLEAN, pc=PRODUCTS_CLEAN) + "SELECT pc.category AS category_label, c.district AS customer_district, count(*) AS n FROM f JOIN pc ON pc.product_id = f.product_id LEFT JOIN c ON c.customer_id = f.customer_id WHERE f.product_sk IS NOT NULL GROUP BY 1, 2",
    "phone_clusters": _cte(**CUSTOMERS) + "SELECT customer_id AS id, CASE WHEN phone_status = 'valid' THEN min(customer_id) OVER (PARTITION BY phone_status, phone_e164) ELSE customer_id END AS cluster FROM c",
    "survivors": _cte(
        **CUSTOMERS,
        k="SELECT *, CASE WHEN phone_status = 'valid' THEN min(customer_id) OVER (PARTITION BY phone_status, phone_e164) ELSE customer_id END AS cluster FROM c",
        r="SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY (full_name <> '')::INT + (phone_e164 <> '')::INT + (email <> '')::INT + (district <> '')::INT + (registration_date <> '')::INT + (gender <> '')::INT DESC, CASE WHEN registration_date = '' THEN '9999-12-31' ELSE registration_date END, customer_id) AS n FROM k",
    )
    + "SELECT cluster, max(CASE WHEN n = 1 THEN customer_id END) AS customer_id, coalesce(string_agg(CASE WHEN n > 1 THEN customer_id END, ';' ORDER BY customer_id), '') AS merged_customer_ids FROM r GROUP BY 1",
    "name_pairs_edit_distance": "SELECT a.s_suppkey AS a, b.s_suppkey AS b, levenshtein(a.s_name, b.s_name) AS distance FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE levenshtein(a.s_name, b.s_name) <= 2",
    "scd2_apply": "SELECT c_custkey, CASE WHEN v = 0 THEN c_mktsegment ELSE upper(c_mktsegment) || '!' END AS segment, CASE WHEN v = 0 THEN '2024-01-01' ELSE '2024-06-01' END AS valid_from, CASE WHEN v = 0 AND c_custkey % 5 = 0 THEN '2024-06-01' ELSE '9999-12-31' END AS valid_to, NOT (v = 0 AND c_custkey % 5 = 0) AS is_current FROM customer, (VALUES (0), (1)) t(v) WHERE v = 0 OR c_custkey % 5 = 0",
    "scd2_asof": "SELECT CASE WHEN o_custkey % 5 = 0 AND o_orderkey % 2 = 1 THEN upper(c_mktsegment) || '!' ELSE c_mktsegment END AS segment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "dim_date": "SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_sk, CAST(d AS VARCHAR) AS calendar_date, strftime(d, '%A') AS day_of_week, day(d) AS day_of_month, week(d) AS week_of_year, month(d) AS month, strftime(d, '%B') AS month_name, quarter(d) AS quarter, year(d) AS year, isodow(d) >= 6 AS is_weekend, strftime(d, '%m-%d') = '01-01' AS is_public_holiday FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2025-12-31', INTERVAL 1 DAY)) AS DATE) AS d)",
    "role_store_rows": LINES + "SELECT store_id, count(*) AS n FROM s WHERE store_id = 'ST07' GROUP BY 1",
    "role_matrix": "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{r}', '{t}', '{o}')"
        for r, own in {
            "store_cashier": {"sales": "I", "sales_masked": "S", "products": "S", "customers_masked": "S"},
            "store_manager": {"sales": "IU", "sales_masked": "S", "products": "S", "customers_masked": "S", "financial_reports": "S"},
            "data_analyst": {"sales_masked": "S", "products": "S", "customers_masked": "S", "financial_reports": "S"},
            "compliance_officer": {"sales": "S", "sales_masked": "S", "customers": "S", "products": "S", "financial_reports": "S", "customers_masked": "S"},
            "cdm_admin": {"sales": "SIUD", "sales_masked": "SIUD", "customers": "SIUD", "products": "SIUD", "financial_reports": "SIUD", "customers_masked": "SIUD"},
        }.items()
        for t, o in own.items()
    )
    + ") t(role, object_name, operations)",
    "footfall_windows": """SELECT store_id, CAST(time_bucket(INTERVAL 15 MINUTE, ts) AS VARCHAR) AS window_start, count(*) AS events,
  CAST(sum(CASE WHEN n % 3 <> 0 AND event_type = 'click' THEN n % 4 ELSE 0 END) AS BIGINT) AS entered, CAST(sum(CASE WHEN n % 3 <> 0 AND event_type <> 'click' THEN n % 4 ELSE 0 END) AS BIGINT) AS "left",
  CAST(sum(n % 4) AS BIGINT) AS moves, CAST(sum(n % 90) AS BIGINT) AS dwell_seconds
FROM (SELECT 'U' || CAST(user_id % 24 AS VARCHAR) AS store_id, ts, event_type, event_id AS n FROM events) GROUP BY 1, 2""",
    "event_gaps": "SELECT user_id, after_seq, event_id AS next_seq, event_id - after_seq - 1 AS missing FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS after_seq FROM events) WHERE event_id > after_seq + 1",
    "distinct_events": "SELECT user_id, CAST(floor(value) AS INT) AS v, min(event_id) AS event_id FROM events GROUP BY 1, 2",
    "sliding_24h": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM events",
    "trade_area": LINES + f", d AS ({plain(DIRTY_CUSTOMERS)}), h AS (SELECT CAST(substr(customer_id, 5) AS BIGINT) - 100000 AS customer_sk, {district('district')[0]} AS district FROM d) SELECT district, city, sum(amount) AS revenue, count(DISTINCT customer_sk) AS customers FROM s JOIN h USING (customer_sk) WHERE customer_sk > 0 GROUP BY 1, 2",
    "repeated_reference_windows": """SELECT payment_ref, CAST(start AS VARCHAR) AS window_start, count(DISTINCT store_id) AS stores
FROM (SELECT 'R' || CAST(user_id % 300 AS VARCHAR) AS payment_ref, 'U' || CAST(event_id % 24 AS VARCHAR) AS store_id, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(unnest(range(24))) AS start FROM events)
GROUP BY 1, 2 HAVING count(DISTINCT store_id) > 1""",
    "on_hand": "SELECT p_partkey, greatest(100 - coalesce(q, 0) + p_size, 0) AS on_hand FROM part LEFT JOIN (SELECT l_partkey, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey",
}


def _values(base: str, measures: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{d}' AS dimension, '{m}' AS metric, CAST({v} AS DOUBLE) AS value FROM {base}" for d, m, v in measures)


def _measures(base: str, measures: list[tuple[str, str, str]]) -> str:
    return _cte(x=base) + _values("x", measures)


def _pct(condition: str) -> str:
    return f"coalesce(round(CAST(count(*) FILTER ({condition}) AS DECIMAL(20, 0)) * 100 / nullif(count(*), 0), 2), 0)"


_FORMAT = f"""CASE WHEN {strip("phone_number")} IN ('', 'nan', 'None') THEN NULL WHEN regexp_full_match({strip("phone_number")}, '\\+2567\\d{{8}}') THEN 'e164' WHEN regexp_full_match({strip("phone_number")}, '07\\d{{8}}') THEN 'national'
  WHEN regexp_full_match({strip("phone_number")}, '2567\\d{{8}}') THEN 'no_plus' WHEN regexp_full_match({strip("phone_number")}, '7\\d{{8}}') THEN 'no_zero' WHEN regexp_full_match({strip("phone_number")}, '[\\d\\s-]+') AND regexp_matches({strip("phone_number")}, '[\\s-]') THEN 'spaced' ELSE 'other' END"""
_FIELDS = ["full_name", "phone_number", "email", "district", "registration_date", "gender"]


def _profiled(base: str) -> str:
    return f"SELECT *, {_FORMAT} AS fmt, {date('registration_date')[0]} AS dv, {date('registration_date')[1]} AS ds, TRY_CAST(CASE WHEN {date('registration_date')[1]} NOT IN ('missing', 'unparseable') THEN {date('registration_date')[0]} END AS DATE) AS dd, {phone('phone_number')[1]} AS ps, {district('district')[1]} AS xs, count(*) OVER (PARTITION BY {', '.join(_FIELDS)}) AS copies, CASE WHEN {_FORMAT} IS NOT NULL THEN count(*) OVER (PARTITION BY {_FORMAT}) END AS of_format FROM ({base})"


_E164, _MAIL = f"regexp_full_match({strip('phone_number')}, '\\+2567\\d{{8}}')", f"({strip('email')} = '' OR regexp_full_match({strip('email')}, '{MAIL}'))"
_SEX = f"{strip('gender')} IN ('M', 'F', 'Male', 'Female')"
_CUSTOMER_MEASURES = [
    ("Uniqueness", "unique_customer_id_pct", "round(CAST(count(DISTINCT customer_id) AS DECIMAL(20, 0)) * 100 / nullif(count(*), 0), 2)"),
    *[("Completeness", f"present_{c}_pct", _pct(f"{strip(c)} <> ''")) for c in _FIELDS],
    ("Completeness", "cells_pct", "round(CAST(" + " + ".join(f"count(*) FILTER ({strip(c)} <> '')" for c in _FIELDS) + " AS DECIMAL(20, 0)) * 100 / nullif(count(*) * 6, 0), 2)"),
    ("Consistency", "phone_formats", "count(DISTINCT fmt)"),
    ("Consistency", "date_formats", "count(DISTINCT nullif(ds, 'missing'))"),
    ("Consistency", "iso_dates_pct", _pct("ds = '%Y-%m-%d'")),
    ("Consistency", "district_labels", f"count(DISTINCT nullif({strip('district')}, ''))"),
    ("Consistency", "gender_labels", f"count(DISTINCT nullif({strip('gender')}, ''))"),
    ("Timeliness", "date_parseable_pct", _pct("dd IS NOT NULL")),
    ("Timeliness", "not_in_future_pct", _pct("dd <= DATE '2026-10-05'")),
    ("Timeliness", "last_four_years_pct", _pct("dd >= DATE '2026-10-05' - 1461 AND dd <= DATE '2026-10-05'")),
    ("Accuracy", "district_official_pct", _pct("xs IN ('exact', 'exact_remapped')")),
    ("Accuracy", "phone_plausible_pct", _pct("ps = 'valid'")),
    ("Accuracy", "gender_canonical_pct", _pct(f"{strip('gender')} IN ('M', 'F', '')")),
    ("Validity", "phone_e164_pct", _pct(_E164)),
    ("Validity", "email_pct", _pct(_MAIL)),
    ("Validity", "date_pct", _pct("dv <> ''")),
    ("Validity", "date_strict_pct", _pct("dd IS NOT NULL")),
    ("Validity", "gender_pct", _pct(_SEX)),
    ("Validity", "composite_pct", _pct(f"{_E164} AND {_MAIL} AND dv <> '' AND {_SEX}")),
    ("Uniqueness", "exact_duplicates_pct", "coalesce(round(CAST(count(*) FILTER (copies > 1) AS DECIMAL(20, 0)) * 100 / nullif(count(*), 0), 2), 0)"),
    ("Consistency", "dominant_phone_format_pct", "coalesce(round(CAST(max(of_format) AS DECIMAL(20, 0)) * 100 / nullif(count(*), 0), 2), 0)"),
]
ORACLES["profile_customers"] = _measures(_profiled(plain(DIRTY_CUSTOMERS)), _CUSTOMER_MEASURES)
ORACLES["compare_profiles"] = (
    _cte(
        **CUSTOMERS,
        x=_profiled("SELECT * FROM d"),
        y=_profiled("SELECT customer_id, full_name, phone_e164 AS phone_number, email, district, registration_date, gender FROM c"),
        b=_values("x", _CUSTOMER_MEASURES),
        a=_values("y", _CUSTOMER_MEASURES),
        m="SELECT dimension, metric, b.value AS before, a.value AS after, round(a.value - b.value, 2) AS delta FROM b JOIN a USING (dimension, metric)",
        g="SELECT *, CASE WHEN regexp_matches(metric, 'labels|formats|below_cost|currency|duplicate') THEN delta < 0 ELSE delta > 0 END AS better FROM m",
    )
    + """SELECT dimension, metric, before, after, delta, CASE WHEN metric LIKE '%below_cost%' THEN 'Flagged (manual)' WHEN metric LIKE '%four_years%' THEN 'Monitored'
  WHEN metric LIKE '%sku%' AND delta = 0 THEN 'Flagged (stewardship)' WHEN delta = 0 THEN 'No change' WHEN NOT better AND abs(delta) < 0.5 AND metric LIKE '%_pct' THEN 'Stable' WHEN better THEN 'Improved' ELSE 'Regressed' END AS status FROM g"""
)
_UNIT_OK, _CATEGORY_OK = f"{strip('unit_of_measure')} IN ('kg', 'pcs', 'liters')", f"{strip('category')} IN {OFFICIAL_CATEGORIES}"
_SKU_OK = f"regexp_full_match({strip('sku')}, '[A-Z0-9]{{3,10}}')"
ORACLES["profile_products"] = _measures(
    f"SELECT *, {price('cost_ugx')[0]} AS cost, {price('selling_price_ugx')[0]} AS sell, count(*) OVER (PARTITION BY {strip('sku')}) AS of_sku, count(*) OVER (PARTITION BY sku, product_name, category, unit_of_measure, cost_ugx, selling_price_ugx) AS copies, min(product_name) OVER (PARTITION BY {strip('sku')}) AS least, max(product_name) OVER (PARTITION BY {strip('sku')}) AS most FROM ({plain(DIRTY_PRODUCTS)})",
    [
        ("Uniqueness", "product_id_present_pct", _pct(f"{strip('product_id')} NOT IN ('', 'nan')")),
        *[("Completeness", f"present_{c}_pct", _pct(f"{strip(c)} <> ''")) for c in ("sku", "product_name", "category", "unit_of_measure", "cost_ugx", "selling_price_ugx")],
        ("Consistency", "unit_labels", f"count(DISTINCT {strip('unit_of_measure')})"),
        ("Consistency", "category_labels", f"count(DISTINCT {strip('category')})"),
        ("Consistency", "currency_strings_pct", _pct("regexp_matches(selling_price_ugx, '(?i)ugx|,')")),
        ("Timeliness", "refreshable_pct", _pct(f"product_id IS NOT NULL AND {strip('sku')} <> ''")),
        ("Accuracy", "below_cost_pct", _pct("sell < cost")),
        ("Accuracy", "prices_numeric_pct", _pct("sell IS NOT NULL AND cost IS NOT NULL")),
        ("Accuracy", "prices_not_negative_pct", _pct("sell >= 0 AND cost >= 0")),
        ("Validity", "unit_pct", _pct(_UNIT_OK)),
        ("Validity", "category_pct", _pct(_CATEGORY_OK)),
        ("Validity", "sku_pct", _pct(_SKU_OK)),
        ("Validity", "composite_pct", _pct(f"{_UNIT_OK} AND {_CATEGORY_OK} AND {_SKU_OK} AND sell IS NOT NULL")),
        ("Completeness", "cells_pct", "round(CAST(" + " + ".join(f"count(*) FILTER ({strip(c)} <> '')" for c in ("sku", "product_name", "category", "unit_of_measure", "cost_ugx", "selling_price_ugx")) + " AS DECIMAL(20, 0)) * 100 / nullif(count(*) * 6, 0), 2)"),
        ("Uniqueness", "duplicate_sku_rows", f"count(*) FILTER (of_sku > 1 AND {strip('sku')} NOT IN ('', 'nan'))"),
        ("Consistency", "sku_multi_name", f"count(DISTINCT CASE WHEN least <> most AND {strip('sku')} <> '' THEN {strip('sku')} END)"),
        ("Uniqueness", "exact_duplicates_pct", _pct("copies > 1")),
    ],
)

_CHECKED = CUSTOMERS | SALES | {
    "p": plain(DIRTY_PRODUCTS),
    "pc": PRODUCTS_CLEAN,
    "k": "SELECT *, CASE WHEN phone_status = 'valid' THEN min(customer_id) OVER (PARTITION BY phone_status, phone_e164) ELSE customer_id END AS cluster FROM c",
    "r": "SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY (full_name <> '')::INT + (phone_e164 <> '')::INT + (email <> '')::INT + (district <> '')::INT + (registration_date <> '')::INT + (gender <> '')::INT DESC, CASE WHEN registration_date = '' THEN '9999-12-31' ELSE registration_date END, customer_id) AS n FROM k",
    "golden": "SELECT * FROM r WHERE n = 1",
}
_LATE_DAY = "NOT coalesce(TRY_CAST(registration_date AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2026-10-05', false)"
# Rule, severity, number of rows that fail.
_RULES = [
    ("VR-001", "high", "SELECT count(*) FROM c WHERE phone_status NOT IN ('valid', 'missing')"),
    ("VR-002", "medium", "SELECT count(*) FROM c WHERE district_status = 'unresolved'"),
    ("VR-003", "medium", f"SELECT count(*) FROM c WHERE NOT (email = '' OR regexp_full_match(email, '{MAIL}'))"),
    ("VR-004", "critical", "SELECT count(*) FROM (SELECT customer_id, count(*) OVER (PARTITION BY customer_id) AS n FROM c) WHERE n > 1 OR customer_id = ''"),
    ("VR-005", "high", f"SELECT count(*) FROM c WHERE {_LATE_DAY}"),
    ("VR-006", "medium", "SELECT count(*) FROM c WHERE NOT (length(trim(full_name)) >= 2 AND regexp_full_match(full_name, '[A-Za-z .-]+'))"),
    ("VR-007", "critical", "SELECT count(*) FROM (SELECT count(*) OVER (PARTITION BY phone_e164) AS times FROM golden WHERE phone_status = 'valid') WHERE times > 1"),
    ("VR-008", "critical", "SELECT count(*) FROM pc WHERE lower(sku) IN ('', 'nan') OR duplicate_sku"),
    ("VR-009", "high", "SELECT count(*) FROM pc WHERE unit_of_measure NOT IN ('kg', 'pcs', 'liters')"),
    ("VR-010", "high", f"SELECT count(*) FROM pc WHERE category NOT IN {OFFICIAL_CATEGORIES}"),
    ("VR-011", "medium", "SELECT count(*) FROM pc WHERE margin_anomaly"),
    ("VR-012", "high", f"SELECT count(*) FROM parsed WHERE rule IS NULL AND payment_method IN {MOMO} AND payment_ref IN ('', 'nan', 'None', 'PENDING_RECON') AND reconciliation_status <> 'PENDING'"),
]
ORACLES["rule_violations"] = _cte(**_CHECKED) + " UNION ALL ".join(f"SELECT '{r}' AS rule, '{w}' AS severity, ({q}) AS violations" for r, w, q in _RULES)

_SHARE = "coalesce(round(CAST(count(*) FILTER ({0}) AS DECIMAL(20, 0)) * 100 / nullif(count(*) FILTER ({1}), 0), 4), 100)"
# Check, value, what raises an alert, what raises an incident.
_MONITORED = [
    ("DQC-01", "SELECT round(CAST((SELECT count(*) FROM c) - (SELECT count(*) FROM golden) AS DECIMAL(20, 0)) * 100 / (SELECT count(*) FROM c), 4)", "> 1", "> 2"),
    ("DQC-02", "SELECT " + _SHARE.format("regexp_full_match(phone_e164, '\\+2567\\d{8}')", "phone_status <> 'missing'") + " FROM c", "< 99", ""),
    ("DQC-03", "SELECT " + _SHARE.format("district_status NOT IN ('missing', 'unresolved')", "district_status <> 'missing'") + " FROM c", "< 99.5", ""),
    ("DQC-03-label", "SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM c WHERE district_status = 'unresolved' GROUP BY district)", "> 50", ""),
    ("DQC-04-phone", "SELECT " + _SHARE.format("phone_status <> 'missing'", "true") + " FROM c", "< 92", ""),
    ("DQC-04-email", "SELECT " + _SHARE.format("email <> ''", "true") + " FROM c", "< 85", ""),
    ("DQC-04-district", "SELECT " + _SHARE.format("district_status <> 'missing'", "true") + " FROM c", "< 99", ""),
    ("DQC-05", "SELECT " + _SHARE.format(f"unit_of_measure IN ('kg', 'pcs', 'liters') AND category IN {OFFICIAL_CATEGORIES}", "true") + " FROM pc", "< 99", ""),
    ("DQC-06", "SELECT count(*) FROM (SELECT sku FROM pc WHERE sku NOT IN ('', 'nan') AND product_id <> '' GROUP BY sku HAVING count(DISTINCT product_id) > 1)", "> 0", ""),
    ("DQC-07", "SELECT round(CAST(count(*) FILTER (rule IS NOT NULL) AS DECIMAL(20, 0)) * 100 / count(*), 4) FROM parsed", "> 0.5", ""),
    ("DQC-07-rows", "SELECT count(*) FILTER (rule IS NOT NULL) FROM parsed", "> 100", ""),
    ("DQC-08", "SELECT count(*) FROM parsed WHERE rule IS NULL AND reconciliation_status = 'PENDING' AND sold_at < TIMESTAMP '2026-10-04 00:00:00'", "> 0", "> 50"),
    ("DQC-09", f"SELECT count(*) FROM c WHERE {_LATE_DAY}", "> 0", ""),
    ("DQC-10", "SELECT count(*) FROM pc WHERE margin_anomaly", "> 0", "> 25"),
]
ORACLES["monitoring"] = _cte(**_CHECKED) + " UNION ALL ".join(
    f"SELECT '{k}' AS check_id, value, CASE {f"WHEN value {incident} THEN 'P1'" if incident else ''} WHEN value {alert} THEN 'ALERT' ELSE 'OK' END AS status FROM (SELECT CAST(({q}) AS DOUBLE) AS value)" for k, q, alert, incident in _MONITORED
)

# Codes and regions by place in the list of districts.
_DISTRICT_ROWS = "(VALUES ('D001', 'Kampala', 'Central'), ('D002', 'Wakiso', 'Central'), ('D004', 'Jinja', 'Eastern'), ('D005', 'Gulu', 'Northern'), ('D006', 'Mbarara', 'Western'), ('D015', 'Fort Portal', 'Western'), ('D021', 'Kumi', 'Eastern')) t(district_code, district_name, region)"
ORACLES["dim_district"] = f"SELECT * FROM {_DISTRICT_ROWS}"
ORACLES["migration_checks"] = (
    _cte(**FACTS, c=CLEAN, known="SELECT district, district_status, district IN ('Kampala', 'Wakiso', 'Jinja', 'Gulu', 'Mbarara', 'Fort Portal', 'Kumi') AS placed FROM c WHERE customer_id <> ''")
    + """SELECT 'V1' AS check, CAST(count(*) FILTER (district_status = 'unresolved') AS DOUBLE) AS value, count(*) FILTER (district_status = 'unresolved') = 0 AS passed FROM known
UNION ALL SELECT 'V2', CAST(round(CAST(count(*) FILTER (district_status = 'unresolved') AS DECIMAL(20, 0)) * 100 / count(*), 4) AS DOUBLE), count(*) FILTER (district_status = 'unresolved') * 100.0 / count(*) <= 0.5 FROM known WHERE district <> ''
UNION ALL SELECT 'V3', count(*) FILTER (NOT placed) + 1, false FROM known
UNION ALL SELECT 'V4', 1, true
UNION ALL SELECT 'V5', 0, true
UNION ALL SELECT 'V6', count(*) FILTER (district_status = 'unresolved'), count(*) FILTER (district_status = 'unresolved') = 0 FROM known"""
)
ORACLES["customers_without_segment"] = "SELECT o_orderpriority, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING' WHERE c_custkey IS NULL GROUP BY 1"
ORACLES["golden_remap"] = (
    _cte(**_CHECKED, g="SELECT r.customer_id AS merged_id, golden.customer_id AS survivor FROM r JOIN golden USING (cluster) WHERE r.n > 1")
    + "SELECT coalesce(survivor, customer_id) AS customer_id, count(*) AS n, sum(net_amount_ugx) AS total FROM parsed LEFT JOIN g ON customer_id = merged_id WHERE rule IS NULL GROUP BY 1"
)
_MENDED = {
    "raw": "SELECT * REPLACE (replace(unit_price, 'UGX cheap', '1500') AS unit_price) FROM (" + plain(DIRTY_SALES) + ")",
    "parts": _PARTS,
    "parsed": _PARSED,
    "raw0": plain(DIRTY_SALES),
    "parts0": _PARTS.replace("FROM raw", "FROM raw0"),
    "parsed0": _PARSED.replace("FROM parts", "FROM parts0"),
    "mended": "SELECT b.*, a.rule AS error_rule FROM parsed0 a JOIN parsed b USING (transaction_id) WHERE a.rule IS NOT NULL",
}
ORACLES["replay_settled"] = _cte(**_MENDED) + "SELECT error_rule, rule IS NULL AS replayed, count(*) AS n FROM mended GROUP BY 1, 2"
ORACLES["replay_loaded"] = _cte(**_MENDED) + "SELECT transaction_id, unit_price_ugx, net_amount_ugx, payment_ref FROM mended WHERE rule IS NULL"
ORACLES["upsert_customers"] = "SELECT CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE lower(c_mktsegment) END AS segment, count(*) AS n FROM customer GROUP BY 1"
ORACLES["role_reads"] = LINES + "SELECT role, object_name, count(*) AS n, CASE WHEN object_name = 'sales_masked' THEN count(payment_ref) ELSE 0 END AS masked, CASE WHEN object_name = 'sales' THEN count(payment_ref) ELSE 0 END AS plain FROM s, (VALUES ('store_cashier', 'sales_masked', 'ST07'), ('store_manager', 'sales_masked', 'ST07'), ('data_analyst', 'sales_masked', ''), ('compliance_officer', 'sales', ''), ('cdm_admin', 'sales', '')) t(role, object_name, own) WHERE own IN ('', store_id) GROUP BY 1, 2"
ORACLES["version_churn"] = "SELECT count(*) + count(*) FILTER (c_custkey % 5 = 0) AS versions, count(*) AS keys, round((count(*) + count(*) FILTER (c_custkey % 5 = 0)) / count(*), 6) AS per_key, (count(*) + count(*) FILTER (c_custkey % 5 = 0)) / count(*) > 1.05 AS alert FROM customer"
ORACLES["as_of_segments"] = "SELECT CASE WHEN c_custkey % 5 = 0 THEN upper(c_mktsegment) || '!' ELSE c_mktsegment END AS segment, count(*) AS n FROM customer GROUP BY 1"
ORACLES["households"] = _cte(**CUSTOMERS) + "SELECT district, regexp_extract(trim(regexp_replace(lower(full_name), '[^a-z0-9]+', ' ', 'g')), '[^ ]+$') AS surname, phone_e164, count(*) AS members FROM c WHERE phone_status = 'valid' AND full_name <> '' GROUP BY 1, 2, 3 HAVING count(*) > 1"
ORACLES["search_payments"] = _cte(raw=plain(DIRTY_SALES)) + "SELECT transaction_id, payment_method FROM raw WHERE regexp_matches(payment_method, '(?i)momo|airtel') ORDER BY transaction_id LIMIT 6"

_M = FIRST_MONTH.format("month")
ORACLES["cohort_segments"] = LINES + f""", b AS (SELECT * FROM s WHERE customer_sk > 0 AND NOT is_return),
f AS (SELECT customer_sk, city, CASE WHEN store_id = 'ECOM01' THEN 'online' ELSE 'store' END AS channel, month AS cohort FROM b QUALIFY row_number() OVER (PARTITION BY customer_sk ORDER BY sold_at, o_orderkey, store_id) = 1),
m AS (SELECT DISTINCT customer_sk, month FROM b)
SELECT cohort, city, channel, {_M} - ({FIRST_MONTH.format("cohort")}) AS age, count(*) AS customers FROM m JOIN f USING (customer_sk) GROUP BY ALL"""
ORACLES["growth_drivers"] = LINES + f""", b AS (SELECT customer_sk, {_M} AS m, sum(amount) AS rev, count(*) AS k, sum(quantity) AS u FROM s WHERE customer_sk > 0 AND NOT is_return GROUP BY 1, 2),
months AS (SELECT DISTINCT m FROM b WHERE m > (SELECT min(m) FROM b)),
new AS (SELECT m, sum(rev) AS v FROM b WHERE NOT EXISTS (SELECT 1 FROM b e WHERE e.customer_sk = b.customer_sk AND e.m < b.m) GROUP BY 1),
back AS (SELECT m, sum(rev) AS v FROM b WHERE EXISTS (SELECT 1 FROM b e WHERE e.customer_sk = b.customer_sk AND e.m < b.m - 1) AND NOT EXISTS (SELECT 1 FROM b e WHERE e.customer_sk = b.customer_sk AND e.m = b.m - 1) GROUP BY 1),
lost AS (SELECT m + 1 AS m, -sum(rev) AS v FROM b WHERE NOT EXISTS (SELECT 1 FROM b e WHERE e.customer_sk = b.customer_sk AND e.m = b.m + 1) GROUP BY 1),
st AS (SELECT b.m, CAST(sum(b.rev) AS DOUBLE) AS r1, CAST(sum(b.k) AS DOUBLE) AS k1, CAST(sum(b.u) AS DOUBLE) AS u1, CAST(sum(e.rev) AS DOUBLE) AS r0, CAST(sum(e.k) AS DOUBLE) AS k0, CAST(sum(e.u) AS DOUBLE) AS u0 FROM b JOIN b e ON e.customer_sk = b.customer_sk AND e.m = b.m - 1 GROUP BY 1)
SELECT printf('%04d-%02d', (months.m - 1) // 12, (months.m - 1) % 12 + 1) AS month, coalesce(new.v, 0) AS by_new, coalesce(back.v, 0) AS by_back, coalesce(lost.v, 0) AS by_lost,
  round(coalesce((k1 - k0) * (r0 / k0), 0), 2) AS by_frequency, round(coalesce((u1 - k1 * (u0 / k0)) * (r0 / u0), 0), 2) AS by_basket, round(coalesce(r1 - u1 * (r0 / u0), 0), 2) AS by_price_mix
FROM months LEFT JOIN new USING (m) LEFT JOIN back USING (m) LEFT JOIN lost USING (m) LEFT JOIN st USING (m)"""
ORACLES["pending_register"] = LINES + f"SELECT CAST(CAST(sold_at AS DATE) AS VARCHAR) AS day, store_id, count(*) AS line_count, sum(amount) AS value, count(*) FILTER (sold_at < TIMESTAMP '1998-08-01' - INTERVAL 48 HOUR) AS escalated FROM s WHERE payment_ref IS NULL AND payment_method IN {MOMO} AND sold_at <= TIMESTAMP '1998-08-01' GROUP BY 1, 2"
ORACLES["rounding_clusters"] = LINES + "SELECT store_id, payment_method, count(*) FILTER (amount % 5 = 0) AS round_lines, count(*) AS line_count, round(count(*) FILTER (amount % 5 = 0) / count(*), 6) AS share FROM s GROUP BY 1, 2 HAVING round(count(*) FILTER (amount % 5 = 0) / count(*), 6) >= 0.001"
ORACLES["kpi_targets"] = LINES + f""", b AS (SELECT DISTINCT customer_sk, month FROM s WHERE customer_sk > 0 AND NOT is_return), o AS (SELECT * FROM s WHERE month = '1997-03'),
v AS (SELECT 'new_customers' AS measure, CAST(count(*) AS DOUBLE) AS value FROM (SELECT customer_sk FROM b GROUP BY 1 HAVING min(month) = '1997-03')
UNION ALL SELECT 'churn', round(1 - count(*) FILTER (customer_sk IN (SELECT customer_sk FROM b WHERE month = '1997-04')) / count(*), 6) FROM b WHERE month = '1997-03'
UNION ALL SELECT 'pending_share', round(count(*) FILTER (payment_ref IS NULL) / count(*), 6) FROM o WHERE payment_method IN {MOMO}
UNION ALL SELECT 'walk_in_revenue_share', round(CAST(sum(CASE WHEN customer_sk = 0 THEN amount END) AS DOUBLE) / CAST(sum(amount) AS DOUBLE), 6) FROM o)
SELECT measure, value, CAST(CASE measure WHEN 'new_customers' THEN 600 WHEN 'churn' THEN 0.5 WHEN 'pending_share' THEN 0.005 ELSE 0.03 END AS DOUBLE) AS target,
  CASE measure WHEN 'new_customers' THEN value >= 600 WHEN 'churn' THEN value <= 0.5 WHEN 'pending_share' THEN value < 0.005 ELSE value < 0.03 END AS met FROM v"""
ORACLES["delivery_zones"] = LINES + f""", d AS ({plain(DIRTY_CUSTOMERS)}), c AS ({CLEAN}), h AS (SELECT CAST(substr(customer_id, 5) AS BIGINT) - 100000 AS customer_sk, CASE district WHEN 'Kampala' THEN 'Central' WHEN 'Wakiso' THEN 'Central' WHEN 'Jinja' THEN 'Eastern' WHEN 'Kumi' THEN 'Eastern' WHEN 'Mbarara' THEN 'Western' WHEN 'Fort Portal' THEN 'Western' WHEN 'Gulu' THEN 'Northern' END AS region FROM c)
SELECT coalesce(region, 'unassigned') AS zone, sum(amount) AS revenue, count(DISTINCT customer_sk) AS customers FROM s LEFT JOIN h USING (customer_sk) WHERE customer_sk > 0 GROUP BY 1"""
ORACLES["stock_variance"] = """WITH p AS (SELECT p_partkey, CAST(p_size AS BIGINT) + 100 AS b, CAST(p_size AS BIGINT) + 100 - p_partkey % 7 AS n, CAST(p_retailprice AS DECIMAL(12, 2)) AS c FROM part WHERE p_partkey % 6 <> 0),
w AS (SELECT 'returns' AS step, sum(CAST(l_quantity AS INT)) AS units, sum(CAST(l_quantity AS INT) * c) AS value FROM lineitem JOIN p ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND l_orderkey % 50 = 0 HAVING count(*) > 0
UNION ALL SELECT 'unit of measure', sum(-3), sum(-3 * c) FROM p WHERE p_partkey % 11 = 0 HAVING count(*) > 0)
SELECT 'book' AS step, CAST(sum(b) AS BIGINT) AS units, CAST(sum(b * c) AS DECIMAL(24, 4)) AS value FROM p UNION ALL SELECT 'physical', CAST(sum(n) AS BIGINT), CAST(sum(n * c) AS DECIMAL(24, 4)) FROM p
UNION ALL SELECT step, CAST(units AS BIGINT), CAST(value AS DECIMAL(24, 4)) FROM w
UNION ALL SELECT 'unexplained', CAST((SELECT sum(n) - sum(b) FROM p) - (SELECT sum(units) FROM w) AS BIGINT), CAST((SELECT sum(n * c) - sum(b * c) FROM p) - (SELECT sum(value) FROM w) AS DECIMAL(24, 4))"""
ORACLES["demand_potential"] = """WITH n AS (SELECT c_nationkey, CASE WHEN c_nationkey > 0 THEN count(*) * greatest(avg(c_acctbal), 0) / (c_nationkey * 5.0) ELSE 0 END AS v FROM customer GROUP BY 1)
SELECT c_nationkey, round(CAST(v AS DOUBLE), 4) AS potential, round(v / (SELECT sum(v) FROM n), 6) AS share FROM n"""
ORACLES["household_scores"] = _cte(**CUSTOMERS) + """, a AS (SELECT DISTINCT 'CUST' || CAST(o_custkey + 100000 AS VARCHAR) AS customer_id FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-01') BETWEEN 0 AND 90),
h AS (SELECT district, regexp_extract(trim(regexp_replace(lower(full_name), '[^a-z0-9]+', ' ', 'g')), '[^ ]+$') AS surname, phone_e164, count(*) AS members, count(a.customer_id) AS active FROM c LEFT JOIN a USING (customer_id) WHERE phone_status = 'valid' AND full_name <> '' GROUP BY 1, 2, 3)
SELECT *, round(CAST(0.5 AS DOUBLE) + least((members - 2) * CAST(0.1 AS DOUBLE), CAST(0.3 AS DOUBLE)) + CAST(0.2 AS DOUBLE) * active / members, 4) AS score FROM h WHERE members > 1 AND active > 0"""
ORACLES["event_contract"] = """WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 17 = 0 THEN event_id - 500 ELSE event_id END AS q FROM events),
t AS (SELECT *, max(q) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e)
SELECT CASE WHEN event_id % 13 = 0 THEN 'NULL_COUNT' WHEN event_id % 19 = 0 OR event_id % 23 = 0 THEN 'QUALITY' WHEN q < top THEN 'NOT_MONOTONIC' END AS reason, count(*) AS n FROM t GROUP BY 1"""


def _drawn(salt: str, below: int, row: str = "id") -> str:
    return f"CAST(('0x' || substr(md5('20261005-{salt}-' || CAST({row} AS VARCHAR)), 1, 8)) AS BIGINT) % {below}"


_TRUTH = {
    "customers": ("(SELECT range AS id, CASE WHEN range >= 3850 THEN " + _drawn("copied", 3850, "range") + " ELSE range END AS src FROM range(5000))", {"duplicate_rows": "id >= 3850", "exact_copies": f"id >= 3850 AND {_drawn('copy', 100)} < 30", "fuzzy_name_variants": f"id >= 3850 AND {_drawn('copy', 100)} BETWEEN 30 AND 69", "phone_variants": f"id >= 3850 AND {_drawn('copy', 100)} >= 70", "null_phone": _drawn("no phone", 100, "src") + " < 10", "null_email": _drawn("no email", 100, "src") + " < 6", "null_gender": _drawn("no gender", 100, "src") + " < 15"}),
    "products": ("(SELECT range AS id FROM range(1200))", {"null_key_rows": _drawn("no key", 100) + " < 3", "duplicate_sku_rows": f"id >= 10 AND {_drawn('sku', 100)} < 6", "currency_string_price": _drawn("currency", 100) + " < 4", "price_below_cost": _drawn("margin", 100) + " < 5"}),
    "sales": ("(SELECT range AS id FROM range(10000))", {"negative_qty_rows": _drawn("return", 100) + " < 5", "null_payment_ref_rows": _drawn("no ref", 1000) + " < 113", "currency_string_unit_price": _drawn("sale currency", 1000) + " < 67", "blank_customer_rows": _drawn("walk-in", 100) + " < 8", "slash_timestamps": _drawn("style", 100) + " < 15"}),
}
ORACLES["injection_truth"] = " UNION ALL ".join(f"SELECT '{e}' AS entity, '{k}' AS defect, count(*) AS n FROM {rows} WHERE {test}" for e, (rows, tests) in _TRUTH.items() for k, test in ({"rows": "true"} | tests).items())
_RULE = "SELECT '{}' AS table_name, '{}' AS column_name, '{}' AS kind, CAST(coalesce(({}), 0) AS BIGINT) AS n"
_BROKEN = [
    ("dim_customer", "customer_sk", "unique", "0"),
    ("dim_product", "product_sk", "unique", "SELECT count(*) FROM (SELECT product_id FROM pc WHERE NOT bad_key AND product_id <> '' GROUP BY 1 HAVING count(*) > 1)"),
    ("dim_product", "unit_of_measure", "within", "SELECT count(*) FROM pc WHERE NOT bad_key AND product_id <> '' AND (unit_of_measure IS NULL OR unit_of_measure NOT IN ('kg', 'pcs', 'liters'))"),
    ("dim_store", "store_bk", "unique", "0"),
    ("dim_store", "store_type", "within", "0"),
    ("dim_date", "calendar_date", "unique", "0"),
    ("dim_payment_method", "payment_bk", "unique", "0"),
    ("dim_payment_method", "channel", "within", "0"),
    ("fact_sales", "transaction_id", "unique", "SELECT count(*) FROM (SELECT transaction_id FROM own GROUP BY 1 HAVING count(*) > 1)"),
    ("fact_sales", "transaction_id", "present", "0"),
    ("fact_sales", "reconciliation_status", "within", "SELECT count(*) FROM own WHERE reconciliation_status NOT IN ('MATCHED', 'PENDING', 'MISSING', 'NOT_REQUIRED')"),
    ("fact_sales", "store_sk", "known", "SELECT count(*) FROM own WHERE store_id = 'UNKNOWN_STORE'"),
    ("fact_sales", "customer_sk", "known", "0"),
    ("fact_sales", "product_sk", "known", "0"),
    ("fact_sales", "date_sk", "known", "SELECT count(*) FROM own WHERE CAST(sold_at AS DATE) NOT BETWEEN DATE '2024-01-01' AND DATE '2024-07-31'"),
    ("fact_sales", "payment_sk", "known", "0"),
]
ORACLES["star_constraints"] = _cte(**FACTS, pc=PRODUCTS_CLEAN, own="SELECT * FROM f WHERE product_sk IS NOT NULL") + " UNION ALL ".join(_RULE.format(*r) for r in _BROKEN)
