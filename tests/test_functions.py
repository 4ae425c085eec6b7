import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bazaarflow.functions import masking, similarity
from bazaarflow.functions import standardize as S
from bazaarflow.functions.keys import row_hash, surrogate_key


def values(spark, function, raw):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(raw)], "k int, x string")
    rows = df.select("k", function(F.col("x")).alias("y")).orderBy("k").collect()
    return [tuple(r.y) if isinstance(r.y, tuple) else r.y for r in rows]


CASES = {
    "phone": (
        S.phone,
        {"+256 77 123 4567": ("+256771234567", "valid"), "077-123-4567": ("+256771234567", "valid"), "256771234567": ("+256771234567", "valid"), "771234567": ("+256771234567", "valid"), "12": ("12", "invalid"), "n/a": ("", "missing"), None: ("", "missing")},
    ),
    "district": (S.district, {" KLA ": ("Kampala", "variant_mapped"), "Jinja City": ("Jinja", "exact_remapped"), "Kumi": ("Kumi", "exact"), "Atlantis": ("Atlantis", "unresolved"), "null": ("", "missing")}),
    "unit": (S.unit, {"KGS": ("kg", "mapped"), "ml": ("liters", "converted"), "dozen": ("dozen", "unresolved"), None: ("", "missing")}),
    "category": (S.category, {"bevages": ("Beverages", "mapped"), "Unknown": ("", "mapped"), "": ("", "missing"), "Toys": ("Toys", "unresolved")}),
    "date": (S.date, {"2024-1-5": ("2024-01-05", "%Y-%m-%d"), "05/01/2024": ("2024-01-05", "%d/%m/%Y"), "05-01-2024": ("2024-01-05", "%d-%m-%Y"), "31/02/2024": ("31/02/2024", "unparseable"), "": ("", "missing")}),
    "gender": (S.gender, {"Male ": ("M", "mapped"), "f": ("F", "mapped"), "x": ("x", "unresolved")}),
}


@pytest.mark.parametrize("name", CASES)
def test_standardizers(spark, name):
    function, cases = CASES[name]
    assert values(spark, function, list(cases)) == list(cases.values())


def test_price(spark):
    got = values(spark, S.price, ["UGX 50,000", "12.5", "UGX cheap", "N/A", "1_000", None])
    assert [(None if v is None else float(v), s) for v, s in got] == [(50000.0, "valid"), (12.5, "valid"), (None, "invalid"), (None, "missing"), (None, "invalid"), (None, "missing")]


def test_masks(spark):
    assert values(spark, masking.mask_name, ["Ronald Atim", " Ronald ", "A  B C", " ", None]) == ["R*** A**", "R***", "A*** B**", None, None]
    assert values(spark, masking.mask_phone, ["+256721191430", "12345", "", None]) == ["+256-XXX-XX1430", "+256-XXX-XXXX", None, None]
    assert values(spark, masking.mask_email, [" ronald@shop.co.ug", "none", None]) == ["r***@shop.co.ug", None, None]
    assert values(spark, masking.mask_payment_ref, ["AUTH83951", "CASH-5129", "AB", " ", None]) == ["AU*****51", "CA*****29", "****", None, None]


def test_keys(spark):
    import hashlib

    assert values(spark, surrogate_key, ["CUST1"]) == [int(hashlib.sha1(b"CUST1").hexdigest()[:15], 16)]
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert len({r[0] for r in df.select(row_hash(*map(F.col, "xyz"))).collect()}) == 2


@settings(max_examples=60, deadline=None)
@given(st.text("abc d", max_size=30), st.text("abc d", max_size=30))
def test_indel_ratio(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    want = 200.0 * rows[-1][-1] / (len(a) + len(b)) if a or b else 100.0
    assert similarity.indel_ratio(a, b) == pytest.approx(want)
