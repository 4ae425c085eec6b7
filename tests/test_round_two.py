import os
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from bazaarflow.functions.similarity import indel_ratio
from bazaarflow.operators import cube, near, resolve
from bazaarflow.plans import inputs, queries
from bazaarflow.streaming import footfall


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_sliding_counts_round_to_the_nearest_second(spark):
    times = {1: "2024-01-01 00:00:00.400", 2: "2024-01-01 00:00:00.600", 3: "2024-01-02 00:00:00.700", 4: "2024-01-03 00:00:01.400", 5: "2024-01-04 00:00:01.500"}
    own = spark.createDataFrame([(k, 1, t) for k, t in times.items()], "event_id int, user_id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.event_id: r.n for r in own.select("event_id", footfall.sliding_counts(own, "user_id", "ts", 86_400).alias("n")).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 2, 5: 1}


def odd_names(seed, n):
    draw = random.Random(seed)
    words = ["okello", "akello", "junior", "é", "naïve", "x", "customer", "", "a" * 45]
    return ["".join(draw.choices("01é", k=draw.randrange(9))) if k % 2 else " ".join(draw.choices(words, k=draw.randrange(1, 5))) for k in range(n)]


def test_near_keys_are_all_pairs_within_two_edits(spark):
    for start in ("", "Supplier#"):
        rows = [(k % 2 if k % 41 else None, k, start + x) for k, x in enumerate(odd_names(1, 300))] + [(0, 900, None), (5, 901, "alone"), (6, 902, "same"), (6, 903, "same")]
        want = Counter((a[1], b[1], d) for a, b in combinations(rows, 2) if a[0] is not None and a[0] == b[0] and None not in (a[2], b[2]) and (d := edits(a[2], b[2])) <= 2)
        got = resolve.near_keys(spark.createDataFrame(rows, "g int, k int, s string"), "g", "k", "s")
        assert Counter(map(tuple, got.collect())) == want


def test_fuzzy_links_count_all_pairs_without_making_them(spark):
    names, mails = odd_names(2, 260), ["", None, "a@x.co", "b@x.co", "c@x.co"]
    rows = [(f"C{k:03}", x, mails[k % 5], "Gulu" if k % 3 else "Kumi", "exact" if k % 20 else "unresolved") for k, x in enumerate(names)]
    own = spark.createDataFrame(rows, "customer_id string, full_name string, email string, district string, district_status string")
    kept = resolve._named(own).collect()
    want = set()
    for a, b in combinations(kept, 2):
        if a.district == b.district and indel_ratio(a.name, b.name) >= 90:
            want.add((*sorted((a.customer_id, b.customer_id)), "review" if "" in (a.email, b.email) else "merge" if a.email == b.email else "reject"))
    pairs = [tuple(r) for r in resolve.fuzzy_pairs(own).collect()]
    assert len(pairs) == len(want) and set(pairs) == want
    links = resolve.fuzzy_links(own).collect()
    count = Counter((end, outcome) for a, b, outcome in want for end in (a, b))
    assert {(r.customer_id, k): r[k] for r in links for k in ("merge", "reject", "review") if r[k]} == dict(count)
    assert len(links) == len(kept) and all(r.links == r.merge + r.reject + r.review for r in links)


def test_fuzzy_pairs_reads_whole_names(spark, tmp_path):
    names = {12: "Customer#000012345", 24: "Customer#000067890", 36: "Customer#000067891"}
    spark.createDataFrame([(k, x) for k, x in names.items()], "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.customer_id: (r.class_size, r.links) for r in queries.QUERIES["fuzzy_pairs"](spark, str(tmp_path)).collect()}
    assert got == {"CUST100012": (1, 0), "CUST100024": (1, 1), "CUST100036": (1, 1)}


@pytest.mark.parametrize(("keys", "pairs"), [(near.KEYS, near.PAIRS), (10_000, 64), (500, 7)])
def test_near_rows_are_all_near_pairs(monkeypatch, keys, pairs):
    monkeypatch.setattr(near, "KEYS", keys)
    monkeypatch.setattr(near, "PAIRS", pairs)
    draw = random.Random(4)
    short = sorted({f"{draw.randrange(3000) * 997:09} customer" for _ in range(700)})
    mixed = sorted({x for x in odd_names(5, 200) if x} | {"".join(draw.choices("ab é", k=130)) + "z" * 70, "b" * 64, "b" * 65, "b" * 66})
    for names in (short, mixed):
        ones = near.np.ones((len(names), 1), near.np.int64)
        half = len(names) // 3
        want = Counter(x for a, b in combinations(range(len(names)), 2) if indel_ratio(names[a], names[b]) >= 90 for x in (a, b))
        got = near.cell_sums(names, None, (ones, ones), 90)[0][:, 0]
        assert dict(enumerate(map(int, got))) == {k: want[k] for k in range(len(names))}
        parts = names[:half], names[half:]
        got = near.cell_sums(*parts, (ones[:half], ones[half:]), 90)
        assert [list(map(int, x[:, 0])) for x in got] == [[sum(indel_ratio(x, y) >= 90 for y in other) for x in own] for own, other in (parts, parts[::-1])]


def test_near_sums_of_tiles_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near, "SUM_TILES", (40, 11))
    rows = sorted({(f"b{k % 3}" if k % 7 else f"c{k % 40}", k % 2, x) for k, x in enumerate(odd_names(6, 400)) if x})
    rows = [(*r, k + 1, k % 5) for k, r in enumerate(rows)]
    want = Counter()
    for a, b in combinations(rows, 2):
        if a[:2] == b[:2] and indel_ratio(a[2], b[2]) >= 90:
            for x, y in ((a, b), (b, a)):
                want[(*x[:3], "v")] += y[3]
                want[(*x[:3], "w")] += y[4]
    got = near.near_sums(spark.createDataFrame(rows, "g string, h long, name string, v long, w long"), ["g", "h"], ["v", "w"]).collect()
    assert {(r.g, r.h, r.name, k): r[k] for r in got for k in "vw" if r[k]} == {k: n for k, n in want.items() if n}


def test_fuzzy_links_shuffle_no_pairs(spark):
    rows = [(f"C{k}", f"Customer#{k:09}  Junior", "a@x.co" if k % 2 else "", "Gulu", "exact") for k in range(2000)]
    own = spark.createDataFrame(rows, "customer_id string, full_name string, email string, district string, district_status string")
    store = spark.sparkContext._jsc.sc().statusStore()
    java = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters
    stages = lambda: java.asJava(store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")()))
    before = {s.stageId() for s in stages()}
    links = resolve.fuzzy_links(own).collect()
    assert sum(r.links for r in links) > 500_000
    assert sum(s.shuffleWriteRecords() for s in stages() if s.stageId() not in before) < 100_000


def test_near_candidates_grow_with_the_names(spark):
    draw = random.Random(3)
    names = spark.createDataFrame([(1, x) for x in {f"{draw.randrange(10**9):09} customer junior" for _ in range(1500)}], "block int, name string")
    assert near.candidates(names, lambda a, b: F.ceil((a + b) * 90 / 200)).count() < 1500 * 1499 / 2 / 50


DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def scans(df):
    """How often the executed plan reads lines anew; what a reused exchange gives is not read again."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0].count("lineitem.parquet")


@needs_data
def test_narrow_lines_are_the_lines(spark):
    wide, narrow = inputs.load(spark, DATA, inputs.SALE_LINES), inputs.sale_lines(spark, DATA)
    assert wide.dtypes == narrow.dtypes
    assert wide.exceptAll(narrow).isEmpty() and narrow.exceptAll(wide).isEmpty()


@needs_data
def test_unusual_amounts_and_months_read_the_lines_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert scans(queries.QUERIES["unusual_amounts"](spark, DATA)) == 1
        assert scans(queries.QUERIES["revenue_month_city"](spark, DATA)) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_months_of_odd_lines(spark):
    rows = [("2024-01", "a", 5.0), ("2024-04", "b", 7.0), (None, "c", 9.0), ("2024-02", None, 3.0)]
    got = cube.dense_months(spark.createDataFrame(rows, "month string, city string, amount double"), "city").collect()
    want = {(f"2024-0{m}", c): 0.0 for m in range(1, 5) for c in ("a", "b", "c", None)} | {("2024-01", "a"): 5.0, ("2024-04", "b"): 7.0}
    assert {(r.month, r.city): float(r.revenue) for r in got} == want and len(got) == len(want)
    assert cube.dense_months(spark.createDataFrame([], "month string, city string, amount double"), "city").count() == 0


@needs_data
def test_idempotent_load_makes_its_facts_once(spark):
    plan = queries.QUERIES["idempotent_load"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "customer_id" not in plan and "LogicalRDD" in plan


@needs_data
def test_pareto_reads_the_lines_once(spark):
    plan = queries.QUERIES["pareto_parts"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "LogicalRDD" in plan
