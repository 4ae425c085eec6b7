"""Entity resolution: match edges, components, survivors and the map from merged to surviving identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.similarity import may_reach, sorted_tokens, token_sort_ratio
from ..functions.standardize import name_key
from .near import candidates, near_sums


def phone_edges(customers: DataFrame) -> DataFrame:
    """(a, b): rows of one valid phone linked to its smallest identifier; a star, not all pairs."""
    valid = customers.where("phone_status = 'valid'")
    hubs = valid.groupBy("phone_e164").agg(F.min("customer_id").alias("a"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return valid.join(hubs, "phone_e164").where(F.col("customer_id") != F.col("a")).select("a", F.col("customer_id").alias("b"))


def _named(customers: DataFrame) -> DataFrame:
    """customer_id, district, email (null: empty), name with sorted words: customers with a name in a resolved district."""
    own = customers.where("district_status not in ('missing', 'unresolved')").select("customer_id", "district", F.coalesce("email", F.lit("")).alias("email"), name_key(F.col("full_name")).alias("name"))
    return own.where("name <> ''").withColumn("name", sorted_tokens(F.col("name")))


def near_names(own: DataFrame, least: int = 90) -> DataFrame:
    """(district, x, y), x before y: different names of one district with a similarity of at least `least`."""
    names = own.select(F.col("district").alias("block"), "name").distinct()
    kept = lambda a, b: F.ceil((a + b) * least / 200.0)
    near = candidates(names, kept).where(may_reach(F.col("x"), F.col("y"), least))
    return near.where(token_sort_ratio(F.col("x"), F.col("y")) >= least).select(F.col("block").alias("district"), "x", "y")


def fuzzy_pairs(customers: DataFrame, least: int = 90) -> DataFrame:
    """(a, b, outcome) of pairs with near names in one resolved district: equal emails merge, different ones reject, others review.

    A block is a district; its names are compared once each, and their customers are paired afterwards.
    """
    own = _named(customers)
    a, b = (own.select("district", *[F.col(c).alias(f"{c}_{k}") for c in ("customer_id", "email")], F.col("name").alias(k)) for k in "xy")
    same = own.select("district", F.col("name").alias("x"), F.col("name").alias("y")).distinct()
    pairs = near_names(own, least).unionByName(same).join(a, ["district", "x"]).join(b, ["district", "y"])
    pairs = pairs.where(F.when(F.col("x") == F.col("y"), F.col("customer_id_x") < F.col("customer_id_y")).otherwise(F.col("customer_id_x") != F.col("customer_id_y")))
    both = (F.col("email_x") != "") & (F.col("email_y") != "")
    outcome = F.when(both & (F.col("email_x") == F.col("email_y")), "merge").when(both, "reject").otherwise("review")
    return pairs.select(F.least("customer_id_x", "customer_id_y").alias("a"), F.greatest("customer_id_x", "customer_id_y").alias("b"), outcome.alias("outcome"))


def fuzzy_links(customers: DataFrame, least: int = 90) -> DataFrame:
    """Each named customer of a resolved district with its class and how many of its fuzzy_pairs() have which outcome.

    A class is a district's customers of one name (sorted words), called by its smallest identifier. Copies are counted, not
    paired: names are compared once each in a district, and once in the customers of an email there, which give sums over near
    names and no pairs. Identifiers are unique. Customers are checkpointed in the session's shared folder, since they are read several times.
    """
    need_checkpoints(customers.sparkSession)
    own = _named(customers).checkpoint()
    by_name = own.groupBy("district", "name").agg(F.min("customer_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.count_if(F.col("email") == "").alias("blanks"))
    around = near_sums(by_name.select("district", "name", F.col("class_size").alias("_n"), F.col("blanks").alias("_blanks")), ["district"], ["_n", "_blanks"], least)
    # equal emails under two names: only emails that several names of the district have
    mails = own.where("email <> ''").groupBy("district", "name", "email").agg(F.count(F.lit(1)).alias("k"))
    shared = mails.join(mails.groupBy("district", "email").agg(F.count(F.lit(1)).alias("_names")).where("_names > 1").drop("_names"), ["district", "email"])
    merged = near_sums(shared.withColumnRenamed("k", "_k"), ["district", "email"], ["_k"], least)
    of_mail = mails.join(merged, ["district", "name", "email"], "left").select("district", "name", "email", (F.col("k") - 1 + F.coalesce("_k", F.lit(0))).alias("_merge"))
    met = own.join(by_name.join(around, ["district", "name"], "left"), ["district", "name"]).join(of_mail, ["district", "name", "email"], "left")
    links = F.col("class_size") - 1 + F.coalesce("_n", F.lit(0))
    blanks = F.col("blanks") + F.coalesce("_blanks", F.lit(0))
    merge = F.coalesce("_merge", F.lit(0))
    review = F.when(F.col("email") == "", links).otherwise(blanks)
    return met.select("customer_id", "class_id", "class_size", links.alias("links"), merge.alias("merge"), (links - merge - review).alias("reject"), review.alias("review"))


def near_keys(rows: DataFrame, block: str, key: str, name: str) -> DataFrame:
    """(a, b, distance), a < b: keys of one block whose names are at most two edits apart.

    What all names of a block begin with is left out, which changes no distance. Different names are compared once each.
    """
    own = rows.select(F.col(block).alias("block"), F.col(key).alias("key"), F.col(name).alias("name")).dropna()
    ends = own.groupBy("block").agg(F.min("name").alias("_low"), F.max("name").alias("_high"))
    same = lambda k: F.substring("_low", F.lit(1), k) == F.substring("_high", F.lit(1), k)
    shared = F.size(F.filter(F.sequence(F.lit(0), F.length("_low")), same)) - 1
    own = own.join(F.broadcast(ends.select("block", shared.alias("_shared"))), "block").withColumn("name", F.substring("name", F.col("_shared") + 1, F.length("name"))).drop("_shared")
    names = own.select("block", "name").distinct()
    near = candidates(names, lambda a, b: b - 2).withColumn("distance", F.levenshtein("x", "y", 2)).where("distance >= 0")
    near = near.unionByName(names.select("block", F.col("name").alias("x"), F.col("name").alias("y"), F.lit(0).alias("distance")))
    a, b = (own.select("block", F.col("key").alias(f"_{k}"), F.col("name").alias(k)) for k in "xy")
    pairs = near.join(a, ["block", "x"]).join(b, ["block", "y"]).where(F.when(F.col("x") == F.col("y"), F.col("_x") < F.col("_y")).otherwise(F.col("_x") != F.col("_y")))
    return pairs.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "distance")


def need_checkpoints(spark: SparkSession) -> None:
    """Without spark.checkpoint.dir a session of one machine gets a folder of that machine; a cluster must name a shared one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(base or "/tmp/checkpoints/retail")


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, cluster (the smallest identifier that links reach), for every node. Rounds of minimum labels.

    Each round is checkpointed in the session's shared folder.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    need_checkpoints(nodes.sparkSession)
    cut = lambda d: d.checkpoint()
    both = cut(both)
    labels = cut(nodes.select("id", F.col("id").alias("cluster")))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("near"))
        stepped = cut(labels.join(near, "id", "left").select("id", F.least("cluster", F.coalesce("near", "cluster")).alias("cluster"), F.col("cluster").alias("_old")))
        if stepped.where("cluster <> _old").isEmpty():
            return stepped.drop("_old")
        labels = stepped.drop("_old")


def survivors(customers: DataFrame, clustered: DataFrame) -> DataFrame:
    """One row per cluster, its most complete and then oldest, with the identifiers merged into it."""
    filled = sum(((F.coalesce(F.col(c), F.lit("")) != "").cast("int") for c in ("full_name", "phone_e164", "email", "district", "registration_date", "gender")), F.lit(0))
    day = F.when(F.coalesce("registration_date", F.lit("")) == "", "9999-12-31").otherwise(F.col("registration_date"))
    order = Window.partitionBy("cluster").orderBy(F.desc(filled), day, "customer_id")
    ranked = customers.join(clustered.withColumnRenamed("id", "customer_id"), "customer_id").withColumn("_n", F.row_number().over(order))
    merged = ranked.where("_n > 1").groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("customer_id")), ";").alias("merged_customer_ids"))
    return ranked.where("_n = 1").drop("_n").join(merged, "cluster", "left").withColumn("merged_customer_ids", F.coalesce("merged_customer_ids", F.lit("")))


def golden_map(surviving: DataFrame) -> DataFrame:
    """merged_id, customer_id: where each merged identifier went."""
    return surviving.where("merged_customer_ids <> ''").select(F.explode(F.split("merged_customer_ids", ";")).alias("merged_id"), "customer_id")


def remap(sales: DataFrame, golden: DataFrame) -> DataFrame:
    """Sales of merged customers under the surviving identifier."""
    met = sales.join(golden.select(F.col("merged_id"), F.col("customer_id").alias("_to")), sales["customer_id"] == F.col("merged_id"), "left")
    return met.withColumn("customer_id", F.coalesce("_to", "customer_id")).drop("_to", "merged_id")


def open_reviews(pairs: DataFrame, clustered: DataFrame) -> DataFrame:
    """Pairs to review whose ends are in different clusters."""
    ends = clustered.select("id", "cluster")
    a, b = (ends.select(F.col("id").alias(k), F.col("cluster").alias(f"_{k}")) for k in ("a", "b"))
    return pairs.where("outcome = 'review'").join(a, "a").join(b, "b").where("_a <> _b").select("a", "b")


def with_review_flag(surviving: DataFrame, reviews: DataFrame) -> DataFrame:
    """Surviving customers with stewardship_flag on those that an open pair (a, b) names."""
    named = reviews.select(F.explode(F.array("a", "b")).alias("customer_id")).distinct().withColumn("_open", F.lit(True))
    return surviving.join(named, "customer_id", "left").withColumn("stewardship_flag", F.when(F.col("_open"), "REVIEW: possible duplicate").otherwise("")).drop("_open")


def statistics(customers: DataFrame, surviving: DataFrame, reviews: DataFrame) -> DataFrame:
    """metric, value: input rows, surviving rows, merged rows, clusters of several rows, open pairs, flagged rows."""
    n = F.count(F.lit(1))
    flagged = with_review_flag(surviving, reviews)
    parts = {
        "input_rows": customers.agg(n),
        "surviving_rows": surviving.agg(n),
        "merged_rows": surviving.agg(F.coalesce(F.sum(F.when(F.col("merged_customer_ids") != "", F.size(F.split("merged_customer_ids", ";"))).otherwise(0)), F.lit(0))),
        "clusters": surviving.agg(F.count_if(F.col("merged_customer_ids") != "")),
        "open_review_pairs": reviews.agg(n),
        "rows_flagged_for_review": flagged.agg(F.count_if(F.col("stewardship_flag") != "")),
    }
    out = None
    for name, df in parts.items():
        row = df.toDF("value").select(F.lit(name).alias("metric"), F.col("value").cast("long").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def best_by_source(records: DataFrame, key: str, columns: dict[str, list[str]], source: str = "source") -> DataFrame:
    """Per key and column, the value of the first source in the column's list that has one."""
    picks = []
    for column, order in columns.items():
        rank = F.coalesce(*[F.when(F.col(source) == s, len(order) - k) for k, s in enumerate(order)], F.lit(0))
        picks.append(F.max_by(column, F.when(F.coalesce(F.col(column), F.lit("")) != "", rank)).alias(column))
    return records.groupBy(key).agg(*picks)


def households(customers: DataFrame) -> DataFrame:
    """District, last name and phone that several customers share: a hint, never a merge."""
    last = F.element_at(F.split(name_key(F.col("full_name")), " "), -1)
    own = customers.where("phone_status = 'valid' and full_name <> ''").groupBy("district", last.alias("surname"), "phone_e164").agg(F.count(F.lit(1)).alias("members"))
    return own.where("members > 1")


def household_scores(customers: DataFrame, activity: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """households() with at least one member active in the last days, and a score from 0 to 1; activity: customer_id, last_day.

    Chosen weights: 0.5 for the shared keys, 0.1 for each member beyond two up to 0.3, 0.2 for the share of active members.
    """
    last = F.element_at(F.split(name_key(F.col("full_name")), " "), -1)
    own = customers.where("phone_status = 'valid' and full_name <> ''").select("customer_id", "district", last.alias("surname"), "phone_e164")
    recent = activity.where(F.datediff(F.lit(as_of).cast("date"), F.to_date("last_day")).between(0, days)).select("customer_id", F.lit(1).alias("_a")).distinct()
    met = own.join(recent, "customer_id", "left").groupBy("district", "surname", "phone_e164").agg(F.count(F.lit(1)).alias("members"), F.count("_a").alias("active"))
    score = 0.5 + F.least((F.col("members") - 2) * 0.1, F.lit(0.3)) + 0.2 * F.col("active") / F.col("members")
    return met.where("members > 1 and active > 0").withColumn("score", F.round(score, 4))
