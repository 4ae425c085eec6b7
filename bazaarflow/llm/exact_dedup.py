"""Exact deduplication by a tree of merges of sorted digest runs. DataFrame functions only.

Rows are dealt over `runs` runs, a power of two; each run holds one entry per digest (largest identifier, number of
rows), sorted by digest. In each of log2(runs) binomial rounds, run r takes in run r + 1 of the same pair: both are exchanged
by segment, sorted together by digest and merged, so that equal digests lie side by side and one entry of them goes on.
To keep every executor busy up to the root, a merged run is cut into as many segments of digest prefixes as it took in
runs. With a larger `fan_in`, a round merges as many runs at once. A merge takes entries for one text only if SHA-256,
length in bytes and a second, independent hash agree, and holds on to the wanted identifier at every level. Answers
go back down by (run, digest), so that a text that a third of all rows share is looked up once per run and its rows stay
spread over all runs.

Defined results: null text counts as empty; repeated rows count as rows; rows without identifier sort below all
identifiers (the group keeps null only if it has no identifier at all); very long texts are digested whole; an empty table
gives an empty table; other columns are ignored by `exact_duplicates` and kept, whatever their names, by
`drop_exact_duplicates`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, free_names, materialize, shuffle_width

FAN_IN = 2


def width(spark) -> int:
    """Runs to deal rows over: a power of two, and no fewer than partitions of a shuffle."""
    return 1 << max(1, (shuffle_width(spark) - 1).bit_length())


def second_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _digests(docs: DataFrame, runs: int) -> DataFrame:
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    return docs.select(F.col("doc_id"), text.alias("_t")).select(
        "doc_id",
        F.unhex(F.sha2(F.col("_t"), 256)).alias("digest"),
        F.struct(F.octet_length("_t").alias("size"), second_hash(F.col("_t")).alias("second")).alias("proof"),
        F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.length("_t")), F.lit(runs)).cast("int").alias("run"),
    )


def leaves(rows: DataFrame, keep: str) -> DataFrame:
    """One entry per digest of each run, added up before they are sorted."""
    best = {"max": F.max, "min": F.min}[keep]
    entries = rows.groupBy("run", "digest", "proof").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return entries.withColumn("prefix", F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("int"))


def merge_tree(runs: DataFrame, n_runs: int, keep: str = "max", fan_in: int = FAN_IN) -> DataFrame:
    """Merge runs (run, digest, proof, keep_id, group_size, prefix) in rounds up to one entry for each digest."""
    best = {"max": F.desc_nulls_last, "min": F.asc_nulls_last}[keep]
    level, segments = runs, 1
    while n_runs > 1:
        n_runs, segments = -(-n_runs // fan_in), segments * fan_in
        # the segment is a function of the digest and rises with it: it spreads a merged run and keeps its order
        dealt = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).withColumn("segment", F.floor(F.col("prefix").cast("long") * segments / (1 << 24)).cast("int"))
        same = Window.partitionBy("run", "segment", "digest", "proof").orderBy(best("keep_id"))
        merged = dealt.repartition("run", "segment").select(
            "run", "digest", "proof", "prefix", "keep_id", F.sum("group_size").over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("group_size"), F.row_number().over(same).alias("place")
        )
        level = merged.where("place = 1").drop("place")
    return level.select("digest", "proof", "keep_id", "group_size")


def exact_duplicates(docs: DataFrame, keep: str = "max", runs: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    n = runs or width(docs.sparkSession)
    rows = materialize(_digests(docs, n))
    tops = merge_tree(leaves(rows, keep), n, keep, fan_in)
    entries = rows.select("run", "digest", "proof").distinct()
    down = entries.join(tops, ["digest", "proof"]).select("run", "digest", "proof", "keep_id", "group_size")
    # the third key keeps the join's partitioning apart from the entries' and spreads a run's rows by digest
    return rows.join(down, ["run", "digest", "proof"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, keep: str = "max", fan_in: int = FAN_IN) -> DataFrame:
    """docs without the rows that another row of the same text replaces; all columns stay.

    Of rows that repeat the kept identifier, one stays: the one whose other columns hash lowest.
    """
    n = width(docs.sparkSession)
    known, lacks, second, size, nth = free_names(docs.columns, "id", "lacks", "second", "size", "nth")
    rows = materialize(_digests(docs.select(F.col("doc_id"), F.col("text")), n))
    identity = lambda row_id: [F.coalesce(row_id, F.lit(0)).alias(known), F.isnull(row_id).alias(lacks)]
    stay = merge_tree(leaves(rows, keep), n, keep, fan_in).select(*identity(F.col("keep_id")), F.col("proof.second").alias(second), F.col("proof.size").alias(size))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    low = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    met = docs.select(*columns, *identity(F.col("doc_id")), second_hash(low).alias(second), F.octet_length(low).alias(size)).join(stay, [known, lacks, second, size], "left_semi")
    order = F.xxhash64(*[c.cast("string") for c in columns])
    return met.withColumn(nth, F.row_number().over(Window.partitionBy(known, lacks, second, size).orderBy(order))).where(F.col(nth) == 1).select(*columns)
