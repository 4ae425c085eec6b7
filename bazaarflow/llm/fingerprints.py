"""Document fingerprints of closed syncmers. DataFrame functions only.

A text is cut into words (long ones into pieces of PIECE characters, so a text without spaces has anchors too). A run of
K words is a closed syncmer, and thereby an anchor, if the smallest hash among its runs of S words is its first or its
last one; this depends on the run alone, so an edit elsewhere leaves the anchor and its order in place. A text of fewer
than K words is one anchor. The fingerprint is the SIZE smallest distinct anchor hashes; two fingerprints' likeness is
the share of the smallest hashes of their union that both have, an estimate of the anchors' Jaccard similarity. Beside the
estimates stand two comparisons of all anchors: their Jaccard similarity, and the largest share of the union that is matched at
one and the same shift of positions (each anchor at its first place), which reordering lowers.

Defined results: null text is empty and has no anchors; two texts without anchors are alike (1), one with and one without are
not (0); rows without identifier come last; rows of one identifier are ordered by a hash of the text; repeated rows follow
each other; a single row's next document is itself; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K, S, PIECE, SIZE, BITS = 5, 2, 16, 64, 40
#: Rows that a chunk of neighbouring identifiers should hold, ranges and chunks of a range at most, bounds looked at together.
CHUNK, COARSE, FINE, FAN = 1000, 1024, 1024, 32


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with column out: array of (position of the anchor's first word, hash)."""
    words, h, g = f"__{out}_w", f"__{out}_h", f"__{out}_g"
    df = df.withColumn(words, F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]{1,%d}" % PIECE), F.lit(0)))
    df = df.withColumn(h, F.transform(words, lambda x: F.xxhash64(x)))
    spots = lambda width: F.when(F.size(h) >= width, F.sequence(F.lit(0), F.size(h) - width)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(g, F.transform(spots(S), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(S)])))

    def anchor(i: Column) -> Column:
        inner = [F.get(g, i + k) for k in range(K - S + 1)]
        least = F.least(*inner)
        closed = (inner[0] == least) | (inner[-1] == least)
        return F.when(closed, F.struct(i.alias("at"), F.xxhash64(*[F.get(h, i + k) for k in range(K)]).alias("hash")))

    whole = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(F.array_join(words, " "), F.lit(K)).alias("hash")))
    found = F.when(F.size(h) >= K, F.filter(F.transform(spots(K), anchor), lambda a: a.isNotNull())).when(F.size(h) > 0, whole)
    return df.withColumn(out, F.coalesce(found, F.array().cast("array<struct<at:int,hash:bigint>>"))).drop(words, h, g)


def sketch(anchors: Column) -> Column:
    """The smallest distinct anchor hashes, of BITS bits each."""
    low = F.transform(anchors, lambda a: a["hash"].bitwiseAND(F.lit((1 << BITS) - 1)))
    return F.slice(F.sort_array(F.array_distinct(low)), 1, SIZE)


def written(own: Column) -> Column:
    """A sketch as text: hexadecimal numbers of one width."""
    return F.array_join(F.transform(own, lambda x: F.lpad(F.lower(F.hex(x)), BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    low = F.slice(F.sort_array(F.array_union(a, b)), 1, SIZE)
    both = F.size(F.array_intersect(low, F.array_intersect(a, b)))
    return F.when(F.size(low) > 0, both / F.size(low)).otherwise(1.0)


def compared(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with anchors_<out> and placed_<out>: all anchors of a and b compared, without and with their positions."""
    every, firsts, shifts = f"__{out}_e", f"__{out}_f", f"__{out}_s"
    tagged = lambda c, side: F.transform(c, lambda x: F.struct(x["hash"].alias("hash"), F.lit(side).alias("side"), x["at"].alias("at")))
    df = df.withColumn(every, F.sort_array(F.concat(tagged(a, 0), tagged(b, 1))))

    def fresh(x: Column, i: Column) -> Column:
        before = F.get(every, i - 1)
        return (i == 0) | (before["hash"] != x["hash"]) | (before["side"] != x["side"])

    def shift(x: Column, i: Column) -> Column:
        after = F.get(firsts, i + 1)
        return F.when((x["side"] == 0) & (after["hash"] == x["hash"]), after["at"] - x["at"])

    def longest(s: Column, x: Column) -> Column:
        run = F.when(s["last"] == x, s["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    df = df.withColumn(firsts, F.filter(every, fresh))
    df = df.withColumn(shifts, F.sort_array(F.filter(F.transform(firsts, shift), lambda x: x.isNotNull())))
    none = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))
    union = F.size(firsts) - F.size(shifts)
    share = lambda n: F.when(union > 0, n / union).otherwise(1.0)
    return df.withColumns({f"anchors_{out}": share(F.size(shifts)), f"placed_{out}": share(F.aggregate(shifts, none, longest)["best"])}).drop(every, firsts, shifts)


def _below(bounds: Column, x: Column) -> Column:
    """Number of ascending bounds below x: first among every FAN-th, then among those between."""
    size = F.size(bounds)
    coarse = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((size - 1) / FAN), F.lit(0)).cast("int")), lambda k: F.get(bounds, k * FAN))
    group = F.greatest(F.size(F.filter(coarse, lambda b: b < x)) - 1, F.lit(0)) * FAN
    return F.when(size > 0, group + F.size(F.filter(F.slice(bounds, group + 1, F.lit(FAN)), lambda b: b < x))).otherwise(0)


def _chunked(df: DataFrame) -> DataFrame:
    """df with a chunk number that falls with the identifier; null identifiers come last.

    Quantiles of all rows cut them into at most COARSE ranges, and quantiles of each range cut that into at most FINE chunks.
    """
    n = df.count()
    chunks = max(1, -(-n // CHUNK))
    coarse = min(COARSE, chunks)
    fine = min(FINE, -(-chunks // coarse))
    points = lambda k: [i / k for i in range(1, k)]
    bounds = sorted(set((df.agg(F.percentile_approx("doc_id", points(coarse), 100 * coarse)).first()[0] or []) if coarse > 1 else []))  # fewer than COARSE numbers
    none = F.col("doc_id").isNull()
    every = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    ranged = df.withColumn("range", F.when(none, F.lit(len(bounds) + 1)).otherwise(F.lit(len(bounds)) - _below(every, F.col("doc_id"))))
    if fine == 1:
        return ranged.withColumnRenamed("range", "chunk")
    cuts = F.array_distinct(F.coalesce(F.percentile_approx("doc_id", points(fine), 100 * fine), F.array().cast("array<bigint>")))
    inner = materialize(ranged.groupBy("range").agg(cuts.alias("bounds")))  # approximate, so read and never made twice
    met = ranged.join(F.broadcast(inner), "range")  # at most COARSE + 1 rows of FINE numbers
    place = F.when(none, F.lit(0)).otherwise(F.size("bounds") - _below(F.col("bounds"), F.col("doc_id")))
    return met.withColumn("chunk", (F.col("range") * FINE + place).cast("int")).drop("range", "bounds")


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """df (doc_id, mark and columns) with next_<column> of the row that follows by falling identifier; the first follows the last."""
    numbered = _chunked(df)
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), -F.col("mark").cast("decimal(20,0)"))
    firsts = numbered.groupBy("chunk").agg(F.max_by(F.struct("doc_id", "mark"), place).alias("first"))
    # one row per chunk, COARSE * FINE at most
    around = Window.orderBy("chunk")
    last = F.last("chunk").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = firsts.select("chunk", F.col("first.doc_id").alias("first_id"), F.col("first.mark").alias("first_mark"), F.coalesce(F.lag("chunk").over(around), last).alias("before"))
    known = numbered.join(F.broadcast(heads), "chunk")
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark"))
    # a chunk's first row also stands, as a follower, at the end of the chunk before
    places = F.when(first, F.array(F.struct("chunk", F.lit(0).alias("role")), F.struct(F.col("before").alias("chunk"), F.lit(1).alias("role")))).otherwise(F.array(F.struct("chunk", F.lit(0).alias("role"))))
    spread = known.select("doc_id", "mark", *columns, F.explode(places).alias("p")).select("doc_id", "mark", *columns, "p.*")
    order = Window.partitionBy("chunk").orderBy("role", F.desc_nulls_last("doc_id"), "mark")
    led = spread.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return led.where("role = 0").drop("chunk", "role")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, anchors_edited, placed_edited, anchors_next, placed_next."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    ordered = with_next(own, ["text"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    cut = ordered.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)))
    # anchors are made here and not before the shuffle: all of them are larger than their text
    for text, out in (("text", "own"), ("next_text", "next"), ("edited", "cut")):
        cut = with_anchors(cut, text, out)
    prints = {f"{c}_print": sketch(F.col(c)) for c in ("own", "next", "cut")}
    cut = compared(compared(cut, "own", "cut", "edited"), "own", "next", "next").withColumns(prints)
    return cut.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("own_print")).alias("fingerprint"),
        written(F.col("cut_print")).alias("edited_fingerprint"),
        likeness(F.col("own_print"), F.col("cut_print")).alias("near_edited"),
        likeness(F.col("own_print"), F.col("next_print")).alias("near_next"),
        "anchors_edited",
        "placed_edited",
        "anchors_next",
        "placed_next",
    )
