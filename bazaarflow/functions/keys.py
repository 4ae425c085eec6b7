"""Keys and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def surrogate_key(c: Column) -> Column:
    """60 bits of the SHA-1 of the business key: the same key on every load."""
    return F.conv(F.substring(F.sha1(c.cast("binary")), 1, 15), 16, 10).cast("bigint")


def row_hash(*columns: Column) -> Column:
    """SHA-1 over all values; null has a mark of its own, so neighbours cannot run together."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns]).cast("binary"))
