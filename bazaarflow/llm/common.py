"""Shared helpers: intermediate tables in the cluster's shared folder, row keys, salted group look-ups."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Used only where a session of one machine names no shared folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/bazaarflow"
#: Settings of a write: shuffle files are dropped behind it, and a batch that goes to Python is small however long the texts are.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session: spark.checkpoint.dir, or a folder of this machine where that is all there is."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not base and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(base or LOCAL_CHECKPOINTS).rstrip('/')}/bazaarflow-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    The shuffle files behind it are dropped with the write, as nothing reads them again.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() made, once all that is made from them has been written."""
    for df in tables:
        _delete(df.sparkSession, df._stored_at)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has, in any case of letters."""
    taken = {c.lower() for c in columns}
    return [next(x for x in (f"__{w}{k or ''}" for k in itertools.count()) if x not in taken) for w in wanted]


def map_whole(df: DataFrame, run, schema: StructType) -> DataFrame:
    """df.mapInArrow(run, schema) whatever the columns are called; run finds them by place."""
    plain = [f"c{k}" for k in range(len(schema))]
    fields = StructType([StructField(n, f.dataType, f.nullable) for n, f in zip(plain, schema, strict=True)])

    def renamed(batches):
        for batch in run(batches):
            yield batch.rename_columns(plain)

    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(renamed, fields).toDF(*schema.names)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the identifier's text, modulo modulus; null identifiers count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A pure ASCII text takes the fast path; others are translated letter by letter."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
