"""Sources and sinks: text extracts, Parquet tables, landing zones, small reports."""

from __future__ import annotations

import json
import os
import re
import tempfile
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with header, every column as text, nulls as empty text."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).csv(path, header=True, escape='"').na.fill("")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def preferred(spark: SparkSession, *paths: str) -> str:
    """The first path that exists: a cleansed extract before a raw one."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {paths}")


def land(df: DataFrame, path: str, run_id: str) -> None:
    """Append a run's raw rows in a partition of their own; earlier runs are not touched."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8) -> DataFrame:
    """A table of a relational database, in parallel over a numeric key where one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, parts: int = 8) -> None:
    """Append to a table of a relational database over a bounded number of connections."""
    df.coalesce(parts).write.mode("append").option("batchsize", "5000").jdbc(url, table)


def read_stream_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A stream of text extracts that arrive in a folder."""
    return spark.readStream.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, header=True)


def read_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()


def report_rows(df: DataFrame, most: int = 10_000) -> list[dict]:
    """Rows of a small report; refuses a table that is none."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    return [r.asDict(recursive=True) for r in rows]


def to_json(df: DataFrame) -> str:
    return json.dumps(report_rows(df), default=str, indent=2)


def to_markdown(df: DataFrame) -> str:
    rows = [[str(v) for v in r.values()] for r in report_rows(df)]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)]) + "\n"


def to_html(df: DataFrame, title: str) -> str:
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r.values()) + "</tr>" for r in report_rows(df))
    return f"<!doctype html><title>{escape(title)}</title><table><tr>{head}</tr>{body}</table>"


def publish(template: str, tokens: dict[str, str], path: str) -> None:
    """Fill the {{tokens}} of a page and put it in place at once: readers see the old page or the new one. A token without value is an error."""
    page = re.sub(r"\{\{(\w+)\}\}", lambda m: tokens[m[1]], template)
    with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(os.path.abspath(path)), suffix=".part", delete=False, encoding="utf-8") as f:
        f.write(page)
    os.replace(f.name, path)
