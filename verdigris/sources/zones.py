"""Lakehouse zones: partitioned parquet tables, reject sinks, presence and freshness.

Tables are Hive-style partitioned parquet (``reporting_year[/reporting_month]``)
with partition columns kept only in the path. Re-running one year replaces that
year and leaves the others; whole-table writes and named values also remove
what has no rows any more. Each replacement is seen whole or not at all.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import snapshots

ZONES = ("raw", "curated", "aggregated")


def table_path(root: str, zone: str, table: str) -> str:
    return f"{root.rstrip('/')}/{zone}/{table}"


def read_zone(spark: SparkSession, root: str, zone: str, table: str,
              schema: T.StructType | str | None = None) -> DataFrame:
    """SRC-01/02: scan a partitioned table; partition columns come from the path.

    A table with snapshots is read at its newest complete version, any other folder as it is. Filters on partition columns prune directories; other filters and the
    projection are pushed into the parquet scan by Catalyst.
    """
    path = table_path(root, zone, table)
    if (found := snapshots.read(spark, path, schema)) is not None:
        return found
    r = spark.read.option("basePath", path)
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def write_zone(df: DataFrame, root: str, zone: str, table: str, columns: list[str] | None = None,
               partition_by: tuple[str, ...] = ("reporting_year",), replace: str | list | None = None) -> str:
    """SRC-05 / GOV-15: ordered projection to the contract, partition replacement at one moment (see ``snapshots``).

    The REBALANCE hint brings the rows of a partition value together, so each
    is written by few tasks, and splits a value that is too large for one.
    ``replace``: None replaces the partitions that ``df`` has rows for;
    ``"table"`` replaces the whole table; a list of values of the first
    partition column replaces these, so that partitions that have no rows any
    more don't stay.
    """
    path = table_path(root, zone, table)
    out = df.select(*columns) if columns else df
    snapshots.write(out.hint("rebalance", *partition_by), path, partition_by, replace)
    return path


def land(df: DataFrame, root: str, zone: str, table: str, partition_by: tuple[str, ...]) -> str:
    """Rows into plain partition folders, each written by one batch alone and overwritten when that batch runs again."""
    path = table_path(root, zone, table)
    if snapshots.newest(df.sparkSession, path):
        raise ValueError(f"{path} has snapshots; rows can't land beside them")
    (df.hint("rebalance", *partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))
    return path


REJECT_PARTITIONS = ("reporting_year", "reject_reason")


def write_rejects(df: DataFrame, root: str, table: str, replace: str | list | None = None) -> str:
    """SRC-08: rejected rows by year and ``reject_reason``, the one layout of every writer."""
    return write_zone(df, root, "curated", f"errors/{table}", None, REJECT_PARTITIONS, replace)


def read_rejects(spark: SparkSession, root: str, table: str, schema: T.StructType | str | None = None) -> DataFrame:
    return read_zone(spark, root, "curated", f"errors/{table}", schema)


def partition_presence(spark: SparkSession, present: DataFrame, tables: list[str], first_year: int,
                       last_year: int, key: str = "reporting_year") -> DataFrame:
    """SRC-06: required (table, year) partitions, and whether each holds rows.

    ``present`` is (table_name, reporting_year) of the data found. The
    required domain is generated with ``sequence`` - no driver-side loops.
    """
    dom = (spark.createDataFrame([(t,) for t in tables], "table_name string")
           .select("table_name", F.explode(F.sequence(F.lit(first_year), F.lit(last_year))).alias(key)))
    found = present.select("table_name", key).distinct().withColumn("present", F.lit(True))
    return (dom.join(found, ["table_name", key], "left")
               .select("table_name", key, F.coalesce("present", F.lit(False)).alias("present")))


def freshness(df: DataFrame, table: str, now_col=None, max_age_hours: float = 720.0) -> DataFrame:
    """SRC-07: age in hours of the newest file of a table (``_metadata``), stale flag."""
    now = now_col if now_col is not None else F.current_timestamp()
    newest = df.select(F.col("_metadata.file_modification_time").alias("m")).agg(F.max("m").alias("newest"))
    age = (F.unix_timestamp(now) - F.unix_timestamp("newest")) / F.lit(3600.0)
    return newest.select(F.lit(table).alias("table_name"), "newest",
                         F.round(age, 2).alias("age_hours"), (age > max_age_hours).alias("stale"))


def row_text(df: DataFrame) -> "F.Column":
    """One text per row, the same in any engine: doubles as 6-digit decimals, NULL as ``~``."""
    def one(f):
        c = F.col(f.name)
        c = c.cast("decimal(38,6)") if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c
        return F.coalesce(c.cast("string"), F.lit("~"))
    return F.concat_ws("|", *[one(f) for f in df.schema.fields])


def table_fingerprint(df: DataFrame, name: str) -> DataFrame:
    """SRC-12: order-insensitive SHA-256 fingerprint: row count, and the sum of the rows' first 15 hex digits."""
    h = F.conv(F.substring(F.sha2(row_text(df), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.sum("h").cast("string").alias("hash_sum")) \
             .select(F.lit(name).alias("table_name"), "rows", F.sha2(F.coalesce("hash_sum", F.lit("0")), 256).alias("fingerprint"), "hash_sum")


def payload_digest(col) -> "F.Column":
    """SRC-12: 16-hex digest of a JSON payload."""
    return F.substring(F.sha2(F.to_json(col), 256), 1, 16)


def list_objects(spark: SparkSession, root: str, exclude_prefixes: tuple[str, ...] = ("prompts/",),
                 min_bytes: int = 100) -> DataFrame:
    """SRC-13: object listing without reading contents, category = first path part."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path", "length", "modificationTime"))
    rel = F.regexp_replace("path", "^.*?" + os.path.basename(root.rstrip("/")) + "/", "")
    f = files.withColumn("key", rel)
    cond = (F.col("length") >= min_bytes) & ~F.col("key").endswith(".metadata.json")
    for p in exclude_prefixes:
        cond = cond & ~F.col("key").startswith(p)
    return (f.filter(cond)
             .select("key", F.element_at(F.split("key", "/"), 1).alias("category"),
                     F.element_at(F.split("key", "/"), -1).alias("filename"),
                     F.round(F.col("length") / F.lit(1024.0), 1).alias("size_kb"),
                     F.col("modificationTime").alias("modified")))


def write_sample_csv(df: DataFrame, path: str, n: int = 100) -> str:
    """SRC-09: CSV sample of the first ``n`` rows (a sampling sink: the limit is the feature)."""
    df.limit(n).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """SRC-09: CSV source with an explicit schema (no inference)."""
    return spark.read.option("header", "true").schema(schema).csv(path)


def write_bundle_json(bundle: DataFrame, path: str) -> str:
    """SRC-10: the serving bundle as a JSON cache file."""
    bundle.coalesce(1).write.mode("overwrite").json(path)
    return path


def read_bundle_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """SRC-10: read the cached bundle back with its schema."""
    return spark.read.schema(schema).json(path)
