"""Incremental refresh of the curated zones as raw energy files arrive.

The original refreshes on a schedule and polls a cache. Here a Structured
Streaming query watches the raw landing folder (parquet file source with the
raw schema). For each micro-batch, ``foreachBatch`` finds the reporting years
the batch touches and recomputes those years of ``ghg_scope1`` and
``ghg_scope2`` from the full raw zone. Imputation needs the whole year of a
facility, so a year is the unit of recomputation. The touched years are
replaced as a whole, and the others are left alone.

``foreachBatch`` may run a batch again after a failure. Raw rows are therefore
written to a partition named by the batch, which a replay overwrites, and the
raw zone is read as one row per facility and month, the one of the latest
batch. The raw zone is the only state; the checkpoint (in the shared folder)
records which files were processed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import scope1, scope2
from ..session import shared_dir
from ..sources import zones

ENERGY_SCHEMA = T.StructType([
    T.StructField("facility_id", T.StringType()), T.StructField("electricity_kwh", T.DoubleType()),
    T.StructField("natural_gas_gj", T.DoubleType()), T.StructField("diesel_liters", T.DoubleType()),
    T.StructField("srec_mwh_claimed", T.DoubleType()), T.StructField("grid_ef_kgco2_kwh", T.DoubleType()),
    T.StructField("ef_source", T.StringType()), T.StructField("meter_reading_kwh", T.DoubleType()),
    T.StructField("data_source", T.StringType()), T.StructField("record_status", T.StringType()),
    T.StructField("reporting_year", T.IntegerType()), T.StructField("reporting_month", T.IntegerType()),
])


RAW_PARTITIONS = ("reporting_year", "reporting_month", "batch_id")
RAW_SCHEMA = T.StructType([*ENERGY_SCHEMA.fields, T.StructField("batch_id", T.LongType())])


def raw_energy(spark: SparkSession, root: str, years: list[int] | None = None) -> DataFrame:
    """The raw zone's rows: of a facility and month the one that arrived last.

    ``years`` go into the filter as literals (as many as the calendar has), so
    the scan lists only their folders.
    """
    raw = zones.read_zone(spark, root, "raw", "energy_consumption", RAW_SCHEMA)
    if years is not None:
        raw = raw.where(F.col("reporting_year").isin(years))
    key = ["facility_id", "reporting_year", "reporting_month"]
    rest = [f.name for f in ENERGY_SCHEMA.fields if f.name not in key]
    last = F.max(F.struct("batch_id", *rest)).alias("last")
    return raw.groupBy(*key).agg(last).select(*[f"last.{f.name}" if f.name in rest else f.name for f in ENERGY_SCHEMA.fields])


def refresh_years(spark: SparkSession, root: str, years: list[int], facilities: DataFrame | None) -> None:
    """Recompute the curated tables of ``years`` from the raw zone; what they no longer hold goes."""
    touched = raw_energy(spark, root, years)
    curated, rejects = scope1.scope1(touched)
    zones.write_zone(curated, root, "curated", "ghg_scope1", replace=years)
    zones.write_rejects(rejects, root, "ghg_scope1", years)
    zones.write_zone(scope2.scope2(touched, facilities), root, "curated", "ghg_scope2", replace=years)


def on_batch(batch: DataFrame, batch_id: int, root: str, facilities: DataFrame | None = None) -> None:
    """One micro-batch; a replay writes the same partitions again and changes nothing."""
    spark = batch.sparkSession
    zones.land(batch.withColumn("batch_id", F.lit(batch_id).cast("long")), root, "raw", "energy_consumption", RAW_PARTITIONS)
    # the years of one batch: bounded by the calendar
    years = sorted(r[0] for r in batch.where("reporting_year IS NOT NULL").select("reporting_year").distinct().collect())
    if years:
        refresh_years(spark, root, years, facilities)


def start(spark: SparkSession, landing: str, root: str, facilities: DataFrame | None = None,
          checkpoint: str | None = None, available_now: bool = True):
    """Start the refresh stream: landing parquet files -> raw zone -> affected curated years."""
    ckpt = checkpoint or f"{shared_dir(spark).rstrip('/')}/streams/energy_refresh"
    src = spark.readStream.schema(ENERGY_SCHEMA).parquet(landing)
    w = src.writeStream.foreachBatch(lambda b, i: on_batch(b, i, root, facilities)).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
