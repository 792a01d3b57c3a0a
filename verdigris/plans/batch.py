"""The yearly refresh as Spark jobs: raw -> curated -> aggregated (+ gates).

Each stage writes its tables into the zone root (a shared folder; by default
under ``spark.checkpoint.dir``) and the next stage reads them back, so a lost
executor only re-runs the stage it belonged to and lineage stays short. What
two sinks share (facility-years, checked loans) is a table of its own, written
once; nothing is kept on executors' disks.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import aggregate, gates, retrieval, scope1, scope2, scope3
from ..session import shared_dir
from ..sources import zones
from ..sources.fixtures import Inputs


class _Writer:
    """Writes zone tables whole and notes their paths and rows (GOV-14, observed during the write)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.paths, self.rows = spark, root, {}, {}

    def write(self, df: DataFrame, zone: str, table: str, name: str | None = None, columns=None,
              partition_by: tuple[str, ...] = ("reporting_year",)) -> DataFrame:
        seen = Observation()
        name = name or table
        self.paths[name] = zones.write_zone(df.observe(seen, F.count(F.lit(1)).alias("rows")), self.root, zone, table, columns,
                                            partition_by, "table")
        self.rows[name] = seen.get["rows"]
        return zones.read_zone(self.spark, self.root, zone, table, None if self.rows[name] else df.schema)

    def rejects(self, df: DataFrame, table: str) -> None:
        self.write(df, "curated", f"errors/{table}", f"{table}_rejects", partition_by=zones.REJECT_PARTITIONS)


def curated_stage(inp: Inputs, out: _Writer, impute_by: str = "month", rec_mode: str = "spec") -> None:
    """Curated tables from one read of each raw table."""
    energy = out.write(inp.energy, "raw", "energy_consumption", partition_by=("reporting_year", "reporting_month"))
    years = out.write(scope1.facility_years(energy, impute_by, inp.facilities), "curated", "scope1_facility_years")
    curated, rejects = scope1.split(years)
    out.write(curated, "curated", "ghg_scope1")
    out.rejects(rejects, "ghg_scope1")
    out.write(scope2.scope2(energy, inp.facilities, rec_mode), "curated", "ghg_scope2")
    loans = out.write(inp.loans, "raw", "loan_portfolio")
    loan, rejects = scope3.loan_emissions(loans)
    loan = out.write(loan, "curated", "loan_financed")
    out.rejects(rejects, "ghg_scope3")
    out.write(scope3.sector_rollup(loan), "curated", "ghg_scope3_financed")


def aggregated_stage(inp: Inputs, out: _Writer, bank_id: str = C.BANK_ID, base_year: int = C.BASE_YEAR) -> None:
    s1, s2, s3 = (zones.read_zone(inp.spark, out.root, "curated", t) for t in ("ghg_scope1", "ghg_scope2", "ghg_scope3_financed"))
    loans = zones.read_zone(inp.spark, out.root, "raw", "loan_portfolio")
    summary = aggregate.annual_summary(s1, s2, s3, inp.hr, loans, inp.revenue, bank_id, base_year)
    out.write(summary, "aggregated", "ghg_summary_annual")
    out.write(aggregate.sector_table(s3, inp.sector_display), "aggregated", "pcaf_by_sector")
    out.write(scope1.top_facilities(s1, 10), "aggregated", "scope1_by_facility")


def run_summaries(spark: SparkSession, root: str) -> DataFrame:
    """GOV-16: count, sum, mean, max of the measures of every curated and aggregated table."""
    out = None
    for zone, table, measures in RUN_MEASURES:
        t = zones.read_zone(spark, root, zone, table)
        part = gates.run_summary(t, measures).withColumn("table_name", F.lit(table))
        out = part if out is None else out.unionByName(part)
    return out.select("table_name", "rows", "measure", "total", "mean", "maximum")


RUN_MEASURES = [
    ("curated", "ghg_scope1", ["scope1_tco2e", "scope1_natgas_tco2e", "scope1_diesel_tco2e"]),
    ("curated", "ghg_scope2", ["scope2_location_tco2e", "scope2_market_tco2e"]),
    ("curated", "ghg_scope3_financed", ["financed_emissions_gross_tco2e", "financed_emissions_weighted_tco2e"]),
    ("aggregated", "ghg_summary_annual", ["scope1_tco2e", "scope2_market_tco2e", "scope3_cat15_gross_tco2e"]),
]


def gate_stage(inp: Inputs, root: str) -> DataFrame:
    spark = inp.spark
    s1 = zones.read_zone(spark, root, "curated", "ghg_scope1")
    s2 = zones.read_zone(spark, root, "curated", "ghg_scope2")
    s3 = zones.read_zone(spark, root, "curated", "ghg_scope3_financed")
    energy = zones.read_zone(spark, root, "raw", "energy_consumption")
    return (gates.scope1_gates(s1, energy)
            .unionByName(gates.scope2_gates(s2, energy))
            .unionByName(gates.scope3_gates(s3)))


def refresh(spark: SparkSession, sf_dir: str, root: str | None = None, index_documents: bool = False) -> dict[str, object]:
    """Run the whole refresh; returns table paths, rows written, and stage seconds.

    ``index_documents`` also writes the retrieval index of the documents anew.
    """
    root = root or f"{shared_dir(spark).rstrip('/')}/lake"
    inp, out = Inputs(spark, sf_dir), _Writer(spark, root)
    t0 = time.time()
    curated_stage(inp, out)
    t1 = time.time()
    aggregated_stage(inp, out)
    t2 = time.time()
    zones.write_zone(gate_stage(inp, root).withColumn("run_date", F.current_date()), root, "aggregated", "gate_results",
                     None, ("run_date",))
    t3 = time.time()
    seconds = {"curated": t1 - t0, "aggregated": t2 - t1, "gates": t3 - t2}
    if index_documents:
        docs = inp.raw("documents")
        out.paths["bm25_index"] = retrieval.index_path(docs)
        retrieval.write_index(docs, out.paths["bm25_index"])
        seconds["index"] = time.time() - t3
    return {"root": root, "paths": out.paths, "observed": out.rows, "seconds": seconds}
