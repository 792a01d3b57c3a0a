"""Registered queries of sources and sinks: each writes a table of the zones, reads it back and aggregates it.

Every run has zones of its own in the shared folder, so runs over one input don't
meet. The folder is scratch space, to be cleared after a job.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.exprs import dround
from ..operators import gates, scope1
from ..session import shared_dir
from ..sources import ddl, zones
from ..sources.fixtures import inputs
from . import batch
from .catalog_core import core
from .sqltext import R, with_ctes


def zone_root(spark: SparkSession, sf_dir: str) -> str:
    """A folder of this call's own."""
    return f"{shared_dir(spark).rstrip('/')}/zones/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}-{uuid.uuid4().hex}"


def q_zone_two_levels(spark: SparkSession, d: str) -> DataFrame:
    """SRC-01 / SRC-05: energy by year and month."""
    root = zone_root(spark, d)
    zones.write_zone(inputs(spark, d).energy, root, "raw", "energy_consumption", None, ("reporting_year", "reporting_month"), "table")
    e = zones.read_zone(spark, root, "raw", "energy_consumption")
    return e.groupBy("reporting_year", "reporting_month").agg(F.count(F.lit(1)).alias("rows"), dround(F.sum("electricity_kwh"), 4).alias("kwh"),
                                                              F.min("facility_id").alias("first_facility"))


def q_zone_one_level(spark: SparkSession, d: str) -> DataFrame:
    """SRC-02 / SRC-05: loans by year; one year is written twice and replaced, not doubled."""
    root, loans = zone_root(spark, d), inputs(spark, d).loans
    zones.write_zone(loans, root, "raw", "loan_portfolio", replace="table")
    zones.write_zone(loans.where(F.col("reporting_year") == C.BASE_YEAR), root, "raw", "loan_portfolio")
    return zones.read_zone(spark, root, "raw", "loan_portfolio").groupBy("reporting_year").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("outstanding_idr").cast("decimal(38,0)")).cast("string").alias("outstanding"))


def q_zone_by_name(spark: SparkSession, d: str) -> DataFrame:
    """SRC-03 / SRC-04: tables are created over the zones, read by name, and dropped; their data stay."""
    root = zone_root(spark, d)
    zones.write_zone(core(spark, d).summary(), root, "aggregated", "ghg_summary_annual", replace="table")
    with ddl.Catalog(spark, root) as catalog:   # what the names gave is kept, as they are gone when the result is read
        catalog.create({"ghg_summary_annual"})
        ddl.summary_by_name(catalog, C.CURRENT_YEAR, C.BANK_ID).write.parquet(f"{root}/by_name")
    return spark.read.parquet(f"{root}/by_name")


def q_zone_rejects(spark: SparkSession, d: str) -> DataFrame:
    """SRC-08: rejects by year and reason."""
    root = zone_root(spark, d)
    rejects = scope1.scope1(inputs(spark, d).energy)[1]
    zones.write_rejects(rejects, root, "ghg_scope1", "table")
    return zones.read_rejects(spark, root, "ghg_scope1", rejects.schema).groupBy("reporting_year", "reject_reason").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("imputed_months").cast("bigint").alias("imputed_months"))


def q_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """SRC-09: workforce rows through CSV with an explicit schema."""
    hr = inputs(spark, d).hr
    return zones.read_csv(spark, zones.write_sample_csv(hr, f"{zone_root(spark, d)}/csv/hr_metrics"), hr.schema)


def q_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """SRC-10: workforce rows through a JSON bundle."""
    hr = inputs(spark, d).hr
    return zones.read_bundle_json(spark, zones.write_bundle_json(hr, f"{zone_root(spark, d)}/json/hr_metrics"), hr.schema)


def q_run_summaries(spark: SparkSession, d: str) -> DataFrame:
    """GOV-16: the run summary of every output."""
    c, out = core(spark, d), None
    for table, df in (("ghg_scope1", c.s1), ("ghg_scope2", c.s2), ("ghg_scope3_financed", c.s3), ("ghg_summary_annual", c.summary())):
        measures = next(m for _, t, m in batch.RUN_MEASURES if t == table)
        part = gates.run_summary(df, measures).select(F.lit(table).alias("table_name"), "rows", "measure", "total", "mean", "maximum")
        out = part if out is None else out.unionByName(part)
    return out


def q_null_months(spark: SparkSession, d: str) -> DataFrame:
    """GOV-13: facility-years with more than six months without electricity."""
    return gates.null_month_gate(inputs(spark, d).energy)


def q_observed_rows(spark: SparkSession, d: str) -> DataFrame:
    """GOV-14: rows observed while each curated table was written, and rows read back."""
    c, out, found = core(spark, d), batch._Writer(spark, zone_root(spark, d)), None
    for table, df in (("ghg_scope1", c.s1), ("ghg_scope2", c.s2), ("ghg_scope3_financed", c.s3)):
        back = out.write(df, "curated", table).agg(F.lit(table).alias("table_name"), F.count(F.lit(1)).alias("rows_read"))
        back = back.withColumn("rows_written", F.lit(out.rows[table]).cast("long"))
        found = back if found is None else found.unionByName(back)
    return found.withColumn("equal", F.col("rows_read") == F.col("rows_written"))


def queries() -> dict:
    return {"zone_two_levels": q_zone_two_levels, "zone_one_level": q_zone_one_level, "zone_by_name": q_zone_by_name,
            "zone_rejects": q_zone_rejects, "csv_round_trip": q_csv_round_trip, "json_round_trip": q_json_round_trip,
            "run_summaries": q_run_summaries, "observed_rows": q_observed_rows, "gate_null_months": q_null_months}


def _row_text(columns: dict[str, str]) -> str:
    """The canonical text of a row; ``columns``: name -> kind."""
    one = {"double": "CAST(CAST(CAST({c} AS VARCHAR) AS DECIMAL(38,6)) AS VARCHAR)"}
    return " || '|' || ".join(f"coalesce({one.get(kind, 'CAST({c} AS VARCHAR)').format(c=c)}, '~')" for c, kind in columns.items())


def _fingerprint(table: str, columns: dict[str, str]) -> str:
    return (f"SELECT '{table}' AS table_name, COUNT(*) AS rows, sha256(CAST(coalesce(SUM(h), 0) AS VARCHAR)) AS fingerprint, "
            f"CAST(SUM(h) AS VARCHAR) AS hash_sum FROM (SELECT CAST(CAST('0x' || substr(sha256({_row_text(columns)}), 1, 15) AS BIGINT) AS HUGEINT) AS h "
            f"FROM {table}) x")


#: Columns in the tables' own order.
_FINGERPRINTED = {
    "energy_consumption": ["facility_id", "electricity_kwh", "natural_gas_gj", "diesel_liters", "srec_mwh_claimed", "grid_ef_kgco2_kwh", "ef_source",
                           "meter_reading_kwh", "data_source", "record_status", "reporting_year", "reporting_month"],
    "loan_portfolio": ["loan_id", "borrower_id", "sector_nace", "loan_type", "currency", "outstanding_idr", "total_equity_idr", "total_debt_idr",
                       "pcaf_attribution_factor", "borrower_emissions_tco2e", "pcaf_data_quality_score", "record_status", "reporting_year"],
    "hr_metrics": ["period_date", "fte_total", "fte_female_pct", "fte_management_female_pct", "new_hire_count", "voluntary_turnover_pct",
                   "training_hours_per_fte", "discrimination_cases", "reporting_year"],
}


def _schema_sql(table: str, contract: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{table}' AS table_name, '{c}' AS column_name, 'ok' AS kind, 'none' AS severity, '{t}' AS expected_type, "
                              f"'{t}' AS actual_type, COUNT(*) AS rows, COUNT(*) - COUNT({c}) AS nulls FROM {table}" for c, t in contract.items())


def oracles() -> dict[str, str]:
    contracts = {"energy_consumption": gates.ENERGY_CONTRACT, "loan_portfolio": gates.LOAN_CONTRACT, "hr_metrics": gates.HR_CONTRACT}
    q = {}
    q["zone_two_levels"] = with_ctes(f"SELECT reporting_year, reporting_month, COUNT(*) AS rows, {R('SUM(electricity_kwh)', 4)} AS kwh, "
                                     "MIN(facility_id) AS first_facility FROM energy_consumption GROUP BY 1, 2", ["energy_consumption"])
    q["zone_one_level"] = with_ctes("SELECT reporting_year, COUNT(*) AS rows, CAST(SUM(CAST(outstanding_idr AS HUGEINT)) AS VARCHAR) AS outstanding "
                                    "FROM loan_portfolio GROUP BY 1", ["loan_portfolio"])
    q["zone_by_name"] = with_ctes(f"""
SELECT metric_key, scope1_tco2e, scope2_location_tco2e, scope2_market_tco2e, scope3_cat15_gross_tco2e, yoy_change_pct
FROM ghg_summary_annual WHERE reporting_year = {C.CURRENT_YEAR} AND starts_with(metric_key, '{C.BANK_ID}_')""", ["ghg_summary_annual"])
    q["zone_rejects"] = with_ctes("""
SELECT reporting_year, 'imputed_months_gt_5' AS reject_reason, COUNT(*) AS rows, CAST(SUM(imputed_months) AS BIGINT) AS imputed_months
FROM s1_annual WHERE data_quality_score = 4 GROUP BY 1""", ["s1_annual"])
    q["csv_round_trip"] = q["json_round_trip"] = with_ctes("SELECT * FROM hr_metrics", ["hr_metrics"])
    names = {"ghg_scope3_financed": "ghg_scope3"}
    parts = [f"SELECT '{t}' AS table_name, COUNT(*) AS rows, '{m}' AS measure, {R(f'SUM({m})', 4)} AS total, {R(f'AVG({m})', 6)} AS mean, "
             f"MAX({m}) AS maximum FROM {names.get(t, t)}" for _, t, measures in batch.RUN_MEASURES for m in measures]
    q["run_summaries"] = with_ctes(" UNION ALL ".join(parts), ["ghg_scope1", "ghg_scope2", "ghg_scope3", "ghg_summary_annual"])
    q["observed_rows"] = with_ctes(" UNION ALL ".join(
        f"SELECT '{t}' AS table_name, COUNT(*) AS rows_read, COUNT(*) AS rows_written, true AS equal FROM {names.get(t, t)}"
        for t in ("ghg_scope1", "ghg_scope2", "ghg_scope3_financed")), ["ghg_scope1", "ghg_scope2", "ghg_scope3"])
    q["gate_null_months"] = with_ctes("""
SELECT facility_id, reporting_year, COUNT(*) FILTER (WHERE electricity_kwh IS NULL) AS null_months
FROM energy_consumption GROUP BY 1, 2 HAVING COUNT(*) FILTER (WHERE electricity_kwh IS NULL) > 6""", ["energy_consumption"])
    q["table_fingerprint"] = with_ctes(" UNION ALL ".join(
        _fingerprint(t, {c: contracts[t][c] for c in columns}) for t, columns in _FINGERPRINTED.items()), list(contracts))
    q["schema_check"] = with_ctes(" UNION ALL ".join(_schema_sql(t, c) for t, c in contracts.items()), list(contracts))
    return q
