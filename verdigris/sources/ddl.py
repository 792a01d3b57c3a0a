"""Zone databases and external tables (SRC-03 / SRC-04).

Three databases (raw, curated, aggregated) with parquet tables partitioned by
INT columns kept in the path; column comments carry units and rules, as the
original DDL does. Tables point at the zone folders written by
``sources.zones``, their partitions at the folders of the newest version.

The names belong to one ``Catalog``: its databases carry a token that no other
session or root has, are made by it alone (never taken over), and only what it
made is dropped. Queries get table names through ``IDENTIFIER(:name)``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import snapshots, zones

DATABASES = {"raw": "esg_raw", "curated": "esg_curated", "aggregated": "esg_aggregated"}

# (zone, table, columns "name type COMMENT '...'" , partition columns)
TABLES = [
    ("raw", "energy_consumption", [
        ("facility_id", "STRING", "FAC-NNNN"), ("electricity_kwh", "DOUBLE", "kWh per month, nullable"),
        ("natural_gas_gj", "DOUBLE", "GJ per month, nullable"), ("diesel_liters", "DOUBLE", "litres per month"),
        ("srec_mwh_claimed", "DOUBLE", "REC MWh claimed"), ("grid_ef_kgco2_kwh", "DOUBLE", "kgCO2/kWh"),
        ("ef_source", "STRING", "enum"), ("meter_reading_kwh", "DOUBLE", "kWh"),
        ("data_source", "STRING", "enum"), ("record_status", "STRING", "complete|missing_primary|excluded")],
     [("reporting_year", "INT"), ("reporting_month", "INT")]),
    ("raw", "loan_portfolio", [
        ("loan_id", "STRING", "LN-YYYY-NNNNNNN"), ("borrower_id", "STRING", "BOR-NNNNNN"),
        ("sector_nace", "STRING", "enum"), ("loan_type", "STRING", "enum"), ("currency", "STRING", "IDR|USD"),
        ("outstanding_idr", "BIGINT", "IDR"), ("total_equity_idr", "BIGINT", "IDR"), ("total_debt_idr", "BIGINT", "IDR"),
        ("pcaf_attribution_factor", "DOUBLE", "(0,1]"), ("borrower_emissions_tco2e", "DOUBLE", "tCO2e"),
        ("pcaf_data_quality_score", "DOUBLE", "1,1.5,2,3,4,5"), ("record_status", "STRING", "validated|pending|rejected")],
     [("reporting_year", "INT")]),
    ("raw", "hr_metrics", [
        ("period_date", "DATE", "YYYY-12-31"), ("fte_total", "INT", "FTE"), ("fte_female_pct", "DOUBLE", "%"),
        ("fte_management_female_pct", "DOUBLE", "%"), ("new_hire_count", "INT", ">= 0"),
        ("voluntary_turnover_pct", "DOUBLE", "%"), ("training_hours_per_fte", "DOUBLE", "hours"),
        ("discrimination_cases", "INT", ">= 0")],
     [("reporting_year", "INT")]),
    ("curated", "ghg_scope1", [
        ("facility_id", "STRING", ""), ("scope1_tco2e", "DOUBLE", "tCO2e, 4 dp"),
        ("scope1_natgas_tco2e", "DOUBLE", "tCO2e"), ("scope1_diesel_tco2e", "DOUBLE", "tCO2e"),
        ("total_natgas_gj", "DOUBLE", "GJ"), ("total_diesel_liters", "DOUBLE", "L"),
        ("imputed_months", "INT", "gas + diesel gap months"), ("data_quality_score", "INT", "1-3"),
        ("emission_factor_source", "STRING", ""), ("methodology", "STRING", ""),
        ("consolidation_approach", "STRING", "")],
     [("reporting_year", "INT")]),
    ("curated", "ghg_scope2", [
        ("facility_id", "STRING", ""), ("total_consumption_mwh", "DOUBLE", "MWh"),
        ("scope2_location_tco2e", "DOUBLE", "tCO2e"), ("scope2_market_tco2e", "DOUBLE", "tCO2e"),
        ("grid_region", "STRING", ""), ("grid_ef_applied", "DOUBLE", "kgCO2/kWh"),
        ("rec_mwh_applied", "DOUBLE", "MWh"), ("rec_applied_pct", "DOUBLE", "%"), ("has_ppa", "BOOLEAN", ""),
        ("data_quality_score", "INT", "1-4"), ("methodology", "STRING", "")],
     [("reporting_year", "INT")]),
    ("curated", "ghg_scope3_financed", [
        ("sector_nace", "STRING", ""), ("loan_count", "INT", ""), ("borrower_count", "INT", ""),
        ("total_outstanding_idr_trillion", "DOUBLE", "IDR tn"), ("financed_emissions_gross_tco2e", "DOUBLE", "tCO2e"),
        ("financed_emissions_weighted_tco2e", "DOUBLE", "tCO2e"), ("avg_pcaf_score", "DOUBLE", "1-5"),
        ("high_quality_data_pct", "DOUBLE", "%")],
     [("reporting_year", "INT")]),
    ("aggregated", "ghg_summary_annual", [
        ("metric_key", "STRING", "{bank}_{year}"), ("scope1_tco2e", "DOUBLE", ""), ("scope1_natgas_tco2e", "DOUBLE", ""),
        ("scope1_diesel_tco2e", "DOUBLE", ""), ("scope2_location_tco2e", "DOUBLE", ""),
        ("scope2_market_tco2e", "DOUBLE", ""), ("scope3_cat15_gross_tco2e", "DOUBLE", ""),
        ("scope3_cat15_weighted_tco2e", "DOUBLE", ""), ("intensity_tco2e_per_idr_bn", "DOUBLE", ""),
        ("intensity_tco2e_per_fte", "DOUBLE", ""), ("yoy_change_pct", "DOUBLE", "nullable"),
        ("vs_base_year_change_pct", "DOUBLE", "nullable"), ("avg_pcaf_data_quality", "DOUBLE", ""),
        ("assurance_level", "STRING", "")],
     [("reporting_year", "INT")]),
    ("aggregated", "pcaf_by_sector", [
        ("sector_nace", "STRING", ""), ("sector_display_name", "STRING", ""), ("loan_count", "INT", ""),
        ("borrower_count", "INT", ""), ("total_outstanding_idr_trillion", "DOUBLE", ""),
        ("financed_emissions_gross_tco2e", "DOUBLE", ""), ("financed_emissions_weighted_tco2e", "DOUBLE", ""),
        ("emission_intensity_per_idr_bn", "DOUBLE", ""), ("avg_pcaf_score", "DOUBLE", ""),
        ("pct_of_total_portfolio", "DOUBLE", ""), ("pct_of_total_financed_emissions", "DOUBLE", ""),
        ("yoy_change_emissions_pct", "DOUBLE", "")],
     [("reporting_year", "INT")]),
    ("aggregated", "scope1_by_facility", [
        ("rank", "INT", "1-10"), ("facility_id", "STRING", ""), ("scope1_tco2e", "DOUBLE", ""),
        ("scope1_natgas_tco2e", "DOUBLE", ""), ("scope1_diesel_tco2e", "DOUBLE", ""),
        ("total_natgas_gj", "DOUBLE", ""), ("total_diesel_liters", "DOUBLE", ""),
        ("data_quality_score", "INT", "")],
     [("reporting_year", "INT")]),
]


def _q(s: str) -> str:
    return s.replace("'", "\\'")


class Catalog:
    """The databases and tables of one root, under names of their own."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.token = spark, root, uuid.uuid4().hex[:16]
        self.databases: list[str] = []
        self.tables: list[str] = []

    def database(self, zone: str) -> str:
        return f"{DATABASES[zone]}_{self.token}"

    def name(self, zone: str, table: str) -> str:
        return f"{self.database(zone)}.{table}"

    def create(self, only: set[str] | None = None) -> list[str]:
        """CREATE DATABASE / CREATE TABLE ... USING parquet PARTITIONED BY ... LOCATION for every zone table, or those of ``only``."""
        for zone in DATABASES:
            self.spark.sql("CREATE DATABASE IDENTIFIER(:name)", args={"name": self.database(zone)})
            self.databases.append(self.database(zone))
        for zone, table, cols, parts in TABLES:
            if only is None or table in only:
                self._table(zone, table, cols, parts)
        return list(self.tables)

    def _table(self, zone: str, table: str, cols, parts) -> None:
        full, path = self.name(zone, table), zones.table_path(self.root, zone, table)
        body = ",\n  ".join(f"`{c}` {t} COMMENT '{_q(cm)}'" for c, t, cm in cols)
        pcols = ",\n  ".join(f"`{c}` {t}" for c, t in parts)
        self.spark.sql(f"""CREATE TABLE {full} (
  {body},
  {pcols})
USING parquet
PARTITIONED BY ({", ".join(c for c, _ in parts)})
LOCATION '{_q(path)}'""")
        self.tables.append(full)
        now = snapshots.newest(self.spark, path)
        if now is None:
            self.spark.sql(f"ALTER TABLE {full} RECOVER PARTITIONS")
            return
        for folder in now["partitions"]:   # as many as the calendar has
            values = dict(x.split("=", 1) for x in folder.split("/")[1:])
            spec = ", ".join(f"`{c}` = '{_q(values[c])}'" for c, _ in parts)
            self.spark.sql(f"ALTER TABLE {full} ADD PARTITION ({spec}) LOCATION '{_q(f'{path}/{folder}')}'")

    def drop(self) -> None:
        """Drop the tables that were created here (data stays: they are external) and the databases, which are empty then."""
        while self.tables:
            self.spark.sql("DROP TABLE IDENTIFIER(:name)", args={"name": self.tables.pop()})
        while self.databases:
            self.spark.sql("DROP DATABASE IDENTIFIER(:name) RESTRICT", args={"name": self.databases.pop()})

    def __enter__(self) -> "Catalog":
        return self

    def __exit__(self, *failure) -> None:
        self.drop()


def summary_by_name(catalog: Catalog, year: int, bank_id: str) -> DataFrame:
    """SRC-03 / SRV-01 through SQL by table name, with named parameters (no string formatting)."""
    return catalog.spark.sql(
        "SELECT metric_key, scope1_tco2e, scope2_location_tco2e, scope2_market_tco2e, scope3_cat15_gross_tco2e, "
        "yoy_change_pct FROM IDENTIFIER(:table) WHERE reporting_year = :year AND metric_key = :key",
        args={"table": catalog.name("aggregated", "ghg_summary_annual"), "year": year, "key": f"{bank_id}_{year}"})
