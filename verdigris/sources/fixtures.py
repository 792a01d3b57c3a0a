"""Test inputs derived from the driver's parquet tables.

The three raw tables of the data model (facility energy, loan book, HR) are
not shipped with test data; they are derived from the TPC-H-like tables by
the SELECTs below (see FIXTURES.md). The same text runs in Spark SQL and in
DuckDB, so the oracle and the Spark job start from identical rows. On Spark
the raw tables are passed as DataFrame arguments, never as global views.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C

def padded(number: str, digits: int) -> str:
    """SQL text of a number in at least ``digits`` digits; longer numbers keep all of theirs."""
    s = f"CAST({number} AS STRING)"
    return f"lpad({s}, CAST(greatest({digits}, length({s})) AS INT), '0')"


ENERGY_SQL = f"""
WITH g AS (
  SELECT CAST(l_suppkey AS BIGINT) AS k,
         CAST(year(l_shipdate) AS INT) AS reporting_year,
         CAST(month(l_shipdate) AS INT) AS reporting_month,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS p,
         CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q
  FROM {{lineitem}} GROUP BY 1, 2, 3
), e AS (
  SELECT g.*, k % 10 AS t,
         CASE WHEN (k*31 + reporting_month*7 + reporting_year) % 53 = 0 THEN NULL ELSE p / 10 END AS kwh
  FROM g
)
SELECT concat('FAC-', {padded('k + 1', 4)}) AS facility_id,
       kwh AS electricity_kwh,
       CASE WHEN t IN (0,1,2,3,4,8) THEN NULL
            WHEN t = 5 THEN CASE WHEN reporting_month = 1 THEN q / 4 ELSE NULL END
            WHEN (k*13 + reporting_month*5 + reporting_year) % 11 = 0 THEN NULL
            ELSE q / 4 END AS natural_gas_gj,
       CASE WHEN t <= 5 THEN NULL
            WHEN (k*17 + reporting_month*3 + reporting_year) % 13 = 0 THEN NULL
            ELSE q * 10 END AS diesel_liters,
       CASE WHEN t IN (8,9) THEN coalesce(kwh, 0e0) * ((reporting_month % 4) + 1) * 5e-5 ELSE 0e0 END AS srec_mwh_claimed,
       CASE WHEN (k + reporting_month + reporting_year) % 20 < 17 THEN 7.886e-1
            WHEN (k + reporting_month + reporting_year) % 20 < 19 THEN 8.012e-1 ELSE 7.95e-1 END AS grid_ef_kgco2_kwh,
       CASE WHEN (k + reporting_month + reporting_year) % 20 < 17 THEN 'PLN_Grid_Average_2023'
            WHEN (k + reporting_month + reporting_year) % 20 < 19 THEN 'DEFRA_2025' ELSE 'IPCC_AR6_CH4_GWP100' END AS ef_source,
       CASE WHEN (k + reporting_month) % 7 = 0 THEN NULL
            WHEN (k + reporting_month) % 41 = 0 THEN kwh * 1.02e0
            ELSE kwh * (1e0 + ((k + reporting_month) % 9 - 4) * 1e-3) END AS meter_reading_kwh,
       CASE WHEN (k + reporting_month) % 7 = 0 THEN 'estimate'
            WHEN (k + reporting_month) % 3 = 0 THEN 'manual_entry' ELSE 'smart_meter_api' END AS data_source,
       CASE WHEN kwh IS NULL THEN 'missing_primary'
            WHEN (k*7 + reporting_month*3 + reporting_year) % 50 = 0 THEN 'excluded' ELSE 'complete' END AS record_status,
       reporting_year, reporting_month
FROM e
"""

LOANS_SQL = f"""
WITH o AS (
  SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey AS BIGINT) AS c,
         CAST(year(o_orderdate) AS INT) AS reporting_year,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 1000000 AS BIGINT) AS outstanding_idr
  FROM {{orders}}
), v AS (
  SELECT o.*,
         CASE WHEN k % 211 = 0 THEN CAST(0 AS BIGINT) ELSE ((k*7919) % 100 + 1) * 10000000000 END AS total_equity_idr,
         CASE WHEN k % 211 = 0 THEN CAST(0 AS BIGINT) ELSE ((k*104729) % 80) * 10000000000 END AS total_debt_idr
  FROM o
)
SELECT concat('LN-', CAST(reporting_year AS STRING), '-', {padded('k', 7)}) AS loan_id,
       concat('BOR-', {padded('c', 6)}) AS borrower_id,
       CASE c % 10 WHEN 0 THEN 'manufacturing_cement' WHEN 1 THEN 'manufacturing_steel' WHEN 2 THEN 'manufacturing_food'
            WHEN 3 THEN 'real_estate_commercial' WHEN 4 THEN 'real_estate_residential' WHEN 5 THEN 'transportation_road'
            WHEN 6 THEN 'agriculture' WHEN 7 THEN 'energy_oil_gas' WHEN 8 THEN 'financial_services' ELSE 'retail_trade' END AS sector_nace,
       CASE k % 6 WHEN 0 THEN 'term_loan' WHEN 1 THEN 'revolving_credit' WHEN 2 THEN 'mortgage'
            WHEN 3 THEN 'project_finance' WHEN 4 THEN 'syndicated_loan' ELSE 'leasing' END AS loan_type,
       CASE WHEN k % 5 = 0 THEN 'USD' ELSE 'IDR' END AS currency,
       outstanding_idr, total_equity_idr, total_debt_idr,
       CASE WHEN total_equity_idr + total_debt_idr > 0
            THEN CAST(outstanding_idr AS DOUBLE) / CAST(total_equity_idr + total_debt_idr AS DOUBLE) END AS pcaf_attribution_factor,
       CASE WHEN k % 499 = 0 THEN NULL WHEN k % 197 = 0 THEN 0e0
            ELSE 5e2 + ((c*37) % 5000) * (1 + c % 10) * 1e1 END AS borrower_emissions_tco2e,
       CASE WHEN (k*31) % 200 < 7 THEN 1e0 WHEN (k*31) % 200 < 10 THEN 1.5e0 WHEN (k*31) % 200 < 40 THEN 2e0
            WHEN (k*31) % 200 < 100 THEN 3e0 WHEN (k*31) % 200 < 170 THEN 4e0 ELSE 5e0 END AS pcaf_data_quality_score,
       CASE WHEN (k*17) % 100 < 88 THEN 'validated' WHEN (k*17) % 100 < 96 THEN 'pending' ELSE 'rejected' END AS record_status,
       reporting_year
FROM v
"""

HR_SQL = """
WITH y AS (
  SELECT CAST(year(o_orderdate) AS INT) AS reporting_year, COUNT(DISTINCT o_custkey) AS n, COUNT(*) AS m
  FROM {orders} GROUP BY 1
)
SELECT make_date(reporting_year, 12, 31) AS period_date,
       CAST(5000 + n AS INT) AS fte_total,
       4e1 + (reporting_year % 7) * 1.5e0 AS fte_female_pct,
       2.5e1 + (reporting_year % 5) * 2e0 AS fte_management_female_pct,
       CAST(250 + m % 400 AS INT) AS new_hire_count,
       8e0 + (reporting_year % 6) * 1.25e0 AS voluntary_turnover_pct,
       3e1 + (reporting_year % 4) * 7.5e0 AS training_hours_per_fte,
       CAST(reporting_year % 4 AS INT) AS discrimination_cases,
       reporting_year
FROM y
"""

# Small dimensions over the fixture's facilities (suppliers), as SQL so the
# oracle uses the same definition. They grow with the supplier table, so they
# are joined without a broadcast hint (AQE decides from the real size).
FACILITY_DIM_SQL = f"""
SELECT concat('FAC-', {padded('CAST(s_suppkey AS BIGINT) + 1', 4)}) AS facility_id,
       CASE CAST(s_suppkey AS BIGINT) % 6 WHEN 0 THEN 'java_bali' WHEN 1 THEN 'sumatra' WHEN 2 THEN 'kalimantan'
            WHEN 3 THEN 'sulawesi' WHEN 4 THEN 'national' END AS grid_region,
       CASE WHEN CAST(s_suppkey AS BIGINT) % 10 <= 5 THEN 'branch'
            WHEN CAST(s_suppkey AS BIGINT) % 10 <= 7 THEN 'regional_office'
            WHEN CAST(s_suppkey AS BIGINT) % 10 = 8 THEN 'data_centre' ELSE 'headquarters' END AS facility_type
FROM {{supplier}}
"""

BORROWER_DIM_SQL = f"""
SELECT concat('BOR-', {padded('CAST(c_custkey AS BIGINT)', 6)}) AS borrower_id,
       c_mktsegment AS borrower_segment
FROM {{customer}}
"""

# Input tables that a bank keeps by hand, derived so that they grow with the given ones: governance facts, peer
# figures, the playbook's rules, reported borrower emissions, power purchase agreements.
GOVERNANCE_SQL = """
SELECT CAST(year(o_orderdate) AS INT) AS reporting_year, COUNT(*) % 2 = 0 AS has_esg_committee, COUNT(*) % 3 > 0 AS has_climate_policy,
       CASE COUNT(DISTINCT o_custkey) % 3 WHEN 0 THEN 'Committed' WHEN 1 THEN 'Submitted' ELSE 'None' END AS sbti_status
FROM {orders} GROUP BY 1
"""

_PEER_METRICS = [("training_hours_per_fte", "true", "2e1", "2.5e0"), ("fte_female_pct", "true", "3e1", "1.5e0"),
                 ("fte_management_female_pct", "true", "1.5e1", "1.25e0"), ("voluntary_turnover_pct", "false", "4e0", "5e-1"),
                 ("scope1_tco2e", "false", "1e2", "4e1"), ("scope2_location_tco2e", "false", "1e3", "2.5e2")]
PEERS_SQL = "\nUNION ALL\n".join(f"""
SELECT concat('bank_', CAST(n.n_nationkey AS STRING)) AS peer, '{metric}' AS metric, {higher} AS higher_is_better,
       CAST({base} + {step} * (COUNT(c.c_custkey) % 17) AS DOUBLE) AS pvalue
FROM {{nation}} n LEFT JOIN {{customer}} c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_nationkey""" for metric, higher, base, step in _PEER_METRICS)

PLAYBOOK_SQL = """
SELECT concat('PB-', CAST(n_nationkey AS STRING)) AS rule_id,
       CASE n_nationkey % 6 WHEN 0 THEN 'scope1_tco2e' WHEN 1 THEN 'scope2_location_tco2e' WHEN 2 THEN 'scope3_cat15_gross_tco2e'
            WHEN 3 THEN 'training_hours_per_fte' WHEN 4 THEN 'fte_management_female_pct' ELSE 'voluntary_turnover_pct' END AS metric,
       CASE CAST(floor(n_nationkey / 6) AS INT) % 3 WHEN 0 THEN 'change' WHEN 1 THEN 'value' ELSE 'gap' END AS basis,
       CASE WHEN n_nationkey % 2 = 0 THEN '>' ELSE '<' END AS op,
       CAST(n_nationkey % 5 * 10 - 10 AS DOUBLE) AS threshold,
       concat('review ', lower(n_name)) AS action
FROM {nation}
"""

EMISSIONS_SQL = f"""
SELECT concat('BOR-', {padded('CAST(o_custkey AS BIGINT)', 6)}) AS borrower_id, CAST(year(o_orderdate) AS INT) AS reporting_year,
       CASE WHEN COUNT(*) % 11 = 0 THEN NULL ELSE CAST(400 + (o_custkey * 53) % 7000 + COUNT(*) AS DOUBLE) END AS reported_emissions_tco2e
FROM {{orders}} WHERE o_custkey % 17 <> 0 GROUP BY o_custkey, year(o_orderdate)
"""

PPA_SQL = f"""
SELECT DISTINCT concat('FAC-', {padded('CAST(l_suppkey AS BIGINT) + 1', 4)}) AS facility_id, CAST(year(l_shipdate) AS INT) AS reporting_year,
       CAST(((l_suppkey * 7 + year(l_shipdate)) % 5) * 25 AS DOUBLE) AS ppa_mwh
FROM {{lineitem}} WHERE l_suppkey % 3 = 0
"""

# Fleet and gas-bottle activity as logged: one row per event of three kinds.
ACTIVITY_SQL = """
SELECT CAST(1995 + event_id % 6 AS INT) AS reporting_year,
       CASE event_type WHEN 'view' THEN 'diesel_fleet' WHEN 'click' THEN 'petrol_fleet' ELSE 'lpg' END AS source_type,
       CASE WHEN event_id % 4 = 0 THEN 'smart_meter_api' WHEN event_id % 4 = 1 THEN 'estimate' ELSE 'manual_entry' END AS data_source,
       value AS quantity
FROM {events} WHERE event_type IN ('view', 'click', 'error')
"""

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
              "events", "documents", "embeddings", "pages", "benchmark", "labels",
              "conversations")


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@dataclass
class Inputs:
    """Lazily built input DataFrames for one scale-factor folder."""

    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return read_raw(self.spark, self.sf_dir, name)

    @cached_property
    def energy(self) -> DataFrame:
        return self.spark.sql(ENERGY_SQL, lineitem=self.raw("lineitem"))

    @cached_property
    def loans(self) -> DataFrame:
        return self.spark.sql(LOANS_SQL, orders=self.raw("orders"))

    @cached_property
    def hr(self) -> DataFrame:
        return self.spark.sql(HR_SQL, orders=self.raw("orders"))

    @cached_property
    def facilities(self) -> DataFrame:
        return self.spark.sql(FACILITY_DIM_SQL, supplier=self.raw("supplier"))

    @cached_property
    def borrowers(self) -> DataFrame:
        return self.spark.sql(BORROWER_DIM_SQL, customer=self.raw("customer"))

    def _table(self, sql: str) -> DataFrame:
        named = {t: self.raw(t) for t in RAW_TABLES if "{" + t + "}" in sql}
        return self.spark.sql(sql, **named)

    @cached_property
    def governance(self) -> DataFrame:
        return self._table(GOVERNANCE_SQL)

    @cached_property
    def activity(self) -> DataFrame:
        return self._table(ACTIVITY_SQL)

    @cached_property
    def peers(self) -> DataFrame:
        return self._table(PEERS_SQL)

    @cached_property
    def playbook(self) -> DataFrame:
        return self._table(PLAYBOOK_SQL)

    @cached_property
    def reported_emissions(self) -> DataFrame:
        return self._table(EMISSIONS_SQL)

    @cached_property
    def ppa(self) -> DataFrame:
        return self._table(PPA_SQL)

    # -- fixed-size dimensions (row count bounded by the constants) ----------
    @cached_property
    def revenue(self) -> DataFrame:
        years = range(C.REVENUE_FIRST_YEAR, C.REVENUE_LAST_YEAR + 1)
        rows = [(y, C.REVENUE_BASE_IDR_BN + C.REVENUE_STEP_IDR_BN * (y - C.REVENUE_FIRST_YEAR))
                for y in years]
        return self.spark.createDataFrame(rows, "reporting_year int, revenue_idr_bn double")

    @cached_property
    def grid_ef(self) -> DataFrame:
        return self.spark.createDataFrame(list(C.GRID_EF.items()), "grid_region string, grid_ef double")

    @cached_property
    def pcaf_confidence(self) -> DataFrame:
        return self.spark.createDataFrame(list(C.PCAF_CONFIDENCE.items()), "score double, factor double")

    @cached_property
    def sector_display(self) -> DataFrame:
        return self.spark.createDataFrame(list(C.SECTOR_DISPLAY.items()),
                                          "sector_nace string, sector_display_name string")


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    return Inputs(spark, sf_dir)


def dim_values_sql(name: str) -> str:
    """The fixed dimensions as a VALUES list, for the oracle."""
    if name == "revenue":
        rows = [f"({y}, {C.REVENUE_BASE_IDR_BN + C.REVENUE_STEP_IDR_BN * (y - C.REVENUE_FIRST_YEAR)!r})"
                for y in range(C.REVENUE_FIRST_YEAR, C.REVENUE_LAST_YEAR + 1)]
        return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(reporting_year, revenue_idr_bn)"
    if name == "grid_ef":
        rows = [f"('{k}', {v!r})" for k, v in C.GRID_EF.items()]
        return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(grid_region, grid_ef)"
    if name == "sector_display":
        rows = [f"('{k}', '{v}')" for k, v in C.SECTOR_DISPLAY.items()]
        return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(sector_nace, sector_display_name)"
    if name == "pcaf_confidence":
        rows = [f"({k!r}, {v!r})" for k, v in C.PCAF_CONFIDENCE.items()]
        return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(score, factor)"
    raise KeyError(name)


def _oracle_text(sql: str) -> str:
    for t in RAW_TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


ORACLE_INPUT_CTES = {
    "energy_consumption": _oracle_text(ENERGY_SQL),
    "loan_portfolio": _oracle_text(LOANS_SQL),
    "hr_metrics": _oracle_text(HR_SQL),
    "facility_dim": _oracle_text(FACILITY_DIM_SQL),
    "borrower_dim": _oracle_text(BORROWER_DIM_SQL),
    "governance": _oracle_text(GOVERNANCE_SQL),
    "activity": _oracle_text(ACTIVITY_SQL),
    "peers": _oracle_text(PEERS_SQL),
    "playbook": _oracle_text(PLAYBOOK_SQL),
    "reported_emissions": _oracle_text(EMISSIONS_SQL),
    "ppa": _oracle_text(PPA_SQL),
}
