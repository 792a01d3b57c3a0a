"""Registered queries of the emission core: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.exprs import dround
from ..operators import aggregate, scope1, scope2, scope3
from ..sources import zones
from ..sources.fixtures import Inputs, inputs


#: Session setting that names a zone root: queries then read the tables that the batch refresh has written there.
ZONES = "spark.verdigris.zones"


def _first(kept: DataFrame | None, derived) -> DataFrame:
    return derived() if kept is None else kept


class Core:
    """The core tables of one input folder: derived from raw, or read from the zones that the session names."""

    def __init__(self, inp: Inputs):
        self.inp = inp
        self.root = inp.spark.conf.get(ZONES, None)

    def _zone(self, zone: str, table: str) -> DataFrame | None:
        return zones.read_zone(self.inp.spark, self.root, zone, table) if self.root else None

    @property
    def s1(self) -> DataFrame:
        return _first(self._zone("curated", "ghg_scope1"), lambda: scope1.scope1(self.inp.energy)[0])

    @property
    def s1_rejects(self) -> DataFrame:
        return _first(self._zone("curated", "errors/ghg_scope1"), lambda: scope1.scope1(self.inp.energy)[1])

    @property
    def s2(self) -> DataFrame:
        return _first(self._zone("curated", "ghg_scope2"), lambda: scope2.scope2(self.inp.energy, self.inp.facilities, "spec"))

    @property
    def loan(self) -> DataFrame:
        return _first(self._zone("curated", "loan_financed"), lambda: scope3.loan_emissions(self.inp.loans)[0])

    @property
    def s3(self) -> DataFrame:
        return _first(self._zone("curated", "ghg_scope3_financed"), lambda: scope3.sector_rollup(self.loan))

    def summary(self, keep_totals: bool | str = False) -> DataFrame:
        kept = None if keep_totals else self._zone("aggregated", "ghg_summary_annual")
        if kept is not None:
            return kept.select(*aggregate.SUMMARY_COLUMNS)
        loans = _first(self._zone("raw", "loan_portfolio"), lambda: self.inp.loans)
        return aggregate.annual_summary(self.s1, self.s2, self.s3, self.inp.hr, loans, self.inp.revenue, keep_totals=keep_totals)

    @property
    def sector(self) -> DataFrame:
        kept = self._zone("aggregated", "pcaf_by_sector")
        return aggregate.sector_table(self.s3, self.inp.sector_display) if kept is None else kept.select(*aggregate.SECTOR_COLUMNS)


def core(spark: SparkSession, sf_dir: str) -> Core:
    return Core(inputs(spark, sf_dir))


def q_energy_clean(spark, d):
    return scope1.complete_rows(inputs(spark, d).energy).select(
        "facility_id", "reporting_year", "reporting_month", "electricity_kwh", "natural_gas_gj",
        "diesel_liters", "srec_mwh_claimed", "grid_ef_kgco2_kwh", "ef_source")


def q_scope1_connection(spark, d):
    m = scope1.fuel_months(inputs(spark, d).energy)
    of = lambda fuel, x: F.coalesce(F.max(F.when(F.col("fuel") == fuel, x)), F.lit(0))
    gaps = lambda fuel: F.count_if((F.col("fuel") == fuel) & F.col("is_gap"))
    return (m.groupBy("facility_id", "reporting_year")
             .agg(of("natgas", F.col("known_months")).alias("gas_nonnull_months"),
                  of("diesel", F.col("known_months")).alias("diesel_nonnull_months"),
                  gaps("natgas").alias("gas_gap_months"), gaps("diesel").alias("diesel_gap_months")))


def q_scope1_monthly_mean(spark, d):
    m = scope1.monthly_means(scope1.complete_rows(inputs(spark, d).energy))
    return m.select("reporting_year", "reporting_month", dround("mean_natgas_gj", 6).alias("mean_natgas_gj"),
                    dround("mean_diesel_liters", 6).alias("mean_diesel_liters"))


def q_scope1_imputed_monthly(spark, d):
    m = scope1.fuel_months(inputs(spark, d).energy)
    out = m.groupBy("facility_id", "reporting_year", "reporting_month").pivot("fuel", [f.short for f in scope1.FUELS]).agg(
        F.first("is_gap").cast("int").alias("is_null"), dround(F.first("amount"), 6).alias("amount"),
        dround(F.first("kgco2e"), 6).alias("kg"))
    return out.select("facility_id", "reporting_year", "reporting_month", "natgas_is_null", "diesel_is_null",
                      *[F.col(f"{f.short}_amount").alias(f"{f.column}_imputed") for f in scope1.FUELS],
                      *[F.col(f"{f.short}_kg").alias(f"scope1_{f.short}_month_kgco2e") for f in scope1.FUELS])


def q_scope1_by_type_imputed(spark, d):
    inp = inputs(spark, d)
    return scope1.scope1(inp.energy, "facility_type", inp.facilities)[0]


def q_ghg_scope1(spark, d):
    return core(spark, d).s1


def q_scope1_rejects(spark, d):
    return core(spark, d).s1_rejects


def q_scope1_reconciliation(spark, d):
    return scope1.reconciliation(core(spark, d).s1)


def q_scope1_top_facilities(spark, d):
    return scope1.top_facilities(core(spark, d).s1, 10)


def q_scope2_monthly(spark, d):
    m = scope2.monthly(inputs(spark, d).energy)
    return m.select("facility_id", "reporting_year", "reporting_month", "electricity_kwh_clean",
                    dround("scope2_location_month_kgco2e", 6).alias("scope2_location_month_kgco2e"))


def q_ghg_scope2(spark, d):
    return core(spark, d).s2


def q_ghg_scope2_code_rec(spark, d):
    inp = inputs(spark, d)
    return scope2.scope2(inp.energy, inp.facilities, "code")


def q_scope2_regional_ef(spark, d):
    inp = inputs(spark, d)
    return scope2.regional_ef(inp.energy, inp.facilities, inp.grid_ef)


def q_scope3_loan_level(spark, d):
    return core(spark, d).loan.select(
        "loan_id", "borrower_id", "sector_nace", "reporting_year", "outstanding_idr", "enterprise_value",
        dround("attribution_factor_calc", 8).alias("attribution_factor_calc"),
        dround("af_capped", 8).alias("af_capped"), "data_quality_flag", "confidence_factor",
        dround("financed_emissions_loan_tco2e", 4).alias("financed_emissions_loan_tco2e"),
        dround("financed_emissions_weighted_tco2e", 4).alias("financed_emissions_weighted_tco2e"))


def q_scope3_rejects(spark, d):
    _, rej = scope3.loan_emissions(inputs(spark, d).loans)
    return rej.select("loan_id", "reporting_year", "sector_nace", "reject_reason")


def q_ghg_scope3_financed(spark, d):
    return core(spark, d).s3


def q_pcaf_weighted_score(spark, d):
    return scope3.pcaf_weighted(inputs(spark, d).loans, ["reporting_year"])


def q_portfolio_coverage(spark, d):
    return scope3.coverage(inputs(spark, d).loans)


def q_af_recompute_check(spark, d):
    return scope3.af_recompute_check(inputs(spark, d).loans)


def q_ghg_summary_annual(spark, d):
    return core(spark, d).summary()


def q_ghg_totals(spark, d):
    return core(spark, d).summary(keep_totals=True)


def q_data_completeness(spark, d):
    return aggregate.data_completeness(core(spark, d).s1)


def q_pcaf_by_sector(spark, d):
    return core(spark, d).sector


def q_yoy_by_measure(spark, d):
    return aggregate.yoy_by_measure(core(spark, d).summary())


def queries() -> dict:
    return {
        "energy_clean": q_energy_clean,
        "scope1_connection": q_scope1_connection,
        "scope1_monthly_mean": q_scope1_monthly_mean,
        "scope1_imputed_monthly": q_scope1_imputed_monthly,
        "scope1_by_type_imputed": q_scope1_by_type_imputed,
        "ghg_scope1": q_ghg_scope1,
        "scope1_rejects": q_scope1_rejects,
        "scope1_reconciliation": q_scope1_reconciliation,
        "scope1_top_facilities": q_scope1_top_facilities,
        "scope1_by_source": lambda s, d: scope1.by_source(
            scope1.fuel_activity(inputs(s, d).energy).unionByName(inputs(s, d).activity)),
        "scope1_source_check": lambda s, d: scope1.source_total_check(inputs(s, d).energy),
        "scope2_monthly": q_scope2_monthly,
        "ghg_scope2": q_ghg_scope2,
        "ghg_scope2_code_rec": q_ghg_scope2_code_rec,
        "scope2_regional_ef": q_scope2_regional_ef,
        "scope3_loan_level": q_scope3_loan_level,
        "scope3_rejects": q_scope3_rejects,
        "ghg_scope3_financed": q_ghg_scope3_financed,
        "scope3_reported_emissions": lambda s, d: scope3.scope3(scope3.with_reported_emissions(inputs(s, d).loans, inputs(s, d).reported_emissions)),
        "scope3_usd_converted": lambda s, d: scope3.sector_rollup(scope3.loan_emissions(inputs(s, d).loans, C.USD_IDR_RATE)[0]),
        "scope2_ppa": lambda s, d: scope2.regional_ef(inputs(s, d).energy, inputs(s, d).facilities, inputs(s, d).grid_ef, inputs(s, d).ppa),
        "pcaf_weighted_score": q_pcaf_weighted_score,
        "portfolio_coverage": q_portfolio_coverage,
        "af_recompute_check": q_af_recompute_check,
        "ghg_summary_annual": q_ghg_summary_annual,
        "ghg_totals": q_ghg_totals,
        "data_completeness": q_data_completeness,
        "pcaf_by_sector": q_pcaf_by_sector,
        "yoy_by_measure": q_yoy_by_measure,
    }
