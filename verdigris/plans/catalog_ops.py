"""Registered queries: gates, data-quality audit, serving and dashboard frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import aggregate, dashboard, dq, gates, scope1, scope3, serving
from ..sources.fixtures import inputs
from .catalog_core import core

YEAR = C.CURRENT_YEAR


def summary_with_totals(spark, d):
    return core(spark, d).summary(keep_totals="both")


def _frames(spark, d):
    inp = inputs(spark, d)
    return {"energy_consumption": inp.energy, "loan_portfolio": inp.loans, "hr_metrics": inp.hr}


def _dq(*families):
    return lambda spark, d: dq.dq_family(_frames(spark, d), set(families))


ENERGY_NUMERIC = ["electricity_kwh", "natural_gas_gj", "diesel_liters", "srec_mwh_claimed",
                  "grid_ef_kgco2_kwh", "meter_reading_kwh"]
LOAN_NUMERIC = ["outstanding_idr", "total_equity_idr", "total_debt_idr", "pcaf_attribution_factor",
                "borrower_emissions_tco2e", "pcaf_data_quality_score"]


def q_dq_profile(spark, d):
    inp = inputs(spark, d)
    return dq.profile(inp.energy, ENERGY_NUMERIC, "energy_consumption", True).unionByName(
        dq.profile(inp.loans, LOAN_NUMERIC, "loan_portfolio", True))


def q_dq_category_shares(spark, d):
    inp = inputs(spark, d)
    return (dq.category_shares(inp.energy, "data_source", "energy_consumption")
            .unionByName(dq.category_shares(inp.energy, "record_status", "energy_consumption"))
            .unionByName(dq.category_shares(inp.loans, "sector_nace", "loan_portfolio"))
            .unionByName(dq.category_shares(inp.loans, "loan_type", "loan_portfolio")))


def q_dq_orphans(spark, d):
    inp = inputs(spark, d)
    return dq.orphans(inp.energy, inp.facilities, "facility_id", "energy_consumption").unionByName(
        dq.orphans(inp.loans, inp.borrowers, "borrower_id", "loan_portfolio"))


def q_enum_violations(spark, d):
    inp = inputs(spark, d)
    return gates.enum_gate(inp.energy, gates.ENERGY_ENUMS, "energy_consumption").unionByName(
        gates.enum_gate(inp.loans, gates.LOAN_ENUMS, "loan_portfolio"))


def q_schema_check(spark, d):
    inp = inputs(spark, d)
    return (gates.schema_gate(inp.energy, gates.ENERGY_CONTRACT, "energy_consumption")
            .unionByName(gates.schema_gate(inp.loans, gates.LOAN_CONTRACT, "loan_portfolio"))
            .unionByName(gates.schema_gate(inp.hr, gates.HR_CONTRACT, "hr_metrics")))


def q_summary_long(spark, d):
    return aggregate.unpivot_measures(core(spark, d).summary())


def q_typed_values(spark, d):
    long = aggregate.unpivot_measures(core(spark, d).summary()).select(
        "metric_key", "measure", F.col("value").cast("string").alias("cell"))
    return serving.typed_values(long, "cell").drop("cell")


def q_stacked(spark, d):
    b = dashboard.breakdown(core(spark, d).summary()).filter(F.col("chart") == "scope")
    return dashboard.stacked_totals(b.drop("share_pct", "chart"), "reporting_year", "category")


def q_waterfall(spark, d):
    return dashboard.waterfall(dashboard.emissions_bridge_steps(core(spark, d).summary()))


def q_data_input_bundle(spark, d):
    c = core(spark, d)
    return serving.data_input_bundle(c.summary(), c.sector, scope1.top_facilities(c.s1), c.inp.hr, YEAR)


def q_data_bundle_rows(spark, d):
    """SRV-08: the nested bundle, written and read back by its schema, as flat rows."""
    from ..sources import zones
    from .catalog_sources import zone_root
    c = core(spark, d)
    b = serving.data_input(c.summary(), c.sector, scope1.top_facilities(c.s1), c.inp.hr, YEAR)
    return serving.bundle_rows(zones.read_bundle_json(spark, zones.write_bundle_json(b, f"{zone_root(spark, d)}/bundle"), b.schema))


def queries() -> dict:
    return {
        # governance gates
        "gates_scope1": lambda s, d: gates.scope1_gates(core(s, d).s1, inputs(s, d).energy),
        "gates_scope2": lambda s, d: gates.scope2_gates(core(s, d).s2, inputs(s, d).energy),
        "gates_scope3": lambda s, d: gates.scope3_gates(core(s, d).s3),
        "gates_agg": lambda s, d: gates.agg_gates(summary_with_totals(s, d)),
        "enum_violations": q_enum_violations,
        "schema_check": q_schema_check,
        "run_summary_scope1": lambda s, d: gates.run_summary(
            core(s, d).s1, ["scope1_tco2e", "scope1_natgas_tco2e", "scope1_diesel_tco2e"]),
        # data-quality audit
        "dq_ids": _dq("ids"),
        "dq_ranges": _dq("ranges"),
        "dq_share_in_range": _dq("share_in_range"),
        "dq_not_null": _dq("not_null"),
        "dq_enums": _dq("enums"),
        "dq_meter": _dq("meter"),
        "dq_unique": _dq("unique"),
        "dq_cross": _dq("cross"),
        "dq_cardinality": _dq("cardinality"),
        "dq_year_end": _dq("year_end"),
        "dq_pcaf_distribution": lambda s, d: dq.pcaf_distribution(inputs(s, d).loans),
        "dq_profile": q_dq_profile,
        "dq_category_shares": q_dq_category_shares,
        "dq_orphans": q_dq_orphans,
        # serving
        "summary_for_year": lambda s, d: serving.summary_for(core(s, d).summary(), YEAR),
        "summary_for_year_sql": lambda s, d: serving.summary_for_sql(s, core(s, d).summary(), YEAR),
        "prior_year_summary": lambda s, d: serving.prior_summary(core(s, d).summary(), YEAR),
        "sector_top10": lambda s, d: serving.sector_top(core(s, d).sector, YEAR, 10),
        "facility_top10": lambda s, d: serving.facility_top(scope1.top_facilities(core(s, d).s1), YEAR, 10),
        "hr_metrics": lambda s, d: serving.hr_metrics(inputs(s, d).hr, YEAR),
        "hr_yoy": lambda s, d: serving.hr_yoy(inputs(s, d).hr),
        "trend": lambda s, d: serving.trend(core(s, d).summary()),
        "sum_check": lambda s, d: serving.sum_check(summary_with_totals(s, d)),
        "pcaf_consistency": lambda s, d: scope3.consistency(core(s, d).s3),
        "available_years": lambda s, d: serving.available_years(core(s, d).summary()),
        "typed_values": q_typed_values,
        "data_input_bundle": q_data_input_bundle,
        "data_bundle_rows": q_data_bundle_rows,
        # dashboard frames
        "total_kpi": lambda s, d: dashboard.total_kpi(core(s, d).summary()),
        "scope_breakdown": lambda s, d: dashboard.breakdown(core(s, d).summary()),
        "scope_yoy_pairs": lambda s, d: dashboard.year_pairs(core(s, d).summary()),
        "sector_concentration": lambda s, d: dashboard.sector_concentration(core(s, d).sector),
        "pcaf_tiers": lambda s, d: dashboard.pcaf_tiers(core(s, d).sector),
        "gender_hiring": lambda s, d: dashboard.gender_hiring(inputs(s, d).hr),
        "kpi_humanized": lambda s, d: dashboard.kpi_humanized(q_summary_long(s, d)),
        "stacked_totals": q_stacked,
        "waterfall": q_waterfall,
        "run_log_rollup": lambda s, d: dashboard.run_log_rollup(inputs(s, d).raw("events")),
        "run_log_latest": lambda s, d: dashboard.run_log_latest(inputs(s, d).raw("events"), 20),
        "run_log_latest_errors": lambda s, d: dashboard.run_log_latest(inputs(s, d).raw("events"), 20, "error"),
        "documents_by_category": lambda s, d: dashboard.documents_by_category(inputs(s, d).raw("documents")),
    }
