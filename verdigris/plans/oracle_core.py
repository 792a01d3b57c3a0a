"""Oracle SQL for the emission core (scope 1/2/3 and the annual aggregation)."""

from __future__ import annotations

from ..functions import constants as C
from ..sources.fixtures import dim_values_sql
from .sqltext import D, R, fragment, with_ctes

# ---------------------------------------------------------------- dimensions
fragment("revenue_dim", dim_values_sql("revenue").replace(".0)", ".0e0)"))
fragment("grid_ef_dim", "SELECT grid_region, CAST(grid_ef AS DOUBLE) AS grid_ef FROM ("
         + dim_values_sql("grid_ef") + ") x")
fragment("sector_display_dim", dim_values_sql("sector_display"))

# ---------------------------------------------------------------- scope 1
fragment("s1_base", "SELECT * FROM energy_consumption WHERE record_status = 'complete'",
         ["energy_consumption"])
fragment("s1_conn", """
SELECT facility_id, reporting_year,
       COUNT(natural_gas_gj) AS gas_nonnull_months, COUNT(diesel_liters) AS diesel_nonnull_months
FROM s1_base GROUP BY facility_id, reporting_year""", ["s1_base"])
fragment("s1_means", """
SELECT reporting_year, reporting_month,
       AVG(natural_gas_gj) AS mean_natgas_gj, AVG(diesel_liters) AS mean_diesel_liters
FROM s1_base WHERE natural_gas_gj IS NOT NULL OR diesel_liters IS NOT NULL
GROUP BY reporting_year, reporting_month""", ["s1_base"])

GAS_KG = (f"(gi * {D(C.EF_NATGAS_CO2_PER_GJ)} + gi * {D(C.EF_NATGAS_CH4_PER_GJ)} * {D(C.GWP_CH4)}"
          f" + gi * {D(C.EF_NATGAS_N2O_PER_GJ)} * {D(C.GWP_N2O)})")
DSL_KG = (f"(di * {D(C.EF_DIESEL_CO2_PER_L)} + di * {D(C.EF_DIESEL_CH4_PER_L)} * {D(C.GWP_CH4)}"
          f" + di * {D(C.EF_DIESEL_N2O_PER_L)} * {D(C.GWP_N2O)})")


def _s1_monthly(mean_src: str, extra_join: str = "", extra_cols: str = "") -> str:
    return f"""
SELECT x.*, {GAS_KG.replace('gi', 'x.natural_gas_gj_imputed')} AS gas_kg,
            {DSL_KG.replace('di', 'x.diesel_liters_imputed')} AS diesel_kg
FROM (
  SELECT b.facility_id, b.reporting_year, b.reporting_month, b.ef_source,
         b.natural_gas_gj, b.diesel_liters, c.gas_nonnull_months, c.diesel_nonnull_months,
         CASE WHEN c.gas_nonnull_months > 0 AND b.natural_gas_gj IS NULL THEN 1 ELSE 0 END AS natgas_is_null,
         CASE WHEN c.diesel_nonnull_months > 0 AND b.diesel_liters IS NULL THEN 1 ELSE 0 END AS diesel_is_null,
         CASE WHEN b.natural_gas_gj IS NOT NULL THEN b.natural_gas_gj
              WHEN c.gas_nonnull_months > 0 THEN COALESCE(m.mean_natgas_gj, 0e0) ELSE 0e0 END AS natural_gas_gj_imputed,
         CASE WHEN b.diesel_liters IS NOT NULL THEN b.diesel_liters
              WHEN c.diesel_nonnull_months > 0 THEN COALESCE(m.mean_diesel_liters, 0e0) ELSE 0e0 END AS diesel_liters_imputed
         {extra_cols}
  FROM s1_base b
  JOIN s1_conn c ON b.facility_id = c.facility_id AND b.reporting_year = c.reporting_year
  {extra_join}
  LEFT JOIN {mean_src} m ON m.reporting_year = b.reporting_year AND m.reporting_month = b.reporting_month
       {"AND m.facility_type = f.facility_type" if extra_join else ""}
) x"""


fragment("s1_monthly", _s1_monthly("s1_means"), ["s1_base", "s1_conn", "s1_means"])


def _s1_annual(src: str) -> str:
    return f"""
SELECT facility_id, reporting_year, natgas_t, diesel_t, gas_gj, diesel_l, imputed_months,
       emission_factor_source,
       CASE WHEN imputed_months = 0 THEN 1 WHEN imputed_months <= 2 THEN 2
            WHEN imputed_months <= 5 THEN 3 ELSE 4 END AS data_quality_score
FROM (
  SELECT facility_id, reporting_year,
         SUM(gas_kg) / 1000e0 AS natgas_t, SUM(diesel_kg) / 1000e0 AS diesel_t,
         SUM(natural_gas_gj_imputed) AS gas_gj, SUM(diesel_liters_imputed) AS diesel_l,
         CAST(SUM(natgas_is_null + diesel_is_null) AS INTEGER) AS imputed_months,
         arg_min(ef_source, reporting_month) AS emission_factor_source
  FROM {src} GROUP BY facility_id, reporting_year
) a"""


def _s1_publish(src: str, cond: str) -> str:
    return f"""
SELECT facility_id, reporting_year,
       {R(R('natgas_t', 4) + ' + ' + R('diesel_t', 4), 4)} AS scope1_tco2e,
       {R('natgas_t', 4)} AS scope1_natgas_tco2e, {R('diesel_t', 4)} AS scope1_diesel_tco2e,
       {R('gas_gj', 2)} AS total_natgas_gj, {R('diesel_l', 2)} AS total_diesel_liters,
       imputed_months, data_quality_score, emission_factor_source,
       '{C.SCOPE1_METHODOLOGY}' AS methodology, '{C.SCOPE1_CONSOLIDATION}' AS consolidation_approach
FROM {src} WHERE {cond}"""


fragment("s1_annual", _s1_annual("s1_monthly"), ["s1_monthly"])
fragment("ghg_scope1", _s1_publish("s1_annual", "data_quality_score < 4"), ["s1_annual"])

# facility-type variant (S1-05)
fragment("s1_typed_base", """
SELECT b.*, f.facility_type FROM s1_base b LEFT JOIN facility_dim f ON b.facility_id = f.facility_id""",
         ["s1_base", "facility_dim"])
fragment("s1_type_means", """
SELECT reporting_year, reporting_month, facility_type,
       AVG(natural_gas_gj) AS mean_natgas_gj, AVG(diesel_liters) AS mean_diesel_liters
FROM s1_typed_base GROUP BY reporting_year, reporting_month, facility_type""", ["s1_typed_base"])
fragment("s1_type_monthly",
         _s1_monthly("s1_type_means", "LEFT JOIN facility_dim f ON b.facility_id = f.facility_id",
                     ", f.facility_type"),
         ["s1_base", "s1_conn", "s1_type_means", "facility_dim"])
fragment("s1_type_annual", _s1_annual("s1_type_monthly"), ["s1_type_monthly"])

# ---------------------------------------------------------------- scope 2
fragment("s2_monthly", """
SELECT facility_id, reporting_year, reporting_month, electricity_kwh, grid_ef_kgco2_kwh, srec_mwh_claimed,
       COALESCE(electricity_kwh, 0e0) AS electricity_kwh_clean,
       COALESCE(electricity_kwh, 0e0) * grid_ef_kgco2_kwh AS scope2_location_month_kgco2e
FROM energy_consumption WHERE record_status = 'complete'""", ["energy_consumption"])
fragment("s2_annual", """
SELECT facility_id, reporting_year,
       SUM(electricity_kwh_clean) / 1000e0 AS mwh,
       SUM(scope2_location_month_kgco2e) / 1000e0 AS loc,
       COALESCE(SUM(srec_mwh_claimed), 0e0) AS rec,
       arg_min(grid_ef_kgco2_kwh, reporting_month) AS ef,
       CAST(SUM(CASE WHEN electricity_kwh IS NULL THEN 1 ELSE 0 END) AS INTEGER) AS null_months
FROM s2_monthly GROUP BY facility_id, reporting_year""", ["s2_monthly"])


def _s2_publish(mode: str) -> str:
    if mode == "spec":
        rec = "LEAST(rec, mwh)"
        market = f"GREATEST(loc - {rec} * ef, 0e0)"
        pct = f"CASE WHEN mwh > 0 THEN {rec} / mwh * 100e0 ELSE 0e0 END"
    else:
        rec = "LEAST(rec, mwh)"
        market = "GREATEST(loc - rec * ef / 1000e0, 0e0)"
        pct = "CASE WHEN mwh > 0 THEN rec / mwh * 100e0 ELSE 0e0 END"
    return f"""
SELECT a.facility_id, a.reporting_year, {R('mwh', 3)} AS total_consumption_mwh,
       {R('loc', 3)} AS scope2_location_tco2e, {R(market, 3)} AS scope2_market_tco2e,
       COALESCE(f.grid_region, 'national') AS grid_region, ef AS grid_ef_applied,
       {R(rec, 3)} AS rec_mwh_applied, {R(pct, 2)} AS rec_applied_pct, false AS has_ppa,
       CASE WHEN null_months = 0 THEN 1 WHEN null_months <= 2 THEN 2 WHEN null_months <= 5 THEN 3 ELSE 4 END
         AS data_quality_score,
       '{C.SCOPE2_METHODOLOGY}' AS methodology
FROM s2_annual a LEFT JOIN facility_dim f ON a.facility_id = f.facility_id"""


fragment("ghg_scope2", _s2_publish("spec"), ["s2_annual", "facility_dim"])
fragment("ghg_scope2_code", _s2_publish("code"), ["s2_annual", "facility_dim"])

# ---------------------------------------------------------------- scope 3
fragment("s3_checked", """
SELECT l.*, total_equity_idr + total_debt_idr AS enterprise_value,
       CASE WHEN total_equity_idr + total_debt_idr IS NULL THEN 'ev_null'
            WHEN total_equity_idr + total_debt_idr <= 0 THEN 'ev_nonpositive'
            WHEN borrower_emissions_tco2e IS NULL THEN 'emissions_null'
            WHEN borrower_emissions_tco2e <= 0 THEN 'emissions_nonpositive' END AS reject_reason
FROM loan_portfolio l WHERE record_status = 'validated'""", ["loan_portfolio"])

_CONF = " ".join(f"WHEN pcaf_data_quality_score = {D(k)} THEN {D(v)}" for k, v in C.PCAF_CONFIDENCE.items())
fragment("s3_loan", f"""
SELECT loan_id, borrower_id, sector_nace, loan_type, currency, reporting_year, outstanding_idr, enterprise_value,
       afc AS attribution_factor_calc,
       CASE WHEN afc > 1e0 THEN 1e0 ELSE afc END AS af_capped,
       CASE WHEN afc > 1e0 THEN 'AF_CAPPED' ELSE 'OK' END AS data_quality_flag,
       borrower_emissions_tco2e, pcaf_data_quality_score,
       conf AS confidence_factor,
       (CASE WHEN afc > 1e0 THEN 1e0 ELSE afc END) * borrower_emissions_tco2e AS financed_emissions_loan_tco2e,
       (CASE WHEN afc > 1e0 THEN 1e0 ELSE afc END) * borrower_emissions_tco2e * conf AS financed_emissions_weighted_tco2e
FROM (
  SELECT *, CAST(outstanding_idr AS DOUBLE) / CAST(enterprise_value AS DOUBLE) AS afc,
         CASE {_CONF} ELSE {D(C.PCAF_CONFIDENCE_DEFAULT)} END AS conf
  FROM s3_checked WHERE reject_reason IS NULL
) x""", ["s3_checked"])
fragment("ghg_scope3", f"""
SELECT sector_nace, reporting_year, CAST(COUNT(*) AS INTEGER) AS loan_count,
       CAST(COUNT(DISTINCT borrower_id) AS INTEGER) AS borrower_count,
       {R('CAST(SUM(CAST(outstanding_idr AS DECIMAL(38,0))) AS DOUBLE) / 1e12', 6)} AS total_outstanding_idr_trillion,
       {R('SUM(financed_emissions_loan_tco2e)', 2)} AS financed_emissions_gross_tco2e,
       {R('SUM(financed_emissions_weighted_tco2e)', 2)} AS financed_emissions_weighted_tco2e,
       {R('AVG(pcaf_data_quality_score)', 2)} AS avg_pcaf_score,
       {R('CAST(SUM(CASE WHEN pcaf_data_quality_score <= 2e0 THEN 1 ELSE 0 END) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 100e0', 4)} AS high_quality_data_pct
FROM s3_loan GROUP BY sector_nace, reporting_year""", ["s3_loan"])



def _sectors_of(name: str, loans: str, deps: list[str]) -> str:
    """The sector table over another loan book."""
    from .sqltext import _FRAGMENTS
    fragment(f"loans_{name}", loans, deps)
    names = {"loan_portfolio": f"loans_{name}"}
    for part in ("s3_checked", "s3_loan", "ghg_scope3"):
        sql, parts = _FRAGMENTS[part]
        for old, new in names.items():
            sql = sql.replace(f"FROM {old} ", f"FROM {new} ").replace(f"FROM {old}\n", f"FROM {new}\n")
        names[part] = f"{part}_{name}"
        fragment(names[part], sql, [names.get(x, x) for x in parts])
    return with_ctes(f"SELECT * FROM {names['ghg_scope3']}", [names["ghg_scope3"]])


# ---------------------------------------------------------------- aggregation
fragment("agg_totals", """
SELECT a1.reporting_year, a1.scope1_tco2e, a1.scope1_natgas_tco2e, a1.scope1_diesel_tco2e,
       a1.scope1_facility_count, a1.high_quality_facilities,
       a2.scope2_location_tco2e, a2.scope2_market_tco2e, a2.scope2_facility_count,
       a3.scope3_cat15_gross_tco2e, a3.scope3_cat15_weighted_tco2e, a4.fte_count, a5.avg_pcaf_data_quality,
       a1.scope1_tco2e + a2.scope2_market_tco2e + a3.scope3_cat15_gross_tco2e AS total_tco2e,
       a1.scope1_tco2e + a2.scope2_location_tco2e + a3.scope3_cat15_gross_tco2e AS total_location_based_tco2e
FROM (SELECT reporting_year, SUM(scope1_tco2e) AS scope1_tco2e, SUM(scope1_natgas_tco2e) AS scope1_natgas_tco2e,
             SUM(scope1_diesel_tco2e) AS scope1_diesel_tco2e, COUNT(*) AS scope1_facility_count,
             SUM(CASE WHEN data_quality_score <= 2 THEN 1 ELSE 0 END) AS high_quality_facilities
      FROM ghg_scope1 GROUP BY reporting_year) a1
JOIN (SELECT reporting_year, SUM(scope2_location_tco2e) AS scope2_location_tco2e,
             SUM(scope2_market_tco2e) AS scope2_market_tco2e, COUNT(*) AS scope2_facility_count
      FROM ghg_scope2 GROUP BY reporting_year) a2 ON a1.reporting_year = a2.reporting_year
JOIN (SELECT reporting_year, SUM(financed_emissions_gross_tco2e) AS scope3_cat15_gross_tco2e,
             SUM(financed_emissions_weighted_tco2e) AS scope3_cat15_weighted_tco2e
      FROM ghg_scope3 GROUP BY reporting_year) a3 ON a1.reporting_year = a3.reporting_year
LEFT JOIN (SELECT reporting_year, SUM(fte_total) AS fte_count FROM hr_metrics GROUP BY reporting_year) a4
       ON a1.reporting_year = a4.reporting_year
LEFT JOIN (SELECT reporting_year,
                  SUM(CAST(outstanding_idr AS DOUBLE) * pcaf_data_quality_score)
                  / NULLIF(SUM(CAST(outstanding_idr AS DOUBLE)), 0) AS avg_pcaf_data_quality
           FROM loan_portfolio WHERE record_status = 'validated' GROUP BY reporting_year) a5
       ON a1.reporting_year = a5.reporting_year""",
         ["ghg_scope1", "ghg_scope2", "ghg_scope3", "hr_metrics", "loan_portfolio"])

fragment("agg_summary_raw", f"""
SELECT t.*, r.revenue_idr_bn,
       CASE WHEN r.revenue_idr_bn > 0 THEN t.total_tco2e / r.revenue_idr_bn END AS intensity_idr,
       CASE WHEN t.fte_count > 0 THEN (t.scope1_tco2e + t.scope2_market_tco2e) / t.fte_count END AS intensity_fte,
       CASE WHEN p.total_tco2e <> 0 THEN (t.total_tco2e - p.total_tco2e) / p.total_tco2e * 100e0 END AS yoy,
       CASE WHEN t.reporting_year <> {C.BASE_YEAR} AND b.total_tco2e <> 0
            THEN (t.total_tco2e - b.total_tco2e) / b.total_tco2e * 100e0 END AS vs_base
FROM agg_totals t
LEFT JOIN revenue_dim r ON r.reporting_year = t.reporting_year
LEFT JOIN agg_totals p ON p.reporting_year = t.reporting_year - 1
LEFT JOIN (SELECT total_tco2e FROM agg_totals WHERE reporting_year = {C.BASE_YEAR}) b ON true""",
         ["agg_totals", "revenue_dim"])

fragment("ghg_summary_annual", f"""
SELECT '{C.BANK_ID}_' || CAST(reporting_year AS VARCHAR) AS metric_key, reporting_year,
       {R('scope1_tco2e', 3)} AS scope1_tco2e, {R('scope1_natgas_tco2e', 4)} AS scope1_natgas_tco2e,
       {R('scope1_diesel_tco2e', 4)} AS scope1_diesel_tco2e,
       {R('scope2_location_tco2e', 3)} AS scope2_location_tco2e, {R('scope2_market_tco2e', 3)} AS scope2_market_tco2e,
       {R('scope3_cat15_gross_tco2e', 2)} AS scope3_cat15_gross_tco2e,
       {R('scope3_cat15_weighted_tco2e', 2)} AS scope3_cat15_weighted_tco2e,
       {R('intensity_idr', 6)} AS intensity_tco2e_per_idr_bn, {R('intensity_fte', 4)} AS intensity_tco2e_per_fte,
       {R('yoy', 2)} AS yoy_change_pct, {R('vs_base', 2)} AS vs_base_year_change_pct,
       {R('avg_pcaf_data_quality', 2)} AS avg_pcaf_data_quality, '{C.ASSURANCE_LEVEL}' AS assurance_level
FROM agg_summary_raw""", ["agg_summary_raw"])

fragment("pcaf_by_sector", f"""
SELECT s.sector_nace, s.reporting_year, COALESCE(d.sector_display_name, s.sector_nace) AS sector_display_name,
       s.loan_count, s.borrower_count, s.total_outstanding_idr_trillion, s.financed_emissions_gross_tco2e,
       s.financed_emissions_weighted_tco2e,
       {R('CASE WHEN s.total_outstanding_idr_trillion > 0 THEN s.financed_emissions_gross_tco2e / (s.total_outstanding_idr_trillion * 1000e0) ELSE 0e0 END', 4)} AS emission_intensity_per_idr_bn,
       s.avg_pcaf_score,
       {R('CASE WHEN y.tot_out > 0 THEN s.total_outstanding_idr_trillion / y.tot_out * 100e0 ELSE 0e0 END', 2)} AS pct_of_total_portfolio,
       {R('CASE WHEN y.tot_em > 0 THEN s.financed_emissions_gross_tco2e / y.tot_em * 100e0 ELSE 0e0 END', 2)} AS pct_of_total_financed_emissions,
       {R('CASE WHEN p.financed_emissions_gross_tco2e <> 0 THEN (s.financed_emissions_gross_tco2e - p.financed_emissions_gross_tco2e) / p.financed_emissions_gross_tco2e * 100e0 END', 2)} AS yoy_change_emissions_pct
FROM ghg_scope3 s
LEFT JOIN sector_display_dim d ON d.sector_nace = s.sector_nace
JOIN (SELECT reporting_year, SUM(total_outstanding_idr_trillion) AS tot_out,
             SUM(financed_emissions_gross_tco2e) AS tot_em FROM ghg_scope3 GROUP BY reporting_year) y
  ON y.reporting_year = s.reporting_year
LEFT JOIN ghg_scope3 p ON p.sector_nace = s.sector_nace AND p.reporting_year = s.reporting_year - 1""",
         ["ghg_scope3", "sector_display_dim"])


# ---------------------------------------------------------------- oracle queries
def oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    q["energy_clean"] = with_ctes("""
SELECT facility_id, reporting_year, reporting_month, electricity_kwh, natural_gas_gj, diesel_liters,
       srec_mwh_claimed, grid_ef_kgco2_kwh, ef_source
FROM energy_consumption WHERE record_status = 'complete'""", ["energy_consumption"])
    q["scope1_connection"] = with_ctes("""
SELECT c.facility_id, c.reporting_year, c.gas_nonnull_months, c.diesel_nonnull_months,
       CAST(SUM(CASE WHEN c.gas_nonnull_months > 0 AND b.natural_gas_gj IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS gas_gap_months,
       CAST(SUM(CASE WHEN c.diesel_nonnull_months > 0 AND b.diesel_liters IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS diesel_gap_months
FROM s1_conn c JOIN s1_base b ON b.facility_id = c.facility_id AND b.reporting_year = c.reporting_year
GROUP BY c.facility_id, c.reporting_year, c.gas_nonnull_months, c.diesel_nonnull_months""",
                                       ["s1_conn", "s1_base"])
    q["scope1_monthly_mean"] = with_ctes(f"""
SELECT reporting_year, reporting_month, {R('mean_natgas_gj', 6)} AS mean_natgas_gj,
       {R('mean_diesel_liters', 6)} AS mean_diesel_liters FROM s1_means""", ["s1_means"])
    q["scope1_imputed_monthly"] = with_ctes(f"""
SELECT facility_id, reporting_year, reporting_month, natgas_is_null, diesel_is_null,
       {R('natural_gas_gj_imputed', 6)} AS natural_gas_gj_imputed,
       {R('diesel_liters_imputed', 6)} AS diesel_liters_imputed,
       {R('gas_kg', 6)} AS scope1_natgas_month_kgco2e, {R('diesel_kg', 6)} AS scope1_diesel_month_kgco2e
FROM s1_monthly""", ["s1_monthly"])
    q["scope1_by_type_imputed"] = with_ctes(_s1_publish("s1_type_annual", "data_quality_score < 4"),
                                            ["s1_type_annual"])
    q["ghg_scope1"] = with_ctes("SELECT * FROM ghg_scope1", ["ghg_scope1"])
    q["scope1_rejects"] = with_ctes(
        _s1_publish("s1_annual", "data_quality_score = 4").replace(
            "FROM s1_annual", ", 'imputed_months_gt_5' AS reject_reason FROM s1_annual"), ["s1_annual"])
    q["scope1_reconciliation"] = with_ctes(f"""
SELECT facility_id, reporting_year, scope1_tco2e,
       {R('ABS(scope1_natgas_tco2e + scope1_diesel_tco2e - scope1_tco2e)', 6)} AS discrepancy
FROM ghg_scope1 WHERE ABS(scope1_natgas_tco2e + scope1_diesel_tco2e - scope1_tco2e) > 1e-4""", ["ghg_scope1"])
    q["scope1_top_facilities"] = with_ctes("""
SELECT reporting_year, rank, facility_id, scope1_tco2e, scope1_natgas_tco2e, scope1_diesel_tco2e,
       total_natgas_gj, total_diesel_liters, data_quality_score
FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY reporting_year
                                   ORDER BY scope1_tco2e DESC, facility_id) AS INTEGER) AS rank
      FROM ghg_scope1) r WHERE rank <= 10""", ["ghg_scope1"])
    from ..operators import scope1 as _s1
    fac = ", ".join(f"('{a}', '{u}', {D(f)}, '{c}')" for a, u, f, c in _s1.ACTIVITY_FACTORS)
    qual = ", ".join(f"('{a}', {b})" for a, b in _s1.SOURCE_QUALITY)
    q["scope1_by_source"] = with_ctes(f"""
SELECT reporting_year, emission_source, source_type, unit, COUNT(*) AS records, {R('SUM(quantity)', 2)} AS quantity,
       {R('SUM(quantity * factor)', 4)} AS emissions_tco2e, {R('AVG(COALESCE(quality_score, 4))', 4)} AS avg_quality_score
FROM (SELECT reporting_year, data_source, 'natural_gas' AS source_type, natural_gas_gj AS quantity FROM s1_base
      UNION ALL SELECT reporting_year, data_source, 'diesel_generator', diesel_liters FROM s1_base
      UNION ALL SELECT reporting_year, data_source, source_type, quantity FROM activity) a
JOIN (VALUES {fac}) f(source_type, unit, factor, emission_source) USING (source_type)
LEFT JOIN (VALUES {qual}) qs(data_source, quality_score) USING (data_source)
WHERE quantity IS NOT NULL
GROUP BY reporting_year, emission_source, source_type, unit""", ["s1_base", "activity"])
    gas = "(56.1e0 + 0.001e0 * 29.8e0 + 0.0001e0 * 273e0)"
    diesel = "(2.53763e0 + 0.0000097e0 * 29.8e0 + 0.000121e0 * 273e0)"
    q["scope1_source_check"] = with_ctes(f"""
SELECT reporting_year, {R('s', 3)} AS by_source_tco2e, {R('g', 3)} AS by_gas_tco2e, abs(s - g) * 100 <= 0.01e0 * g AS within_tolerance
FROM (SELECT reporting_year, {R(f'SUM(natural_gas_gj) * {gas} / 1000', 4)} + {R(f'SUM(diesel_liters) * {diesel} / 1000', 4)} AS s,
             SUM(coalesce(natural_gas_gj * {gas}, 0) + coalesce(diesel_liters * {diesel}, 0)) / 1000 AS g
      FROM s1_base GROUP BY reporting_year) x""", ["s1_base"])
    q["scope2_monthly"] = with_ctes(f"""
SELECT facility_id, reporting_year, reporting_month, electricity_kwh_clean,
       {R('scope2_location_month_kgco2e', 6)} AS scope2_location_month_kgco2e FROM s2_monthly""", ["s2_monthly"])
    q["ghg_scope2"] = with_ctes("SELECT * FROM ghg_scope2", ["ghg_scope2"])
    q["ghg_scope2_code_rec"] = with_ctes("SELECT * FROM ghg_scope2_code", ["ghg_scope2_code"])
    q["scope2_ppa"] = with_ctes(f"""
SELECT a.facility_id, a.reporting_year, COALESCE(f.grid_region, 'national') AS grid_region,
       {R('COALESCE(g.grid_ef, 7.886e-1)', 4)} AS regional_ef, {R('a.mwh', 3)} AS total_consumption_mwh,
       {R('greatest(a.mwh - COALESCE(p.ppa_mwh, 0e0), 0e0) * COALESCE(g.grid_ef, 7.886e-1)', 3)} AS scope2_location_regional_tco2e,
       {R('a.loc', 3)} AS scope2_location_row_ef_tco2e, COALESCE(p.ppa_mwh, 0e0) > 0 AS has_ppa
FROM s2_annual a LEFT JOIN facility_dim f ON a.facility_id = f.facility_id
LEFT JOIN grid_ef_dim g ON g.grid_region = COALESCE(f.grid_region, 'national')
LEFT JOIN ppa p ON p.facility_id = a.facility_id AND p.reporting_year = a.reporting_year""", ["s2_annual", "facility_dim", "grid_ef_dim", "ppa"])
    q["scope3_reported_emissions"] = _sectors_of("reported", """
SELECT l.* EXCLUDE (borrower_emissions_tco2e), e.reported_emissions_tco2e AS borrower_emissions_tco2e
FROM loan_portfolio l LEFT JOIN reported_emissions e ON e.borrower_id = l.borrower_id AND e.reporting_year = l.reporting_year""",
                                                  ["loan_portfolio", "reported_emissions"])
    q["scope3_usd_converted"] = _sectors_of("usd", """
SELECT * REPLACE (CASE WHEN currency = 'USD' THEN CAST(outstanding_idr * 15750e0 AS BIGINT) ELSE outstanding_idr END AS outstanding_idr)
FROM loan_portfolio""", ["loan_portfolio"])
    q["scope2_regional_ef"] = with_ctes(f"""
SELECT a.facility_id, a.reporting_year, COALESCE(f.grid_region, 'national') AS grid_region,
       {R('COALESCE(g.grid_ef, 7.886e-1)', 4)} AS regional_ef, {R('a.mwh', 3)} AS total_consumption_mwh,
       {R('a.mwh * COALESCE(g.grid_ef, 7.886e-1)', 3)} AS scope2_location_regional_tco2e,
       {R('a.loc', 3)} AS scope2_location_row_ef_tco2e, false AS has_ppa
FROM s2_annual a LEFT JOIN facility_dim f ON a.facility_id = f.facility_id
LEFT JOIN grid_ef_dim g ON g.grid_region = COALESCE(f.grid_region, 'national')""",
                                        ["s2_annual", "facility_dim", "grid_ef_dim"])
    q["scope3_loan_level"] = with_ctes(f"""
SELECT loan_id, borrower_id, sector_nace, reporting_year, outstanding_idr, enterprise_value,
       {R('attribution_factor_calc', 8)} AS attribution_factor_calc, {R('af_capped', 8)} AS af_capped,
       data_quality_flag, confidence_factor,
       {R('financed_emissions_loan_tco2e', 4)} AS financed_emissions_loan_tco2e,
       {R('financed_emissions_weighted_tco2e', 4)} AS financed_emissions_weighted_tco2e
FROM s3_loan""", ["s3_loan"])
    q["scope3_rejects"] = with_ctes("""
SELECT loan_id, reporting_year, sector_nace, reject_reason FROM s3_checked WHERE reject_reason IS NOT NULL""",
                                    ["s3_checked"])
    q["ghg_scope3_financed"] = with_ctes("SELECT * FROM ghg_scope3", ["ghg_scope3"])
    q["pcaf_weighted_score"] = with_ctes(f"""
SELECT reporting_year,
       {R('SUM(CAST(outstanding_idr AS DOUBLE) * pcaf_data_quality_score) / NULLIF(SUM(CAST(outstanding_idr AS DOUBLE)), 0)', 4)} AS portfolio_weighted_pcaf,
       COUNT(*) AS loan_count
FROM loan_portfolio WHERE record_status = 'validated' GROUP BY reporting_year""", ["loan_portfolio"])
    q["portfolio_coverage"] = with_ctes(f"""
SELECT reporting_year, COUNT(*) FILTER (WHERE reject_reason IS NULL) AS loans_covered, COUNT(*) AS loans_total,
       {R('CAST(SUM(CASE WHEN reject_reason IS NULL THEN CAST(outstanding_idr AS DECIMAL(38,0)) ELSE 0 END) AS DOUBLE) / CAST(SUM(CAST(outstanding_idr AS DECIMAL(38,0))) AS DOUBLE) * 100e0', 4)} AS coverage_pct
FROM s3_checked GROUP BY reporting_year""", ["s3_checked"])
    q["af_recompute_check"] = with_ctes("""
SELECT loan_id, reporting_year,
       CASE WHEN total_equity_idr + total_debt_idr = 0 THEN 'no_enterprise_value' ELSE 'mismatch' END AS issue
FROM loan_portfolio
WHERE (pcaf_attribution_factor IS NULL) <> (total_equity_idr + total_debt_idr = 0)
   OR ABS(pcaf_attribution_factor - CAST(outstanding_idr AS DOUBLE)
          / NULLIF(CAST(total_equity_idr + total_debt_idr AS DOUBLE), 0)) > 1e-6""", ["loan_portfolio"])
    q["ghg_summary_annual"] = with_ctes("SELECT * FROM ghg_summary_annual", ["ghg_summary_annual"])
    q["ghg_totals"] = with_ctes(f"""
SELECT '{C.BANK_ID}_' || CAST(reporting_year AS VARCHAR) AS metric_key, reporting_year,
       {R(R('scope1_tco2e', 3) + ' + ' + R('scope2_market_tco2e', 3) + ' + ' + R('scope3_cat15_gross_tco2e', 2), 3)} AS total_tco2e,
       {R(R('scope1_tco2e', 3) + ' + ' + R('scope2_location_tco2e', 3) + ' + ' + R('scope3_cat15_gross_tco2e', 2), 3)} AS total_location_based_tco2e,
       scope1_facility_count, scope2_facility_count, CAST(high_quality_facilities AS BIGINT) AS high_quality_facilities,
       {R('CASE WHEN scope1_facility_count > 0 THEN CAST(high_quality_facilities AS DOUBLE) / CAST(scope1_facility_count AS DOUBLE) * 100e0 ELSE 0e0 END', 2)} AS data_completeness_pct,
       revenue_idr_bn, CAST(fte_count AS BIGINT) AS fte_count
FROM agg_summary_raw""", ["agg_summary_raw"])
    q["data_completeness"] = with_ctes(f"""
SELECT reporting_year, facility_count, high_quality_facilities, pct AS data_completeness_pct,
       CASE WHEN pct >= 95 THEN 'high' WHEN pct >= 80 THEN 'moderate' ELSE 'limitation' END AS completeness_band
FROM (SELECT reporting_year, COUNT(*) AS facility_count,
             COUNT(*) FILTER (WHERE data_quality_score <= 2) AS high_quality_facilities,
             {R('CAST(COUNT(*) FILTER (WHERE data_quality_score <= 2) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 100e0', 2)} AS pct
      FROM ghg_scope1 GROUP BY reporting_year) x""", ["ghg_scope1"])
    q["pcaf_by_sector"] = with_ctes("SELECT * FROM pcaf_by_sector", ["pcaf_by_sector"])
    measures = ["scope1_tco2e", "scope2_location_tco2e", "scope2_market_tco2e", "scope3_cat15_gross_tco2e",
                "scope3_cat15_weighted_tco2e", "intensity_tco2e_per_idr_bn", "intensity_tco2e_per_fte",
                "avg_pcaf_data_quality"]
    union = " UNION ALL ".join(
        f"SELECT metric_key, reporting_year, '{m}' AS measure, {m} AS value FROM ghg_summary_annual"
        for m in measures)
    q["yoy_by_measure"] = with_ctes(f"""
SELECT c.metric_key, c.reporting_year, c.measure, c.value, p.value AS prior_value,
       {R('CASE WHEN p.value <> 0 THEN (c.value - p.value) / p.value * 100e0 END', 2)} AS yoy_change_pct
FROM ({union}) c LEFT JOIN ({union}) p ON p.measure = c.measure AND p.reporting_year = c.reporting_year - 1""",
                                    ["ghg_summary_annual"])
    return q
