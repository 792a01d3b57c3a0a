"""Oracle SQL for gates, data-quality audit, serving and dashboard frames."""

from __future__ import annotations

from ..functions import constants as C
from ..operators import dq, gates
from . import oracle_core  # noqa: F401  (registers the core fragments)
from .sqltext import R, fragment, with_ctes

Y = C.CURRENT_YEAR

fragment("agg_with_totals", f"""
SELECT s.*, {R(R('r.scope1_tco2e', 3) + ' + ' + R('r.scope2_market_tco2e', 3) + ' + ' + R('r.scope3_cat15_gross_tco2e', 2), 3)} AS total_tco2e,
       {R(R('r.scope1_tco2e', 3) + ' + ' + R('r.scope2_location_tco2e', 3) + ' + ' + R('r.scope3_cat15_gross_tco2e', 2), 3)} AS total_location_based_tco2e,
       r.revenue_idr_bn
FROM ghg_summary_annual s JOIN agg_summary_raw r ON r.reporting_year = s.reporting_year""",
         ["ghg_summary_annual", "agg_summary_raw"])
fragment("top_fac", """
SELECT * FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY reporting_year
                                   ORDER BY scope1_tco2e DESC, facility_id) AS INTEGER) AS rank
               FROM ghg_scope1) r WHERE rank <= 10""", ["ghg_scope1"])
_MEASURES = ["scope1_tco2e", "scope2_location_tco2e", "scope2_market_tco2e", "scope3_cat15_gross_tco2e",
             "scope3_cat15_weighted_tco2e", "intensity_tco2e_per_idr_bn", "intensity_tco2e_per_fte",
             "avg_pcaf_data_quality"]
fragment("summary_long", " UNION ALL ".join(
    f"SELECT metric_key, reporting_year, '{m}' AS measure, {m} AS value FROM ghg_summary_annual"
    for m in _MEASURES), ["ghg_summary_annual"])


def _gate_sql(table: str, gs) -> str:
    return " UNION ALL ".join(
        f"SELECT '{g.gate_id}' AS gate_id, '{g.severity}' AS severity, "
        f"CAST(COUNT(*) FILTER (WHERE COALESCE({g.predicate}, false)) AS BIGINT) AS failed_rows, "
        f"COUNT(*) FILTER (WHERE COALESCE({g.predicate}, false)) = 0 AS passed FROM {table}" for g in gs)


def _metric_sql(r: dq.Rule) -> str:
    p = r.duck or r.pred
    if r.kind == "violations":
        return f"CAST(COUNT(*) FILTER (WHERE COALESCE({p}, false)) AS DOUBLE)"
    if r.kind == "share":
        scope = r.scope or "true"
        return R(f"CAST(COUNT(*) FILTER (WHERE COALESCE(({scope}) AND ({p}), false)) AS DOUBLE) * 100e0"
                 f" / NULLIF(CAST(COUNT(*) FILTER (WHERE COALESCE({scope}, false)) AS DOUBLE), 0)", 4)
    if r.kind == "distinct":
        return f"CAST(COUNT(DISTINCT {p}) AS DOUBLE)"
    if r.kind == "duplicates":
        return f"CAST(COUNT({p}) - COUNT(DISTINCT {p}) AS DOUBLE)"
    raise ValueError(r.kind)


def _dq_sql(families: set[str]) -> str:
    parts, deps = [], []
    for t, rules in dq.TABLE_RULES.items():
        for r in rules:
            if r.family not in families:
                continue
            deps.append(t)
            ok = "metric <= threshold" if r.kind in ("violations", "duplicates") \
                else "COALESCE(metric >= threshold, false)"
            parts.append(f"SELECT table_name, family, rule, metric, threshold, {ok} AS passed FROM ("
                         f"SELECT '{t}' AS table_name, '{r.family}' AS family, '{r.rule}' AS rule, "
                         f"{_metric_sql(r)} AS metric, {float(r.threshold)!r}e0 AS threshold FROM {t}) x")
    return with_ctes(" UNION ALL ".join(parts), deps)


def _profile_sql(table: str, cols: list[str], integral=()) -> str:
    def mean(c):
        s = f"SUM(CAST({c} AS DECIMAL(38,0)))" if c in integral else f"SUM({c})"
        return R(f"CAST({s} AS DOUBLE) / NULLIF(COUNT({c}), 0)", 4)
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, COUNT(*) AS rows, COUNT(*) - COUNT({c}) AS nulls, "
        f"{mean(c)} AS mean, CAST(MIN({c}) AS DOUBLE) AS min_value, CAST(MAX({c}) AS DOUBLE) AS max_value, CAST(quantile_disc({c}, 0.5) AS DOUBLE) AS median "
        f"FROM {table}" for c in cols)


def _shares_sql(table: str, col: str) -> str:
    return (f"SELECT '{table}' AS table_name, '{col}' AS column_name, CAST({col} AS VARCHAR) AS value, rows, "
            f"{R('rows * 100e0 / SUM(rows) OVER ()', 2)} AS pct "
            f"FROM (SELECT {col}, COUNT(*) AS rows FROM {table} GROUP BY {col}) g")


def _enum_sql(table: str, enums: dict) -> str:
    parts = []
    for c, vals in enums.items():
        lst = ", ".join(f"'{v}'" for v in vals)
        parts.append(f"SELECT '{table}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, "
                     f"COUNT(*) AS rows FROM {table} WHERE {c} IS NULL OR {c} NOT IN ({lst}) GROUP BY {c}")
    return " UNION ALL ".join(parts)


def _humanize(x: str) -> str:
    small = f"regexp_replace(printf('%.3f', {R(x, 3)}), '\\.?0+$', '')"
    return (f"CASE WHEN {x} IS NULL OR {x} = 0 THEN '0' "
            f"WHEN {x} >= 1e6 THEN printf('%.1f', {R(f'{x} / 1e6', 1)}) || 'M' "
            f"WHEN {x} >= 1e3 THEN printf('%.1f', {R(f'{x} / 1e3', 1)}) || 'K' ELSE {small} END")


def oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    q["gates_scope1"] = with_ctes(_gate_sql("ghg_scope1", gates.SCOPE1_GATES) + """
UNION ALL
SELECT 'GATE-S1-04' AS gate_id, 'fail' AS severity,
       CAST(COUNT(*) FILTER (WHERE o.n > COALESCE(i.n, 0)) AS BIGINT) AS failed_rows,
       COUNT(*) FILTER (WHERE o.n > COALESCE(i.n, 0)) = 0 AS passed
FROM (SELECT reporting_year, COUNT(*) AS n FROM ghg_scope1 GROUP BY reporting_year) o
LEFT JOIN (SELECT reporting_year, COUNT(DISTINCT facility_id) AS n FROM s1_base GROUP BY reporting_year) i
  ON o.reporting_year = i.reporting_year""", ["ghg_scope1", "s1_base"])
    q["gates_scope2"] = with_ctes(_gate_sql("s1_base", gates.SCOPE2_INPUT_GATES) + " UNION ALL "
                                  + _gate_sql("ghg_scope2", gates.SCOPE2_GATES), ["s1_base", "ghg_scope2"])
    q["gates_scope3"] = with_ctes(_gate_sql("ghg_scope3", gates.SCOPE3_GATES), ["ghg_scope3"])
    q["gates_agg"] = with_ctes(_gate_sql("agg_with_totals", gates.AGG_GATES) + """
UNION ALL
SELECT 'GATE-AGG-06' AS gate_id, 'fail' AS severity, CAST(COUNT(*) AS BIGINT) AS failed_rows, COUNT(*) = 0 AS passed
FROM (SELECT metric_key, reporting_year FROM agg_with_totals GROUP BY 1, 2 HAVING COUNT(*) > 1) d""",
                               ["agg_with_totals"])
    q["enum_violations"] = with_ctes(
        _enum_sql("energy_consumption", gates.ENERGY_ENUMS) + " UNION ALL " + _enum_sql("loan_portfolio", gates.LOAN_ENUMS),
        ["energy_consumption", "loan_portfolio"])
    q["run_summary_scope1"] = with_ctes(" UNION ALL ".join(
        f"SELECT COUNT(*) AS rows, '{m}' AS measure, {R(f'SUM({m})', 4)} AS total, {R(f'AVG({m})', 6)} AS mean, "
        f"MAX({m}) AS maximum "
        f"FROM ghg_scope1" for m in ["scope1_tco2e", "scope1_natgas_tco2e", "scope1_diesel_tco2e"]),
        ["ghg_scope1"])
    for fam in ["ids", "ranges", "share_in_range", "not_null", "enums", "meter", "unique", "cross",
                "cardinality", "year_end"]:
        q[f"dq_{fam}"] = _dq_sql({fam})
    tgt = " UNION ALL ".join(f"SELECT {k!r}e0 AS s, {v!r}e0 AS target_pct" for k, v in C.PCAF_TARGET_PCT.items())
    q["dq_pcaf_distribution"] = with_ctes(f"""
SELECT COALESCE(c.s, t.s) AS pcaf_data_quality_score, CAST(COALESCE(c.loans, 0) AS BIGINT) AS loans,
       COALESCE(c.pct, 0e0) AS pcaf_pct_tmp, t.target_pct,
       COALESCE(ABS(COALESCE(c.pct, 0e0) - t.target_pct) <= 5e0, false) AS within_tolerance
FROM (SELECT s, loans, {R('loans * 100e0 / SUM(loans) OVER ()', 2)} AS pct
      FROM (SELECT pcaf_data_quality_score AS s, COUNT(*) AS loans FROM loan_portfolio GROUP BY 1) g) c
FULL JOIN ({tgt}) t ON c.s = t.s""", ["loan_portfolio"]).replace("pcaf_pct_tmp", "pct")
    q["dq_profile"] = with_ctes(
        _profile_sql("energy_consumption", ["electricity_kwh", "natural_gas_gj", "diesel_liters", "srec_mwh_claimed",
                                            "grid_ef_kgco2_kwh", "meter_reading_kwh"]) + " UNION ALL "
        + _profile_sql("loan_portfolio", ["outstanding_idr", "total_equity_idr", "total_debt_idr",
                                          "pcaf_attribution_factor", "borrower_emissions_tco2e",
                                          "pcaf_data_quality_score"],
                         integral=("outstanding_idr", "total_equity_idr", "total_debt_idr")),
        ["energy_consumption", "loan_portfolio"])
    q["dq_category_shares"] = with_ctes(" UNION ALL ".join([
        _shares_sql("energy_consumption", "data_source"), _shares_sql("energy_consumption", "record_status"),
        _shares_sql("loan_portfolio", "sector_nace"), _shares_sql("loan_portfolio", "loan_type")]),
        ["energy_consumption", "loan_portfolio"])
    q["dq_orphans"] = with_ctes("""
SELECT 'energy_consumption' AS table_name, 'facility_id' AS fk_column, COUNT(*) AS orphan_rows
FROM energy_consumption e WHERE NOT EXISTS (SELECT 1 FROM facility_dim f WHERE f.facility_id = e.facility_id)
UNION ALL
SELECT 'loan_portfolio', 'borrower_id', COUNT(*)
FROM loan_portfolio l WHERE NOT EXISTS (SELECT 1 FROM borrower_dim b WHERE b.borrower_id = l.borrower_id)""",
                                ["energy_consumption", "loan_portfolio", "facility_dim", "borrower_dim"])
    # ------------------------------------------------------------ serving
    fields14 = ("metric_key, scope1_tco2e, scope1_natgas_tco2e, scope1_diesel_tco2e, scope2_location_tco2e, "
                "scope2_market_tco2e, scope3_cat15_gross_tco2e, scope3_cat15_weighted_tco2e, "
                "intensity_tco2e_per_idr_bn, intensity_tco2e_per_fte")
    bank = f"starts_with(metric_key, '{C.BANK_ID}_')"
    q["summary_for_year"] = with_ctes(
        f"SELECT {fields14}, yoy_change_pct, vs_base_year_change_pct, avg_pcaf_data_quality, assurance_level "
        f"FROM ghg_summary_annual WHERE reporting_year = {Y} AND {bank}", ["ghg_summary_annual"])
    q["summary_for_year_sql"] = q["summary_for_year"]
    q["prior_year_summary"] = with_ctes(
        f"SELECT {fields14} FROM ghg_summary_annual WHERE reporting_year = {Y - 1} AND {bank}", ["ghg_summary_annual"])
    q["sector_top10"] = with_ctes(f"""
SELECT sector_nace, sector_display_name, loan_count, borrower_count, total_outstanding_idr_trillion,
       financed_emissions_gross_tco2e, financed_emissions_weighted_tco2e, emission_intensity_per_idr_bn,
       avg_pcaf_score, pct_of_total_portfolio, pct_of_total_financed_emissions, yoy_change_emissions_pct
FROM pcaf_by_sector WHERE reporting_year = {Y}
ORDER BY financed_emissions_gross_tco2e DESC, sector_nace LIMIT 10""", ["pcaf_by_sector"])
    q["facility_top10"] = with_ctes(f"""
SELECT facility_id, scope1_tco2e, scope1_natgas_tco2e, scope1_diesel_tco2e, total_natgas_gj,
       total_diesel_liters, data_quality_score
FROM top_fac WHERE reporting_year = {Y} ORDER BY scope1_tco2e DESC, facility_id LIMIT 10""", ["top_fac"])
    q["hr_metrics"] = with_ctes(f"""
SELECT reporting_year, fte_total, fte_female_pct, fte_management_female_pct, new_hire_count,
       voluntary_turnover_pct, training_hours_per_fte, discrimination_cases,
       {R('CAST(new_hire_count AS DOUBLE) / CAST(fte_total AS DOUBLE) * 100e0', 2)} AS hiring_rate_pct,
       CAST({R('CAST(fte_total AS DOUBLE) * (fte_female_pct / 100e0)', 0)} AS INTEGER) AS female_headcount,
       CAST({R('CAST(fte_total AS DOUBLE) * (1e0 - fte_female_pct / 100e0)', 0)} AS INTEGER) AS male_headcount
FROM hr_metrics WHERE reporting_year IN ({Y}, {Y - 1})""", ["hr_metrics"])
    bundle = with_ctes(f"""
SELECT {Y} AS reporting_year, '{C.BANK_ID}' AS bank_id, x.* FROM (
  SELECT 'ghg_summary' AS part, 1 AS pos, '{Y}' AS label, scope1_tco2e AS amount, yoy_change_pct AS change FROM ghg_summary_annual WHERE reporting_year = {Y} AND {bank}
  UNION ALL SELECT 'prior_year', 1, '{Y - 1}', scope1_tco2e, NULL FROM ghg_summary_annual WHERE reporting_year = {Y - 1} AND {bank}
  UNION ALL SELECT 'pcaf_sectors', CAST(row_number() OVER (ORDER BY financed_emissions_gross_tco2e DESC, sector_nace) AS INTEGER), sector_nace,
                   financed_emissions_gross_tco2e, yoy_change_emissions_pct FROM pcaf_by_sector WHERE reporting_year = {Y} QUALIFY row_number() OVER (ORDER BY financed_emissions_gross_tco2e DESC, sector_nace) <= 10
  UNION ALL SELECT 'scope1_facilities', CAST(row_number() OVER (ORDER BY scope1_tco2e DESC, facility_id) AS INTEGER), facility_id, scope1_tco2e, NULL
            FROM top_fac WHERE reporting_year = {Y} QUALIFY row_number() OVER (ORDER BY scope1_tco2e DESC, facility_id) <= 10
  UNION ALL SELECT 'hr_metrics', CAST(row_number() OVER (ORDER BY reporting_year DESC) AS INTEGER), CAST(reporting_year AS VARCHAR), CAST(fte_total AS DOUBLE),
                   {R('CAST(new_hire_count AS DOUBLE) / CAST(fte_total AS DOUBLE) * 100e0', 2)} FROM hr_metrics WHERE reporting_year IN ({Y}, {Y - 1})) x""",
                       ["ghg_summary_annual", "pcaf_by_sector", "top_fac", "hr_metrics"])
    q["data_bundle_rows"] = bundle
    six = lambda c: f"coalesce(CAST(CAST(CAST({c} AS VARCHAR) AS DECIMAL(38,6)) AS VARCHAR), '~')"
    q["bundle_digest"] = (f"SELECT reporting_year, bank_id, substr(sha256(string_agg(part || '|' || pos || '|' || label || '|' || {six('amount')} || '|' || {six('change')}, "
                          f"chr(10) ORDER BY part, pos)), 1, 16) AS digest FROM ({bundle}) b GROUP BY 1, 2")
    q["hr_yoy"] = with_ctes(f"""
SELECT c.reporting_year,
       {R('CASE WHEN CAST(p.fte_total AS DOUBLE) <> 0 THEN (CAST(c.fte_total AS DOUBLE) - CAST(p.fte_total AS DOUBLE)) / CAST(p.fte_total AS DOUBLE) * 100e0 END', 2)} AS yoy_headcount_change_pct,
       {R('CASE WHEN p.voluntary_turnover_pct <> 0 THEN (c.voluntary_turnover_pct - p.voluntary_turnover_pct) / p.voluntary_turnover_pct * 100e0 END', 2)} AS yoy_turnover_change_pct,
       {R('CASE WHEN p.training_hours_per_fte <> 0 THEN (c.training_hours_per_fte - p.training_hours_per_fte) / p.training_hours_per_fte * 100e0 END', 2)} AS yoy_training_change_pct,
       {R('c.fte_female_pct - p.fte_female_pct', 2)} AS female_pct_change_pp,
       {R('c.fte_management_female_pct - p.fte_management_female_pct', 2)} AS mgmt_female_pct_change_pp
FROM hr_metrics c LEFT JOIN hr_metrics p ON p.reporting_year = c.reporting_year - 1""", ["hr_metrics"])
    q["trend"] = with_ctes(f"""
SELECT reporting_year, scope1_tco2e, scope2_market_tco2e, scope2_location_tco2e, scope3_cat15_gross_tco2e,
       {R('scope1_tco2e + scope2_market_tco2e + scope3_cat15_gross_tco2e', 3)} AS total_tco2e, yoy_change_pct
FROM ghg_summary_annual WHERE {bank} ORDER BY reporting_year""", ["ghg_summary_annual"])
    q["sum_check"] = with_ctes(f"""
SELECT reporting_year, total_tco2e,
       {R('scope1_tco2e + scope2_market_tco2e + scope3_cat15_gross_tco2e', 3)} AS computed_total_tco2e,
       {R('total_tco2e - ' + R('scope1_tco2e + scope2_market_tco2e + scope3_cat15_gross_tco2e', 3), 6)} AS discrepancy
FROM agg_with_totals""", ["agg_with_totals"])
    q["pcaf_consistency"] = with_ctes(f"""
SELECT sector_nace, reporting_year,
       {R('financed_emissions_weighted_tco2e - financed_emissions_gross_tco2e', 2)} AS excess_tco2e
FROM ghg_scope3 WHERE financed_emissions_weighted_tco2e - financed_emissions_gross_tco2e > 0""", ["ghg_scope3"])
    q["available_years"] = with_ctes("SELECT DISTINCT reporting_year FROM ghg_summary_annual", ["ghg_summary_annual"])
    q["typed_values"] = with_ctes("""
SELECT metric_key, measure,
       CASE WHEN NOT contains(cell, '.') THEN TRY_CAST(cell AS BIGINT) END AS cell_int,
       CASE WHEN contains(cell, '.') THEN TRY_CAST(cell AS DOUBLE) END AS cell_float
FROM (SELECT metric_key, measure, CAST(value AS VARCHAR) AS cell FROM summary_long) x""", ["summary_long"])
    # ------------------------------------------------------------ dashboard
    q["total_kpi"] = with_ctes(f"""
SELECT reporting_year, {R('COALESCE(scope1_tco2e, 0e0) + COALESCE(scope2_location_tco2e, 0e0) + COALESCE(scope3_cat15_gross_tco2e, 0e0)', 3)} AS total_emissions_location_tco2e
FROM ghg_summary_annual""", ["ghg_summary_annual"])
    fragment("breakdown_long", """
SELECT reporting_year, 'scope' AS chart, 'Scope 1' AS category, COALESCE(scope1_tco2e, 0e0) AS value FROM ghg_summary_annual
UNION ALL SELECT reporting_year, 'scope', 'Scope 2', COALESCE(scope2_location_tco2e, 0e0) FROM ghg_summary_annual
UNION ALL SELECT reporting_year, 'scope', 'Scope 3', COALESCE(scope3_cat15_gross_tco2e, 0e0) FROM ghg_summary_annual
UNION ALL SELECT reporting_year, 'scope1_source', 'Natural Gas', COALESCE(scope1_natgas_tco2e, 0e0) FROM ghg_summary_annual
UNION ALL SELECT reporting_year, 'scope1_source', 'Diesel', COALESCE(scope1_diesel_tco2e, 0e0) FROM ghg_summary_annual""",
             ["ghg_summary_annual"])
    q["scope_breakdown"] = with_ctes(f"""
SELECT reporting_year, chart, category, value,
       {R('CASE WHEN SUM(value) OVER (PARTITION BY reporting_year, chart) > 0 THEN value / SUM(value) OVER (PARTITION BY reporting_year, chart) * 100e0 ELSE 0e0 END', 1)} AS share_pct
FROM breakdown_long""", ["breakdown_long"])
    pairs = [("scope2_basis", "Location", "scope2_location_tco2e", None),
             ("scope2_basis", "Market", "scope2_market_tco2e", None),
             ("yoy_scope", "Scope 1", "scope1_tco2e", "scope1_tco2e"),
             ("yoy_scope", "Scope 2", "scope2_location_tco2e", "scope2_location_tco2e"),
             ("yoy_scope", "Scope 3", "scope3_cat15_gross_tco2e", "scope3_cat15_gross_tco2e"),
             ("intensity", "Per IDR Bn", "intensity_tco2e_per_idr_bn", "intensity_tco2e_per_idr_bn"),
             ("intensity", "Per FTE", "intensity_tco2e_per_fte", "intensity_tco2e_per_fte")]
    q["scope_yoy_pairs"] = with_ctes(" UNION ALL ".join(
        f"SELECT c.reporting_year, '{a}' AS chart, '{b}' AS category, COALESCE(c.{m}, 0e0) AS current_value, "
        f"{'CAST(NULL AS DOUBLE)' if pm is None else f'COALESCE(p.{pm}, 0e0)'} AS prior_value "
        f"FROM ghg_summary_annual c LEFT JOIN ghg_summary_annual p ON p.reporting_year = c.reporting_year - 1"
        for a, b, m, pm in pairs), ["ghg_summary_annual"])
    q["sector_concentration"] = with_ctes("""
SELECT reporting_year, rank, sector_nace, substr(COALESCE(sector_display_name, ''), 1, 15) AS label_emissions,
       substr(COALESCE(sector_display_name, ''), 1, 12) AS label_short, financed_emissions_gross_tco2e,
       pct_of_total_portfolio, avg_pcaf_score, rank <= 8 AS in_emissions_chart, rank <= 6 AS in_portfolio_chart,
       CASE WHEN avg_pcaf_score <= 2 THEN 'good' WHEN avg_pcaf_score <= 3.5 THEN 'medium' ELSE 'poor' END AS score_colour
FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY reporting_year
                     ORDER BY financed_emissions_gross_tco2e DESC, sector_nace) AS INTEGER) AS rank
      FROM pcaf_by_sector) r WHERE rank <= 8""", ["pcaf_by_sector"])
    q["pcaf_tiers"] = with_ctes("""
SELECT y.reporting_year, t.tier_no, t.tier, CAST(COALESCE(c.n, 0) AS BIGINT) AS sectors,
       CAST(CASE WHEN COALESCE(c.n, 0) = 0 THEN 1 ELSE c.n END AS BIGINT) AS display_value
FROM (SELECT DISTINCT reporting_year FROM pcaf_by_sector) y
JOIN (VALUES ('Good (<=2)', 1), ('Medium (2-3.5)', 2), ('Poor (>3.5)', 3)) t(tier, tier_no) ON true
LEFT JOIN (SELECT reporting_year, tier_no, COUNT(*) AS n FROM (
             SELECT reporting_year,
                    CASE WHEN s <= 2 THEN 1 WHEN s <= 3.5 THEN 2 ELSE 3 END AS tier_no
             FROM (SELECT reporting_year, CASE WHEN COALESCE(avg_pcaf_score, 0e0) = 0 THEN 3e0
                                               ELSE avg_pcaf_score END AS s FROM pcaf_by_sector) a) b
           GROUP BY 1, 2) c ON c.reporting_year = y.reporting_year AND c.tier_no = t.tier_no""", ["pcaf_by_sector"])
    q["gender_hiring"] = with_ctes(f"""
SELECT reporting_year, COALESCE(fte_female_pct, 0e0) AS female_pct, 100e0 - COALESCE(fte_female_pct, 0e0) AS male_pct,
       COALESCE(voluntary_turnover_pct, 0e0) AS turnover_pct,
       CAST(COALESCE(CASE WHEN COALESCE(new_hire_count, 0) > 0 AND COALESCE(fte_total, 0) > 0
            THEN {R('CAST(new_hire_count AS DOUBLE) / CAST(fte_total AS DOUBLE) * 100', 0)} END, 0e0) AS INTEGER) AS hiring_rate_pct
FROM hr_metrics""", ["hr_metrics"])
    q["kpi_humanized"] = with_ctes(f"SELECT *, {_humanize('value')} AS display FROM summary_long", ["summary_long"])
    q["stacked_totals"] = with_ctes(f"""
SELECT reporting_year, category, value,
       {R('COALESCE(SUM(value) OVER (PARTITION BY reporting_year ORDER BY category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)', 3)} AS bottom,
       {R('SUM(value) OVER (PARTITION BY reporting_year)', 3)} AS category_total
FROM breakdown_long WHERE chart = 'scope'""", ["breakdown_long"])
    tot = lambda a: f"{a}.scope1_tco2e + {a}.scope2_market_tco2e + {a}.scope3_cat15_gross_tco2e"
    q["waterfall"] = with_ctes(f"""
SELECT chart_id, step_no, kind, label, {R('value', 3)} AS value,
       {R("CASE WHEN kind = 'total' THEN 0e0 WHEN value >= 0 THEN lvl - value ELSE lvl END", 3)} AS bottom,
       {R('ABS(value)', 3)} AS height,
       CASE WHEN kind = 'total' THEN 'total' WHEN value >= 0 THEN 'up' ELSE 'down' END AS direction
FROM (SELECT *, SUM(value) OVER (PARTITION BY chart_id, grp ORDER BY step_no ROWS UNBOUNDED PRECEDING) AS lvl
      FROM (SELECT *, SUM(CASE WHEN kind = 'total' THEN 1 ELSE 0 END)
                        OVER (PARTITION BY chart_id ORDER BY step_no ROWS UNBOUNDED PRECEDING) AS grp
            FROM (SELECT c.reporting_year AS chart_id, s.step_no, s.kind, s.label,
                         {R('CASE s.step_no WHEN 1 THEN ' + tot('p') + ' WHEN 2 THEN c.scope1_tco2e - p.scope1_tco2e WHEN 3 THEN c.scope2_market_tco2e - p.scope2_market_tco2e WHEN 4 THEN c.scope3_cat15_gross_tco2e - p.scope3_cat15_gross_tco2e ELSE ' + tot('c') + ' END', 3)} AS value
                  FROM ghg_summary_annual c JOIN ghg_summary_annual p ON p.reporting_year = c.reporting_year - 1
                  JOIN (VALUES (1, 'total', 'prior total'), (2, 'delta', 'scope 1'), (3, 'delta', 'scope 2 market'),
                               (4, 'delta', 'scope 3'), (5, 'total', 'current total')) s(step_no, kind, label) ON true
                 ) a) b) c""", ["ghg_summary_annual"])
    q["run_log_rollup"] = f"""
SELECT event_type AS status, COUNT(*) AS runs, {R('SUM(value)', 2)} AS total_duration_s,
       {R('AVG(value)', 4)} AS mean_duration_s, MAX(ts) AS latest_start
FROM events GROUP BY event_type"""
    q["run_log_latest"] = f"""
SELECT event_id AS run_id, event_type AS status, ts AS start_ts,
       ts + to_microseconds(CAST(CAST(value AS DECIMAL(18,6)) * 1000000 AS BIGINT)) AS stop_ts,
       {R('value', 3)} AS duration_s
FROM events ORDER BY ts DESC, event_id DESC LIMIT 20"""
    q["run_log_latest_errors"] = f"""
SELECT event_id AS run_id, event_type AS status, ts AS start_ts,
       ts + to_microseconds(CAST(CAST(value AS DECIMAL(18,6)) * 1000000 AS BIGINT)) AS stop_ts,
       {R('value', 3)} AS duration_s
FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20"""
    q["documents_by_category"] = f"""
SELECT source AS category, COUNT(*) AS documents, SUM(n_chars) AS total_chars,
       {R('AVG(n_chars) / 1024e0', 2)} AS avg_size_kb, COUNT(DISTINCT lang) AS languages
FROM documents GROUP BY source"""
    return q
