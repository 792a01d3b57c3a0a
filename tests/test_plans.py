"""Physical-plan properties that matter at scale."""

from verdigris.plans import registry

from conftest import SF0001


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_uses_partial_window_group_limit(spark):
    p = plan_of(registry.queries()["scope1_top_facilities"](spark, SF0001))
    assert "WindowGroupLimit" in p


def test_status_filter_pushed_to_scan(spark, tmpdir_run):
    from verdigris.operators import scope3
    from verdigris.sources import zones
    from verdigris.sources.fixtures import inputs
    zones.write_zone(inputs(spark, SF0001).loans, tmpdir_run, "raw", "loan_portfolio")
    loans = zones.read_zone(spark, tmpdir_run, "raw", "loan_portfolio")
    p = plan_of(scope3.loan_emissions(loans)[0].select("loan_id", "financed_emissions_loan_tco2e"))
    assert "EqualTo(record_status,validated)" in p and "pcaf_attribution_factor" not in p


def test_scope1_shuffles_aggregated_rows_only(spark, tmpdir_run):
    from verdigris.operators import scope1
    from verdigris.sources import zones
    from verdigris.sources.fixtures import inputs
    zones.write_zone(inputs(spark, SF0001).energy, tmpdir_run, "raw", "energy_consumption", None, ("reporting_year", "reporting_month"))
    p = plan_of(scope1.facility_years(zones.read_zone(spark, tmpdir_run, "raw", "energy_consumption")))
    assert p.count("Exchange hashpartitioning") == 2 and "Window" not in p   # the months' means, and the facility-years


def test_no_python_udf_in_core_plans(spark):
    qs = registry.queries()
    for name in ["ghg_scope1", "ghg_scope2", "ghg_scope3_financed", "ghg_summary_annual", "pcaf_by_sector",
                 "audit_outcome", "audit_footnotes", "bm25_top5", "retrieval_with_fallback", "vector_top5", "indicator_table", "peer_gap", "scope2_ppa"]:
        p = plan_of(qs[name](spark, SF0001))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_monthly_means_broadcast(spark):
    p = plan_of(registry.queries()["scope1_imputed_monthly"](spark, SF0001))
    assert "BroadcastHashJoin" in p
