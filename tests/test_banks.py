"""Several banks in one summary, one's id a prefix of another's: nothing crosses from bank to bank."""

from verdigris.operators import aggregate, serving

BANKS = ("FI", "FI_1", "FI_1_2", "FI_10", "F")
FIELDS = list(dict.fromkeys([*serving.SUMMARY_FIELDS[1:], *aggregate.MEASURES, "scope2_market_tco2e", "scope2_location_tco2e", "scope1_tco2e", "scope3_cat15_gross_tco2e"]))


def summary(spark, banks=BANKS):
    rows = [(f"{b}_{y}", b, y, *[float(100 * (i + 1) + (y - 2000) * (i + 2) + n) if f != "assurance_level" else "none" for n, f in enumerate(FIELDS)])
            for i, b in enumerate(BANKS) if b in banks for y in (2000, 2001, 2003, 2004)]
    kinds = ", ".join(f"{f} {'string' if f == 'assurance_level' else 'double'}" for f in FIELDS)
    return spark.createDataFrame(rows, f"metric_key string, bank_id string, reporting_year int, {kinds}")


def test_serving_takes_one_bank(spark):
    every = summary(spark)
    for b in BANKS:
        own = summary(spark, (b,))
        for year in (2001, 2004):
            for got, want in ((serving.summary_for(every, year, b), serving.summary_for(own, year, b)),
                              (serving.summary_for_sql(spark, every, year, b), serving.summary_for(own, year, b)),
                              (serving.prior_summary(every, year, b), serving.prior_summary(own, year, b))):
                assert got.collect() == want.collect() and len(got.collect()) == 1
        assert serving.trend(every, b).collect() == serving.trend(own, b).collect()


def test_changes_stay_inside_a_bank(spark):
    every = summary(spark)
    keyed = lambda df: {(r.metric_key, r.measure): r for r in df.collect()}
    changes = lambda df: {r.metric_key: (r.yoy_change_pct, r.vs_base_year_change_pct) for r in
                          aggregate.with_year_changes(df.drop("yoy_change_pct", "vs_base_year_change_pct"), "scope1_tco2e", 2001).collect()}
    all_rows, all_changes = keyed(aggregate.yoy_by_measure(every)), changes(every)
    for b in BANKS:
        own = summary(spark, (b,))
        for k, r in keyed(aggregate.yoy_by_measure(own)).items():
            assert all_rows[k] == r and (r.prior_value is None) == (r.reporting_year in (2000, 2003))
        for k, r in changes(own).items():
            assert all_changes[k] == r
