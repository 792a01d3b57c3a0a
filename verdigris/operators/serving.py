"""Serving queries over the aggregated tables (dashboard / report inputs).

All inputs are the small aggregated tables (one row per year, per
sector-year or top-k facility-year); the parameterised filters are pushed
into the parquet scan when the tables are read from the aggregated zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.exprs import dround, pct_change

SUMMARY_FIELDS = ["metric_key", "scope1_tco2e", "scope1_natgas_tco2e", "scope1_diesel_tco2e",
                  "scope2_location_tco2e", "scope2_market_tco2e", "scope3_cat15_gross_tco2e",
                  "scope3_cat15_weighted_tco2e", "intensity_tco2e_per_idr_bn", "intensity_tco2e_per_fte",
                  "yoy_change_pct", "vs_base_year_change_pct", "avg_pcaf_data_quality", "assurance_level"]
PRIOR_FIELDS = SUMMARY_FIELDS[:10]
SECTOR_FIELDS = ["sector_nace", "sector_display_name", "loan_count", "borrower_count",
                 "total_outstanding_idr_trillion", "financed_emissions_gross_tco2e",
                 "financed_emissions_weighted_tco2e", "emission_intensity_per_idr_bn", "avg_pcaf_score",
                 "pct_of_total_portfolio", "pct_of_total_financed_emissions", "yoy_change_emissions_pct"]
FACILITY_FIELDS = ["facility_id", "scope1_tco2e", "scope1_natgas_tco2e", "scope1_diesel_tco2e",
                   "total_natgas_gj", "total_diesel_liters", "data_quality_score"]


def _bank(bank_id: str):
    """Rows of exactly this bank: a key is the bank's id, an underscore and the year (D-08: no LIKE, and no prefix that a longer id shares)."""
    return F.col("metric_key") == F.concat(F.lit(bank_id + "_"), F.col("reporting_year").cast("string"))


def summary_for(summary: DataFrame, year: int, bank_id: str = C.BANK_ID) -> DataFrame:
    """SRV-01."""
    return summary.filter((F.col("reporting_year") == year) & _bank(bank_id)).select(*SUMMARY_FIELDS)


def summary_for_sql(spark, summary: DataFrame, year: int, bank_id: str = C.BANK_ID) -> DataFrame:
    """SRV-01 through the SQL API: named parameters instead of formatted strings (D-08)."""
    return spark.sql(
        "SELECT " + ", ".join(SUMMARY_FIELDS) + " FROM {summary} "
        "WHERE reporting_year = :year AND metric_key = :key",
        args={"year": year, "key": f"{bank_id}_{year}"}, summary=summary)


def prior_summary(summary: DataFrame, year: int, bank_id: str = C.BANK_ID) -> DataFrame:
    """SRV-03: the year before ``year``."""
    return summary.filter((F.col("reporting_year") == year - 1) & _bank(bank_id)).select(*PRIOR_FIELDS)


def sector_top(sector: DataFrame, year: int, k: int = 10) -> DataFrame:
    """SRV-02: top-k sectors by gross financed emissions (TakeOrderedAndProject)."""
    return (sector.filter(F.col("reporting_year") == year)
            .orderBy(F.desc("financed_emissions_gross_tco2e"), F.asc("sector_nace"))
            .limit(k).select(*SECTOR_FIELDS))


def facility_top(top_facilities: DataFrame, year: int, k: int = 10) -> DataFrame:
    """SRV-04."""
    return (top_facilities.filter(F.col("reporting_year") == year)
            .orderBy(F.desc("scope1_tco2e"), F.asc("facility_id")).limit(k).select(*FACILITY_FIELDS))


def hr_metrics(hr: DataFrame, year: int) -> DataFrame:
    """SRV-05: current and prior year with hiring rate and headcount split."""
    fte = F.col("fte_total").cast("double")
    return (hr.filter(F.col("reporting_year").isin(year, year - 1))
            .select("reporting_year", "fte_total", "fte_female_pct", "fte_management_female_pct",
                    "new_hire_count", "voluntary_turnover_pct", "training_hours_per_fte",
                    "discrimination_cases",
                    dround(F.col("new_hire_count").cast("double") / fte * F.lit(100.0), 2).alias("hiring_rate_pct"),
                    dround(fte * (F.col("fte_female_pct") / F.lit(100.0)), 0).cast("int").alias("female_headcount"),
                    dround(fte * (F.lit(1.0) - F.col("fte_female_pct") / F.lit(100.0)), 0).cast("int")
                    .alias("male_headcount")))


def hr_yoy(hr: DataFrame) -> DataFrame:
    """SRV-06: each year paired with exactly the year before (self join on year - 1).

    Percent change for headcount, turnover, training; percentage points for
    the two female shares; NULL when the prior year or value is missing.
    """
    c = hr.alias("c")
    p = hr.select(*[F.col(x).alias(f"p_{x}") for x in hr.columns])
    j = c.join(p, F.col("p_reporting_year") == F.col("reporting_year") - 1, "left")
    return j.select(
        "reporting_year",
        dround(pct_change(F.col("fte_total").cast("double"), F.col("p_fte_total").cast("double")), 2)
        .alias("yoy_headcount_change_pct"),
        dround(pct_change("voluntary_turnover_pct", "p_voluntary_turnover_pct"), 2).alias("yoy_turnover_change_pct"),
        dround(pct_change("training_hours_per_fte", "p_training_hours_per_fte"), 2).alias("yoy_training_change_pct"),
        dround(F.col("fte_female_pct") - F.col("p_fte_female_pct"), 2).alias("female_pct_change_pp"),
        dround(F.col("fte_management_female_pct") - F.col("p_fte_management_female_pct"), 2)
        .alias("mgmt_female_pct_change_pp"))


def trend(summary: DataFrame, bank_id: str = C.BANK_ID) -> DataFrame:
    """SRV-07: multi-year trend with the computed total, ordered by year."""
    total = dround(F.col("scope1_tco2e") + F.col("scope2_market_tco2e") + F.col("scope3_cat15_gross_tco2e"), 3)
    return (summary.filter(_bank(bank_id))
            .select("reporting_year", "scope1_tco2e", "scope2_market_tco2e", "scope2_location_tco2e",
                    "scope3_cat15_gross_tco2e", total.alias("total_tco2e"), "yoy_change_pct")
            .orderBy("reporting_year"))


def sum_check(summary_with_totals: DataFrame) -> DataFrame:
    """SRV-09: stored total against the sum of its rounded parts."""
    j = summary_with_totals
    computed = dround(F.col("scope1_tco2e") + F.col("scope2_market_tco2e") + F.col("scope3_cat15_gross_tco2e"), 3)
    return j.select("reporting_year", "total_tco2e", computed.alias("computed_total_tco2e"),
                    dround(F.col("total_tco2e") - computed, 6).alias("discrepancy"))


def available_years(summary: DataFrame) -> DataFrame:
    """SRV-11."""
    return summary.select("reporting_year").distinct()


def typed_values(df: DataFrame, column: str) -> DataFrame:
    """SRV-10: string cells typed as int when integral text, float when it has a '.', else NULL."""
    s = F.col(column)
    return df.withColumn(f"{column}_int", F.when(~s.contains("."), s.try_cast("bigint"))) \
             .withColumn(f"{column}_float", F.when(s.contains("."), s.try_cast("double")))


def data_input_bundle(summary: DataFrame, sector: DataFrame, top_fac: DataFrame, hr: DataFrame,
                      year: int, bank_id: str = C.BANK_ID) -> DataFrame:
    """SRV-08: one row holding the five serving results as nested JSON.

    Every nested list is a top-k or a two-row result, so the collected
    arrays are bounded; empty results become ``{}`` / ``[]``.
    """
    parts = [
        summary_for(summary, year, bank_id).select(F.lit("ghg_summary").alias("part"),
                                                   F.to_json(F.struct("*")).alias("json")),
        prior_summary(summary, year, bank_id).select(F.lit("prior_year").alias("part"),
                                                     F.to_json(F.struct("*")).alias("json")),
        sector_top(sector, year).agg(F.lit("pcaf_sectors").alias("part"),
                                     F.to_json(F.collect_list(F.struct(*SECTOR_FIELDS))).alias("json")),
        facility_top(top_fac, year).agg(F.lit("scope1_facilities").alias("part"),
                                        F.to_json(F.collect_list(F.struct(*FACILITY_FIELDS))).alias("json")),
        hr_metrics(hr, year).agg(F.lit("hr_metrics").alias("part"),
                                 F.to_json(F.collect_list(F.struct("*"))).alias("json")),
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    pick = {name: F.max(F.when(F.col("part") == name, F.col("json"))) for name in
            ["ghg_summary", "prior_year", "pcaf_sectors", "scope1_facilities", "hr_metrics"]}
    return u.agg(
        F.lit(year).alias("reporting_year"), F.lit(bank_id).alias("bank_id"),
        F.coalesce(pick["ghg_summary"], F.lit("{}")).alias("ghg_summary_json"),
        F.coalesce(pick["prior_year"], F.lit("{}")).alias("prior_year_json"),
        F.coalesce(pick["pcaf_sectors"], F.lit("[]")).alias("pcaf_sectors_json"),
        F.coalesce(pick["scope1_facilities"], F.lit("[]")).alias("scope1_facilities_json"),
        F.coalesce(pick["hr_metrics"], F.lit("[]")).alias("hr_metrics_json"))


def data_input(summary: DataFrame, sector: DataFrame, top_fac: DataFrame, hr: DataFrame, year: int, bank_id: str = C.BANK_ID) -> DataFrame:
    """SRV-08: one row with the five serving results as typed columns: structs, and arrays of structs in rank order.

    Lists are top-k or two-row results, so they are bounded; a list without rows is empty, a struct without a row NULL.
    """
    by = {"pcaf_sectors": (sector_top(sector, year), SECTOR_FIELDS, (F.desc("financed_emissions_gross_tco2e"), F.asc("sector_nace"))),
          "scope1_facilities": (facility_top(top_fac, year), FACILITY_FIELDS, (F.desc("scope1_tco2e"), F.asc("facility_id"))),
          "hr_metrics": (hr_metrics(hr, year), None, (F.desc("reporting_year"),))}
    parts = [summary_for(summary, year, bank_id).select(F.struct("*").alias("ghg_summary")),
             prior_summary(summary, year, bank_id).select(F.struct("*").alias("prior_year"))]
    for name, (rows, fields, order) in by.items():
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))   # ten rows at most
        parts.append(ranked.agg(F.array_sort(F.collect_list(F.struct("rank", *(fields or [c for c in rows.columns])))).alias(name)))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    one = u.agg(*(F.first(c, ignorenulls=True).alias(c) for c in u.columns))
    return one.select(F.lit(year).alias("reporting_year"), F.lit(bank_id).alias("bank_id"), "ghg_summary", "prior_year",
                      *(F.coalesce(n, F.array().cast(one.schema[n].dataType)).alias(n) for n in by))


def bundle_rows(bundle: DataFrame) -> DataFrame:
    """reporting_year, bank_id, part, pos, label, amount, change: the bundle's parts as flat rows."""
    item = lambda part, pos, label, amount, change: F.struct(
        F.lit(part).alias("part"), pos.cast("int").alias("pos"), label.cast("string").alias("label"),
        amount.cast("double").alias("amount"), change.cast("double").alias("change"))
    of = lambda name, f: F.transform(name, f)
    year, none = F.col("reporting_year"), F.lit(None)
    found = F.concat(
        F.array_compact(F.array(
            F.when(F.col("ghg_summary").isNotNull(), item("ghg_summary", F.lit(1), year, F.col("ghg_summary.scope1_tco2e"), F.col("ghg_summary.yoy_change_pct"))),
            F.when(F.col("prior_year").isNotNull(), item("prior_year", F.lit(1), year - 1, F.col("prior_year.scope1_tco2e"), none)))),
        of("pcaf_sectors", lambda r: item("pcaf_sectors", r["rank"], r["sector_nace"], r["financed_emissions_gross_tco2e"], r["yoy_change_emissions_pct"])),
        of("scope1_facilities", lambda r: item("scope1_facilities", r["rank"], r["facility_id"], r["scope1_tco2e"], none)),
        of("hr_metrics", lambda r: item("hr_metrics", r["rank"], r["reporting_year"], r["fte_total"], r["hiring_rate_pct"])))
    return bundle.select("reporting_year", "bank_id", F.explode(found).alias("r")).select("reporting_year", "bank_id", "r.*")
