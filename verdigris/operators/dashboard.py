"""Data frames behind the dashboard and report charts (drawing is not built).

Inputs are aggregated tables, so windows here run over a few rows per
year; the run-log roll-ups over ``events`` are a partial aggregate and a
top-k (TakeOrderedAndProject), both safe at any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import dround
from .aggregate import bank_of, with_prior_year


def total_kpi(summary: DataFrame) -> DataFrame:
    """DB-01: total on the location basis, NULL parts as 0 (D-12)."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return summary.select("reporting_year",
                          dround(z("scope1_tco2e") + z("scope2_location_tco2e") + z("scope3_cat15_gross_tco2e"), 3)
                          .alias("total_emissions_location_tco2e"))


def breakdown(summary: DataFrame) -> DataFrame:
    """DB-02: scope split and scope-1 source split in long format with shares."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    long = summary.select("reporting_year", F.explode(F.array(
        F.struct(F.lit("scope").alias("chart"), F.lit("Scope 1").alias("category"), z("scope1_tco2e").alias("value")),
        *[F.struct(F.lit(a).alias("chart"), F.lit(b).alias("category"), z(c).alias("value")) for a, b, c in [
            ("scope", "Scope 2", "scope2_location_tco2e"), ("scope", "Scope 3", "scope3_cat15_gross_tco2e"),
            ("scope1_source", "Natural Gas", "scope1_natgas_tco2e"),
            ("scope1_source", "Diesel", "scope1_diesel_tco2e")]])).alias("r")).select("reporting_year", "r.chart", "r.category", "r.value")
    tot = F.sum("value").over(Window.partitionBy("reporting_year", "chart"))
    return long.withColumn("share_pct", dround(F.when(tot > 0, F.col("value") / tot * F.lit(100.0))
                                               .otherwise(F.lit(0.0)), 1))


def year_pairs(summary: DataFrame) -> DataFrame:
    """DB-03: location vs market, current vs prior by scope, intensity current vs prior."""
    cols = ["scope1_tco2e", "scope2_location_tco2e", "scope3_cat15_gross_tco2e", "intensity_tco2e_per_idr_bn",
            "intensity_tco2e_per_fte"]
    j = with_prior_year(summary.withColumn("bank_id", bank_of()), cols)
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    items = [
        ("scope2_basis", "Location", z("scope2_location_tco2e"), F.lit(None).cast("double")),
        ("scope2_basis", "Market", z("scope2_market_tco2e"), F.lit(None).cast("double")),
        ("yoy_scope", "Scope 1", z("scope1_tco2e"), z("p_scope1_tco2e")),
        ("yoy_scope", "Scope 2", z("scope2_location_tco2e"), z("p_scope2_location_tco2e")),
        ("yoy_scope", "Scope 3", z("scope3_cat15_gross_tco2e"), z("p_scope3_cat15_gross_tco2e")),
        ("intensity", "Per IDR Bn", z("intensity_tco2e_per_idr_bn"), z("p_intensity_tco2e_per_idr_bn")),
        ("intensity", "Per FTE", z("intensity_tco2e_per_fte"), z("p_intensity_tco2e_per_fte")),
    ]
    return j.select("reporting_year", F.explode(F.array(*[
        F.struct(F.lit(a).alias("chart"), F.lit(b).alias("category"), c.alias("current_value"),
                 d.alias("prior_value")) for a, b, c, d in items])).alias("r")) \
            .select("reporting_year", "r.*")


def sector_concentration(sector: DataFrame, k_emissions: int = 8, k_portfolio: int = 6) -> DataFrame:
    """DB-04: top-8 sectors by emissions and top-6 portfolio slices per year, labels cut."""
    w = Window.partitionBy("reporting_year").orderBy(F.desc("financed_emissions_gross_tco2e"), F.asc("sector_nace"))
    r = sector.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(k_emissions, k_portfolio))
    return r.select("reporting_year", "rank", "sector_nace",
                    F.substring(F.coalesce("sector_display_name", F.lit("")), 1, 15).alias("label_emissions"),
                    F.substring(F.coalesce("sector_display_name", F.lit("")), 1, 12).alias("label_short"),
                    "financed_emissions_gross_tco2e", "pct_of_total_portfolio", "avg_pcaf_score",
                    (F.col("rank") <= k_emissions).alias("in_emissions_chart"),
                    (F.col("rank") <= k_portfolio).alias("in_portfolio_chart"),
                    F.when(F.col("avg_pcaf_score") <= 2, F.lit("good"))
                     .when(F.col("avg_pcaf_score") <= 3.5, F.lit("medium")).otherwise(F.lit("poor"))
                     .alias("score_colour"))


TIERS = [("Good (<=2)", 1), ("Medium (2-3.5)", 2), ("Poor (>3.5)", 3)]


def pcaf_tiers(sector: DataFrame) -> DataFrame:
    """DB-05: sectors per PCAF tier; NULL/0 score counts as 3; an empty tier shows 1."""
    s = F.when(F.coalesce(F.col("avg_pcaf_score"), F.lit(0.0)) == 0, F.lit(3.0)).otherwise(F.col("avg_pcaf_score"))
    tier = F.when(s <= 2, F.lit(1)).when(s <= 3.5, F.lit(2)).otherwise(F.lit(3))
    counts = sector.groupBy("reporting_year", tier.alias("tier_no")).agg(F.count(F.lit(1)).alias("n"))
    years = sector.select("reporting_year").distinct()
    # domain = years x the three fixed tiers, by exploding a literal array (no join)
    grid = years.select("reporting_year", F.explode(F.array(*[
        F.struct(F.lit(t).alias("tier"), F.lit(n).alias("tier_no")) for t, n in TIERS])).alias("d")) \
        .select("reporting_year", "d.tier", "d.tier_no")
    return (grid.join(counts, ["reporting_year", "tier_no"], "left")
                .select("reporting_year", "tier_no", "tier",
                        F.coalesce("n", F.lit(0)).cast("bigint").alias("sectors"),
                        F.when(F.coalesce("n", F.lit(0)) == 0, F.lit(1)).otherwise(F.col("n")).cast("bigint")
                        .alias("display_value")))


def gender_hiring(hr: DataFrame) -> DataFrame:
    """DB-06: female/male split and hiring rate as a whole percent."""
    z = F.coalesce(F.col("fte_female_pct"), F.lit(0.0))
    rate = F.when((F.coalesce("new_hire_count", F.lit(0)) > 0) & (F.coalesce("fte_total", F.lit(0)) > 0),
                  dround(F.col("new_hire_count").cast("double") / F.col("fte_total").cast("double") * 100, 0))
    return hr.select("reporting_year", z.alias("female_pct"), (F.lit(100.0) - z).alias("male_pct"),
                     F.coalesce("voluntary_turnover_pct", F.lit(0.0)).alias("turnover_pct"),
                     F.coalesce(rate, F.lit(0.0)).cast("int").alias("hiring_rate_pct"))


def humanize(c) -> "F.Column":
    """DB-07: 0/NULL -> '0'; >= 1e6 -> '1.2M'; >= 1e3 -> '3.4K'; else up to 3 decimals."""
    x = F.col(c) if isinstance(c, str) else c
    small = F.regexp_replace(F.format_string("%.3f", dround(x, 3)), r"\.?0+$", "")
    return (F.when(x.isNull() | (x == 0), F.lit("0"))
             .when(x >= 1e6, F.concat(F.format_string("%.1f", dround(x / F.lit(1e6), 1)), F.lit("M")))
             .when(x >= 1e3, F.concat(F.format_string("%.1f", dround(x / F.lit(1e3), 1)), F.lit("K")))
             .otherwise(small))


def kpi_humanized(long: DataFrame) -> DataFrame:
    return long.withColumn("display", humanize("value"))


def stacked_totals(long: DataFrame, category: str, series: str, value: str = "value") -> DataFrame:
    """DB-08: bar bottoms as the running sum of earlier series within a category."""
    w = Window.partitionBy(category).orderBy(series)
    return (long.withColumn("bottom", F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                                 F.lit(0.0)))
                .withColumn("category_total", F.sum(value).over(Window.partitionBy(category)))
                .withColumn("bottom", dround("bottom", 3))
                .withColumn("category_total", dround("category_total", 3)))


def waterfall(steps: DataFrame, key: str = "chart_id") -> DataFrame:
    """DB-09: steps (key, step_no, kind 'total'|'delta', value) -> bottom, height, direction.

    A total resets the running level; deltas accumulate from it.
    """
    w = Window.partitionBy(key).orderBy("step_no")
    g = steps.withColumn("grp", F.sum(F.when(F.col("kind") == "total", 1).otherwise(0))
                         .over(w.rowsBetween(Window.unboundedPreceding, 0)))
    wg = Window.partitionBy(key, "grp").orderBy("step_no").rowsBetween(Window.unboundedPreceding, 0)
    lvl = F.sum("value").over(wg)
    return (g.withColumn("level", lvl)
             .withColumn("bottom", F.when(F.col("kind") == "total", F.lit(0.0))
                         .when(F.col("value") >= 0, F.col("level") - F.col("value"))
                         .otherwise(F.col("level")))
             .withColumn("height", F.abs("value"))
             .withColumn("direction", F.when(F.col("kind") == "total", F.lit("total"))
                         .when(F.col("value") >= 0, F.lit("up")).otherwise(F.lit("down")))
             .select(key, "step_no", "kind", "label", dround("value", 3).alias("value"),
                     dround("bottom", 3).alias("bottom"), dround("height", 3).alias("height"), "direction"))


def emissions_bridge_steps(summary: DataFrame) -> DataFrame:
    """Waterfall input from the summary: prior total, change per scope, current total."""
    cols = ["scope1_tco2e", "scope2_market_tco2e", "scope3_cat15_gross_tco2e"]
    j = with_prior_year(summary.withColumn("bank_id", bank_of()), cols) \
        .filter(F.col("p_scope1_tco2e").isNotNull() | F.col("p_scope2_market_tco2e").isNotNull()
                | F.col("p_scope3_cat15_gross_tco2e").isNotNull())
    tot = lambda pre: (F.col(f"{pre}scope1_tco2e") + F.col(f"{pre}scope2_market_tco2e")
                       + F.col(f"{pre}scope3_cat15_gross_tco2e"))
    steps = [
        (1, "total", "prior total", tot("p_")),
        (2, "delta", "scope 1", F.col("scope1_tco2e") - F.col("p_scope1_tco2e")),
        (3, "delta", "scope 2 market", F.col("scope2_market_tco2e") - F.col("p_scope2_market_tco2e")),
        (4, "delta", "scope 3", F.col("scope3_cat15_gross_tco2e") - F.col("p_scope3_cat15_gross_tco2e")),
        (5, "total", "current total", tot("")),
    ]
    return j.select(F.col("reporting_year").alias("chart_id"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("step_no"), F.lit(k).alias("kind"), F.lit(lb).alias("label"),
                 dround(v, 3).alias("value")) for n, k, lb, v in steps])).alias("s")).select("chart_id", "s.*")


def run_log_rollup(log: DataFrame, status: str = "event_type", value: str = "value") -> DataFrame:
    """DB-10: runs per status with total and mean duration (partial aggregate)."""
    return log.groupBy(F.col(status).alias("status")).agg(
        F.count(F.lit(1)).alias("runs"),
        dround(F.sum(value), 2).alias("total_duration_s"),
        dround(F.avg(value), 4).alias("mean_duration_s"),
        F.max("ts").alias("latest_start"))


def run_log_latest(log: DataFrame, n: int = 20, only_status: str | None = None,
                   status: str = "event_type", value: str = "value") -> DataFrame:
    """DB-10: latest ``n`` runs by start time (top-k), optional status filter."""
    d = log if only_status is None else log.filter(F.col(status) == only_status)
    return (d.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
             .select(F.col("event_id").alias("run_id"), F.col(status).alias("status"),
                     F.col("ts").alias("start_ts"),
                     (F.col("ts") + F.make_dt_interval(secs=F.col(value).cast("decimal(18,6)"))).alias("stop_ts"),
                     dround(value, 3).alias("duration_s")))


def documents_by_category(docs: DataFrame, category: str = "source") -> DataFrame:
    """DB-11: documents per category with size statistics (no per-group lists)."""
    return docs.groupBy(F.col(category).alias("category")).agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("n_chars").alias("total_chars"),
        dround(F.avg("n_chars") / F.lit(1024.0), 2).alias("avg_size_kb"),
        F.countDistinct("lang").alias("languages"))
