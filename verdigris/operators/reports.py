"""Report tables the original leaves to prompt text or hard-codes, computed from data.

Inputs are the yearly aggregates (a few rows per year) and the tables that a
bank keeps by hand (governance facts, peer figures, playbook rules), except the portfolio
tables, which read the loan book with partial aggregates and a per-year
top-k window (WindowGroupLimit before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.exprs import dround, pct_change, trend_class
from .scope3 import loan_emissions, validated, with_reject_reason

# FIXED VALUES: regulator indicator rows (number, indicator, unit, shown metric, metric judged, its change or value,
# condition, target, state when the condition holds)
INDICATORS = [
    (1, "Total GHG emissions (scope 1+2+3)", "tCO2e", "total_tco2e", "total_tco2e", "change", "< 0", "Annual reduction", "achieved"),
    (2, "Direct GHG emissions (scope 1)", "tCO2e", "scope1_tco2e", "scope1_tco2e", "change", "< 0", "Reduce diesel dependency", "achieved"),
    (3, "Energy indirect emissions (scope 2)", "tCO2e", "scope2_location_tco2e", "renewable_pct", "value", "> 0", "Procure renewable energy", "in progress"),
    (4, "Financed emissions (scope 3 cat. 15)", "tCO2e", "scope3_cat15_gross_tco2e", "avg_pcaf_data_quality", "value", "< 3.0", "Improve PCAF score <3.0", "achieved"),
    (5, "Emission intensity", "tCO2e/IDR bn", "intensity_tco2e_per_idr_bn", "intensity_tco2e_per_idr_bn", "change", "< 0", "Annual intensity reduction", "achieved"),
    (6, "Energy consumption", "MWh", "total_energy_mwh", "total_energy_mwh", "change", "< -5", "Reduce 5% annually", "achieved"),
    (7, "Renewable energy share", "%", "renewable_pct", "renewable_pct", "value", ">= 10", ">=10%", "achieved"),
    (8, "Total employees", "FTE", "fte_total", None, None, None, "N/A", None),
    (9, "Female workforce share", "%", "fte_female_pct", "fte_female_pct", "value", ">= 40", ">=40%", "achieved"),
    (10, "Women in management", "%", "fte_management_female_pct", "fte_management_female_pct", "value", ">= 30", ">=30%", "achieved"),
    (11, "Average training hours", "hours/FTE", "training_hours_per_fte", "training_hours_per_fte", "value", ">= 40", ">=40 hours", "achieved"),
    (12, "Voluntary turnover rate", "%", "voluntary_turnover_pct", "voluntary_turnover_pct", "value", "< 10", "<10%", "achieved"),
    (13, "ESG board committee", "yes/no", "has_esg_committee", "has_esg_committee", "fact", "= 'yes'", "Established", "achieved"),
    (14, "Climate policy", "yes/no", "has_climate_policy", "has_climate_policy", "fact", "= 'yes'", "Approved", "achieved"),
    (15, "SBTi commitment", "status", "sbti_status", "sbti_status", "fact", "= 'Committed'", "Committed", "achieved"),
]

# FIXED VALUES: PCAF improvement path and target pathway
PCAF_PATH = [(1, -0.15), (2, -0.35)]
PCAF_PATH_FINAL = 3.0
TARGET_REDUCTION_PCT = 30.0
TARGET_YEAR = 2030


def metrics_by_year(summary: DataFrame, s2: DataFrame, hr: DataFrame, loans: DataFrame) -> DataFrame:
    """Wide per-year metric row: summary totals, energy, renewable share, HR, PCAF."""
    energy = s2.groupBy("reporting_year").agg(
        F.sum("total_consumption_mwh").alias("_mwh"), F.sum("rec_mwh_applied").alias("_rec"))
    energy = energy.select("reporting_year", dround("_mwh", 3).alias("total_energy_mwh"),
                           dround(F.when(F.col("_mwh") > 0, F.col("_rec") / F.col("_mwh") * 100), 2)
                           .alias("renewable_pct"))
    s = summary.select("reporting_year", "scope1_tco2e", "scope2_location_tco2e", "scope2_market_tco2e",
                       "scope3_cat15_gross_tco2e", "scope3_cat15_weighted_tco2e", "intensity_tco2e_per_idr_bn",
                       "intensity_tco2e_per_fte", "avg_pcaf_data_quality", "yoy_change_pct",
                       dround(F.col("scope1_tco2e") + F.col("scope2_market_tco2e")
                              + F.col("scope3_cat15_gross_tco2e"), 3).alias("total_tco2e"))
    h = hr.select("reporting_year", F.col("fte_total").cast("double").alias("fte_total"), "fte_female_pct",
                  "fte_management_female_pct", "training_hours_per_fte", "voluntary_turnover_pct")
    # one row per year on every side: bounded by the calendar
    return s.join(F.broadcast(energy), "reporting_year", "left").join(F.broadcast(h), "reporting_year", "left")


METRIC_COLUMNS = ["total_tco2e", "scope1_tco2e", "scope2_location_tco2e", "scope2_market_tco2e",
                  "scope3_cat15_gross_tco2e", "scope3_cat15_weighted_tco2e", "intensity_tco2e_per_idr_bn",
                  "intensity_tco2e_per_fte", "avg_pcaf_data_quality", "total_energy_mwh", "renewable_pct",
                  "fte_total", "fte_female_pct", "fte_management_female_pct", "training_hours_per_fte",
                  "voluntary_turnover_pct"]


def metrics_long(wide: DataFrame) -> DataFrame:
    """(year, metric, value, prior_value, change_pct) with the prior year exactly year-1."""
    long = wide.select("reporting_year", *[F.col(c).cast("double").alias(c) for c in METRIC_COLUMNS]) \
        .unpivot(["reporting_year"], METRIC_COLUMNS, "metric", "value")
    # prior value of exactly year-1 by window (one metric's years per group), no self-join
    w = Window.partitionBy("metric").orderBy("reporting_year").rangeBetween(-1, -1)
    j = long.withColumn("prior_value", F.max("value").over(w))
    return j.select("reporting_year", "metric", "value", "prior_value",
                    dround(pct_change("value", "prior_value"), 2).alias("change_pct"))


def _compare(x, op, thr):
    return (F.when(op == "<", x < thr).when(op == "<=", x <= thr).when(op == ">", x > thr)
             .when(op == ">=", x >= thr))


def governance_facts(governance: DataFrame) -> DataFrame:
    """The governance table's facts as text: yes, no, or the status."""
    yes = lambda c: F.when(F.col(c), "yes").when(~F.col(c), "no")
    return governance.select("reporting_year", yes("has_esg_committee").alias("has_esg_committee"),
                             yes("has_climate_policy").alias("has_climate_policy"), "sbti_status")


def indicator_table(wide: DataFrame, governance: DataFrame) -> DataFrame:
    """RP-01: indicator, current, prior, change, target and state of every year.

    All fifteen rows are read off one row per year that holds every metric
    beside its value of exactly the year before.
    """
    before = Window.partitionBy(F.lit(0)).orderBy("reporting_year").rangeBetween(-1, -1)   # one row per year
    known = wide.select("reporting_year", *[F.col(c).cast("double").alias(c) for c in METRIC_COLUMNS])
    known = known.select("*", *[F.max(c).over(before).alias(f"prior_{c}") for c in METRIC_COLUMNS])
    known = known.select("*", *[dround(pct_change(c, f"prior_{c}"), 2).alias(f"change_{c}") for c in METRIC_COLUMNS])
    known = known.join(governance_facts(governance), "reporting_year", "left")
    rows = []
    for no, indicator, unit, shown, judged, basis, condition, target, good in INDICATORS:
        numeric = shown in METRIC_COLUMNS
        subject = judged and (f"change_{judged}" if basis == "change" else judged)
        state = F.lit("n/a") if judged is None else F.when(F.expr(f"{subject} {condition}"), F.lit(good)).otherwise(F.lit("not achieved"))
        none = F.lit(None).cast("double")
        rows.append(F.struct(
            F.lit(no).alias("no"), F.lit(indicator).alias("indicator"), F.lit(unit).alias("unit"),
            (F.col(shown) if numeric else none).alias("current_value"),
            (F.lit(None).cast("string") if numeric else F.col(shown)).alias("current_text"),
            (F.col(f"prior_{shown}") if numeric else none).alias("prior_value"),
            (F.col(f"change_{shown}") if numeric else none).alias("change_pct"), F.lit(target).alias("target"), state.alias("achievement")))
    return known.select("reporting_year", F.inline(F.array(*rows)))


def scorecard(wide: DataFrame, governance: DataFrame) -> DataFrame:
    """RP-02: environmental rating by YoY +-3 %, social by female share and training hours, governance by its three facts."""
    wide = wide.join(governance_facts(governance), "reporting_year", "left")
    y = F.col("yoy_change_pct")
    env = F.when(y.isNull(), F.lit("n/a")).when(y < -3, F.lit("green")).when(y > 3, F.lit("red")) \
           .otherwise(F.lit("amber"))
    a = F.coalesce(F.col("fte_female_pct") >= 40, F.lit(False))
    b = F.coalesce(F.col("training_hours_per_fte") >= 30, F.lit(False))
    soc = F.when(a & b, F.lit("green")).when(a | b, F.lit("amber")).otherwise(F.lit("red"))
    facts = [F.coalesce(c, F.lit(False)).cast("int") for c in (F.col("has_esg_committee") == "yes", F.col("has_climate_policy") == "yes",
                                                               F.col("sbti_status") == "Committed")]
    held = facts[0] + facts[1] + facts[2]
    gov = F.when(F.col("sbti_status").isNull(), F.lit("n/a")).when(held == 3, F.lit("green")).when(held > 0, F.lit("amber")).otherwise(F.lit("red"))
    return wide.select("reporting_year", F.explode(F.array(
        F.struct(F.lit("Environmental").alias("dimension"), env.alias("rating"),
                 F.concat(F.lit("total YoY "), F.coalesce(y.cast("string"), F.lit("n/a")), F.lit("%")).alias("driver")),
        F.struct(F.lit("Social").alias("dimension"), soc.alias("rating"),
                 F.concat(F.lit("female "), F.col("fte_female_pct").cast("string"), F.lit("%, training "),
                          F.col("training_hours_per_fte").cast("string"), F.lit(" h")).alias("driver")),
        F.struct(F.lit("Governance").alias("dimension"), gov.alias("rating"),
                 F.concat(held.cast("string"), F.lit(" of 3 in place")).alias("driver")),
    )).alias("r")).select("reporting_year", "r.*")


def disclosure_flags(summary: DataFrame, s1: DataFrame, s2: DataFrame) -> DataFrame:
    """RP-03: conditional disclosures required for each year."""
    q1 = s1.groupBy("reporting_year").agg(F.max("data_quality_score").alias("max_score"))
    q2 = s2.groupBy("reporting_year").agg(F.max("rec_applied_pct").alias("max_rec_pct"))
    j = summary.join(F.broadcast(q1), "reporting_year", "left").join(F.broadcast(q2), "reporting_year", "left")
    flags = F.array_compact(F.array(
        F.when(F.col("max_score") >= 3, F.lit("imputation_footnote")),
        F.when(F.col("max_rec_pct") > 0, F.lit("market_based_method_paragraph")),
        F.when(F.col("yoy_change_pct").isNull(), F.lit("omit_yoy_paragraph")),
        F.when(F.col("assurance_level") == "none", F.lit("no_assurance_footnote")),
        F.when(F.col("avg_pcaf_data_quality") > 3.5, F.lit("pcaf_quality_roadmap")),
    ))
    return j.select("reporting_year", F.explode(flags).alias("disclosure"))


def playbook_actions(long: DataFrame, rules: DataFrame, gaps: DataFrame) -> DataFrame:
    """RP-04: the actions of ``rules`` (rule_id, metric, basis, op, threshold, action) that fire.

    A rule looks at a metric's change, its value, or its gap to the best peer
    (``gaps``: reporting_year, metric, gap_to_best).
    """
    known = long.join(gaps.select("reporting_year", "metric", "gap_to_best"), ["reporting_year", "metric"], "left")
    x = F.when(F.col("basis") == "change", F.col("change_pct")).when(F.col("basis") == "gap", F.col("gap_to_best")).otherwise(F.col("value"))
    fired = known.join(rules, "metric").filter(F.coalesce(_compare(x, F.col("op"), F.col("threshold")), F.lit(False)))
    return fired.select("reporting_year", "rule_id", "metric", "basis", x.alias("observed"), "action")


def confidence_at(score: "F.Column") -> "F.Column":
    """The PCAF confidence factor at any score, on straight lines between the published ones."""
    points = sorted(C.PCAF_CONFIDENCE.items())
    out = F.lit(points[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:]))):
        out = F.when(score <= x1, F.lit(y0) + (score - F.lit(x0)) * F.lit((y1 - y0) / (x1 - x0))).otherwise(out)
    return out


def pcaf_improvement(wide: DataFrame) -> DataFrame:
    """RP-06: PCAF score path (-0.15, -0.35, then below 3.0) and the confidence gap."""
    gap = dround(F.when(F.col("scope3_cat15_gross_tco2e") > 0,
                        (F.col("scope3_cat15_gross_tco2e") - F.col("scope3_cat15_weighted_tco2e"))
                        / F.col("scope3_cat15_gross_tco2e") * 100), 2)
    steps = [F.struct(F.lit(0).alias("step"), F.col("avg_pcaf_data_quality").alias("target_score"))]
    steps += [F.struct(F.lit(n).alias("step"), dround(F.col("avg_pcaf_data_quality") + F.lit(d), 2).alias("target_score"))
              for n, d in PCAF_PATH]
    steps += [F.struct(F.lit(3).alias("step"),
                       F.least(F.lit(PCAF_PATH_FINAL), F.col("avg_pcaf_data_quality")).alias("target_score"))]
    return wide.select("reporting_year", gap.alias("confidence_gap_pct"), F.explode(F.array(*steps)).alias("s")) \
        .select("reporting_year", (F.col("reporting_year") + F.col("s.step")).alias("target_year"),
                "s.step", "s.target_score", "confidence_gap_pct",
                dround((F.lit(1.0) - confidence_at(F.col("s.target_score"))) * 100, 2).alias("projected_gap_pct"))


def target_pathway(wide: DataFrame, reduction_pct: float = TARGET_REDUCTION_PCT,
                   target_year: int = TARGET_YEAR) -> DataFrame:
    """RP-07: compound annual rate needed to reach -X % by the target year vs the actual YoY."""
    years = F.lit(target_year) - F.col("reporting_year")
    req = F.when(years > 0, (F.lit(1.0) - F.pow(F.lit(1.0 - reduction_pct / 100.0), F.lit(1.0) / years)) * 100)
    actual = -F.col("yoy_change_pct")
    return wide.select("reporting_year", dround(req, 4).alias("required_annual_reduction_pct"),
                       dround(actual, 2).alias("actual_annual_reduction_pct"),
                       dround(F.when(actual > 0, req / actual), 2).alias("acceleration_factor"))


def kpi_cards(long: DataFrame, metrics: tuple[str, ...] = ("total_tco2e", "scope1_tco2e",
                                                           "scope2_location_tco2e", "avg_pcaf_data_quality")) -> DataFrame:
    """RP-08: KPI cards with a trend class from the change."""
    return long.filter(F.col("metric").isin(*metrics)).select(
        "reporting_year", "metric", "value", "change_pct", trend_class("change_pct").alias("trend"))


def portfolio_composition(loans: DataFrame) -> DataFrame:
    """RP-10: outstanding by loan type, share of total, and how much enters financed emissions."""
    r = with_reject_reason(loans)
    out = F.col("outstanding_idr").cast("decimal(38,0)")
    g = r.groupBy("reporting_year", "loan_type").agg(
        F.count(F.lit(1)).alias("loans"), F.sum(out).alias("_out"),
        F.sum(F.when(F.col("reject_reason").isNull(), out).otherwise(F.lit(0).cast("decimal(38,0)"))).alias("_inc"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("excluded_loans"),
        F.array_join(F.array_sort(F.collect_set("reject_reason")), ",").alias("exclusion_reasons"))   # four reasons
    tot = F.sum("_out").over(Window.partitionBy("reporting_year"))   # six loan types per year
    return g.select("reporting_year", "loan_type", "loans", "excluded_loans",
                    dround(F.col("_out").cast("double") / 1e12, 6).alias("outstanding_idr_trillion"),
                    dround(F.col("_out").cast("double") / tot.cast("double") * 100, 2).alias("pct_of_portfolio"),
                    dround(F.col("_inc").cast("double") / F.col("_out").cast("double") * 100, 2)
                    .alias("pct_included"), (F.col("excluded_loans") == 0).alias("fully_included"), "exclusion_reasons")


# FIXED VALUES: asset class of each loan type
ASSET_CLASSES = {"term_loan": "Business Loans", "revolving_credit": "Business Loans", "syndicated_loan": "Business Loans", "leasing": "Business Loans",
                 "project_finance": "Project Finance", "mortgage": "Retail Mortgages"}
REJECT_REASONS = ("ev_null", "ev_nonpositive", "emissions_null", "emissions_nonpositive")


def portfolio_by_asset_class(loans: DataFrame) -> DataFrame:
    """RP-10: outstanding by asset class and loan type, with sub-totals and the year's total, from one aggregate.

    ``level`` is 0 for a loan type, 1 for an asset class, 3 for the year; what is
    left out of financed emissions is counted by reason.
    """
    r = with_reject_reason(loans)
    kind = F.create_map(*[F.lit(x) for pair in ASSET_CLASSES.items() for x in pair])
    r = r.withColumn("asset_class", F.coalesce(F.try_element_at(kind, F.col("loan_type")), F.lit("Other")))
    out = F.col("outstanding_idr").cast("decimal(38,0)")
    keys = ["reporting_year", "asset_class", "loan_type"]
    g = r.groupingSets([keys, keys[:2], keys[:1]], *keys).agg(
        F.grouping_id(*keys).cast("int").alias("level"), F.count(F.lit(1)).alias("loans"), F.sum(out).alias("_out"),
        F.sum(F.when(F.col("reject_reason").isNull(), out).otherwise(F.lit(0).cast("decimal(38,0)"))).alias("_inc"),
        *[F.count_if(F.col("reject_reason") == x).alias(f"excluded_{x}") for x in REJECT_REASONS])
    total = F.max(F.when(F.col("level") == 3, F.col("_out"))).over(Window.partitionBy("reporting_year"))   # a few rows a year
    return g.select(*keys, "level", "loans", dround(F.col("_out").cast("double") / 1e12, 6).alias("outstanding_idr_trillion"),
                    dround(F.col("_out").cast("double") / total.cast("double") * 100, 2).alias("pct_of_portfolio"),
                    dround(F.col("_inc").cast("double") / F.col("_out").cast("double") * 100, 2).alias("pct_included"),
                    *[f"excluded_{x}" for x in REJECT_REASONS])


def what_if_gap(loans: DataFrame, k: int = 50, from_score: float = 4.0, to_score: float = 3.0) -> DataFrame:
    """RP-11: confidence gap (share of financed emissions that the confidence takes away) now, and with the top-k borrowers' scores improved."""
    b = validated(loans).groupBy("reporting_year", "borrower_id").agg(F.sum(F.col("outstanding_idr").cast("double")).alias("b_out"))
    w = Window.partitionBy("reporting_year").orderBy(F.desc("b_out"), F.asc("borrower_id"))
    top = b.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("reporting_year", "borrower_id", F.lit(True).alias("top"))
    # at most k borrowers per reporting year: bounded by k x years
    j = loan_emissions(loans)[0].join(F.broadcast(top), ["reporting_year", "borrower_id"], "left")
    gross = F.col("financed_emissions_loan_tco2e")
    moved = F.when(F.col("top") & (F.col("pcaf_data_quality_score") == from_score), F.lit(C.PCAF_CONFIDENCE[to_score])).otherwise(F.col("confidence_factor"))
    gap = lambda conf: dround((F.lit(1.0) - F.sum(gross * conf) / F.sum(gross)) * 100, 4)
    return j.groupBy("reporting_year").agg(gap(F.col("confidence_factor")).alias("confidence_gap_pct"), gap(moved).alias("projected_gap_pct"))


def score_what_if(loans: DataFrame, k: int = 50, from_score: float = 4.0, to_score: float = 3.0) -> DataFrame:
    """RP-11: move the top-k borrowers (by outstanding) from score 4 to 3; new weighted score."""
    v = validated(loans)
    b = v.groupBy("reporting_year", "borrower_id").agg(F.sum(F.col("outstanding_idr").cast("double")).alias("b_out"))
    w = Window.partitionBy("reporting_year").orderBy(F.desc("b_out"), F.asc("borrower_id"))
    top = b.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("reporting_year", "borrower_id")
    # at most k borrowers per reporting year: bounded by k x years
    j = v.join(F.broadcast(top.withColumn("top", F.lit(True))), ["reporting_year", "borrower_id"], "left")
    out = F.col("outstanding_idr").cast("double")
    moved = F.when(F.col("top") & (F.col("pcaf_data_quality_score") == from_score), F.lit(to_score)) \
             .otherwise(F.col("pcaf_data_quality_score"))
    return j.groupBy("reporting_year").agg(
        dround(F.sum(out * F.col("pcaf_data_quality_score")) / F.sum(out), 4).alias("weighted_score"),
        dround(F.sum(out * moved) / F.sum(out), 4).alias("weighted_score_after"),
        dround(F.sum(F.when(F.col("top"), out).otherwise(0.0)) / F.sum(out) * 100, 2).alias("top_share_pct"),
        F.count_if(F.col("top") & (F.col("pcaf_data_quality_score") == from_score)).alias("loans_moved"))


def score_concentration(loans: DataFrame) -> DataFrame:
    """RP-11: outstanding share per PCAF score and the score with the highest share."""
    v = validated(loans)
    g = v.groupBy("reporting_year", "pcaf_data_quality_score").agg(
        F.sum(F.col("outstanding_idr").cast("decimal(38,0)")).alias("_out"))
    w = Window.partitionBy("reporting_year")                          # six scores per year
    r = Window.partitionBy("reporting_year").orderBy(F.desc("_out"), F.asc("pcaf_data_quality_score"))
    return g.select("reporting_year", "pcaf_data_quality_score",
                    dround(F.col("_out").cast("double") / F.sum("_out").over(w).cast("double") * 100, 2)
                    .alias("pct_of_outstanding"),
                    (F.row_number().over(r) == 1).alias("highest"))


def imputation_note(s1: DataFrame) -> DataFrame:
    """RP-12: imputed months and affected facilities where the quality score is 3 or worse."""
    f = s1.filter(F.col("data_quality_score") >= 3)
    return f.groupBy("reporting_year").agg(
        F.sum("imputed_months").cast("bigint").alias("imputed_months"),
        F.count_distinct("facility_id").alias("facilities"),
        F.max("data_quality_score").alias("worst_score"))


def peer_gap(long: DataFrame, peers: DataFrame) -> DataFrame:
    """RP-05: own value vs ``peers`` (metric, peer, pvalue, higher_is_better): best in class, gap to best, rank among own + peers.

    Own rows (one per year and metric) meet the peers by an equi-join on the
    metric; rank = 1 + peers strictly better; a tie for best goes to the peer.
    """
    sgn = lambda c: F.when(F.col("higher_is_better"), F.col(c)).otherwise(-F.col(c))
    j = long.select("reporting_year", "metric", "value").join(peers, "metric")
    g = j.groupBy("reporting_year", "metric", "value", "higher_is_better").agg(
        F.count_if(sgn("pvalue") > sgn("value")).alias("better"),
        F.max(F.struct(sgn("pvalue").alias("s"), F.col("peer"), F.col("pvalue"))).alias("bp"),
        F.count(F.lit(1)).alias("peers"))
    own_best = sgn("value") > F.col("bp.s")
    best_value = F.when(own_best, F.col("value")).otherwise(F.col("bp.pvalue"))
    return g.select("reporting_year", "metric", F.col("value").alias("own_value"), best_value.alias("best_value"),
                    F.when(own_best, F.lit("own")).otherwise(F.col("bp.peer")).alias("best_bank"),
                    dround(F.col("value") - best_value, 4).alias("gap_to_best"),
                    (F.col("better") + 1).cast("int").alias("rank"), (F.col("peers") + 1).alias("banks"))


# FIXED VALUES: report section -> framework disclosure references
FRAMEWORKS = ["GRI 305", "IFRS S2", "ESRS E1", "OJK PSPK"]
DISCLOSURES = [
    ("Scope 1 Emissions", "scope1", ["305-1 (a-g)", "Para 29(a)(i)", "DR E1-6 §44", "Lampiran II.A.1"]),
    ("Scope 2 Emissions", "scope2", ["305-2 (a-e)", "Para 29(a)(ii)", "DR E1-6 §47-48", "Lampiran II.A.2"]),
    ("Scope 3 / Financed", "scope3_pcaf", ["305-3 (a-f)", "Para 29(a)(iv)", "DR E1-6 §51-54", "Lampiran II.A.3"]),
    ("Intensity", "intensity", ["305-4 (a-d)", "Para 29(b)", "DR E1-6 §55-56", "Lampiran II.B"]),
    ("Reduction Targets", "targets", ["305-5 (a-e)", "Para 33-36", "DR E1-4 §34-42", "Lampiran II.C"]),
    ("Governance", "governance", [None, "Para 5-9", "ESRS 2 GOV-1", "Lampiran I"]),
    ("Transition Plan", "transition", [None, "Para 14-15", "DR E1-1 §14-19", "Lampiran III"]),
    ("Social Metrics", "social", ["401/404/405/406", None, "ESRS S1", "Lampiran IV"]),
]


def disclosure_map(spark: SparkSession) -> DataFrame:
    """RP-09: flat (requirement, section_type, framework, disclosure_id) mapping."""
    rows = [(req, st, fw, ref) for req, st, refs in DISCLOSURES for fw, ref in zip(FRAMEWORKS, refs)]
    return spark.createDataFrame(rows, "requirement string, section_type string, framework string, "
                                       "disclosure_id string")


# FIXED VALUES: how a section's framework is written in the disclosure table
FRAMEWORK_COLUMNS = {"GRI_305": "GRI 305", "IFRS_S2": "IFRS S2", "CSRD_ESRS_E1": "ESRS E1", "OJK_PSPK": "OJK PSPK"}


def nested_disclosures(spark: SparkSession) -> DataFrame:
    """section_type, requirement, references (array of framework and disclosure_id): the mapping as a template keeps it."""
    rows = [(st, req, [(fw, ref) for fw, ref in zip(FRAMEWORKS, refs)]) for req, st, refs in DISCLOSURES]
    return spark.createDataFrame(rows, "section_type string, requirement string, references array<struct<framework: string, disclosure_id: string>>")


def section_disclosures(sections: DataFrame, nested: DataFrame) -> DataFrame:
    """RP-09: flat (section_key, requirement, framework, disclosure_id) of ``sections`` (section_key, section_type, framework).

    A section of one framework takes that one's reference; one of several (any other name) takes all.
    """
    named = F.create_map(*[F.lit(x) for pair in FRAMEWORK_COLUMNS.items() for x in pair])
    j = sections.select("section_key", "section_type", F.try_element_at(named, F.col("framework")).alias("own")).join(nested, "section_type")
    flat = j.select("section_key", "own", "requirement", F.explode("references").alias("r"))
    return flat.where((F.col("own").isNull() | (F.col("own") == F.col("r.framework"))) & F.col("r.disclosure_id").isNotNull()).select(
        "section_key", "requirement", "r.framework", "r.disclosure_id")


def compliance_matrix(spark: SparkSession, outcomes: DataFrame) -> DataFrame:
    """RP-09: requirement x framework status from the audited sections.

    disclosed = some section of the type passed; partial = included with
    warnings only; gap = no included section; n/a = the framework has no
    such disclosure. Outcomes reduce to one row per section type first.
    """
    st = outcomes.groupBy("section_type").agg(
        F.max(F.when(F.col("status") == "INCLUDED", 2)
               .when(F.col("status") == "INCLUDED_WITH_WARNINGS", 1).otherwise(0)).alias("level"))
    m = disclosure_map(spark).join(F.broadcast(st), "section_type", "left")
    status = (F.when(F.col("disclosure_id").isNull(), F.lit("n/a"))
               .when(F.col("level") == 2, F.lit("disclosed"))
               .when(F.col("level") == 1, F.lit("partial")).otherwise(F.lit("gap")))
    return (m.withColumn("status", status)
             .groupBy("requirement").pivot("framework", FRAMEWORKS).agg(F.first("status")))
