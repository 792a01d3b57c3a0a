"""Bulk raw-data audit: data-quality rules as data, one aggregate per table.

A rule is a SQL predicate (Spark SQL text; a DuckDB spelling only where the
dialects differ, e.g. regex). ``dq_report`` evaluates every rule of a table
in a single ``agg`` and unpivots to
``dq_results(table_name, family, rule, metric, threshold, passed)``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.exprs import dround
from ..functions.quantiles import exact_quantile


@dataclass(frozen=True)
class Rule:
    family: str
    rule: str
    kind: str                  # violations | share | distinct | duplicates
    pred: str                  # violations: failing row; share: ok row; distinct/duplicates: expression
    threshold: float = 0.0
    scope: str | None = None   # share: rows counted in the denominator
    duck: str | None = None    # DuckDB spelling of ``pred`` when it differs

    def metric(self) -> Column:
        if self.kind == "violations":
            return F.count_if(F.coalesce(F.expr(self.pred), F.lit(False))).cast("double")
        if self.kind == "share":
            scope = F.expr(self.scope) if self.scope else F.lit(True)
            ok = F.count_if(F.coalesce(scope & F.expr(self.pred), F.lit(False)))
            den = F.count_if(F.coalesce(scope, F.lit(False)))
            return dround(F.try_divide(ok.cast("double") * F.lit(100.0), den.cast("double")), 4)
        if self.kind == "distinct":
            return F.count_distinct(F.expr(self.pred)).cast("double")
        if self.kind == "duplicates":
            return (F.count(F.expr(self.pred)) - F.count_distinct(F.expr(self.pred))).cast("double")
        raise ValueError(self.kind)

    def passes(self, m: Column) -> Column:
        if self.kind in ("violations", "duplicates"):
            return m <= F.lit(self.threshold)
        return F.coalesce(m >= F.lit(self.threshold), F.lit(False))


def dq_report(df: DataFrame, rules: list[Rule], table: str) -> DataFrame:
    a = df.agg(*[r.metric().alias(f"m{i}") for i, r in enumerate(rules)])
    return a.select(F.explode(F.array(*[
        F.struct(F.lit(table).alias("table_name"), F.lit(r.family).alias("family"),
                 F.lit(r.rule).alias("rule"), F.col(f"m{i}").alias("metric"),
                 F.lit(float(r.threshold)).alias("threshold"), r.passes(F.col(f"m{i}")).alias("passed"))
        for i, r in enumerate(rules)])).alias("r")).select("r.*")


def _enum(col: str, vals) -> str:
    return f"{col} IS NULL OR {col} NOT IN ({', '.join(repr(v) for v in vals)})"


# FIXED VALUES: the reference's audit rules, thresholds as published
ENERGY_RULES = [
    Rule("ids", "facility_id_format", "violations", "NOT (facility_id RLIKE '^FAC-[0-9]{4,}$')",
         duck="NOT regexp_full_match(facility_id, 'FAC-[0-9]{4,}')"),
    Rule("ranges", "year_in_domain", "violations", f"reporting_year NOT BETWEEN {C.DQ_FIRST_YEAR} AND {C.DQ_LAST_YEAR}"),
    Rule("ranges", "month_1_12", "violations", "reporting_month NOT BETWEEN 1 AND 12"),
    Rule("ranges", "electricity_nonnegative", "violations", "electricity_kwh < 0"),
    Rule("ranges", "natural_gas_nonnegative", "violations", "natural_gas_gj < 0"),
    Rule("ranges", "diesel_nonnegative", "violations", "diesel_liters < 0"),
    Rule("ranges", "srec_nonnegative", "violations", "srec_mwh_claimed < 0"),
    Rule("ranges", "grid_ef_positive", "violations", "grid_ef_kgco2_kwh <= 0"),
    Rule("share_in_range", "electricity_1500_85000", "share", "electricity_kwh BETWEEN 1500 AND 85000",
         95.0, "electricity_kwh IS NOT NULL"),
    Rule("share_in_range", "natural_gas_0_120", "share", "natural_gas_gj BETWEEN 0 AND 120",
         95.0, "natural_gas_gj IS NOT NULL"),
    Rule("share_in_range", "diesel_0_3500", "share", "diesel_liters BETWEEN 0 AND 3500",
         95.0, "diesel_liters IS NOT NULL"),
    Rule("not_null", "srec_not_null", "violations", "srec_mwh_claimed IS NULL"),
    Rule("not_null", "grid_ef_not_null", "violations", "grid_ef_kgco2_kwh IS NULL"),
    Rule("enums", "ef_source_enum", "violations", _enum("ef_source", C.EF_SOURCES)),
    Rule("enums", "data_source_enum", "violations", _enum("data_source", C.DATA_SOURCES)),
    Rule("enums", "record_status_enum", "violations", _enum("record_status", C.ENERGY_STATUSES)),
    Rule("cross", "pln_source_ef_7886", "violations",
         "ef_source = 'PLN_Grid_Average_2023' AND abs(grid_ef_kgco2_kwh - 0.7886) > 1e-9"),
    Rule("meter", "meter_within_0_5pct", "share",
         "abs(meter_reading_kwh - electricity_kwh) <= 0.005 * electricity_kwh", 99.0,
         "meter_reading_kwh IS NOT NULL AND electricity_kwh IS NOT NULL"),
    Rule("cardinality", "facilities_at_least_200", "distinct", "facility_id", 200.0),
]

LOAN_RULES = [
    Rule("ids", "loan_id_format", "violations", "NOT (loan_id RLIKE '^LN-[0-9]{4}-[0-9]{7,}$')",
         duck="NOT regexp_full_match(loan_id, 'LN-[0-9]{4}-[0-9]{7,}')"),
    Rule("ids", "borrower_id_format", "violations", "NOT (borrower_id RLIKE '^BOR-[0-9]{6,}$')",
         duck="NOT regexp_full_match(borrower_id, 'BOR-[0-9]{6,}')"),
    Rule("enums", "sector_enum", "violations", _enum("sector_nace", C.SECTORS)),
    Rule("enums", "loan_type_enum", "violations", _enum("loan_type", C.LOAN_TYPES)),
    Rule("enums", "currency_enum", "violations", _enum("currency", C.CURRENCIES)),
    Rule("enums", "record_status_enum", "violations", _enum("record_status", C.LOAN_STATUSES)),
    Rule("enums", "pcaf_score_enum", "violations",
         "pcaf_data_quality_score IS NULL OR pcaf_data_quality_score NOT IN (1.0, 1.5, 2.0, 3.0, 4.0, 5.0)"),
    Rule("ranges", "outstanding_positive", "violations", "outstanding_idr <= 0"),
    Rule("ranges", "outstanding_5e8_2e12", "violations", "outstanding_idr NOT BETWEEN 500000000 AND 2000000000000"),
    Rule("ranges", "equity_1e9_5e13", "violations", "total_equity_idr NOT BETWEEN 1000000000 AND 50000000000000"),
    Rule("ranges", "debt_0_5e13", "violations", "total_debt_idr NOT BETWEEN 0 AND 50000000000000"),
    Rule("ranges", "enterprise_value_positive", "violations", "total_equity_idr + total_debt_idr <= 0"),
    Rule("ranges", "attribution_factor_0_1", "violations",
         "pcaf_attribution_factor IS NULL OR pcaf_attribution_factor <= 0 OR pcaf_attribution_factor > 1"),
    Rule("ranges", "emissions_500_5e6", "violations",
         "borrower_emissions_tco2e IS NULL OR borrower_emissions_tco2e NOT BETWEEN 500 AND 5000000"),
    Rule("cross", "outstanding_le_enterprise_value", "violations",
         "outstanding_idr > total_equity_idr + total_debt_idr"),
    Rule("cross", "attribution_factor_recomputed", "violations",
         "total_equity_idr + total_debt_idr > 0 AND abs(pcaf_attribution_factor - "
         "CAST(outstanding_idr AS DOUBLE) / CAST(total_equity_idr + total_debt_idr AS DOUBLE)) > 1e-6"),
    Rule("unique", "loan_id_unique", "duplicates", "loan_id"),
    Rule("cardinality", "borrowers_at_least_2000", "distinct", "borrower_id", 2000.0),
]

HR_RULES = [
    Rule("year_end", "period_date_dec_31", "violations",
         "NOT (month(period_date) = 12 AND dayofmonth(period_date) = 31)"),
    Rule("ranges", "fte_500_50000", "violations", "fte_total NOT BETWEEN 500 AND 50000"),
    Rule("ranges", "female_pct_0_100", "violations", "fte_female_pct NOT BETWEEN 0 AND 100"),
    Rule("ranges", "mgmt_female_pct_0_100", "violations", "fte_management_female_pct NOT BETWEEN 0 AND 100"),
    Rule("ranges", "turnover_pct_0_100", "violations", "voluntary_turnover_pct NOT BETWEEN 0 AND 100"),
    Rule("ranges", "new_hires_nonnegative", "violations", "new_hire_count < 0"),
    Rule("ranges", "training_8_120", "violations", "training_hours_per_fte NOT BETWEEN 8 AND 120"),
    Rule("ranges", "discrimination_nonnegative", "violations", "discrimination_cases < 0"),
]

TABLE_RULES = {"energy_consumption": ENERGY_RULES, "loan_portfolio": LOAN_RULES, "hr_metrics": HR_RULES}


def dq_family(frames: dict[str, DataFrame], families: set[str]) -> DataFrame:
    out = None
    for t, rules in TABLE_RULES.items():
        rs = [r for r in rules if r.family in families]
        if not rs:
            continue
        d = dq_report(frames[t], rs, t)
        out = d if out is None else out.unionByName(d)
    return out


def pcaf_distribution(loans: DataFrame, tolerance_points: float = 5.0) -> DataFrame:
    """DQ-10: share of loans per PCAF score vs the target share (+-5 points)."""
    spark = loans.sparkSession
    target = spark.createDataFrame([(k, v) for k, v in C.PCAF_TARGET_PCT.items()],
                                   "pcaf_data_quality_score double, target_pct double")
    c = loans.groupBy("pcaf_data_quality_score").agg(F.count(F.lit(1)).alias("loans"))
    # the grouped frame has one row per score value (six): a global window over it is tiny
    c = c.withColumn("pct", dround(F.col("loans") * F.lit(100.0) / F.sum("loans").over(Window.partitionBy()), 2))
    return (c.join(F.broadcast(target), "pcaf_data_quality_score", "full")
             .select("pcaf_data_quality_score", F.coalesce("loans", F.lit(0)).cast("bigint").alias("loans"),
                     F.coalesce("pct", F.lit(0.0)).alias("pct"), "target_pct",
                     F.coalesce(F.abs(F.coalesce("pct", F.lit(0.0)) - F.col("target_pct")) <= tolerance_points,
                                F.lit(False)).alias("within_tolerance")))


def profile(df: DataFrame, numeric: list[str], table: str, median: bool = False) -> DataFrame:
    """DQ-13: count, nulls, mean, min, max per numeric column, one pass.

    ``median`` adds the exact one, found by counts (see ``quantiles``).
    """
    aggs = [F.count(F.lit(1)).alias("rows")]
    types = dict(df.dtypes)
    for c in numeric:
        # integral columns are summed exactly (DECIMAL(38,0)); a BIGINT sum could overflow at scale
        total = (F.sum(F.col(c).cast("decimal(38,0)")) if types[c] in ("bigint", "int", "smallint")
                 else F.sum(c)).cast("double")
        aggs += [F.count(c).alias(f"{c}__n"), F.try_divide(total, F.count(c)).alias(f"{c}__mean"),
                 F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max")]
    medians = exact_quantile(df, numeric) if median else {}
    a = df.agg(*aggs)
    items = []
    for c in numeric:
        fields = [F.lit(table).alias("table_name"), F.lit(c).alias("column_name"),
                  F.col("rows").alias("rows"), (F.col("rows") - F.col(f"{c}__n")).alias("nulls"),
                  dround(f"{c}__mean", 4).alias("mean"), F.col(f"{c}__min").alias("min_value"),
                  F.col(f"{c}__max").alias("max_value")]
        if median:
            fields.append(F.lit(medians[c]).cast("double").alias("median"))
        items.append(F.struct(*fields))
    return a.select(F.explode(F.array(*items)).alias("r")).select("r.*")


def category_shares(df: DataFrame, column: str, table: str) -> DataFrame:
    """DQ-13: share of rows per category value (grouped rows, then a tiny window)."""
    c = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    return c.select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
                    F.col(column).cast("string").alias("value"), "rows",
                    dround(F.col("rows") * F.lit(100.0) / F.sum("rows").over(Window.partitionBy()), 2)
                    .alias("pct"))


def orphans(df: DataFrame, dim: DataFrame, key: str, table: str) -> DataFrame:
    """DQ-14: rows whose foreign key has no row in the master (left anti join)."""
    missing = df.select(key).join(dim.select(key), key, "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("orphan_rows")).select(
        F.lit(table).alias("table_name"), F.lit(key).alias("fk_column"), "orphan_rows")
