"""Governance gates as one aggregate pass.

A gate is (gate_id, severity, failing-row predicate). ``run_gates`` folds all
gates of a frame into a single ``agg(count_if(...))`` - partial aggregation
on every map task, one row through the shuffle - and unpivots the result to
``gate_results(gate_id, severity, failed_rows, passed)``. Nothing is
collected; a caller that must stop on a failed gate reads the one small
result row set.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions.exprs import dround


@dataclass(frozen=True)
class Gate:
    gate_id: str
    severity: str          # "fail" | "warn"
    predicate: str         # SQL boolean expression true on a failing row

    def failing(self) -> Column:
        return F.coalesce(F.expr(self.predicate), F.lit(False))


RESULT_SCHEMA = "gate_id string, severity string, failed_rows bigint, passed boolean"


def run_gates(df: DataFrame, gates: list[Gate]) -> DataFrame:
    """GOV-04..GOV-13: every gate of ``df`` in one pass."""
    counts = df.agg(*[F.count_if(g.failing()).alias(f"g{i}") for i, g in enumerate(gates)])
    pairs = ", ".join(f"'{g.gate_id}', '{g.severity}', g{i}" for i, g in enumerate(gates))
    return (counts.select(F.expr(f"stack({len(gates)}, {pairs}) AS (gate_id, severity, failed_rows)"))
                  .withColumn("failed_rows", F.col("failed_rows").cast("bigint"))
                  .withColumn("passed", F.col("failed_rows") == 0))


def per_key_gate(gate_id: str, severity: str, out: DataFrame, inp: DataFrame, key: str,
                 distinct_col: str) -> DataFrame:
    """GOV-07 (per year, D-07): output rows per key must not exceed distinct input entities."""
    o = out.groupBy(key).agg(F.count(F.lit(1)).alias("out_rows"))
    i = inp.groupBy(key).agg(F.count_distinct(distinct_col).alias("in_entities"))
    j = o.join(i, key, "left")
    return (j.agg(F.count_if(F.col("out_rows") > F.coalesce(F.col("in_entities"), F.lit(0))).alias("failed_rows"))
             .select(F.lit(gate_id).alias("gate_id"), F.lit(severity).alias("severity"),
                     F.col("failed_rows").cast("bigint").alias("failed_rows"),
                     (F.col("failed_rows") == 0).alias("passed")))


def key_uniqueness(gate_id: str, severity: str, df: DataFrame, keys: list[str]) -> DataFrame:
    """GOV-12: number of keys with more than one record."""
    d = df.groupBy(*keys).count().filter(F.col("count") > 1)
    return (d.agg(F.count(F.lit(1)).cast("bigint").alias("failed_rows"))
             .select(F.lit(gate_id).alias("gate_id"), F.lit(severity).alias("severity"), "failed_rows",
                     (F.col("failed_rows") == 0).alias("passed")))


# ----------------------------------------------------------------- gate sets
SCOPE1_GATES = [
    Gate("GATE-S1-01", "fail", "scope1_tco2e IS NULL"),
    Gate("GATE-S1-02", "fail", "scope1_tco2e < 0"),
    Gate("GATE-S1-03", "fail", "abs(scope1_tco2e - (scope1_natgas_tco2e + scope1_diesel_tco2e)) > 1e-4"),
    Gate("GATE-S1-05", "fail", "emission_factor_source IS NULL OR trim(emission_factor_source) = ''"),
    Gate("GATE-S1-06", "fail", "methodology IS NULL OR trim(methodology) = ''"),
]
SCOPE2_INPUT_GATES = [
    Gate("GATE-S2-05", "fail", "grid_ef_kgco2_kwh IS NULL"),
]
SCOPE2_GATES = [
    Gate("GATE-S2-01", "fail", "scope2_location_tco2e < 0"),
    Gate("GATE-S2-02", "fail", "scope2_market_tco2e < 0"),
    Gate("GATE-S2-03", "warn", "scope2_market_tco2e > scope2_location_tco2e"),
    Gate("GATE-S2-04", "warn", "total_consumption_mwh <= 0"),
]
SCOPE3_GATES = [
    Gate("GATE-S3-23", "fail", "financed_emissions_weighted_tco2e > financed_emissions_gross_tco2e"),
    Gate("GATE-S3-24", "fail", "loan_count <= 0"),
    Gate("GATE-S3-25", "fail", "avg_pcaf_score < 1.0 OR avg_pcaf_score > 5.0"),
]
AGG_GATES = [
    Gate("GATE-AGG-01", "fail",
         "abs(total_tco2e - (scope1_tco2e + scope2_market_tco2e + scope3_cat15_gross_tco2e)) > 1e-3"),
    Gate("GATE-AGG-02", "fail",
         "abs(total_location_based_tco2e - (scope1_tco2e + scope2_location_tco2e + scope3_cat15_gross_tco2e)) > 1e-3"),
    Gate("GATE-AGG-03", "fail", "scope3_cat15_weighted_tco2e > scope3_cat15_gross_tco2e"),
    Gate("GATE-AGG-04", "fail", "revenue_idr_bn > 0 AND NOT (intensity_tco2e_per_idr_bn > 0)"),
    Gate("GATE-AGG-05", "warn", "yoy_change_pct IS NOT NULL AND abs(yoy_change_pct) > 50"),
    Gate("GATE-AGG-07", "fail", "avg_pcaf_data_quality < 1.0 OR avg_pcaf_data_quality > 5.0"),
    Gate("GATE-AGG-08", "warn", "scope2_market_tco2e > scope2_location_tco2e"),
]


def scope1_gates(curated: DataFrame, energy: DataFrame) -> DataFrame:
    complete = energy.filter(F.col("record_status") == C.ENERGY_OK_STATUS)
    return run_gates(curated, SCOPE1_GATES).unionByName(
        per_key_gate("GATE-S1-04", "fail", curated, complete, "reporting_year", "facility_id"))


def scope2_gates(curated: DataFrame, energy: DataFrame) -> DataFrame:
    complete = energy.filter(F.col("record_status") == C.ENERGY_OK_STATUS)
    return run_gates(complete, SCOPE2_INPUT_GATES).unionByName(run_gates(curated, SCOPE2_GATES))


def scope3_gates(sector: DataFrame) -> DataFrame:
    return run_gates(sector, SCOPE3_GATES)


def agg_gates(summary_with_totals: DataFrame) -> DataFrame:
    # a key's second row, if it has one, counts for the key: uniqueness is checked in the same pass
    nth = F.row_number().over(Window.partitionBy("metric_key", "reporting_year").orderBy(F.lit(0)))
    return run_gates(summary_with_totals.withColumn("_nth", nth), [*AGG_GATES, Gate("GATE-AGG-06", "fail", "_nth = 2")])


# ----------------------------------------------------------------- schema / enum
_TYPE_NAMES = {T.StringType: "string", T.DoubleType: "double", T.LongType: "bigint",
               T.IntegerType: "int", T.BooleanType: "boolean", T.DateType: "date",
               T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp_ntz"}


def _type_name(dt: T.DataType) -> str:
    return _TYPE_NAMES.get(type(dt), dt.simpleString())


def schema_gate(df: DataFrame, contract: dict[str, str], table: str) -> DataFrame:
    """GOV-01: each column's state: ok, missing (fail), type_mismatch or unexpected (warn), with its rows and NULLs.

    One pass counts every column that is there; the state comes from the schema.
    """
    actual = {f.name: _type_name(f.dataType) for f in df.schema.fields}

    def state(c: str) -> tuple[str, str]:
        if c not in actual:
            return "missing", "fail"
        if c not in contract:
            return "unexpected", "warn"
        return ("ok", "none") if actual[c] == contract[c] else ("type_mismatch", "warn")

    text = lambda v: F.lit(v).cast("string")
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n_{c}") for c in actual])
    rows = [F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), F.lit(state(c)[0]).alias("kind"), F.lit(state(c)[1]).alias("severity"),
                     text(contract.get(c)).alias("expected_type"), text(actual.get(c)).alias("actual_type"), F.col("rows").alias("rows"),
                     (F.col("rows") - F.col(f"n_{c}") if c in actual else F.col("rows")).alias("nulls"))
            for c in [*contract, *(x for x in actual if x not in contract)]]
    return counts.select(F.inline(F.array(*rows)))


def null_month_gate(energy: DataFrame, most: int = 6) -> DataFrame:
    """GOV-13: facility-years with more than ``most`` months without an electricity reading."""
    return (energy.groupBy("facility_id", "reporting_year").agg(F.count_if(F.col("electricity_kwh").isNull()).alias("null_months"))
            .filter(F.col("null_months") > most))


def enum_gate(df: DataFrame, allowed: dict[str, tuple], table: str) -> DataFrame:
    """GOV-02: per checked column, rows outside the allowed set (NULL is invalid).

    All columns are checked in one pass: unpivot the checked columns, keep
    invalid cells, count per (column, value) with a partial aggregate.
    """
    cols = list(allowed)
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "column_name", "value")
    invalid = None
    for c, vals in allowed.items():
        cond = (F.col("column_name") == c) & (F.col("value").isNull() | ~F.col("value").isin(list(vals)))
        invalid = cond if invalid is None else invalid | cond
    return (long.filter(invalid).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("rows"))
                .select(F.lit(table).alias("table_name"), "column_name", "value", "rows"))


ENERGY_CONTRACT = {
    "facility_id": "string", "electricity_kwh": "double", "natural_gas_gj": "double",
    "diesel_liters": "double", "srec_mwh_claimed": "double", "grid_ef_kgco2_kwh": "double",
    "ef_source": "string", "meter_reading_kwh": "double", "data_source": "string",
    "record_status": "string", "reporting_year": "int", "reporting_month": "int",
}
LOAN_CONTRACT = {
    "loan_id": "string", "borrower_id": "string", "sector_nace": "string", "loan_type": "string",
    "currency": "string", "outstanding_idr": "bigint", "total_equity_idr": "bigint",
    "total_debt_idr": "bigint", "pcaf_attribution_factor": "double",
    "borrower_emissions_tco2e": "double", "pcaf_data_quality_score": "double",
    "record_status": "string", "reporting_year": "int",
}
HR_CONTRACT = {
    "period_date": "date", "fte_total": "int", "fte_female_pct": "double",
    "fte_management_female_pct": "double", "new_hire_count": "int", "voluntary_turnover_pct": "double",
    "training_hours_per_fte": "double", "discrimination_cases": "int", "reporting_year": "int",
}

ENERGY_ENUMS = {"ef_source": C.EF_SOURCES, "record_status": C.ENERGY_STATUSES,
                "data_source": C.DATA_SOURCES}
LOAN_ENUMS = {"sector_nace": C.SECTORS, "record_status": C.LOAN_STATUSES,
              "loan_type": C.LOAN_TYPES, "currency": C.CURRENCIES}


def run_summary(df: DataFrame, measures: list[str]) -> DataFrame:
    """GOV-16: count, sum, mean, max per measure in one aggregate."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for m in measures:
        aggs += [dround(F.sum(m), 4).alias(f"{m}__sum"), dround(F.avg(m), 6).alias(f"{m}__mean"),
                 F.max(m).alias(f"{m}__max")]
    a = df.agg(*aggs)
    parts = ", ".join(f"'{m}', `{m}__sum`, `{m}__mean`, `{m}__max`" for m in measures)
    return a.select("rows", F.expr(f"stack({len(measures)}, {parts}) AS (measure, total, mean, maximum)"))
