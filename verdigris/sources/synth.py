"""Distributed generator of raw energy and loan tables (SRC-11).

Re-aimed from a single-machine script: the entity lists come from the given
tables (facilities from ``supplier``, borrowers from ``customer``), months
come from ``explode(sequence)``, and every random draw is a pure function of
(seed, entity, period, stream) through ``xxhash64`` - no driver state, the
same rows on any cluster layout, and the output grows with the inputs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C

# generator parameters (ours): facility archetypes with shares, base monthly use
ARCHETYPES = [
    # type, share, base kWh, base gas GJ (None = no gas), base diesel L (None = none)
    ("branch", 0.68, 9000.0, None, 250.0),
    ("regional_office", 0.14, 30000.0, 18.0, 600.0),
    ("data_centre", 0.07, 70000.0, None, 2200.0),
    ("headquarters", 0.02, 60000.0, 90.0, 900.0),
    ("warehouse", 0.09, 5000.0, 6.0, 1200.0),
]


def uniform(seed: int, *parts) -> Column:
    """A uniform draw in [0, 1) from the hash of (seed, parts)."""
    h = F.xxhash64(F.lit(seed), *parts)
    return F.pmod(h, F.lit(2 ** 31)).cast("double") / F.lit(float(2 ** 31))


def normal(seed: int, *parts) -> Column:
    """Box-Muller standard normal from two hashed uniforms."""
    u1 = F.greatest(uniform(seed, *parts, F.lit("n1")), F.lit(1e-12))
    u2 = uniform(seed, *parts, F.lit("n2"))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def _padded(number: Column, digits: int) -> Column:
    """At least ``digits`` digits; longer numbers keep all of theirs."""
    s = number.cast("string")
    return F.lpad(s, F.greatest(F.lit(digits), F.length(s)), "0")


def _archetype(u: Column, field: int) -> Column:
    e = None
    acc = 0.0
    for a in ARCHETYPES:
        acc += a[1]
        v = F.lit(a[field])
        e = F.when(u < acc, v) if e is None else e.when(u < acc, v)
    return e.otherwise(F.lit(ARCHETYPES[-1][field]))


def synthesize_energy(supplier: DataFrame, years: tuple[int, ...] = (2023, 2024), seed: int = 42,
                      yoy_factor: float = 1.03) -> DataFrame:
    """facility x month energy rows: seasonality 1 + 0.15 sin, YoY factor, noise, gaps."""
    f = supplier.select(F.concat(F.lit("FAC-"), _padded(F.col("s_suppkey") + 1, 4))
                        .alias("facility_id"))
    f = f.withColumn("u_type", uniform(seed, F.col("facility_id"), F.lit("type")))
    months = F.explode(F.sequence(F.lit(0), F.lit(12 * len(years) - 1))).alias("m")
    r = f.select("facility_id", "u_type", months)
    y = F.lit(years[0]) + F.floor(F.col("m") / 12).cast("int")
    mo = (F.col("m") % 12 + 1).cast("int")
    season = F.lit(1.0) + F.lit(0.15) * F.sin(F.lit(2 * math.pi) * (mo - 1) / 12)
    growth = F.pow(F.lit(yoy_factor), y - F.lit(years[0]))
    key = (F.col("facility_id"), F.col("m"))
    noise = lambda s: F.lit(1.0) + F.lit(0.05) * normal(seed, *key, F.lit(s))
    kwh = _archetype(F.col("u_type"), 2) * season * growth * noise("kwh")
    gas = _archetype(F.col("u_type"), 3) * season * noise("gas")
    dsl = _archetype(F.col("u_type"), 4) * growth * noise("dsl")
    u_gap = uniform(seed, *key, F.lit("gap"))
    status = (F.when(u_gap < 0.03, F.lit("missing_primary")).when(u_gap < 0.05, F.lit("excluded"))
               .otherwise(F.lit("complete")))
    u_src = uniform(seed, *key, F.lit("src"))
    ef_src = F.when(u_src < 0.85, F.lit(C.EF_SOURCES[0])).when(u_src < 0.95, F.lit(C.EF_SOURCES[1])) \
              .otherwise(F.lit(C.EF_SOURCES[2]))
    ef = F.when(ef_src == C.EF_SOURCES[0], F.lit(0.7886)).when(ef_src == C.EF_SOURCES[1], F.lit(0.8012)) \
          .otherwise(F.lit(0.7950))
    out = r.select(
        "facility_id",
        F.when(status == "missing_primary", F.lit(None).cast("double")).otherwise(F.round(kwh, 2)).alias("electricity_kwh"),
        F.when(uniform(seed, *key, F.lit("gasnull")) < 0.08, F.lit(None).cast("double"))
         .otherwise(F.round(gas, 3)).alias("natural_gas_gj"),
        F.when(uniform(seed, *key, F.lit("dslnull")) < 0.08, F.lit(None).cast("double"))
         .otherwise(F.round(dsl, 2)).alias("diesel_liters"),
        F.lit(0.0).alias("srec_mwh_claimed"), ef.alias("grid_ef_kgco2_kwh"), ef_src.alias("ef_source"),
        F.round(kwh * (F.lit(1.0) + F.lit(0.002) * normal(seed, *key, F.lit("meter"))), 2).alias("meter_reading_kwh"),
        F.when(u_src < 0.7, F.lit("smart_meter_api")).when(u_src < 0.9, F.lit("manual_entry"))
         .otherwise(F.lit("estimate")).alias("data_source"),
        status.alias("record_status"), y.alias("reporting_year"), mo.alias("reporting_month"))
    return out


def synthesize_loans(customer: DataFrame, year: int = 2024, seed: int = 42) -> DataFrame:
    """One loan per borrower: log-normal equity, debt and outstanding, clamped and rounded to 1e6."""
    b = customer.select(F.col("c_custkey").cast("bigint").alias("c"))
    k = (F.col("c"),)
    lognorm = lambda mu, sig, s: F.exp(F.lit(mu) + F.lit(sig) * normal(seed, *k, F.lit(s)))
    equity = F.round(F.least(F.greatest(lognorm(27.0, 1.5, "eq"), F.lit(1e9)), F.lit(5e13)), -6).cast("bigint")
    debt = F.round(F.least(F.greatest(lognorm(26.5, 1.8, "debt"), F.lit(0.0)), F.lit(5e13)), -6).cast("bigint")
    ev = equity + debt
    out = F.least(F.round(F.least(F.greatest(lognorm(24.0, 1.2, "out"), F.lit(5e8)), F.lit(2e12)), -6).cast("bigint"),
                  ev)
    u_s = uniform(seed, *k, F.lit("score"))
    acc, score = 0.0, None
    for sc, pct in C.PCAF_TARGET_PCT.items():
        acc += pct / 100.0
        score = F.when(u_s < acc, F.lit(sc)) if score is None else score.when(u_s < acc, F.lit(sc))
    score = score.otherwise(F.lit(5.0))
    u_st = uniform(seed, *k, F.lit("status"))
    sector = F.element_at(F.array(*[F.lit(s) for s in C.SECTORS]),
                          (F.pmod(F.xxhash64(F.lit(seed), F.col("c"), F.lit("sector")), F.lit(len(C.SECTORS))) + 1)
                          .cast("int"))
    ltype = F.element_at(F.array(*[F.lit(s) for s in C.LOAN_TYPES]),
                         (F.pmod(F.xxhash64(F.lit(seed), F.col("c"), F.lit("type")), F.lit(len(C.LOAN_TYPES))) + 1)
                         .cast("int"))
    b = b.select("c", equity.alias("total_equity_idr"), debt.alias("total_debt_idr"), sector.alias("sector_nace"),
                  ltype.alias("loan_type"), score.alias("pcaf_data_quality_score"), u_st.alias("u_st"))
    b = b.withColumn("outstanding_idr", out)
    return b.select(
        F.concat(F.lit(f"LN-{year}-"), _padded(F.col("c"), 7)).alias("loan_id"),
        F.concat(F.lit("BOR-"), _padded(F.col("c"), 6)).alias("borrower_id"),
        "sector_nace", "loan_type",
        F.when(uniform(seed, *k, F.lit("ccy")) < 0.2, F.lit("USD")).otherwise(F.lit("IDR")).alias("currency"),
        "outstanding_idr", "total_equity_idr", "total_debt_idr",
        (F.col("outstanding_idr").cast("double") / (F.col("total_equity_idr") + F.col("total_debt_idr")).cast("double"))
        .alias("pcaf_attribution_factor"),
        F.round(F.least(F.greatest(lognorm(9.5, 1.6, "em"), F.lit(500.0)), F.lit(5e6)), 2).alias("borrower_emissions_tco2e"),
        "pcaf_data_quality_score",
        F.when(F.col("u_st") < 0.88, F.lit("validated")).when(F.col("u_st") < 0.96, F.lit("pending"))
         .otherwise(F.lit("rejected")).alias("record_status"),
        F.lit(year).alias("reporting_year"))
