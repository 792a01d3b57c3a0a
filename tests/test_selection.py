"""Exact quantiles, document bitmaps, nearest allowed values, sections of many bank-years, bundle and sources with fixed inputs."""

import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from verdigris.functions import quantiles
from verdigris.functions.quantiles import exact_quantile
from verdigris.operators import audit, docmeta, serving
from verdigris.sources import sections, zones


def plain_quantile(values, share):
    held = sorted((x for x in values if x is not None), key=lambda x: (math.isnan(x), x))
    return held[max(1, math.ceil(len(held) * share)) - 1] if held else None


@pytest.mark.parametrize("few,ranges", [(10_000, 4096), (0, 2), (3, 7)])
def test_quantiles_are_exact_at_any_size(spark, monkeypatch, few, ranges):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "RANGES", ranges)
    r = random.Random(few)
    n = 400
    columns = {
        "normal": [r.gauss(0, 1) for _ in range(n)], "heavy": [5.0] * 300 + [r.random() for _ in range(n - 300)],
        "wide": [r.choice((-1, 1)) * 10 ** r.uniform(-300, 300) for _ in range(n)], "near": [1.0 + i * 2**-52 for i in range(n)],
        "holes": [None if i % 3 else float(i) for i in range(n)], "nothing": [None] * n, "nan": [float("nan")] * 250 + [1.0] * (n - 250),
        "zeros": [0.0] * 100 + [-1.0] * 100 + [2.0] * 200, "infinite": [float("inf")] * 150 + [-float("inf")] * 150 + [0.5] * 100}
    rows = [tuple(columns[c][i] for c in columns) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in columns)).repartition(3)
    for share in (0.5, 0.9) if few else (0.5,):
        got = exact_quantile(df, list(columns), share)
        for c, values in columns.items():
            want = plain_quantile(values, share)
            assert got[c] == want or want != want and got[c] != got[c], (c, share)
    whole = spark.range(7).select((F.col("id") * 2**40 + 1).alias("x"))
    assert exact_quantile(whole, ["x"])["x"] == 3 * 2**40 + 1 and exact_quantile(whole.limit(0), ["x"]) == {"x": None}


def test_bitmaps_equal_a_plain_filter(spark):
    r = random.Random(4)
    rows = [(i, r.choice("abc") if i % 7 else None, r.choice("xyz"), str(i % 2 == 0).lower()) for i in [*range(300), 32_767, 32_768, 70_000, 10**9]]
    meta = spark.createDataFrame(rows, "doc_id long, language string, category string, flag string")
    maps = docmeta.bitmaps(meta)
    for clauses in ({"language": ("a", "b"), "flag": ("true",)}, {"category": ("x",)}, {"language": ("a",), "category": ("y", "z"), "flag": ("false",)},
                    {"language": ("none",), "flag": ("true",)}):
        want = {i for i, lang, cat, flag in rows if all({"language": lang, "category": cat, "flag": flag}[c] in v for c, v in clauses.items())}
        got = docmeta.passing(meta, docmeta.allowed(maps, clauses))
        assert got.columns == meta.columns and {x.doc_id for x in got.collect()} == want


def test_nearest_allowed_value_equals_brute_force(spark):
    r = random.Random(8)
    metrics = [(f"m{i}", n, r.choice([None, round(r.uniform(-50, 5000), r.randrange(6))])) for i in range(4) for n in ("a", "b", "c")]
    held = spark.createDataFrame(metrics, "metrics_key string, metric string, value double")
    values = {x.metrics_key: sorted(x.allowed) for x in audit.report_metrics(held).collect()}
    claims = []
    for i in range(400):
        key = f"m{r.randrange(5)}"
        near = r.choice(values[key]) + r.choice([0, 1e-3, -1e-3, 2e-3, 0.5]) if key in values else 1.0
        claims.append((i, key, r.choice([near, round(r.uniform(-10, 6000), 2), None])))
    c = spark.createDataFrame(claims, "n long, metrics_key string, value double")
    got = {x.n: x for x in audit.tolerance_matched(c, held).collect()}
    assert len(got) == len(claims)
    for n, key, x in claims:
        a = values.get(key, [])
        want = x is not None and any(abs(v - x) <= 1e-3 for v in a)
        assert got[n].matched == want
        if x is not None and a:
            at = bisect.bisect_right(a, x)
            assert abs(got[n].nearest - x) == min(abs(v - x) for v in a[max(0, at - 1) : at + 1])
    bucketed = audit.match_tolerance(c.where("value IS NOT NULL"), audit.allowed_values(held), ["metrics_key"], "value", "allowed", 1e-3)
    assert {x.n for x in bucketed.select("n").collect()} == {n for n, x in got.items() if x.matched}


def test_every_bank_year_has_sections(spark):
    years = [(f"BANK_{b:02d}_{y}", y, *[float(b + y)] * 12) for b in range(25) for y in range(2000, 2020)]
    fields = ["scope1_tco2e", "scope1_natgas_tco2e", "scope1_diesel_tco2e", "scope2_location_tco2e", "scope2_market_tco2e", "scope3_cat15_gross_tco2e",
              "scope3_cat15_weighted_tco2e", "intensity_tco2e_per_idr_bn", "intensity_tco2e_per_fte", "yoy_change_pct", "vs_base_year_change_pct", "avg_pcaf_data_quality"]
    summary = spark.createDataFrame(years, "metric_key string, reporting_year int, " + ", ".join(f"{f} double" for f in fields))
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    made = sections.sections_from_documents(docs, summary)
    assert made.count() == 1500
    keys = {x.metrics_key.removesuffix("_draft") for x in made.select("metrics_key").distinct().collect()}
    assert keys == {y[0] for y in years} and len(keys) == 500


def test_an_empty_year_gives_an_empty_bundle(spark):
    from conftest import SF0001
    from verdigris.operators import scope1
    from verdigris.plans.catalog_core import core
    c = core(spark, SF0001)
    b = serving.data_input(c.summary(), c.sector, scope1.top_facilities(c.s1), c.inp.hr, 1850)
    r = b.first()
    assert (r.ghg_summary, r.prior_year, r.pcaf_sectors, r.scope1_facilities, r.hr_metrics) == (None, None, [], [], [])
    assert serving.bundle_rows(b).count() == 0


def test_freshness_and_listing_of_fixed_files(spark, tmpdir_run):
    import os

    spark.range(10).coalesce(1).write.parquet(f"{tmpdir_run}/t")
    stamp = 1_600_000_000
    for name in os.listdir(f"{tmpdir_run}/t"):
        os.utime(f"{tmpdir_run}/t/{name}", (stamp, stamp))
    t = spark.read.parquet(f"{tmpdir_run}/t")
    for hours, stale in ((10, False), (721, True)):
        r = zones.freshness(t, "t", F.timestamp_seconds(F.lit(stamp + 3600 * hours))).first()
        assert (r.table_name, r.age_hours, r.stale) == ("t", float(hours), stale)
    for path, size in (("gri/a.pdf", 2048), ("gri/a.pdf.metadata.json", 500), ("prompts/x.txt", 900), ("ifrs/small.txt", 10)):
        os.makedirs(os.path.dirname(f"{tmpdir_run}/kb/{path}"), exist_ok=True)
        with open(f"{tmpdir_run}/kb/{path}", "wb") as f:
            f.write(b"x" * size)
    got = zones.list_objects(spark, f"{tmpdir_run}/kb").collect()
    assert [(r.key, r.category, r.filename, r.size_kb) for r in got] == [("gri/a.pdf", "gri", "a.pdf", 2.0)]
