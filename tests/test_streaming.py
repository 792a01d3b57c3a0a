"""Incremental refresh stream: arriving energy files update only the touched years."""

import os

from pyspark.sql import functions as F

from verdigris.operators import scope1
from verdigris.sources import zones
from verdigris.sources.fixtures import inputs
from verdigris.streaming import incremental

from conftest import SF0001


def test_stream_refreshes_touched_years(spark, tmpdir_run):
    energy = inputs(spark, SF0001).energy.select(*[f.name for f in incremental.ENERGY_SCHEMA.fields])
    landing = os.path.join(tmpdir_run, "landing")
    root = os.path.join(tmpdir_run, "lake")
    ckpt = os.path.join(tmpdir_run, "ckpt")
    energy.filter(F.col("reporting_year").isin(1995, 1996)).coalesce(1).write.parquet(os.path.join(landing, "a"))
    q = incremental.start(spark, landing + "/*", root, checkpoint=ckpt)
    q.awaitTermination()
    cur = zones.read_zone(spark, root, "curated", "ghg_scope1")
    assert {r.reporting_year for r in cur.select("reporting_year").distinct().collect()} == {1995, 1996}
    want = scope1.scope1(energy.filter(F.col("reporting_year").isin(1995, 1996)))[0]
    assert cur.select(*want.columns).exceptAll(want).count() == 0
    assert want.exceptAll(cur.select(*want.columns)).count() == 0

    # a second file for 1997 arrives; the restarted stream only processes it
    energy.filter(F.col("reporting_year") == 1997).coalesce(1).write.parquet(os.path.join(landing, "b"))
    q = incremental.start(spark, landing + "/*", root, checkpoint=ckpt)
    q.awaitTermination()
    cur = zones.read_zone(spark, root, "curated", "ghg_scope1")
    assert {r.reporting_year for r in cur.select("reporting_year").distinct().collect()} == {1995, 1996, 1997}
    raw = zones.read_zone(spark, root, "raw", "energy_consumption")
    assert raw.count() == energy.filter(F.col("reporting_year").isin(1995, 1996, 1997)).count()


def test_replayed_batch_changes_nothing(spark, tmpdir_run):
    energy = inputs(spark, SF0001).energy.select(*[f.name for f in incremental.ENERGY_SCHEMA.fields])
    one = energy.filter(F.col("reporting_year") == 1996)
    sums = lambda: [sorted(map(str, zones.read_zone(spark, tmpdir_run, "curated", t).collect()))
                    for t in ("ghg_scope1", "ghg_scope2")]
    incremental.on_batch(one, 7, tmpdir_run)
    before = sums()
    incremental.on_batch(one, 7, tmpdir_run)
    assert sums() == before
    # a later file corrects one reading: it replaces the row, and rejects follow
    fixed = one.filter("reporting_month = 3").withColumn("diesel_liters", F.lit(1e6))
    incremental.on_batch(fixed, 8, tmpdir_run)
    assert incremental.raw_energy(spark, tmpdir_run).count() == one.count() and sums() != before
    rejects = zones.read_rejects(spark, tmpdir_run, "ghg_scope1")
    assert {(r.reporting_year, r.reject_reason) for r in rejects.collect()} <= {(1996, "imputed_months_gt_5")}


def test_years_prune_the_raw_scan(spark, tmpdir_run):
    energy = inputs(spark, SF0001).energy.select(*[f.name for f in incremental.ENERGY_SCHEMA.fields])
    incremental.on_batch(energy.filter("reporting_year IN (1995, 1996)"), 1, tmpdir_run)
    plan = incremental.raw_energy(spark, tmpdir_run, [1996])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(reporting_year" in plan and "= 1996)" in plan


def test_partitions_without_rows_go(spark, tmpdir_run):
    df = spark.range(4).selectExpr("id", "CAST(2000 + id % 2 AS INT) AS reporting_year", "'a' AS reject_reason")
    zones.write_rejects(df, tmpdir_run, "t")
    zones.write_rejects(df.filter("reporting_year = 2000").withColumn("reject_reason", F.lit("b")), tmpdir_run, "t", [2000])
    got = {(r.reporting_year, r.reject_reason) for r in zones.read_rejects(spark, tmpdir_run, "t").collect()}
    assert got == {(2000, "b"), (2001, "a")}
