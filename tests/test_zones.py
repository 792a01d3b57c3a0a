"""Partitioned zone round trips, reject sink, presence, CSV/JSON sinks, listing."""

import os

from pyspark.sql import functions as F

from verdigris.operators import scope1
from verdigris.plans import batch
from verdigris.sources import zones
from verdigris.sources.fixtures import inputs

from conftest import SF0001


def test_round_trip_and_dynamic_overwrite(spark, tmpdir_run):
    inp = inputs(spark, SF0001)
    cur, rej = scope1.scope1(inp.energy)
    zones.write_zone(cur, tmpdir_run, "curated", "ghg_scope1")
    back = zones.read_zone(spark, tmpdir_run, "curated", "ghg_scope1")
    assert back.count() == cur.count()
    assert set(back.columns) == set(cur.columns)
    # rewrite a single year: other years stay
    one = cur.filter(F.col("reporting_year") == 1996).limit(1)
    zones.write_zone(one, tmpdir_run, "curated", "ghg_scope1")
    again = zones.read_zone(spark, tmpdir_run, "curated", "ghg_scope1")
    assert again.filter(F.col("reporting_year") == 1996).count() == 1
    assert again.filter(F.col("reporting_year") != 1996).count() == cur.filter(F.col("reporting_year") != 1996).count()
    p = zones.write_rejects(rej, tmpdir_run, "ghg_scope1")
    assert {r.reject_reason for r in zones.read_rejects(spark, tmpdir_run, "ghg_scope1").collect()} == {"imputed_months_gt_5"}
    assert not os.path.isdir(os.path.join(p, "reject_reason=imputed_months_gt_5"))


def test_partition_pruning_in_plan(spark, tmpdir_run):
    cur, _ = scope1.scope1(inputs(spark, SF0001).energy)
    zones.write_zone(cur, tmpdir_run, "curated", "ghg_scope1")
    q = zones.read_zone(spark, tmpdir_run, "curated", "ghg_scope1").filter(F.col("reporting_year") == 2000) \
        .select("facility_id", "scope1_tco2e")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(reporting_year" in plan
    assert "ReadSchema: struct<facility_id:string,scope1_tco2e:double>" in plan


def test_batch_refresh(spark, tmpdir_run):
    res = batch.refresh(spark, SF0001, tmpdir_run)
    s = zones.read_zone(spark, tmpdir_run, "aggregated", "ghg_summary_annual")
    assert s.count() == 7
    g = zones.read_zone(spark, tmpdir_run, "aggregated", "gate_results")
    failed = g.filter((F.col("severity") == "fail") & ~F.col("passed")).count()
    assert failed == 0
    assert set(res["paths"]) >= {"ghg_scope1", "ghg_scope2", "ghg_scope3_financed", "pcaf_by_sector"}
    cur = zones.read_zone(spark, tmpdir_run, "curated", "ghg_scope1").count()
    assert res["observed"]["ghg_scope1"] == cur


def test_presence_csv_json_listing(spark, tmpdir_run):
    inp = inputs(spark, SF0001)
    present = inp.hr.select(F.lit("hr_metrics").alias("table_name"), "reporting_year")
    pr = {r.reporting_year: r.present for r in
          zones.partition_presence(spark, present, ["hr_metrics"], 1994, 2002).collect()}
    assert pr[1994] is False and pr[1995] is True and pr[2002] is False
    csv = zones.write_sample_csv(inp.loans, os.path.join(tmpdir_run, "sample_csv"))
    back = zones.read_csv(spark, csv, inp.loans.schema)
    assert back.count() == 100
    js = zones.write_bundle_json(inp.hr, os.path.join(tmpdir_run, "bundle_json"))
    assert zones.read_bundle_json(spark, js, inp.hr.schema).count() == inp.hr.count()
    lst = zones.list_objects(spark, tmpdir_run, min_bytes=1).collect()
    assert any(r.category == "sample_csv" for r in lst)


def test_ddl_tables_over_zones(spark, tmpdir_run):
    from verdigris.sources import ddl
    inp = inputs(spark, SF0001)
    zones.write_zone(inp.energy, tmpdir_run, "raw", "energy_consumption", None, ("reporting_year", "reporting_month"))
    zones.write_zone(inp.loans, tmpdir_run, "raw", "loan_portfolio")
    zones.write_zone(inp.hr, tmpdir_run, "raw", "hr_metrics")
    batch.refresh(spark, SF0001, tmpdir_run)
    with ddl.Catalog(spark, tmpdir_run) as catalog:
        names = catalog.create()
        assert len(names) == 9
        assert spark.table(catalog.name("raw", "energy_consumption")).count() == inp.energy.count()
        assert spark.table(catalog.name("curated", "ghg_scope1")).count() > 0
        parts = spark.sql(f"SHOW PARTITIONS {catalog.name('aggregated', 'ghg_summary_annual')}").count()
        assert parts == 7
        r = ddl.summary_by_name(catalog, 2000, "GENERIC_FI_001").collect()
        assert len(r) == 1 and r[0].metric_key == "GENERIC_FI_001_2000"
        comment = [c for c in spark.catalog.listColumns(catalog.name("curated", "ghg_scope1")) if c.name == "scope1_tco2e"][0]
        assert comment.description == "tCO2e, 4 dp"
    assert not [d for d in spark.catalog.listDatabases() if d.name.endswith(catalog.token)]


def test_names_of_others_are_left_alone(spark, tmpdir_run):
    """Databases and tables that were there before, by the zones' plain names, stay; two catalogs of one root don't meet."""
    from verdigris.sources import ddl
    for db in ddl.DATABASES.values():
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {db} LOCATION '{tmpdir_run}/{db}'")
    spark.sql(f"CREATE TABLE esg_raw.energy_consumption (x INT) USING parquet LOCATION '{tmpdir_run}/foreign'")
    spark.sql("INSERT INTO esg_raw.energy_consumption VALUES (7)")
    try:
        from verdigris.plans import registry
        assert registry.queries()["zone_by_name"](spark, SF0001).count() == 1
        inp = inputs(spark, SF0001)
        zones.write_zone(inp.energy, tmpdir_run, "raw", "energy_consumption", None, ("reporting_year", "reporting_month"))
        with ddl.Catalog(spark, tmpdir_run) as one, ddl.Catalog(spark, tmpdir_run) as two:
            one.create({"energy_consumption"})
            two.create({"energy_consumption"})
            one.drop()
            assert spark.table(two.name("raw", "energy_consumption")).count() == inp.energy.count()
        assert [r.x for r in spark.table("esg_raw.energy_consumption").collect()] == [7]
        assert {db.name for db in spark.catalog.listDatabases()} >= set(ddl.DATABASES.values())
    finally:
        spark.sql("DROP TABLE IF EXISTS esg_raw.energy_consumption")
        for db in ddl.DATABASES.values():
            spark.sql(f"DROP DATABASE IF EXISTS {db}")


def _years(spark, root):
    return {(r.reporting_year, r.x) for r in zones.read_zone(spark, root, "curated", "t").collect()}


def test_a_failed_write_leaves_the_old_rows(spark, tmpdir_run, monkeypatch):
    import pytest

    from verdigris.sources import snapshots
    rows = lambda *r: spark.createDataFrame(r, "reporting_year int, x int")
    zones.write_zone(rows((1, 1), (2, 2), (3, 3)), tmpdir_run, "curated", "t")
    lost = rows((1, 9), (2, 9)).withColumn("x", F.when(F.col("reporting_year") == 2, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        zones.write_zone(lost, tmpdir_run, "curated", "t", replace=[1, 2])
    assert _years(spark, tmpdir_run) == {(1, 1), (2, 2), (3, 3)}
    keep = snapshots._publish
    monkeypatch.setattr(snapshots, "_publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):   # all data written, the manifest not
        zones.write_zone(rows((1, 9)), tmpdir_run, "curated", "t", replace=[1, 2])
    assert _years(spark, tmpdir_run) == {(1, 1), (2, 2), (3, 3)}
    # another writer takes the number in between: both changes count
    taken = []

    def late(spark_, table, version, body):
        if not taken:
            taken.append(version)
            monkeypatch.setattr(snapshots, "_publish", keep)
            zones.write_zone(rows((3, 30)), tmpdir_run, "curated", "t")
            monkeypatch.setattr(snapshots, "_publish", late)
        return keep(spark_, table, version, body)

    monkeypatch.setattr(snapshots, "_publish", late)
    zones.write_zone(rows((1, 10)), tmpdir_run, "curated", "t", replace=[1, 2])
    assert _years(spark, tmpdir_run) == {(1, 10), (3, 30)}


def test_versions_expire_and_broken_manifests_are_passed_over(spark, tmpdir_run):
    from verdigris.sources import snapshots
    rows = lambda *r: spark.createDataFrame(r, "reporting_year int, x int")
    path = f"{tmpdir_run}/curated/t"
    zones.write_zone(rows((1, 0), (2, 0)), tmpdir_run, "curated", "t")
    old = zones.read_zone(spark, tmpdir_run, "curated", "t")
    zones.write_zone(rows((1, 1)), tmpdir_run, "curated", "t")
    assert {(r.reporting_year, r.x) for r in old.collect()} == {(1, 0), (2, 0)}   # a reader keeps the version it has resolved
    for x in range(2, 7):
        zones.write_zone(rows((1, x)), tmpdir_run, "curated", "t")
    assert snapshots.versions(spark, path) == [5, 6, 7] and _years(spark, tmpdir_run) == {(1, 6), (2, 0)}
    snaps = [x for x in os.listdir(path) if x.startswith("snap=")]
    assert len(snaps) == 4    # three of year 1, and the first for year 2
    with open(f"{path}/_manifests/000000008.json", "w") as f:
        f.write('{"partitions": []')
    assert _years(spark, tmpdir_run) == {(1, 6), (2, 0)}
    zones.write_zone(rows(), tmpdir_run, "curated", "t", replace="table")
    assert _years(spark, tmpdir_run) == set() and zones.read_zone(spark, tmpdir_run, "curated", "t").columns == ["x", "reporting_year"]
    import pytest
    with pytest.raises(ValueError):
        zones.land(rows((1, 1)), tmpdir_run, "curated", "t", ("reporting_year",))


def test_queries_serve_from_zones(spark, tmpdir_run):
    from verdigris.plans import catalog_core, registry
    batch.refresh(spark, SF0001, tmpdir_run)
    names = ["summary_for_year", "prior_year_summary", "sector_top10", "facility_top10", "scope1_rejects", "ghg_scope3_financed", "sum_check"]
    def rows(name):
        df = registry.queries()[name](spark, SF0001)
        return sorted(str([r[c] for c in sorted(df.columns)]) for r in df.collect())

    fresh = {n: rows(n) for n in names}
    spark.conf.set(catalog_core.ZONES, tmpdir_run)
    try:
        assert {n: rows(n) for n in names} == fresh
        plan = registry.queries()["summary_for_year"](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(reporting_year" in plan and "lineitem" not in plan
    finally:
        spark.conf.unset(catalog_core.ZONES)
