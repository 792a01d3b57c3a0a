"""Settings that are there stay; a cluster without a shared folder is an error."""

import pytest

from verdigris import session
from verdigris.sources.fixtures import ORACLE_INPUT_CTES, padded


def test_preset_values_stay(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Jakarta")
    try:
        again = session.get_session()
        assert again.conf.get("spark.sql.shuffle.partitions") == "5"
        assert again.conf.get("spark.sql.session.timeZone") == "Asia/Jakarta"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


@pytest.mark.parametrize("digits", [4, 6, 7])
def test_long_numbers_keep_their_digits(spark, digits):
    top = 10**digits
    numbers = [1, top - 1, top, top + 1, top * 10 - 1, top * 10, 12 * top * 100]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    got = [r[0] for r in df.selectExpr(padded("n", digits)).collect()]
    assert got == [str(n).zfill(digits) for n in numbers] and len(set(got)) == len(numbers)


def test_facility_ids_beyond_the_padding(spark):
    from verdigris.sources.fixtures import FACILITY_DIM_SQL
    keys = spark.createDataFrame([(k,) for k in (0, 999, 9998, 9999, 10_000, 99_999)], "s_suppkey long")
    ids = [r.facility_id for r in spark.sql(FACILITY_DIM_SQL, supplier=keys).collect()]
    assert len(set(ids)) == 6 and "FAC-10000" in ids and "greatest" in ORACLE_INPUT_CTES["facility_dim"]


def test_entry_works_without_corpus_operators(monkeypatch):
    """With an empty folder left behind, or a package that they need missing, the other queries stay."""
    import sys
    import types

    import __spark_entry__ as entry
    from verdigris.plans import registry

    empty = types.ModuleType("verdigris.llm")
    empty.__path__ = []
    for name in [m for m in sys.modules if m.startswith("verdigris.llm")] + ["corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setitem(sys.modules, "verdigris.llm", empty)
    import verdigris
    monkeypatch.setattr(verdigris, "llm", empty, raising=False)
    assert entry.queries().keys() == registry.queries().keys()
    assert entry.oracle_sql().keys() == registry.oracle_sql().keys()
