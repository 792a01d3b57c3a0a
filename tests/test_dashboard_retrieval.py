"""Waterfall, packing, chunking and humanised numbers (FIXTURES F8)."""

from pyspark.sql import functions as F

from verdigris.operators import dashboard, retrieval


def test_waterfall(spark):
    steps = spark.createDataFrame(
        [(1, 1, "total", "a", 10.0), (1, 2, "delta", "b", 3.0), (1, 3, "delta", "c", -5.0), (1, 4, "total", "d", 8.0)],
        "chart_id int, step_no int, kind string, label string, value double")
    r = dashboard.waterfall(steps).orderBy("step_no").collect()
    assert [x.bottom for x in r] == [0.0, 10.0, 8.0, 0.0]
    assert [x.height for x in r] == [10.0, 3.0, 5.0, 8.0]
    assert [x.direction for x in r] == ["total", "up", "down", "total"]


def test_pack_stops_when_tail_too_short(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id int, doc_id int, rank int")
    passages = spark.createDataFrame([(10, "a" * 300), (11, "b" * 150), (12, "c" * 200)], "doc_id int, text string")
    r = retrieval.pack(hits, passages, cap_tokens=125).orderBy("rank").collect()   # 500 characters
    assert [x.chars_used for x in r] == [300, 150]


def test_pack_truncates_crossing_passage(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id int, doc_id int, rank int")
    passages = spark.createDataFrame([(10, "a" * 300), (11, "b" * 400), (12, "c" * 50)], "doc_id int, text string")
    r = retrieval.pack(hits, passages, cap_tokens=125).orderBy("rank").collect()
    assert [(x.chars_used, x.truncated) for x in r] == [(300, False), (200, True)]
    assert r[1].context == "b" * 200 + "..."
    ctx = retrieval.context_text(retrieval.pack(hits, passages, cap_tokens=125)).first().context
    assert ctx == "a" * 300 + "\n\n---\n\n" + "b" * 200 + "..."


def test_chunks_cover_every_token(spark):
    words = [f"w{i}" for i in range(1234)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, "one two")], "doc_id int, text string")
    ch = retrieval.chunk(docs).collect()
    d1 = sorted([c for c in ch if c.doc_id == 1], key=lambda c: c.chunk_no)
    covered = set()
    for c in d1:
        toks = c.chunk_text.split(" ")
        assert len(toks) <= 300
        covered.update(toks)
    assert covered == set(words)
    assert [c.n_tokens for c in ch if c.doc_id == 3] == [2]


def test_humanize(spark):
    df = spark.createDataFrame([(0.0,), (None,), (1250000.0,), (3456.0,), (12.5,), (999.0,)], "v double")
    got = [r[0] for r in df.select(dashboard.humanize("v")).collect()]
    assert got == ["0", "0", "1.3M", "3.5K", "12.5", "999"]


def _plain_bm25(queries, docs):
    """(query, doc) -> score by the formula, in plain Python"""
    import collections
    import math
    import re
    token = re.compile(r"[^\W_]+")
    tf = {i: collections.Counter(token.findall(t.lower())) for i, t in docs}
    df = collections.Counter(w for c in tf.values() for w in c)
    mean = sum(sum(c.values()) for c in tf.values()) / len(tf)
    out = {}
    for q, text in queries:
        for i, c in tf.items():
            held = [w for w in set(token.findall(text.lower())) if c[w]]
            if held:
                out[q, i] = sum(math.log(1 + (len(tf) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2
                                / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in held)
    return out


def test_bm25_index_equals_plain_scoring(spark, tmpdir_run):
    from conftest import SF0001
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "lang", F.substring("text", 1, 400).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(9_000, "en", ""), (9_001, "xx", "the the of")], docs.schema))
    q = [(1, "the and of in"), (2, "zzzz unknownterm"), (3, "license version 2"), (4, "der die ungheit los que"), (5, "")]
    queries = spark.createDataFrame(q, "query_id long, query_text string")
    retrieval.write_index(docs, f"{tmpdir_run}/index")
    index = retrieval.read_index(spark, f"{tmpdir_run}/index")
    rows = docs.collect()
    scores = _plain_bm25(q, [(r.doc_id, r.text) for r in rows])
    lang = {r.doc_id: r.lang for r in rows}

    def top(visible):
        out = []
        for i, _ in q:
            hits = sorted((-round(s, 6), d) for (a, d), s in scores.items() if a == i and visible(lang[d]))[:5]
            out += [(i, d, n + 1) for n, (_, d) in enumerate(hits)]
        return out

    for visible, column in ((lambda x: True, None), (lambda x: x in ("en", "es"), F.col("lang").isin("en", "es")), (lambda x: x == "xx", F.col("lang") == "xx")):
        got = retrieval.bm25_topk(queries, index, 5, visible=column).select("query_id", "doc_id", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(top(visible))


def test_index_is_written_once(spark):
    from conftest import SF0001
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    path = retrieval.index_path(docs)
    files = lambda: sorted(retrieval.index_of(docs).postings.inputFiles())
    assert files() == files() and path == retrieval.index_path(spark.read.parquet(f"{SF0001}/documents.parquet"))


def _indexed(spark, folder, rows):
    """documents.parquet of ``folder`` replaced by ``rows``; the ids that the stored index finds for one query."""
    import pandas as pd

    from verdigris.sources.fixtures import inputs
    pd.DataFrame(rows, columns=["doc_id", "lang", "text"]).to_parquet(f"{folder}/documents.parquet")
    queries = spark.createDataFrame([(1, "harbour wind")], "query_id long, query_text string")
    docs = inputs(spark, folder).raw("documents")
    hits = retrieval.bm25_topk(queries, retrieval.index_of(docs), 5).orderBy("rank").collect()
    return docs, [r.doc_id for r in hits]


def test_replaced_documents_are_indexed_anew(spark, tmpdir_run):
    import os
    old = [(1, "en", "harbour wind"), (2, "en", "nothing here"), (3, "en", "more words")]
    assert _indexed(spark, tmpdir_run, old)[1] == [1]
    first = os.stat(f"{tmpdir_run}/documents.parquet")
    new = [(1, "en", "nothing here"), (2, "en", "harbour wind"), (3, "en", "more words")]
    assert _indexed(spark, tmpdir_run, new)[1] == [2]
    assert os.stat(f"{tmpdir_run}/documents.parquet").st_size == first.st_size   # told apart by time alone


def test_an_incomplete_build_is_not_read(spark, tmpdir_run):
    import glob
    import os

    import pytest
    docs, hits = _indexed(spark, tmpdir_run, [(1, "en", "harbour wind"), (2, "en", "x y")])
    path = retrieval.index_path(docs)
    whole = retrieval._latest_build(spark, path)
    other = docs.withColumn("text", F.lit("lost"))
    retrieval.write_index(other, path)
    lost = retrieval._latest_build(spark, path)
    assert lost != whole and len(glob.glob(f"{path}/build-*")) == 2   # the first build is left as it was
    os.remove(f"{lost.removeprefix('file:')}/stats/_SUCCESS")           # as if the rewrite had ended before its last table
    assert retrieval._latest_build(spark, path) == whole
    assert retrieval.index_of(docs).postings.where("term = 'harbour'").count() == 1
    with pytest.raises(FileNotFoundError):
        retrieval.read_index(spark, f"{tmpdir_run}/none")


def test_fusion_and_routes(spark):
    rank = lambda rows: spark.createDataFrame(rows, "query_id int, doc_id int, rank int")
    got = retrieval.fuse(rank([(1, 7, 1), (1, 8, 2)]), rank([(1, 9, 1), (1, 8, 2)]))
    assert [(r.doc_id, r.rank) for r in got.orderBy("rank").collect()] == [(8, 1), (7, 2), (9, 3)]
    routes = spark.createDataFrame([("scope1", "A", "q1", 3), ("scope1", None, "q2", 5), ("social", None, "q3", 1)],
                                   "section_type string, framework string, query_text string, cap int")
    sections = spark.createDataFrame([(1, "scope1", "A"), (2, "scope1", "B"), (3, "social", "A"), (4, "x", "A")],
                                     "section_key int, section_type string, framework string")
    assert {(r.section_key, r.query_text, r.cap) for r in retrieval.route(routes, sections).collect()} == {(1, "q1", 3), (2, "q2", 5), (3, "q3", 1)}


def test_every_fiftieth_vector_is_a_query(spark):
    from conftest import SF0001
    from verdigris.plans import registry
    rows = spark.read.parquet(f"{SF0001}/embeddings.parquet").collect()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = set()
    for q in rows:
        if q.vec_id % 50 == 0:
            found = sorted((-round(cos(q.embedding, r.embedding), 6), r.vec_id) for r in rows if r.label == q.label)[:5]
            want |= {(q.vec_id, v, n + 1) for n, (_, v) in enumerate(found)}
    got = registry.queries()["vector_ids_top5"](spark, SF0001).collect()
    assert {(r.query_id, r.vec_id, r.rank) for r in got} == want and len(got) == len(want)
    assert {r.query_id for r in got} == {r.vec_id for r in rows if r.vec_id % 50 == 0}


def test_copies_do_not_leave_their_segment(spark, tmpdir_run):
    """Of 400 equal documents a search sends on the few that can be in the top k; rows that share an id are one document."""
    rows = [(i, "en", "harbour wind and rain") for i in range(400)] + [(900, "en", "harbour"), (900, "de", "harbour harbour wind"), (901, None, "wind"), (902, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    retrieval.write_index(docs, f"{tmpdir_run}/index")
    index = retrieval.read_index(spark, f"{tmpdir_run}/index")
    assert index.stats.first().n_docs == 404
    queries = spark.createDataFrame([(1, "harbour wind"), (2, "rain"), (None, "wind")], "query_id long, query_text string")
    assert retrieval.bm25_candidates(queries, index, 5).count() <= 14
    got = sorted((r.query_id, r.rank, r.doc_id) for r in retrieval.bm25_topk(queries, index, 5).collect())
    assert got == [(1, 1, 900), *((1, n + 2, n) for n in range(4)), *((2, n + 1, n) for n in range(5))]
    hidden = retrieval.bm25_topk(queries.limit(2), index, 5, visible=F.col("lang").isNull()).collect()
    assert [(r.query_id, r.doc_id) for r in hidden] == [(1, 901)]
