"""What every operator does with broken bytes and empty tables, op4's SQL on odd rows, and the rounds of components."""

import duckdb
import pytest
from llm.conftest import frame, odd_rows, prose
from pyspark.sql import functions as F
from verdigris.llm import block_names, chat_format, graph, line_crf, line_dedup, minhash, mixing, packing, pii, queries, secret_scan, warc

BROKEN = b"caf\xff mail a.b@c.de \xc3( token = \"0123456789abcdef\" " + prose(90, 70, per_line=60).encode() + b"\n\xe2\x82 tail"


@pytest.fixture(scope="module")
def broken(spark):
    rows = [(1, bytearray(BROKEN)), (2, bytearray(BROKEN)), (3, bytearray(b"\xff")), (4, bytearray(prose(91, 90).encode()))]
    docs = spark.createDataFrame(rows, "doc_id long, text binary")
    return docs.select("doc_id", F.col("text").cast("string"), F.lit("en").alias("lang"), F.lit("s").alias("source"))


def test_broken_bytes_reach_every_operator(spark, broken, tmpdir_run):
    text = BROKEN.decode("utf-8", "replace")
    field = line_crf.train(broken, spark.createDataFrame([], "doc_id long, quality int"))
    table = {r.doc_id: r.kept for r in line_crf.rule_table(broken, field).collect()}
    assert {r.doc_id for r in line_crf.keep_good(broken, field).select("doc_id").collect()} == {i for i, kept in table.items() if kept}
    for r in pii.find_pii(broken).collect():
        if r.doc_id < 3:
            (s,) = [x for x in r.spans if x.kind == "email"]
            assert text[s.start : s.end] == "a.b@c.de"
    assert len(secret_scan.find_secrets(broken).collect()) == 4
    assert len(minhash.near_groups(broken, size=3, percent=85).collect()) == len(block_names.exact_groups(broken).collect()) == 4
    assert len(mixing.plan(broken).collect()) == 4
    got = {r.doc_id: r for r in line_dedup.drop_passages(broken).collect()}
    assert got[1].text == text and len(got[2].text) < len(text) / 4 and got[3].text == "�"
    assert {r.doc_id: r.text for r in line_dedup.drop_repeats(broken).collect()}[1] == text
    tokens = {}
    for r in packing.packed_pieces(broken).collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens[1] == tokens[2] == len(packing.encoder()(text)) + 1
    chats = broken.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), "text")
    assert {r.conv_id: r.loss_chars for r in chat_format.read_back(chat_format.format_chats(chats)).collect()}[1] == len(text)
    pages = broken.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    index = warc.write_archives(pages, f"{tmpdir_run}/warc")
    got = {r.page_id: r for r in warc.resolved(warc.read_archives(index.select("archive").distinct()), index).collect()}
    assert got[2].refers_to == 1 and got[1].payload_bytes == got[2].payload_bytes == len(BROKEN) and got[3].payload_bytes == 1


def test_empty_tables(spark, empty):
    field = line_crf.train(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert line_crf.rule_table(empty, field).collect() == [] and line_crf.keep_good(empty, field).collect() == []
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pipeline_of_nothing(spark, empty, tmpdir_run):
    import corpus_pipeline

    empty.write.parquet(f"{tmpdir_run}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmpdir_run}/labels.parquet")
    assert corpus_pipeline.run(spark, tmpdir_run).collect() == []


def test_spans_of_odd_rows_are_those_of_the_plain_rules(odd):
    auto = pii.automaton()
    want = sorted((i or -1, [(k, *x) for k, of in zip(pii.KINDS, pii.spans(t or "", auto)) for x in of]) for i, t, _ in odd_rows())
    assert sorted((r.doc_id or -1, [tuple(x) for x in r.spans]) for r in pii.find_pii(odd).collect()) == want


def test_line_dedup_query_equals_its_sql(spark, tmpdir_run):
    rows = [(i, t, s) for i, t, s in odd_rows() if i is not None and (i != 1 or s == "s1") and i != 11]
    rows = list(dict.fromkeys(rows))
    w = prose(60, 150, per_line=150).lower().split()
    rows += [(50, " ".join(w[:70]) + "\n" + prose(61, 30), "s"), (51, prose(62, 20) + " " + "  ".join(w[10:70]) + " " + prose(63, 20), "s"),
             (52, "\n".join(" ".join(w[i : i + 6]) for i in range(0, 66, 6)), "s"), (53, "ab cd " * 90, "s"),
             (54, "\t" + "\t ".join(w[60:130]) + "\r\n x", "s"), (55, " ".join(w[60:140]), "s"), (56, " ".join(w[20:100]) + "\n\n", "s")]
    frame(spark, rows).write.parquet(f"{tmpdir_run}/documents.parquet")
    got = queries.QUERIES["op4_line_dedup"](spark, tmpdir_run)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmpdir_run}/documents.parquet/*.parquet')")
    want = con.execute(queries.ORACLES["op4_line_dedup"])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted(want.fetchall())
    assert sorted(map(tuple, got.select(*columns).collect())) == want
    assert sum(r[columns.index("n_long")] for r in want) > 3 and sum(r[columns.index("n_passages")] for r in want) > 5


def test_rounds_grow_with_the_logarithm_of_a_chain(spark, monkeypatch):
    made = []
    keep = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: made.append(name) or keep(df.coalesce(1), name))
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 800)] + [(0, 800)], "a long, b long").coalesce(1)
    assert {r.root for r in graph.components(edges).collect()} == {0}
    assert made.count("least") <= 15


def test_texts_beyond_a_million_characters_have_the_same_ids():
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    base = prose(7, 60_000) + "\n"
    for n in (packing.LONG_TEXT - 5, packing.LONG_TEXT + 5):
        text = (base * (n // len(base) + 1))[:n]
        assert packing.encoder(added=True)(text) == tok.encode(text, add_special_tokens=False).ids
