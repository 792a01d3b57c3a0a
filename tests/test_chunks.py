"""Chunks by paragraph and sentence, and the search over their blocks, against plain Python."""

import collections
import math
import random
import re

import pytest
from conftest import SF0001
from pyspark.sql import functions as F

from verdigris.operators import chunks, retrieval

WHITE = "\t\n\x0b\f\r "


def plain_chunks(text, size, overlap):
    pieces = re.findall(f"[^{WHITE}]+[{WHITE}]*", text or "")
    n = len(pieces)
    paragraph = lambda i: i + 1 == n or re.search(r"\n[\t\x0b\f\r ]*\n", pieces[i])
    tokens = [p.rstrip(WHITE) for p in pieces]
    pars = [i + 1 for i in range(n) if paragraph(i)]
    ends = [i + 1 for i in range(n) if paragraph(i) or re.search(r"[.!?][\"')\]]*$", tokens[i])]
    out, start = [], 0
    while n:
        near = [e for e in ends if start < e <= start + size]
        half = [e for e in pars if start + size // 2 <= e <= start + size]
        cut = half[-1] if half else near[-1] if near else start + size
        out.append((len(out), start, cut - start, " ".join(tokens[start:cut])))
        if cut == n:
            break
        following = min(e for e in ends if e > cut)
        carried = [e for e in near if cut - overlap <= e <= cut and following - e <= size]
        start = cut - overlap if not near else carried[0] if carried else cut
    return out


def texts(seed, count):
    r = random.Random(seed)
    word = lambda: r.choice("ab cd ef gh ij k1 l2 a.b (x) \"q\"".split()) + r.choice([""] * 6 + [".", "!", "?\"", ".)"])
    gap = lambda: r.choice([" "] * 12 + ["\n", "\n\n", "  ", "\n \t\n", "\r\n\x0b\n"])
    return ["".join(word() + gap() for _ in range(r.randrange(120))) for _ in range(count)] + [
        None, "", " \n ", "one", "w " * 95, "a. " * 50, " lead\n\ntail", "x. " + "y " * 40 + ". z.", "s. " * 3 + "t " * 30]


@pytest.mark.parametrize("size,overlap", [(10, 3), (7, 6), (30, 8), (300, 50)])
def test_chunks_equal_plain_ones(spark, size, overlap):
    rows = list(enumerate(texts(size, 150)))
    got = collections.defaultdict(list)
    for r in chunks.chunk(spark.createDataFrame(rows, "doc_id long, text string"), size=size, overlap=overlap).collect():
        got[r.doc_id].append((r.chunk_no, r.first_token, r.n_tokens, r.chunk_text))
    for i, text in rows:
        assert sorted(got[i]) == plain_chunks(text, size, overlap), text
        tokens = re.findall(f"[^{WHITE}]+", text or "")
        assert {t for _, a, n, _ in got[i] for t in range(a, a + n)} == set(range(len(tokens)))
        assert all(0 < n <= size for _, _, n, _ in got[i])


def plain_hits(queries, held):
    token = re.compile(r"[^\W_]+")
    tf = {k: collections.Counter(token.findall(t.lower())) for k, t in held.items()}
    df = collections.Counter(w for c in tf.values() for w in c)
    mean = sum(sum(c.values()) for c in tf.values()) / len(tf)
    out = []
    for q, text in queries:
        scores = []
        for k, c in tf.items():
            words = [w for w in set(token.findall(text.lower())) if c[w]]
            if words:
                scores.append((-round(sum(math.log(1 + (len(tf) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2
                                          / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in words), 6), k))
        out += [(q, *k, n + 1) for n, (_, k) in enumerate(sorted(scores)[:5])]
    return sorted(out)


@pytest.mark.parametrize("block", [2, 128])
def test_search_equals_plain_scoring_and_skips_blocks(spark, tmpdir_run, monkeypatch, block):
    monkeypatch.setattr(chunks, "BLOCK", block)
    monkeypatch.setattr(chunks, "BUCKET_TOKENS", 20_000)
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    docs = docs.select("doc_id", "lang", "text").unionByName(spark.createDataFrame([(9_000, "en", ""), (9_001, "xx", "the the of"), (9_002, "en", "...")], "doc_id long, lang string, text string"))
    chunks.write_index(docs, f"{tmpdir_run}/index")
    index = chunks.read_index(spark, f"{tmpdir_run}/index")
    held = {(r.doc_id, r.chunk_no): r.chunk_text for r in index.chunks.collect()}
    assert index.stats.first().n_chunks == len(held)
    some = sorted(held.items())[::37]
    q = [(1, "the and of in"), (2, "zzzz unknownterm"), (3, "license version 2"), (4, "der die ungheit los que"), (5, "")]
    q += [(100 + i, " ".join(t.split()[5:25])) for i, (_, t) in enumerate(some)]
    queries = spark.createDataFrame(q, "query_id long, query_text string")
    found = chunks.search(queries, index, 5)
    got = chunks.bm25_topk(found, index, 5)
    assert sorted((r.query_id, r.doc_id, r.chunk_no, r.rank) for r in got.collect()) == plain_hits(q, held)
    read = chunks.blocks_read(found, index).collect()
    assert all(r.blocks_read <= r.blocks and r.postings_read <= r.postings for r in read)
    if block == 2:
        assert sum(r.blocks_read for r in read) < 0.8 * sum(r.blocks for r in read)
    packed = chunks.pack(got, index, 100).collect()
    assert packed and all(r.context.removesuffix("...") == held[r.doc_id, r.chunk_no][: r.chars_used] and r.chars_used <= 400 for r in packed)


def test_an_index_is_found_by_its_files(spark, tmpdir_run):
    import pandas as pd

    def put(text):
        pd.DataFrame([(1, "en", text), (2, "en", "other")], columns=["doc_id", "lang", "text"]).to_parquet(f"{tmpdir_run}/documents.parquet")
        return chunks.index_of(spark.read.parquet(f"{tmpdir_run}/documents.parquet"))

    first = put("harbour wind")
    assert sorted(first.blocks.inputFiles()) == sorted(chunks.index_of(spark.read.parquet(f"{tmpdir_run}/documents.parquet")).blocks.inputFiles())
    second = put("wind harbour")
    assert {r.chunk_text for r in second.chunks.collect()} == {"wind harbour", "other"}
    with pytest.raises(FileNotFoundError):
        chunks.read_index(spark, f"{tmpdir_run}/none")


def test_postings_are_not_read_for_bounds(spark, tmpdir_run):
    docs = spark.createDataFrame([(i, "en", f"w{i % 7} common text {i}") for i in range(50)], "doc_id long, lang string, text string")
    chunks.write_index(docs, f"{tmpdir_run}/index")
    index = chunks.read_index(spark, f"{tmpdir_run}/index")
    plan = index.blocks.select("bucket", "term", "block", "max_part").where(F.col("term") == "w1")._jdf.queryExecution().toString()
    assert "postings" not in plan.split("ReadSchema")[1] and "PushedFilters: [IsNotNull(term), EqualTo(term,w1)]" in plan


def test_counted_terms(spark):
    rows = [(["b", "a", "b", "c", "b"],), (["x"],)]
    got = spark.createDataFrame(rows, "t array<string>").select(chunks._counted(F.col("t")).alias("c")).collect()
    assert [[tuple(x) for x in r.c] for r in got] == [[("a", 1), ("b", 3), ("c", 1)], [("x", 1)]]
    assert retrieval.TOP_K == 5


def test_equal_chunks_do_not_leave_their_segment(spark, tmpdir_run):
    """Of 400 equal chunks a search sends on the few that can be in the top k; chunks that share key and number are one."""
    rows = [(i, "en", "harbour wind and rain") for i in range(400)] + [(900, "de", "harbour and rain"), (900, "en", "harbour wind"), (901, None, "wind"), (902, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    chunks.write_index(docs, f"{tmpdir_run}/index")
    index = chunks.read_index(spark, f"{tmpdir_run}/index")
    queries = spark.createDataFrame([(1, "harbour wind"), (2, "rain"), (None, "wind")], "query_id long, query_text string")
    found = chunks.search(queries, index, 5)
    assert found.hits.count() <= 5 * 2 * index.segments.count() + 4
    got = sorted((r.query_id, r.rank, r.doc_id) for r in chunks.bm25_topk(found, index, 5).collect())
    assert [x for x in got if x[0] == 1] == [(1, 1, 900), *((1, n + 2, n) for n in range(4))]
    assert {x[2] for x in got if x[0] == 2} == {900, 0, 1, 2, 3}
    held = index.blocks.collect()   # every block's postings, as rows
    assert sum(r.n for r in held) == sum(len(r.postings) for r in held) and all(abs(max(p.part for p in r.postings) - r.max_part) < 1e-12 for r in held)
    assert all(r.blocks_read <= r.blocks and r.postings_read <= r.postings for r in chunks.blocks_read(found, index).collect())


def test_an_index_and_its_search_leave_little_on_disk(spark, tmpdir_run):
    """The stored index takes about its texts' size, places and all; shuffles and tables between steps are not left beside it."""
    import pathlib
    import time

    r = random.Random(5)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 9))) for _ in range(20_000)]
    rows = [(i, "en", " ".join(r.choice(words) + r.choice(["", "", "."]) for _ in range(2_000))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {b.name() for b in (x.apply(i) for x in [disk.getAllBlocks()] for i in range(x.size())) if b.name().startswith("shuffle_")}
    before = shuffles()
    chunks.write_index(docs, f"{tmpdir_run}/index")
    index = chunks.read_index(spark, f"{tmpdir_run}/index")
    found = chunks.search(spark.createDataFrame([(1, rows[0][2][:200])], "query_id long, query_text string"), index, 5)
    for _ in range(50):   # they go a moment after their query
        if left := shuffles() - before:
            time.sleep(0.2)
    assert not left
    size = lambda folder: sum(p.stat().st_size for p in pathlib.Path(tmpdir_run).rglob(f"{folder}/**/*.parquet"))
    text = sum(len(t) for _, _, t in rows)
    assert 0 < size("chunks") < 0.7 * text and 0 < size("rows") < 1.5 * text and not size("packed")
    assert found.hits.where("doc_id = 0").count()
