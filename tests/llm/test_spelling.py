"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from llm.conftest import frame, odd_rows
from pyspark.sql import functions as F
from verdigris.llm import queries, spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counts_expected(rows, spoil=97):
    n = collections.Counter()
    for i, t, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]+", lambda m: m[0].lower(), w)
            if spoil and (h := zlib.crc32(f"{'' if i is None else i}:{w}".encode())) % spoil == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def variants_expected(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        if others and n[best := min(others, key=lambda x: (-n[x], x))] >= 2 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def texts(seed, count, syllables):
    r = random.Random(seed)
    words = ["".join(r.choice(syllables) for _ in range(r.randrange(2, 5))) for _ in range(150)]
    weights = [1 / (i + 1) for i in range(150)]

    def slip(w):
        i = r.randrange(len(w) + 1)
        return r.choice([w, w[:i] + r.choice("abé") + w[i:], w[:i] + w[i + 1 :], w[:i] + "X" + w[i + 1 :]]) if r.random() < 0.3 else w

    return [(1000 * seed + n, " ".join(slip(w) for w in r.choices(words, weights, k=60)), "s") for n in range(count)]


@pytest.mark.parametrize("block", [2, 7, 1024])
def test_variants_equal_brute_force(spark, block):
    r = random.Random(block)
    n = {}
    for _ in range(500):
        w = "".join(r.choice("abé") for _ in range(r.randrange(5, 9)))
        n[w] = r.choice([3, 4, 8, 16, 40])
    for w in ("aaaaa", "aaaaaa", "aaaaaaa", "x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 150, "zzzzz"):
        n[w] = r.choice([3, 6, 12, 24])
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = spelling.variants(words, block=block).collect()
    assert len(got) == len(n) and {tuple(x) for x in got} == variants_expected(n)


def test_chains_of_forms(spark):
    chain = ["a" * i + "bcdef" for i in range(40)]
    n = {w: 3 * 2**i for i, w in enumerate(chain)}
    got = {x.word: x for x in spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert all(got[w].root == chain[-1] and got[w].form == chain[i + 1] for i, w in enumerate(chain[:-1])) and got[chain[-1]].form is None


def test_query_equals_brute_force(spark, tmpdir_run):
    rows = odd_rows() + texts(1, 40, ["ta", "ko", "éri", "mu", "sch"]) + texts(2, 40, ["on", "en", "ÿla", "r"])
    frame(spark, rows).write.parquet(f"{tmpdir_run}/documents.parquet")
    got = queries.QUERIES["op13_spelling_variants"](spark, tmpdir_run)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = got.collect()
    want = variants_expected(counts_expected(rows))
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert sum(x[1] is not None for x in want) > 30


def test_counts(spark, odd, monkeypatch):
    want = counts_expected(odd_rows(), 0)
    for held in (5, 200_000):
        monkeypatch.setattr(spelling, "HELD", held)
        assert {tuple(x) for x in spelling.word_counts(odd).collect()} == set(want.items())
    broken = spark.createDataFrame([(1, bytearray(b"abcdef\xffghijk " * 3))], "doc_id long, text binary").select("doc_id", F.col("text").cast("string"))
    assert {tuple(x) for x in spelling.word_counts(broken).collect()} == {("abcdef", 3), ("ghijk", 3)}


def test_nothing(spark, empty):
    assert spelling.variants(spelling.word_counts(empty)).collect() == []
    lone = spark.createDataFrame([("lonely", 3)], "word string, n long")
    assert [tuple(x) for x in spelling.variants(lone).collect()] == [("lonely", None, "lonely", 3, 0, None)]


def test_each_near_pair_meets_once():
    r = random.Random(9)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randrange(5, 9))) for _ in range(300)})
    seen = collections.Counter()
    for longer in range(5, 10):
        cut = (longer + 1) // 2
        for side in "ps":
            held = collections.defaultdict(list)
            for w in words:
                if len(w) in (longer, longer - 1):
                    held[w[:cut] if side == "p" else w[len(w) - (longer - cut) :]].append(w)
            for same in held.values():
                for at, n, _ in spelling.compare(same, np.zeros(len(same), int), True, side, longer):
                    for i, k in zip(at, n):
                        seen[same[i]] += int(k)
    assert seen == collections.Counter({w: k for w in words if (k := sum(one_edit(w, x) for x in words))})
