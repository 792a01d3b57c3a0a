"""Periodic runs against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import frame, odd_rows
from verdigris.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, least=6, times=4):
    """All stretches with their smallest period, by trying every period and every stretch it can't extend."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=7), st.integers(1, 7)), max_size=8), st.integers(2, 4))
def test_runs_equal_brute_force(parts, times):
    words = [w for part, n in parts for w in part * n]
    assert periodic.runs([words, words[1:], []], 6, times) == [plain_runs(words, 6, times), plain_runs(words[1:], 6, times), []]


def test_fibonacci_words_and_long_runs():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 400:
        a, b = b, b + a
    assert periodic.runs([b], 6, 2) == [plain_runs(b, 6, 2)]
    many = [b"x"] * 5000 + [b"y"] + [b"p", b"q", b"r"] * 700
    assert periodic.runs([many]) == [[(0, 5000, 1), (5001, 2100, 3)]]
    hub = [w for i in range(3000) for w in (b"%d" % i, b"a", b"a", b"a", b"a", b"a", b"a")]
    assert periodic.runs([hub]) == [[(7 * i + 1, 6, 1) for i in range(3000)]]


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(seed):
    r = random.Random(seed)
    texts = []
    for _ in range(60):
        w = [b"%d" % r.randrange(1 + r.randrange(6)) for _ in range(r.randrange(40))]
        for _ in range(r.randrange(4)):
            at, p = r.randrange(len(w) + 1), [b"%d" % r.randrange(3) for _ in range(r.randrange(1, 6))]
            w[at:at] = (p * 9)[: r.randrange(4, 9) * len(p)]
        texts.append(w)
    assert periodic.runs(texts) == [plain_runs(w) for w in texts]


def test_left_words_keep_the_lists_short(monkeypatch):
    """The pairs that are looked at are those of runs, not those of places."""
    found = {}
    n = 4000
    places, depth = list(range(n - 1, -1, -1)), [0, *range(1, n)]
    seen = []
    monkeypatch.setattr(periodic, "abs", lambda x: seen.append(x) or (x if x > 0 else -x), raising=False)
    periodic._pairs(places, depth, [-1] + [0] * (n - 1), 6, 4, found)
    assert found == {(0, n): 1} and len(seen) < n


def query_expected(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + math.floor((n - a) / (3 + g % 8))
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = plain_runs(w)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_equals_brute_force(spark, tmpdir_run):
    rows = [(i, t, s) for i, t, s in odd_rows() if i not in (11, 12)]
    r = random.Random(3)
    rows += [(100 + n, " ".join(r.choice("abcd") for _ in range(r.randrange(120))), "s") for n in range(120)]
    rows += [(n, " ".join(str(r.randrange(4000)) for _ in range(90)) + " z" * n, "s") for n in range(300, 340)]
    frame(spark, rows).write.parquet(f"{tmpdir_run}/documents.parquet")
    got = queries.QUERIES["op12_periodic_runs"](spark, tmpdir_run)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = collections.Counter(query_expected(i, t) for i, t, _ in rows)
    assert collections.Counter(map(tuple, got.collect())) == want
    assert sum(n for x, n in want.items() if x[1]) > 40


def test_whole_rows(spark, odd, empty):
    got = periodic.periodic_runs(odd).collect()
    assert len(got) == len(odd_rows())
    assert collections.Counter((r.doc_id, r.n_words) for r in got) == collections.Counter((i, len(WORD.findall(t or ""))) for i, t, _ in odd_rows())
    assert periodic.periodic_runs(empty).collect() == []
    broken = spark.createDataFrame([(1, bytearray(b"a\xff " * 8))], "doc_id long, text binary").selectExpr("doc_id", "cast(text as string) text")
    r = periodic.periodic_runs(broken).first()
    assert r.collapsed == "a�" and [tuple(x) for x in r.runs] == [(0, 8, 1)]
