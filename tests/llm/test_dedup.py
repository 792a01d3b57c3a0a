"""Exact, near and line dedup against plain Python."""

import collections
import random
import re

import numpy as np
import pytest
from conftest import SF0001
from llm.conftest import frame, odd_rows, prose
from verdigris.llm import block_names, graph, line_dedup, minhash, queries

WHITE = re.compile(r"[\x20\x09-\x0D]")


def exact_expected(rows):
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[WHITE.sub("", t or "")].append((len(t or ""), i))
    out = []
    for i, t, _ in rows:
        g = groups[WHITE.sub("", t or "")]
        most = max(n for n, _ in g)
        keep = min((j for n, j in g if n == most), key=lambda j: (j is None, j))
        out.append((i, keep, len(g), i == keep and len(t or "") == most))
    return out


@pytest.mark.parametrize("sizes", [(128, 512), (3, 2)])
def test_exact_groups(odd, sizes):
    got = block_names.exact_groups(odd, *sizes).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, exact_expected(odd_rows())))


def test_exact_keeps_one_row_of_each_text(odd):
    kept = block_names.keep_one(odd)
    assert kept.columns == odd.columns
    texts = [WHITE.sub("", r.text or "") for r in kept.collect()]
    assert sorted(texts) == sorted({WHITE.sub("", t or "") for _, t, _ in odd_rows()})


def test_names_tell_blocks_apart(spark):
    # same length and same first block, so that only the later blocks' names differ
    rows = [(i, "h" * 10 + "".join(random.Random(i // 2).choice("ab") for _ in range(50)), None) for i in range(40)]
    got = block_names.exact_groups(frame(spark, rows), 8, 4).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(exact_expected(rows))


def near_expected(rows, size, percent):
    """component per row by comparing all pairs of sets"""
    sets = []
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(*[w[k:] for k in range(size)])) if len(w) >= size else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    ids = collections.defaultdict(list)
    for x, (i, _, _) in enumerate(rows):
        ids[find(x)].append(i)
    return [(i, len(sets[x]), i if not sets[x] else min((j for j in ids[find(x)] if j is not None), default=None))
            for x, (i, _, _) in enumerate(rows)]


def edited(seed, words, edits):
    r = random.Random(seed)
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_groups(spark, size, percent):
    base = prose(5, 90).split()
    rows = odd_rows() + [(100 + i, edited(i, base, i % 7), "s") for i in range(150)]
    got = minhash.near_groups(frame(spark, rows), size, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, near_expected(rows, size, percent)))


def test_near_keeps_columns(odd):
    kept = minhash.keep_one(odd, 3, 85)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {1, 6, 7, 8, 9, 11, 13, 14, 15, 16, 17, None}  # (1, b) stays for (4, b)


def test_banding_and_pruning_miss_almost_nothing():
    for percent in (80, 85, 95):
        bands, rows = minhash.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= minhash.MISS and bands * rows <= minhash.MOST_HASHES
        need = minhash.least_matches(percent)
        r = np.random.default_rng(1)
        steps = r.binomial(minhash.BATCH, percent / 100, (100_000, len(need))).cumsum(axis=1)
        assert (steps < np.array(need)).any(axis=1).mean() < 1e-4
        low = r.binomial(minhash.BATCH, 0.4, (10_000, len(need))).cumsum(axis=1)
        assert (low < np.array(need)).any(axis=1).mean() > 0.99


def test_signatures_estimate_similarity():
    r = np.random.default_rng(3)
    x = r.integers(0, 2**63, 300, dtype=np.uint64)
    other = r.integers(0, 2**63, 60, dtype=np.uint64)
    y = np.concatenate((x[60:], other))
    same = (minhash.signature(x, 400) == minhash.signature(y, 400)).mean()
    assert abs(same - 240 / 360) < 0.08


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in got} and set(got) == {x for e in edges if e[0] != e[1] for x in e}


def lines_expected(rows, least):
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t, _ in rows}, key=lambda x: (x[0] is None, x[0] or 0, x[1] is None)):
        start, gone, kept = 0, [], []
        for n, line in enumerate((t or "").split("\n")):
            words = line.encode().lower().split()
            if len(words) >= least and tuple(words) in seen:
                gone.append((n, start, start + len(line)))
            else:
                kept.append(line)
                if len(words) >= least:
                    seen.add(tuple(words))
            start += len(line) + 1
        out[i, t] = (gone, None if t is None else "\n".join(kept))
    return out


def test_line_dedup(spark):
    rows = [(i, t, s) for i, t, s in odd_rows() if i != 1 or s == "s1"]  # one text per id, so that the order is known
    want = lines_expected(rows, 8)
    got = line_dedup.drop_repeats(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = collections.defaultdict(set)
    for (i, t), (gone, left) in want.items():
        texts[i].add((str([tuple(g) for g in gone]), left))
    for r in got:
        assert (str([tuple(x) for x in r.removed]), r.text) in texts[r.doc_id]


@pytest.mark.parametrize("run", [block_names.exact_groups, block_names.keep_one, minhash.near_groups, minhash.keep_one, line_dedup.drop_repeats])
def test_empty(empty, run):
    assert run(empty).collect() == []


def test_exact_query_is_native(spark):
    plan = queries.QUERIES["op9_block_names"](spark, SF0001)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)


def passages_expected(rows, least, size):
    """(doc_id, text) -> words left, by a dictionary of all runs of the words that the lines' removal leaves."""
    seen, out, lines = {}, {}, lines_expected(rows, least)
    for i, t in sorted({(i, t) for i, t, _ in rows}, key=lambda x: (x[0] is None, x[0] or 0, x[1] is None)):
        words = (lines[i, t][1] or "").encode().lower().split()
        gone = set()
        for p in range(len(words) - size + 1):
            doc, first = seen.setdefault(tuple(words[p : p + size]), ((i, t), p))
            if (doc, first) != ((i, t), p):
                gone |= set(range(max(p, first + size) if doc == (i, t) else p, p + size))
        out[i, t] = [w for n, w in enumerate(words) if n not in gone]
    return out


def test_passages_inside_and_across_lines(spark):
    passage = prose(70, 60, per_line=60).lower().rstrip(".")
    w = passage.split()
    wrapped = "\n".join(" ".join(w[i : i + 6]) for i in range(0, 60, 6))
    inside = prose(71, 40, per_line=40) + " " + passage + " " + prose(72, 48, per_line=48)
    rows = [(1, prose(73, 20) + "\n" + passage + "\n" + prose(74, 20), "s"), (2, inside, "s"),
            (3, prose(75, 5) + "\n" + wrapped + "\n" + prose(76, 7), "s"), (4, " ".join(w[:49]) + " other", "s")]
    got = {r.doc_id: r for r in line_dedup.drop_passages(frame(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[1].passages == [] and got[4].text == rows[3][1]
    assert got[2].text == prose(71, 40, per_line=40) + " " + prose(72, 48, per_line=48)
    assert got[3].text == prose(75, 5) + "\n" + prose(76, 7)
    a, b = got[2].passages[0]
    assert inside[a:b] == passage + " " and all(rows[2][1][a:b] in wrapped for a, b in got[3].passages)


@pytest.mark.parametrize("size", [4, 50])
def test_passages_equal_brute_force(spark, size):
    r = random.Random(size)
    rows = [(i, t, s) for i, t, s in odd_rows() if i not in (1, 11, 12) or s == "s1" and i == 1]
    rows += [(100 + n, " ".join(r.choice("abc") for _ in range(r.randrange(30))) + "\n" + prose(r.randrange(6), 90, per_line=7), "s") for n in range(40)]
    rows += [(200, "x " * 300, "s"), (201, "a b C " * 60 + "\n" + "\u00a0d " * 70, "s"), (None, prose(2, 70), "s")]
    want = collections.defaultdict(list)
    for (i, t), words in passages_expected(rows, 8, size).items():
        want[i].append(words)
    got = line_dedup.drop_passages(frame(spark, rows), size=size).collect()
    assert len(got) == len(rows)
    for x in got:
        assert (x.text or "").encode().lower().split() in want[x.doc_id]


def test_passages_of_nothing(empty):
    assert line_dedup.drop_passages(empty).collect() == []
    assert "passage_dedup" in __import__("__spark_entry__").queries()
