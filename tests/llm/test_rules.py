"""Quality rules, personal data, secrets, packing, mixing, chats and archives against plain Python."""

import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
from conftest import SF0001
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import frame, odd_rows, prose
from verdigris.llm import chat_format, line_crf, mixing, packing, pii, queries, secret_scan, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    w, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB é🙂\n\r\t\x0b|#!.1 ", max_size=120))
def test_line_counts(text):
    for t in (text, text * 4):
        d = line_crf.read(t.encode())
        assert (d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, d.base_failed) == base_counts(t)
        assert len(d.features) == len(d.weight) == sum(bool(WORD.search(x)) for x in t.split("\n"))


def test_line_counts_across_slices(monkeypatch):
    text = prose(4, 400) + "\n\n" + "x y " * 50
    whole = line_crf.read(text.encode())
    monkeypatch.setattr(line_crf, "SLICE", 7)
    cut = line_crf.read(text.encode())
    assert np.array_equal(whole.features, cut.features) and whole.n_words == cut.n_words


def test_viterbi_finds_the_best_sequence():
    r = np.random.default_rng(1)
    for n in range(1, 9):
        f = line_crf.Field(r.normal(size=len(line_crf.FEATURES)), r.normal(size=(2, 2)))
        x = r.normal(size=(n, len(line_crf.FEATURES)))

        def score(y):
            return sum((x[i] @ f.weights) * y[i] for i in range(n)) + sum(f.step[a, b] for a, b in zip(y, y[1:]))

        best = max((tuple(int(b) for b in format(k, f"0{n}b")) for k in range(2**n)), key=score)
        assert tuple(f.decode(x)) == best


def test_fit_learns_emissions_and_transitions():
    r = np.random.default_rng(2)
    docs, labels = [], []
    for _ in range(120):
        y = [0]
        for _ in range(19):
            y.append(y[-1] if r.random() < 0.9 else 1 - y[-1])
        x = r.normal(size=(20, len(line_crf.FEATURES))) * 0.1
        x[:, 1] += np.array(y) * 2 + r.normal(size=20)
        docs.append(x)
        labels.append(np.array(y))
    f = line_crf.fit(docs[:60], labels[:60])
    right = np.mean([np.mean(f.decode(d) == g) for d, g in zip(docs[60:], labels[60:])])
    alone = np.mean([np.mean((d[:, 1] > 1) == g) for d, g in zip(docs[60:], labels[60:])])
    assert right > alone + 0.03 and f.step[0, 0] > f.step[0, 1]


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    field = line_crf.train(docs.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 0"))
    got = line_crf.rule_table(docs.where("doc_id % 2 = 1"), field).join(labels, "doc_id").where("NOT base_failed").collect()
    good = [r.kept for r in got if r.quality == 1]
    bad = [r.kept for r in got if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1 and len(bad) > 30


def test_quality_rows_and_filter(spark, odd):
    field = line_crf.train(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert np.array_equal(field.weights, line_crf.PRIOR)
    got = line_crf.rule_table(odd, field).collect()
    want = collections.Counter((i, *base_counts(t)) for i, t, _ in odd_rows())
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    kept = line_crf.keep_good(odd, field)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        odd, even = s[::-2], s[-2::-2]
        return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0

    return [[m.span() for m in EMAIL.finditer(t)],
            [m.span() for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))],
            [m.span() for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
            [m.span() for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]]


AUTO = pii.automaton()


@settings(max_examples=800, deadline=None)
@given(st.one_of(st.text(alphabet="ab1@.-+ é", max_size=40), st.text(alphabet="0123. +-()", max_size=60),
                 st.lists(st.sampled_from(["4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "255.0.0.256", ".", "a@b.c", "@", "+1 (555) 010-9999",
                                           " ", "-", "x", "7", "+"]), max_size=12).map("".join)))
def test_pii_expansion_equals_the_base_rules(text):
    assert pii.spans(text, AUTO)[:4] == plain_pii(text)


def test_pii_added_kinds():
    text = "See https://ex.org/a?b=1. IBAN DE89370400440532013000, account no. 12345678 and iban DE00370400440532013000"
    found = pii.spans(text, AUTO)
    assert [text[a:b] for a, b in found[4]] == ["https://ex.org/a?b=1"]
    assert [text[a:b] for a, b in found[5]] == ["DE89370400440532013000", "12345678"]


def test_pii_rows(odd, empty):
    got = pii.find_pii(odd).collect()
    assert len(got) == len(odd_rows()) and pii.find_pii(empty).collect() == []


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def plain_secrets(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]


def test_secret_rows(spark, empty):
    parts = ["password", "PassWD", "ſecret", "secret", "api_key", "apikey", "toKen", '"', "'", " ", ":", "=", " = ", "AKIA", "ABCDEFGHIJ12345", "0123456789abcdef",
             "é🙂", "x", "AbCdEf123456", "\n"]
    r = np.random.default_rng(5)
    rows = [(i, "".join(parts[k] for k in r.integers(0, len(parts), r.integers(0, 14))), None) for i in range(4000)] + [(9999, None, None), (9999, None, None)]
    want = {i: plain_secrets(t or "") for i, t, _ in rows}
    for block in (1 << 22, 64):
        got = secret_scan.find_secrets(frame(spark, rows), secret_scan.BASE, block).collect()
        assert len(got) == len(rows) and all([tuple(s) for s in x.spans] == want[x.doc_id] for x in got)
    assert sum(map(len, want.values())) > 300
    assert secret_scan.find_secrets(empty).collect() == []


@pytest.mark.parametrize("pattern,text", [("abc(def|ghi)?jkl", "abcjkl"), ("(foo|bar)[xy]baz", "FOOxbaz"), ("a{3}bcd", "aaabcd"), ("(?:ab)+cde", "ababcde"),
                                          ("x[0-9]*yzw", "xyzw"), ("^begin$", "begin"), ("[^a]bcd", "zbcd"), ("a.bcd", "azbcd"), ("(ab|cd|)efg", "efg")])
def test_trigram_queries_never_lose_a_match(pattern, text):
    q = secret_scan.trigram_query(pattern)
    wanted = sorted(secret_scan._wanted(q))
    index = secret_scan.Index([text.encode(), b"nothing here"], wanted)
    assert 0 in index.search(q)


def test_rules_without_trigrams_scan():
    assert secret_scan.trigram_query("[0-9a-f]+") == secret_scan.ALL
    assert secret_scan.trigram_query("AKIA[A-Z0-9]+") == ("and", frozenset({("tri", b"aki"), ("tri", b"kia")}))


def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rows = odd_rows() + [(50 + i, prose(i, 30 + 40 * i), "s") for i in range(40)] + [(200, "<|endoftext|> x", "s")]
    rows = [(1000 + n, t, s) for n, (_, t, s) in enumerate(rows)]
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.packed_pieces(frame(spark, rows)).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t, _ in rows:
        ids, at = tok.encode(t or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(pieces.pop(i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    assert not pieces
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.packed_pieces(empty).collect() == []


@pytest.mark.parametrize("long_text", [1_000_000, 10])
def test_added_tokens_have_their_ids(monkeypatch, long_text):
    from tokenizers import Tokenizer

    import public_tokenizers

    monkeypatch.setattr(packing, "LONG_TEXT", long_text)
    plain, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(added=True)
    assert encode("a <|endoftext|> b") == [64, 220, 50256, 275]
    r = np.random.default_rng(3)
    texts = [prose(9, 300), "", "<|endoftext|>", "<|endoftext|" + "<|endoftext|>" * 3 + "\n\n x", "<|ENDOFTEXT|> <|endoftext |>"]
    texts += ["".join(r.choice(["<|endoftext|>", "<|", "endoftext", "|>", " ", "\n", "é🙂", "don't", "12"], 30)) for _ in range(200)]
    for text in texts:
        assert encode(text) == plain.encode(text, add_special_tokens=False).ids


def test_packing_stages_give_added_tokens_their_ids(spark, tmpdir_run):
    import corpus_pipeline

    rows = [(1, "a <|endoftext|> b", "s"), (2, "plain words", "s")]
    frame(spark, rows).write.parquet(f"{tmpdir_run}/documents.parquet")
    docs = spark.read.parquet(f"{tmpdir_run}/documents.parquet")
    want = zlib.crc32(struct.pack("<5I", 64, 220, 50256, 275, 1))
    for out in (queries.QUERIES["op10_packing"](spark, tmpdir_run), corpus_pipeline.pack_sequences(spark, docs, tmpdir_run)):
        got = {r.doc_id: r for r in out.collect()}
        assert (got[1].doc_tokens, got[1].ids_crc32) == (5, want)


def test_long_texts_take_the_other_library(monkeypatch):
    text = prose(8, 500) + " " * 50 + "é🙂"
    quick = packing.encoder()(text)
    monkeypatch.setattr(packing, "LONG_TEXT", 10)
    assert packing.encoder()(text) == quick


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=80))
def test_differencing_keeps_within_capacity(lengths):
    found = packing.pack_group(lengths, 60)
    filled = np.bincount(found, lengths)
    assert filled.max() <= 60 and len(found) == len(lengths) and set(found) == set(range(len(filled)))


def test_differencing_balances():
    r = np.random.default_rng(1)
    lengths = r.integers(1, 512, 1000).tolist()
    filled = np.bincount(packing.difference(lengths, 130), lengths, minlength=130)
    assert filled.max() - filled.min() < 0.02 * filled.mean()
    assert 1 - sum(lengths) / (2048 * (max(packing.pack_group(lengths, 2048)) + 1)) < 0.03


def water_fill(sizes, share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, fixed, free = share * sum(sizes.values()), {}, set(names)
    while True:
        rest, w = total - sum(fixed.values()), sum(weight[n] for n in free)
        over = [n for n in free if rest * weight[n] / w > 2 * sizes[n]]
        if not over:
            return fixed | {n: rest * weight[n] / w for n in free}
        fixed |= {n: 2 * sizes[n] for n in over}
        free -= set(over)


def test_mixing(spark, odd, empty):
    rows = odd_rows() + [(100 + i, prose(i, 5 + i % 90), f"s{i % 7}" if i % 3 else "hot") for i in range(600)] + [(900, "a b c", "\U0001f642"), (901, "a b", "￿")]
    docs = frame(spark, rows)
    got = mixing.plan(docs).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    want, taken = water_fill(sizes), collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.times <= 2
        taken[r.source] += r.size * r.times
    assert len(got) == len(rows)
    for s in sizes:  # as near as sizes allow: the best sum of documents is found
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 60 or sizes[s] > 29_000
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(docs).collect()))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixing.plan(empty).collect() == [] and mixing.mixed(empty).collect() == []


@pytest.mark.parametrize("share", [1.5, 0.2, 2.0])
def test_targets_of_many_sources_by_ranges(spark, share):
    sizes = {None if i == 7 else f"host{i}\U0001f642": (i * i) % 97 * (1000 if i % 50 == 0 else 1) for i in range(3000)}
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), share=share).collect()
    finally:
        spark.conf.set(coalesce, before)
    want = water_fill(sizes, share)
    assert {r.source: r.source_size for r in got} == sizes
    assert all(abs(r.target - want[r.source]) <= 1e-9 * want[r.source] + 1e-9 for r in got)
    assert abs(sum(r.target for r in got) - share * sum(sizes.values())) < 1e-3


def test_mixing_ranks_in_ranges(spark, monkeypatch):
    rows = [(i, "one two three", "a" if i % 3 else "b") for i in range(3000)]
    whole = sum(r.times for r in mixing.plan(frame(spark, rows)).collect())
    monkeypatch.setattr(mixing, "RANGE", 50)
    got = mixing.plan(frame(spark, rows)).collect()
    per = collections.Counter()
    for r in got:
        per[r.source] += 3 * r.times
    assert sum(r.times for r in got) == whole and all(abs(per[r.source] - r.target) <= 3 for r in got)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 25), st.integers(1, 4), min_size=1, max_size=6), st.integers(0, 300))
def test_fit_finds_the_best_sum_for_small_budgets(counts, budget):
    sizes = sorted(counts)
    total = sum(s * c for s, c in counts.items())
    budget = min(budget, total)
    take = mixing.fit_counts(sizes, [counts[s] for s in sizes], budget)
    assert all(0 <= t <= counts[s] for s, t in zip(sizes, take))
    sums = {0}
    for s, c in counts.items():
        sums = {x + s * k for x in sums for k in range(c + 1)}
    assert sum(s * t for s, t in zip(sizes, take)) == max(x for x in sums if x <= budget)


def test_fit_beyond_the_table_comes_close(monkeypatch):
    monkeypatch.setattr(mixing, "TABLE", 64)
    for seed in range(200):
        r = np.random.default_rng(seed)
        sizes = sorted({int(x) for x in r.integers(3, 90, 12)})
        counts = [int(x) for x in r.integers(1, 40, len(sizes))]
        total = sum(s * c for s, c in zip(sizes, counts))
        budget = int(r.integers(total))
        take = mixing.fit_counts(sizes, counts, budget)
        got = sum(s * t for s, t in zip(sizes, take))
        assert all(0 <= t <= c for t, c in zip(take, counts)) and budget - sizes[-1] < got <= budget


texts = st.one_of(st.text(max_size=30), st.lists(st.sampled_from([*chat_format.CONTROL, "\\", "[", "<", "/s>", "INST]", "a", " ", "é🙂", "\n"]), max_size=12).map("".join))
texts = texts.map(lambda s: s.encode("utf-8", "ignore").decode())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "</s>"]), texts), max_size=6))
def test_rendering_is_reversible(turns):
    formatted, spans = chat_format.render(turns)
    assert chat_format.parse(formatted) == turns
    assert [chat_format.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "tool"]), texts), max_size=6))
def test_loss_mask_covers_assistant_texts(turns):
    tok = chat_format.encoder()
    formatted, spans = chat_format.render(turns)
    got = tok.encode(formatted, add_special_tokens=False)
    offsets = np.array(got.offsets, np.int32).reshape(-1, 2)
    mask = chat_format.loss_mask(offsets, spans)
    assert chat_format.masked_text(formatted, offsets[:, 0], offsets[:, 1], mask) == "".join(t for r, t in turns if r == "assistant")


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (2, 5, "assistant", "x" * 300_000), (2, 1, None, "</s>"),
            (None, 0, "user", "q"), (None, None, "assistant", "first"), (3, 0, "system", "[INST]\\"), (4, 0, "assistant", "é🙂 ok")]
    chats = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, loss_mask int")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(chats)).collect()}
    by = collections.defaultdict(list)
    for c, n, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] is not None, r[3] or "")):
        by[c].append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.format_chats(chats.limit(0)).collect() == []


def pages_expected(rows):
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        f = first.get(h or "")
        revisit = len(data) >= 100 and f is not None and p != f
        out.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(map(str, out))


def test_archives(spark, tmpdir_run):
    big = "<p>é🙂\r\n\r\nWARC/1.1</p>" * 9000
    rows = [(5, "http://a", big), (3, "http://b\r\nX: y", big), (9, None, big), (9, None, big), (3, "http://b", big), (1, "u", "small"), (2, "u", "small"), (4, "v", None),
            (6, "v", ""), (None, "w", big), (None, None, None), (7, "x", "q" * 99), (8, "x", "q" * 99), (10, "x", "r" * 100), (11, "x", "r" * 100)]
    rows += [(100 + i, f"http://h/{i}", prose(i, 60)) for i in range(200)]
    pages = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, archive string, `first` int").repartition(3)
    index = warc.write_archives(pages, f"{tmpdir_run}/warc", frame=4096, archive=20_000)
    archives = index.select("archive").distinct()
    got = warc.resolved(warc.read_archives(archives), index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(str, map(tuple, got))) == pages_expected(rows)
    # every record is found again by a seek, and frames are as the seek tables say
    by_id = {r.record_id: r for r in warc.read_archives(archives).collect()}
    for r in warc.fetch(index, index.select("record_id")).collect():
        assert r.record_id in by_id and (r.record_type == "revisit" or hashlib.sha256(r.payload).hexdigest() == r.payload_digest)
    places = {(r.archive, r.frame_offset, r.frame_size) for r in index.collect()}
    assert places == {(r.archive, r.offset, r.size) for r in warc.frames_of(archives).collect()} and len(places) > 5
    nothing = warc.write_archives(pages.limit(0), f"{tmpdir_run}/none")
    assert warc.resolved(warc.read_archives(nothing.select("archive").distinct()), nothing).collect() == []


def test_archives_are_plain_zstandard(spark, tmpdir_run):
    import glob

    import zstandard

    pages = spark.createDataFrame([(i, "u", prose(i, 100)) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"{tmpdir_run}/plain", frame=2000).count()
    path, = glob.glob(f"{tmpdir_run}/plain/*.warc.zst")
    with open(path, "rb") as f:  # a reader that knows nothing of the seek table skips it
        data = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    at, seen = 0, 0
    while at < len(data):
        headers, payload, at = warc.parse(data, at)
        seen += payload.decode() == prose(int(headers["X-Page-ID"]), 100)
    assert seen == 30


def test_pipeline_stages(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF0001)
        if name != "pack_sequences":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        sizes[name] = docs.count()
    assert sizes["quality_rules"] >= sizes["exact_dedup"] >= sizes["near_dedup"] > 100 and sizes["pack_sequences"] > 0
    assert "pipeline" in __import__("__spark_entry__").queries()


def test_run_equals_plain_stages(spark, tmpdir_run, monkeypatch):
    """run() on sf0.001 with planted copies; each stage's rows against a plain version on what its predecessor left."""
    import corpus_pipeline
    import public_tokenizers
    from llm.test_dedup import edited, exact_expected, near_expected
    from tokenizers import Tokenizer

    given = spark.read.parquet(f"{SF0001}/documents.parquet")
    rows = given.orderBy("doc_id").collect()
    last = max(r.doc_id for r in rows)
    long = [r for r in rows if len(r.text.split()) > 100][:60]
    planted = [(r, r.text.replace(" ", "  ") if n % 2 else r.text) for n, r in enumerate(long[:30])]
    planted += [(r, edited(n, r.text.split(), 2)) for n, r in enumerate(long[30:])] + [(long[0], long[0].text + " <|endoftext|> end")]
    rows += [type(r)(**(r.asDict() | {"doc_id": last + 1 + n, "text": t})) for n, (r, t) in enumerate(planted)]
    spark.createDataFrame(rows, given.schema).repartition(3).write.parquet(f"{tmpdir_run}/documents.parquet")
    labels = spark.read.parquet(f"{SF0001}/labels.parquet")
    labels.write.parquet(f"{tmpdir_run}/labels.parquet")

    out, keep = {}, corpus_pipeline.materialize

    def recorded(df, name):
        stored = keep(df, name)
        out[name.removeprefix("stage-")] = [r.asDict() for r in stored.collect()]
        return stored

    monkeypatch.setattr(corpus_pipeline, "materialize", recorded)
    result = [r.asDict() for r in corpus_pipeline.run(spark, tmpdir_run).collect()]
    assert list(out) == [n for n, _ in corpus_pipeline.STAGES]
    assert sorted(map(str, result)) == sorted(map(str, out["pack_sequences"]))

    def same(stage, expected):
        assert sorted(map(str, out[stage])) == sorted(str(r) for r in expected)

    triples = lambda found: [(r["doc_id"], r["text"], r["source"]) for r in found]
    rows = [r.asDict() for r in rows]
    field = line_crf.train(spark.read.parquet(f"{tmpdir_run}/documents.parquet"), labels)
    good = [r for r in rows if not base_counts(r["text"])[-1] and line_crf.judge(r["text"].encode(), field)[-1]]
    same("quality_rules", good)
    exact = {i for i, _, _, kept in exact_expected(triples(good)) if kept}
    unlike = [r for r in good if r["doc_id"] in exact]
    assert len(unlike) < len(good) < len(rows)
    same("exact_dedup", unlike)
    near = {i for i, _, first in near_expected(triples(unlike), 5, 80) if i == first}
    single = [r for r in unlike if r["doc_id"] in near]
    assert len(single) < len(unlike)
    same("near_dedup", single)

    by_id, sizes, taken = {r["doc_id"]: r for r in single}, collections.Counter(), collections.Counter()
    for r in single:
        sizes[r["source"]] += len(r["text"].encode().split())
    times = collections.Counter(r["doc_id"] for r in out["mix_sources"])
    assert all(r == by_id[r["doc_id"]] for r in out["mix_sources"]) and max(times.values()) <= 2
    for r in out["mix_sources"]:
        taken[r["source"]] += len(r["text"].encode().split())
    for s, want in water_fill(sizes).items():   # whole rounds of the source, then the best sum of documents below the rest
        whole, reach = int(want // sizes[s]), 1
        for r in single:
            if r["source"] == s:
                reach |= reach << len(r["text"].encode().split())
        rest = round(want - whole * sizes[s])
        assert taken[s] == whole * sizes[s] + (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected, windows = collections.Counter(), collections.defaultdict(list)
    for i, n in times.items():
        ids = plain.encode(by_id[i]["text"], add_special_tokens=False).ids + [1]
        for start, length in packing.cut(len(ids), packing.CAPACITY, packing.PART):
            expected[i, start, length, len(ids), zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length]))] += n
    assert expected == collections.Counter((r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["ids_crc32"]) for r in result)
    for r in result:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_every_query_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
