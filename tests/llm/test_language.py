"""Language identification: held-out accuracy, calibration, defined results, slices."""

import random
import zlib

import numpy as np
import pytest
from llm.conftest import frame, odd_rows
from pyspark.sql import functions as F
from verdigris.llm import language, queries

TONGUES = {"aa": ["ta", "ko", "ri", "mu"], "bb": ["sch", "ein", "ung", "ver"], "cc": ["ção", "ñi", "é", "lla"]}


def speech(tongue, seed, words):
    r = random.Random(f"{tongue}{seed}")
    return " ".join("".join(r.choice(TONGUES[tongue]) for _ in range(r.randrange(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def model():
    rows = [(language.letters(speech(t, n, 60)), t) for n in range(40) for t in TONGUES]
    return language.fit([t for t, _ in rows], [x for _, x in rows])


def test_query_learns_from_training_documents_and_is_right_on_the_others(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = queries.QUERIES["op11_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in got) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.985
    taken = [r for r in held if not r.rejected]
    assert len(taken) > 0.9 * len(held) and np.mean([r.lang_pred == lang[r.doc_id] for r in taken]) > 0.985


def test_labels_of_held_out_documents_are_never_read(spark):
    rows = [(n, speech(t, n, 30), t if n % 2 else "zz", "s") for n in range(60) for t in TONGUES]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = language.train(docs, F.col("doc_id") % 2 == 1)
    assert found.languages == sorted(TONGUES)


def test_scores_are_calibrated(model):
    r = random.Random(5)
    rows = [(speech(t, 1000 + n, r.randrange(1, 4)), t) for n in range(300) for t in TONGUES]
    p = model.scores([language.letters(x) for x, _ in rows])
    right = np.array([model.languages[i] == t for i, (_, t) in zip(p.argmax(axis=1), rows)])
    assert abs(right.mean() - p.max(axis=1).mean()) < 0.05
    taken = p.max(axis=1) >= model.least
    assert right[taken].mean() > 0.97 and taken.mean() > 0.5


def test_the_mean_is_that_of_single_subwords(model):
    text = language.letters("Verschein, kota-éllaung x")
    assert text == " verschein kota éllaung x "
    want = sorted(g for w in text.split() for n in language.SIZES for g in [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)])
    got = [text[i : i + n] for n, (at, _) in zip(language.SIZES, language._subwords(language._points(text), len(text))) for i in at]
    assert sorted(got) == want
    count, total = model.sums([text])
    assert count[0] == len(want) and (total[:, 0] == model.products[:, language.buckets(text)].sum(axis=1)).all()


def test_slices_change_nothing(model, monkeypatch):
    texts = [language.letters(speech(t, n, n + 1)) for n in range(30) for t in TONGUES]
    whole = model.sums(texts)
    for size in (1, 7, 64, 300):
        monkeypatch.setattr(language, "SLICE", size)
        cut = model.sums(texts)
        assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_odd_rows(spark, odd, empty, model):
    got = language.predict(odd, model).collect()
    assert len(got) == len(odd_rows())
    none = [r for r in got if r.lang_pred == "und"]
    assert all(r.score == 0 and r.rejected for r in none)
    assert sum(not any(c.isalpha() for c in t or "") for _, t, _ in odd_rows()) == len(none)
    assert all(r.lang_pred == "und" and r.score == 0 for r in language.predict(odd, None).collect())
    assert language.predict(empty, model).collect() == [] and language.train(empty, F.lit(True)) is None
    assert language.train(odd.withColumn("lang", F.lit(None)), F.lit(True)) is None
    assert language.train(odd, F.lit(True)).languages == ["en"]


def test_broken_bytes(spark, model):
    docs = spark.createDataFrame([(1, bytearray(b"ta\xffko ri"))], "doc_id long, text binary").selectExpr("doc_id", "cast(text as string) text")
    assert language.predict(docs, model).first().lang_pred == "aa"
    assert language.train(docs.withColumn("lang", F.lit("x")), F.lit(True)).languages == ["x"]
