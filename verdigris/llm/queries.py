"""The corpus queries (spark, sf_dir) -> DataFrame and their DuckDB restatements."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (
    block_names,
    chat_format,
    language,
    line_crf,
    line_dedup,
    minhash,
    mixing,
    packing,
    periodic,
    pii,
    secret_scan,
    spelling,
    warc,
)
from .common import table

QUERIES, ORACLES = {}, {}
#: Queries beside the ten, which are one per number.
FURTHER = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f
    return add


@query("op9_block_names", r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, max(chars) AS most FROM t GROUP BY norm),
k AS (SELECT t.norm, min(t.doc_id) AS keep_id FROM t JOIN g ON t.norm = g.norm AND t.chars = g.most GROUP BY t.norm)
SELECT t.doc_id, k.keep_id, g.group_size, t.doc_id = k.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm JOIN k ON t.norm = k.norm
""")
def op9_block_names(spark, sf_dir):
    groups = block_names.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op1_minhash_bayes")
def op1_minhash_bayes(spark, sf_dir):
    groups = minhash.near_groups(table(spark, sf_dir, "documents"), size=3, percent=85)
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


@query("op2_line_crf")
def op2_line_crf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    field = line_crf.train(docs, table(spark, sf_dir, "labels"))
    return line_crf.rule_table(docs, field).drop("line_labels")


@query("op4_line_dedup", r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
u AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS unit FROM d),
n AS (SELECT doc_id, unit, line,
             sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY unit) - length(line) - 1 AS starts,
             trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM u),
q AS (SELECT *, len(regexp_extract_all(norm, '[^ ]+')) >= 8 AS counted FROM n),
r AS (SELECT *, counted AND row_number() OVER (PARTITION BY norm, counted ORDER BY doc_id NULLS LAST, unit) > 1 AS gone FROM q),
-- the words of every line, each with the white space behind it; places count those of the lines that stay
w AS (SELECT doc_id, unit, starts, gone, unnest(regexp_extract_all(line, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*')) AS piece,
             unnest(range(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*')))) AS i,
             regexp_extract(line, '^[\x20\x09-\x0D]*') AS lead FROM r),
p AS (SELECT *, count(*) FILTER (NOT gone) OVER (PARTITION BY doc_id ORDER BY unit, i) - 1 AS place,
             starts + length(lead) + sum(length(piece)) OVER (PARTITION BY doc_id, unit ORDER BY i) AS ends,
             translate(regexp_extract(piece, '^[^\x20\x09-\x0D]+'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM w),
a AS (SELECT doc_id, list(word ORDER BY place) AS words FROM p WHERE NOT gone GROUP BY doc_id HAVING count(*) >= 50),
h AS (SELECT doc_id, words, unnest(range(len(words) - 49)) AS place FROM a),
g AS (SELECT doc_id, place, md5(array_to_string(list_slice(words, place + 1, place + 50), ' ')) AS run FROM h),
f AS (SELECT *, first_value(doc_id) OVER runs AS doc, first_value(place) OVER runs AS earliest FROM g
      WINDOW runs AS (PARTITION BY run ORDER BY doc_id NULLS LAST, place)),
x AS (SELECT doc_id, CASE WHEN doc IS NOT DISTINCT FROM doc_id THEN greatest(place, earliest + 50) ELSE place END AS lo, place + 50 AS hi
      FROM f WHERE doc IS DISTINCT FROM doc_id OR earliest < place),
e AS (SELECT doc_id, place, sum(step) AS step FROM (SELECT doc_id, lo AS place, 1 AS step FROM x UNION ALL SELECT doc_id, hi, -1 FROM x) GROUP BY doc_id, place),
m AS (SELECT p.*, NOT gone AND sum(CASE WHEN gone THEN 0 ELSE coalesce(step, 0) END) OVER (PARTITION BY p.doc_id ORDER BY unit, i) > 0 AS dropped
      FROM p LEFT JOIN e ON p.doc_id IS NOT DISTINCT FROM e.doc_id AND p.place = e.place AND NOT gone),
-- stretches of removed words, in the whole text and inside a line
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY unit, i) - row_number() OVER (PARTITION BY doc_id, gone OR dropped ORDER BY unit, i) AS stretch,
             i - row_number() OVER (PARTITION BY doc_id, unit, dropped ORDER BY i) AS inner_stretch,
             bool_and(dropped) OVER (PARTITION BY doc_id, unit) AS whole FROM m),
long AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM s WHERE gone OR dropped GROUP BY doc_id, stretch HAVING count(*) >= 50) GROUP BY doc_id),
cuts AS (SELECT doc_id, unit, min(ends - length(piece)) AS lo, max(ends) AS hi FROM s WHERE dropped AND NOT whole GROUP BY doc_id, unit, inner_stretch
         UNION ALL SELECT DISTINCT s.doc_id, s.unit, r.starts, r.starts + length(r.line) FROM s JOIN r ON s.doc_id IS NOT DISTINCT FROM r.doc_id AND s.unit = r.unit WHERE whole),
cut AS (SELECT doc_id, count(*) AS n, sum(hi - lo) AS chars, string_agg(CAST(lo AS BIGINT) || ':' || CAST(hi AS BIGINT), ',' ORDER BY lo) AS spans FROM cuts GROUP BY doc_id),
l AS (SELECT doc_id, unit, lead || coalesce(string_agg(piece, '' ORDER BY i) FILTER (NOT dropped), '') AS line, whole FROM s GROUP BY doc_id, unit, lead, whole),
k AS (SELECT r.doc_id, r.unit, r.line AS full_line, r.starts, counted, gone, coalesce(l.line, r.line) AS line, gone OR coalesce(l.whole, false) AS off
      FROM r LEFT JOIN l ON r.doc_id IS NOT DISTINCT FROM l.doc_id AND r.unit = l.unit),
t AS (SELECT doc_id, CAST(count(*) FILTER (counted) AS BIGINT) AS n_units, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
             CAST(coalesce(sum(length(full_line)) FILTER (gone), 0) AS BIGINT) AS removed_chars,
             coalesce(string_agg(CAST(starts AS BIGINT) || ':' || CAST(starts + length(full_line) AS BIGINT), ',' ORDER BY unit) FILTER (gone), '') AS spans,
             sha256(coalesce(string_agg(line, chr(10) ORDER BY unit) FILTER (NOT off), '')) AS kept_sha256 FROM k GROUP BY doc_id)
SELECT t.*, CAST(coalesce(cut.n, 0) AS BIGINT) AS n_passages, CAST(coalesce(cut.chars, 0) AS BIGINT) AS passage_chars,
       coalesce(cut.spans, '') AS passage_spans, CAST(coalesce(long.n, 0) AS BIGINT) AS n_long
FROM t LEFT JOIN cut ON t.doc_id IS NOT DISTINCT FROM cut.doc_id LEFT JOIN long ON t.doc_id IS NOT DISTINCT FROM long.doc_id
""")
def op4_line_dedup(spark, sf_dir):
    """Lines, then passages inside and across lines; all spans are code points of the original text."""
    out = line_dedup.drop_passages(table(spark, sf_dir, "documents"))
    spans = lambda name: F.concat_ws(",", F.transform(name, lambda x: F.concat_ws(":", x["start"], x["end"])))
    chars = lambda name: F.aggregate(name, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_units", F.size("lines").cast("long").alias("n_removed"), chars("lines").alias("removed_chars"),
                      spans("lines").alias("spans"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
                      F.size("passages").cast("long").alias("n_passages"), chars("passages").alias("passage_chars"),
                      spans("passages").alias("passage_spans"), "n_long")


def passage_dedup(spark, sf_dir):
    """op4's line removal, then that of passages inside and across lines."""
    out = line_dedup.drop_passages(table(spark, sf_dir, "documents"))
    length = lambda name: F.aggregate(name, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("passages").cast("long").alias("n_passages"),
                      length("lines").alias("line_chars"), length("passages").alias("passage_chars"),
                      F.concat_ws(",", F.transform("passages", lambda x: F.concat_ws(":", x["start"], x["end"]))).alias("spans"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


FURTHER["passage_dedup"] = passage_dedup


@query("op8_mixing")
def op8_mixing(spark, sf_dir):
    plan = mixing.plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


@query("op10_packing")
def op10_packing(spark, sf_dir):
    return packing.packed_pieces(table(spark, sf_dir, "documents"), added=True)


def _span_columns(found, counted, base):
    """n_<kind> for ``counted``, base_sha256 over the spans of ``base`` kinds, and all spans as text."""
    join = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda kinds: F.filter("spans", lambda x: x["kind"].isin(list(kinds)))
    return found.select("doc_id", *(F.size(of([k])).cast("long").alias(f"n_{k}") for k in counted),
                        F.sha2(join(of(base)), 256).alias("base_sha256"), join(F.col("spans")).alias("spans"))


@query("op5_pii_anchors")
def op5_pii_anchors(spark, sf_dir):
    return _span_columns(pii.find_pii(table(spark, sf_dir, "documents")), pii.BASE, pii.BASE)


@query("op6_secret_trigrams")
def op6_secret_trigrams(spark, sf_dir):
    base = [r.name for r in secret_scan.BASE]
    return _span_columns(secret_scan.find_secrets(table(spark, sf_dir, "documents")), base, base)


@query("op7_chat_masks")
def op7_chat_masks(spark, sf_dir):
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                    F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_format.read_back(chat_format.format_chats(chats.unionByName(control)))


@query("op3_warc_bundles", r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, min(page_id) AS first_id, octet_length(encode(html)) >= 100 AS large FROM p GROUP BY html)
SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, sha256(p.html) AS payload_digest,
       CASE WHEN g.large AND p.page_id <> g.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.large AND p.page_id <> g.first_id THEN g.first_id END AS refers_to
FROM p JOIN g ON p.html = g.html
""")
def op3_warc_bundles(spark, sf_dir):
    index = warc.write_archives(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.resolved(warc.read_archives(index.select("archive").distinct()), index)


#: Documents with this remainder of crc32(doc_id as text) by 3 are held out from training.
HELD_OUT = 1


@query("op11_language_id")
def op11_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == HELD_OUT
    found = language.predict(docs, language.train(docs, ~held_out))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def with_repeats(docs):
    """doc_id and text; where crc32 h of the doc_id ends in 0, words from a on repeat with period p (a, p by h and the word count)."""
    h = F.crc32(F.col("doc_id").cast("string"))
    d = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.filter(
        F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("words"))
    d = d.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn(
        "p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    source = lambda i: F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i).cast("int")
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1), lambda i: F.get("words", source(i)))
    return d.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    found = periodic.periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: Words whose crc32 this divides lose a code point, so that there are misspellings to find.
SPOILT = 97


@query("op13_spelling_variants")
def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), spoil=SPOILT))
