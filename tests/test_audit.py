"""Section audit: outcomes as the rules give them, and the text rules against plain Python ``re``."""

import json
import re

import pytest
from pyspark.sql import functions as F

from verdigris.operators import audit
from verdigris.sources import sections

from conftest import SF0001

CRAFTED = [
    "We are proud: our team cut 1,199.7924 tCO2e and 3,402.997 tCO2e (approximately 12.5%).",
    "Scope I and scope II; I think I can. US operations; us; Müus; ourselves.",
    "See https://example.org/x?y=1 and http://a.b. According to the ministry, output rose.",
    "Industry-leading, best in class, world-class and cutting edge results; revolutionary!",
    "500000 tCO2e, 12.3.4%, 7 per FTE, 0.0123 tCO2e/IDR, 45 per IDR billion {unresolved_key} {Bad}",
    "",
]


METRICS = [("m", "scope1_tco2e", 500.0), ("m", "scope1_natgas_tco2e", 300.0), ("m", "scope1_diesel_tco2e", 200.0), ("m", "yoy_change_pct", -4.5),
           ("m", "scope3_cat15_gross_tco2e", 9000.0), ("m", "scope3_cat15_weighted_tco2e", 6000.0),
           ("draft", "scope1_tco2e", 500.0), ("draft", "scope3_cat15_gross_tco2e", 9000.0), ("draft", "scope3_cat15_weighted_tco2e", 9500.0)]


def section(text, cell="500.0", advice=("a", "b"), **other):
    base = {"section_id": "GRI_305_SCOPE1_2000", "title": "t", "paragraphs": [{"paragraph_type": "narrative", "text": text}],
            "tables": [{"caption": "c", "headers": ["Measure", "Value"], "rows": [["Total", cell]]}],
            "key_metrics": [{"metric": "total", "value": 500.0, "unit": "tCO2e"}], "footnotes": [], "framework_references": ["GRI 305"],
            "data_sources_used": ["s"], "advisory_recommendations": list(advice)}
    return json.dumps({k: v for k, v in (base | other).items() if v is not None})


#: (metrics, retry count, section, outcome, status, rules found), as the rules give them
EXPECTED = [
    ("m", 0, section("Scope 1 was 500.0 tCO2e."), "PASS", "INCLUDED", set()),
    ("m", 0, section("Scope 1 was 500.0 tCO2e.", advice=()), "WARN", "INCLUDED_WITH_WARNINGS", {"VAL-STR-10"}),
    ("m", 0, section("Scope 1 was 777.0 tCO2e."), "RETRY", "RETRY_PENDING", {"VAL-NUM-01", "VAL-NUM-07"}),
    ("m", 1, section("Scope 1 was 777.0 tCO2e.", "777.0"), "FAIL", "INCLUDED_WITH_WARNINGS", {"VAL-NUM-01"}),
    ("m", 0, section("Scope 1 was 777.0 tCO2e and 888.0 tCO2e, once 500.0 tCO2e."), "FAIL", "INCLUDED_WITH_WARNINGS", {"VAL-NUM-01"}),
    ("m", 0, section("We cut 500.0 tCO2e, a 4.5 % change."), "FAIL", "INCLUDED_WITH_WARNINGS", {"VAL-PRH-04", "VAL-NUM-04"}),
    ("draft", 0, section("Scope 1 was 500.0 tCO2e."), "FAIL_NO_RETRY", "HUMAN_REVIEW", {"VAL-NUM-06"}),
    ("m", 0, section("x", tables=None), "FAIL", "INCLUDED_WITH_WARNINGS", {"VAL-STR-02", "VAL-STR-06"}),
    ("m", 0, "{", "RETRY", "RETRY_PENDING", {"VAL-STR-01"}),
    ("m", 1, "{", "ERROR", "ERROR", {"VAL-STR-01"}),
]


def test_outcomes(spark):
    rows = [(i, m, n, text) for i, (m, n, text, *_) in enumerate(EXPECTED)]
    sec = spark.createDataFrame(rows, "section_key long, metrics_key string, retry_count int, content_json string")
    metrics = spark.createDataFrame(METRICS, "metrics_key string, metric string, value double")
    out = {r.section_key: r for r in audit.audit(sec, metrics).collect()}
    p = audit.structure_findings(audit.parse_sections(sec))
    found = audit.section_structure(p).select("section_key", "rule").unionByName(audit.numeric_findings(p, metrics).select("section_key", "rule")) \
        .unionByName(audit.prohibited_findings(p).select("section_key", "rule")).collect()
    for i, (_, _, _, outcome, status, rules) in enumerate(EXPECTED):
        assert (out[i].outcome if status != "ERROR" else "ERROR", out[i].status) == (outcome, status), i
        assert {r.rule for r in found if r.section_key == i} == rules, i


def _generated(spark):
    from verdigris.plans.catalog_core import core
    c = core(spark, SF0001)
    summary = c.summary()
    return sections.sections_from_documents(c.inp.raw("documents"), summary), sections.report_metrics(summary)


def test_generated_sections_reach_every_rule_and_type(spark):
    sec, metrics = _generated(spark)
    p = audit.structure_findings(audit.parse_sections(sec)).cache()
    rules = {r.rule for r in audit.content_findings(p, metrics).select(F.explode("content").alias("f")).select("f.rule").distinct().collect()}
    assert rules >= {f"VAL-NUM-0{i}" for i in (1, 2, 3, 5, 6, 7)} | {f"VAL-PRH-0{i}" for i in (2, 3, 4, 5)}
    types = {r.section_type for r in p.select("section_type").distinct().collect()}
    assert types == {t for t, _ in audit.SECTION_MARKS} | {"unknown"}
    outcomes = {r.outcome for r in audit.audit(sec, metrics).select("outcome").distinct().collect()}
    assert outcomes == {"PASS", "WARN", "RETRY", "FAIL", "FAIL_NO_RETRY"}


@pytest.mark.parametrize("sid,kind", [("UNIFIED_S2_SOCIAL_2000", "social"), ("IFRS_S2_SOCIAL_2000", "scope2"), ("GRI_305_S3_X_2000", "scope3_pcaf"),
                                      ("A_305-5_2000", "reduction"), ("GRI_305_GOV_2000", "governance"), ("X_MATERIALITY_2000", "double_materiality"),
                                      ("UNIFIED_SUMMARY_2000", "summary"), ("", "unknown")])
def test_section_types(spark, sid, kind):
    assert spark.range(1).select(audit.section_type(F.lit(sid))).first()[0] == kind


def test_claims_keep_long_numbers_and_years(spark):
    text = "Scope 1 for 2000 came to 1450.00 tCO2e; diesel in 1999 gave 3402.997 tCO2e."
    sec = spark.createDataFrame([(1, "m", 0, section(text))], "section_key long, metrics_key string, retry_count int, content_json string")
    metrics = spark.createDataFrame([("m", "scope1_tco2e", 1450.0)], "metrics_key string, metric string, value double")
    p = audit.parse_sections(sec)
    got = {(r.label, r.claimed_value, r.matches) for r in audit.claim_metric_mapping(p, metrics).collect()}
    assert got == {("scope 1", 1450.0, True), ("diesel", 3402.997, None)}
    assert [r.value for r in audit.extract_claims(p, "section_key", "all_text").collect()][:2] == [1450.0, 3402.997]


def test_footnote_numbers_by_ranges_equal_plain_order(spark):
    rows = [(k, f"m{k % 2}", 0, json.dumps({"footnotes": [f"n{(k * 7) % 31}", f"n{(k * 11) % 43}", f"n{(k * 7) % 31}"]})) for k in range(200)]
    sec = spark.createDataFrame(rows, "section_key long, metrics_key string, retry_count int, content_json string")
    want, places = {}, {}
    for k, m, _, text in rows:
        for n in json.loads(text)["footnotes"]:
            places[m, n] = want.setdefault(m, {}).setdefault(n, len(want[m]) + 1)
    assert {(r.metrics_key, r.footnote): r.footnote_no for r in audit.footnote_index(sec).collect()} == places
    got = {r.section_key: r.footnote_nos for r in audit.footnote_places(sec).collect()}
    assert got[3] == ",".join(str(places["m1", n]) for n in json.loads(rows[3][3])["footnotes"])


def test_invalid_json_is_retry(spark):
    df = spark.createDataFrame([(1, "m", 0, "not json"), (2, "m", 0, "[1, 2]")],
                               "section_key long, metrics_key string, retry_count int, content_json string")
    m = spark.createDataFrame([("m", "scope1_tco2e", 1.0)], "metrics_key string, metric string, value double")
    assert {r.outcome for r in audit.audit(df, m).collect()} == {"RETRY"}


def _texts(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text")
    crafted = spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(CRAFTED)], "doc_id long, text string")
    return docs.unionByName(crafted)


@pytest.mark.parametrize("strict", [True, False])
def test_claims_match_python_re(spark, strict):
    texts = _texts(spark)
    got = sorted((r.doc_id, r.claim_no, r.raw, r.unit)
                 for r in audit.extract_claims(texts, "doc_id", "text", strict).collect())
    pat = re.compile(audit.NUMERIC_PATTERN_STRICT if strict else audit.NUMERIC_PATTERN)
    want = sorted((r.doc_id, i, v, u) for r in texts.collect() for i, (v, u) in enumerate(pat.findall(r.text or "")))
    assert got == want


def test_prohibited_hits_match_python_re(spark):
    texts = _texts(spark)
    got = {(r.doc_id, r.rule): r.hits for r in audit.prohibited_hits(texts, "doc_id", "text").collect()}
    want = {}
    for r in texts.collect():
        for rule, _, pat in audit.PROHIBITED + [("VAL-PLACEHOLDER", "error", audit.PLACEHOLDER_PATTERN)]:
            py = re.compile(pat.replace("(?U)", ""))
            n = sum(1 for _ in py.finditer(r.text or ""))
            if n:
                want[(r.doc_id, rule)] = n
    assert got == want


ODD = ["1.5% 12,345.678 tCO2e,1.2 % .5% 1,2.3% 7.25\n%", "0.12345tCO2e/IDR 0.1234 per FTE 10.00000\tper IDR 1.23 per IDR 0.99999 tCO2e/FTE", "I. AI I'm (I) _I I_ Ié éI 2I\nI",
       "WE we, ourselves ourself hours bus us\u0301 US_ my.our", "Roughly\nwe Estimate we  estimate; approximately2 divided by multiplied by", "world-class worldXclass best in class Pioneering",
       "3 per employee 4 per IDR billion 1,000,00 IDR 9GJ 1234,567MWh ١٢% 5\u00a0%", "x12.3% a1b2.5% 2.5%%"]


def test_quick_patterns_find_what_the_rules_find(spark):
    texts = CRAFTED + ODD + [r.text or "" for r in _texts(spark).limit(150).collect()]
    whole = {audit.NUMERIC_PATTERN: 0, audit.PCT_PATTERN: 1, audit.INTENSITY_PATTERN: 1}
    assert len(audit.QUICK) == 7 and set(audit.QUICK) <= {p for _, _, p in audit.PROHIBITED} | set(whole)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for plain, fast in audit.QUICK.items():
        group = whole.get(plain, 0)
        rows = df.select(F.regexp_extract_all("t", F.lit(plain), F.lit(group)).alias("a"), F.regexp_extract_all("t", F.lit(fast), F.lit(0)).alias("b")).collect()
        assert any(r.a for r in rows) and [r.a for r in rows] == [r.b for r in rows], plain


def test_audit_searches_a_text_once_per_rule(spark):
    """Four patterns of numbers and the first hit of six rules; the raw lines are read once for the summary."""
    from verdigris.plans import catalog_text
    sec, metrics = _generated(spark)
    plan = audit.audit(sec, metrics)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 4
    made = []
    keep = catalog_text.materialize
    catalog_text.materialize = lambda df, name: made.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or keep(df, name)
    try:
        catalog_text._summary(spark, SF0001)
    finally:
        catalog_text.materialize = keep
    assert [name for name, _ in made] == ["audit-energy", "audit-summary"]
    assert sum(p.count("l_shipdate") > 0 for _, p in made) == 1


def test_tolerance_join_equals_brute_force(spark):
    left = spark.createDataFrame([(1, "k", v) for v in [0.0, 0.0009, 0.0011, 1.0, 2.4995, 1e15, -3.0]],
                                 "id int, metrics_key string, value double").withColumn("id", F.monotonically_increasing_id())
    right = spark.createDataFrame([("k", 0.001), ("k", 2.5), ("k", 1e15 + 0.0005), ("k", -3.001)],
                                  "metrics_key string, allowed double")
    semi = {r.value for r in audit.match_tolerance(left, right, ["metrics_key"], "value", "allowed", 0.001).collect()}
    allowed = [r.allowed for r in right.collect()]
    want = {r.value for r in left.collect() if any(abs(r.value - a) <= 0.001 for a in allowed)}
    assert semi == want


def test_single_pass_matches_range_join_path(spark):
    """Unmatched claims: per-row allowed-array check == bucketed tolerance join + anti join."""
    sec, met = _generated(spark)
    p = audit.structure_findings(audit.parse_sections(sec))
    single = {(r.section_key, r.detail) for r in audit.numeric_findings(p, met).collect() if r.rule == "VAL-NUM-01"}
    ok = p.filter(~F.col("struct_error"))
    claims = audit.extract_claims(ok, "section_key", "all_text").filter(F.col("value").isNotNull()) \
        .join(ok.select("section_key", "metrics_key"), "section_key") \
        .filter(~F.col("value").isin(*audit.WHITELISTED_VALUES))
    anti = audit.match_tolerance(claims, audit.allowed_values(met), ["metrics_key"], "value", "allowed",
                                 audit.TOLERANCE_TCO2E, "left_anti")
    joined = {(r.section_key, f"{r.value:.6f} {r.unit}") for r in anti.collect()}
    assert single == joined
    assert len(single) > 0
