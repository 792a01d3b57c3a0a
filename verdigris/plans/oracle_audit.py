"""Oracle SQL of the section audit: DuckDB parses the sections' JSON and applies the rules itself.

The sections come from the generator's SQL over DuckDB's own summary. Rules,
word lists and tables are written out here and not read from the operators.
Java's word boundary counts letters of every script, RE2's only ASCII, so
boundaries are spelled as a character that is no letter, digit or underscore.
"""

from __future__ import annotations

from ..sources import sections
from . import oracle_core  # noqa: F401  (registers the summary)
from .oracle_text import CLAIM_RE2
from .sqltext import fragment, with_ctes

WHITE = ", ".join(f"{float(x)!r}" for x in [*range(2020, 2031), 2035, 2050, 2060, 29.8, 273, 1, 1.5, 2, 3, 4, 5, 0.45, 0.6, 0.75, 0.9, 100, 0, 0.7886])

fragment("sec_slots", sections.slots_sql("ghg_summary_annual"), ["ghg_summary_annual"])
fragment("sec_raw", sections.sections_sql("documents", "sec_slots", "CAST(to_json({text}) AS VARCHAR)", "(SELECT count(*) FROM sec_slots)"), ["sec_slots"])
fragment("sec_long", " UNION ALL ".join(f"SELECT metric_key, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM ghg_summary_annual" for m in sections.METRICS),
         ["ghg_summary_annual"])
fragment("sec_metrics", sections.METRICS_SQL.format(long="sec_long"), ["sec_long"])
fragment("sec_wide", "SELECT metrics_key, " + ", ".join(f"MAX(value) FILTER (WHERE metric = '{m}') AS {m}" for m in sections.METRICS)
         + " FROM sec_metrics GROUP BY metrics_key", ["sec_metrics"])
fragment("sec_json", """
SELECT section_key, metrics_key, retry_count, json_valid(content_json) AS valid,
       CASE WHEN json_valid(content_json) THEN CAST(content_json AS JSON) END AS j FROM sec_raw""", ["sec_raw"])

_TYPES = [("scope1", "scope1"), ("scope1", "_s1_"), ("scope2", "scope2"), ("scope2", "_s2_"), ("scope3_pcaf", "pcaf"), ("scope3_pcaf", "scope3"),
          ("scope3_pcaf", "_s3_"), ("intensity", "intensity"), ("social", "social"), ("reduction", "reduction"), ("reduction", "305-5"),
          ("summary", "summary"), ("governance", "gov"), ("targets", "target"), ("double_materiality", "materiality")]
_UNIFIED = ["scope1", "scope2", "pcaf", "scope3", "intensity", "reduction", "social", "governance", "targets"]
_NAMED = dict(pcaf="scope3_pcaf", scope3="scope3_pcaf")
_TYPE = ("CASE " + " ".join(f"WHEN contains(l, 'unified') AND contains(l, '{m}') THEN '{_NAMED.get(m, m)}'" for m in _UNIFIED) + " "
         + " ".join(f"WHEN contains(l, '{m}') THEN '{t}'" for t, m in _TYPES) + " ELSE 'unknown' END")
fragment("sec_parsed", f"""
SELECT *, {_TYPE} AS section_type,
       array_to_string(list_concat(list_transform(texts, lambda x: coalesce(x, '')), coalesce(cells, CAST([] AS VARCHAR[]))), ' ') AS all_text
FROM (SELECT *, lower(section_id) AS l,
             coalesce(CAST(j->'$.paragraphs[*].text' AS VARCHAR[]), CAST([] AS VARCHAR[])) AS texts0,
             coalesce(j->>'$.paragraphs[*].text', CAST([] AS VARCHAR[])) AS texts,
             coalesce(j->>'$.tables[*].rows[*][*]', CAST([] AS VARCHAR[])) AS cells
      FROM (SELECT *, coalesce(j->>'$.section_id', '') AS section_id FROM sec_json) a) b""".replace(
    "coalesce(CAST(j->'$.paragraphs[*].text' AS VARCHAR[]), CAST([] AS VARCHAR[])) AS texts0,\n             ", ""), ["sec_json"])

_KEYS = ["footnotes", "framework_references", "key_metrics", "paragraphs", "section_id", "tables", "title"]
_MISSING = "array_to_string(list_filter([" + ", ".join(f"'{k}'" for k in _KEYS) + "], lambda k: NOT list_contains(json_keys(j), k)), ',')"
_QUANT = "section_type IN ('scope1', 'scope2', 'scope3_pcaf', 'intensity', 'summary')"
_BAD = ("array_to_string(list_filter(coalesce(j->>'$.paragraphs[*].paragraph_type', CAST([] AS VARCHAR[])), "
        "lambda t: t NOT IN ('narrative', 'methodology', 'footnote', 'forward_looking')), ',')")
# every table here has one header list; its rows are counted cell by cell
_RAGGED = ("len(list_filter(coalesce(j->'$.tables[0].rows[*]', CAST([] AS JSON[])), "
           "lambda r: json_array_length(r) <> json_array_length(j, '$.tables[0].headers'))) > 0")
_STRUCTURE = [
    ("VAL-STR-01", "retry", "NOT valid", "'not a JSON object'"),
    ("VAL-STR-02", "error", f"valid AND {_MISSING} <> ''", _MISSING),
    ("VAL-STR-03", "warning", "valid AND NOT regexp_matches(section_id, '^[A-Z0-9_]+_[A-Z0-9]+_[0-9]{4}$')", "section_id"),
    ("VAL-STR-04", "warning", "valid AND coalesce(json_array_length(j, '$.paragraphs'), 0) = 0", "'empty paragraphs'"),
    ("VAL-STR-05", "error", f"valid AND {_BAD} <> ''", _BAD),
    ("VAL-STR-06", "error", f"valid AND {_QUANT} AND coalesce(json_array_length(j, '$.tables'), 0) = 0", "'no tables'"),
    ("VAL-STR-07", "error", f"valid AND {_RAGGED}", "'row length differs from headers'"),
    ("VAL-STR-08", "error", f"valid AND {_QUANT} AND coalesce(json_array_length(j, '$.key_metrics'), 0) = 0", "'no key_metrics'"),
    ("VAL-STR-09", "warning", "valid AND coalesce(json_array_length(j, '$.data_sources_used'), 0) = 0", "'data_sources_used empty'"),
    ("VAL-STR-10", "warning", "valid AND coalesce(json_array_length(j, '$.advisory_recommendations'), 0) < 2", "'advisory_recommendations < 2'"),
]
fragment("sec_structure", " UNION ALL ".join(
    f"SELECT section_key, '{r}' AS rule, '{s}' AS severity, {d} AS detail FROM sec_parsed WHERE {c}" for r, s, c, d in _STRUCTURE), ["sec_parsed"])
fragment("sec_ok", """
SELECT * FROM sec_parsed p WHERE NOT EXISTS (
  SELECT 1 FROM sec_structure f WHERE f.section_key = p.section_key AND f.severity IN ('error', 'retry'))""", ["sec_parsed", "sec_structure"])


def _numbers(name: str, pattern: str, src: str = "sec_ok") -> None:
    fragment(name, f"""
SELECT * FROM (SELECT section_key, metrics_key, TRY_CAST(replace(x, ',', '') AS DOUBLE) AS v
FROM (SELECT section_key, metrics_key, unnest(regexp_extract_all(all_text, '{pattern}', 1)) AS x FROM {src}) a) b WHERE v IS NOT NULL""", [src])


fragment("sec_claims", f"""
SELECT section_key, metrics_key, CAST(claim_no AS INTEGER) AS claim_no, raw, TRY_CAST(replace(raw, ',', '') AS DOUBLE) AS value, unit
FROM (SELECT section_key, metrics_key, unnest(generate_series(0, len(v) - 1)) AS claim_no, unnest(v) AS raw, unnest(u) AS unit
      FROM (SELECT section_key, metrics_key, regexp_extract_all(all_text, '{CLAIM_RE2}', 1) AS v,
                   regexp_extract_all(all_text, '{CLAIM_RE2}', 2) AS u FROM sec_parsed) a) b""", ["sec_parsed"])
_numbers("sec_pct", r"(\d+\.\d+)\s*%")
_numbers("sec_yoy", r"(?i)(-?\d+\.\d+)\s*%.*(?:year.over.year|YoY|change)")
_numbers("sec_int", r"(\d+\.\d{4,})\s*(?:tCO2e/IDR|per IDR|per FTE|tCO2e/FTE)")
fragment("sec_allowed", f"""
SELECT metrics_key, unnest([value, abs(value), value * 1000, value / 1000, value * 100, round(value, 1), round(value, 2), round(value, 3),
                            round(value, 4), round(value, 6)]) AS a FROM sec_metrics WHERE value IS NOT NULL
UNION ALL SELECT DISTINCT metrics_key, unnest([{WHITE}]) FROM sec_metrics""", ["sec_metrics"])
_NUM = lambda x: f"coalesce(CAST(TRY_CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,6)) AS VARCHAR), 'large')"
_KNOWN = lambda x, tol: (f"{x} IN ({WHITE}) OR EXISTS (SELECT 1 FROM sec_allowed a WHERE a.metrics_key = c.metrics_key "  # noqa: E731
                         f"AND abs(a.a - {x}) <= {tol})")
fragment("sec_numeric", f"""
SELECT c.section_key, 'VAL-NUM-01' AS rule, 'error' AS severity, {_NUM('c.value')} || ' ' || c.unit AS detail
FROM sec_claims c JOIN sec_ok o ON o.section_key = c.section_key WHERE c.value IS NOT NULL AND NOT ({_KNOWN('c.value', '1e-3')})
UNION ALL SELECT section_key, 'VAL-NUM-02', 'error', 'natgas + diesel != scope1_tco2e' FROM sec_ok o JOIN sec_wide w ON w.metrics_key = o.metrics_key
WHERE abs(scope1_tco2e - (scope1_natgas_tco2e + scope1_diesel_tco2e)) > 1e-3
UNION ALL SELECT c.section_key, 'VAL-NUM-03', 'warning', {_NUM('c.v')} || '%' FROM sec_pct c WHERE NOT ({_KNOWN('c.v', '5e-2')})
UNION ALL SELECT c.section_key, 'VAL-NUM-04', 'error', {_NUM('c.v')} || ' vs ' || {_NUM('w.yoy_change_pct')}
FROM sec_yoy c JOIN sec_wide w ON w.metrics_key = c.metrics_key WHERE abs(c.v - w.yoy_change_pct) > 1e-1
UNION ALL SELECT c.section_key, 'VAL-NUM-05', 'error', {_NUM('c.v')} FROM sec_int c JOIN sec_wide w ON w.metrics_key = c.metrics_key
WHERE NOT coalesce(intensity_tco2e_per_idr_bn <> 0 AND abs(c.v - intensity_tco2e_per_idr_bn) <= 1e-6, false)
  AND NOT coalesce(intensity_tco2e_per_fte <> 0 AND abs(c.v - intensity_tco2e_per_fte) <= 1e-6, false) AND c.v NOT IN ({WHITE})
UNION ALL SELECT section_key, 'VAL-NUM-06', 'no_retry', 'weighted ' || {_NUM('scope3_cat15_weighted_tco2e')} || ' > gross ' || {_NUM('scope3_cat15_gross_tco2e')}
FROM sec_ok o JOIN sec_wide w ON w.metrics_key = o.metrics_key WHERE scope3_cat15_weighted_tco2e > scope3_cat15_gross_tco2e
UNION ALL SELECT section_key, 'VAL-NUM-07', 'warning', {_NUM('t')} FROM (
  SELECT DISTINCT section_key, TRY_CAST(replace(replace(c, ',', ''), '%', '') AS DOUBLE) AS t FROM (SELECT section_key, unnest(cells) AS c FROM sec_ok) x) y
WHERE t IS NOT NULL AND t NOT IN ({WHITE})
  AND NOT EXISTS (SELECT 1 FROM sec_claims c WHERE c.section_key = y.section_key AND abs(c.value - t) <= 1e-3)""",
         ["sec_claims", "sec_ok", "sec_wide", "sec_pct", "sec_yoy", "sec_int", "sec_allowed"])

_L, _R_ = r"(?:^|[^\p{L}\p{M}\p{N}_])", r"(?:[^\p{L}\p{M}\p{N}_]|$)"
_PHRASE = [
    ("VAL-PRH-02", "error", f"(?i){_L}(calculated as|computed by|we estimate|approximately|roughly|we calculate|divided by|multiplied by){_R_}", 1),
    ("VAL-PRH-03", "error", r"https?://\S+", 0),
    ("VAL-PRH-03", "warning", r"(?i)according to\s+([^,.]+)", 0),
    ("VAL-PRH-04", "error", f"(?i){_L}(we|our|us|my|ourselves){_R_}", 1),
    ("VAL-PRH-04", "error", f"{_L}(I){_R_}", 1),
    ("VAL-PRH-05", "error", f"(?i){_L}(industry.leading|best.in.class|world.class|cutting.edge|pioneering|unparalleled|groundbreaking|revolutionary){_R_}", 1),
]
fragment("sec_prohibited", " UNION ALL ".join(
    f"SELECT section_key, '{r}' AS rule, '{s}' AS severity, regexp_extract(all_text, '{p}', {g}) AS detail FROM sec_ok WHERE regexp_matches(all_text, '{p}')"
    for r, s, p, g in _PHRASE), ["sec_ok"])
fragment("sec_outcome", """
SELECT *, CASE WHEN NOT valid AND retry_count > 0 THEN 'ERROR' WHEN outcome = 'PASS' THEN 'INCLUDED'
               WHEN outcome IN ('WARN', 'FAIL') THEN 'INCLUDED_WITH_WARNINGS' WHEN outcome = 'RETRY' THEN 'RETRY_PENDING'
               ELSE 'HUMAN_REVIEW' END AS status
FROM (SELECT *, other_errors + CASE WHEN unmatched_claims > 0 THEN 1 ELSE 0 END AS errors,
             CASE WHEN retries > 0 THEN 'RETRY' WHEN struct_errors > 0 THEN 'FAIL' WHEN unmatched_claims = 1 AND retry_count = 0 THEN 'RETRY'
                  WHEN no_retry > 0 THEN 'FAIL_NO_RETRY' WHEN other_errors > 0 OR unmatched_claims > 0 THEN 'FAIL'
                  WHEN warnings > 0 THEN 'WARN' ELSE 'PASS' END AS outcome
      FROM (SELECT p.section_key, p.section_id, p.section_type, p.retry_count, p.valid,
                   COUNT(*) FILTER (WHERE f.severity = 'retry') AS retries,
                   COUNT(*) FILTER (WHERE f.severity = 'error' AND f.rule LIKE 'VAL-STR%') AS struct_errors,
                   COUNT(*) FILTER (WHERE f.rule = 'VAL-NUM-01') AS unmatched_claims,
                   COUNT(*) FILTER (WHERE f.severity = 'no_retry') AS no_retry,
                   COUNT(*) FILTER (WHERE f.severity IN ('error', 'no_retry') AND f.rule <> 'VAL-NUM-01') AS other_errors,
                   COUNT(*) FILTER (WHERE f.severity = 'warning') AS warnings
            FROM sec_parsed p LEFT JOIN (SELECT * FROM sec_structure UNION ALL SELECT * FROM sec_numeric UNION ALL SELECT * FROM sec_prohibited) f
              ON f.section_key = p.section_key GROUP BY ALL) a) b""", ["sec_parsed", "sec_structure", "sec_numeric", "sec_prohibited"])

_ORDER = {
    "GRI_305": ["summary", "scope1", "scope2", "scope3_pcaf", "intensity", "reduction", "social"],
    "IFRS_S2": ["summary", "governance", "scope1", "scope2", "scope3_pcaf", "intensity", "targets", "social"],
    "CSRD_ESRS_E1": ["summary", "governance", "targets", "scope1", "scope2", "scope3_pcaf", "intensity", "reduction", "social", "double_materiality"],
    "OJK_PSPK": ["summary", "governance", "scope1", "scope2", "scope3_pcaf", "intensity", "reduction", "social"],
    "MULTI_FRAMEWORK": ["summary", "scope1", "scope2", "scope3_pcaf", "intensity", "reduction", "governance", "targets", "social", "double_materiality"],
}
_LABELS = [("scope 1", "scope1_tco2e"), ("natural gas", "scope1_natgas_tco2e"), ("diesel", "scope1_diesel_tco2e"), ("scope 2", "scope2_location_tco2e"),
           ("gross financed", "scope3_cat15_gross_tco2e"), ("confidence-weighted", "scope3_cat15_weighted_tco2e")]
_LABEL_RE = "(?i)(" + "|".join(x for x, _ in _LABELS) + r")[^\n]{0,60}?[^\n\d,.](\d+(?:,\d{3})*(?:\.\d+)?)\s*tCO2e"
fragment("sec_notes", """
SELECT metrics_key, section_key, CAST(pos AS INTEGER) AS pos, footnote FROM (
  SELECT metrics_key, section_key, unnest(generate_series(0, len(f) - 1)) AS pos, unnest(f) AS footnote
  FROM (SELECT metrics_key, section_key, coalesce(j->>'$.footnotes[*]', CAST([] AS VARCHAR[])) AS f FROM sec_json) a) b""", ["sec_json"])
fragment("sec_numbered", """
SELECT metrics_key, footnote, CAST(row_number() OVER (PARTITION BY metrics_key ORDER BY s, p) AS INTEGER) AS footnote_no
FROM (SELECT metrics_key, footnote, MIN(section_key) AS s, arg_min(pos, section_key * 1000 + pos) AS p FROM sec_notes GROUP BY 1, 2) x""", ["sec_notes"])
_FIELDS = ["Source:", "EF:", "Methodology:", "Quality:", "Validated:", "Owner:"]
_DISCLOSED = [("Scope 1 Emissions", "scope1", "1111"), ("Scope 2 Emissions", "scope2", "1111"), ("Scope 3 / Financed", "scope3_pcaf", "1111"),
              ("Intensity", "intensity", "1111"), ("Reduction Targets", "targets", "1111"), ("Governance", "governance", "0111"),
              ("Transition Plan", "transition", "0111"), ("Social Metrics", "social", "1011")]
_COLUMNS = ["GRI 305", "IFRS S2", "ESRS E1", "OJK PSPK"]


def oracles() -> dict[str, str]:
    q = {"audit_structure": with_ctes("SELECT * FROM sec_structure", ["sec_structure"]),
         "audit_claims": with_ctes("SELECT section_key, claim_no, raw, value, unit FROM sec_claims", ["sec_claims"]),
         "audit_numeric": with_ctes("SELECT * FROM sec_numeric", ["sec_numeric"]),
         "audit_unmatched": with_ctes("SELECT * FROM sec_numeric WHERE rule = 'VAL-NUM-01'", ["sec_numeric"]),
         "audit_prohibited": with_ctes("SELECT * FROM sec_prohibited", ["sec_prohibited"]),
         "audit_outcome": with_ctes("SELECT section_key, section_id, section_type, retry_count, outcome, status, errors, warnings, unmatched_claims "
                                    "FROM sec_outcome", ["sec_outcome"]),
         "audit_included": with_ctes("SELECT status, COUNT(*) AS sections, status IN ('INCLUDED', 'INCLUDED_WITH_WARNINGS') AS included "
                                     "FROM sec_outcome GROUP BY status", ["sec_outcome"]),
         "audit_footnotes": with_ctes("SELECT * FROM sec_numbered", ["sec_numbered"]),
         "audit_footnote_places": with_ctes("""
SELECT n.metrics_key, n.section_key, string_agg(CAST(f.footnote_no AS VARCHAR), ',' ORDER BY n.pos, f.footnote_no) AS footnote_nos
FROM sec_notes n JOIN sec_numbered f ON f.metrics_key = n.metrics_key AND f.footnote = n.footnote GROUP BY 1, 2""", ["sec_notes", "sec_numbered"])}
    q["audit_unmatched_first10"] = with_ctes("""
SELECT * FROM sec_numeric WHERE rule = 'VAL-NUM-01'
QUALIFY row_number() OVER (PARTITION BY section_key ORDER BY detail) <= 10""", ["sec_numeric"])
    near = "EXISTS (SELECT 1 FROM sec_allowed a WHERE a.metrics_key = c.metrics_key AND abs(a.a - c.value) <= 1e-3)"
    for name, what in (("tolerance_semi", near), ("tolerance_anti", f"NOT {near}")):
        q[name] = with_ctes(f"SELECT section_key, claim_no, raw, value, unit FROM sec_claims c WHERE value IS NOT NULL AND {what}", ["sec_claims", "sec_allowed"])
    q["section_placeholders"] = with_ctes(r"""
SELECT section_key, CAST(len(h) AS INTEGER) AS hits, h[1] AS sample
FROM (SELECT section_key, regexp_extract_all(all_text, '\{[a-z_]+\}') AS h FROM sec_parsed) x WHERE len(h) > 0""", ["sec_parsed"])
    order = ", ".join(f"('{f}', '{t}', {i})" for f, ts in _ORDER.items() for i, t in enumerate(ts))
    framework = "CASE " + " ".join(f"WHEN starts_with(section_id, '{f}_') THEN '{f}'" for f in _ORDER if f != "MULTI_FRAMEWORK") + " ELSE 'MULTI_FRAMEWORK' END"
    q["section_order"] = with_ctes(f"""
SELECT t.metrics_key, t.framework, t.section_key, t.section_id, t.section_type, COALESCE(o.position, 999) AS position
FROM (SELECT *, {framework} AS framework FROM sec_parsed) t
LEFT JOIN (VALUES {order}) o(framework, section_type, position) ON o.framework = t.framework AND o.section_type = t.section_type""", ["sec_parsed"])
    q["section_summary_context"] = with_ctes("""
SELECT metrics_key, COUNT(*) AS total_sections,
       COUNT(*) FILTER (WHERE len(list_filter(texts, lambda t: contains(t, 'KEY INSIGHT'))) > 0) AS sections_with_insights
FROM sec_parsed GROUP BY 1""", ["sec_parsed"])
    held = " + ".join(f"CASE WHEN contains(block, '{f}') THEN 1 ELSE 0 END" for f in _FIELDS)
    q["audit_provenance"] = with_ctes(f"""
SELECT section_key, block IS NOT NULL AS has_provenance, CASE WHEN block IS NULL THEN 0 ELSE {held} END AS fields_present,
       CASE WHEN block IS NULL THEN 'VAL-PROV-01' WHEN {held} < 6 THEN 'VAL-PROV-02' END AS warning
FROM (SELECT section_key, list_filter(coalesce(j->>'$.footnotes[*]', CAST([] AS VARCHAR[])), lambda n: contains(n, 'DATA PROVENANCE:'))[1] AS block
      FROM sec_json) x""", ["sec_json"])
    q["section_json_recovery"] = with_ctes("""
SELECT section_key, json IS NOT NULL AS recovered, json->>'$.section_id' AS section_id
FROM (SELECT section_key, CASE WHEN section_key % 4 < 3 AND json_valid(content_json) THEN CAST(content_json AS JSON) END AS json FROM sec_raw) x""",
                                           ["sec_raw"])
    labels = ", ".join(f"('{a}', '{b}')" for a, b in _LABELS)
    q["audit_claim_mapping"] = with_ctes(f"""
SELECT x.section_key, CAST(x.claim_no AS INTEGER) AS claim_no, lower(x.lab) AS label, lm.metric,
       TRY_CAST(replace(x.num, ',', '') AS DOUBLE) AS claimed_value, m.value AS source_value,
       ABS(TRY_CAST(replace(x.num, ',', '') AS DOUBLE) - m.value) <= 1e-3 AS matches
FROM (SELECT section_key, metrics_key, unnest(generate_series(0, len(l) - 1)) AS claim_no, unnest(l) AS lab, unnest(n) AS num
      FROM (SELECT section_key, metrics_key, regexp_extract_all(all_text, '{_LABEL_RE}', 1) AS l,
                   regexp_extract_all(all_text, '{_LABEL_RE}', 2) AS n FROM sec_parsed) a) x
JOIN (VALUES {labels}) lm(label, metric) ON lm.label = lower(x.lab)
LEFT JOIN sec_metrics m ON m.metrics_key = x.metrics_key AND m.metric = lm.metric""", ["sec_parsed", "sec_metrics"])
    kinds = ["scope1", "scope2", "scope3_pcaf", "intensity", "social", "reduction", "summary", "governance", "targets", "double_materiality"]
    pick = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    fragment("rq_routes", f"""
SELECT item_id AS query_id, {pick(kinds)}[item_id % {len(kinds)} + 1] AS section_type,
       CASE WHEN item_id % 3 > 0 THEN {pick(_ORDER)}[item_id % {len(_ORDER)} + 1] END AS framework,
       CAST(item_id % 5 + 1 AS INTEGER) AS cap FROM benchmark""")
    fragment("rq_sections", f"SELECT section_key, section_type, {framework} AS framework FROM sec_parsed", ["sec_parsed"])
    fragment("rq_own", """
SELECT s.section_type, s.framework, s.section_key, r.query_id, r.cap
FROM rq_sections s JOIN rq_routes r ON r.section_type = s.section_type AND r.framework = s.framework""", ["rq_sections", "rq_routes"])
    q["routed_queries"] = with_ctes("""
SELECT * FROM rq_own UNION ALL
SELECT s.section_type, s.framework, s.section_key, r.query_id, r.cap
FROM rq_sections s JOIN rq_routes r ON r.section_type = s.section_type AND r.framework IS NULL
WHERE s.section_key NOT IN (SELECT section_key FROM rq_own)""", ["rq_sections", "rq_routes", "rq_own"])
    refs = [("Scope 1 Emissions", "scope1", ["305-1 (a-g)", "Para 29(a)(i)", "DR E1-6 §44", "Lampiran II.A.1"]),
            ("Scope 2 Emissions", "scope2", ["305-2 (a-e)", "Para 29(a)(ii)", "DR E1-6 §47-48", "Lampiran II.A.2"]),
            ("Scope 3 / Financed", "scope3_pcaf", ["305-3 (a-f)", "Para 29(a)(iv)", "DR E1-6 §51-54", "Lampiran II.A.3"]),
            ("Intensity", "intensity", ["305-4 (a-d)", "Para 29(b)", "DR E1-6 §55-56", "Lampiran II.B"]),
            ("Reduction Targets", "targets", ["305-5 (a-e)", "Para 33-36", "DR E1-4 §34-42", "Lampiran II.C"]),
            ("Governance", "governance", [None, "Para 5-9", "ESRS 2 GOV-1", "Lampiran I"]),
            ("Transition Plan", "transition", [None, "Para 14-15", "DR E1-1 §14-19", "Lampiran III"]),
            ("Social Metrics", "social", ["401/404/405/406", None, "ESRS S1", "Lampiran IV"])]
    flat = ", ".join(f"('{r}', '{t}', '{fw}', '{x}')" for r, t, xs in refs for fw, x in zip(_COLUMNS, xs) if x)
    own = "CASE framework WHEN 'GRI_305' THEN 'GRI 305' WHEN 'IFRS_S2' THEN 'IFRS S2' WHEN 'CSRD_ESRS_E1' THEN 'ESRS E1' WHEN 'OJK_PSPK' THEN 'OJK PSPK' END"
    q["section_disclosures"] = with_ctes(f"""
SELECT s.section_key, d.requirement, d.framework, d.disclosure_id
FROM (SELECT section_key, section_type, {own} AS own FROM rq_sections) s
JOIN (VALUES {flat}) d(requirement, section_type, framework, disclosure_id)
  ON d.section_type = s.section_type AND (s.own IS NULL OR s.own = d.framework)""", ["rq_sections"])
    rows = ", ".join(f"('{r}', '{t}', " + ", ".join("true" if f == "1" else "false" for f in has) + ")" for r, t, has in _DISCLOSED)
    cell = lambda i: (f"CASE WHEN NOT d.f{i} THEN 'n/a' WHEN s.level = 2 THEN 'disclosed' WHEN s.level = 1 THEN 'partial' ELSE 'gap' END "  # noqa: E731
                      f"AS \"{_COLUMNS[i]}\"")
    q["compliance_matrix"] = with_ctes(f"""
SELECT d.requirement, {", ".join(cell(i) for i in range(4))}
FROM (VALUES {rows}) d(requirement, section_type, f0, f1, f2, f3)
LEFT JOIN (SELECT section_type, MAX(CASE WHEN status = 'INCLUDED' THEN 2 WHEN status = 'INCLUDED_WITH_WARNINGS' THEN 1 ELSE 0 END) AS level
           FROM sec_outcome GROUP BY 1) s ON s.section_type = d.section_type""", ["sec_outcome"])
    return q
