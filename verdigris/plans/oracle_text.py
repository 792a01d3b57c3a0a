"""Oracle SQL for text rules, retrieval, report tables and source checks.

Regexes are restated for RE2 where Java needs a lookbehind: the claim
pattern's ``(?<![\\d,.])`` becomes a consumed ``(?:^|[^\\d,.])`` prefix, which
finds the same numbers wherever two claims are not glued together.
The section audit's oracles are in ``oracle_audit``.
"""

from __future__ import annotations

from ..functions import constants as C
from ..operators import reports
from . import oracle_core, oracle_ops  # noqa: F401  (register fragments)
from .sqltext import R, fragment, with_ctes

CLAIM_RE2 = (r"(?:^|[^\d,.])(\d+(?:,\d{3})*(?:\.\d+)?)\s*"
             r"(tCO2e/IDR|per IDR billion|per employee|per FTE|tCO2e|MWh|IDR|GJ|%)")
WS = r"[\t\n\x0B\f\r ]+"
TOKEN = r"[\p{L}\p{N}]+"


def _q(s: str) -> str:
    return s.replace("'", "''")


fragment("bm25_scores", f"""
SELECT query_id, doc_id, SUM(part) AS score FROM (
  SELECT qt.query_id, p.doc_id,
         i.idf * p.tf * 2.2e0 / (p.tf + 1.2e0 * (2.5e-1 + 7.5e-1 * p.dl / (SELECT avgdl FROM bm_stats))) AS part
  FROM bm_qt qt JOIN bm_post p ON p.term = qt.term JOIN bm_idf i ON i.term = qt.term) x
GROUP BY query_id, doc_id""", ["bm_qt", "bm_post", "bm_idf", "bm_stats"])
fragment("bm_toks", f"SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS t FROM documents")
fragment("bm_stats", "SELECT COUNT(*) AS n_docs, AVG(len(t)) AS avgdl FROM bm_toks", ["bm_toks"])
fragment("bm_qt", f"""
SELECT DISTINCT query_id, term FROM (
  SELECT item_id AS query_id, UNNEST(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM benchmark) x""")
fragment("bm_post", """
SELECT doc_id, dl, term, COUNT(*) AS tf FROM (
  SELECT doc_id, len(t) AS dl, UNNEST(t) AS term FROM bm_toks) x
WHERE term IN (SELECT term FROM bm_qt) GROUP BY doc_id, dl, term""", ["bm_toks", "bm_qt"])
fragment("bm_idf", """
SELECT term, ln(1e0 + ((SELECT n_docs FROM bm_stats) - df + 5e-1) / (df + 5e-1)) AS idf
FROM (SELECT term, COUNT(*) AS df FROM bm_post GROUP BY term) d""", ["bm_post", "bm_stats"])
fragment("bm25_top5", f"""
SELECT query_id, doc_id, rank, score FROM (
  SELECT query_id, doc_id, score,
         CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM (SELECT query_id, doc_id, {R('score', 6)} AS score FROM bm25_scores) s) r WHERE rank <= 5""", ["bm25_scores"])

# chunks: from each start, the last paragraph's end that fills half, else the last sentence's, else a window
_PIECES = "regexp_extract_all(text, '[^\\t\\n\\x0B\\f\\r ]+[\\t\\n\\x0B\\f\\r ]*')"
fragment("chunk_toks", f"""
SELECT doc_id, list_transform(p, lambda x: regexp_extract(x, '^[^\\t\\n\\x0B\\f\\r ]+')) AS toks, len(p) AS n,
       list_filter(range(1, len(p) + 1), lambda i: i = len(p) OR regexp_matches(p[i], '\\n[\\t\\x0B\\f\\r ]*\\n')) AS pars,
       list_filter(range(1, len(p) + 1), lambda i: i = len(p) OR regexp_matches(p[i], '\\n[\\t\\x0B\\f\\r ]*\\n')
                   OR regexp_matches(p[i], '[.!?]["'')\\]]*[\\t\\n\\x0B\\f\\r ]*$')) AS ends
FROM (SELECT doc_id, {_PIECES} AS p FROM documents) x WHERE len(p) > 0""")
fragment("chunk_walk", """
SELECT * FROM (
  WITH RECURSIVE walk(doc_id, chunk_no, s, e) AS (
    SELECT doc_id, 0, CAST(0 AS BIGINT),
           coalesce(list_max(list_filter(pars, lambda x: x >= 150 AND x <= 300)), list_max(list_filter(ends, lambda x: x <= 300)), 300)
    FROM chunk_toks
    UNION ALL
    SELECT doc_id, chunk_no + 1, t, coalesce(list_max(list_filter(pars, lambda x: x >= t + 150 AND x <= t + 300)),
                                             list_max(list_filter(ends, lambda x: x > t AND x <= t + 300)), t + 300)
    FROM (SELECT doc_id, chunk_no, pars, ends,
                 CASE WHEN len(list_filter(ends, lambda x: x > s AND x <= s + 300)) = 0 THEN e - 50
                      ELSE coalesce(list_min(list_filter(ends, lambda x: x > s AND x >= e - 50 AND x <= e
                                                                 AND list_min(list_filter(ends, lambda y: y > e)) - x <= 300)), e) END AS t
          FROM walk JOIN chunk_toks USING (doc_id) WHERE e < n) y)
  SELECT * FROM walk) w""", ["chunk_toks"])
fragment("text_chunks", """
SELECT w.doc_id, chunk_no, CAST(s AS INTEGER) AS first_token, CAST(e - s AS INTEGER) AS n_tokens,
       array_to_string(list_slice(toks, s + 1, e), ' ') AS chunk_text
FROM chunk_walk w JOIN chunk_toks t ON t.doc_id = w.doc_id""", ["chunk_walk", "chunk_toks"])
fragment("bc_toks", f"SELECT doc_id, chunk_no, regexp_extract_all(lower(chunk_text), '{TOKEN}') AS t FROM text_chunks", ["text_chunks"])
fragment("bc_stats", "SELECT COUNT(*) AS n_docs, AVG(len(t)) AS avgdl FROM bc_toks", ["bc_toks"])
fragment("bc_post", """
SELECT doc_id, chunk_no, dl, term, COUNT(*) AS tf FROM (SELECT doc_id, chunk_no, len(t) AS dl, UNNEST(t) AS term FROM bc_toks) x
WHERE term IN (SELECT term FROM bm_qt) GROUP BY doc_id, chunk_no, dl, term""", ["bc_toks", "bm_qt"])
fragment("bc_idf", """
SELECT term, ln(1e0 + ((SELECT n_docs FROM bc_stats) - df + 5e-1) / (df + 5e-1)) AS idf
FROM (SELECT term, COUNT(*) AS df FROM bc_post GROUP BY term) d""", ["bc_post", "bc_stats"])
fragment("bm25_chunks_top5", f"""
SELECT r.query_id, r.doc_id, r.chunk_no, rank, score, first_token, n_tokens FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_no) AS INTEGER) AS rank
  FROM (SELECT query_id, doc_id, chunk_no, {R('SUM(part)', 6)} AS score FROM (
          SELECT qt.query_id, p.doc_id, p.chunk_no,
                 i.idf * p.tf * 2.2e0 / (p.tf + 1.2e0 * (2.5e-1 + 7.5e-1 * p.dl / (SELECT avgdl FROM bc_stats))) AS part
          FROM bm_qt qt JOIN bc_post p ON p.term = qt.term JOIN bc_idf i ON i.term = qt.term) x
        GROUP BY query_id, doc_id, chunk_no) s) r
JOIN text_chunks c ON c.doc_id = r.doc_id AND c.chunk_no = r.chunk_no WHERE rank <= 5""", ["bm_qt", "bc_post", "bc_idf", "bc_stats", "text_chunks"])

# ------------------------------------------------------------------ reports
fragment("rp_energy", f"""
SELECT reporting_year, {R('SUM(total_consumption_mwh)', 3)} AS total_energy_mwh,
       {R('CASE WHEN SUM(total_consumption_mwh) > 0 THEN SUM(rec_mwh_applied) / SUM(total_consumption_mwh) * 100 END', 2)} AS renewable_pct
FROM ghg_scope2 GROUP BY reporting_year""", ["ghg_scope2"])
fragment("rp_wide", f"""
SELECT s.reporting_year, s.scope1_tco2e, s.scope2_location_tco2e, s.scope2_market_tco2e, s.scope3_cat15_gross_tco2e,
       s.scope3_cat15_weighted_tco2e, s.intensity_tco2e_per_idr_bn, s.intensity_tco2e_per_fte,
       s.avg_pcaf_data_quality, s.yoy_change_pct,
       {R('s.scope1_tco2e + s.scope2_market_tco2e + s.scope3_cat15_gross_tco2e', 3)} AS total_tco2e,
       e.total_energy_mwh, e.renewable_pct, CAST(h.fte_total AS DOUBLE) AS fte_total, h.fte_female_pct,
       h.fte_management_female_pct, h.training_hours_per_fte, h.voluntary_turnover_pct
FROM ghg_summary_annual s LEFT JOIN rp_energy e ON e.reporting_year = s.reporting_year
LEFT JOIN hr_metrics h ON h.reporting_year = s.reporting_year""", ["ghg_summary_annual", "rp_energy", "hr_metrics"])
fragment("rp_long_base", " UNION ALL ".join(
    f"SELECT reporting_year, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM rp_wide"
    for m in reports.METRIC_COLUMNS), ["rp_wide"])
fragment("rp_long", f"""
SELECT c.reporting_year, c.metric, c.value, p.value AS prior_value,
       {R('CASE WHEN p.value <> 0 THEN (c.value - p.value) / p.value * 100e0 END', 2)} AS change_pct
FROM rp_long_base c LEFT JOIN rp_long_base p ON p.metric = c.metric AND p.reporting_year = c.reporting_year - 1""",
         ["rp_long_base"])


def _indicator(no, indicator, unit, shown, state, target) -> str:
    """One indicator of every year; ``shown`` is a metric, or a fact's SQL text."""
    if shown in reports.METRIC_COLUMNS:
        src = (f"SELECT w.reporting_year, l.value AS v, NULL AS t, l.prior_value AS p, l.change_pct AS c FROM rp_wide w "
               f"LEFT JOIN rp_long l ON l.reporting_year = w.reporting_year AND l.metric = '{shown}'")
    else:
        src = (f"SELECT w.reporting_year, CAST(NULL AS DOUBLE) AS v, {shown} AS t, CAST(NULL AS DOUBLE) AS p, CAST(NULL AS DOUBLE) AS c "
               f"FROM rp_wide w LEFT JOIN governance g ON g.reporting_year = w.reporting_year")
    ch = lambda m: f"(SELECT change_pct FROM rp_long x WHERE x.metric = '{m}' AND x.reporting_year = s.reporting_year)"
    val = lambda m: f"(SELECT value FROM rp_long x WHERE x.metric = '{m}' AND x.reporting_year = s.reporting_year)"
    return (f"SELECT s.reporting_year, {no} AS no, '{indicator}' AS indicator, '{unit}' AS unit, v AS current_value, CAST(t AS VARCHAR) AS current_text, "
            f"p AS prior_value, c AS change_pct, '{target}' AS target, {state(ch, val)} AS achievement FROM ({src}) s")


def _indicators() -> str:
    def good(cond, word="achieved"):
        return lambda ch, val: f"CASE WHEN {cond(ch, val)} THEN '{word}' ELSE 'not achieved' END"
    drop = lambda m, by="0": good(lambda ch, val: f"{ch(m)} < {by}")
    least = lambda m, x: good(lambda ch, val: f"{val(m)} >= {x}")
    yes = lambda c: f"CASE WHEN g.{c} THEN 'yes' WHEN NOT g.{c} THEN 'no' END"
    held = lambda word: good(lambda ch, val: f"t = '{word}'")
    rows = [
        (1, "Total GHG emissions (scope 1+2+3)", "tCO2e", "total_tco2e", drop("total_tco2e"), "Annual reduction"),
        (2, "Direct GHG emissions (scope 1)", "tCO2e", "scope1_tco2e", drop("scope1_tco2e"), "Reduce diesel dependency"),
        (3, "Energy indirect emissions (scope 2)", "tCO2e", "scope2_location_tco2e", good(lambda ch, val: f"{val('renewable_pct')} > 0", "in progress"),
         "Procure renewable energy"),
        (4, "Financed emissions (scope 3 cat. 15)", "tCO2e", "scope3_cat15_gross_tco2e", good(lambda ch, val: f"{val('avg_pcaf_data_quality')} < 3"),
         "Improve PCAF score <3.0"),
        (5, "Emission intensity", "tCO2e/IDR bn", "intensity_tco2e_per_idr_bn", drop("intensity_tco2e_per_idr_bn"), "Annual intensity reduction"),
        (6, "Energy consumption", "MWh", "total_energy_mwh", drop("total_energy_mwh", "-5"), "Reduce 5% annually"),
        (7, "Renewable energy share", "%", "renewable_pct", least("renewable_pct", 10), ">=10%"),
        (8, "Total employees", "FTE", "fte_total", lambda ch, val: "'n/a'", "N/A"),
        (9, "Female workforce share", "%", "fte_female_pct", least("fte_female_pct", 40), ">=40%"),
        (10, "Women in management", "%", "fte_management_female_pct", least("fte_management_female_pct", 30), ">=30%"),
        (11, "Average training hours", "hours/FTE", "training_hours_per_fte", least("training_hours_per_fte", 40), ">=40 hours"),
        (12, "Voluntary turnover rate", "%", "voluntary_turnover_pct", good(lambda ch, val: f"{val('voluntary_turnover_pct')} < 10"), "<10%"),
        (13, "ESG board committee", "yes/no", yes("has_esg_committee"), held("yes"), "Established"),
        (14, "Climate policy", "yes/no", yes("has_climate_policy"), held("yes"), "Approved"),
        (15, "SBTi commitment", "status", "g.sbti_status", held("Committed"), "Committed"),
    ]
    return "\nUNION ALL\n".join(_indicator(*r) for r in rows)


def _cmp(x: str) -> str:
    return (f"CASE r.op WHEN '<' THEN {x} < r.threshold WHEN '<=' THEN {x} <= r.threshold "
            f"WHEN '>' THEN {x} > r.threshold WHEN '>=' THEN {x} >= r.threshold END")


_SIGNED = "CASE WHEN p.higher_is_better THEN {0} ELSE -{0} END"
fragment("rp_peer_gap", f"""
SELECT reporting_year, metric, value AS own_value,
       CASE WHEN own_s > bs THEN value ELSE bpv END AS best_value,
       CASE WHEN own_s > bs THEN 'own' ELSE bpeer END AS best_bank,
       {R('value - CASE WHEN own_s > bs THEN value ELSE bpv END', 4)} AS gap_to_best,
       CAST(better + 1 AS INTEGER) AS rank, peers + 1 AS banks
FROM (SELECT l.reporting_year, l.metric, l.value, {_SIGNED.format('l.value')} AS own_s,
             COUNT(*) FILTER (WHERE {_SIGNED.format('p.pvalue')} > {_SIGNED.format('l.value')}) AS better,
             MAX({_SIGNED.format('p.pvalue')}) AS bs,
             arg_max(p.peer, struct_pack(s := {_SIGNED.format('p.pvalue')}, peer := p.peer)) AS bpeer,
             arg_max(p.pvalue, struct_pack(s := {_SIGNED.format('p.pvalue')}, peer := p.peer)) AS bpv, COUNT(*) AS peers
      FROM rp_long l JOIN peers p ON p.metric = l.metric GROUP BY l.reporting_year, l.metric, l.value, p.higher_is_better) x""", ["rp_long", "peers"])


def oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    q["doc_numeric_claims"] = f"""
SELECT doc_id, CAST(claim_no AS INTEGER) AS claim_no, raw, TRY_CAST(replace(raw, ',', '') AS DOUBLE) AS value, unit
FROM (SELECT doc_id, UNNEST(generate_series(0, len(v) - 1)) AS claim_no, UNNEST(v) AS raw, UNNEST(u) AS unit
      FROM (SELECT doc_id, regexp_extract_all(text, '{CLAIM_RE2}', 1) AS v,
                   regexp_extract_all(text, '{CLAIM_RE2}', 2) AS u FROM documents) a) b"""
    q["doc_chunks"] = with_ctes("SELECT doc_id, chunk_no, first_token, n_tokens, chunk_text FROM text_chunks", ["text_chunks"])
    q["bm25_chunks_top5"] = with_ctes("SELECT * FROM bm25_chunks_top5", ["bm25_chunks_top5"])
    q["doc_windows"] = f"""
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(len(body) AS INTEGER) AS n_tokens,
       array_to_string(body, ' ') AS chunk_text
FROM (SELECT doc_id, chunk_no, list_slice(toks, s + 1, s + 300) AS body
      FROM (SELECT doc_id, toks, UNNEST(generate_series(0, len(st) - 1)) AS chunk_no, UNNEST(st) AS s
            FROM (SELECT doc_id, toks, generate_series(0, greatest(len(toks) - 51, 0), 250) AS st
                  FROM (SELECT doc_id, list_filter(string_split_regex(text, '{WS}'), lambda x: x <> '') AS toks
                        FROM documents) a) b) c) d"""
    q["bm25_top5"] = with_ctes("SELECT query_id, doc_id, rank, score FROM bm25_top5",
                               ["bm25_top5"])
    q["vector_top5"] = f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
c AS (SELECT label, list(x ORDER BY dim) AS qv FROM (
        SELECT label, dim, AVG(x) AS x FROM (
          SELECT label, UNNEST(generate_series(0, len(v) - 1)) AS dim, UNNEST(v) AS x FROM e) a
        GROUP BY label, dim) b GROUP BY label),
s AS (SELECT c.label AS query_id, e.vec_id,
             list_dot_product(c.qv, e.v) / (sqrt(list_dot_product(c.qv, c.qv)) * sqrt(list_dot_product(e.v, e.v))) AS score
      FROM c JOIN e ON e.label = c.label)
SELECT query_id, vec_id, rank, score FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM (SELECT query_id, vec_id, {R('score', 6)} AS score FROM s) s2) r
WHERE rank <= 5"""
    q["vector_ids_top5"] = f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT c.vec_id AS query_id, e.vec_id,
             list_dot_product(c.v, e.v) / (sqrt(list_dot_product(c.v, c.v)) * sqrt(list_dot_product(e.v, e.v))) AS score
      FROM e c JOIN e ON e.label = c.label WHERE c.vec_id % 50 = 0)
SELECT query_id, vec_id, rank, score FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM (SELECT query_id, vec_id, {R('score', 6)} AS score FROM s) s2) r
WHERE rank <= 5"""
    q["context_pack"] = with_ctes("""
SELECT query_id, doc_id, rank, CAST(length(used) AS INTEGER) AS chars_used, length(used) < len AS truncated,
       CASE WHEN length(used) < len THEN used || '...' ELSE used END AS context
FROM (SELECT *, CASE WHEN cum <= 2000 THEN passage
                     WHEN prev < 2000 AND 2000 - prev > 100 THEN substring(passage, 1, CAST(2000 - prev AS INTEGER)) END AS used,
             MIN(CASE WHEN cum > 2000 THEN rank END) OVER (PARTITION BY query_id) AS first_over
      FROM (SELECT *, cum - len AS prev FROM (
              SELECT h.query_id, h.doc_id, h.rank, d.text AS passage, length(d.text) AS len,
                     SUM(length(d.text)) OVER (PARTITION BY h.query_id ORDER BY h.rank ROWS UNBOUNDED PRECEDING) AS cum
              FROM bm25_top5 h JOIN documents d ON d.doc_id = h.doc_id WHERE length(d.text) > 0) a) b) c
WHERE used IS NOT NULL AND (first_over IS NULL OR rank <= first_over)""", ["bm25_top5"])
    q["chunk_context"] = with_ctes("""
SELECT query_id, doc_id, chunk_no, first_token, n_tokens, rank, CAST(length(used) AS INTEGER) AS chars_used, length(used) < len AS truncated,
       CASE WHEN length(used) < len THEN used || '...' ELSE used END AS context
FROM (SELECT *, CASE WHEN cum <= 2000 THEN passage
                     WHEN prev < 2000 AND 2000 - prev > 100 THEN substring(passage, 1, CAST(2000 - prev AS INTEGER)) END AS used,
             MIN(CASE WHEN cum > 2000 THEN rank END) OVER (PARTITION BY query_id) AS first_over
      FROM (SELECT *, cum - len AS prev FROM (
              SELECT h.*, c.chunk_text AS passage, length(c.chunk_text) AS len,
                     SUM(length(c.chunk_text)) OVER (PARTITION BY h.query_id ORDER BY h.rank ROWS UNBOUNDED PRECEDING) AS cum
              FROM bm25_chunks_top5 h JOIN text_chunks c ON c.doc_id = h.doc_id AND c.chunk_no = h.chunk_no) a) b) c
WHERE used IS NOT NULL AND (first_over IS NULL OR rank <= first_over)""", ["bm25_chunks_top5", "text_chunks"])
    q["chunk_context_text"] = (f"SELECT query_id, string_agg(context, chr(10) || chr(10) || '---' || chr(10) || chr(10) "
                               f"ORDER BY rank) AS context, SUM(chars_used) AS chars_used FROM ({q['chunk_context']}) p "
                               f"GROUP BY query_id")
    q["context_text"] = (f"SELECT query_id, string_agg(context, chr(10) || chr(10) || '---' || chr(10) || chr(10) "
                         f"ORDER BY rank) AS context, SUM(chars_used) AS chars_used FROM ({q['context_pack']}) p "
                         f"GROUP BY query_id")
    # ------------------------------------------------------------ reports
    q["indicator_table"] = with_ctes(_indicators(), ["rp_wide", "rp_long", "governance"])
    q["scorecard"] = with_ctes("""
SELECT reporting_year, 'Environmental' AS dimension,
       CASE WHEN yoy_change_pct IS NULL THEN 'n/a' WHEN yoy_change_pct < -3 THEN 'green'
            WHEN yoy_change_pct > 3 THEN 'red' ELSE 'amber' END AS rating,
       'total YoY ' || COALESCE(CAST(yoy_change_pct AS VARCHAR), 'n/a') || '%' AS driver FROM rp_wide
UNION ALL
SELECT reporting_year, 'Social',
       CASE WHEN COALESCE(fte_female_pct >= 40, false) AND COALESCE(training_hours_per_fte >= 30, false) THEN 'green'
            WHEN COALESCE(fte_female_pct >= 40, false) OR COALESCE(training_hours_per_fte >= 30, false) THEN 'amber'
            ELSE 'red' END,
       'female ' || CAST(fte_female_pct AS VARCHAR) || '%, training ' || CAST(training_hours_per_fte AS VARCHAR) || ' h'
FROM rp_wide
UNION ALL
SELECT w.reporting_year, 'Governance',
       CASE WHEN g.sbti_status IS NULL THEN 'n/a' WHEN h = 3 THEN 'green' WHEN h > 0 THEN 'amber' ELSE 'red' END, CAST(h AS VARCHAR) || ' of 3 in place'
FROM (SELECT w.*, COALESCE(CAST(g.has_esg_committee AS INTEGER), 0) + COALESCE(CAST(g.has_climate_policy AS INTEGER), 0)
             + CASE WHEN g.sbti_status = 'Committed' THEN 1 ELSE 0 END AS h
      FROM rp_wide w LEFT JOIN governance g ON g.reporting_year = w.reporting_year) w
LEFT JOIN governance g ON g.reporting_year = w.reporting_year""", ["rp_wide", "governance"])
    q["disclosure_flags"] = with_ctes("""
SELECT reporting_year, disclosure FROM (
  SELECT s.reporting_year, CASE WHEN q1.max_score >= 3 THEN 'imputation_footnote' END AS f1,
         CASE WHEN q2.max_rec_pct > 0 THEN 'market_based_method_paragraph' END AS f2,
         CASE WHEN s.yoy_change_pct IS NULL THEN 'omit_yoy_paragraph' END AS f3,
         CASE WHEN s.assurance_level = 'none' THEN 'no_assurance_footnote' END AS f4,
         CASE WHEN s.avg_pcaf_data_quality > 3.5 THEN 'pcaf_quality_roadmap' END AS f5
  FROM ghg_summary_annual s
  LEFT JOIN (SELECT reporting_year, MAX(data_quality_score) AS max_score FROM ghg_scope1 GROUP BY 1) q1
         ON q1.reporting_year = s.reporting_year
  LEFT JOIN (SELECT reporting_year, MAX(rec_applied_pct) AS max_rec_pct FROM ghg_scope2 GROUP BY 1) q2
         ON q2.reporting_year = s.reporting_year) x
UNPIVOT (disclosure FOR k IN (f1, f2, f3, f4, f5))""", ["ghg_summary_annual", "ghg_scope1", "ghg_scope2"])
    seen = "CASE r.basis WHEN 'change' THEN l.change_pct WHEN 'gap' THEN g.gap_to_best ELSE l.value END"
    q["playbook_actions"] = with_ctes(f"""
SELECT l.reporting_year, r.rule_id, l.metric, r.basis, {seen} AS observed, r.action
FROM rp_long l JOIN playbook r ON r.metric = l.metric
LEFT JOIN rp_peer_gap g ON g.reporting_year = l.reporting_year AND g.metric = l.metric
WHERE COALESCE({_cmp(seen)}, false)""", ["rp_long", "playbook", "rp_peer_gap"])
    q["pcaf_improvement"] = with_ctes(f"""
SELECT reporting_year, reporting_year + step AS target_year, step, target_score, confidence_gap_pct,
       {R("(1e0 - CASE WHEN target_score <= 2 THEN CASE WHEN target_score <= 1.5e0 THEN 1e0 + (target_score - 1) * (-1e-1) ELSE 9.5e-1 + (target_score - 1.5e0) * (-1e-1) END WHEN target_score <= 3 THEN 9e-1 + (target_score - 2) * (-1.5e-1) WHEN target_score <= 4 THEN 7.5e-1 + (target_score - 3) * (-1.5e-1) WHEN target_score <= 5 THEN 6e-1 + (target_score - 4) * (-1.5e-1) ELSE 4.5e-1 END) * 100", 2)} AS projected_gap_pct FROM (
  SELECT reporting_year, {R('CASE WHEN scope3_cat15_gross_tco2e > 0 THEN (scope3_cat15_gross_tco2e - scope3_cat15_weighted_tco2e) / scope3_cat15_gross_tco2e * 100 END', 2)} AS confidence_gap_pct,
         0 AS step, avg_pcaf_data_quality AS target_score FROM rp_wide
  UNION ALL SELECT reporting_year, {R('CASE WHEN scope3_cat15_gross_tco2e > 0 THEN (scope3_cat15_gross_tco2e - scope3_cat15_weighted_tco2e) / scope3_cat15_gross_tco2e * 100 END', 2)},
         1, {R('avg_pcaf_data_quality + -1.5e-1', 2)} FROM rp_wide
  UNION ALL SELECT reporting_year, {R('CASE WHEN scope3_cat15_gross_tco2e > 0 THEN (scope3_cat15_gross_tco2e - scope3_cat15_weighted_tco2e) / scope3_cat15_gross_tco2e * 100 END', 2)},
         2, {R('avg_pcaf_data_quality + -3.5e-1', 2)} FROM rp_wide
  UNION ALL SELECT reporting_year, {R('CASE WHEN scope3_cat15_gross_tco2e > 0 THEN (scope3_cat15_gross_tco2e - scope3_cat15_weighted_tco2e) / scope3_cat15_gross_tco2e * 100 END', 2)},
         3, LEAST(3e0, avg_pcaf_data_quality) FROM rp_wide) x""", ["rp_wide"])
    q["target_pathway"] = with_ctes(f"""
SELECT reporting_year,
       {R(f'CASE WHEN {reports.TARGET_YEAR} - reporting_year > 0 THEN (1e0 - pow(7e-1, 1e0 / ({reports.TARGET_YEAR} - reporting_year))) * 100 END', 4)} AS required_annual_reduction_pct,
       {R('-yoy_change_pct', 2)} AS actual_annual_reduction_pct,
       {R(f'CASE WHEN -yoy_change_pct > 0 THEN (CASE WHEN {reports.TARGET_YEAR} - reporting_year > 0 THEN (1e0 - pow(7e-1, 1e0 / ({reports.TARGET_YEAR} - reporting_year))) * 100 END) / -yoy_change_pct END', 2)} AS acceleration_factor
FROM rp_wide""", ["rp_wide"])
    q["kpi_cards"] = with_ctes("""
SELECT reporting_year, metric, value, change_pct,
       CASE WHEN change_pct IS NULL THEN 'n/a' WHEN change_pct > 0 THEN 'up' WHEN change_pct < 0 THEN 'down'
            ELSE 'stable' END AS trend
FROM rp_long WHERE metric IN ('total_tco2e', 'scope1_tco2e', 'scope2_location_tco2e', 'avg_pcaf_data_quality')""",
                               ["rp_long"])
    q["portfolio_composition"] = with_ctes(f"""
SELECT reporting_year, loan_type, loans, excluded_loans,
       {R('CAST(o AS DOUBLE) / 1e12', 6)} AS outstanding_idr_trillion,
       {R('CAST(o AS DOUBLE) / CAST(SUM(o) OVER (PARTITION BY reporting_year) AS DOUBLE) * 100', 2)} AS pct_of_portfolio,
       {R('CAST(inc AS DOUBLE) / CAST(o AS DOUBLE) * 100', 2)} AS pct_included, excluded_loans = 0 AS fully_included, exclusion_reasons
FROM (SELECT reporting_year, loan_type, COUNT(*) AS loans,
             SUM(CAST(outstanding_idr AS DECIMAL(38,0))) AS o,
             SUM(CASE WHEN reject_reason IS NULL THEN CAST(outstanding_idr AS DECIMAL(38,0)) ELSE 0 END) AS inc,
             COUNT(*) FILTER (WHERE reject_reason IS NOT NULL) AS excluded_loans,
             COALESCE(string_agg(DISTINCT reject_reason, ',' ORDER BY reject_reason), '') AS exclusion_reasons
      FROM s3_checked GROUP BY 1, 2) g""", ["s3_checked"])
    reasons = ("ev_null", "ev_nonpositive", "emissions_null", "emissions_nonpositive")
    held = ", ".join(f"COUNT(*) FILTER (WHERE reject_reason = '{x}') AS excluded_{x}" for x in reasons)
    q["portfolio_by_asset_class"] = with_ctes(f"""
SELECT reporting_year, asset_class, loan_type, level, loans, {R('CAST(o AS DOUBLE) / 1e12', 6)} AS outstanding_idr_trillion,
       {R('CAST(o AS DOUBLE) / CAST(MAX(CASE WHEN level = 3 THEN o END) OVER (PARTITION BY reporting_year) AS DOUBLE) * 100', 2)} AS pct_of_portfolio,
       {R('CAST(inc AS DOUBLE) / CAST(o AS DOUBLE) * 100', 2)} AS pct_included, {", ".join(f"excluded_{x}" for x in reasons)}
FROM (SELECT reporting_year, asset_class, loan_type, CAST(GROUPING(reporting_year, asset_class, loan_type) AS INTEGER) AS level, COUNT(*) AS loans,
             SUM(CAST(outstanding_idr AS DECIMAL(38,0))) AS o,
             SUM(CASE WHEN reject_reason IS NULL THEN CAST(outstanding_idr AS DECIMAL(38,0)) ELSE 0 END) AS inc, {held}
      FROM (SELECT *, CASE loan_type WHEN 'project_finance' THEN 'Project Finance' WHEN 'mortgage' THEN 'Retail Mortgages'
                                     WHEN 'term_loan' THEN 'Business Loans' WHEN 'revolving_credit' THEN 'Business Loans'
                                     WHEN 'syndicated_loan' THEN 'Business Loans' WHEN 'leasing' THEN 'Business Loans' ELSE 'Other' END AS asset_class
            FROM s3_checked) c
      GROUP BY GROUPING SETS ((reporting_year, asset_class, loan_type), (reporting_year, asset_class), (reporting_year))) g""", ["s3_checked"])
    q["what_if_gap"] = with_ctes(f"""
SELECT reporting_year, {R('(1e0 - SUM(g * confidence_factor) / SUM(g)) * 100', 4)} AS confidence_gap_pct,
       {R('(1e0 - SUM(g * CASE WHEN top AND pcaf_data_quality_score = 4e0 THEN 7.5e-1 ELSE confidence_factor END) / SUM(g)) * 100', 4)} AS projected_gap_pct
FROM (SELECT l.*, financed_emissions_loan_tco2e AS g, t.borrower_id IS NOT NULL AS top FROM s3_loan l
      LEFT JOIN (SELECT reporting_year, borrower_id FROM loan_portfolio WHERE record_status = 'validated' GROUP BY 1, 2
                 QUALIFY ROW_NUMBER() OVER (PARTITION BY reporting_year ORDER BY SUM(CAST(outstanding_idr AS DOUBLE)) DESC, borrower_id) <= 50) t
        ON t.reporting_year = l.reporting_year AND t.borrower_id = l.borrower_id) x GROUP BY 1""", ["s3_loan", "loan_portfolio"])
    fragment("doc_filtered", """
SELECT doc_id, lang AS language, source AS category, ['GRI_305', 'IFRS_S2', 'CSRD_ESRS_E1', 'OJK_PSPK'][CAST(doc_id % 4 AS INTEGER) + 1] AS framework
FROM documents WHERE doc_id % 4 IN (0, 1) AND lang IN ('en', 'de') AND NOT coalesce(regexp_matches(text, '[0-9]'), false)""")
    q["filtered_documents"] = with_ctes("SELECT * FROM doc_filtered", ["doc_filtered"])
    q["bm25_filtered_chunks_top5"] = with_ctes(f"""
SELECT query_id, doc_id, chunk_no, rank, score FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_no) AS INTEGER) AS rank
  FROM (SELECT query_id, doc_id, chunk_no, {R('SUM(part)', 6)} AS score FROM (
          SELECT qt.query_id, p.doc_id, p.chunk_no,
                 i.idf * p.tf * 2.2e0 / (p.tf + 1.2e0 * (2.5e-1 + 7.5e-1 * p.dl / (SELECT avgdl FROM bc_stats))) AS part
          FROM bm_qt qt JOIN bc_post p ON p.term = qt.term JOIN bc_idf i ON i.term = qt.term
          WHERE p.doc_id IN (SELECT doc_id FROM doc_filtered)) x
        GROUP BY query_id, doc_id, chunk_no) s) r WHERE rank <= 5""", ["bm_qt", "bc_post", "bc_idf", "bc_stats", "doc_filtered"])
    q["score_what_if"] = with_ctes(f"""
SELECT reporting_year,
       {R('SUM(o * pcaf_data_quality_score) / SUM(o)', 4)} AS weighted_score,
       {R('SUM(o * CASE WHEN top AND pcaf_data_quality_score = 4e0 THEN 3e0 ELSE pcaf_data_quality_score END) / SUM(o)', 4)} AS weighted_score_after,
       {R('SUM(CASE WHEN top THEN o ELSE 0e0 END) / SUM(o) * 100', 2)} AS top_share_pct,
       COUNT(*) FILTER (WHERE top AND pcaf_data_quality_score = 4e0) AS loans_moved
FROM (SELECT l.reporting_year, CAST(l.outstanding_idr AS DOUBLE) AS o, l.pcaf_data_quality_score,
             t.borrower_id IS NOT NULL AS top
      FROM loan_portfolio l
      LEFT JOIN (SELECT reporting_year, borrower_id FROM (
                   SELECT reporting_year, borrower_id,
                          ROW_NUMBER() OVER (PARTITION BY reporting_year ORDER BY b_out DESC, borrower_id) AS r
                   FROM (SELECT reporting_year, borrower_id, SUM(CAST(outstanding_idr AS DOUBLE)) AS b_out
                         FROM loan_portfolio WHERE record_status = 'validated' GROUP BY 1, 2) b) x WHERE r <= 50) t
             ON t.reporting_year = l.reporting_year AND t.borrower_id = l.borrower_id
      WHERE l.record_status = 'validated') y
GROUP BY reporting_year""", ["loan_portfolio"])
    q["score_concentration"] = with_ctes(f"""
SELECT reporting_year, pcaf_data_quality_score,
       {R('CAST(o AS DOUBLE) / CAST(SUM(o) OVER (PARTITION BY reporting_year) AS DOUBLE) * 100', 2)} AS pct_of_outstanding,
       ROW_NUMBER() OVER (PARTITION BY reporting_year ORDER BY o DESC, pcaf_data_quality_score) = 1 AS highest
FROM (SELECT reporting_year, pcaf_data_quality_score, SUM(CAST(outstanding_idr AS DECIMAL(38,0))) AS o
      FROM loan_portfolio WHERE record_status = 'validated' GROUP BY 1, 2) g""", ["loan_portfolio"])
    q["imputation_note"] = with_ctes("""
SELECT reporting_year, CAST(SUM(imputed_months) AS BIGINT) AS imputed_months,
       COUNT(DISTINCT facility_id) AS facilities, MAX(data_quality_score) AS worst_score
FROM ghg_scope1 WHERE data_quality_score >= 3 GROUP BY reporting_year""", ["ghg_scope1"])
    q["peer_gap"] = with_ctes("SELECT * FROM rp_peer_gap", ["rp_peer_gap"])
    for name, least in (("rwf", "4e-1"), ("rwf_peer", "3e-1")):
        fragment(name, f"""
WITH sm AS (SELECT s.query_id, s.doc_id, {R('s.score / MAX(s.score) OVER (PARTITION BY s.query_id)', 6)} AS score, d.lang
            FROM bm25_scores s JOIN documents d ON d.doc_id = s.doc_id),
filt AS (SELECT query_id, doc_id, score, rank FROM (
           SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
           FROM sm WHERE lang = 'en') a WHERE rank <= 5),
usable AS (SELECT DISTINCT query_id FROM filt WHERE score >= {least}),
unf AS (SELECT query_id, doc_id, score, rank FROM (
          SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
          FROM sm) b WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM usable))
SELECT query_id, doc_id, rank, score, false AS fallback FROM filt WHERE query_id IN (SELECT query_id FROM usable)
       AND score >= {least}
UNION ALL
SELECT query_id, doc_id, rank, score, true AS fallback FROM unf WHERE score >= {least}""", ["bm25_scores"])
    q["peer_retrieval"] = with_ctes("SELECT * FROM rwf_peer", ["rwf_peer"])
    q["bm25_two_languages"] = with_ctes(f"""
SELECT query_id, doc_id, rank, score FROM (
  SELECT query_id, doc_id, score, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM (SELECT s.query_id, s.doc_id, {R('s.score', 6)} AS score FROM bm25_scores s JOIN documents d ON d.doc_id = s.doc_id
        WHERE d.lang = 'en' OR d.lang = 'de') x) r WHERE rank <= 5""", ["bm25_scores"])
    q["hybrid_top5"] = with_ctes(f"""
SELECT query_id, doc_id, rank, score FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM (SELECT query_id, doc_id, {R('SUM(1e0 / (60 + rank))', 8)} AS score FROM (
          SELECT query_id, doc_id, rank FROM bm25_top5
          UNION ALL
          SELECT query_id, vec_id, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
          FROM (SELECT b.query_id, e.vec_id, {R("list_dot_product(b.v, CAST(e.embedding AS DOUBLE[])) / (sqrt(list_dot_product(b.v, b.v)) * sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))))", 6)} AS score
                FROM (SELECT query_id, arg_min(label, rank) AS label, arg_min(CAST(embedding AS DOUBLE[]), rank) AS v
                      FROM bm25_top5 h JOIN embeddings x ON x.vec_id = h.doc_id GROUP BY query_id) b
                JOIN embeddings e ON e.label = b.label) s
          QUALIFY rank <= 5) u GROUP BY query_id, doc_id) f) r WHERE rank <= 5""", ["bm25_top5"])
    q["retrieval_with_fallback"] = with_ctes("SELECT * FROM rwf", ["rwf"])
    q["retrieval_stats"] = with_ctes("""
SELECT h.query_id, h.hits, h.above_threshold, h.used_fallback, CAST(COALESCE(p.used, 0) AS BIGINT) AS used,
       CAST(COALESCE(p.chars, 0) AS BIGINT) AS chars
FROM (SELECT query_id, COUNT(*) AS hits, COUNT(*) FILTER (WHERE score >= 4e-1) AS above_threshold, bool_or(fallback) AS used_fallback
      FROM rwf GROUP BY query_id) h
LEFT JOIN (
  SELECT query_id, COUNT(*) AS used, SUM(length(used)) AS chars
  FROM (SELECT *, CASE WHEN cum <= 2000 THEN passage
                       WHEN prev < 2000 AND 2000 - prev > 100 THEN substring(passage, 1, CAST(2000 - prev AS INTEGER)) END AS used,
               MIN(CASE WHEN cum > 2000 THEN rank END) OVER (PARTITION BY query_id) AS first_over
        FROM (SELECT *, cum - len AS prev FROM (
                SELECT h.query_id, h.doc_id, h.rank, d.text AS passage, length(d.text) AS len,
                       SUM(length(d.text)) OVER (PARTITION BY h.query_id ORDER BY h.rank ROWS UNBOUNDED PRECEDING) AS cum
                FROM rwf h JOIN documents d ON d.doc_id = h.doc_id WHERE length(d.text) > 0) a) b) c
  WHERE used IS NOT NULL AND (first_over IS NULL OR rank <= first_over)
  GROUP BY query_id) p ON p.query_id = h.query_id""", ["rwf"])
    # ------------------------------------------------------------ sources
    q["partition_presence"] = with_ctes(f"""
SELECT t.table_name, CAST(y.reporting_year AS INTEGER) AS reporting_year, COALESCE(p.present, false) AS present
FROM (VALUES ('energy_consumption'), ('loan_portfolio'), ('hr_metrics')) t(table_name)
JOIN range({C.BASE_YEAR - 1}, {C.CURRENT_YEAR + 2}) y(reporting_year) ON true
LEFT JOIN (SELECT DISTINCT 'energy_consumption' AS table_name, reporting_year, true AS present FROM energy_consumption
           UNION SELECT DISTINCT 'loan_portfolio', reporting_year, true FROM loan_portfolio
           UNION SELECT DISTINCT 'hr_metrics', reporting_year, true FROM hr_metrics) p
  ON p.table_name = t.table_name AND p.reporting_year = y.reporting_year""",
                                        ["energy_consumption", "loan_portfolio", "hr_metrics"])
    return q
