"""Report sections to audit: one per document, written from the computed summary.

A section belongs to a bank-year, a framework and a section type, all given by
its document's id. Its text is the whole document followed by sentences that
state figures of ``ghg_summary_annual``; its table, key metrics, footnotes and
references follow from the same figures. Thirteen variants by document id
plant the faults that the audit looks for: a figure off by a tenth, a changed
percentage, a wrong intensity, a table figure the text doesn't have, banned
wording, missing keys, a ragged table, broken JSON, and drafts whose own
metrics contradict each other, placeholders that nothing has replaced; variant 0 has none.

The generator is SQL text that runs in Spark and in DuckDB alike (the one
difference is how a string becomes JSON), so both start from the same JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import settled

#: (framework, as written in a section's id)
FRAMEWORKS = ("GRI_305", "IFRS_S2", "CSRD_ESRS_E1", "OJK_PSPK", "UNIFIED")
#: Id part of each section type, in the order in which documents take them.
TYPE_PARTS = ("SCOPE1", "SUMMARY", "SCOPE2", "SCOPE3_PCAF", "INTENSITY", "REDUCTION", "S3_SUPPLY", "SOCIAL", "GOVERNANCE",
              "TARGETS", "MATERIALITY", "ANNEX")
VARIANTS = 13

#: Metrics that a section may be asked about.
METRICS = ("scope1_tco2e", "scope1_natgas_tco2e", "scope1_diesel_tco2e", "scope2_location_tco2e", "scope2_market_tco2e",
           "scope3_cat15_gross_tco2e", "scope3_cat15_weighted_tco2e", "intensity_tco2e_per_idr_bn", "intensity_tco2e_per_fte",
           "yoy_change_pct", "avg_pcaf_data_quality")


def _fixed(x: str, digits: int) -> str:
    return f"CAST(CAST(CAST({x} AS STRING) AS DECIMAL(38,{digits})) AS STRING)"


def _pick(expr: str, values) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


# The figures as a report prints them, one row per document.
_FACTS = f"""
SELECT d.doc_id AS k, d.text AS doc_text, s.reporting_year AS y, s.metric_key,
       CAST(d.doc_id % {VARIANTS} AS INT) AS v,
       {_pick(f"CAST(d.doc_id % {len(FRAMEWORKS)} AS INT)", FRAMEWORKS)} AS fw,
       {_pick(f"CAST(floor(d.doc_id / 5) % {len(TYPE_PARTS)} AS INT)", TYPE_PARTS)} AS part,
       {_fixed('s.scope1_tco2e', 3)} AS s1, {_fixed('s.scope1_natgas_tco2e', 4)} AS gas, {_fixed('s.scope1_diesel_tco2e', 4)} AS diesel,
       {_fixed('s.scope2_location_tco2e', 3)} AS s2l, {_fixed('s.scope2_market_tco2e', 3)} AS s2m,
       {_fixed('s.scope3_cat15_gross_tco2e', 2)} AS gross, {_fixed('s.scope3_cat15_weighted_tco2e', 2)} AS weighted,
       {_fixed('s.intensity_tco2e_per_idr_bn', 6)} AS per_idr, {_fixed('s.intensity_tco2e_per_fte', 4)} AS per_fte,
       coalesce({_fixed('s.yoy_change_pct', 2)}, '') AS yoy,
       {_fixed('(s.scope1_tco2e * 1.1e0)', 3)} AS s1_off,
       {_fixed('(s.intensity_tco2e_per_idr_bn + 1e0)', 6)} AS per_idr_off
FROM {{documents}} d JOIN {{slots}} s ON s.slot = CAST(d.doc_id % {{years}} AS INT)
"""

_SENTENCES = """
SELECT f.*,
  CASE WHEN part = 'SCOPE1' THEN 'Scope 1 emissions for ' || y || ' came to ' || CASE WHEN v = 2 THEN s1_off ELSE s1 END || ' tCO2e; natural gas gave '
            || gas || ' tCO2e and diesel ' || diesel || ' tCO2e.' || CASE WHEN yoy <> '' THEN ' Total emissions moved by '
            || CASE WHEN v = 4 THEN '77.7' ELSE yoy END || '% as the yearly change.' ELSE '' END
       WHEN part = 'SUMMARY' THEN 'In ' || y || ' scope 1 stood at ' || CASE WHEN v = 2 THEN s1_off ELSE s1 END || ' tCO2e, scope 2 at ' || s2l
            || ' tCO2e and gross financed emissions at ' || gross || ' tCO2e.'
       WHEN part = 'SCOPE2' THEN 'Scope 2 emissions for ' || y || ' were ' || s2l || ' tCO2e by location and '
            || CASE WHEN v = 2 THEN s1_off ELSE s2m END || ' tCO2e by market.'
       WHEN part IN ('SCOPE3_PCAF', 'S3_SUPPLY') THEN 'Gross financed emissions reached ' || gross || ' tCO2e, the confidence-weighted figure '
            || CASE WHEN v = 2 THEN s1_off ELSE weighted END || ' tCO2e in ' || y || '.'
       WHEN part = 'INTENSITY' THEN 'Intensity in ' || y || ' was ' || coalesce(CASE WHEN v = 10 THEN per_idr_off ELSE per_idr END, 'n/a') || ' tCO2e/IDR bn and '
            || coalesce(per_fte, 'n/a') || ' per FTE.'
       ELSE 'This chapter covers the year ' || y || '.' END
  || CASE v WHEN 3 THEN ' We present our results as a world-class effort.'
            WHEN 6 THEN ' The total was calculated as a sum, divided by sites.'
            WHEN 11 THEN ' According to the registry, see https://example.org/data for more.'
            WHEN 1 THEN ' The figures are in {{figure_table}} and {{annex_note}}.'
            WHEN 12 THEN ' Some 61.37 % of sites took part.'
            WHEN 0 THEN ' KEY INSIGHT: the figures above are final.' ELSE '' END AS said,
  CASE WHEN part IN ('SCOPE1', 'SUMMARY') THEN CASE WHEN v = 2 THEN s1_off ELSE s1 END WHEN part = 'SCOPE2' THEN s2l
       WHEN part IN ('SCOPE3_PCAF', 'S3_SUPPLY') THEN gross WHEN part = 'INTENSITY' THEN per_fte END AS headline
FROM ({facts}) f
"""

_JSON = """
SELECT k AS section_key, metric_key || CASE WHEN v = 7 THEN '_draft' ELSE '' END AS metrics_key,
       CAST(k % 2 AS INT) AS retry_count, fw || '_' || part || '_' || y AS section_id,
  CASE WHEN v = 8 THEN '{{"section_id": "' || fw || '", "paragraphs": [' ELSE
  '{{"section_id": "' || fw || '_' || part || '_' || y || '", "title": "' || part || ' ' || y || '"'
  || CASE WHEN v = 5 THEN '' ELSE
     ', "paragraphs": [{{"paragraph_type": "' || CASE WHEN v = 9 THEN 'story' ELSE 'narrative' END || '", "text": ' || {quoted}
     || '}}, {{"paragraph_type": "methodology", "text": "Figures follow the operational control approach."}}]'
     || ', "tables": [' || CASE WHEN headline IS NULL THEN '' ELSE
        '{{"caption": "Figures of ' || y || '", "headers": ["Measure", "Value"], "rows": [["Total", "' || headline || '"'
        || CASE WHEN v = 9 THEN ', "extra"' ELSE '' END || ']' || CASE WHEN v = 12 THEN ', ["Estimate", "31415.9265"]' ELSE '' END || ']}}' END || ']'
     || ', "key_metrics": [' || CASE WHEN headline IS NULL THEN '' ELSE '{{"metric": "total", "value": ' || headline || ', "unit": "tCO2e"}}' END || ']'
     || ', "footnotes": ["Figures of ' || y || ' are rounded."' || CASE k % 3 WHEN 0 THEN
        ', "DATA PROVENANCE: Source: summary EF: national Methodology: GHG Protocol Quality: 2 Validated: yes Owner: risk"'
        WHEN 1 THEN ', "DATA PROVENANCE: Source: summary EF: national Methodology: GHG Protocol Quality: 2 Validated: no"' ELSE '' END || ']'
     || ', "framework_references": ["' || fw || '"]' END
  || CASE WHEN v = 1 THEN ', "data_sources_used": []' ELSE ', "data_sources_used": ["aggregated.ghg_summary_annual"]' END
  || CASE WHEN v = 1 THEN '' ELSE ', "advisory_recommendations": ["Meter all sites.", "Ask borrowers for data."]' END
  || '}}' END AS content_json
FROM ({sentences}) s
"""


def sections_sql(documents: str, slots: str, quoted: str, years: str) -> str:
    """The generator over named tables; ``quoted`` makes a JSON string of {text}, ``years`` is the number of bank-years."""
    facts = _FACTS.format(documents=documents, slots=slots, years=years)
    return _JSON.format(sentences=_SENTENCES.format(facts=facts), quoted=quoted.format(text="coalesce(doc_text, '') || ' ' || said"))


def slots_sql(summary: str) -> str:
    """The bank-years, numbered from 0; a document takes the one that its id leaves as remainder."""
    return f"SELECT CAST(row_number() OVER (ORDER BY metric_key) - 1 AS INT) AS slot, * FROM {summary}"


def sections_from_documents(docs: DataFrame, summary: DataFrame) -> DataFrame:
    """section_key, metrics_key, retry_count, section_id, content_json of every document.

    ``summary`` should be a stored table, as it is counted first. Every bank-year has sections, however many there are.
    """
    spark = docs.sparkSession
    slots = summary.withColumn("slot", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("metric_key")) - 1)   # one row per bank and year
    sql = sections_sql("@docs", "@slots", "substr(to_json(array({text})), 2, length(to_json(array({text}))) - 2)", str(max(1, summary.count())))
    for plain, named in (("{", "{{"), ("}", "}}"), ("@docs", "{docs}"), ("@slots", "{slots}")):
        sql = sql.replace(plain, named)
    return settled(spark.sql(sql, docs=docs.select("doc_id", "text"), slots=slots))


METRICS_SQL = """
SELECT metrics_key, metric, CASE WHEN draft AND metric IN ('scope3_cat15_weighted_tco2e', 'scope1_natgas_tco2e') THEN value * 3e0 ELSE value END AS value
FROM (SELECT metric_key || d.suffix AS metrics_key, d.draft, m.metric, m.value
      FROM {long} m JOIN (SELECT '' AS suffix, false AS draft UNION ALL SELECT '_draft', true) d ON true) x
"""


def report_metrics(summary: DataFrame) -> DataFrame:
    """metrics_key, metric, value: the summary unpivoted; a draft's own figures contradict each other."""
    long = summary.select("metric_key", *[F.col(m).cast("double").alias(m) for m in METRICS]).unpivot(["metric_key"], list(METRICS), "metric", "value")
    draft = F.when(F.col("metric").isin("scope3_cat15_weighted_tco2e", "scope1_natgas_tco2e"), F.col("value") * 3.0).otherwise(F.col("value"))
    return (long.select(F.col("metric_key").alias("metrics_key"), "metric", "value")
            .unionByName(long.select(F.concat("metric_key", F.lit("_draft")).alias("metrics_key"), "metric", draft.alias("value"))))
