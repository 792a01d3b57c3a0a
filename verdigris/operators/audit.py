"""Audit of generated report sections (and plain texts) against the numbers, at scale.

Input tables:

* ``sections(section_key, metrics_key, retry_count, content_json)`` - one JSON
  section per row;
* ``metrics(metrics_key, metric, value)`` - the source numbers, unpivoted
  (every level of the data bundle, D-11).

Every rule is a column expression or a join; claims are exploded from the
text with ``regexp_extract_all``; the tolerance match between claims and
allowed values is a bucketed equi-join (``floor(v / tol)`` with the allowed
side expanded to the neighbouring buckets) followed by ``abs <= tol`` - a
range join that never compares all pairs of a section.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import settled

# --------------------------------------------------------------------------
# FIXED VALUES: audit constants, patterns and word lists (reference rules)
# --------------------------------------------------------------------------
TOLERANCE_TCO2E = 0.001
TOLERANCE_PCT = 0.05
TOLERANCE_YOY = 0.1
TOLERANCE_INTENSITY = 0.000001

WHITELISTED_VALUES = (
    2020.0, 2021.0, 2022.0, 2023.0, 2024.0, 2025.0, 2026.0, 2027.0, 2028.0, 2029.0, 2030.0,
    2035.0, 2050.0, 2060.0,
    29.8, 273.0,
    1.0, 1.5, 2.0, 3.0, 4.0, 5.0,
    0.45, 0.60, 0.75, 0.90, 1.00,
    100.0, 0.0,
    0.7886,
)

REQUIRED_KEYS = ("section_id", "title", "paragraphs", "tables", "key_metrics", "footnotes",
                 "framework_references")
PARAGRAPH_TYPES = ("narrative", "methodology", "footnote", "forward_looking")
QUANT_SECTIONS = ("scope1", "scope2", "scope3_pcaf", "intensity", "summary")
SECTION_ID_PATTERN = r"^[A-Z0-9_]+_[A-Z0-9]+_\d{4}$"

# numbers with a unit: the original pattern (strict_reference) and the corrected default
# (no match inside a longer number, longest unit first) - see D-10
NUMERIC_PATTERN_STRICT = (r"(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*"
                          r"(tCO2e|%|IDR|MWh|GJ|tCO2e/IDR|per FTE|per employee|per IDR billion)")
NUMERIC_PATTERN = (r"(?<![\d,.])(\d+(?:,\d{3})*(?:\.\d+)?)\s*"
                   r"(tCO2e/IDR|per IDR billion|per employee|per FTE|tCO2e|MWh|IDR|GJ|%)")
PCT_PATTERN = r"(\d+\.\d+)\s*%"
YOY_PATTERN = r"(?i)(-?\d+\.\d+)\s*%.*(?:year.over.year|YoY|change)"
INTENSITY_PATTERN = r"(\d+\.\d{4,})\s*(?:tCO2e/IDR|per IDR|per FTE|tCO2e/FTE)"
PLACEHOLDER_PATTERN = r"\{[a-z_]+\}"

# Java's \b already treats letters of every script as word characters (as Python's
# patterns do); (?U) is needed only where \w appears, and costs a lot of CPU elsewhere
PROHIBITED = [
    # rule, severity, pattern
    ("VAL-PRH-02", "error", r"(?i)\b(calculated as|computed by|we estimate|approximately|roughly|"
                            r"we calculate|divided by|multiplied by)\b"),
    ("VAL-PRH-03", "error", r"https?://\S+"),
    ("VAL-PRH-03-CITE", "warning", r"(?i)according to\s+([^,.]+)"),
    ("VAL-PRH-04", "error", r"(?i)\b(we|our|us|my|ourselves)\b"),
    ("VAL-PRH-04-I", "error", r"(?U)(?<![A-Z])\bI\b(?!\w)"),
    ("VAL-PRH-05", "error", r"(?i)\b(industry.leading|best.in.class|world.class|cutting.edge|"
                            r"pioneering|unparalleled|groundbreaking|revolutionary)\b"),
]


def _from_letters(pattern: str) -> str:
    """A pattern of whole words that begins with a class of their first letters."""
    words = re.fullmatch(r"\(\?i\)\\b\((.*)\)\\b", pattern)[1].split("|")
    firsts = "".join(sorted({w[0] for w in words}))
    return rf"(?i)[{firsts}](?<=\b.)(?:" + "|".join(f"(?<={w[0]}){w[1:]}" for w in words) + r")\b"


#: Patterns with the same matches, written so that a place of the text is given up at its first character: one that
#: begins with a boundary, a look behind or a group costs several times as much per character. Those of numbers match
#: the whole claim, and the number alone.
QUICK = {
    NUMERIC_PATTERN: NUMERIC_PATTERN.replace(r"(?<![\d,.])(\d+(?:,\d{3})*(?:\.\d+)?)", r"\d(?<![\d,.]\d)\d*(?:,\d{3})*(?:\.\d+)?"),
    PCT_PATTERN: r"\d\d*\.\d+(?=\s*%)",
    INTENSITY_PATTERN: INTENSITY_PATTERN.replace(r"(\d+\.\d{4,})\s*", r"\d\d*\.\d{4,}(?=\s*") + ")",
    **{p: _from_letters(p) for _, _, p in PROHIBITED if p.startswith(r"(?i)\b(")},
    r"(?U)(?<![A-Z])\bI\b(?!\w)": r"(?U)I(?<![A-Z]I)(?<=\bI)\b(?!\w)",
}


def _quick(pattern: str) -> Column:
    return F.lit(QUICK.get(pattern, pattern))


SECTION_SCHEMA = T.StructType([
    T.StructField("section_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("paragraphs", T.ArrayType(T.StructType([
        T.StructField("paragraph_type", T.StringType()), T.StructField("text", T.StringType())]))),
    T.StructField("tables", T.ArrayType(T.StructType([
        T.StructField("caption", T.StringType()),
        T.StructField("headers", T.ArrayType(T.StringType())),
        T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType())))]))),
    T.StructField("key_metrics", T.ArrayType(T.StructType([
        T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType())]))),
    T.StructField("footnotes", T.ArrayType(T.StringType())),
    T.StructField("framework_references", T.ArrayType(T.StringType())),
    T.StructField("data_sources_used", T.ArrayType(T.StringType())),
    T.StructField("advisory_recommendations", T.ArrayType(T.StringType())),
])


# -------------------------------------------------------------------- parsing
def parse_sections(sections: DataFrame) -> DataFrame:
    """VA-01/02/09/22: parse JSON, key list, section type and the flattened text."""
    keys = F.json_object_keys("content_json")
    s = (sections.withColumn("keys", keys)
         .withColumn("json_valid", F.col("keys").isNotNull())
         .withColumn("sec", F.when(F.col("json_valid"), F.from_json("content_json", SECTION_SCHEMA))))
    paras = F.coalesce(F.col("sec.paragraphs"), F.array())
    tables = F.coalesce(F.col("sec.tables"), F.array())
    cells = F.flatten(F.transform(tables, lambda t: F.flatten(F.coalesce(t["rows"], F.array()))))
    texts = F.transform(paras, lambda p: F.coalesce(p["text"], F.lit("")))
    sid = F.coalesce(F.col("sec.section_id"), F.lit(""))
    return settled(s.withColumn("section_id", sid)
                   .withColumn("section_type", section_type(sid))
                   .withColumn("all_text", F.array_join(F.concat(texts, F.coalesce(cells, F.array())), " "))
                   .withColumn("table_cells", cells))


# FIXED VALUES: section type by the parts its id holds, first match wins; ids of unified reports look at the
# first list before the second
UNIFIED_MARKS = [("scope1", ["scope1"]), ("scope2", ["scope2"]), ("scope3_pcaf", ["pcaf", "scope3"]), ("intensity", ["intensity"]),
                 ("reduction", ["reduction"]), ("social", ["social"]), ("governance", ["governance"]), ("targets", ["targets"])]
SECTION_MARKS = [("scope1", ["scope1", "_s1_"]), ("scope2", ["scope2", "_s2_"]), ("scope3_pcaf", ["pcaf", "scope3", "_s3_"]),
                 ("intensity", ["intensity"]), ("social", ["social"]), ("reduction", ["reduction", "305-5"]), ("summary", ["summary"]),
                 ("governance", ["gov"]), ("targets", ["target"]), ("double_materiality", ["materiality"])]


def section_type(sid) -> Column:
    """VA-22: section type from its id, by the tables above."""
    s = F.lower(sid)
    cases = [(F.instr(s, "unified") > 0, UNIFIED_MARKS), (F.lit(True), SECTION_MARKS)]
    hits = [F.when(given & (F.instr(s, mark) > 0), F.lit(kind)) for given, marks in cases for kind, parts in marks for mark in parts]
    return F.coalesce(*hits, F.lit("unknown"))


def _rule(cond: Column, rule: str, severity: str, detail: Column) -> Column:
    return F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
                                 detail.cast("string").alias("detail")))


def structure_findings(parsed: DataFrame) -> DataFrame:
    """Adds ``findings`` (structural findings array) and ``struct_error`` to parsed sections."""
    f = _structure_array()
    return (settled(parsed.withColumn("findings", f))
                  .withColumn("struct_error", F.exists("findings", lambda x: x["severity"].isin("error", "retry"))))


def section_structure(parsed: DataFrame) -> DataFrame:
    """VA-01..VA-08: structural findings, one row per (section, rule)."""
    p = parsed if "findings" in parsed.columns else structure_findings(parsed)
    return (p.select("section_key", F.explode("findings").alias("f"))
             .select("section_key", "f.rule", "f.severity", "f.detail"))


def _structure_array() -> Column:
    sec = F.col("sec")
    paras = F.coalesce(sec["paragraphs"], F.array())
    tables = F.coalesce(sec["tables"], F.array())
    missing = F.array_except(F.array(*[F.lit(k) for k in REQUIRED_KEYS]), F.coalesce("keys", F.array()))
    bad_types = F.filter(paras, lambda p: ~F.coalesce(p["paragraph_type"], F.lit("")).isin(*PARAGRAPH_TYPES))
    ragged = F.exists(tables, lambda t: F.exists(F.coalesce(t["rows"], F.array()),
                                                 lambda r: F.size(r) != F.size(F.coalesce(t["headers"], F.array()))))
    quant = F.col("section_type").isin(*QUANT_SECTIONS)
    findings = F.array_compact(F.array(
        _rule(~F.col("json_valid"), "VAL-STR-01", "retry", F.lit("not a JSON object")),
        _rule(F.col("json_valid") & (F.size(missing) > 0), "VAL-STR-02", "error", F.array_join(F.array_sort(missing), ",")),
        _rule(F.col("json_valid") & ~F.col("section_id").rlike(SECTION_ID_PATTERN), "VAL-STR-03", "warning",
              F.col("section_id")),
        _rule(F.col("json_valid") & (F.size(paras) == 0), "VAL-STR-04", "warning", F.lit("empty paragraphs")),
        _rule(F.col("json_valid") & (F.size(bad_types) > 0), "VAL-STR-05", "error",
              F.array_join(F.transform(bad_types, lambda p: F.coalesce(p["paragraph_type"], F.lit(""))), ",")),
        _rule(F.col("json_valid") & quant & (F.size(tables) == 0), "VAL-STR-06", "error", F.lit("no tables")),
        _rule(F.col("json_valid") & ragged, "VAL-STR-07", "error", F.lit("row length differs from headers")),
        _rule(F.col("json_valid") & quant & (F.size(F.coalesce(sec["key_metrics"], F.array())) == 0),
              "VAL-STR-08", "error", F.lit("no key_metrics")),
        _rule(F.col("json_valid") & (F.size(F.coalesce(sec["data_sources_used"], F.array())) == 0),
              "VAL-STR-09", "warning", F.lit("data_sources_used empty")),
        _rule(F.col("json_valid") & (F.size(F.coalesce(sec["advisory_recommendations"], F.array())) < 2),
              "VAL-STR-10", "warning", F.lit("advisory_recommendations < 2")),
    ))
    return findings


# -------------------------------------------------------------------- claims
def _claims_in(text: Column, strict_reference: bool) -> Column:
    """Array of (v, u): every number with a unit, found in one pass and then told apart."""
    found = F.regexp_extract_all(text, _quick(NUMERIC_PATTERN_STRICT if strict_reference else NUMERIC_PATTERN), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, r"^[\d,.]+", 0).alias("v"),
                                                 F.regexp_replace(m, r"^[\d,.]+\s*", "").alias("u")))


def extract_claims(texts: DataFrame, key: str, text_col: str, strict_reference: bool = False) -> DataFrame:
    """VA-10: (key, claim_no, value, unit) for every number-with-unit in the text."""
    z = texts.select(key, F.posexplode(_claims_in(F.col(text_col), strict_reference)).alias("claim_no", "c"))
    return z.select(key, "claim_no", F.col("c.v").alias("raw"),
                    F.regexp_replace("c.v", ",", "").try_cast("double").alias("value"),
                    F.col("c.u").alias("unit"))


def extract_values(texts: DataFrame, key: str, text_col: str, pattern: str, name: str = "value") -> DataFrame:
    """Numbers of one capture group of ``pattern`` as (key, pos, value)."""
    arr = F.regexp_extract_all(F.col(text_col), F.lit(pattern), 1)
    return (texts.select(key, F.posexplode(arr).alias("pos", "raw"))
                 .select(key, "pos", F.regexp_replace("raw", ",", "").try_cast("double").alias(name)))


def allowed_values(metrics: DataFrame, key: str = "metrics_key") -> DataFrame:
    """VA-11: whitelist plus, per metric, v, |v|, x1000, /1000, x100 and v rounded to 1/2/3/4/6."""
    v = F.col("value")
    variants = F.array(v, F.abs(v), v * 1000, v / 1000, v * 100, F.round(v, 1), F.round(v, 2),
                       F.round(v, 3), F.round(v, 4), F.round(v, 6))
    derived = metrics.filter(v.isNotNull()).select(key, F.explode(variants).alias("allowed"))
    wl = metrics.select(key).distinct().select(
        key, F.explode(F.array(*[F.lit(float(x)) for x in WHITELISTED_VALUES])).alias("allowed"))
    return derived.unionByName(wl).distinct()


def _floor_bucket(x: Column, tol: float) -> Column:
    # floor(x / tol) kept as a double: no BIGINT overflow for huge numbers in text
    q = x / F.lit(tol)
    return q - F.pmod(q, F.lit(1.0))


def match_tolerance(left: DataFrame, right: DataFrame, keys: list[str], left_value: str, right_value: str,
                    tol: float, how: str = "left_semi") -> DataFrame:
    """VA-12: rows of ``left`` with (semi) / without (anti) a right value within ``tol``.

    Equi-join on (keys, bucket) where the right side is copied to its bucket
    and both neighbours, then the exact ``abs(l - r) <= tol`` filter.
    """
    lb = left.withColumn("_bucket", _floor_bucket(F.col(left_value), tol))
    rb0 = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col(right_value).alias("_rv"))
    rb = rb0.select("*", F.explode(F.array(*[_floor_bucket(F.col("_rv"), tol) + F.lit(float(d))
                                              for d in (-1, 0, 1)])).alias("_r_bucket"))
    cond = [F.col(k) == F.col(f"_r_{k}") for k in keys]
    cond += [F.col("_bucket") == F.col("_r_bucket"), F.abs(F.col(left_value) - F.col("_rv")) <= F.lit(tol)]
    return lb.join(rb, cond, how).drop("_bucket")


def tolerance_matched(claims: DataFrame, metrics: DataFrame, value: str = "value", tol: float = TOLERANCE_TCO2E, key: str = "metrics_key") -> DataFrame:
    """VA-12 over all claims: adds ``nearest``, the allowed value closest to each claim, and ``matched`` (within ``tol``).

    A report's allowed values are one sorted array (the metric catalogue bounds
    it); a claim finds its neighbours by binary search and meets one value at
    most, so nothing multiplies, and a report with very many claims is split
    by the adaptive skew join, as the claims are never grouped.
    """
    held = report_metrics(metrics, key).select(key, F.array_sort("allowed").alias("_allowed"))
    j = claims.join(held, key, "left")
    a, x = F.col("_allowed"), F.col(value)
    first = F.struct(F.lit(0).alias("low"), F.size(a).alias("high"))

    def step(s: Column, _: Column) -> Column:   # values before `low` are at most x, those from `high` on are larger
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        up = F.get(a, mid) <= x
        return F.when(s["low"] >= s["high"], s).otherwise(F.struct(F.when(up, mid + 1).otherwise(s["low"]).alias("low"),
                                                                   F.when(up, s["high"]).otherwise(mid).alias("high")))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(a) + 1)).cast("int") + 1)
    j = j.withColumn("_below", F.when(a.isNotNull() & x.isNotNull(), F.aggregate(steps, first, step, lambda s: s["low"])))
    under, over = F.get(a, F.col("_below") - 1), F.get(a, F.col("_below"))
    nearest = F.when(over.isNull() | (x - under <= over - x), under).otherwise(over)
    return (j.withColumn("nearest", nearest).withColumn("matched", F.coalesce(F.abs(F.col("nearest") - x) <= tol, F.lit(False)))
            .drop("_allowed", "_below"))


def report_metrics(metrics: DataFrame, key: str = "metrics_key") -> DataFrame:
    """One row per report: its allowed-value array (VA-11) and a metric -> value map.

    A report carries a bounded set of published numbers, so the collected
    arrays are bounded by the metric catalogue, not by the data.
    """
    v = F.col("value")
    variants = F.array(v, F.abs(v), v * 1000, v / 1000, v * 100, F.round(v, 1), F.round(v, 2),
                       F.round(v, 3), F.round(v, 4), F.round(v, 6))
    wl = F.array(*[F.lit(float(x)) for x in WHITELISTED_VALUES])
    g = metrics.groupBy(key).agg(
        F.flatten(F.collect_list(F.when(v.isNotNull(), variants))).alias("_derived"),
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("mmap"))
    return g.select(key, F.array_distinct(F.concat(wl, F.coalesce("_derived", F.array().cast("array<double>"))))
                    .alias("allowed"), "mmap")


def _near_any(arr: Column, x: Column, tol: float) -> Column:
    return F.exists(arr, lambda a: F.abs(a - x) <= F.lit(tol))


def _is_whitelisted(x: Column) -> Column:
    return x.isin(*[float(w) for w in WHITELISTED_VALUES])


def _parsed_numbers(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, _quick(pattern), F.lit(0 if pattern in QUICK else 1)),
                                lambda r: F.regexp_replace(r, ",", "").try_cast("double")),
                    lambda x: x.isNotNull())


def _finding(rule: str, severity: str, detail: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))


def _text(x: Column) -> Column:
    """A number as text, the same in any engine."""
    return F.coalesce(x.try_cast("decimal(38,6)").cast("string"), F.lit("large"))


def content_findings(parsed: DataFrame, metrics: DataFrame, strict_reference: bool = False,
                     prohibited: bool = True) -> DataFrame:
    """VA-10..VA-20 as one projection per section: adds ``content`` (numeric and
    prohibited findings) next to the structural ``findings``.

    The report's allowed values and metrics arrive by an equi-join on
    ``metrics_key`` with one row per report; every rule is a higher-order
    function over the section's own claims, so the corpus is read once and
    never shuffled. Sections with structural errors get no content findings
    (the reference stops there).
    """
    p = parsed if "struct_error" in parsed.columns else structure_findings(parsed)
    # one row per report: Spark broadcasts it while its measured size allows, and then splits
    # reports that own a large share of all sections
    p = p.join(report_metrics(metrics), "metrics_key", "left")
    # no text is searched whose findings the structural errors rule out
    text = F.when(~F.col("struct_error"), F.col("all_text"))
    allowed = F.coalesce(F.col("allowed"), F.array(*[F.lit(float(x)) for x in WHITELISTED_VALUES]))
    m = lambda k: F.col("mmap")[F.lit(k)]
    raw_claims = _claims_in(text, strict_reference)
    # each regex pass is materialised once as its own column (referenced several times below)
    p = (p.withColumn("_claims", F.filter(F.transform(raw_claims, lambda c: F.struct(
            F.regexp_replace(c["v"], ",", "").try_cast("double").alias("value"), c["u"].alias("unit"))),
            lambda c: c["value"].isNotNull()))
          .withColumn("_pcts", _parsed_numbers(text, PCT_PATTERN))
          # a yearly change is a percentage first
          .withColumn("_yoys", F.when(F.size("_pcts") > 0, _parsed_numbers(text, YOY_PATTERN)))
          .withColumn("_ints", _parsed_numbers(text, INTENSITY_PATTERN))
          .withColumn("_allowed", allowed))
    allowed = F.col("_allowed")
    claims = F.col("_claims")
    claim_values = F.transform(claims, lambda c: c["value"])
    num01 = F.transform(F.filter(claims, lambda c: ~_is_whitelisted(c["value"])
                                 & ~_near_any(allowed, c["value"], TOLERANCE_TCO2E)),
                        lambda c: _finding("VAL-NUM-01", "error", F.concat_ws(" ", _text(c["value"]), c["unit"])))
    pct = F.transform(F.filter(F.col("_pcts"),
                               lambda x: ~_is_whitelisted(x) & ~_near_any(allowed, x, TOLERANCE_PCT)
                               & ~x.isin(0.0, 100.0)),
                      lambda x: _finding("VAL-NUM-03", "warning", F.concat(_text(x), F.lit("%"))))
    yoy = m("yoy_change_pct")
    num04 = F.when(yoy.isNotNull(), F.transform(
        F.filter(F.col("_yoys"), lambda x: F.abs(x - yoy) > TOLERANCE_YOY),
        lambda x: _finding("VAL-NUM-04", "error", F.concat(_text(x), F.lit(" vs "), _text(yoy)))))
    irev, ifte = m("intensity_tco2e_per_idr_bn"), m("intensity_tco2e_per_fte")
    hit = lambda ref, x: F.coalesce((ref != 0) & (F.abs(x - ref) <= TOLERANCE_INTENSITY), F.lit(False))
    num05 = F.transform(F.filter(F.col("_ints"),
                                 lambda x: ~hit(irev, x) & ~hit(ifte, x) & ~_is_whitelisted(x)),
                        lambda x: _finding("VAL-NUM-05", "error", _text(x)))
    s1, s1n, s1d = m("scope1_tco2e"), m("scope1_natgas_tco2e"), m("scope1_diesel_tco2e")
    gross, weighted = m("scope3_cat15_gross_tco2e"), m("scope3_cat15_weighted_tco2e")
    num02 = F.when(F.abs(s1 - (s1n + s1d)) > TOLERANCE_TCO2E,
                   F.array(_finding("VAL-NUM-02", "error", F.lit("natgas + diesel != scope1_tco2e"))))
    num06 = F.when(weighted > gross, F.array(_finding(
        "VAL-NUM-06", "no_retry", F.concat(F.lit("weighted "), _text(weighted), F.lit(" > gross "), _text(gross)))))
    tvals = F.array_distinct(F.filter(F.transform(
        F.coalesce(F.col("table_cells"), F.array().cast("array<string>")),
        lambda c: F.regexp_replace(F.regexp_replace(c, ",", ""), "%", "").try_cast("double")),
        lambda x: x.isNotNull()))
    num07 = F.transform(F.filter(tvals, lambda t: ~_is_whitelisted(t) & ~_near_any(claim_values, t, TOLERANCE_TCO2E)),
                        lambda t: _finding("VAL-NUM-07", "warning", _text(t)))
    prh = []
    for i, (rule, severity, ptn) in enumerate(PROHIBITED if prohibited else []):
        p = p.withColumn(f"_prh{i}", F.regexp_extract(text, QUICK.get(ptn, ptn), 0))   # the first hit; no rule matches nothing
        hit_text = F.col(f"_prh{i}")
        name = "VAL-PRH-04" if rule.startswith("VAL-PRH-04") else ("VAL-PRH-03" if rule == "VAL-PRH-03-CITE" else rule)
        prh.append(F.when(hit_text != "", F.array(_finding(name, severity, hit_text))))
    empty = F.array().cast("array<struct<rule:string,severity:string,detail:string>>")
    parts = [num01, num02, pct, num04, num05, num06, num07] + prh
    content = F.flatten(F.array(*[F.coalesce(x, empty) for x in parts]))
    return (p.withColumn("content", F.when(F.col("struct_error"), empty).otherwise(content))
             .drop("allowed", "mmap", "_claims", "_pcts", "_yoys", "_ints", "_allowed",
                   *[f"_prh{i}" for i in range(len(PROHIBITED))]))


def numeric_findings(parsed: DataFrame, metrics: DataFrame, strict_reference: bool = False) -> DataFrame:
    """VA-10..VA-19: numeric findings (section_key, rule, severity, detail).

    ``VAL-NUM-01`` rows are the unmatched claims; the outcome step decides
    between RETRY and FAIL from their count.
    """
    c = content_findings(parsed, metrics, strict_reference, prohibited=False)
    return (c.select("section_key", F.explode("content").alias("f"))
             .filter(F.col("f.rule").startswith("VAL-NUM"))
             .select("section_key", "f.rule", "f.severity", "f.detail"))


def prohibited_hits(texts: DataFrame, key: str, text_col: str) -> DataFrame:
    """VA-20 / VA-25: per text and rule, the number of matches and the first one."""
    rules = PROHIBITED + [("VAL-PLACEHOLDER", "error", PLACEHOLDER_PATTERN)]
    # one regex pass per rule, materialised once and read twice (count and sample)
    arrs = texts.select(key, *[F.regexp_extract_all(F.col(text_col), _quick(pat), F.lit(0)).alias(f"_h{i}")
                               for i, (_, _, pat) in enumerate(rules)])
    items = [F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
                      F.size(f"_h{i}").alias("hits"), F.try_element_at(f"_h{i}", F.lit(1)).alias("sample"))
             for i, (rule, severity, _) in enumerate(rules)]
    return (arrs.select(key, F.explode(F.array(*items)).alias("h"))
                 .select(key, "h.rule", "h.severity", "h.hits", "h.sample")
                 .filter(F.col("hits") > 0))


def prohibited_findings(parsed: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """VA-20: prohibited-content findings of sections without structural errors."""
    p = parsed if "struct_error" in parsed.columns else structure_findings(parsed)
    h = prohibited_hits(p.filter(~F.col("struct_error")).select("section_key", "all_text"), "section_key", "all_text") \
        .filter(F.col("rule") != "VAL-PLACEHOLDER")
    rule = F.when(F.col("rule").startswith("VAL-PRH-04"), F.lit("VAL-PRH-04")) \
            .when(F.col("rule") == "VAL-PRH-03-CITE", F.lit("VAL-PRH-03")).otherwise(F.col("rule"))
    return h.select("section_key", rule.alias("rule"), "severity", F.col("sample").alias("detail"))


# -------------------------------------------------------------------- outcome
OUTCOME_RANK = {"PASS": 0, "WARN": 1, "RETRY": 2, "FAIL": 3, "FAIL_NO_RETRY": 4}


def audit(sections: DataFrame, metrics: DataFrame, strict_reference: bool = False) -> DataFrame:
    """VA-13 / VA-21 / VA-23: outcome and inclusion status per section, in one pass.

    RETRY when the JSON is unusable, or when exactly one claim is unmatched
    on the first attempt; otherwise FAIL_NO_RETRY > FAIL > WARN > PASS.
    """
    c = content_findings(structure_findings(parse_sections(sections)), metrics, strict_reference)
    allf = F.concat(F.col("findings"), F.col("content"))
    cnt = lambda pred: F.size(F.filter(allf, pred))
    retry_flags = cnt(lambda f: f["severity"] == "retry")
    struct_errors = cnt(lambda f: f["rule"].startswith("VAL-STR") & (f["severity"] == "error"))
    unmatched = cnt(lambda f: f["rule"] == "VAL-NUM-01")
    no_retry = cnt(lambda f: f["severity"] == "no_retry")
    other_errors = cnt(lambda f: f["severity"].isin("error", "no_retry") & (f["rule"] != "VAL-NUM-01"))
    warnings = cnt(lambda f: f["severity"] == "warning")
    errors = other_errors + F.when(unmatched > 0, 1).otherwise(0)
    outcome = (F.when(retry_flags > 0, F.lit("RETRY"))
                .when(struct_errors > 0, F.lit("FAIL"))
                .when((unmatched == 1) & (F.col("retry_count") == 0), F.lit("RETRY"))
                .when(no_retry > 0, F.lit("FAIL_NO_RETRY"))
                .when(errors > 0, F.lit("FAIL"))
                .when(warnings > 0, F.lit("WARN"))
                .otherwise(F.lit("PASS")))
    status = (F.when(~F.col("json_valid") & (F.col("retry_count") > 0), F.lit("ERROR"))   # unusable again
               .when(F.col("outcome") == "PASS", F.lit("INCLUDED"))
               .when(F.col("outcome").isin("WARN", "FAIL"), F.lit("INCLUDED_WITH_WARNINGS"))
               .when(F.col("outcome") == "RETRY", F.lit("RETRY_PENDING"))
               .otherwise(F.lit("HUMAN_REVIEW")))
    return (c.withColumn("outcome", outcome).withColumn("status", status)
             .select("section_key", "section_id", "section_type", "retry_count", "outcome", "status",
                     errors.cast("bigint").alias("errors"), warnings.cast("bigint").alias("warnings"),
                     unmatched.cast("bigint").alias("unmatched_claims")))


def included_summary(outcomes: DataFrame) -> DataFrame:
    """VA-23: counts per status and whether the status is kept for assembly."""
    return outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("sections")) \
        .withColumn("included", F.col("status").isin("INCLUDED", "INCLUDED_WITH_WARNINGS"))


def failure_detail(findings: DataFrame, cap: int | None = None) -> DataFrame:
    """VA-13: the unmatched claims of each section, all or the first ``cap`` of each (the report's list)."""
    found = findings.filter(F.col("rule") == "VAL-NUM-01")
    if cap is None:
        return found
    w = Window.partitionBy("section_key").orderBy("detail")
    return found.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= cap).drop("n")


# FIXED VALUES: section order per framework (unknown types last)
SECTION_ORDER = {
    "GRI_305": ["summary", "scope1", "scope2", "scope3_pcaf", "intensity", "reduction", "social"],
    "IFRS_S2": ["summary", "governance", "scope1", "scope2", "scope3_pcaf", "intensity", "targets", "social"],
    "CSRD_ESRS_E1": ["summary", "governance", "targets", "scope1", "scope2", "scope3_pcaf", "intensity",
                     "reduction", "social", "double_materiality"],
    "OJK_PSPK": ["summary", "governance", "scope1", "scope2", "scope3_pcaf", "intensity", "reduction", "social"],
    "MULTI_FRAMEWORK": ["summary", "scope1", "scope2", "scope3_pcaf", "intensity", "reduction", "governance",
                        "targets", "social", "double_materiality"],
}
UNKNOWN_POSITION = 999


def section_order(parsed: DataFrame, framework_col: str = "framework") -> DataFrame:
    """VA-27: each section's position in its framework's order (sort key, then section_key).

    The order table is fixed and small (broadcast); no per-report window,
    so a report with very many sections never lands in one task.
    """
    spark = parsed.sparkSession
    rows = [(fw, t, i) for fw, types in SECTION_ORDER.items() for i, t in enumerate(types)]
    order = spark.createDataFrame(rows, "framework string, section_type string, position int")
    p = parsed.select("section_key", "metrics_key", "section_id", "section_type", F.col(framework_col).alias("framework"))
    return (p.join(F.broadcast(order), ["framework", "section_type"], "left")
             .select("metrics_key", "framework", "section_key", "section_id", "section_type",
                     F.coalesce("position", F.lit(UNKNOWN_POSITION)).alias("position")))


def framework_of(section_id) -> Column:
    """Framework prefix of a section id: the known framework names it starts with."""
    sid = F.col(section_id) if isinstance(section_id, str) else section_id
    e = F.lit("MULTI_FRAMEWORK")
    for fw in sorted(SECTION_ORDER, key=len):
        e = F.when(sid.startswith(fw + "_"), F.lit(fw)).otherwise(e)
    return e


def summary_context(parsed: DataFrame, marker: str = "KEY INSIGHT") -> DataFrame:
    """RP-13: sections per report and how many carry an insight marker in a paragraph."""
    has = F.exists(F.coalesce(F.col("sec.paragraphs"), F.array()),
                   lambda p: F.coalesce(p["text"].contains(marker), F.lit(False)))
    return parsed.groupBy("metrics_key").agg(F.count(F.lit(1)).alias("total_sections"),
                                             F.count_if(has).alias("sections_with_insights"))


# FIXED VALUES: metric labels recognised in text (label -> metric) for claim mapping
CLAIM_LABELS = [("scope 1", "scope1_tco2e"), ("natural gas", "scope1_natgas_tco2e"),
                ("diesel", "scope1_diesel_tco2e"), ("scope 2", "scope2_location_tco2e"),
                ("gross financed", "scope3_cat15_gross_tco2e"),
                ("confidence-weighted", "scope3_cat15_weighted_tco2e")]
LABEL_WINDOW = 60
# the number may follow other digits (a year), but doesn't begin inside one
LABEL_PATTERN = ("(?iu)(" + "|".join(lb for lb, _ in CLAIM_LABELS) + r")[^\n]{0,%d}?[^\n\d,.](\d+(?:,\d{3})*(?:\.\d+)?)\s*tCO2e"
                 % LABEL_WINDOW)


def claim_metric_mapping(parsed: DataFrame, metrics: DataFrame) -> DataFrame:
    """VA-24: a number with a metric label within 60 characters before it is a claim about
    that metric; compare it with the report's value (tolerance 0.001)."""
    p = parsed.join(report_metrics(metrics), "metrics_key", "left")
    labels = F.regexp_extract_all("all_text", F.lit(LABEL_PATTERN), 1)
    nums = F.regexp_extract_all("all_text", F.lit(LABEL_PATTERN), 2)
    lm = F.create_map(*[x for lb, m in CLAIM_LABELS for x in (F.lit(lb), F.lit(m))])
    z = p.select("section_key", "mmap", F.posexplode(F.arrays_zip(labels.alias("l"), nums.alias("n")))
                 .alias("claim_no", "c"))
    metric = lm[F.lower(F.col("c.l"))]
    claimed = F.regexp_replace("c.n", ",", "").try_cast("double")
    source = F.col("mmap")[metric]
    return z.select("section_key", "claim_no", F.lower(F.col("c.l")).alias("label"), metric.alias("metric"),
                    claimed.alias("claimed_value"), source.alias("source_value"),
                    (F.abs(claimed - source) <= TOLERANCE_TCO2E).alias("matches"))


# FIXED VALUES: provenance block marker and its six fields
PROVENANCE_MARK = "DATA PROVENANCE:"
PROVENANCE_FIELDS = ("Source:", "EF:", "Methodology:", "Quality:", "Validated:", "Owner:")


def provenance_check(parsed: DataFrame) -> DataFrame:
    """VA-29: provenance footnote present (VAL-PROV-01) and complete (VAL-PROV-02), warnings."""
    notes = F.coalesce(F.col("sec.footnotes"), F.array().cast("array<string>"))
    block = F.try_element_at(F.filter(notes, lambda n: n.contains(PROVENANCE_MARK)), F.lit(1))
    present = F.size(F.array_compact(F.array(*[F.when(block.contains(f), F.lit(f)) for f in PROVENANCE_FIELDS])))
    return parsed.select("section_key", block.isNotNull().alias("has_provenance"),
                         F.coalesce(present, F.lit(0)).alias("fields_present"),
                         F.when(block.isNull(), F.lit("VAL-PROV-01"))
                          .when(present < len(PROVENANCE_FIELDS), F.lit("VAL-PROV-02")).alias("warning"))


def recover_json(raw) -> Column:
    """VA-26: the object as is, else the fenced ```json block, else first '{' .. last '}'."""
    r = F.col(raw) if isinstance(raw, str) else raw
    fenced = F.regexp_extract(r, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    braces = F.regexp_extract(r, r"(?s)(\{.*\})", 1)
    valid = lambda s: F.json_object_keys(s).isNotNull()
    return (F.when(valid(r), r)
             .when(valid(fenced), fenced)
             .when(valid(braces), braces))


#: Footnotes of a report are ranked in this many ranges of their hash's first places.
FOOTNOTE_RANGES = 64


def footnote_index(sections: DataFrame, report_key: str = "metrics_key") -> DataFrame:
    """VA-28: footnotes de-duplicated across a report's sections and numbered in first-seen order.

    A report may own most sections: first places come from a partial aggregate
    over (report, footnote), and ranks from ranges of section keys, each
    counted first and then ranked alone, so no report is ranked in one task.
    """
    p = parse_sections(sections)
    f = p.select(report_key, "section_key", F.posexplode(F.coalesce(F.col("sec.footnotes"), F.array()))
                 .alias("pos", "footnote"))
    first = f.groupBy(report_key, "footnote").agg(F.min(F.struct("section_key", "pos")).alias("first"))
    keys = p.agg(F.min("section_key").alias("lo"), F.max("section_key").alias("hi"))
    lo = keys.select("lo").scalar()
    span = keys.select(F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) / FOOTNOTE_RANGES))).scalar()
    placed = first.withColumn("range", F.floor((F.col("first.section_key") - lo) / span))
    ahead = Window.partitionBy(report_key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(report_key, "range").agg(F.count("*").alias("c"))
    counts = counts.select(report_key, "range", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy(report_key, "range").orderBy("first.section_key", "first.pos"))
    return placed.join(counts, [report_key, "range"]).select(report_key, (F.col("before") + rank).cast("int").alias("footnote_no"), "footnote")


def footnote_places(sections: DataFrame, report_key: str = "metrics_key") -> DataFrame:
    """VA-28: the footnote numbers that each section's content refers to, in the order of the section."""
    p = parse_sections(sections).select(report_key, "section_key", F.posexplode(F.coalesce(F.col("sec.footnotes"), F.array()))
                                        .alias("pos", "footnote"))
    return (p.join(footnote_index(sections, report_key), [report_key, "footnote"])
            .groupBy(report_key, "section_key")   # a section's own footnotes
            .agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("pos", "footnote_no"))), lambda x: x["footnote_no"]))
                 .alias("footnote_nos")))
