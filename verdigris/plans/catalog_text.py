"""Registered queries: section audit, text rules, retrieval, report tables, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import audit, chunks, docmeta, reports, retrieval, vectors
from ..session import materialize
from ..sources import sections, synth, zones
from ..sources.fixtures import inputs
from .catalog_core import core

PACK_CAP_TOKENS = 500
FALLBACK_LANG = "en"


def _summary(spark, d):
    """The summary as a table of its own: a query that audits derives it once, for sections and metrics alike.

    The facilities' months, which three of its branches read, are derived from the raw lines once.
    """
    c = core(spark, d)
    if not c.root:
        c.inp.energy = materialize(c.inp.energy, "audit-energy")
    return materialize(c.summary(), "audit-summary")


def _sections(spark, d, summary=None):
    return sections.sections_from_documents(inputs(spark, d).raw("documents"), summary or _summary(spark, d))


def _parsed(spark, d, summary=None):
    return audit.parse_sections(_sections(spark, d, summary))


def _with_metrics(of, made):
    """A query of (sections or what ``of`` makes of them, metrics), both from one summary."""
    def run(spark, d):
        summary = _summary(spark, d)
        return made(of(spark, d, summary), sections.report_metrics(summary))
    return run


def _outcomes(spark, d):
    return _with_metrics(_sections, audit.audit)(spark, d)


def _claims(matched: bool):
    """VA-12: the claims of all sections with (semi) or without (anti) an allowed value in reach."""
    def made(parsed, metrics):
        claims = audit.extract_claims(parsed, "section_key", "all_text").where("value IS NOT NULL")
        keyed = claims.join(parsed.select("section_key", "metrics_key"), "section_key")
        found = audit.tolerance_matched(keyed, metrics)
        return found.where(F.col("matched") == matched).select("section_key", "claim_no", "raw", "value", "unit")
    return _with_metrics(_parsed, made)


def _section_placeholders(spark, d):
    """VA-25: placeholders left in the sections' texts."""
    hits = audit.prohibited_hits(_parsed(spark, d), "section_key", "all_text")
    return hits.where("rule = 'VAL-PLACEHOLDER'").select("section_key", F.col("hits").cast("int").alias("hits"), "sample")


def _section_disclosures(spark, d):
    s = _parsed(spark, d).withColumn("framework", audit.framework_of("section_id"))
    return reports.section_disclosures(s, reports.nested_disclosures(spark))


#: A filter as a knowledge base takes it: either framework, some categories, one of two languages, no numeric data.
FILTER = {"framework": ("GRI_305", "IFRS_S2"), "language": ("en", "de"), "contains_numeric_data": ("false",)}


def _allowed(spark, d):
    docs = inputs(spark, d).raw("documents")
    return materialize(docmeta.allowed(docmeta.bitmaps(docmeta.doc_meta(docs)), FILTER), "doc-allowed")


def q_filtered_documents(spark, d):
    """KB-02: the documents that pass the filter, by their bits."""
    return docmeta.passing(docmeta.doc_meta(inputs(spark, d).raw("documents")), _allowed(spark, d)).select("doc_id", "language", "category", "framework")


def q_bm25_filtered_chunks_top5(spark, d):
    """KB-02 / KB-04: keyword search over the chunks of documents that pass the filter."""
    index = _chunk_index(spark, d)
    return chunks.bm25_topk(chunks.search(_benchmark_queries(spark, d), index, 5, allowed=_allowed(spark, d)), index, 5)


def _benchmark_queries(spark, d):
    b = inputs(spark, d).raw("benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def _index(spark, d):
    return retrieval.index_of(inputs(spark, d).raw("documents"))


def q_bm25_top5(spark, d):
    return retrieval.bm25_topk(_benchmark_queries(spark, d), _index(spark, d), 5)


def _chunk_index(spark, d):
    return chunks.index_of(inputs(spark, d).raw("documents"))


def q_bm25_chunks_top5(spark, d):
    index = _chunk_index(spark, d)
    hits = chunks.bm25_topk(chunks.search(_benchmark_queries(spark, d), index, 5), index, 5)
    return chunks.with_text(hits, index).drop("chunk_text")


def q_bm25_chunk_blocks(spark, d):
    """KB-08: blocks that a search has read, of all blocks of its terms."""
    index = _chunk_index(spark, d)
    return chunks.blocks_read(chunks.search(_benchmark_queries(spark, d), index, 5), index)


def q_chunk_context(spark, d):
    index = _chunk_index(spark, d)
    hits = chunks.bm25_topk(chunks.search(_benchmark_queries(spark, d), index, 5), index, 5)
    return chunks.pack(hits, index, PACK_CAP_TOKENS)


def q_bm25_two_languages(spark, d):
    either = F.col("lang").isin("en", "de")   # KB-02: a filter of alternatives
    return retrieval.bm25_topk(_benchmark_queries(spark, d), _index(spark, d), 5, visible=either)


def q_hybrid_top5(spark, d):
    words = q_bm25_top5(spark, d)
    emb = inputs(spark, d).raw("embeddings")
    near = retrieval.vector_topk(retrieval.vectors_of_best(words, emb), emb, 5).withColumnRenamed("vec_id", "doc_id")
    return retrieval.fuse(words, near)


def _routes(spark, d):
    """A route for each benchmark text: its number gives section type and framework, every third is for any framework."""
    frameworks = list(audit.SECTION_ORDER)
    kinds = [k for k, _ in audit.SECTION_MARKS]
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    q = _benchmark_queries(spark, d)
    return q.select("query_id", pick(kinds, F.col("query_id")).alias("section_type"),
                    F.when(F.col("query_id") % 3 > 0, pick(frameworks, F.col("query_id"))).alias("framework"),
                    (F.col("query_id") % 5 + 1).cast("int").alias("cap"))


def q_routed_queries(spark, d):
    s = _parsed(spark, d).withColumn("framework", audit.framework_of("section_id"))
    return retrieval.route(_routes(spark, d), s)


def q_vector_top5(spark, d):
    emb = inputs(spark, d).raw("embeddings")
    return retrieval.vector_topk(retrieval.label_centroids(emb), emb, 5)


def q_vector_ids_top5(spark, d):
    emb = inputs(spark, d).raw("embeddings")
    return vectors.vector_topk(retrieval.sampled_vectors(emb), emb, 5)


def q_retrieval_with_fallback(spark, d):
    return retrieval.with_fallback(_benchmark_queries(spark, d), _index(spark, d), F.col("lang") == FALLBACK_LANG,
                                   retrieval.SCORE_THRESHOLD)


def q_peer_retrieval(spark, d):
    return retrieval.with_fallback(_benchmark_queries(spark, d), _index(spark, d), F.col("lang") == FALLBACK_LANG,
                                   retrieval.BENCHMARK_THRESHOLD)


def q_context_pack(spark, d):
    hits = q_bm25_top5(spark, d)
    return retrieval.pack(hits, inputs(spark, d).raw("documents"), PACK_CAP_TOKENS)


def q_retrieval_stats(spark, d):
    hits = q_retrieval_with_fallback(spark, d)
    packed = retrieval.pack(hits, inputs(spark, d).raw("documents"), PACK_CAP_TOKENS)
    return retrieval.retrieval_stats(hits, packed, retrieval.SCORE_THRESHOLD)


def q_section_json_recovery(spark, d):
    """VA-26: sections as a model may hand them over - plain, fenced, inside prose, cut off - and what is recovered."""
    s, j = _sections(spark, d), F.col("content_json")
    fence = F.concat(F.lit("Here it is:\n```json\n"), j, F.lit("\n```\nDone."))
    raw = (F.when(F.col("section_key") % 4 == 0, j).when(F.col("section_key") % 4 == 1, fence)
            .when(F.col("section_key") % 4 == 2, F.concat(F.lit("Result: "), j, F.lit(" (end)"))).otherwise(F.substring(j, 1, 40)))
    return s.select("section_key", audit.recover_json(raw).alias("json")).select(
        "section_key", F.col("json").isNotNull().alias("recovered"), F.get_json_object("json", "$.section_id").alias("section_id"))


def _conv_texts(spark, d):
    c = inputs(spark, d).raw("conversations")
    return c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
                    .alias("turn_key"), "text")


def _wide(spark, d):
    c = core(spark, d)
    return reports.metrics_by_year(c.summary(), c.s2, c.inp.hr, c.inp.loans)


def _long(spark, d):
    return reports.metrics_long(_wide(spark, d))


def q_playbook_actions(spark, d):
    long, inp = _long(spark, d), inputs(spark, d)
    return reports.playbook_actions(long, inp.playbook, reports.peer_gap(long, inp.peers))


def q_partition_presence(spark, d):
    inp = inputs(spark, d)
    present = (inp.energy.select(F.lit("energy_consumption").alias("table_name"), "reporting_year")
               .unionByName(inp.loans.select(F.lit("loan_portfolio").alias("table_name"), "reporting_year"))
               .unionByName(inp.hr.select(F.lit("hr_metrics").alias("table_name"), "reporting_year")))
    return zones.partition_presence(spark, present, ["energy_consumption", "loan_portfolio", "hr_metrics"],
                                    C.BASE_YEAR - 1, C.CURRENT_YEAR + 1)


def q_table_fingerprint(spark, d):
    inp = inputs(spark, d)
    return (zones.table_fingerprint(inp.energy, "energy_consumption")
            .unionByName(zones.table_fingerprint(inp.loans, "loan_portfolio"))
            .unionByName(zones.table_fingerprint(inp.hr, "hr_metrics")))


def q_bundle_digest(spark, d):
    """SRC-12: 16 hex digits over the bundle's flat rows, in their order."""
    from .catalog_ops import q_data_bundle_rows
    rows = q_data_bundle_rows(spark, d)
    text = zones.row_text(rows.select("part", "pos", "label", "amount", "change"))
    lines = F.sort_array(F.collect_list(F.struct("part", "pos", text.alias("text"))))   # a few top-k lists
    return rows.groupBy("reporting_year", "bank_id").agg(
        F.substring(F.sha2(F.array_join(F.transform(lines, lambda x: x["text"]), "\n"), 256), 1, 16).alias("digest"))


def queries() -> dict:
    return {
        # section audit over documents
        "audit_structure": lambda s, d: audit.section_structure(_parsed(s, d)),
        "audit_claims": lambda s, d: audit.extract_claims(_parsed(s, d), "section_key", "all_text"),
        "audit_claims_strict": lambda s, d: audit.extract_claims(_parsed(s, d), "section_key", "all_text", True),
        "audit_numeric": _with_metrics(_parsed, audit.numeric_findings),
        "audit_prohibited": lambda s, d: audit.prohibited_findings(_parsed(s, d)),
        "audit_outcome": _outcomes,
        "audit_included": lambda s, d: audit.included_summary(_outcomes(s, d)),
        "audit_unmatched": _with_metrics(_parsed, lambda p, m: audit.failure_detail(audit.numeric_findings(p, m))),
        "audit_unmatched_first10": _with_metrics(_parsed, lambda p, m: audit.failure_detail(audit.numeric_findings(p, m), 10)),
        "tolerance_semi": _claims(True),
        "tolerance_anti": _claims(False),
        "section_placeholders": _section_placeholders,
        "section_disclosures": _section_disclosures,
        "audit_footnotes": lambda s, d: audit.footnote_index(_sections(s, d)),
        "audit_footnote_places": lambda s, d: audit.footnote_places(_sections(s, d)),
        # text rules on whole documents and conversations
        "doc_numeric_claims": lambda s, d: audit.extract_claims(inputs(s, d).raw("documents"), "doc_id", "text"),
        "doc_prohibited_hits": lambda s, d: audit.prohibited_hits(inputs(s, d).raw("documents"), "doc_id", "text"),
        "conversation_prohibited_hits": lambda s, d: audit.prohibited_hits(_conv_texts(s, d), "turn_key", "text"),
        "conversation_json_recovery": lambda s, d: _conv_texts(s, d).select(
            "turn_key", audit.recover_json("text").isNotNull().alias("has_json")),
        "section_json_recovery": q_section_json_recovery,
        # retrieval
        "doc_chunks": lambda s, d: chunks.chunk(inputs(s, d).raw("documents")),
        "doc_windows": lambda s, d: retrieval.chunk(inputs(s, d).raw("documents")),
        "bm25_chunks_top5": q_bm25_chunks_top5,
        "bm25_chunk_blocks": q_bm25_chunk_blocks,
        "filtered_documents": q_filtered_documents,
        "bm25_filtered_chunks_top5": q_bm25_filtered_chunks_top5,
        "chunk_context": q_chunk_context,
        "chunk_context_text": lambda s, d: retrieval.context_text(q_chunk_context(s, d)),
        "bm25_top5": q_bm25_top5,
        "bm25_two_languages": q_bm25_two_languages,
        "hybrid_top5": q_hybrid_top5,
        "vector_top5": q_vector_top5,
        "vector_ids_top5": q_vector_ids_top5,
        "peer_retrieval": q_peer_retrieval,
        "routed_queries": q_routed_queries,
        "retrieval_with_fallback": q_retrieval_with_fallback,
        "context_pack": q_context_pack,
        "retrieval_stats": q_retrieval_stats,
        "context_text": lambda s, d: retrieval.context_text(q_context_pack(s, d)),
        # report tables
        "indicator_table": lambda s, d: reports.indicator_table(_wide(s, d), inputs(s, d).governance),
        "scorecard": lambda s, d: reports.scorecard(_wide(s, d), inputs(s, d).governance),
        "disclosure_flags": lambda s, d: reports.disclosure_flags(core(s, d).summary(), core(s, d).s1, core(s, d).s2),
        "playbook_actions": q_playbook_actions,
        "pcaf_improvement": lambda s, d: reports.pcaf_improvement(_wide(s, d)),
        "target_pathway": lambda s, d: reports.target_pathway(_wide(s, d)),
        "kpi_cards": lambda s, d: reports.kpi_cards(_long(s, d)),
        "portfolio_composition": lambda s, d: reports.portfolio_composition(inputs(s, d).loans),
        "portfolio_by_asset_class": lambda s, d: reports.portfolio_by_asset_class(inputs(s, d).loans),
        "what_if_gap": lambda s, d: reports.what_if_gap(inputs(s, d).loans),
        "score_what_if": lambda s, d: reports.score_what_if(inputs(s, d).loans),
        "score_concentration": lambda s, d: reports.score_concentration(inputs(s, d).loans),
        "imputation_note": lambda s, d: reports.imputation_note(core(s, d).s1),
        "peer_gap": lambda s, d: reports.peer_gap(_long(s, d), inputs(s, d).peers),
        "compliance_matrix": lambda s, d: reports.compliance_matrix(s, _outcomes(s, d)),
        "section_order": lambda s, d: audit.section_order(
            _parsed(s, d).withColumn("framework", audit.framework_of("section_id"))),
        "section_summary_context": lambda s, d: audit.summary_context(_parsed(s, d)),
        "audit_provenance": lambda s, d: audit.provenance_check(_parsed(s, d)),
        "audit_claim_mapping": _with_metrics(_parsed, audit.claim_metric_mapping),
        # sources
        "partition_presence": q_partition_presence,
        "data_freshness": lambda s, d: zones.freshness(inputs(s, d).raw("lineitem"), "lineitem").unionByName(
            zones.freshness(inputs(s, d).raw("orders"), "orders")),
        "object_listing": lambda s, d: zones.list_objects(s, d, exclude_prefixes=(), min_bytes=100),
        "bundle_digest": q_bundle_digest,
        "table_fingerprint": q_table_fingerprint,
        "synthetic_energy": lambda s, d: synth.synthesize_energy(inputs(s, d).raw("supplier")),
        "synthetic_loans": lambda s, d: synth.synthesize_loans(inputs(s, d).raw("customer")),
    }
