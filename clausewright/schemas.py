"""Declared schemas (Spark DDL) of every table; nothing is inferred on read."""

_COMMITMENT = "struct<obligation: string, quantity: string, method: string, standard: string, missing_info: array<string>>"
_CITATION = "struct<code: string, version: string, section: string, raw_text: string, resolved: boolean, resolved_chunk_id: string, rejection_reason: string>"
_SEVERITY = "struct<commercial_exposure: int, dispute_likelihood: int, reviewer_cost: int, rationale: string>"
_BBOX = "struct<x0: double, y0: double, x1: double, y1: double>"

DOCUMENT = "filename string, role string, sequence int, page_count int, file_size_bytes bigint, sha256 string, issuance_date date, notes string"
TABLES = {
    "manifest": f"tender_id string, project_title string, issuing_authority string, issue_date date, award_date date, source_url string, retrieved_at timestamp, schema_version string, documents array<struct<{', '.join(': '.join(f.split(' ')) for f in DOCUMENT.split(', '))}>>",
    "pages": "doc_id string, tender_id string, page_number int, text string, char_count int, block_count int, width_points double, height_points double, has_text_layer boolean, ocr_was_used boolean",
    "clauses": f"clause_id string, doc_id string, tender_id string, page int, page_end int, bbox {_BBOX}, section_path array<string>, clause_number string, text string, char_count int, word_count int, table_origin boolean, ocr_was_used boolean, notes string",
    "definitions": "canonical_form string, definition_text string, defined_in_clause string, doc_id string, tender_id string, extraction_method string, aliases array<string>, confidence double, notes string",
    "quantities": "quantity_id string, clause_id string, doc_id string, tender_id string, raw_text string, surrounding_text string, kind string, value double, unit string, value_norm double, unit_norm string, referent string, referent_confidence double, referent_method string, page int, notes string",
    "references": "from_clause string, target_kind string, target_label string, target_id string, raw_text string, confidence double, resolved boolean, notes string",
    "candidate_flags": f"flag_id string, clause_id string, doc_id string, tender_id string, page int, clause_text string, section_path array<string>, clause_number string, bct_output struct<commitments: array<{_COMMITMENT}>>, flagged boolean, flag_reason string, is_obligation boolean, skipped_reason string, cost_inr double, seconds_elapsed double",
    "verdicts": "flag_id string, clause_id string, verdict string, resolving_clause_id string, rationale string, confidence double, retrieved_chunk_ids array<string>, retrieved_sources array<array<string>>, cost_inr double, seconds_elapsed double, error string",
    "confirmed": f"flag_id string, clause_id string, doc_id string, tender_id string, page int, clause_text string, section_path array<string>, clause_number string, stage2_verdict string, stage2_rationale string, resolving_clause_id string, critique_verdict string, critique_refutation string, severity {_SEVERITY}, composite_severity int, severity_tier string, cost_inr double, seconds_elapsed double, error string",
    "iscode_chunks": "chunk_id string, code_id string, code_title string, version_year int, section string, section_path array<string>, page int, text string, char_count int, source_file string, notes string",
    "rewrites": f"flag_id string, clause_id string, tender_id string, doc_id string, original_text string, rewrite_text string, is_code_citations array<{_CITATION}>, rewrite_explanation string, citation_integrity_passed boolean, citation_resolved_count int, citation_unresolved_count int, reflag_check_passed boolean, reflag_check_reason string, original_cd_count int, rewrite_cd_count int, intent_cosine double, intent_check_passed boolean, status string, rejection_reason string, attempts int, cost_inr double, seconds_elapsed double, error string",
    "lexicon_flags": "flag_id string, clause_id string, doc_id string, tender_id string, page int, clause_text string, section_path array<string>, clause_number string, flagged boolean, flag_reason string, marker_count int, marker_categories array<string>, matched_markers array<string>",
    "runs": "run_id string, stage string, stage_version string, started_at string, finished_at string, seconds_elapsed double, success boolean, cost_usd double, cost_inr double, api_calls int, cache_hit_rate double, manifest_path string",
}

COMMITMENTS = f"array<{_COMMITMENT}>"
