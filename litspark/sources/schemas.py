"""Explicit schemas of the file formats."""

SECTION = "struct<name: string, raw_name: string, content: string, section_type: string>"
PAPERS = (
    "paper_key string, pmid string, doi string, title string, abstract string, journal string, "
    f"year int, authors array<string>, sections array<{SECTION}>"
)
LEGACY_PAPERS = (
    "pmc_id string, pmid string, title string, abstract string, authors array<string>, "
    "journal string, year string, doi string, "
    "sections array<struct<section_name: string, content: string>>, num_sections int, "
    "topic string, collected_at string"
)
WITHDRAWAL = (
    "struct<drug: string, aliases: array<string>, indication: string, "
    "indication_keywords: array<string>, jurisdiction: string, status: string, date: string, "
    "warning: string, warning_fr: string, source: string, raw_description: string>"
)
BIOMARKER = (
    "struct<drug: string, drug_patterns: array<string>, required_biomarker: string, "
    "biomarker_keywords: array<string>, indication_keywords: array<string>, warning: string, "
    "warning_fr: string, jurisdiction: string>"
)
GOLDEN_ITEM = (
    "struct<id: string, query: string, question: string, cancer_type: string, topic: string, "
    "difficulty: string, question_type: string, expected_study_designs: array<string>, "
    "must_contain_terms: array<string>, must_not_hallucinate: boolean, ground_truth: string, "
    "expected_sources: array<string>, notes: string>"
)
ENFORCEMENT = (
    "drug string, product_description string, reason_for_recall string, "
    "voluntary_mandated string, status string, recall_initiation_date string"
)
EAV_EMBEDDINGS = "id bigint, embedding_id string"
EAV_METADATA = "id bigint, key string, string_value string, int_value bigint, float_value double"
INGEST_STATE = "paper_key string, topic string, committed_at timestamp"
