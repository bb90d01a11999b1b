"""Schemas of the entities, and the enumerations (fixed values)."""

from __future__ import annotations

PAPERS = "paper_id string, title string, authors array<string>, published string, updated string, categories array<string>, primary_category string, url string, pdf_url string, abstract string, pdf_path string"
LINES = "paper_id string, page int, pos int, text string, size double, bold boolean, bbox array<double>"
PARSED = (
    "paper_id string, title string, source_pdf string, num_pages int, parser string, pages array<struct<page_number:int,text:string>>, "
    "sections array<struct<title:string,level:int,page_start:int,page_end:int,text:string>>, "
    "tables array<struct<table_id:string,page:int,caption:string,bbox:array<double>,html:string,rows:array<array<string>>>>, "
    "diagnostics struct<body_font_size:double,num_headings_detected:int,heading_density_per_page:double,mentioned_table_count:int,captured_table_count:int,"
    "rejected_table_candidates:array<struct<page:int,bbox:array<double>,reason:string>>,tables_garbled:boolean,headings_garbled:boolean,needs_fallback_parser:boolean>"
)
CHUNKS = "chunk_id string, paper_id string, title string, section_title string, chunk_type string, page_start int, page_end int, token_count int, text string"
VECTORS = "chunk_id string, embedding array<float>"
TAGS = "paper_id string, signal_type array<string>, asset_class array<string>"
METRIC = "struct<metric_name:string,value:double,unit:string,context:string,evidence_quote:string,source_location:string>"
EXTRACTION = f"struct<signal_type:array<string>,asset_class:array<string>,methodology_summary:string,data_period:string,universe:string,performance_metrics:array<{METRIC}>,key_findings:array<string>,limitations:array<string>,extraction_confidence:string,extraction_notes:string>"
RECORDS = f"paper_id string, title string, extraction {EXTRACTION}, extraction_meta struct<model:string,extracted_at:string,input_tokens:bigint,validation_flags:array<string>,curation_signal_type:array<string>,curation_asset_class:array<string>,manually_corrected:boolean>"
EVAL_QUERIES = "query_id string, query string, relevant_paper_ids array<string>"
FAILURES = "paper_id string, error string, failed_at string"

SIGNAL_TYPES = (
    "momentum", "reversal", "value", "size", "quality_profitability", "low_volatility", "volatility_risk_premium", "carry",
    "liquidity", "seasonality", "event_driven", "sentiment_text", "alternative_data", "stat_arb_pairs", "ml_composite", "other",
)
ASSET_CLASSES = ("equities", "fixed_income", "fx", "commodities", "crypto", "futures_multi_asset", "options_volatility", "other")
UNITS = ("ratio", "percent", "bps", "stddev", "count", "currency", "other")
CONFIDENCES = ("high", "medium", "low")
MODES = ("structured", "retrieval", "hybrid")
OPERATORS = (">", ">=", "<", "<=", "none")
