"""Schemas of the tables that operators exchange, as DDL."""

REPORTS = "report_id string, apt_group string, source_vendor string, published_date date, file_path string, file_type string, raw_name string, extra_tags array<string>"
PARAGRAPHS = "report_id string, paragraph_index int, language string, text string, apt_group string, source_vendor string, published_date date, file_path string"
ENTITIES = "report_id string, paragraph_index int, label string, text string, start int, `end` int, label_rank int, ordinal int"
SKIPPED = "report_id string, file_path string, reason string"
NODES = "report_id string, node_idx int, label string, text string, text_key string, paragraph_index int, start int, `end` int"
EDGES = "report_id string, src int, dst int"
GROUPS = "id string, aliases string, origin string, targets string, description string, last_seen string, tools string, iocs array<string>, related_samples array<string>"
INDEX_CSV = "report_id string, apt_group string, source_vendor string, published_date string, file_path string, file_type string, raw_name string, extra_tags string"
RUN_RESULT = "accuracy double, f1_weighted double, f1_macro double"
