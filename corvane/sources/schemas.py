"""Explicit schemas and value domains."""

from __future__ import annotations

PAPER = "bibcode string, title string, year int, authors array<string>, abstract string"
RAW_PAPER = "bibcode string, title array<string>, year string, author array<string>, abstract string, citation_count long"
CHUNK = "chunk_id string, bibcode string, section string, content string, token_count long, chunk_index int"
GOLD = (
    "example_id string, task_family string, partition string, query string, "
    "retrieved_context array<struct<bibcode:string,chunk_id:string,retrieval_score:double>>, answer string, "
    "claims array<struct<text:string,cited_bibcode:string,support_span:string,supported:boolean>>, "
    "abstention_reason string, is_negative boolean, negative_type string, provenance map<string,string>"
)
CHAT = (
    "messages array<struct<role:string,content:string,tool_calls:array<struct<name:string,arguments:string>>>>, "
    "metadata struct<source:string,topic:string,difficulty:string,requires_tools:boolean,tools_used:array<string>>"
)
EVAL_RESULTS = "model string, benchmark string, score decimal(6,3), details string, run_at timestamp"

#: Domains of the record fields.
TASK_FAMILIES = ("lit_qa", "summarization", "abstention")
PARTITIONS = ("calibration", "eval")
ABSTENTION_REASONS = ("thin", "contradictory", "off_topic", "absent")
NEGATIVE_TYPES = ("claim_not_supported", "contradicts", "wrong_paper", "overgeneralization")
CHAT_ROLES = ("system", "user", "assistant", "tool")
ARMS = ("dense", "lexical", "hybrid")
#: Composition targets as (group, least, most); null is open.
TARGETS = (
    ("calibration/positive", 40, None),
    ("calibration/negative", 40, 60),
    ("eval/lit_qa", 40, None),
    ("eval/summarization", 30, None),
    ("eval/abstention", 25, None),
    ("total", 170, 230),
)
