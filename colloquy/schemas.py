"""Schemas of the stored tables and of the structures inside them, as DDL texts."""

from __future__ import annotations


def _struct(**kinds: str) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in kinds.items())


DEDUCTIVE_CODE = "struct<code:string,evidence_quote:string,confidence:string>"
EMERGENT_CANDIDATE = "struct<label:string,definition:string,partial_overlap_with:string,distinct_dimension:string,evidence_quote:string,confidence:string>"
POST_META = "struct<corpus_layer:string,source:string,addendum:string,subreddit_id:string,tertile:int,upvote_ratio:double,nsfw:boolean,locked:boolean,flair_text:string,gilded:boolean,parent_id:string>"

POSTS_CSV = _struct(**dict.fromkeys("id subreddit_id subreddit_name title body score upvote_ratio flair_text post_date corpus_layer tertile nsfw locked permalink".split(), "string"))
COMMENTS_CSV = _struct(**dict.fromkeys("comment_id post_id parent_id subreddit_id body score gilded permalink comment_date corpus_layer".split(), "string"))

#: A sample file: one row for each item, all its fields flat.
SAMPLE_CSV = _struct(
    SYNTHETIC="string", id="string", type="string", subreddit="string", title="string", text="string", author="string", score="int", num_comments="int", created_utc="double",
    created_date_iso="string", url="string", permalink="string", data_source="string", content_type="string", language_flag="string", word_count="int", ppm_hint="string", collected_at="string",
)

COLLECTED = _struct(
    reddit_id="string", type="string", subreddit="string", title="string", text="string", author="string", url="string", permalink="string", post_id="string",
    session_id="string", data_source="string", score="int", num_comments="int", created_utc="double", collected_at="timestamp", extra_metadata="string",
)
CODED = _struct(
    reddit_id="string", ppm_category="string", confidence="string", coded_by="string", coding_approach="string", session_id="string", rationale="string",
    raw_prompt="string", raw_response="string", ppm_subcodes="array<string>", themes=f"array<{EMERGENT_CANDIDATE}>", evidence_quotes="array<string>",
    coded_at="timestamp", extra_metadata="string", ppm_subcodes_clean="array<string>", evidence_quotes_clean="array<string>", quarantine_reason="string",
)
CODEBOOK = _struct(category="string", name="string", definition="string", examples="string", session_id="string", frequency="int", added_at="timestamp", extra_metadata="string")
RUNS = _struct(job_id="string", status="string", config_hash="string", error_message="string", session_id="string", items_collected="int", started_at="timestamp", completed_at="timestamp", parameters="string", extra_metadata="string")
AUDIT = _struct(timestamp="timestamp", action="string", session_id="string", user_info="string", details="string", extra_metadata="string")
REPLICABILITY = _struct(collection_hash="string", timestamp="timestamp", session_id="string", parameters="string", statistics="string", rate_limit_events="string", validation_results="string", notes="string")
REFERENCES = _struct(zotero_key="string", item_type="string", title="string", year="string", abstract="string", doi="string", url="string", citation_apa="string", authors="array<string>", tags="array<string>", collections="array<string>", keywords="array<string>", synced_at="timestamp")
LINKS = _struct(collection_hash="string", zotero_key="string", link_type="string", relevance_score="double", matched_keywords="array<string>", linked_at="timestamp", notes="string")
CANDIDATES = _struct(category="string", name="string", definition="string", evidence="string", reddit_id="string", status="string", created_at="timestamp", session_id="string")

CODED_POSTS_COLUMNS = (
    "post_id", "subreddit_name", "corpus_layer", "tertile", "body_length", "deductive_codes", "overall_confidence", "ppm_category", "circuit_breaker_flags",
    "override_notes", "model", "session_id", "coded_at", "post_score", "post_created_utc", "permalink", "data_source", "machine_partition", "quarantine_reason",
    "ppm_subcodes", "evidence_quotes_flat", "rationale",
)
CODED_POSTS = _struct(**(dict.fromkeys(CODED_POSTS_COLUMNS, "string") | {"tertile": "int", "body_length": "int", "post_score": "int", "post_created_utc": "double"}))
EMERGENT_COLUMNS = ("label", "definition", "partial_overlap_with", "distinct_dimension", "evidence_quote", "confidence", "subreddit_name", "corpus_layer", "source_post_id", "session_id")
EMERGENT = _struct(**dict.fromkeys(EMERGENT_COLUMNS, "string"))
