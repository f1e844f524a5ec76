"""Schemas of the conversation store. A summary's edge names its derived and its source node, never parent or child."""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "conversations": "conversation_id long, session_id string, session_key string, active boolean, archived_at timestamp, archive_cause string, title string, bootstrapped_at timestamp, created_at timestamp, updated_at timestamp",
    "messages": "message_id long, conversation_id long, seq long, role string, content string, token_count long, identity_hash string, transcript_entry_id string, stable_event_key string, large_content string, created_at timestamp",
    "message_parts": "part_id string, message_id long, part_type string, ordinal long, text_content string, tool_call_id string, tool_name string, tool_input string, tool_output string, metadata string",
    "summaries": "summary_id string, conversation_id long, kind string, depth long, content string, token_count long, earliest_at timestamp, latest_at timestamp, descendant_count long, descendant_token_count long, source_message_token_count long, file_ids array<string>, model string, created_at timestamp",
    "summary_messages": "summary_id string, message_id long, ordinal long",
    "summary_edges": "derived_id string, source_id string, ordinal long",
    "context_items": "conversation_id long, ordinal long, item_type string, message_id long, summary_id string",
    "large_files": "file_id string, conversation_id long, file_name string, mime_type string, byte_size long, line_count long, storage_uri string, exploration_summary string, created_at timestamp",
    "bootstrap_state": "conversation_id long, path string, size long, modified_at timestamp, byte_offset long, last_entry_id string, last_entry_hash string, header_id string, soft_reset_pruned_at timestamp",
    "telemetry": "conversation_id long, cache_state string, consecutive_cold_observations long, turns_since_leaf_compaction long, tokens_accumulated_since_leaf_compaction long, updated_at timestamp",
    "maintenance": "conversation_id long, pending boolean, running boolean, reason string, requested_at timestamp, retry_attempts long, next_attempt_after timestamp, resolution_reason string, maintenance_revision long",
    "focus_briefs": "brief_id string, conversation_id long, status string, content string, token_count long, covered_latest_at timestamp, covered_message_seq long, source_context_hash string, created_at timestamp",
    "focus_brief_sources": "brief_id string, summary_id string, role string, ordinal long",
}
