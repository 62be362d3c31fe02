"""What each query reads of session_events, besides id; nothing else is read, compared or moved."""

from __future__ import annotations

READS = {
    "a01_session_rollup": "session_id type category data bytes_avoided created_at",
    "a02_max_file_edits": "session_id type category data",
    "a03_latest_by_session": "session_id type project_dir",
    "f05_project_sessions": "session_id project_dir",
    "a07_bytes_summary": "session_id data bytes_avoided bytes_returned",
    "a24_time_to_commit": "session_id type data created_at",
    "j04_edit_test_cycles": "session_id type",
    "a25_rework": "session_id type data",
    "a31_commits_per_session": "session_id type data project_dir",
    "a34_retry_storms": "session_id type category",
    "a35_delegating_sessions": "session_id type",
    "a12_conversation_days": "session_id category created_at",
    "a12_span_seconds": "session_id created_at",
    "a20_tool_usage": "type",
    "f10_command_prefixes": "type data",
    "a34_error_tools": "category data",
    "a22_file_activity": "type data",
    "a39_hot_files": "type category data",
    "a23_work_modes": "type data created_at",
    "a23_rule_freshness": "type data created_at",
    "a33_category_counts": "type category data",
    "a10_category_previews": "session_id category data",
    "a36_rejections": "category data",
    "a34_latency_by_tool": "data",
    "a34_latency_p95": "data",
    "a08_lines_median": "data",
    "a08_json_tool_usage": "type data",
    "a27_project_activity": "session_id project_dir attribution_confidence",
    "a27_attribution_summary": "project_dir attribution_confidence",
    "a28_carried_project": "session_id project_dir",
    "a29_hourly": "created_at",
    "a30_weekly_errors": "type created_at",
    "a26_subagent_bursts": "session_id type created_at",
    "w05_file_bursts": "session_id type created_at",
    "a26_burst_summary": "session_id type created_at",
    "a26_global_bursts": "type created_at",
    "a18_overview": "",
    "a21_ratios": "type",
    "a34_error_resolution": "type category",
    "a35_delegation": "type",
    "a36_governance": "type",
    "a37_git_mix": "category data",
    "a38_context_health": "type category data",
    "a39_file_churn": "type category data",
    "a40_scores": "session_id type category data created_at",
    "a09_savings": "type bytes_avoided bytes_returned",
    "a05_ledger": "session_id bytes_avoided bytes_returned",
    "a15_real_usage": "session_id data project_dir source_hook created_at",
    "a14_kept_out": "session_id bytes_avoided bytes_returned",
    "e02_working_directory": "data",
    "e04_git": "data",
    "e05_environment": "data",
    "e16_error_class": "data",
    "e17_command_class": "data",
    "e17_duration_buckets": "data",
    "f06_priority_events": "session_id type priority data",
    "f07_event_search": "category data project_dir",
    "f12_project_names": "session_id project_dir",
    "w07_last_per_category": "session_id category",
    "l08_orphans": "session_id",
    "l09_shard_keys": "project_dir",
    "l01_session_view": "session_id created_at",
    "c05_chunk_json": "data",
    "st1_stored_events": "session_id type data_hash",
    "st2_evicted_events": "session_id priority",
    "st4_flood_verdicts": "session_id created_at",
    "st5_resolved_errors": "session_id type category data",
    "st6_retry_loops": "session_id type data_hash",
    "st7_carried_projects": "session_id project_dir attribution_confidence",
}
