"""Schemas of the tables and reports, as DDL."""

from __future__ import annotations


def struct(text: str) -> str:
    """DDL, checked where it is used: Spark parses it only with a session."""
    return " ".join(text.split())


RESPONSES = struct(
    "target_url STRING, url STRING, depth INT, mode STRING, seq BIGINT, status INT, "
    "content_type STRING, content_encoding STRING, body BINARY"
)
FRONTIER = struct("url STRING, depth INT, source_url STRING")
JS_FILES = struct(
    "id STRING, url STRING, file_path STRING, hash STRING, size BIGINT, extension STRING, content_type STRING, "
    "source_url STRING, crawl_mode STRING, depth INT, is_obfuscated BOOLEAN, is_deobfuscated BOOLEAN, is_duplicate BOOLEAN, "
    "downloaded_at TIMESTAMP, processed_at TIMESTAMP, map_file_url STRING, has_map_file BOOLEAN"
)
MAP_FILES = struct(
    "id STRING, url STRING, file_path STRING, hash STRING, size BIGINT, extension STRING, js_file_url STRING, "
    "js_file_id STRING, downloaded_at TIMESTAMP"
)
STATS = (
    "total_files: BIGINT, static_files: BIGINT, dynamic_files: BIGINT, map_files: BIGINT, failed_files: BIGINT, "
    "deobfuscated_files: BIGINT, visited_urls: BIGINT, fake_http_errors: BIGINT, browser_restarts: BIGINT, "
    "total_size: BIGINT, duration: DOUBLE"
)
CONFIG = (
    "depth: INT, wait_time: INT, max_workers: INT, playwright_tabs: INT, headless: BOOLEAN, resume: BOOLEAN, "
    "similarity_enabled: BOOLEAN, similarity_threshold: DOUBLE, similarity_workers: INT, allow_cross_domain: BOOLEAN"
)
TASK = struct(
    f"id STRING, target_url STRING, domain STRING, created_at TIMESTAMP, started_at TIMESTAMP, completed_at TIMESTAMP, "
    f"config STRUCT<{CONFIG}>, status STRING, mode STRING, stats STRUCT<{STATS}>, error_message STRING"
)
BATCH_TASK = struct("id STRING, url_file STRING, total_urls INT, completed INT, failed INT, sub_tasks ARRAY<STRING>")
BATCH_RESULT = struct(
    f"url STRING, success BOOLEAN, error STRING, stats STRUCT<{STATS}>, processed_at TIMESTAMP, duration DOUBLE"
)
FILE_INFO = "url: STRING, file_path: STRING, size: BIGINT, hash: STRING, crawl_mode: STRING, downloaded_at: TIMESTAMP"
FAILED_INFO = "url: STRING, error_type: STRING, error_msg: STRING, retries: INT"
REPORT = struct(
    f"task_id STRING, target_url STRING, domain STRING, mode STRING, start_time TIMESTAMP, end_time TIMESTAMP, duration DOUBLE, "
    f"stats STRUCT<{STATS}>, success_files ARRAY<STRUCT<{FILE_INFO}>>, failed_files ARRAY<STRUCT<{FAILED_INFO}>>, "
    f"output_dir STRING, encode_dir STRING, decode_dir STRING, config STRUCT<{CONFIG}>"
)
SIMILARITY_GROUP = struct(
    "group_id STRING, represent_file STRING, members ARRAY<STRUCT<file_url: STRING, file_path: STRING, file_size: BIGINT, "
    "similarity: DOUBLE>>, member_count INT, avg_similarity DOUBLE, min_similarity DOUBLE, max_similarity DOUBLE, "
    "duplicate_files ARRAY<STRING>, total_saved_size BIGINT"
)
SIMILARITY_MATRIX = struct("files ARRAY<STRING>, matrix ARRAY<ARRAY<DOUBLE>>")
CHECKPOINT = struct(
    f"task_id STRING, target_url STRING, visited_urls ARRAY<STRING>, downloaded_files ARRAY<STRING>, failed_urls ARRAY<STRING>, "
    f"pending_urls ARRAY<STRING>, current_depth INT, stats STRUCT<{STATS}>, created_at TIMESTAMP, updated_at TIMESTAMP, "
    f"config STRUCT<{CONFIG}>"
)
