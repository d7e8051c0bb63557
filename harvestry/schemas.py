"""Table schemas and the column names operators use by default."""

from __future__ import annotations

from dataclasses import dataclass, field

ENTITIES = """
    id long, journal_id long, name string, issn string, eissn string,
    impact_factor decimal(10,4), impact_factor_realtime decimal(10,4),
    self_citation_rate string, jcr_partition string, cas_partition string, cas_warning string,
    citescore string, review_speed string, acceptance_rate string, category_id long,
    detail_crawled boolean, comments_crawled boolean, detail_data string,
    created_at timestamp_ntz, updated_at timestamp_ntz"""

CHILDREN = """
    id long, journal_id long, comment_id string, content string, author string, rating string,
    submit_experience string, comment_time timestamp_ntz, crawled_at timestamp_ntz"""

GROUPS = "id long, field_tag string, name string, total_count long"

LINKS = """
    category_id long, journal_id long, page_no long, position_no long, active boolean,
    first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"""

GROUP_STATES = """
    category_id long, field_tag string, remote_total_count long, local_index_count long,
    total_pages long, last_page_count long, estimated_new_count long, status string,
    last_checked_at timestamp_ntz, last_full_scanned_at timestamp_ntz"""

PROBLEMS = """
    id long, journal_id long, problem_type string, problem_code string, message string,
    expected_value long, actual_value long, resolved int, resolved_at timestamp_ntz,
    created_at timestamp_ntz, updated_at timestamp_ntz"""

WORK_ITEMS = """
    id long, task_type string, target_id string, target_url string, status string,
    retry_count long, max_retry long, error_message string, worker_id string,
    locked_at timestamp_ntz, created_at timestamp_ntz, started_at timestamp_ntz,
    completed_at timestamp_ntz, extra_data string"""

REPORTERS = """
    worker_id string, status string, current_task_count long, total_completed long,
    total_failed long, last_heartbeat timestamp_ntz"""

ENDPOINTS = """
    id long, ip string, port int, protocol string, username string, secret string,
    proxy_type string, source string, is_active boolean, is_valid boolean, success_count long,
    fail_count long, total_fail_count long, response_time double, last_used_at timestamp_ntz,
    created_at timestamp_ntz, remark string"""


@dataclass(frozen=True)
class EntityColumns:
    """Which column plays which part; rename to run the operators on another table."""

    id: str = "journal_id"
    name: str = "name"
    code: str = "issn"
    alt_code: str = "eissn"
    score: str = "impact_factor"
    score2: str = "impact_factor_realtime"
    group: str = "category_id"
    detail_done: str = "detail_crawled"
    children_done: str = "comments_crawled"
    doc: str = "detail_data"
    created: str = "created_at"
    updated: str = "updated_at"
    texts: tuple[str, ...] = field(default=(
        "jcr_partition", "cas_partition", "cas_warning", "citescore", "review_speed",
        "acceptance_rate", "self_citation_rate",
    ))
