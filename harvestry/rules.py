"""Fixed values the operators need, kept as plain data."""

from __future__ import annotations

# --- fixed values: page and document markers -------------------------------------------
LOGIN_MARKERS = ("注册 或 登录 后", "注册或登录后", "登录 后，查看")
RATE_LIMIT_MARKER = "您请求页面的速度过快"
OVERLAY_MARKER = "force_download_install"
HTTP_FAILURE_MARKER = "HTTP 请求失败"

# --- fixed values: record audit --------------------------------------------------------
MIN_FIELDS = 30
WARN_FIELDS = 45
IDENTITY_FIELDS = {"issn": ("issn", "期刊ISSN")}
IMPORTANT_FIELDS = {
    "impact_factor": ("impact_factor", "最新影响因子"),
    "jcr_partition": ("jcr_partition", "JCR分区"),
    "cas_partition": (
        "cas_partition",
        "中国科学院期刊分区",
        "期刊分区表_（_2025年3月升级版_）",
        "《新锐期刊分区表》_（_2026年3月发布_）",
    ),
    "citescore": ("citescore", "CiteScore"),
}

DETAIL_EMPTY = "detail_empty"
DETAIL_NOT_OBJECT = "detail_not_object"
DETAIL_LOGIN_PLACEHOLDER = "detail_login_placeholder"
DETAIL_LOW_FIELD_COUNT = "detail_low_field_count"
DETAIL_MISSING_IDENTITY = "detail_missing_identity"
DETAIL_WARN_FIELD_COUNT = "detail_warn_field_count"
DETAIL_MISSING_IMPORTANT = "detail_missing_important"
DETAIL_CODES = (
    DETAIL_EMPTY,
    DETAIL_NOT_OBJECT,
    DETAIL_LOGIN_PLACEHOLDER,
    DETAIL_LOW_FIELD_COUNT,
    DETAIL_MISSING_IDENTITY,
    DETAIL_WARN_FIELD_COUNT,
    DETAIL_MISSING_IMPORTANT,
)
# the codes that send an open problem to id re-resolution
RERESOLVE_CODES = (
    DETAIL_MISSING_IDENTITY,
    DETAIL_LOW_FIELD_COUNT,
    DETAIL_EMPTY,
    DETAIL_NOT_OBJECT,
    DETAIL_LOGIN_PLACEHOLDER,
)
QUALITY_FAILED_TEXT = "详情质量检查未通过"
VALIDATION_FAILED_TEXT = "数据校验失败"
QUALITY_ERROR_MARKERS = (QUALITY_FAILED_TEXT, *RERESOLVE_CODES)
QUALITY_ITEM_MARKERS = (*QUALITY_ERROR_MARKERS, VALIDATION_FAILED_TEXT)

COMMENT_MISMATCH = "comment_mismatch"

# --- fixed values: minimum extraction check --------------------------------------------
MIN_EXTRACTED_FIELDS = 5
CORE_FIELDS = ("期刊名字", "issn", "期刊ISSN")
EXPECTED_FIELDS = (
    "issn", "期刊ISSN", "impact_factor", "最新影响因子", "jcr_partition", "JCR分区", "cas_partition",
)

# --- fixed values: metric record --------------------------------------------------------
METRIC_FIELDS = (
    "issn", "eissn", "impact_factor", "impact_factor_realtime", "self_citation_rate",
    "jcr_partition", "cas_partition", "cas_warning", "citescore", "review_speed",
    "acceptance_rate", "comment_count", "comment_pages", "crawled_comment_count",
)

METRIC_COUNTERS = ("comment_count", "comment_pages", "crawled_comment_count")

# --- fixed values: label rules, tried in order, first match per label ---------------------
# "compat" keeps the order in which a plain ISSN rule also catches E-ISSN labels;
# "fixed" puts the specific rules first.
_TAIL_RULES = (
    ("5年影响因子|五年影响因子|五年IF", "impact_factor_5year"),
    ("自引率", "self_citation_rate"),
    ("JCR分区|JCR_分区", "jcr_partition"),
    ("中国科学院期刊分区.*2025年3月最新升级版.*|CAS分区", "cas_partition"),
    ("CAS警告|国际期刊预警名单|预警", "cas_warning"),
    ("审稿速度|平均审稿速度", "review_speed"),
    ("录用比例|接受率", "acceptance_rate"),
    ("出版商|Publisher", "publisher"),
    ("国家|地区|Country", "country"),
    ("出版周期|Frequency", "frequency"),
    ("CiteScore", "citescore"),
    ("创刊年份|创刊时间", "founded_year"),
    ("官方网站|期刊网站", "website"),
    ("投稿网址", "submission_url"),
    ("开放获取|OA|Open_Access", "open_access"),
)
LABEL_RULES_COMPAT = (
    ("期刊ISSN|ISSN", "issn"),
    ("E-ISSN|EISSN|电子ISSN", "eissn"),
    ("最新影响因子|最新IF", "impact_factor"),
    ("实时影响因子|即时影响因子", "impact_factor_realtime"),
    *_TAIL_RULES,
)
LABEL_RULES_FIXED = (
    ("E-ISSN|EISSN|电子ISSN", "eissn"),
    ("期刊ISSN|ISSN", "issn"),
    ("最新影响因子|最新IF", "impact_factor"),
    ("实时影响因子|即时影响因子", "impact_factor_realtime"),
    *_TAIL_RULES,
)
DECIMAL_TARGETS = ("impact_factor", "impact_factor_realtime")

# --- fixed values: numeric cleaning -------------------------------------------------------
NULL_NUMBERS = ("-", "N/A", "n/a", "", "--", "无", "暂无")

# --- fixed values: main table of a detail page --------------------------------------------
DETAIL_SCOPE_ID = "yxyz_content"
DETAIL_REQUIRED = ("期刊名字", "期刊ISSN")
DETAIL_OPTIONAL = (
    "基本信息", "出版商", "出版国家", "出版周期", "平均审稿速度", "最新IF", "影响因子", "JCR",
    "期刊官方网站",
)

# --- fixed values: links and texts of entry and listing pages -----------------------------
GROUP_LINK = r"fieldtag=(\d+)"
ENTITY_LINK = r"journalid=(\d+)"
PAGE_LINK = r"currentpage=(\d+)"
PAGES_STATED = r"(?U)共\s*(\d+)\s*页"

# entity pattern -> replacement, the ampersand last
ENTITIES = (
    (r"&(?:nbsp|#160|#[xX]0*[aA]0);", "\u00a0"), (r"&(?:#12288|#[xX]3000);", "\u3000"), (r"&(?:lt|#60);", "<"), (r"&(?:gt|#62);", ">"),
    (r"&(?:quot|#34);", '"'), (r"&(?:apos|#39|#[xX]27);", "'"), (r"&(?:amp|#38);", "&"),
)

# --- fixed values: entity columns overwritten from a document, even by a missing field ----------
OVERWRITTEN = {
    "eissn": "E-ISSN", "self_citation_rate": "self_citation_rate", "jcr_partition": "jcr_partition",
    "cas_partition": "cas_partition", "cas_warning": "cas_warning", "citescore": "citescore",
    "review_speed": "review_speed", "acceptance_rate": "acceptance_rate",
}

# --- fixed values: child fragments ----------------------------------------------------------
ANONYMOUS = "匿名"
NO_RATING = "暂无评分"
RATING_LABEL = "期刊评分"
AUTHOR_TITLE = "去查看Ta的个人主页"
FIELD_LABEL = "研究方向"
RESULT_LABEL = "投稿结果"
PERIOD_LABEL = "投稿周期"
PUBLISHED_LABEL = "发表时间"
UPDATED_LABEL = "最后更新"
EXPERIENCE_PREFIX = "投稿经验："
REPLIES_MARK = "其他用户回复："
EXPERIENCE_CLASS = "layui-elem-quote"

# --- fixed values: summaries -----------------------------------------------------------------
JCR_DOC_KEYS = ("jcr_partition", "WOS期刊JCR分区_（_2024-2025年最新版_）")
CAS_DOC_KEYS = (
    "cas_partition",
    "期刊分区表_（_2025年3月升级版_）",
    "《新锐期刊分区表》_（_2026年3月发布_）",
    "期刊分区表_（_2023年12月旧的升级版_）",
)
CITESCORE_DOC_KEYS = ("citescore", "CiteScore_（_2025年最新版_）")
JCR_ROW_KEYS = ("JIF分区", "JIF排名", "按JIF指标学科分区")
CITESCORE_RANKS = "CiteScore排名"
CITESCORE_RANK_KEYS = ("分区", "学科", "排名")
PARTITION_ROW_KEYS = (("大类学科",), ("分区", "大类", "小类"), ("小类学科",), ("排名",), ("学科",))

# --- fixed values: work items, problems, failures ----------------------------------------------
TASK_TYPES = ("category", "list", "detail", "comment")
TASK_STATUSES = ("pending", "running", "completed", "failed")
PROBLEM_TYPES = ("warning", "error")

# code, action, retryable, counts against the endpoint and credential used
ERROR_POLICIES = (
    ("proxy_unavailable", "release", False, False),
    ("detail_quality_failed", "resolve_detail_id", False, False),
    ("data_validation_failed", "fail_retry", True, False),
    ("comment_mismatch", "fail_retry", True, False),
    ("http_request_failed", "fail_retry", True, True),
    ("parse_error", "fail_retry", True, False),
    ("unknown_error", "fail_retry", True, True),
)

# state of the latest work item -> action, per planning policy
PLAN_POLICIES = {
    "list": {"none": "create", "pending": "keep", "running": "keep", "failed": "reset",
             "completed": "omit", "completed_refresh": "reset"},
    "detail": {"none": "create", "pending": "keep", "running": "keep", "failed": "reset",
               "completed": "reset", "completed_refresh": "reset"},
    "children": {"none": "create", "pending": "keep", "running": "keep", "failed": "reset",
                 "completed": "skip", "completed_refresh": "reset"},
    "detail_force": {"none": "create", "pending": "reset", "running": "keep", "failed": "reset",
                     "completed": "reset", "completed_refresh": "reset"},
    "group_scan": {"none": "create", "pending": "keep", "running": "keep", "failed": "create",
                   "completed": "create", "completed_refresh": "create"},
}

PAGE_SIZE = 10
KEPT_ERRORS = 10

# --- fixed values: problem messages ---------------------------------------------------------------
MISMATCH_MESSAGE = "评论集合不完整，保留旧评论数据: expected=%d, actual=%d, pages=%d"
AUDIT_MESSAGE = "详情质量检查: status=%s, field_count=%d, reasons=%s"
