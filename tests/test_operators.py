"""The small cases the operators must get right."""

import csv
import datetime as dt
import glob
import json

import pytest
from pyspark.sql import functions as F

from harvestry import rules
from harvestry.operators import children as C
from harvestry.operators import errors as E
from harvestry.operators import listing as L
from harvestry.operators import problems as P
from harvestry.operators import quality as Q
from harvestry.operators import resolve as V
from harvestry.operators import resources as R
from harvestry.operators import search as S
from harvestry.operators import stats
from harvestry.plans import refresh as PL
from harvestry.schemas import CHILDREN, ENDPOINTS, ENTITIES, GROUP_STATES, LINKS, PROBLEMS, REPORTERS, WORK_ITEMS
from harvestry.sources import sinks
from harvestry.sources.lines import read_endpoint_lines
from harvestry.sources.tables import page_files

T0 = dt.datetime(2024, 1, 1)


def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")


def frame(spark, schema, rows):
    """Rows given as dicts; missing columns are NULL."""
    typed = spark.createDataFrame([], schema).schema
    return spark.createDataFrame([tuple(r.get(c) for c in typed.names) for r in rows], typed)


@pytest.fixture(scope="module")
def entities(spark):
    from decimal import Decimal as D

    doc = json.dumps({"publisher": "Nature Press", "review_speed": "fast"})
    return frame(spark, ENTITIES, [
        dict(id=1, journal_id=11, name="Nature", issn="0001", eissn=None, impact_factor=D("28.2"), category_id=1,
             detail_crawled=True, comments_crawled=True, detail_data=doc, updated_at=T0),
        dict(id=2, journal_id=12, name="Cell 100%_x", issn="0002", eissn="9999", impact_factor=D("3.5"), category_id=1,
             detail_crawled=True, comments_crawled=False, detail_data='{"publisher": "Other"}', updated_at=None),
        dict(id=3, journal_id=13, name="Science", issn="0003", eissn=None, impact_factor=D("15.0"), category_id=1,
             detail_crawled=False, comments_crawled=False, detail_data=None, updated_at=T0),
        dict(id=4, journal_id=14, name="Blank", impact_factor=None, category_id=2, detail_crawled=False),
    ])


def ids(df, c="journal_id"):
    return [r[c] for r in df.collect()]


def test_search(spark, entities):
    kids = frame(spark, CHILDREN, [dict(journal_id=11, comment_id="a"), dict(journal_id=11, comment_id="b")])
    hit = S.with_child_counts(S.search_entities(entities, name=" nature "), kids, is_page=True).collect()
    assert [(r.journal_id, r.n_children) for r in hit] == [(11, 2)]
    assert ids(S.sort_entities(S.search_entities(entities, score_min=10, score_max=20), "impact_factor", "asc")) == [13]
    assert ids(S.search_entities(entities, doc_field="publisher", doc_value="nature")) == [11]
    assert sorted(ids(S.search_entities(entities, doc_field="publisher", doc_op="exists"))) == [11, 12]
    assert ids(S.search_entities(entities, doc_field="publisher", doc_value="Other", doc_op="equals")) == [12]
    with pytest.raises(ValueError):
        S.search_entities(entities, score_min=20, score_max=10)
    assert ids(S.search_entities(entities, name="natrue", typo_fuzzy=True, threshold=0.25)) == [11]
    assert ids(S.search_entities(entities, name="100%_X")) == [12]
    assert ids(S.search_entities(entities, name="_")) == [12]
    assert sorted(ids(S.search_entities(entities, q="13"))) == [13]
    assert ids(S.search_entities(entities, doc_text="FAST")) == [11]
    assert ids(S.sort_entities(entities, "nonsense", "desc")) == [11, 13, 12, 14]
    assert ids(S.sort_entities(entities, "impact_factor", "asc")) == [12, 13, 11, 14]
    assert ids(S.page(S.sort_entities(entities, "journal_id", "asc"), 2, 3)) == [14]
    assert ids(S.simple_search(entities, "9999")) == []
    assert ids(S.simple_search(entities, "%")) == [12]
    assert ids(PL.oldest_first(entities, 2)) == [12, 14]


def test_quality(spark):
    filler = {f"f{i}": "v" for i in range(50)}
    full = {**filler, "ISSN": "1", "impact_factor": 1, "JCR分区": 1, "cas_partition": 1, "CiteScore": 1}
    docs = {
        1: json.dumps(full, ensure_ascii=False), 2: None, 3: "{}", 4: "[1]",
        5: json.dumps({**full, "x": {"y": ["请注册或登录后查看"]}}, ensure_ascii=False),
        6: json.dumps({k: v for k, v in full.items() if k != "CiteScore"}, ensure_ascii=False),
        7: '{"a": 1}', 8: json.dumps(dict(list(full.items())[-35:]), ensure_ascii=False), 9: '"text"',
    }
    df = spark.createDataFrame(list(docs.items()), "journal_id long, detail_data string")
    rows = {r.journal_id: r for r in Q.audit(df).collect()}
    assert rows[1].status == "ok" and rows[1].field_count == 55
    assert [rows[i].hard_reasons for i in (2, 3, 4, 9)] == [["detail_empty"], ["detail_empty"], ["detail_not_object"], ["detail_not_object"]]
    assert rows[2].missing_required == ["detail_data"]
    assert rows[5].hard_reasons == ["detail_login_placeholder"]
    assert rows[6].status == "warning" and rows[6].missing_important == ["citescore"]
    assert rows[7].hard_reasons == ["detail_low_field_count", "detail_missing_identity"]
    assert rows[7].warnings == ["detail_missing_important"] and rows[7].missing_required == ["issn"]
    assert rows[8].reason_codes == ["detail_warn_field_count"]
    problems, resolves = Q.audit_to_problems(Q.audit(df))
    found = {r.journal_id: (r.problem_code, r.problem_type, r.expected_value, r.actual_value) for r in problems.collect()}
    assert found[7] == ("detail_low_field_count", "error", 30, 1)
    assert found[6] == ("detail_missing_important", "warning", None, 54)
    assert {r.problem_code for r in resolves.collect()} == set(rules.DETAIL_CODES)


def test_extraction_check(spark):
    df = spark.createDataFrame([({},), ({"a": "1", "ISSN": "2", "b": "", "c": ""},), ({k: "" for k in "abcde"},), (None,)], "fields map<string,string>")
    got = [(r.n_fields, r.accepted, r.warns) for r in Q.validate_extracted(df).collect()]
    assert got == [(0, False, False), (4, False, False), (5, True, True), (0, False, False)]


def test_replace_if_complete(spark):
    old = spark.createDataFrame([(1, "o1", "old"), (2, "o2", "old"), (3, "o3", "old"), (4, "o4", "old")], "journal_id long, comment_id string, content string")
    incoming = spark.createDataFrame(
        [(1, "a", "first", 1), (1, "a", "again", 2), (1, "b", "x", 3), (1, None, "x", 4), (1, "", "x", 5), (2, "c", "x", 1)],
        "journal_id long, comment_id string, content string, position_no long")
    expected = spark.createDataFrame([(1, "2", "1"), (2, "3", "1"), (3, "0", None)], "journal_id long, total_count string, total_pages string")
    got = C.replace_if_complete(old, incoming, expected)
    assert sorted(tuple(r) for r in got.children.collect()) == [
        (1, "a", "first"), (1, "b", "x"), (2, "o2", "old"), (4, "o4", "old")]
    assert {r.journal_id: (r.crawled_count, r.complete) for r in got.report.collect()} == {1: (2, True), 2: (1, False), 3: (0, True)}
    problem = got.problems.collect()
    assert [(p.journal_id, p.problem_code, p.expected_value, p.actual_value) for p in problem] == [(2, "comment_mismatch", 3, 1)]
    assert sorted(ids(got.resolves)) == [1, 3]
    kept = C.replace_if_complete(old, incoming, expected, protect_empty=True)
    assert (3, "o3", "old") in {tuple(r) for r in kept.children.collect()}
    entity = spark.createDataFrame([(2, '{"a": 1}', True)], "journal_id long, detail_data string, comments_crawled boolean")
    row = C.update_child_counters(entity, got.report).first()
    assert json.loads(row.detail_data) == {"a": 1, "comment_count": 3, "comment_pages": 1, "crawled_comment_count": 1}
    assert row.comments_crawled is False


def test_index(spark):
    empty = spark.createDataFrame([], LINKS)
    items = spark.createDataFrame([(1, 1, 1, 5, "A"), (1, 1, 2, 6, None), (1, 1, 3, 5, "dup")],
                                  "category_id long, page_no long, position_no long, journal_id long, name string")
    links = L.upsert_links(empty, items, now())
    assert sorted((r.journal_id, r.position_no, r.is_new) for r in links.collect()) == [(5, 3, True), (6, 2, True)]
    new = L.new_only(items, spark.createDataFrame([], ENTITIES))
    assert sorted((r.journal_id, r.name) for r in new.collect()) == [(5, "A"), (6, "6")]
    states = frame(spark, GROUP_STATES, [dict(category_id=1, field_tag="t", remote_total_count=1, status="changed")])
    after = L.group_state_after_scan(states, links.drop("is_new"), now()).first()
    assert (after.local_index_count, after.estimated_new_count, after.status) == (2, 0, "in_sync")
    assert after.last_full_scanned_at is not None


def test_plan_policies(spark):
    states = ["pending", "running", "failed", "completed"]
    items = frame(spark, WORK_ITEMS, [
        dict(id=i * 10 + k, task_type=t, target_id=str(i), status=s if k else "failed")
        for t in ("list", "detail", "comment", "category") for i, s in enumerate(states) for k in (0, 1)])
    wanted = spark.createDataFrame([(str(i), d) for i in range(5) for d in (True, False)], "target_id string, done boolean")

    def plan(policy, task, **kw):
        rows = PL.plan(wanted, items, policy, task, **kw).collect()
        return [[r.action for r in sorted(rows, key=lambda r: r.target_id) if r.done is done] for done in (False, True)]

    assert plan("list", "list")[0] == ["keep", "keep", "reset", "omit", "create"]
    assert plan("list", "list", refresh=True)[0] == ["keep", "keep", "reset", "reset", "create"]
    assert plan("detail", "detail", done="done") == [["keep", "keep", "reset", "reset", "create"], ["skip"] * 5]
    assert plan("children", "comment", done="done") == [["keep", "keep", "reset", "reset", "create"], ["skip"] * 5]
    assert plan("children", "comment", done="done", refresh=True)[1] == ["keep", "keep", "reset", "reset", "create"]
    assert plan("detail_force", "detail")[0] == ["reset", "keep", "reset", "reset", "create"]
    assert plan("group_scan", "category")[0] == ["keep", "keep", "create", "create", "create"]


def test_work_items(spark):
    items = frame(spark, WORK_ITEMS, [
        dict(id=1, task_type="detail", target_id="9", status="failed", retry_count=1, max_retry=3, created_at=T0, error_message="Proxy down"),
        dict(id=2, task_type="detail", target_id="9", status="pending", retry_count=0, max_retry=3, created_at=T0 + dt.timedelta(1)),
        dict(id=3, task_type="detail", target_id="9", status="failed", retry_count=3, max_retry=3, created_at=T0, error_message="x"),
    ])
    assert ids(S.search_work(items, "failed", term="proxy"), "id") == [1]
    assert ids(PL.next_work(items, 2), "id") == [2, 1]
    assert ids(S.exhausted(items), "id") == [3]
    assert {r.id: (r.status, r.retry_count) for r in PL.reset_items(items, "exhausted").collect()}[3] == ("pending", 0)
    wanted = items.select("id")
    retried = {r.id: (r.status, r.retry_count) for r in PL.reset_items(items, "retry", wanted).collect()}
    assert retried == {1: ("pending", 1), 2: ("pending", 0), 3: ("failed", 3)}
    empty = PL.expand_pages(spark.createDataFrame([("t", 0), ("u", 2), ("v", None)], "field_tag string, total_pages long"))
    assert ids(empty, "target_id") == ["u:1", "u:2"]


def test_failures(spark):
    rows = [
        (1, "endpoint_unavailable", "no endpoint", "detail", "proxy_unavailable"),
        (2, "validation", "详情质量检查未通过: x", "detail", "detail_quality_failed"),
        (3, "validation", "detail_empty", "list", "data_validation_failed"),
        (4, "count_mismatch", "HTTP 请求失败", "comment", "comment_mismatch"),
        (5, "other", "HTTP 请求失败: 500", "list", "http_request_failed"),
        (6, "parse", "bad", "list", "parse_error"), (7, None, None, "list", "unknown_error"),
    ]
    errors = spark.createDataFrame([r[:4] for r in rows], "id long, family string, message string, task_type string")
    got = E.classify(errors)
    assert {r.id: r.code for r in got.collect()} == {r[0]: r[4] for r in rows}
    items = frame(spark, WORK_ITEMS, [dict(id=i, status="running", retry_count=1, max_retry=3, worker_id="w") for i in range(1, 9)])
    after = {r.id: r for r in E.apply_failures(items, got, now(), ["id"]).collect()}
    assert (after[1].status, after[1].retry_count, after[1].worker_id, after[1].counted) == ("pending", 1, None, False)
    assert (after[2].status, after[2].retry_count, after[2].counted) == ("failed", 3, True)
    assert (after[6].status, after[6].retry_count) == ("failed", 2)
    assert (after[8].status, after[8].counted) == ("running", False)


def test_quality_failure_items(spark):
    items = frame(spark, WORK_ITEMS, [
        dict(id=1, task_type="detail", status="failed", error_message="数据校验失败"),
        dict(id=2, task_type="detail", status="failed", extra_data='{"rebuild_reason": "detail_quality"}'),
        dict(id=3, task_type="detail", status="failed", extra_data='{"quality_reasons": ["x", "detail_y"]}'),
        dict(id=4, task_type="detail", status="failed", error_message="timeout", extra_data="bad"),
        dict(id=5, task_type="list", status="failed", error_message="detail_empty"),
        dict(id=6, task_type="detail", status="pending", error_message="detail_empty"),
    ])
    assert sorted(ids(items.filter(V.is_quality_failure()), "id")) == [1, 2, 3]


def test_resolution(spark):
    stale = spark.createDataFrame([(1, "Ｎature - Cell", 1), (2, "--", 1), (3, "Lone", 1), (9, "Same", 1)], "journal_id long, name string, category_id long")
    found = spark.createDataFrame([(1, "nature cell", 1), (5, "NATURE CELL", 2), (4, "nature cell", 3), (9, "same", 1), (9, "same", 2), (7, "..", 1)],
                                  "candidate_id long, candidate_name string, ord long")
    got = {r.journal_id: r.new_id for r in V.resolve_by_name(stale, found).collect()}
    assert got == {1: 5, 2: None, 3: None, 9: None}


def test_problem_table(spark):
    table = frame(spark, PROBLEMS, [
        dict(id=1, journal_id=1, problem_type="error", problem_code="x", message="a", resolved=0, created_at=T0, updated_at=T0),
        dict(id=2, journal_id=1, problem_type="error", problem_code="y", resolved=1, resolved_at=T0),
    ])
    new = spark.createDataFrame([(1, "warning", "x", "b", None, 5, 1), (1, "warning", "y", "c", None, 6, 2), (1, "error", "y", "d", 1, 7, 3)],
                                "journal_id long, problem_type string, problem_code string, message string, expected_value long, actual_value long, n long")
    rows = sorted((r.problem_code, r.resolved, r.problem_type, r.message, r.actual_value)
                  for r in P.record_problems(table, new, now(), ["n"]).collect() if r.message)
    assert rows == [("x", 0, "error", "b", 5), ("y", 0, "warning", "d", 7)]
    keys = spark.createDataFrame([(1, None)], "journal_id long, problem_code string")
    assert P.resolve_problems(table, keys, now()).filter("resolved = 1").count() == 2


def test_endpoints(spark):
    pool = frame(spark, ENDPOINTS, [
        dict(id=1, ip="a", port=60001, source="managed", is_active=True, is_valid=True, success_count=50, fail_count=5, total_fail_count=0),
        dict(id=2, ip="b", port=80, source=None, is_active=True, is_valid=True, success_count=0, fail_count=3, total_fail_count=9, username="u", secret="s", remark="r"),
        dict(id=3, ip="c", port=80, source="x", is_active=True, is_valid=False, success_count=1, fail_count=0, total_fail_count=0),
        dict(id=4, ip="d", port=59000, source="managed", is_active=False, is_valid=True, success_count=0, fail_count=0, total_fail_count=0),
    ])
    s = stats.endpoint_stats(pool).first()
    assert (s.total, s.active, s.valid, s.assignable, s.inactive, s.active_invalid) == (4, 3, 2, 1, 1, 1)
    assert s.success_rate == 85.0
    weights = {r.id: r.w for r in pool.select("id", R.endpoint_weight().alias("w")).collect()}
    assert weights[3] > weights[2] and weights[1] == 60 / 16
    assert R.available(pool, excluded=spark.createDataFrame([(1,)], "id long")).count() == 0
    lines = spark.createDataFrame([(1, "b:80"), (2, "new:81:u:p"), (3, "nope"), (4, "# c")], "line_no long, line string")
    ok, rejects = read_endpoint_lines(lines)
    report, errors = R.import_report(ok, rejects, pool)
    assert tuple(report.first()) == (1, 1, 1, 1) and ids(errors, "line_no") == [3]
    merged = {r.ip: r for r in R.upsert_endpoints(pool, ok, now()).collect()}
    assert (merged["b"].username, merged["b"].secret, merged["b"].fail_count, merged["b"].source, merged["b"].remark) == ("u", "s", 0, "manual", "r")
    assert merged["new"].is_new and merged["new"].secret == "p"
    lines = {r.id: r.line for r in sinks.endpoint_lines(pool, "hostport_auth", only_valid=True).collect()}
    assert lines == {1: "a:60001", 2: "b:80:u:s"}
    picks = {R.weighted_sample(pool, 1, str(i)).first().id for i in range(30)}
    assert {3} < picks | {3}
    held = spark.createDataFrame([(3,)], "id long")
    got = R.allocate(pool, 3, held, "1").collect()
    assert {r.id for r in got} == {1, 2, 4} and sorted(r.consumer for r in got) == [0, 1, 2]


def test_weighted_draw_follows_the_weights(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0)], "id long, w double")
    key = R._draw_key(F.col("w"), "pair", "s")
    rows = spark.range(4000).select(F.col("id").alias("n")).crossJoin(df).withColumn("pair", F.concat_ws("/", "n", "id"))
    share = rows.withColumn("k", key).groupBy("n").agg(F.min_by("id", "k").alias("won")).filter("won = 2").count() / 4000
    assert 0.72 < share < 0.78


def test_reporters(spark):
    at = dt.datetime(2024, 6, 1)
    rows = frame(spark, REPORTERS, [
        dict(worker_id="a", status="online", current_task_count=0, total_completed=1, last_heartbeat=at - dt.timedelta(seconds=120)),
        dict(worker_id="b", status="busy", current_task_count=2, total_failed=3, last_heartbeat=at - dt.timedelta(seconds=121)),
        dict(worker_id="c", status="busy", current_task_count=2, last_heartbeat=at),
        dict(worker_id="d", status="offline"),
    ])
    s = stats.reporter_summary(rows, now()).first()
    assert (s.total_workers, s.online_workers, s.offline_workers, s.busy_workers, s.total_completed, s.total_failed) == (4, 2, 2, 1, 1, 3)
    shown = {r.worker_id: (r.status, r.current_task_count) for r in stats.workers_by_status(rows, now(), "offline").collect()}
    assert shown == {"b": ("offline", 0), "d": ("offline", 0)}


def test_staleness_boundaries(spark):
    rows = [(1, "a", True, None, dt.datetime(2024, 3, 3)), (2, "b", True, '{"comment_count": 3}', dt.datetime(2024, 3, 2, 23)),
            (3, "c", True, '{"comment_count": null}', None), (4, "d", False, None, T0)]
    ents = spark.createDataFrame(rows, "journal_id long, name string, detail_crawled boolean, detail_data string, updated_at timestamp_ntz")
    kids = spark.createDataFrame([(2,)], "journal_id long")
    got = sorted((r.reason, r.journal_id, r.diff, r.days_ago) for r in C.staleness(ents, kids, now()).collect())
    assert got == [("comment_mismatch", 2, 2, None), ("missing_info", 1, None, None), ("missing_info", 3, None, None), ("outdated", 2, None, 90)]


# --- exports ---------------------------------------------------------------------------------------

def test_exports(spark, entities, tmp_path):
    kids = frame(spark, CHILDREN, [
        dict(journal_id=11, comment_id="a", content='say "hi", ok', comment_time=T0), dict(journal_id=11, comment_id="b", content="中")])
    sinks.export_entities_csv(entities.coalesce(1), str(tmp_path / "e"), group_id=1)
    text = open(glob.glob(str(tmp_path / "e" / "*.csv"))[0], "rb").read()
    assert text.startswith(b"\xef\xbb\xbfID,")
    rows = list(csv.reader(text.decode("utf-8-sig").splitlines()))
    assert len(rows) == 4 and rows[0][1] == "期刊ID" and rows[1][5] == "28.2000"
    sinks.export_entities_nested(entities, kids, str(tmp_path / "n"))
    rows = []
    for path in glob.glob(str(tmp_path / "n" / "*.csv")):
        rows += list(csv.DictReader(open(path, encoding="utf-8-sig")))
    by_id = {r["期刊ID"]: r for r in rows}
    listed = json.loads(by_id["11"]["评论数据"])
    assert by_id["11"]["评论数量"] == "2" and listed[0]["comment_time"] == "2024-01-01 00:00" and listed[1]["comment_time"] is None
    assert listed[0]["content"] == 'say "hi", ok' and by_id["12"]["评论数据"] == "" and by_id["12"]["评论数量"] == "0"
    sinks.export_children_csv(kids, str(tmp_path / "c"), entity_id=11)
    rows = []
    for path in glob.glob(str(tmp_path / "c" / "*.csv")):
        rows += list(csv.DictReader(open(path, encoding="utf-8-sig")))
    assert sorted(r["评论时间"] for r in rows) == ["", "2024-01-01 00:00"] and len(rows[0]) == 8
    sinks.export_json(kids, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    pool = spark.createDataFrame([(2, "b", 2, "http", "u", "s", True, True), (1, "a", 1, "http", "u", None, True, False), (3, "c", 3, "http", None, None, False, True)],
                                 "id long, ip string, port int, protocol string, username string, secret string, is_active boolean, is_valid boolean")
    sinks.export_endpoints(pool, str(tmp_path / "p"))
    assert [r.value for r in spark.read.text(str(tmp_path / "p")).collect()] == ["a:1", "b:2:u:s"]


def test_nested_cells_are_bounded(spark):
    ents = spark.createDataFrame([(1,), (2,)], "journal_id long")
    kids = spark.range(1000).select(F.lit(1).cast("long").alias("journal_id"), F.col("id").cast("string").alias("comment_id"))
    rows = sinks.nest_children(ents, kids, fields=["comment_id"], max_children_per_row=100).collect()
    parts = [r for r in rows if r.journal_id == 1]
    assert len(parts) == 10 and {r.n_children for r in parts} == {1000}
    seen = [c["comment_id"] for r in sorted(parts, key=lambda r: r.part_no) for c in json.loads(r.children)]
    assert seen == sorted(str(i) for i in range(1000)) and {len(json.loads(r.children)) for r in parts} == {100}
    assert [(r.part_no, r.children) for r in rows if r.journal_id == 2] == [(0, "")]


def test_page_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>\n1</p>")
    rows = page_files(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].html == "<p>\n1</p>" and rows[0].url.endswith("a.html")


def test_node_keys(spark):
    from harvestry.operators.dedupe import node_keys

    rows = [(" A　", "SS", "Host.Example ", 443.0, '{"name": "A"}'), ("A", "ss ", "host.example", 443.0, None), (" ", None, "h", 1.0, '{"b": 1, "name": "x", "a": "y"}'),
            ("C", "ss", "h", None, '{"a": "y", "b": 1}'), ("D", "ss", "h", -1.0, "broken")]
    got = node_keys(spark.createDataFrame(rows, "name string, type string, server string, port double, config string")).collect()
    assert [r.name_key for r in got] == ["A", "A", None, "C", "D"]
    assert got[0].endpoint_key == got[1].endpoint_key == "ss|host.example|443"
    assert got[2].endpoint_key == got[3].endpoint_key == '{"a":"y","b":"1"}' and got[4].endpoint_key == "{}"


def test_failures_are_kept_in_the_item(spark):
    old = json.dumps({"error_history": [{"message": f"m{i}"} for i in range(9)], "last_error": {"message": "p"}, "kept": 1})
    items = spark.createDataFrame([(1, "running", 0, 3, old), (2, "running", 0, 3, None), (3, "running", 1, 3, "{}")],
                                  "id long, status string, retry_count long, max_retry long, extra_data string").withColumns({
        c: F.lit(None).cast(t) for c, t in (("error_message", "string"), ("worker_id", "string"), ("started_at", "timestamp_ntz"),
                                            ("locked_at", "timestamp_ntz"), ("completed_at", "timestamp_ntz"))})
    told = spark.createDataFrame([(1, "e1", 1), (1, "e2", 2), (2, "x", 1)], "id long, message string, n int").withColumns({
        "code": F.lit("parse_error"), "action": F.lit("fail_retry"), "retryable": F.lit(True)})
    got = {r.id: r for r in E.apply_failures(items, told, now(), ["n"]).collect()}
    one = json.loads(got[1].extra_data)
    assert one["last_error"]["message"] == "e2" and one["kept"] == 1
    assert [e["message"] for e in one["error_history"]] == [*[f"m{i}" for i in range(1, 9)], "p", "e1"]
    two = json.loads(got[2].extra_data)
    assert two["last_error"]["code"] == "parse_error" and two["error_history"] == [] and got[3].extra_data == "{}"


def test_pages_above_a_limit_are_an_error(spark):
    assert S.page(spark.range(300).orderBy("id"), 2, 120).count() == 120
    with pytest.raises(ValueError):
        S.page(spark.range(3), 1, 120, max_size=100)
