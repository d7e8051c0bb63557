"""Streaming jobs replayed over the event file, each compared with its batch definition."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestry.catalog.registry import query
from harvestry.catalog.resources import OUTCOMES, succeeded
from harvestry.schemas import PROBLEMS
from harvestry.session import work_folder
from harvestry.sources.tables import load
from harvestry.streaming import jobs
from harvestry.streaming.batches import read_output, read_state
from harvestry.streaming.liveness import stream_liveness_events as start_liveness_events


def _made(spark, purpose, make):
    """A new folder that ``make`` filled: every call writes its files and runs its stream again."""
    folder = work_folder(spark, purpose)
    make(folder)
    return folder


ROWS_PER_FILE = 250_000


def event_stream(spark, sf):
    """The events in four parts of whole days by time, each a micro-batch of as many files as the others."""
    events = load(spark, sf, "events")
    clock = F.unix_date(F.col("ts").cast("date"))
    low, mid, high = events.agg(F.percentile_approx(clock, [0.25, 0.5, 0.75])).first()[0] or [None] * 3
    part = F.when(clock <= low, 0).when(clock <= mid, 1).when(clock <= high, 2).when(clock > high, 3)
    sizes = {r[0]: r[1] for r in events.groupBy(part.alias("p")).count().collect() if r[0] is not None}
    # a scan task with as many rows as files gives one to each file, so no part has fewer files
    scans = events.rdd.getNumPartitions()
    least = min(sizes.get(p, 0) for p in range(4)) // scans
    files = max(1, min(least, -(-max(sizes.values(), default=0) // ROWS_PER_FILE)))

    def split(folder):
        for p in range(4):
            events.filter(part == p).repartition(files).write.mode("append").parquet(folder)

    folder = _made(spark, "event-files", split)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _finished(started):
    started.awaitTermination()
    return started


OBS = """rec AS (
  SELECT user_id AS journal_id, ts AS seen_at, event_id AS seq, event_type AS kind,
    CASE WHEN value > 20 THEN CAST(CAST(value AS DECIMAL(10, 4)) AS VARCHAR) END AS score FROM events),
m AS (SELECT *, '{"kind": "' || kind || '", "score": ' || coalesce('"' || score || '"', 'null') || '}' AS metrics FROM rec),
prev AS (SELECT *, lag(metrics) OVER w AS p_metrics, lag(kind) OVER w AS p_kind, lag(score) OVER w AS p_score FROM m
  WINDOW w AS (PARTITION BY journal_id ORDER BY seen_at, seq))"""


def _history(spark, sf):
    obs = event_stream(spark, sf).select(
        F.col("user_id").alias("journal_id"), F.col("ts").alias("seen_at"), F.col("event_id").alias("seq"),
        F.col("event_type").alias("kind"), F.when(F.col("value") > 20, F.col("value")).alias("score"))
    return _made(spark, "history", lambda folder: _finished(
        jobs.stream_history(obs, folder, ["journal_id"], ["seen_at", "seq"], ["kind", "score"], ["score"])))


@query("stream_snapshots", f"""
WITH {OBS} SELECT journal_id, seen_at, seq, metrics, sha256(metrics) AS metric_hash FROM prev WHERE p_metrics IS NULL OR p_metrics <> metrics""")
def stream_snapshots(spark, sf):
    return read_output(spark, _history(spark, sf), "snapshots")


@query("stream_changes", f"""
WITH {OBS}, d AS (
  SELECT journal_id, seen_at, seq, 'kind' AS field_name, p_kind AS old_value, kind AS new_value FROM prev WHERE p_metrics IS NOT NULL
  UNION ALL SELECT journal_id, seen_at, seq, 'score', p_score, score FROM prev WHERE p_metrics IS NOT NULL)
SELECT * FROM d WHERE old_value IS DISTINCT FROM new_value""")
def stream_changes(spark, sf):
    return read_output(spark, _history(spark, sf), "changes")


@query("stream_counters", f"""
WITH RECURSIVE {OUTCOMES}, r AS (
  SELECT user_id, rn, CASE WHEN ok THEN 0 ELSE 1 END AS f, CASE WHEN ok THEN 1 ELSE 0 END AS s, true AS v FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.rn, CASE WHEN ok THEN greatest(f - 1, 0) ELSE f + 1 END, s + CASE WHEN ok THEN 1 ELSE 0 END,
    CASE WHEN ok THEN true WHEN f + 1 >= 3 THEN false ELSE v END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, CAST(arg_max(s, rn) AS BIGINT) AS success_count, CAST(arg_max(f, rn) AS BIGINT) AS fail_count, arg_max(v, rn) AS is_valid FROM r GROUP BY user_id""")
def stream_counters(spark, sf):
    folder = work_folder(spark, "counters")
    started = _finished(jobs.stream_counters(event_stream(spark, sf), folder, "user_id", ["ts", "event_id"], succeeded()))
    return read_state(spark, folder, started).select("user_id", "success_count", "fail_count", "is_valid")


@query("stream_liveness", """
WITH b AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 28800 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM b)
SELECT user_id, min(ts) AS online_at, max(ts) AS last_heartbeat, max(ts) + INTERVAL 28800 SECOND AS offline_at, count(*) AS beats
FROM s GROUP BY user_id, n HAVING max(ts) + INTERVAL 28800 SECOND < (SELECT max(ts) FROM events) - INTERVAL 60 SECOND""")
def stream_liveness(spark, sf):
    folder = work_folder(spark, "liveness")
    _finished(jobs.stream_liveness(event_stream(spark, sf), folder, "user_id", "ts", timeout=28800))
    times = ("online_at", "last_heartbeat", "offline_at")
    rows = spark.read.parquet(f"{folder}/periods")
    return rows.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in times], "beats")


@query("stream_liveness_events", """
WITH b AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 28800 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM b),
x AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 28800 SECOND AS z FROM s GROUP BY user_id, n),
e AS (SELECT user_id, 'online' AS event, a AS at FROM x UNION ALL SELECT user_id, 'offline', z FROM x)
SELECT * FROM e WHERE e."at" < (SELECT max(ts) FROM events) - INTERVAL 60 SECOND""")
def stream_liveness_events(spark, sf):
    folder = work_folder(spark, "liveness-events")
    _finished(start_liveness_events(event_stream(spark, sf), folder, "user_id", "ts", timeout=28800))
    return spark.read.parquet(f"{folder}/events").select("user_id", "event", F.col("at").cast("timestamp_ntz").alias("at"))


@query("live_sessions", """
WITH b AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 7200 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM b)
SELECT user_id, min(ts) AS online_at, max(ts) AS last_heartbeat, max(ts) + INTERVAL 7200 SECOND AS offline_at, count(*) AS beats FROM s GROUP BY user_id, n""")
def live_sessions(spark, sf):
    return jobs.live_sessions(load(spark, sf, "events"), "user_id", "ts", timeout=7200)


@query("liveness_events", """
WITH b AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 7200 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM b),
x AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 7200 SECOND AS z FROM s GROUP BY user_id, n)
SELECT user_id, 'online' AS event, a AS at FROM x
UNION ALL SELECT user_id, 'offline', z FROM x WHERE z <= (SELECT max(ts) FROM events)""")
def liveness_events(spark, sf):
    beats = load(spark, sf, "events")
    now = beats.agg(F.max("ts").alias("ts")).scalar()
    return jobs.period_events(jobs.live_sessions(beats, "user_id", "ts", timeout=7200), now, "user_id")


def _problem_events(events):
    kind = F.col("event_type")
    return events.select(
        F.when(kind == "purchase", "resolve").otherwise("report").alias("kind"), F.col("user_id").alias("journal_id"),
        F.when(F.col("value") > 15, "parse_error").otherwise("comment_mismatch").alias("problem_code"),
        F.when(kind == "error", "error").otherwise("warning").alias("problem_type"), kind.alias("message"),
        F.lit(None).cast("long").alias("expected_value"), F.col("event_id").alias("actual_value"), "event_id", "ts")


@query("stream_problems", """
WITH e AS (SELECT user_id AS journal_id, CASE WHEN value > 15 THEN 'parse_error' ELSE 'comment_mismatch' END AS problem_code, event_type = 'purchase' AS fix,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END AS tp, event_type, event_id, ts FROM events),
c AS (SELECT *, coalesce(sum(CASE WHEN fix THEN 1 ELSE 0 END) OVER (PARTITION BY journal_id, problem_code ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM e)
SELECT journal_id, problem_code, arg_min(tp, (ts, event_id)) FILTER (NOT fix) AS problem_type, arg_max(event_type, (ts, event_id)) FILTER (NOT fix) AS message,
  max(event_id) FILTER (NOT fix) AS actual_value, CASE WHEN bool_or(fix) THEN 1 ELSE 0 END AS resolved, max(ts) FILTER (fix) AS resolved_at,
  min(ts) FILTER (NOT fix) AS created_at, max(ts) FILTER (NOT fix) AS updated_at
FROM c GROUP BY journal_id, problem_code, n HAVING count(*) FILTER (NOT fix) > 0""")
def stream_problems(spark, sf):
    folder = work_folder(spark, "problems")
    empty = spark.createDataFrame([], PROBLEMS)
    started = _finished(jobs.stream_problems(
        _problem_events(event_stream(spark, sf)), folder, empty, ["ts", "event_id"], "ts"))
    return read_state(spark, folder, started).drop("id", "expected_value")


def _harvest_rows(events):
    """A user's events of a day are one harvest of children; errors carry no child id."""
    return events.select(
        F.col("user_id").alias("journal_id"), F.dayofmonth("ts").alias("harvest"),
        F.when(F.col("event_type") != "error", F.col("event_id").cast("string")).alias("comment_id"),
        F.col("event_type").alias("content"), F.col("event_id").alias("position_no"),
        (F.col("user_id") % 4 + 1).alias("total_count"), F.lit(1).alias("total_pages"))


@query("stream_children", """
WITH r AS (SELECT user_id AS journal_id, day(ts) AS harvest, CASE WHEN event_type <> 'error' THEN CAST(event_id AS VARCHAR) END AS comment_id,
    event_type AS content, user_id % 4 + 1 AS total_count FROM events),
h AS (SELECT journal_id, harvest FROM r GROUP BY 1, 2 HAVING count(comment_id) >= max(total_count)),
l AS (SELECT journal_id, max(harvest) AS harvest FROM h GROUP BY 1)
SELECT journal_id, comment_id, content FROM r JOIN l USING (journal_id, harvest) WHERE comment_id IS NOT NULL
UNION ALL SELECT c_custkey, 'old-' || c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT journal_id FROM l)""")
def stream_children(spark, sf):
    folder = work_folder(spark, "children")
    old = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("journal_id"), F.concat(F.lit("old-"), "c_custkey").alias("comment_id"),
        F.col("c_name").alias("content"))
    started = _finished(jobs.stream_children(_harvest_rows(event_stream(spark, sf)), folder, old))
    return read_state(spark, folder, started)


@query("late_observations", """
SELECT user_id AS journal_id, min(ts) AS seen_at FROM events GROUP BY user_id""")
def late_observations(spark, sf):
    """A second step that sees every key's first event again finds it late."""
    from harvestry.operators.history import advance_history

    obs = load(spark, sf, "events").select(
        F.col("user_id").alias("journal_id"), F.col("ts").alias("seen_at"), F.col("event_type").alias("kind"))
    first = obs.groupBy("journal_id").agg(F.min("seen_at").alias("seen_at"), F.min_by("kind", "seen_at").alias("kind"))
    keys, order = ["journal_id"], ["seen_at"]
    state = advance_history(None, obs, keys, order, ["kind"], []).state
    return advance_history(state, first, keys, order, ["kind"], []).late.select("journal_id", "seen_at")
