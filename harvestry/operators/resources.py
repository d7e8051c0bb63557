"""Endpoints and credentials: availability, counters, weights, picks, pool rewrites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestry.operators.ids import top_id, with_new_ids
from harvestry.operators.scans import ROWS_PER_CHUNK, Peak, join_on, running

MAX_FAILS = 3
MANAGED = "managed"


def is_available(managed_source: str = MANAGED, base_port: int = 60000, limit: int = MAX_FAILS) -> Column:
    """Active, valid and either a managed row from the base port up or few enough failures."""
    managed = F.col("source").eqNullSafe(F.lit(managed_source))
    usable = (managed & (F.col("port") >= base_port)) | (~managed & (F.col("fail_count") < limit))
    return F.col("is_active") & F.col("is_valid") & usable


def available(
    endpoints: DataFrame, managed_source: str = MANAGED, base_port: int = 60000,
    excluded: DataFrame | None = None, limit: int = MAX_FAILS,
) -> DataFrame:
    rows = endpoints.filter(is_available(managed_source, base_port, limit))
    return rows if excluded is None else exclude(rows, excluded)


def exclude(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti").select(*df.columns)


def endpoint_weight() -> Column:
    """Successes raise the weight, current failures lower it strongly, past ones a little."""
    def count(c: str) -> Column:
        return F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))

    gain = 10.0 + F.least(count("success_count"), F.lit(50))
    penalty = 1.0 + count("fail_count") * 3 + F.least(count("total_fail_count"), F.lit(50)) * 0.2
    return F.greatest(F.lit(0.1), gain / penalty)


def _draw_key(weight: Column, id_col: str, seed: str) -> Column:
    """-ln(u) / w with u from md5(id, seed): the k smallest are a weighted draw without replacement."""
    digits = F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}"))), 1, 12)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**12))
    return -F.ln(u) / weight


def weighted_sample(
    df: DataFrame, k: int = 1, seed: str = "0", weight: Column | None = None, id_col: str = "id"
) -> DataFrame:
    key = _draw_key(endpoint_weight() if weight is None else weight, id_col, seed)
    return df.withColumn("draw_key", key).orderBy("draw_key", id_col).limit(k)


def allocate(
    df: DataFrame, consumers: int, held: DataFrame | None = None, seed: str = "0",
    weight: Column | None = None, id_col: str = "id",
) -> DataFrame:
    """A different endpoint for each of ``consumers`` consumers, none of them already held."""
    free = df if held is None else exclude(df, held, id_col)
    picked = weighted_sample(free, consumers, seed, weight, id_col)
    # at most ``consumers`` rows are left here
    number = F.row_number().over(Window.orderBy("draw_key", id_col)) - 1
    return picked.withColumn("consumer", number.cast("long"))


def clamped_counters(
    events: DataFrame, key: str, order: Sequence[str], success: Column, start: DataFrame | None = None,
    limit: int = MAX_FAILS, exempt: Column | None = None, rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Counters after every outcome: success_count, fail_count, total_fail_count, is_valid.

    A success takes one failure off (never below zero), a failure adds one; a failure at
    or above ``limit`` makes the row invalid unless it is ``exempt``, a success makes it
    valid again.  With running sum S of the steps and starting value f, the clamped count
    is f + S + max(0, highest -(f + S) so far).  ``start`` may hold key, fail_count,
    success_count, total_fail_count and is_valid.
    """
    ok = F.coalesce(success, F.lit(False))
    rows = events.withColumn("_ok", ok)
    sums = {
        "_s": F.when(F.col("_ok"), -1).otherwise(1),
        "success_count": F.when(F.col("_ok"), 1).otherwise(0),
        "total_fail_count": F.when(F.col("_ok"), 0).otherwise(1),
    }
    scanned = running(rows, [key], order, sums, {"_low": Peak("_s", sign=-1)}, rows_per_chunk)
    if start is None:
        scanned = scanned.withColumns({"_f0": F.lit(0), "_ok0": F.lit(0), "_t0": F.lit(0), "_v0": F.lit(True)})
    else:
        given = start.select(
            key, F.col("fail_count").alias("_f0"), F.col("success_count").alias("_ok0"),
            F.col("total_fail_count").alias("_t0"), F.col("is_valid").alias("_v0"),
        )
        scanned = join_on(scanned, given, [key]).withColumns({
            "_f0": F.coalesce("_f0", F.lit(0)), "_ok0": F.coalesce("_ok0", F.lit(0)),
            "_t0": F.coalesce("_t0", F.lit(0)), "_v0": F.coalesce("_v0", F.lit(True)),
        })
    fails = F.col("_f0") + F.col("_s") + F.greatest(F.lit(0), F.col("_low") - F.col("_f0"))
    free = F.lit(False) if exempt is None else F.coalesce(exempt, F.lit(False))
    scanned = scanned.withColumn("fail_count", fails.cast("long"))
    # between two successes failures only grow, so the latest verdict follows from this row
    valid = (
        F.when(F.col("_ok") | free, True).when(F.col("fail_count") >= limit, False)
        .when(F.col("success_count") > 0, True).otherwise(F.col("_v0"))
    )
    return scanned.withColumn("is_valid", valid).withColumns({
        "success_count": F.col("success_count") + F.col("_ok0"),
        "total_fail_count": F.col("total_fail_count") + F.col("_t0"),
    }).select(*events.columns, "success_count", "fail_count", "total_fail_count", "is_valid")


def reset_counters(
    events: DataFrame, key: str, order: Sequence[str], success: Column, reset_on_success: bool = True,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Success and failure counts after every outcome; a success may zero the failures."""
    rows = events.withColumn("_ok", F.coalesce(success, F.lit(False)))
    sums = {
        "success_count": F.when(F.col("_ok"), 1).otherwise(0), "_fails": F.when(F.col("_ok"), 0).otherwise(1),
    }
    peaks = {"_at_success": Peak("_fails", when=F.col("_ok"))} if reset_on_success else {}
    scanned = running(rows, [key], order, sums, peaks, rows_per_chunk)
    base = F.coalesce("_at_success", F.lit(0)) if reset_on_success else F.lit(0)
    return scanned.withColumn("fail_count", (F.col("_fails") - base).cast("long")).select(
        *events.columns, "success_count", "fail_count"
    )


def best_endpoints(
    endpoints: DataFrame, k: int = 1, by_source: bool = True, limit: int = MAX_FAILS
) -> DataFrame:
    """Fewest failures, most successes, longest unused among active, valid, low-failure rows."""
    usable = endpoints.filter(F.col("is_active") & F.col("is_valid") & (F.col("fail_count") < limit))
    order = [F.col("fail_count"), F.col("success_count").desc(), F.col("last_used_at").asc_nulls_first(), F.col("id")]
    if not by_source:
        return usable.orderBy(*order).limit(k)
    rank = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    return usable.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def upsert_endpoints(
    pool: DataFrame, incoming: DataFrame, now: Column, order: Sequence[str] = ("line_no",),
    source: str = "manual", proxy_type: str = "private", remark: str | None = None,
) -> DataFrame:
    """Pool with imported endpoints merged on (ip, port) and ``is_new`` marking added rows.

    Existing rows are revived: active, valid, no failures, new protocol, source and type;
    user, secret and remark are kept when the import has none. Added rows are numbered by ip and port,
    behind the highest id.
    """
    rank = F.struct(*order)

    def last_filled(c: str) -> Column:
        filled = F.coalesce(F.col(c), F.lit("")) != ""
        return F.max_by(c, F.when(filled, rank))

    batch = incoming.groupBy("ip", "port").agg(
        F.max_by("protocol", rank).alias("_protocol"),
        last_filled("username").alias("_username"), last_filled("secret").alias("_secret"),
    )
    both = pool.withColumn("_had", F.lit(True)).join(batch, ["ip", "port"], "full")
    is_new = F.col("_had").isNull()
    hit = F.col("_protocol").isNotNull()
    zero = F.lit(0).cast("long")
    note = F.lit(remark or None)
    values = {
        "protocol": F.coalesce("_protocol", "protocol"),
        "username": F.coalesce("_username", "username"),
        "secret": F.coalesce("_secret", "secret"),
        "source": F.when(hit, source).otherwise(F.col("source")),
        "proxy_type": F.when(hit, proxy_type).otherwise(F.col("proxy_type")),
        "remark": F.when(hit, F.coalesce(note, F.col("remark"))).otherwise(F.col("remark")),
        "is_active": F.when(hit, True).otherwise(F.col("is_active")),
        "is_valid": F.when(hit, True).otherwise(F.col("is_valid")),
        "fail_count": F.when(hit, zero).otherwise(F.col("fail_count")),
        "success_count": F.coalesce("success_count", zero),
        "total_fail_count": F.coalesce("total_fail_count", zero),
        "created_at": F.when(is_new, now).otherwise(F.col("created_at")),
    }
    merged = both.select(*[values.get(c, F.col(c)).alias(c) for c in pool.columns], is_new.alias("is_new"))
    return with_new_ids(merged, pool, F.col("is_new"), ["ip", "port"])


def import_report(
    ok: DataFrame, rejects: DataFrame, existing: DataFrame, order: str = "line_no", max_errors: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Counts added, updated, skipped, failed, and the rejected lines, on request the first ``max_errors`` only.

    The first line of an endpoint not in the pool counts as added, any other as updated.
    """
    known = existing.select("ip", "port").distinct().withColumn("_known", F.lit(True))
    per_endpoint = ok.groupBy("ip", "port").agg(F.count(F.lit(1)).alias("_n"))
    tallied = per_endpoint.join(known, ["ip", "port"], "left")
    added = F.count_if(F.col("_known").isNull())
    zero = F.lit(0).cast("long")
    good = tallied.agg(
        added.alias("added"), (F.coalesce(F.sum("_n"), zero) - added).alias("updated")
    ).select("added", "updated", zero.alias("skipped"), zero.alias("failed"))
    bad = rejects.agg(
        F.count_if("skipped").alias("skipped"), F.count_if(~F.col("skipped")).alias("failed")
    ).select(zero.alias("added"), zero.alias("updated"), "skipped", "failed")
    # one row each
    counts = good.unionByName(bad).agg(*[F.sum(c).alias(c) for c in ("added", "updated", "skipped", "failed")])
    errors = rejects.filter(~F.col("skipped")).orderBy(order)
    return counts, errors if max_errors is None else errors.limit(max_errors)


def resync_pool(
    pool: DataFrame, fresh: DataFrame, now: Column, source: str = MANAGED, base_port: int = 60000,
    order: str = "ord", area: str = "local",
) -> DataFrame:
    """Take the source's active rows out of service and append one row per fresh node.

    ``fresh`` holds ``node_name``, ``egress_ip`` (may be null) and ``ord``. Ports end at 65535, so more nodes than
    there are ports from ``base_port`` on are an error, and the numbering in one task stays small.
    """
    ports = 65536 - base_port
    if len(fresh.limit(ports + 1).select(F.lit(1)).collect()) > ports:
        raise ValueError(f"there are only {ports} ports from {base_port} on")
    own = F.col("source").eqNullSafe(F.lit(source)) & F.col("is_active")
    retired = pool.withColumn("is_active", F.when(own, False).otherwise(F.col("is_active")))
    numbered = fresh.withColumn("_i", F.row_number().over(Window.orderBy(order)) - 1)
    total = fresh.agg(F.count(F.lit(1)).alias("n")).scalar()
    zero = F.lit(0).cast("long")
    remark = F.concat_ws(
        "; ",
        F.concat(F.lit("node listener "), (F.col("_i") + 1).cast("string"), F.lit("/"), total.cast("string")),
        F.concat(F.lit("node="), F.nullif("node_name", F.lit(""))),
        F.concat(F.lit("egress_ip="), F.nullif("egress_ip", F.lit(""))),
    )
    values = {
        "ip": F.lit("127.0.0.1"), "port": (F.col("_i") + base_port).cast("int"), "protocol": F.lit("http"),
        "proxy_type": F.lit("direct"), "source": F.lit(source), "area": F.lit(area),
        "is_active": F.lit(True), "is_valid": F.lit(True), "success_count": zero, "fail_count": zero,
        "total_fail_count": zero, "remark": remark, "created_at": now,
        "id": top_id(pool) + 1 + F.col("_i"),
    }
    added = numbered.select(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in pool.schema
    ])
    return retired.unionByName(added)


def purge_invalid(pool: DataFrame) -> DataFrame:
    return pool.filter(F.col("is_valid"))
