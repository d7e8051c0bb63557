"""Keep-first operators (one key, two keys at once, observed value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.functions.text import blank_to_null, lenient_int, strip
from harvestry.operators.scans import join_on
from harvestry.session import cut_lineage


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False
) -> DataFrame:
    """First (or last) row per key in the given order; rows with a null key are dropped.

    An aggregate rather than a window: map tasks reduce each key to one row before the
    shuffle, so a key holding a third of the table costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    known = df.dropna(subset=list(keys))
    if not rest:
        return known.select(*keys).distinct()
    pick = F.max_by if last else F.min_by
    kept = known.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return kept.select(*keys, "_row.*").select(*df.columns)


def first_per_observed(df: DataFrame, observed: str, order: Sequence[str]) -> DataFrame:
    """First row per observed value, rows without one dropped; unchanged if none has one."""
    seen = F.coalesce(F.col(observed), F.lit("")) != ""
    kept = first_per_key(df.filter(seen), [observed], order)
    n_seen = df.agg(F.count_if(seen).alias("n")).scalar()
    return kept.unionByName(df.filter(n_seen == 0))


def node_keys(
    nodes: DataFrame, name: str = "name", kind: str = "type", server: str = "server", port: str = "port", config: str = "config",
) -> DataFrame:
    """Adds ``name_key`` and ``endpoint_key`` for the two-key dedupe.

    The endpoint is the lower-case type, the lower-case server and the whole-number port; where one of them is missing it
    is the JSON ``config`` without its name, keys sorted. Names keep their case; outer blanks go, blank ones give NULL.
    """
    whole = lenient_int(port, -1)
    known = (blank_to_null(strip(kind)).isNotNull()) & blank_to_null(strip(server)).isNotNull() & (whole >= 0)
    fields = F.from_json(config, "map<string,string>")
    rest = F.array_sort(F.filter(F.map_entries(fields), lambda e: e["key"] != "name"))
    return nodes.withColumns({
        "name_key": blank_to_null(strip(name)),
        "endpoint_key": F.when(known, F.concat_ws("|", F.lower(strip(kind)), F.lower(strip(server)), whole.cast("string"))).otherwise(
            F.coalesce(F.to_json(F.map_from_entries(rest)), F.lit("{}"))),
    })


def _chained(left: DataFrame) -> DataFrame:
    """Kept rows among those that hang on a certain one by a chain of rows, each blocked by the one before alone.

    Such a row is kept if its blocker is not; the chains are followed by pointer doubling.
    """
    def two_first(key: str) -> DataFrame:
        first = left.groupBy("_scope", key).agg(F.min("_o").alias("first"))
        later = join_on(left, first, ["_scope", key]).filter(F.col("_o") > F.col("first"))
        return join_on(first, later.groupBy("_scope", key).agg(F.min("_o").alias("second")), ["_scope", key]).select(
            "_scope", key, F.col("first").alias(f"first{key}"), F.col("second").alias(f"second{key}"))

    rows = join_on(join_on(left, two_first("_a"), ["_scope", "_a"]), two_first("_b"), ["_scope", "_b"])
    is_first = {k: F.col("_o") == F.col(f"first{k}") for k in ("_a", "_b")}
    is_second = {k: F.coalesce(F.col("_o") == F.col(f"second{k}"), F.lit(False)) for k in ("_a", "_b")}
    blocker = F.when(is_first["_a"] & is_second["_b"], F.col("first_b")).when(is_first["_b"] & is_second["_a"], F.col("first_a"))
    state = cut_lineage(rows.select(
        "_scope", "_a", "_b", "_o", blocker.alias("up"), F.lit(False).alias("odd"), (is_first["_a"] & is_first["_b"]).alias("sure")))
    state = cut_lineage(state.withColumn("odd", F.col("up").isNotNull()))
    while True:
        open_ = state.filter("up is not null").count()
        up = state.select(F.col("_scope").alias("s"), F.col("_o").alias("at"), F.col("up").alias("up2"), F.col("odd").alias("odd2"), F.col("sure").alias("sure2"))
        joined = state.join(up, state["_scope"].eqNullSafe(up["s"]) & (state["up"] == up["at"]), "left")
        # at the end of a chain: sure or not, it stays
        state = cut_lineage(joined.select(
            "_scope", "_a", "_b", "_o", F.col("up2").alias("up"), (F.col("odd") != F.coalesce("odd2", F.lit(False))).alias("odd"),
            F.when(F.col("up").isNull(), F.col("sure")).otherwise(F.coalesce("sure2", F.lit(False))).alias("sure")))
        if not open_ or not state.filter("up is not null").limit(1).count():
            return state.filter("sure and not odd").select("_scope", "_a", "_b", "_o")


def first_per_either_key(
    df: DataFrame,
    key_a: str,
    key_b: str,
    order: Sequence[str],
    within: str | None = None,
) -> DataFrame:
    """Keep a row unless its ``key_a`` or its ``key_b`` was taken by an earlier kept row; rows without a key go.

    Rounds: a row that is first among the survivors for both of its keys is certainly kept; rows sharing a key
    with a kept row are certainly dropped. Rows without a scope are a scope of their own. A round that settles less than a twentieth of its rows follows the
    chains of rows that block each other to their ends, so long ones take few rounds.
    """
    # in a struct a NULL scope equals itself
    scope = F.struct(F.lit(0) if within is None else F.col(within))
    rows = df.dropna(subset=[key_a, key_b]).withColumns({
        "_scope": scope, "_a": F.col(key_a), "_b": F.col(key_b), "_o": F.struct(*order, key_a, key_b),
    })
    # later rows of the same pair can never be kept
    left = cut_lineage(rows.groupBy("_scope", "_a", "_b").agg(F.min("_o").alias("_o")))
    remaining, slow = left.count(), False
    kept_parts: list[DataFrame] = []
    while remaining:
        if slow:
            kept = cut_lineage(_chained(left))
        else:
            first_a = left.groupBy("_scope", "_a").agg(F.min("_o").alias("_first_a"))
            first_b = left.groupBy("_scope", "_b").agg(F.min("_o").alias("_first_b"))
            marked = join_on(join_on(left, first_a, ["_scope", "_a"]), first_b, ["_scope", "_b"])
            kept = cut_lineage(marked.filter((F.col("_o") == F.col("_first_a")) & (F.col("_o") == F.col("_first_b"))).select("_scope", "_a", "_b", "_o"))
        kept_parts.append(kept)
        left = cut_lineage(
            left.join(kept.select("_scope", "_a"), ["_scope", "_a"], "left_anti")
            .join(kept.select("_scope", "_b"), ["_scope", "_b"], "left_anti")
            .select("_scope", "_a", "_b", "_o")
        )
        now = left.count()
        slow, remaining = remaining - now < remaining / 20, now
    if not kept_parts:
        return df.limit(0)
    chosen = kept_parts[0]
    for part in kept_parts[1:]:
        chosen = chosen.unionByName(part)
    return rows.join(chosen, ["_scope", "_a", "_b", "_o"], "left_semi").select(*df.columns)
