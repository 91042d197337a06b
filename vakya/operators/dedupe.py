"""First of equals, work done once for equal rows, and caches as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vakya.sources.store import written


def first_of(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the first in the order. Partial aggregation before the shuffle, so a key with a third of the rows is no
    burden; null keys are keys."""
    names = [c for c in df.columns if c not in keys]
    rank = F.struct(*(o if isinstance(o, Column) else F.col(o) for o in order))
    best = F.min_by(F.struct(*names), rank) if names else F.lit(None)
    out = df.groupBy(*keys).agg(best.alias("_row"))
    return out.select(*keys, *(F.col(f"_row.{n}").alias(n) for n in names)).select(*df.columns)


def fan_out(df: DataFrame, keys: list[str], order: str, solve) -> DataFrame:
    """`solve` runs on the first row of each key; every row gets its columns back, with `is_duplicate` for those not first.

    Keys meet null-safely: groups count nulls as equal and the join does too."""
    first = first_of(df, keys, [order])
    solved = solve(first)
    extra = [c for c in solved.columns if c not in df.columns]
    right = solved.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(order).alias("_first"), *extra)
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = c if on is None else on & c
    return df.join(right, on).select(*df.columns, *extra, (F.col(order) != F.col("_first")).alias("is_duplicate"))


def spread_failures(rows: DataFrame, solved: DataFrame, keys: list[str]) -> DataFrame:
    """Each failed row with its key's resolution; its time is its own plus what resolving took beyond the first row's.

    solved: keys, base_ms, resolved_ms, sentiment_ms and whatever the resolution holds."""
    extra = [c for c in solved.columns if c not in keys and c not in ("base_ms", "resolved_ms", "sentiment_ms")]
    own = F.round(F.col("translation_time_ms") + F.greatest(F.lit(0.0), F.col("resolved_ms") - F.col("base_ms")), 3)
    j = rows.join(solved, keys)
    return j.select(*rows.columns, *extra, own.alias("spread_ms"), F.round(own + F.col("sentiment_ms"), 3).alias("total_ms"))


def cache_misses(requests: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys that a cache table doesn't hold."""
    return requests.select(*keys).distinct().join(cache.select(*keys), keys, "left_anti")


def mark_duplicates(df: DataFrame, keys: list[str], order: str, signal: str = "duplicate_post") -> DataFrame:
    """Adds the signal to rows that aren't the first with their keys."""
    first = df.groupBy(*keys).agg(F.min(order).alias("_first"))
    right = first.select(*(F.col(k).alias(f"_{k}") for k in keys), "_first")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    j = df.join(right, on)
    return j.withColumn("signals", F.when(F.col(order) > F.col("_first"), F.array_append("signals", F.lit(signal))).otherwise(F.col("signals"))).select(*df.columns)


def in_chunks(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """`df` with `_chunk`: rows in the order within each group, cut where the data are (by sampled ranges), so that a group of any size is
    spread and values far out don't matter. Equal values stay together. Written, so that the cuts stay as they are."""
    return written(df.repartitionByRange(*by, *order).withColumn("_chunk", F.spark_partition_id()))


def ranked(df: DataFrame, order: str, by: list[str], name: str = "rank") -> DataFrame:
    """Adds the 0-based rank by a column within each group, ties in any order. Nulls of the order come first.

    Chunks are counted and summed up first, so that no task ranks a whole group."""
    b = in_chunks(df, by, [order])
    n = b.groupBy(*by, "_chunk").agg(F.count("*").alias("_n"))
    n = n.withColumn("_base", F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    right = n.select(*(F.col(k).alias(f"_{k}") for k in by), F.col("_chunk").alias("_c"), "_base")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by] + [F.col("_chunk") == F.col("_c")]
    inside = F.row_number().over(W.partitionBy(*by, "_chunk").orderBy(order)) - 1
    return b.withColumn("_in", inside).join(right, on).select(*df.columns, (F.col("_base") + F.col("_in")).alias(name))


def batches(df: DataFrame, order: str, size: int, by: list[str]) -> DataFrame:
    """Adds batch: the number of a row's batch of `size` in the order, within its group."""
    return ranked(df, order, by, "_rank").withColumn("batch", F.floor(F.col("_rank") / size)).drop("_rank")
