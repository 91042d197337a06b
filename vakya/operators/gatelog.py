"""A log of calls replayed: admission, circuit breaker, runs of failures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vakya.operators.dedupe import in_chunks

SIZE, THRESHOLD, COOLDOWN = 2, 8, 30.0


def failure_runs(df: DataFrame, by: list[str], order: list[str], failed: str) -> DataFrame:
    """Adds run: how many calls in a row have failed up to this one. A key's log is cut into chunks of time; each tells how many calls failed
    at its end and whether one succeeded, so runs go on from chunk to chunk without a task that orders the whole log."""
    g = in_chunks(df, by, order)
    bad = F.coalesce(F.col(failed), F.lit(False))
    w = W.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    g = g.withColumn("_grp", F.sum(F.when(bad, 0).otherwise(1)).over(w))
    own = F.sum(F.when(bad, 1).otherwise(0)).over(W.partitionBy(*by, "_chunk", "_grp").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    g = g.withColumn("_run", own)
    ends = g.groupBy(*by, "_chunk").agg(F.max("_grp").alias("_ok"), F.max(F.struct("_grp", "_run")).alias("_last"))
    # What a chunk hands on: its last run, with what came in where nothing in it succeeded.
    before = W.partitionBy(*by).orderBy("_chunk")
    ends = ends.withColumn("_part", F.sum(F.when(F.col("_ok") > 0, 1).otherwise(0)).over(before))
    handed = F.sum("_last._run").over(W.partitionBy(*by, "_part").orderBy("_chunk"))
    ends = ends.withColumn("_out", handed).withColumn("_carry", F.coalesce(F.lag("_out").over(before), F.lit(0)))
    right = ends.select(*(F.col(k).alias(f"_{k}") for k in by), F.col("_chunk").alias("_c"), "_carry")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by] + [F.col("_chunk") == F.col("_c")]
    run = F.when(bad, F.col("_run") + F.when(F.col("_grp") == 0, F.col("_carry")).otherwise(0)).otherwise(0)
    return g.join(right, on).select(*df.columns, run.cast("bigint").alias("run"))


def overlap_bound(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Adds open_calls: calls that began earlier and hadn't ended. An upper bound of a gate's load, for a refused call holds no slot.

    Starts and ends are merged into one order and summed, not joined pairwise, in chunks of time whose sums are added up first."""
    at = df.select(*by, F.col(start).alias("t"), F.lit(1).alias("kind"), F.lit(1).alias("d"), F.struct(*df.columns).alias("row"))
    to = df.select(*by, F.col(end).alias("t"), F.lit(0).alias("kind"), F.lit(-1).alias("d"), F.lit(None).alias("row"))
    u = in_chunks(at.unionByName(to), by, ["t", "kind"])
    sums = u.groupBy(*by, "_chunk").agg(F.sum("d").alias("_d"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_d").over(W.partitionBy(*by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    right = sums.select(*(F.col(k).alias(f"_{k}") for k in by), F.col("_chunk").alias("_c"), "_base")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by] + [F.col("_chunk") == F.col("_c")]
    w = W.partitionBy(*by, "_chunk").orderBy("t", "kind").rangeBetween(W.unboundedPreceding, W.currentRow)
    one = W.partitionBy(*by, "_chunk", "t", "kind")
    u = u.withColumn("open", F.sum("d").over(w)).withColumn("same", F.sum("d").over(one)).where("kind = 1").join(right, on)
    return u.select("row.*", (F.col("_base") + F.col("open") - F.col("same")).cast("bigint").alias("open_calls"))


def _replay(rows: list[tuple[float, float, bool]], size: int, threshold: int, cooldown: float, state: dict | None = None) -> tuple[list[str], dict]:
    """Decisions on calls (start, end, failed) in order of start, and the state after them.

    A failing probe doesn't restart the cooldown: the breaker stays half open, as its opening time is set only once."""
    s = state or {"running": [], "fails": 0, "opened": 0.0}
    out = []

    def settle(now: float) -> None:
        for end, failed in sorted(x for x in s["running"] if x[0] <= now):
            if failed:
                s["fails"] += 1
                if s["fails"] >= threshold and s["opened"] <= 0:
                    s["opened"] = end
            else:
                s["fails"], s["opened"] = 0, 0.0
        s["running"] = [x for x in s["running"] if x[0] > now]

    for start, end, failed in rows:
        settle(start)
        if s["opened"] > 0 and start - s["opened"] < cooldown:
            out.append("open")
        elif s["opened"] > 0 and s["running"]:
            out.append("open")  # one probe at a time
        elif len(s["running"]) >= size:
            out.append("full")
        else:
            out.append("probe" if s["opened"] > 0 else "admitted")
            s["running"].append((end, failed))
    return out, s


def replay(df: DataFrame, key: str, start: str, end: str, failed: str, size: int = SIZE, threshold: int = THRESHOLD, cooldown: float = COOLDOWN) -> DataFrame:
    """Adds decision: 'admitted', 'probe', 'full' or 'open' for each call of a key's gate. One gate's log is sequential by nature and
    streams through a task in order of start; what is held is the gate's state, not the log."""
    cols = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", decision string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in batches:
            out: list[str] = []
            for k, part in pdf.groupby((pdf[key] != pdf[key].shift()).cumsum(), sort=False):
                if part[key].iloc[0] != now:
                    now, state = part[key].iloc[0], None
                d, state = _replay(list(zip(part[start], part[end], part[failed])), size, threshold, cooldown, state)
                out += d
            yield pdf.assign(decision=out)

    return df.repartition(key).sortWithinPartitions(key, start, end).mapInPandas(run, schema).select(*cols, "decision")
