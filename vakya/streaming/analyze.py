"""The analysis on streams, and stateful operators of the call log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vakya.operators.gatelog import COOLDOWN, SIZE, THRESHOLD, _replay
from vakya.plans.pipeline import analyze


def analyzed_stream(spark: SparkSession, path: str, schema: str, text: str = "post_text", files_per_trigger: int = 8) -> DataFrame:
    """A stream of parquet files of posts, analysed as a table would be; the files taken at once bound what is under way."""
    return analyze(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path), text)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Work off what is there, exactly once into parquet, then stop."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def counts_by_window(stream: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Rows per window and group, those later than `late` left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def first_seen(stream: DataFrame, time: str, late: str, *keys: str) -> DataFrame:
    """Each key once within the time that state is kept."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([*keys])


def replayed_stream(stream: DataFrame, key: str, start: str, end: str, failed: str, size: int = SIZE, threshold: int = THRESHOLD, cooldown: float = COOLDOWN) -> DataFrame:
    """Decisions of each key's gate, its state carried from batch to batch; calls must come in order of start across batches."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        import json

        s = json.loads(state.get[0]) if state.exists else None
        if s:
            s["running"] = [tuple(x) for x in s["running"]]
        pdf = pd.concat([*parts]).sort_values([start, end])
        d, s = _replay(list(zip(pdf[start], pdf[end], map(bool, pdf[failed]))), size, threshold, cooldown, s)
        state.update((json.dumps(s),))
        yield pd.DataFrame({key: pdf[key].tolist(), start: pdf[start].tolist(), "decision": d})

    kinds = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(run, f"`{key}` {kinds[key]}, `{start}` {kinds[start]}, decision string", "s string", "append", "NoTimeout")
