"""Which of the models is best, by criteria in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SENTIMENT = (("f1_macro", "Macro F1", True), ("accuracy", "Accuracy", True), ("avg_time_ms", "Inference time", False))
TRANSLATION = (("comet", "COMET", True), ("chrf", "chrF", True), ("bleu", "BLEU", True), ("avg_time_ms", "Translation time", False))


def winner(df: DataFrame, model: str, criteria=SENTIMENT, places: int = 4) -> DataFrame:
    """The one row that leads by the first criterion in which models differ, rounded; the first by name if none does.

    A criterion missing (null or NaN) in any row doesn't count."""
    use = [c for c, _, _ in criteria]
    r = df.withColumns({f"_{c}": F.round(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), places) for c in use})
    r = r.withColumns({f"ok_{c}": F.bool_and(F.col(f"_{c}").isNotNull()).over(W.partitionBy()) for c in use})  # one row per model
    key = [F.when(F.col(f"ok_{c}"), F.col(f"_{c}") * (-1 if up else 1)).otherwise(F.lit(0.0)) for c, _, up in criteria]
    return r.withColumn("_k", F.struct(*key, model)).agg(F.min_by(F.struct(*df.columns), "_k").alias("w")).select("w.*")


def trail(a: Row, b: Row, model: str, criteria=SENTIMENT, places: int = 4) -> list[str]:
    """How two rows compare, a line per criterion until one decides."""
    out = []
    for c, label, up in criteria:
        x, y = a[c], b[c]
        if x is None or y is None or x != x or y != y:
            out.append(f"{label}: unavailable for at least one model; skipped")
            continue
        x, y = round(x, places), round(y, places)
        if x == y:
            out.append(f"{label}: tie at {x}")
            continue
        best = a if (x > y) == up else b
        return [*out, f"{label}: {a[model]} {x} vs {b[model]} {y} -> {best[model]} wins"]
    return [*out, f"All criteria tied; {a[model]} kept"]
