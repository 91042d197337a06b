"""Tables as the reports and charts want them, and files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vakya.functions.text import metric_text


def unpivoted(df: DataFrame, model: str, metrics: list[str]) -> DataFrame:
    """(metric, model, value)."""
    return df.select(F.col(model).alias("model"), *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot("model", metrics, "metric", "value").select("metric", "model", "value")


def metric_table(df: DataFrame, model: str, metrics: list[str], models: list[str]) -> DataFrame:
    """A row per metric, a column per model, as text."""
    return unpivoted(df, model, metrics).groupBy("metric").pivot("model", models).agg(F.first(metric_text("value")))


#: Rows of the two reports: what a row is called, the column it shows, and how.
SENTIMENT_ROWS = (
    ("Accuracy", "accuracy", "%.4f"), ("Precision (macro)", "precision_macro", "%.4f"), ("Recall (macro)", "recall_macro", "%.4f"), ("F1 (macro)", "f1_macro", "%.4f"), ("F1 (weighted)", "f1_weighted", "%.4f"),
    ("ROC-AUC", "roc_auc", "%.4f"), ("Avg confidence", "avg_confidence", "%.4f"), ("Avg inference time (ms/post)", "avg_time_ms", "%.2f"), ("Total inference time (s)", "total_time_s", "%.2f"),
    ("Model size (MB)", "model_size_mb", "%.1f"), ("GPU peak memory (MB)", "gpu_peak_mb", "%.1f"), ("Binary model (Neutral approximated)", "is_binary", ""),
)
TRANSLATION_ROWS = (
    ("BLEU", "bleu", "%.2f"), ("chrF", "chrf", "%.2f"), ("COMET", "comet", "%.4f"), ("Posts translated", "n_translated", "%.0f"), ("Avg latency (ms/post)", "avg_time_ms", "%.1f"), ("Total time (s)", "total_time_s", "%.1f"),
    ("Model size (MB)", "model_size_mb", "%.0f"), ("GPU peak (MB)", "gpu_peak_mb", "%.0f"),
)


def formatted_table(df: DataFrame, model: str, rows, models: list[str]) -> DataFrame:
    """(place, metric, a column per model): each metric of one row per model in its own format; what is missing shows as n/a."""
    show = lambda c, form: F.initcap(F.col(c).cast("string")) if not form else F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit("n/a")).otherwise(F.format_string(form, F.col(c).cast("double")))
    long = df.select(F.col(model).alias("_m"), F.inline(F.array(*(F.struct(F.lit(k).alias("place"), F.lit(name).alias("metric"), show(c, form).alias("_v")) for k, (name, c, form) in enumerate(rows)))))
    return long.groupBy("place", "metric").pivot("_m", models).agg(F.first("_v"))


def memory_bars(df: DataFrame, model: str) -> DataFrame:
    """(metric, model, value): size and peak memory of each model, as a chart of paired bars wants them; a size not known is 0."""
    return unpivoted(df.fillna(0.0, ["model_size_mb", "gpu_peak_mb"]), model, ["model_size_mb", "gpu_peak_mb"])


def pivoted(df: DataFrame, row: str, column: str, value: str, columns: list[str], fill: float | None = None) -> DataFrame:
    out = df.groupBy(row).pivot(column, columns).agg(F.first(value))
    return out if fill is None else out.fillna(fill, columns)


def better_rows(df: DataFrame, row: str, column: str, value: str, best: str, other: str) -> DataFrame:
    """The rows where one column beats another; a missing cell beats nothing and isn't beaten."""
    p = pivoted(df, row, column, value, [best, other])
    return p.where(F.col(best) > F.col(other)).select(row).orderBy(row)


def side_by_side(df: DataFrame, key: str, model: str, models: list[str], values: dict[str, str]) -> DataFrame:
    """A row per key with, for each model, its values under `<first word of the name>_<suffix>`."""
    out = df.groupBy(key).pivot(model, models).agg(*(F.first(c).alias(s) for c, s in values.items()))
    for m in models:
        for s in values.values():
            old = f"{m}_{s}" if len(values) > 1 else m
            out = out.withColumnRenamed(old, f"{m.split()[0]}_{s}")
    return out


def heat_map(cells: DataFrame) -> DataFrame:
    """Confusion cells with `light_text`: whether a cell is dark, above 0.55 of the largest."""
    return cells.withColumn("light_text", F.col("n") > 0.55 * F.max("n").over(W.partitionBy()))  # nine cells


def markdown(df: DataFrame, most: int = 100_000) -> str:
    """A table as Markdown, whole, row by row; ValueError for one too long to be part of a document."""
    line = lambda x: "| " + " | ".join("n/a" if v is None else str(v) for v in x) + " |"
    out = [line(df.columns), line("---" for _ in df.columns)]
    for k, r in enumerate(df.toLocalIterator()):
        if k >= most:
            raise ValueError(f"more than {most} rows for one document")
        out.append(line(r))
    return "\n".join(out)


def summary_markdown(title: str, parts: dict[str, DataFrame]) -> str:
    return "\n\n".join([f"# {title}", *(f"## {k}\n\n{markdown(v)}" for k, v in parts.items())]) + "\n"


def best_document(translation: DataFrame, sentiment: DataFrame, by_language: DataFrame, model: str = "model") -> str:
    """The document on the best models: of each stage the winner with its metrics and why it won, the runner-up's metrics, and the
    languages that the winner of the second stage is better for. One row per model; by_language has one per language and model."""
    from vakya.operators.winners import SENTIMENT, TRANSLATION, trail, winner

    first = [("BLEU", "bleu", ".2f"), ("chrF", "chrf", ".2f"), ("COMET", "comet", ".4f"), ("Time (ms/post)", "avg_time_ms", ".1f")]
    second = [("Accuracy", "accuracy", ".4f"), ("F1 (macro)", "f1_macro", ".4f"), ("F1 (weighted)", "f1_weighted", ".4f"), ("Time (ms/post)", "avg_time_ms", ".1f")]
    show = lambda v, form: "n/a" if v is None or v != v else format(float(v), form)
    parts, best = [], []
    for title, rows, criteria, metrics in (("Translation", translation, TRANSLATION, first), ("Sentiment", sentiment, SENTIMENT, second)):
        won = winner(rows, model, criteria).first()
        others = sorted((r for r in rows.collect() if r[model] != won[model]), key=lambda r: r[model])  # a row per model
        lines = [f"## {title}: {won[model]}", "", *(f"- {name}: {show(won[c], form)}" for name, c, form in metrics), ""]
        for r in others:
            lines += [f"### Against {r[model]}", "", *(f"1. {x}" for x in trail(won, r, model, criteria)), "", "; ".join(f"{name} {show(r[c], form)}" for name, c, form in metrics), ""]
        if title == "Sentiment":
            for r in others:
                better = [x[0] for x in better_rows(by_language, "language", model, "f1_macro", won[model], r[model]).collect()]  # a row per language
                lines += [f"Better than {r[model]} by macro F1 for: {', '.join(better)}", ""] if better else []
        best.append(won[model])
        parts.append("\n".join(lines))
    return "\n".join([f"# Best models: {best[0]}, then {best[1]}", "", *parts])


def write_csv(df: DataFrame, path: str, one_file: bool = False, by: list[str] | None = None) -> None:
    """CSV with a header; arrays must be joined before. One file only for small tables."""
    w = (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("escape", '"')
    (w.partitionBy(*by) if by else w).csv(path)


def write_csv_with_bom(df: DataFrame, path: str, limit: int = 1_000_000) -> None:
    """One local file that spreadsheets open as UTF-8; for small tables, streamed row by row."""
    import csv

    with Path(path).open("w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for k, r in enumerate(df.toLocalIterator()):
            if k >= limit:
                raise ValueError(f"more than {limit} rows for one file")
            out.writerow(["" if v is None else v for v in r])


def json_rows(df: DataFrame, order: str | None = None) -> DataFrame:
    """(json): each row as a JSON object, in order."""
    j = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"), *([F.col(order).alias("_o")] if order else []))
    return j.orderBy("_o").select("json") if order else j


def translations_table(df: DataFrame, key: str, model: str, models: list[str], text: str = "english_text", time: str = "translation_time_ms", base: list[str] | None = None, selected: str | None = None) -> DataFrame:
    """A row per post: its own columns, each model's translation and time, and which model was chosen."""
    wide = df.groupBy(key).pivot(model, models).agg(F.first(text).alias("translation"), F.first(time).alias("time_ms"))
    own = df.groupBy(key).agg(*(F.first(c).alias(c) for c in base or []))
    out = own.join(wide, key)
    return out.withColumn("selected_pipeline", F.lit(selected)) if selected else out


def predictions_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """The input's columns and the result's, arrays joined by '|', fit for CSV."""
    kinds = dict(df.dtypes)
    return df.select(*(F.array_join(F.col(c).cast("array<string>"), "|").alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns))


def accuracy_line(df: DataFrame, truth: str, pred: str, time: str = "total_time_ms") -> str:
    """Accuracy, macro F1 and mean time in one line."""
    from vakya.operators import metrics

    a = metrics.averages(metrics.per_class(metrics.confusion(df, truth, pred))).first()
    ms = df.agg(F.avg(time)).first()[0]
    show = lambda x, p: "n/a" if x is None else f"{x:.{p}f}"
    return f"accuracy {show(a['accuracy'], 4)}, macro F1 {show(a['f1_macro'], 4)}, {show(ms, 1)} ms a post"
