"""Classification metrics. All start from counts by (truth, prediction) or by score, which are aggregated before the shuffle, so nothing
after that depends on the number of rows. Rows whose truth or prediction is no label are left out; a metric with nothing to
divide by is 0, an average of nothing null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vakya.functions.lexicons import LABELS


def _with_labels(df: DataFrame, by: list[str], cells) -> DataFrame:
    """Each group, or one row without groups, with each cell."""
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1)
    return groups.select(*by, F.inline(cells))


def class_counts(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """(by..., label, n) with zeros, in label order."""
    by = by or []
    groups = _with_labels(df, by, F.array(*(F.struct(F.lit(x).alias("label"), F.lit(i).alias("label_id")) for i, x in enumerate(LABELS))))
    n = df.where(F.col(label).isin(*LABELS)).groupBy(*by, F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return groups.join(n, [*by, "label"], "left").select(*by, "label", "label_id", F.coalesce("n", F.lit(0)).alias("n"))


def confusion(df: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """(by..., truth, pred, n): three times three cells for each group."""
    by = by or []
    rows = df.where(F.col(truth).isin(*LABELS) & F.col(pred).isin(*LABELS))
    n = rows.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    grid = _with_labels(n, by, F.array(*(F.struct(F.lit(a).alias("truth"), F.lit(b).alias("pred")) for a in LABELS for b in LABELS)))
    return grid.join(n, [*by, "truth", "pred"], "left").select(*by, "truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., label, tp, fp, fn, precision, recall, f1, support) of confusion cells."""
    by = by or []
    long = cells.select(*by, F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit("t").alias("side")), F.struct(F.col("pred").alias("label"), F.lit("p").alias("side")))).alias("x"), (F.col("truth") == F.col("pred")).alias("hit"), "n")
    s = long.groupBy(*by, F.col("x.label").alias("label")).agg(
        F.sum(F.when((F.col("x.side") == "t") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("x.side") == "p") & ~F.col("hit"), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("x.side") == "t") & ~F.col("hit"), F.col("n")).otherwise(0)).alias("fn"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * p * r, p + r)).withColumn("support", F.col("tp") + F.col("fn"))


def averages(classes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n, accuracy, macro and weighted averages) of per-class rows; a macro average is over all three labels."""
    by = by or []
    k = len(LABELS)
    total = F.sum("support")
    return classes.groupBy(*by).agg(
        total.alias("n"),
        F.when(total > 0, F.sum("tp") / total).alias("accuracy"),
        (F.sum("precision") / k).alias("precision_macro"),
        (F.sum("recall") / k).alias("recall_macro"),
        (F.sum("f1") / k).alias("f1_macro"),
        F.when(total > 0, F.sum(F.col("precision") * F.col("support")) / total).alias("precision_weighted"),
        F.when(total > 0, F.sum(F.col("recall") * F.col("support")) / total).alias("recall_weighted"),
        F.when(total > 0, F.sum(F.col("f1") * F.col("support")) / total).alias("f1_weighted"),
    )


def report(cells: DataFrame) -> DataFrame:
    """(name, precision, recall, f1, support): the classes, accuracy, macro and weighted averages."""
    c = per_class(cells)
    a = averages(c)
    row = lambda name, p, r, f: a.select(F.lit(name).alias("name"), F.col(p).alias("precision"), F.col(r).alias("recall"), F.col(f).alias("f1"), F.col("n").alias("support"))
    out = c.select(F.col("label").alias("name"), "precision", "recall", "f1", "support")
    return out.unionByName(row("accuracy", "accuracy", "accuracy", "accuracy")).unionByName(row("macro avg", "precision_macro", "recall_macro", "f1_macro")).unionByName(row("weighted avg", "precision_weighted", "recall_weighted", "f1_weighted"))


def evaluate(df: DataFrame, truth: str, pred: str, by: list[str], confidence: str = "confidence", time: str = "total_time_ms") -> DataFrame:
    """One row per model: averages with mean confidence and time."""
    means = df.where(F.col(truth).isin(*LABELS) & F.col(pred).isin(*LABELS)).groupBy(*by).agg(F.avg(confidence).alias("avg_confidence"), F.avg(time).alias("avg_time_ms"))
    return averages(per_class(confusion(df, truth, pred, by), by), by).join(means, by)


def breakdown(df: DataFrame, truth: str, pred: str, group: str, by: list[str] | None = None) -> DataFrame:
    """(by..., group, n_posts, accuracy, f1_macro, f1_weighted), the largest groups first."""
    keys = [*(by or []), group]
    a = averages(per_class(confusion(df, truth, pred, keys), keys), keys)
    return a.select(*keys, F.col("n").alias("n_posts"), "accuracy", "f1_macro", "f1_weighted").orderBy(F.desc("n_posts"), *keys)


def _by_score(df: DataFrame, score: str, hit, by: list[str]) -> DataFrame:
    """(by..., s, p, n): positives and negatives at each distinct score."""
    return df.groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.when(hit, 1).otherwise(0)).alias("p"), F.sum(F.when(hit, 0).otherwise(1)).alias("n"))


def _below(scores: DataFrame, by: list[str]) -> DataFrame:
    """Adds cn: the negatives with a lower score. Scores are cut into ranges first, so that no task sums up all of them."""
    b = scores.withColumn("_bin", F.floor(F.least(F.lit(1023), F.greatest(F.lit(0), F.col("s") * 1024))))
    totals = b.groupBy(*by, "_bin").agg(F.sum("n").alias("_n"))
    base = totals.withColumn("_base", F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.coalesce(F.sum("n").over(W.partitionBy(*by, "_bin").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return b.withColumn("_in", within).join(base, [*by, "_bin"]).withColumn("cn", F.col("_base") + F.col("_in"))


def auc(df: DataFrame, score: str, hit, by: list[str] | None = None) -> DataFrame:
    """(by..., auc): the chance that a hit scores higher than a miss, ties counting half; null without both."""
    by = by or []
    s = _below(_by_score(df, score, hit, [*by]), by)
    p, n = F.sum("p"), F.sum("n")
    return s.groupBy(*by).agg(F.when((p > 0) & (n > 0), F.sum(F.col("p") * (F.col("cn") + F.col("n") / 2)) / p / n).alias("auc"))


def _long(df: DataFrame, truth: str, probs: str, by: list[str]) -> DataFrame:
    return df.where(F.col(truth).isin(*LABELS)).select(*by, truth, F.posexplode(probs).alias("k", "score"))


def roc_auc(df: DataFrame, truth: str, probs: str, by: list[str] | None = None) -> DataFrame:
    """(by..., roc_auc): the mean over the classes, each against the rest; with two classes in the truth that of the later one,
    with one null."""
    by = by or []
    long = _long(df, truth, probs, by)
    hit = F.array(*map(F.lit, LABELS))[F.col("k")] == F.col(truth)
    each = auc(long, "score", hit, [*by, "k"])
    seen = each.where("auc is not null").groupBy(*by).agg(F.count("*").alias("c"), F.max_by("auc", "k").alias("last"), F.avg("auc").alias("mean"))
    return seen.select(*by, F.when(F.col("c") == 3, F.col("mean")).when(F.col("c") == 2, F.col("last")).alias("roc_auc"))


def roc_curve(df: DataFrame, truth: str, probs: str) -> DataFrame:
    """(s, fpr, tpr) of all classes together, from the highest score; the origin isn't among the rows."""
    s = _below(_by_score(_long(df, truth, probs, []), "score", F.array(*map(F.lit, LABELS))[F.col("k")] == F.col(truth), []), [])
    bins = s.groupBy("_bin").agg(F.sum("p").alias("_p")).withColumn("_pb", F.coalesce(F.sum("_p").over(W.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    below_p = F.col("_pb") + F.coalesce(F.sum("p").over(W.partitionBy("_bin").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    p, n = s.agg(F.sum("p"), F.sum("n")).first()
    share = lambda all_, below: F.when(F.lit(bool(all_)), (F.lit(all_ or 1) - F.col(below)) / F.lit(all_ or 1))
    return s.join(bins.drop("_p"), "_bin").withColumn("cp", below_p).select("s", share(n, "cn").alias("fpr"), share(p, "cp").alias("tpr"))


def micro_auc(df: DataFrame, truth: str, probs: str) -> DataFrame:
    return auc(_long(df, truth, probs, []), "score", F.array(*map(F.lit, LABELS))[F.col("k")] == F.col(truth))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def languages_of(df: DataFrame, language: str, by: list[str]) -> DataFrame:
    """(by..., languages): the languages of each group, sorted; null is none."""
    return df.groupBy(*by).agg(F.sort_array(F.collect_set(language)).alias("languages"))


def nearest_rank(df: DataFrame, value: str, order: list[str], by: list[str], last: int = 50) -> DataFrame:
    """(by..., n, p50, p95) of the last values in the order, without interpolation, to one place.

    Only `last` rows a group are kept while aggregating, in two steps so that a large group is spread."""
    desc = [F.desc(o) for o in order]
    part = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(64)))
    near = part.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_part").orderBy(*desc))).where(f"_r <= {last}")
    near = near.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*desc))).where(f"_r <= {last}")
    a = near.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("v")).withColumn("n", F.size("v"))
    at = lambda k: F.round(F.element_at("v", k + 1), 1)
    return a.select(*by, "n", at(F.floor(F.col("n") / 2).cast("int")).alias("p50"), at(F.least(F.col("n") - 1, F.floor(F.lit(0.95) * (F.col("n") - 1))).cast("int")).alias("p95"))
