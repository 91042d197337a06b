"""Reading posts: CSV, JSON fixtures, literals and tables; samples."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vakya.functions.text import require_columns

POSTS = "id bigint, platform string, topic string, post_text string, ground_truth_sentiment string, sentiment_score double, reference_translation string"


def resolve(path: str, base: str) -> str:
    """An absolute path as it is, else below the current folder if it's there, else below `base`."""
    p = Path(path)
    return str(p if p.is_absolute() else p.resolve() if p.exists() else Path(base) / p)


def read_posts_csv(spark: SparkSession, path: str, schema: str | None = POSTS, required: tuple[str, ...] = ("post_text", "ground_truth_sentiment")) -> DataFrame:
    """A CSV file of posts (quoted fields may hold line ends; a byte order mark is dropped). Columns beyond the schema are kept as text.

    Raises FileNotFoundError for a missing local file and ValueError for one without rows or required columns."""
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(path)
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*(c.lstrip("﻿") for c in raw.columns))
    require_columns(raw, *required)
    if raw.isEmpty():
        raise ValueError(f"{path} has no rows")
    kinds = dict(x.strip().split(" ") for x in schema.split(",")) if schema else {}
    return raw.select(*(F.col(f"`{c}`").try_cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in raw.columns))


def read_posts_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file with an array `posts`, one row per element."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("posts").alias("p")).select("p.*")


def from_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(pos, post_text) of a request's texts."""
    return spark.createDataFrame([(texts,)], "texts array<string>").select(F.posexplode("texts").alias("pos", "post_text"))


def from_requests(requests: DataFrame) -> DataFrame:
    """Requests with an array `texts`, one row per text with its position and the request's other columns."""
    return requests.select(*[c for c in requests.columns if c != "texts"], F.posexplode("texts").alias("pos", "post_text"))


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows, the same for a seed however the data are laid out; all if there are no more. A histogram of the random keys' prefixes finds
    where the sample ends; only the rows of that prefix are ranked, so a sample of any size stays where its rows are."""
    d = df.withColumn("_k", F.xxhash64(key, F.lit(seed))).withColumn("_p", F.shiftrightunsigned("_k", 50))
    steps = d.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # 16,384 prefixes
    met = d.join(F.broadcast(steps.where(F.col("_before") < n)), "_p")
    edge = met.where(F.col("_before") + F.col("_n") > n).withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy("_k", key))).where(F.col("_r") <= n - F.col("_before"))
    return met.where(F.col("_before") + F.col("_n") <= n).select(*df.columns).unionByName(edge.select(*df.columns))
