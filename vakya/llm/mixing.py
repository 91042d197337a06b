"""Problem 9: a mix of sources with target weights.

Each source's documents are shuffled by a random key per pass and laid end to end; of this line as many tokens as the source's
share are taken and cut into blocks of equal size, so a document at an edge goes on in the next block, as a piece of its own. A low-discrepancy sequence (multiples of the golden ratio, modulo 1) goes through the
cumulative weights and gives each slot of the mix a source; the k-th slot of a source takes its k-th block. So any stretch of
the mix has close to the target shares, whatever the order of the input.

Running totals go over bins of keys first and then within a bin, so no source is summed up by one task; slots are ranked within
chunks in the same way. Sizes are in words split at blanks unless a tokenizer's file is given.

Null and blank texts have size 0 and are never used; documents of sources without targets count in the total only. A source
without documents gets nothing and falls short if its target is above 0. Documents are told apart by doc_id; repeated rows of one
count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vakya.llm.base import release, table, tokenizers, written

BLANKS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
GOLDEN = (math.sqrt(5) - 1) / 2
TOKENIZER = "byte_bpe_50k.json"


def token_counter(path: str):
    """Column function: the number of tokens by a tokenizer's file."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        for s in batches:
            yield pd.Series([len(e.ids) for e in t.encode_batch(s.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    return count


def word_count(text: str):
    return F.size(F.filter(F.split(F.col(text), BLANKS), lambda x: x != "")).cast("bigint")


def sized(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source, text) to one row per document with its size."""
    size = token_counter(tokenizer)("text") if tokenizer else F.when(F.col("text").isNull(), F.lit(0)).otherwise(word_count("text"))
    d = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "source", size.cast("bigint").alias("size"))
    return d.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("size").alias("size"))


def shares(sizes: DataFrame, targets: DataFrame) -> tuple[list[dict], int]:
    """Per source of the targets, the operator's specification: its tokens, how many of them the mix takes, and in how many passes. The
    mix is half of all. With it, all tokens."""
    spark, of = sizes.sparkSession, targets.collect()
    names = spark.createDataFrame([(r["source"],) for r in of], "source string").distinct()
    counts = written(sizes.groupBy("source").agg(F.sum("size").alias("n")))
    have = {r["source"]: r["n"] for r in counts.join(names, "source", "left_semi").collect()}
    total = counts.agg(F.sum("n")).first()[0] or 0
    release(counts)
    out = []
    for r in of:
        tokens, part = have.get(r["source"], 0) or 0, (r["target_permille"] or 0) * total
        supply = tokens * max(0, r["max_repeats"] or 0)
        take = min(-(-part // 2000), supply)
        out.append({"source": r["source"], "target_permille": r["target_permille"], "supply": supply, "take": take, "passes": -(-take // tokens) if tokens else 0})
    return out, total


def schedule(sizes: DataFrame, plan: list[dict], block: int = 8192, seed: int = 42) -> DataFrame:
    """(source, block, place, doc_id, pass, first_token, n_tokens): the pieces of documents taken, by block and place in their source."""
    spark = sizes.sparkSession
    to = spark.createDataFrame([(p["source"], p["take"], p["passes"]) for p in plan if p["take"] > 0], "source string, take bigint, passes int")
    docs = sizes.where("size > 0").join(to, "source")
    docs = docs.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1))).withColumn("key", F.xxhash64("doc_id", "pass", F.lit(seed))).withColumn("bin", F.shiftrightunsigned("key", 50))
    docs = written(docs.select("doc_id", "source", "take", "size", "pass", "key", "bin"))
    earlier = W.partitionBy("source").orderBy("pass", "bin").rowsBetween(W.unboundedPreceding, -1)
    bins = docs.groupBy("source", "pass", "bin").agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    within = W.partitionBy("source", "pass", "bin").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))
    placed = docs.join(bins, ["source", "pass", "bin"]).withColumn("start", start).withColumn("stop", F.least("take", F.col("start") + F.col("size"))).where("start < stop")
    pieces = placed.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (stop - 1) div {block})")))
    a, b = F.greatest("start", F.col("block") * block), F.least("stop", (F.col("block") + 1) * block)
    return pieces.select("source", "block", a.alias("place"), "doc_id", "pass", (a - F.col("start")).alias("first_token"), (b - a).alias("n_tokens"))


def slots(spark, plan: list[dict], block: int = 8192, chunk: int = 100_000) -> DataFrame:
    """(slot, source, block): the order of the sources' blocks."""
    of = [(p["source"], -(-p["take"] // block), p["take"]) for p in plan if p["take"] > 0]
    total = sum(n for _, n, _ in of)
    n = total + total // 50 + 100 * len(of)
    weights = np.cumsum([float(g) for *_, g in of] or [1.0])
    names = pa.array([name for name, *_ in of] or [None], pa.string())

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = (b.column(0).to_numpy() + 0.5) * GOLDEN % 1
            at = np.minimum(np.searchsorted(weights, u * weights[-1], "right"), len(weights) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), names.take(pa.array(at))], names=["slot", "source"])

    points = spark.range(n).mapInArrow(pick, "slot bigint, source string").withColumn("chunk", F.expr(f"slot div {chunk}"))
    base = points.groupBy("source", "chunk").count().withColumn("base", F.coalesce(F.sum("count").over(W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    rank = F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")) - 1
    return points.withColumn("k", rank).join(base, ["source", "chunk"]).select("slot", "source", (F.col("base") + F.col("k")).alias("block"))


def _mixed(sizes: DataFrame, plan: list[dict], block: int, seed: int) -> DataFrame:
    last = F.lit(2**62) + F.col("block")
    taken = schedule(sizes, plan, block, seed).join(slots(sizes.sparkSession, plan, block), ["source", "block"], "left")
    return taken.select(F.coalesce("slot", last).alias("slot"), "place", "doc_id", "source", "pass", "first_token", "n_tokens")


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None, block: int = 8192, seed: int = 42) -> DataFrame:
    """(slot, place, doc_id, source, pass, first_token, n_tokens): the mix in the order of slot and place; every slot but a source's last holds
    `block` tokens. Blocks that the sequence has no slot for (it is off by a few at most) come last."""
    sizes = written(sized(documents, tokenizer))
    return _mixed(sizes, shares(sizes, targets)[0], block, seed)


def mix_report(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None, block: int = 8192, seed: int = 42) -> DataFrame:
    """Per source: target, the tokens needed and the supply with all repeats, what the mix made holds, its share of it, and whether it falls short."""
    sizes = written(sized(documents, tokenizer))
    plan, total = shares(sizes, targets)
    of = sizes.sparkSession.createDataFrame([(p["source"], p["target_permille"], (p["target_permille"] or 0) * total / 2000, p["supply"]) for p in plan], "source string, target_permille int, needed double, supply bigint")
    held = _mixed(sizes, plan, block, seed).groupBy("source").agg(F.sum("n_tokens").alias("held"))
    r = of.join(held, "source", "left").fillna(0, ["held"])
    return r.withColumn("share_permille", F.round(F.try_divide(1000 * F.col("held"), F.sum("held").over(W.partitionBy())), 6)).withColumn("short", F.col("held") < F.col("needed"))


def _in(s, d: str) -> tuple[DataFrame, DataFrame]:
    return table(s, d, "documents", "doc_id", "source", "text"), table(s, d, "mix_targets")


QUERIES = {
    "p9_found": lambda s, d: mix_report(*_in(s, d)).where("short").select("source"),
    "p9_report": lambda s, d: mix_report(*_in(s, d)),
    "p9_report_tokens": lambda s, d: mix_report(*_in(s, d), tokenizer=f"{tokenizers(s)}/{TOKENIZER}"),
    "p9_mix": lambda s, d: mix(*_in(s, d)),
}
_sizes_sql = """
WITH sizes AS (SELECT doc_id, min(source) AS source, max(coalesce(len(list_filter(string_split_regex(text, '[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda x: x <> '')), 0)) AS size FROM documents GROUP BY doc_id),
have AS (SELECT source, sum(size) AS n FROM sizes GROUP BY source),
r AS (SELECT t.source, t.target_permille, t.target_permille * (SELECT sum(size) FROM sizes) AS part, coalesce(h.n, 0) * t.max_repeats AS supply FROM mix_targets t LEFT JOIN have h USING (source))"""
SQL = {
    "p9_found": _sizes_sql + " SELECT source FROM r WHERE 2000 * supply < part",
    "p9_report": _sizes_sql + """,
q AS (SELECT *, least((part + 1999) // 2000, supply) AS held FROM r)
SELECT source, target_permille, part / 2000 AS needed, supply::BIGINT AS supply, held::BIGINT AS held, round(1000 * held / sum(held) OVER (), 6) AS share_permille, held < part / 2000 AS short FROM q""",
}
