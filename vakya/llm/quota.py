"""Problem 3: a sample with given shares of each category.

Quotas come from controlled rounding: the fractional table of targets, its first key in rows and the others in columns, is made
whole by a flow with lower bounds, so that each cell and each margin is its target rounded up or down. A cell's minimum is a lower
bound of its flow too. Where minima don't fit into a margin, the margin is exceeded, by as little as can be in all (a flow of
least cost), and reported. Each cell then takes its quota of the ids with the smallest random keys, exactly: a histogram of key
prefixes finds the prefix where the quota ends, and only the rows of that prefix are ranked. The report counts what was drawn.

Values match trimmed and ignoring case. Rows with a null in a key belong to no cell but count in the total; a repeated id counts
once (with the least of its cells, should they differ); null ids are no rows. Cells without targets aren't sampled. The table of
targets, the operator's specification, is read by the driver.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vakya.llm.base import release, table, written

KEYS = ("platform", "topic", "ground_truth_sentiment")
# Short forms of sentiments.
SHORT = {"neg": "negative", "neu": "neutral", "pos": "positive"}


class Flow:
    """A network: arcs in pairs, forth and back, with what is left of their capacity."""

    def __init__(self, n: int) -> None:
        self.at: list[list[int]] = [[] for _ in range(n)]
        self.head: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []

    def arc(self, u: int, v: int, capacity: int, cost: int = 0) -> int:
        for x, y, c, k in ((u, v, capacity, cost), (v, u, 0, -cost)):
            self.at[x].append(len(self.head))
            self.head.append(y)
            self.left.append(c)
            self.cost.append(k)
        return len(self.head) - 2

    def fill(self, s: int, t: int) -> int:
        """The most that arcs without cost carry: blocking flows over shortest ways."""
        total = 0
        while True:
            level = {s: 0}
            queue = deque([s])
            while queue:
                u = queue.popleft()
                for k in self.at[u]:
                    if self.left[k] and not self.cost[k] and self.head[k] not in level:
                        level[self.head[k]] = level[u] + 1
                        queue.append(self.head[k])
            if t not in level:
                return total
            nxt = dict.fromkeys(level, 0)
            way, u = [], s
            while True:
                if u == t:
                    most = min(self.left[k] for k in way)
                    for k in way:
                        self.left[k] -= most
                        self.left[k ^ 1] += most
                    total += most
                    cut = next(i for i, k in enumerate(way) if not self.left[k])
                    u = self.head[way[cut] ^ 1]
                    del way[cut:]
                    continue
                while nxt[u] < len(self.at[u]):
                    k = self.at[u][nxt[u]]
                    if self.left[k] and not self.cost[k] and level.get(self.head[k]) == level[u] + 1:
                        break
                    nxt[u] += 1
                if nxt[u] < len(self.at[u]):
                    way.append(self.at[u][nxt[u]])
                    u = self.head[way[-1]]
                elif way:
                    u = self.head[way.pop() ^ 1]
                    nxt[u] += 1
                else:
                    break

    def pay(self, s: int, t: int) -> int:
        """What more goes with the arcs that cost, along the cheapest ways, so that the cost stays least."""
        total = 0
        while True:
            best, came, queue, waits = {s: 0}, {}, deque([s]), {s}
            while queue:
                u = queue.popleft()
                waits.discard(u)
                for k in self.at[u]:
                    v = self.head[k]
                    if self.left[k] and best[u] + self.cost[k] < best.get(v, math.inf):
                        best[v], came[v] = best[u] + self.cost[k], k
                        if v not in waits:
                            waits.add(v)
                            queue.append(v)
            if t not in best:
                return total
            way, v = [], t
            while v != s:
                way.append(came[v])
                v = self.head[came[v] ^ 1]
            most = min(self.left[k] for k in way)
            for k in way:
                self.left[k] -= most
                self.left[k ^ 1] += most
            total += most


def controlled_rounding(cells: dict[tuple, float], least: dict[tuple, int] | None = None) -> dict[tuple, int]:
    """Whole numbers for {(row, column): x}: each is x rounded up or down, and so are the sums of rows, columns and all. A cell in
    `least` gets that at least; where sums can't hold then, they exceed their bounds by as little as possible in all."""
    least = least or {}
    rows, cols = sorted({r for r, _ in cells}), sorted({c for _, c in cells})
    near = lambda x: round(x) if abs(x - round(x)) < 1e-6 else x
    node = {("r", r): i for i, r in enumerate(rows)} | {("c", c): len(rows) + i for i, c in enumerate(cols)}
    s, t = len(node), len(node) + 1
    big_s, big_t = t + 1, t + 2
    flow, extra, any_more = Flow(big_t + 1), [0] * (big_t + 1), sum(least.values()) + 1

    def bounded(u: int, v: int, lo: int, hi: int, beyond: bool = False) -> int:
        extra[v] += lo
        extra[u] -= lo
        k = flow.arc(u, v, hi - lo)
        if beyond and least:
            flow.arc(u, v, any_more, 1)
        return k

    low = {k: max(math.floor(near(x)), least.get(k, 0)) for k, x in cells.items()}
    own = {k: bounded(node["r", k[0]], node["c", k[1]], low[k], max(math.ceil(near(x)), low[k])) for k, x in cells.items()}
    sums = {n: 0.0 for n in node}
    for (r, c), x in cells.items():
        sums["r", r] += x
        sums["c", c] += x
    for (side, name), x in sums.items():
        lo, hi = math.floor(near(x)), math.ceil(near(x))
        bounded(*((s, node[side, name]) if side == "r" else (node[side, name], t)), lo, hi, True)
    bounded(t, s, math.floor(near(sum(cells.values()))), math.ceil(near(sum(cells.values()))), True)
    for v, x in enumerate(extra):
        if x > 0:
            flow.arc(big_s, v, x)
        elif x < 0:
            flow.arc(v, big_t, -x)
    flow.fill(big_s, big_t)
    if least:
        flow.pay(big_s, big_t)
    return {k: low[k] + flow.left[own[k] + 1] for k in cells}


def _canonical(c: str):
    x = F.lower(F.trim(F.col(c)))
    return F.coalesce(F.create_map([F.lit(y) for p in SHORT.items() for y in p])[x], x) if c == KEYS[-1] else x


def _cells(posts: DataFrame) -> DataFrame:
    """One row per id: its cell, null where a key is null."""
    c = posts.where(F.col("id").isNotNull()).select("id", F.struct(*(_canonical(k).alias(k) for k in KEYS)).alias("cell"))
    return c.groupBy("id").agg(F.min("cell").alias("cell"))


REPORT = ", ".join(f"{k} string" for k in KEYS) + ", target_permille int, min_rows int, needed bigint, quota bigint, available bigint"


def _plan(posts: DataFrame, targets: DataFrame, one_in: int) -> tuple[DataFrame, DataFrame, list[dict]]:
    """The ids with their cells, a row per cell of targets with its quota, and the margins."""
    spark = posts.sparkSession
    ids = written(_cells(posts).select("id", *(F.col(f"cell.{k}").alias(k) for k in KEYS)))
    counts = written(ids.groupBy(*KEYS).agg(F.count("*").alias("available")))
    n = (counts.agg(F.sum("available")).first()[0] or 0) // one_in
    cells = targets.collect()
    plain = lambda r: tuple(str(r[k] or "").strip().lower() for k in KEYS)
    small = spark.createDataFrame([plain(r) for r in cells] or [("",) * 3], ", ".join(f"{k} string" for k in KEYS)).distinct()
    known = {tuple(r[k] for k in KEYS): r["available"] for r in counts.join(small, [*KEYS], "left_semi").collect()}
    release(counts)
    place = lambda r: (plain(r)[0], plain(r)[1:])
    x = {place(r): (r["target_permille"] or 0) * n / 1000 for r in cells}
    least = {place(r): r["min_rows"] for r in cells if (r["min_rows"] or 0) > 0}
    quota = controlled_rounding(x, least)
    rows = [(*(r[k] for k in KEYS), r["target_permille"], r["min_rows"] or 0, max((r["target_permille"] or 0) * n // 1000, r["min_rows"] or 0), quota[place(r)], known.get(plain(r), 0)) for r in cells]
    margins = []
    for side, part in enumerate((lambda k: k[0], lambda k: " / ".join(k[1]))):
        want, got = {}, {}
        for k in x:
            want[part(k)], got[part(k)] = want.get(part(k), 0.0) + x[k], got.get(part(k), 0) + quota[k]
        margins += [(("platform", "topic / ground_truth_sentiment")[side], k, v, got[k], got[k] > math.ceil(v - 1e-6)) for k, v in want.items()]
    return ids, spark.createDataFrame(rows, REPORT), margins


def _draw(ids: DataFrame, report: DataFrame, seed: int) -> DataFrame:
    to = report.select(*(F.lower(F.trim(k)).alias(k) for k in KEYS), *(F.col(k).alias(f"as_{k}") for k in KEYS), F.least("quota", "available").alias("take"))
    keyed = ids.join(to, [*KEYS]).withColumn("key", F.xxhash64("id", F.lit(seed))).withColumn("prefix", F.shiftrightunsigned("key", 50))
    before = W.partitionBy(*KEYS).orderBy("prefix").rowsBetween(W.unboundedPreceding, -1)
    steps = keyed.groupBy(*KEYS, "prefix", "take").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    steps = steps.where("before < take").withColumn("whole", F.expr("before + n <= take")).drop("n", "take")
    met = keyed.join(steps, [*KEYS, "prefix"])
    edge = met.where("not whole").withColumn("rank", F.row_number().over(W.partitionBy(*KEYS, "prefix").orderBy("key", "id"))).where("rank <= take - before").drop("rank")
    return met.where("whole").unionByName(edge).select("id", *(F.col(f"as_{k}").alias(k) for k in KEYS))


def quota_sample(posts: DataFrame, targets: DataFrame, one_in: int = 10, seed: int = 42) -> DataFrame:
    """(id, platform, topic, ground_truth_sentiment) of the sample, the keys as the targets write them."""
    ids, report, _ = _plan(posts, targets, one_in)
    return _draw(ids, report, seed)


def quota_report(posts: DataFrame, targets: DataFrame, one_in: int = 10, seed: int = 42) -> DataFrame:
    """One row per cell of targets: what's needed, its quota, what is available, what the sample drawn holds, and whether that falls short."""
    ids, report, _ = _plan(posts, targets, one_in)
    drawn = _draw(ids, report, seed).groupBy(*KEYS).agg(F.count("*").alias("taken"))
    return report.join(drawn, [*KEYS], "left").fillna(0, ["taken"]).withColumn("short", F.col("taken") < F.col("needed"))


def quota_margins(posts: DataFrame, targets: DataFrame, one_in: int = 10) -> DataFrame:
    """(margin, value, target, quota, exceeded): the sums of the quotas, and where minima made them larger than their target rounded up."""
    return posts.sparkSession.createDataFrame(_plan(posts, targets, one_in)[2], "margin string, value string, target double, quota bigint, exceeded boolean")


def _posts(s, d: str) -> DataFrame:
    return table(s, d, "dataset", "id", *KEYS)


QUERIES = {
    "p3_found": lambda s, d: quota_report(_posts(s, d), table(s, d, "sample_targets")).where("short").select(*KEYS),
    "p3_report": lambda s, d: quota_report(_posts(s, d), table(s, d, "sample_targets")).select(*KEYS, "target_permille", "needed", "available", "short"),
    "p3_margins": lambda s, d: quota_margins(_posts(s, d), table(s, d, "sample_targets")),
    "p3_sample": lambda s, d: quota_sample(_posts(s, d), table(s, d, "sample_targets")),
}
_report_sql = """
WITH ids AS (
  SELECT DISTINCT id, lower(trim(platform)) AS p, lower(trim(topic)) AS t,
    CASE lower(trim(ground_truth_sentiment)) WHEN 'neg' THEN 'negative' WHEN 'neu' THEN 'neutral' WHEN 'pos' THEN 'positive' ELSE lower(trim(ground_truth_sentiment)) END AS s
  FROM dataset WHERE id IS NOT NULL),
n AS (SELECT count(DISTINCT id) // 10 AS n FROM ids),
have AS (SELECT p, t, s, count(DISTINCT id) AS available FROM ids GROUP BY ALL),
r AS (
  SELECT g.platform, g.topic, g.ground_truth_sentiment, g.target_permille, greatest(g.target_permille * n.n // 1000, g.min_rows) AS needed, coalesce(h.available, 0) AS available
  FROM sample_targets g CROSS JOIN n LEFT JOIN have h ON h.p = lower(trim(g.platform)) AND h.t = lower(trim(g.topic)) AND h.s = lower(trim(g.ground_truth_sentiment)))
"""
SQL = {
    "p3_found": _report_sql + "SELECT platform, topic, ground_truth_sentiment FROM r WHERE available < needed",
    "p3_report": _report_sql + "SELECT platform, topic, ground_truth_sentiment, target_permille, needed, available, available < needed AS short FROM r",
}
