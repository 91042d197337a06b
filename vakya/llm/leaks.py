"""Problem 8: test passages inside training text.

A positional inverted index, split by documents: each shard holds, for the terms of the test items (others can't match, but take
up their positions), the sorted positions of its occurrences in the shard's documents laid end to end with gaps. The index is a
table, one row per shard; shards are made where the text is read and searched where they are, so nothing is shuffled and no
posting list is gathered.
A search goes from the shard's terms to items: every window of `run` words of an item is entered under the term of it that is rarest
in all items, so a shard looks only at items some window of which it may hold, however many items there are. Of these it takes, from
every window, the term that is rarest in the shard, moves its postings by its offset to where the item would begin, and intersects
them with the neighbours' postings moved likewise. A run of `run` words in a row on one such diagonal is a phrase match; the
item's words within `slack` of it count for proximity.
A proximity match of its own needs no phrase: on some diagonal `share` of the item's words are within `slack`. One of the item's
rarest words must then be among them, so only diagonals near the postings of these are tried, and left once too many words miss.

Items go to the executors in blocks of bounded size, each searched for in all documents; a usual set of test items is one block.
Items and documents with null ids or texts, and items of fewer than `run` words, are in no result. Repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vakya.llm.base import table, words_of

RUN, SLACK, SHARD, SHARE = 13, 8, 400_000, 0.8
#: Words of test items that are sent to the executors at once, about 50 MB.
BLOCK = 1_000_000
INDEX = "doc_ids array<bigint>, starts array<int>, terms array<int>, ends array<int>, positions array<int>"


def read_items(items: DataFrame, run: int = RUN, most: int = BLOCK) -> Iterator[list[tuple[int, list[str]]]]:
    """The test items as words, in blocks of about `most` words."""
    rows = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct().toLocalIterator()
    out, size = [], 0
    for i, t in rows:
        w = words_of(t)
        if len(w) >= run:
            out.append((i, w))
            size += len(w)
            if size >= most:
                yield out
                out, size = [], 0
    if out:
        yield out


class Items:
    """Test items by number of word, and which of them a term of a shard may lead to."""

    def __init__(self, items: list[tuple[int, list[str]]]) -> None:
        self.number: dict[str, int] = {}
        self.all = [(i, np.array([self.number.setdefault(x, len(self.number)) for x in w], np.int32)) for i, w in items]
        self.often = np.bincount(np.concatenate([w for _, w in self.all]), minlength=len(self.number))

    def entries(self, places) -> dict[int, list[int]]:
        """Term to items; places: from a word's frequencies to the places of an item under whose terms it is entered."""
        out: dict[int, list[int]] = {}
        for k, (_, w) in enumerate(self.all):
            for t in {*w[places(self.often[w])].tolist()}:
                out.setdefault(t, []).append(k)
        return out

    def some(self, entries: dict[int, list[int]], terms: list[int]) -> list[tuple[int, np.ndarray]]:
        return [self.all[k] for k in sorted({k for t in terms for k in entries.get(t, ())})]


def _shards(number: dict[str, int], limit: int):
    def row(ids, tokens):
        flat = np.concatenate([np.append(t, -1) for t in tokens]).astype(np.int32)
        starts = np.cumsum([0] + [len(t) + 1 for t in tokens[:-1]]).astype(np.int32)
        at = np.flatnonzero(flat >= 0)
        at = at[np.argsort(flat[at], kind="stable")].astype(np.int32)
        terms, counts = np.unique(flat[at], return_counts=True)
        return {"doc_ids": ids, "starts": starts.tolist(), "terms": terms, "ends": np.cumsum(counts).astype(np.int32), "positions": at}

    names = ["doc_ids", "starts", "terms", "ends", "positions"]
    kinds = [pa.list_(pa.int64())] + [pa.list_(pa.int32())] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.get
        pack = lambda ids, tokens: pa.RecordBatch.from_arrays([pa.array([row(ids, tokens)[n]], k) for n, k in zip(names, kinds)], names=names)
        ids, tokens, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = np.fromiter((get(w, -1) for w in words_of(t)), np.int32)
                ids.append(i)
                tokens.append(words)
                size += len(words) + 1
                if size >= limit:
                    yield pack(ids, tokens)
                    ids, tokens, size = [], [], 0
        if ids:
            yield pack(ids, tokens)

    return run


def build_index(documents: DataFrame, vocabulary: dict[str, int], shard: int = SHARD) -> DataFrame:
    """(doc_id, text) to the index, one row per shard of about `shard` words."""
    rows = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    return rows.mapInArrow(_shards(vocabulary, shard), INDEX)


def _matches(items: Items, run: int, slack: int):
    none = np.zeros(0, np.int64)
    windows_of = np.lib.stride_tricks.sliding_window_view
    entries = items.entries(lambda often: np.unique(np.arange(len(often) - run + 1) + windows_of(often, run).argmin(axis=1)))

    def shard(doc_ids, starts, terms, ends, positions):
        first = np.concatenate(([0], ends[:-1]))
        where = {t: (a, b) for t, a, b in zip(terms.tolist(), first.tolist(), ends.tolist())}
        postings = lambda t: positions[slice(*where[t])] if t in where else none
        for item, w in items.some(entries, terms.tolist()):
            df = np.array([b - a for a, b in (where.get(t, (0, 0)) for t in w.tolist())])
            windows = windows_of(df, run)
            possible = np.flatnonzero(windows.min(axis=1) > 0)
            if not len(possible):
                continue
            anchors = np.unique(possible + windows[possible].argmin(axis=1))
            lists = {}
            found: dict[int, set[int]] = {}
            for a in anchors.tolist():
                begin = postings(int(w[a])).astype(np.int64) - a
                lo, hi = max(0, a - run + 1), min(len(w), a + run)
                streak = np.zeros(len(begin), np.int64)
                best = np.zeros(len(begin), np.int64)
                for o in range(lo, hi):
                    if o not in lists:
                        lists[o] = postings(int(w[o]))
                    p, want = lists[o], begin + o
                    at = np.searchsorted(p, want)
                    hit = np.zeros(len(begin), bool) if not len(p) else p[np.minimum(at, len(p) - 1)] == want
                    streak = (streak + 1) * hit
                    best = np.maximum(best, streak)
                for d in begin[best >= run].tolist():
                    k = int(np.searchsorted(starts, d + a, "right")) - 1
                    found.setdefault(k, set()).add(d)
            for k, ds in found.items():
                begin, near = np.array([*ds]), np.zeros(len(ds), np.int64)
                start, stop = starts[k], starts[k + 1] if k + 1 < len(starts) else 2**31 - 1
                for o, t in enumerate(w.tolist()):
                    near += _within(postings(t), begin + o, slack, start, stop)
                yield int(doc_ids[k]), item, int(near.max())

    return _search(shard)


def _within(p: np.ndarray, at: np.ndarray, slack: int, start, stop) -> np.ndarray:
    """Whether there is a posting within `slack` of each place and in its document."""
    return np.searchsorted(p, np.minimum(stop, at + slack + 1)) > np.searchsorted(p, np.maximum(start, at - slack))


def _need(words, share: float) -> int:
    """How many words of an item a proximity match must hold."""
    return -int(-share * len(words) // 1)


def _near(items: Items, share: float, slack: int):
    none = np.zeros(0, np.int64)
    entries = items.entries(lambda often: np.argsort(often, kind="stable")[: len(often) - _need(often, share) + 1])

    def shard(doc_ids, starts, terms, ends, positions):
        first = np.concatenate(([0], ends[:-1]))
        where = {t: (a, b) for t, a, b in zip(terms.tolist(), first.tolist(), ends.tolist())}
        begins, limits = starts.astype(np.int64), np.append(starts[1:], 2**31 - 1).astype(np.int64)
        positions = positions.astype(np.int64)
        for item, w in items.some(entries, terms.tolist()):
            lists = [positions[slice(*where[t])] if t in where else none for t in w.tolist()]
            need = _need(w, share)
            order = sorted(range(len(w)), key=lambda o: len(lists[o]))
            at = np.concatenate([lists[o] for o in order[: len(w) - need + 1]])
            if not len(at):
                continue
            d = np.concatenate([lists[o] - o for o in order[: len(w) - need + 1]])
            doc = np.searchsorted(begins, at, "right") - 1
            missed = np.zeros(len(d), np.int64)
            for o in order:  # a diagonal that has an anchor near has the rest within twice the slack of the anchor's own
                missed += ~_within(lists[o], d + o, 2 * slack, begins[doc], limits[doc])
                keep = missed <= len(w) - need
                d, doc, missed = d[keep], doc[keep], missed[keep]
                if not len(d):
                    break
            if not len(d):
                continue
            shift = np.arange(-slack, slack + 1)
            both = np.unique(np.stack([np.repeat(doc, len(shift)), (d[:, None] + shift).ravel()]), axis=1)
            doc, d = both
            near = sum(_within(p, d + o, slack, begins[doc], limits[doc]).astype(np.int64) for o, p in enumerate(lists))
            for k in np.unique(doc[near >= need]).tolist():
                yield int(doc_ids[k]), item, int(near[doc == k].max())

    return _search(shard)


def _search(shard):

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in range(b.num_rows):
                out += shard(*(b.column(c)[r].values.to_numpy(zero_copy_only=False) for c in range(5)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else ([], [], []))], names=["doc_id", "item_id", "near_words"])

    return search


def _found(documents: DataFrame, items: DataFrame, run: int, shard: int, search, most: int) -> DataFrame:
    kind, found = "doc_id bigint, item_id bigint, near_words bigint", None
    for block in map(Items, read_items(items, run, most)):
        one = build_index(documents, block.number, shard).mapInArrow(search(block), kind)
        found = one if found is None else found.unionAll(one)
    if found is None:
        found = documents.sparkSession.createDataFrame([], kind)
    return found.groupBy("doc_id", "item_id").agg(F.max("near_words").alias("near_words"))


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, slack: int = SLACK, shard: int = SHARD, most: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, near_words): documents holding `run` words of an item in a row; near_words: the most of the item's words in proximity."""
    return _found(documents, items, run, shard, lambda coded: _matches(coded, run, slack), most)


def near_leaks(documents: DataFrame, items: DataFrame, run: int = RUN, slack: int = SLACK, shard: int = SHARD, share: float = SHARE, most: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, near_words): documents with `share` of an item's words in proximity, whether in a row or not."""
    return _found(documents, items, run, shard, lambda coded: _near(coded, share, slack), most)


def _in(s, d: str) -> tuple[DataFrame, DataFrame]:
    return table(s, d, "documents", "doc_id", "text"), table(s, d, "eval_items", "item_id", "text")


QUERIES = {
    "p8_near": lambda s, d: near_leaks(*_in(s, d)),
    "p8_found": lambda s, d: leaks(*_in(s, d)).select("doc_id", "item_id"),
    "p8_items": lambda s, d: leaks(*_in(s, d)).groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("near_words").alias("most_near_words")),
}
_grams_sql = lambda name, table, key: f"{name} AS (SELECT DISTINCT {key}, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS w FROM {table} WHERE {key} IS NOT NULL AND text IS NOT NULL), range(1, len(w) - 11) t(k))"
_leaks_sql = f"WITH {_grams_sql('d', 'documents', 'doc_id')}, {_grams_sql('i', 'eval_items', 'item_id')}, l AS (SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g))"
SQL = {"p8_found": _leaks_sql + " SELECT doc_id, item_id FROM l"}
