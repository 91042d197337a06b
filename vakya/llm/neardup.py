"""Problem 7: posts that share most of their words.

Exact for distinct words of the plain form (see looks.py): all pairs with |A & B| >= t |A | B| and different word sequences.

1. Each post becomes a digest of its word sequence, 64-bit hashes of its distinct words and a 256-bit parity sketch of them.
2. Words are ordered by how many posts hold them, as far as a table of fixed size tells (any order that is the same for all posts
   will do), then by hash. Two similar posts share a word among the first n - ceil(t n) + 1 of each, so posts meet under those, their
   rarest, words only. Words of one post are dropped as they pass by. Of posts with one word sequence only the first goes on.
   Where the first shared word stands bounds what can be shared; pairs below that bound need no look.
3. Posts under a word are compared bit-sliced: one bit of all sketches is one plane, mismatches are added to all distances at
   once by carry-save counters, and a block is abandoned when every distance exceeds its radius. Sketches differ in at most
   |A - B| + |B - A| bits and similar posts in at most (|A| + |B|)(1 - t)/(1 + t) words, so no pair is lost.
   A word with more than `block` posts is split into blocks, compared pairwise in as many tasks.
4. The pairs left are compared word by word, then joined with the posts that have their word sequences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vakya.llm.base import Sieve, check_broadcast, not_blank, release, table, word_pattern, written
from vakya.llm.formatdup import components
from vakya.llm.looks import transducer

BITS = 256


def _bags(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, word = transducer().form, word_pattern()
        known: dict[str, int] = {}
        for b in batches:
            ids, seqs, flat, sizes = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = word.findall(form(t).lower())
                own = set(w)
                if len(own) < least:
                    continue
                for x in own:
                    h = known.get(x)
                    if h is None:
                        if len(known) > 200_000:
                            known.clear()
                        h = known[x] = xxhash.xxh3_64_intdigest(x) - 2**63
                    flat.append(h)
                sizes.append(len(own))
                ids.append(i)
                seqs.append(xxhash.xxh3_128_digest("\x1f".join(w)))
            words, n = np.array(flat, np.int64), np.array(sizes, np.int64)
            cell = np.repeat(np.arange(len(n)), n) * BITS + (words & (BITS - 1))
            bits = (np.bincount(cell, minlength=len(n) * BITS) & 1).astype(np.uint8).reshape(-1, BITS)
            sketch = [x.tobytes() for x in np.packbits(bits, axis=1, bitorder="little")]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(words))
            low = [int.from_bytes(x[:4], "big") for x in seqs]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seqs, pa.binary()), pa.array(low, pa.int64()), pa.array(n, pa.int32()), pa.array(sketch, pa.binary()), lists], names=["id", "seq", "low", "n", "sketch", "words"])

    return run


def _keys(often: np.ndarray, t: float):
    """The words under which a post meets others: its rarest. often: how common the words of each cell are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(ends)), ends)
            order = np.lexsort((flat, often[flat >> 8 & (len(often) - 1)], row))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)
            first = ends - np.ceil(t * ends - 1e-9).astype(np.int64) + 1
            early = place < np.repeat(first, ends)
            pick = order[early]
            yield pa.RecordBatch.from_arrays([pa.array(flat[pick]), b.column(0).take(pa.array(row[pick])), pa.array(place[early].astype(np.int32))], names=["word", "id", "place"])

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by word, of words that several rows hold. The last row of a batch may wait for the next batch."""
    wait = None
    for b in batches:
        if not b.num_rows:
            continue
        w = b.column(0).to_numpy()
        same = w[1:] == w[:-1]
        keep = np.append(False, same) | np.append(same, False)
        if wait is not None and w[0] == wait.column(0)[0].as_py():
            keep[0] = True
            if not wait_told:
                yield wait
        yield b.filter(pa.array(keep))
        wait, wait_told = b.slice(b.num_rows - 1), bool(keep[-1])


def close_lanes(xor: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Which rows of `xor` (bytes) have at most `radius` bits. Rows are lanes; a plane holds one bit of all of them."""
    lanes = len(xor)
    planes = np.packbits(np.unpackbits(xor, axis=1).T, axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.pad(planes, ((0, 0), (0, -planes.shape[1] % 8)))).view(np.uint64)
    levels = int(radius.max() + 1).bit_length()
    start = (1 << levels) - 1 - radius  # counters overflow just beyond the radius
    words = planes.shape[1]
    pack = lambda x: np.pad(y := np.packbits(x, bitorder="little"), (0, words * 8 - len(y))).view(np.uint64)
    count = [pack(start >> j & 1) for j in range(levels)]
    over = ~pack(np.ones(lanes, np.uint8))
    for p in range(len(planes)):
        carry = planes[p]
        for j in range(levels):
            count[j], carry = count[j] ^ carry, count[j] & carry
        over |= carry
        if p & 15 == 15 and (over == 2**64 - 1).all():
            return np.zeros(lanes, bool)
    return np.unpackbits((~over).view(np.uint8), bitorder="little")[:lanes].astype(bool)


def close_sketches(sizes: list[int], bits: np.ndarray, t: float, right: list[bool] | None = None) -> list[tuple[int, int]]:
    """Index pairs whose sketches are within the radius. With `right`, only pairs across the two sides."""
    m = len(sizes)
    order = sorted(range(m), key=sizes.__getitem__)
    n, bits = [sizes[i] for i in order], bits[order]
    planes = [int.from_bytes(c.tobytes(), "little") for c in np.packbits(bits.T.copy(), axis=1, bitorder="little")]
    everyone = (1 << m) - 1
    side = sum(1 << k for k, i in enumerate(order) if right[i]) if right else 0
    out, ratio, hi = [], (1 - t) / (1 + t), 0
    for k in range(m - 1):
        most = math.floor(n[k] / t + 1e-9)
        while hi < m and n[hi] <= most:
            hi += 1
        alive = (1 << hi) - 1 >> (k + 1) << (k + 1)
        if right:
            alive &= everyone ^ side if right[order[k]] else side
        if not alive:
            continue
        radius = math.floor((n[k] + n[hi - 1]) * ratio + 1e-9)
        levels = (radius + 1).bit_length()
        start = (1 << levels) - 1 - radius  # counters overflow just beyond the radius
        count = [alive if start >> j & 1 else 0 for j in range(levels)]
        mine = bits[k].tolist()
        for p in range(BITS):
            carry = (planes[p] ^ everyone if mine[p] else planes[p]) & alive
            for j in range(levels):
                if not carry:
                    break
                count[j], carry = count[j] ^ carry, count[j] & carry
            if carry:
                alive &= ~carry
                if not alive:
                    break
        while alive:
            low = alive & -alive
            alive ^= low
            out.append((order[k], order[low.bit_length() - 1]))
    return out


def _compare(t: float, small: int = 256, chunk: int = 1 << 15):
    ratio, most = (1 - t) / (1 + t), t / (1 + t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, held = [], [], 0

        def emit(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[s] for p in pairs], pa.binary()) for s in (0, 1)], names=["seq_a", "seq_b"])

        def together(seq, n, place, sketch, block, key):
            """The pairs of one word."""
            nonlocal held
            m = len(n)
            cross = key[1] != key[2]
            if m <= small:
                i, j = np.triu_indices(m, 1)
                lo, hi = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                ok = (lo >= t * hi - 1e-9) & (np.minimum(n[i] - place[i], n[j] - place[j]) >= most * (lo + hi) - 1e-9)
                if cross:
                    ok &= block[i] != block[j]
                i, j = i[ok], j[ok]
                if len(i):
                    lanes.append((sketch[i] ^ sketch[j], np.floor((n[i] + n[j]) * ratio + 1e-9).astype(np.int64)))
                    left.append(seq[i])
                    right.append(seq[j])
                    held += len(i)
                return []
            bits = np.unpackbits(sketch, axis=1, bitorder="little")
            pairs = close_sketches(n.tolist(), bits, t, (block != key[1]).tolist() if cross else None)
            return [(min(a, b), max(a, b)) for a, b in ((bytes(seq[i]), bytes(seq[j])) for i, j in pairs) if a != b]

        def flush():
            nonlocal held
            if not held:
                return []
            xor, radius = np.concatenate([x for x, _ in lanes]), np.concatenate([r for _, r in lanes])
            a, b = np.concatenate(left), np.concatenate(right)
            out = []
            for k in range(0, len(xor), chunk):
                at = k + np.flatnonzero(close_lanes(xor[k : k + chunk], radius[k : k + chunk]))
                out += [(min(x, y), max(x, y)) for x, y in zip(map(bytes, a[at]), map(bytes, b[at])) if x != y]
            lanes.clear(), left.clear(), right.clear()
            held = 0
            return out

        lanes: list = []
        rest = None  # rows of the word that the next batch may go on with
        for b in batches:
            if rest is not None:
                b = pa.concat_batches([rest, b])
            if not b.num_rows:
                continue
            rest, found = _solve_batch(b, together, False)
            if held >= chunk:
                found += flush()
            yield emit(found)
        if rest is not None:
            yield emit(_solve_batch(rest, together, True)[1])
        yield emit(flush())

    return run


def _solve_batch(b: pa.RecordBatch, together, last: bool) -> tuple[pa.RecordBatch, list]:
    """Hand each word's rows (word, i, j, seq, n, place, sketch, block; sorted) on, but for the last word's unless it's the end."""
    key = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)])
    cuts = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [b.num_rows]))
    ends = len(cuts) - 1 if last else len(cuts) - 2
    seq = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(b.num_rows, -1)
    n, place = b.column(4).to_numpy().astype(np.int64), b.column(5).to_numpy().astype(np.int64)
    sketch = np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint8).reshape(b.num_rows, -1)
    block, found = b.column(7).to_numpy(), []
    for k in range(ends):
        s = slice(cuts[k], cuts[k + 1])
        if cuts[k + 1] - cuts[k] > 1:
            found += together(seq[s], n[s], place[s], sketch[s], block[s], key[:, cuts[k]])
    return b.slice(cuts[ends]), found


def _near_sequences(posts: DataFrame, t: float, least: int, block: int, cells: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, text) to pairs of near sequences (seq_a, seq_b), the rows (id, seq) of these, and the rows (id, seq) of all posts with enough words.

    Posts with null ids, null or blank texts or fewer than `least` distinct words are in no pair; a repeated id counts once.
    What is broadcast is one byte for each of `cells` (a power of 2; as many as posts, 4 million at most) and a sieve of 32 MB at most."""
    rows = posts.where(F.col("id").isNotNull() & not_blank("text")).select("id", "text")
    bags = written(rows.mapInArrow(_bags(least), "id bigint, seq binary, low bigint, n int, sketch binary, words array<bigint>"))
    cells = cells or 1 << min(22, max(16, bags.count().bit_length()))
    counts = bags.select(F.explode("words").alias("w")).groupBy(F.expr(f"w >> 8 & {cells - 1}").cast("int").alias("cell")).count()
    counts = counts.select("cell", F.least(F.lit(255), F.round(8 * F.log2("count"))).cast("smallint").alias("n")).toArrow()
    often = np.zeros(cells, np.uint8)
    check_broadcast(cells)
    often[counts["cell"].to_numpy()] = counts["n"].to_numpy().astype(np.uint8)
    keys = bags.select("id", "words").mapInArrow(_keys(often, t), "word bigint, id bigint, place int")
    keys = keys.repartition("word").sortWithinPartitions("word").mapInArrow(_met, "word bigint, id bigint, place int")
    first = bags.groupBy("seq").agg(F.min("id").alias("id"))
    stand = bags.select("id", "seq", "n", "sketch").join(first.withColumnRenamed("seq", "first_seq"), "id").where("seq = first_seq").drop("first_seq").dropDuplicates(["id"])
    met = written(keys.distinct().join(stand, "id").select("word", "seq", "n", "place", "sketch"))
    hot = met.groupBy("word").agg(F.count("*").alias("m")).where(f"m > {block}").select("word", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    if hot.isEmpty():
        tasks = met.select("word", F.lit(0).alias("i"), F.lit(0).alias("j"), "seq", "n", "place", "sketch", F.lit(0).alias("block")).repartition("word")
    else:
        split = met.join(hot, "word", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("seq"), F.col("blocks")).cast("int"))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        tasks = split.select("word", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "seq", "n", "place", "sketch", "block").repartition("word", "i", "j")
    close = tasks.sortWithinPartitions("word", "i", "j").mapInArrow(_compare(t), "seq_a binary, seq_b binary").distinct()
    close = written(close)
    release(met)
    sides = written(close.select(F.explode(F.array("seq_a", "seq_b")).alias("seq")).distinct())
    low = F.conv(F.hex(F.substring("seq", 1, 4)), 16, 10).cast("bigint")
    likely = Sieve(sides.select(low.alias("low")), "low").pass_through(bags.select("id", "seq", "low", "n", "words"), "low").drop("low")
    held = written(likely.join(sides, "seq", "left_semi"))
    release(sides)
    one = held.dropDuplicates(["seq"])
    a, b = (one.select(F.col("seq").alias(f"seq_{x}"), F.col("n").alias(f"n_{x}"), F.col("words").alias(f"words_{x}")) for x in "ab")
    shared = F.size(F.array_intersect("words_a", "words_b"))
    pairs = close.join(a, "seq_a").join(b, "seq_b").withColumn("shared", shared).where(f"shared >= {t} * (n_a + n_b - shared) - 1e-9").select("seq_a", "seq_b")
    return pairs, held.select("id", "seq"), bags.select("id", "seq")


def near_pairs(posts: DataFrame, t: float = 0.8, least: int = 10, block: int = 2048, cells: int | None = None) -> DataFrame:
    """(id, text) to (id_a, id_b), the smaller first: see the module's text."""
    pairs, held, _ = _near_sequences(posts, t, least, block, cells)
    x, y = (held.select(F.col("id").alias(k), F.col("seq").alias(f"seq_{k}")).distinct() for k in "ab")
    return pairs.join(x, "seq_a").join(y, "seq_b").select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).where("id_a < id_b").distinct()


def near_classes(posts: DataFrame, t: float = 0.8, least: int = 10, block: int = 2048, cells: int | None = None) -> DataFrame:
    """(id, text) to (id, class_id, n_links), one row per id: the least id that near pairs and equal word sequences lead to, and the
    number of posts with another word sequence that are near.

    Each sequence is stood for by its least id, so a class of many copies is a few edges. A post in no pair is a class of its own or of its copies."""
    pairs, _, bags = _near_sequences(posts, t, least, block, cells)
    pairs = written(pairs)
    first = written(bags.groupBy("seq").agg(F.min("id").alias("first"), F.count_distinct("id").alias("n_posts")))
    both = pairs.unionAll(pairs.select(F.col("seq_b").alias("seq_a"), F.col("seq_a").alias("seq_b")))
    links = both.join(first.select(F.col("seq").alias("seq_b"), "n_posts"), "seq_b").groupBy(F.col("seq_a").alias("seq")).agg(F.sum("n_posts").alias("n_links"))
    a, b = (first.select(F.col("seq").alias(f"seq_{x}"), F.col("first").alias(x)) for x in "ab")
    moved = components(pairs.join(a, "seq_a").join(b, "seq_b").select("a", "b"))
    of = bags.select("id", "seq").join(first.join(links, "seq", "left").drop("n_posts"), "seq").groupBy("id").agg(F.min("first").alias("class_id"), F.max("n_links").alias("n_links"))
    if moved is not None:
        of = of.join(moved.withColumnRenamed("node", "class_id"), "class_id", "left").select("id", F.coalesce("least", "class_id").alias("class_id"), "n_links")
    ids = posts.where("id is not null").select("id").distinct()
    return ids.join(of, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _posts(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dataset").select("id", F.col("post_text").alias("text"))


QUERIES = {"p7_found": lambda s, d: near_pairs(_posts(s, d)), "p7_classes": lambda s, d: near_classes(_posts(s, d))}
