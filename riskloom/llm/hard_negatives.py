"""Hard negatives for anchors and their positives, scores bounded by segment summaries.

A row's score is its inner product with the anchor. Cut into segments, a vector is known by the mean and the deviation (the length of what is left
without the mean) of each: over a segment of w components a product lies within w * mean * mean' ± deviation * deviation', and the sum of these
bounds the score. Summaries are stored with each row for a few wide segments and for more narrow ones (``LEVELS``). Pairs that the wide segments cannot rule out are
bounded by the narrow ones, and only what then remains is scored in whole numbers. What rules a pair out: it cannot reach the fifth best score that the task has
found for the anchor (or for the anchor and positive), or it lies outside what the anchor's positives allow.

All rows are held against all anchors, which are a stated hundredth of the rows, in blocks: a block of anchors is broadcast, ``BLOCK_BYTES`` at most,
every task runs over its rows and gives back five rows per anchor (and positive), and a window takes the first five of those. First positives, then, with their scores, negatives. The driver holds
one block and its positives; the number of blocks grows with the anchors.

Defined cases: rows with a null id, label or vector, or with a component that is null or not finite take no part. Only vectors of the same length have a score; an
empty vector's score is 0. Every row stands for itself: a repeated row is another row, and a repeated anchor is an anchor of its own, with equal results. Ties go to the smaller id.
Components and scores beyond 64 bits are held at the largest whole number. Without anchors, positives or rows in range nothing comes back. Further columns, with any names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.scan import global_index
from riskloom.functions.storage import new_path, stored

LEVELS = (4, 16)
FIRST = 5
BLOCK_BYTES = 16 << 20
ROWS = 2048  # rows held against
ANCHORS = 512  # anchors at once
PAIRS = 50_000  # single products at once
EXACT = 2.0 ** 53
BOTTOM, MOST = -(1 << 63), (1 << 63) - 1  # of a score


def segments(n: int, parts: int) -> np.ndarray:
    """Where each of ``parts`` segments of n components starts; fewer where there are not so many components."""
    return np.unique(np.linspace(0, n, min(parts, n), endpoint=False).astype(np.int64))


def summary(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, segments): means, times the root of the segment's width, and deviations."""
    if not x.shape[1]:
        return np.zeros((len(x), 0)), np.zeros((len(x), 0))
    starts = segments(x.shape[1], parts)
    width = np.diff(np.append(starts, x.shape[1]))
    mean = np.add.reduceat(x, starts, axis=1) / width
    rest = x - np.repeat(mean, width, axis=1)
    return mean * np.sqrt(width), np.sqrt(np.add.reduceat(rest * rest, starts, axis=1))


@dataclass
class Vectors:
    """Rows of equal length: keys, ids, labels, whole components and their summary per level."""

    key: np.ndarray
    id: np.ndarray
    label: np.ndarray
    x: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]

    def part(self, at: slice) -> "Vectors":
        return Vectors(self.key[at], self.id[at], self.label[at], self.x[at], [(m[at], d[at]) for m, d in self.levels])


def vectors(batch: pa.RecordBatch | pa.Table) -> Iterator[Vectors]:
    """The rows of a stored batch, by length."""
    lists = [batch.column(c).combine_chunks() if isinstance(batch, pa.Table) else batch.column(c) for c in range(batch.num_columns)]
    key, ids, label = (c.to_numpy(zero_copy_only=False) for c in lists[:3])
    sizes = lists[3].value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        x, mean, dev = (c.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1) for c in lists[3:])
        ends = np.cumsum([len(segments(n, p)) for p in LEVELS])
        levels = [(mean[:, e - k:e], dev[:, e - k:e]) for e, k in zip(ends, np.diff(ends, prepend=0))] if n else []
        yield Vectors(key[at], ids[at], label[at], x, levels)


def prepared(rows: DataFrame) -> DataFrame:
    """The rows that take part, with whole components and summaries, stored: key, vec_id, label, x, mean, dev (all levels after each other)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == n))
                x = lists.take(at).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n).astype(np.float64)
                found = [summary(x, p) for p in LEVELS]
                both = [np.concatenate(y, axis=1) for y in zip(*found)]
                packed = [pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel())) for y in both]
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), lists.take(at), *packed], names=["vec_id", "label", "x", "mean", "dev"])

    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))  # not NaN either, which is the largest
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    found = kept.select(F.col("vec_id").cast("long"), label.alias("label"), whole.alias("x")).mapInArrow(
        run, "vec_id long, label long, x array<long>, mean array<double>, dev array<double>")
    return stored(found.select(F.monotonically_increasing_id().alias("key"), "*"), "vectors")


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of chosen pairs; of all, when a good part is chosen."""
    if 8 * len(i) >= len(a) * len(b):
        return (a @ b.T)[i, j]
    return np.concatenate([np.einsum("pk,pk->p", a[i[k:k + PAIRS]], b[j[k:k + PAIRS]]) for k in range(0, len(i), PAIRS)] or [np.zeros(0)])


def _scores(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    x, y = a.astype(np.float64), b.astype(np.float64)
    if not len(i) or np.sqrt((x * x).sum(1).max()) * np.sqrt((y * y).sum(1).max()) < EXACT:
        return _products(x, y, i, j).astype(np.int64)
    exact = (sum(p * q for p, q in zip(a[r].tolist(), b[s].tolist())) for r, s in zip(i, j))
    return np.array([min(max(e, -MOST), MOST) for e in exact], np.int64)


def within(rows: Vectors, anchors: Vectors, chosen: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of the chosen pairs whose score lies between the anchor's bounds: refined level by level, then scored."""
    i, j = np.nonzero(chosen)
    for (mean, dev), (mean2, dev2) in zip(rows.levels, anchors.levels):
        middle, reach = _products(mean, mean2, i, j), _products(dev, dev2, i, j)
        slack = 1e-6 + 1e-9 * (np.abs(middle) + reach)
        open_ = (middle + reach + slack >= low[j]) & (np.minimum(middle - reach - slack, MOST) <= high[j])
        i, j = i[open_], j[open_]
    score = _scores(rows.x, anchors.x, i, j)
    inside = (score >= low[j]) & (score <= high[j])
    return i[inside], j[inside], score[inside]


class Best:
    """The first five rows by score and id of each slot, and the score that a further row must reach."""

    def __init__(self, slots: int):
        self.slots = slots
        self.held = tuple(np.zeros(0, np.int64) for _ in range(4))  # slot, score, id, key
        self.least = np.full(slots, BOTTOM, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, key: np.ndarray) -> None:
        good = score >= self.least[slot]
        if not good.any():
            return
        all_ = [np.concatenate([h, n[good]]) for h, n in zip(self.held, (slot, score, ids, key))]
        order = np.lexsort((all_[3], all_[2], ~all_[1], all_[0]))
        slot = all_[0][order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = order[place < FIRST]
        self.held = tuple(h[kept] for h in all_)
        fifth = order[place == FIRST - 1]
        self.least[all_[0][fifth]] = all_[1][fifth]


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[Vectors]:
    """The rows, few at first so that a bound is soon known."""
    size = 128
    for b in batches:
        i = 0
        while i < b.num_rows:
            yield from vectors(b.slice(i, size))
            i, size = i + size, min(ROWS, 2 * size)


def _parts(block: list[Vectors]) -> list[Vectors]:
    return [v.part(slice(i, i + ANCHORS)) for v in block for i in range(0, len(v.key), ANCHORS)]


FOUND = "anchor long, slot long, score long, vec_id long, key long"


def _out(names: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in names], names=["anchor", "slot", "score", "vec_id", "key"])


def _first(found: DataFrame) -> DataFrame:
    """The first five of what the tasks gave for each anchor and slot, with their rank."""
    by = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "key")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= FIRST)


def positives(rows: DataFrame, block: list[Vectors]) -> DataFrame:
    """anchor (its key), score, vec_id, key, rank of the first rows of each anchor's label."""
    shared = rows.sparkSession.sparkContext.broadcast(block)  # BLOCK_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _parts(shared.value)
        best = [Best(len(a.key)) for a in anchors]
        for v in _sliced(batches):
            for a, b in zip(anchors, best):
                if a.x.shape[1] == v.x.shape[1]:
                    chosen = (v.label[:, None] == a.label) & (v.key[:, None] != a.key)
                    i, j, score = within(v, a, chosen, b.least, np.full(len(a.key), MOST))
                    b.add(j, score, v.id[i], v.key[i])
        for a, b in zip(anchors, best):
            slot, score, ids, key = b.held
            yield _out([a.key[slot], 0 * slot, score, ids, key])

    return _first(rows.mapInArrow(run, FOUND))


def negatives(rows: DataFrame, block: list[Vectors], caps: dict[int, list[int]]) -> DataFrame:
    """anchor, slot, score, vec_id, key, rank: the first rows of other labels that a positive allows; ``caps``: an anchor's positive scores, by slot."""
    shared = rows.sparkSession.sparkContext.broadcast((block, caps))  # BLOCK_BYTES and five numbers an anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, caps = shared.value
        anchors = _parts(block)
        most = [np.array([(caps.get(k, []) + [-1] * FIRST)[:FIRST] for k in a.key.tolist()], np.int64).reshape(-1, FIRST) for a in anchors]
        # a cap below 0 allows nothing: four fifths of it lie above it
        least = [np.where(m < 0, MOST, m - m // 5) for m in most]
        best = [Best(FIRST * len(a.key)) for a in anchors]
        for v in _sliced(batches):
            for a, m, l, b in zip(anchors, most, least, best):
                if a.x.shape[1] != v.x.shape[1]:
                    continue
                known = b.least.reshape(-1, FIRST)
                i, j, score = within(v, a, v.label[:, None] != a.label, np.maximum(l, known).min(1), m.max(1))
                for slot in range(FIRST):
                    ok = (score <= m[j, slot]) & (score >= l[j, slot])
                    b.add(FIRST * j[ok] + slot, score[ok], v.id[i[ok]], v.key[i[ok]])
        for a, b in zip(anchors, best):
            slot, score, ids, key = b.held
            yield _out([a.key[slot // FIRST], slot % FIRST, score, ids, key])

    return _first(rows.mapInArrow(run, FOUND))


def mine(rows: DataFrame, every: int = 100) -> DataFrame:
    """Per anchor (an id divisible by ``every``) and positive of ``rows`` (vec_id, label, embedding): the hard negatives, as anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    base = prepared(rows)
    anchors = stored(global_index(base.where(F.col("vec_id") % every == 0), ["vec_id", "key"], "at"), "anchors")
    count, longest = anchors.agg(F.count("*"), F.max(F.size("x"))).first()
    share = max(1, BLOCK_BYTES // (8 * (longest or 0) + 16 * sum(LEVELS) + 64))
    path = new_path(spark, "hard-negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for start in range(0, count, share):
        told = anchors.where(F.col("at").between(start, start + share - 1)).select(*base.columns).toArrow()  # BLOCK_BYTES at most
        block = list(vectors(told))
        known = stored(positives(base, block), "positives")
        caps: dict[int, list[int]] = {}
        for r in known.orderBy("anchor", "rank").toArrow().to_pylist():  # five rows an anchor of the block
            caps.setdefault(r["anchor"], []).append(r["score"])
        found = negatives(base, block, caps).select("anchor", (F.col("slot") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        ids = base.where(F.col("vec_id") % every == 0).select(F.col("key").alias("anchor"), F.col("vec_id").alias("anchor_id"))
        pairs = known.select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(ids, "anchor")
        (pairs.join(found, ["anchor", "place"])
         .select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path))
    return spark.read.schema(schema).parquet(path)
