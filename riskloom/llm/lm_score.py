"""Language-model scores from a log-frequency Bloom filter.

Tokens are words, A-Z lower-cased, and one end token per text. All training texts are counted, single tokens and pairs. The model
keeps quantised counts only: an n-gram seen c times is in the filter at levels 1 .. 1 + floor(log2 c), and its level is read
by probing one level after the other. A token's probability mixes the pair's share of its context with the smoothed share of the token;
pair counts are rounded down and context counts up, so probabilities of a context do not exceed 1 but for false
positives.

The filter is cut into segments by the n-gram's hash; segments grow in number with the corpus, and each has as many bits as its counted
n-grams need at ``LOAD``, so every n-gram is kept whatever the corpus holds. The filter is never in one place: texts are stored as chunks of
tokens, tasks pre-aggregate the n-grams of each chunk, one shuffle brings the cells of a segment together, and the task that counts a segment
fills its part of the filter and reads from it the levels of all n-grams that the chunks asked for. A second shuffle takes the levels back to the chunks.
The base score uses exact counts: tokens among the ``HEAD`` most frequent are
looked up in a broadcast table, the others are joined by a shuffle, so nothing depends on the vocabulary fitting in memory.

Defined cases: a null text is empty and has the end token only. Without training texts all counts are 0. Repeated rows
count and are scored each. A row with a null id is learned from. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.storage import stored
from riskloom.llm.text import mixed, odd_numbers, word_hashes

PROBES = 4
LOAD = 0.45  # share of set bits that filling aims at
HEAD = 1 << 20
CHUNK = 1_000_000  # tokens of a chunk, and its last few texts
CHUNK_TEXTS = 100  # texts that join a chunk at once
BATCH_SEGMENTS = 16  # segments in one Arrow batch of partial counts
SEGMENT_CHARS = 4_000_000  # characters of text per segment
MAX_SEGMENTS = 1 << 14
PAIR_WEIGHT = 0.4
ADDED = 0.1
LEVELS = 50
END = np.uint64(0xE0F)  # hash of the end token


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts one after the other, number of tokens of each)."""
    out = [np.append(word_hashes(t), END) for t in texts]
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array([len(x) for x in out], np.int64)


def pairs(token: np.ndarray, end: np.uint64) -> np.ndarray:
    """Hash of each token and the one before it; a text's first token follows an end."""
    a, b = odd_numbers(2, 23)
    return mixed(np.concatenate([[end], token[:-1]]).astype(np.uint64) * a + token * b)


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return (h >> np.uint64(64 - (segments.bit_length() - 1))).astype(np.int64) if segments > 1 else np.zeros(len(h), np.int64)


def within(h: np.ndarray, segments: int) -> np.ndarray:
    """The 40 bits of a hash that follow its segment."""
    return (h >> np.uint64(24 - (segments.bit_length() - 1))) & np.uint64((1 << 40) - 1)


def chunks_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(ids, held, sizes, tokens, places, chunk): the texts in chunks of about ``CHUNK`` tokens. ``tokens`` are the chunk's distinct hashes in order,
    ``places`` says for each token which it is."""
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.LongType())),
                           T.StructField("tokens", T.BinaryType()), T.StructField("places", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, sizes, waiting, n = [], [], [], [], 0

        def chunk() -> pa.RecordBatch:
            u, where = np.unique(np.concatenate(waiting), return_inverse=True)
            values = [pa.concat_arrays(ids), pa.concat_arrays(held), pa.array(np.concatenate(sizes))]
            rows = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values]
            planes = where.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()  # the upper bytes are mostly zeros and compress
            return pa.RecordBatch.from_arrays([*rows, pa.array([u.tobytes()], pa.binary()), pa.array([planes], pa.binary())], names=schema.names)

        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK_TEXTS):
                b = batch.slice(i, CHUNK_TEXTS)
                token, size = tokens(b.column(2).to_pylist())
                for has, new in ((ids, b.column(0)), (held, b.column(1)), (sizes, size), (waiting, token)):
                    has.append(new)
                n += len(token)
                if n > CHUNK:
                    yield chunk()
                    ids, held, sizes, waiting, n = [], [], [], [], 0
        if n:
            yield chunk()

    held_out = F.coalesce(remainder(doc_id, 10) == 0, F.lit(False)).alias("held_out")
    return stored(docs.select(doc_id, held_out, text).mapInArrow(run, schema).withColumn("chunk", F.monotonically_increasing_id()), "chunks")


def unpacked(token: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, which of them each token is) of a stored chunk."""
    return np.frombuffer(token, np.uint64), np.ascontiguousarray(np.frombuffer(places, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def counted(chunks: DataFrame, segments: int) -> DataFrame:
    """(segment, chunk, tokens, n_tokens, pairs, n_pairs): the distinct n-grams of every chunk, sorted by hash, and how often its training texts have
    each; n-grams of held-out texts only have 0. Pairs keep 40 bits of their hash within the segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, held, sizes, t, places in zip(*(batch.column(i) for i in range(5))):
                u, where = unpacked(t.as_buffer(), places.as_buffer())
                seen = np.repeat(~held.values.to_numpy(zero_copy_only=False), sizes.values.to_numpy())
                c = np.bincount(where[seen], minlength=len(u)).astype(np.uint32)
                p, which = np.unique(pairs(u[where], END), return_inverse=True)
                pc = np.bincount(which[seen], minlength=len(p)).astype(np.uint32)
                e, pe = (np.searchsorted(segment_of(h, segments), np.arange(segments + 1)) for h in (u, p))
                low = within(p, segments)
                upper, lower = (low >> np.uint64(32)).astype(np.uint8), low.astype(np.uint32)
                for first in range(0, segments, BATCH_SEGMENTS):
                    rows = range(first, min(first + BATCH_SEGMENTS, segments))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(rows, pa.int32()), pa.array([chunk.as_py()] * len(rows), pa.int64()),
                        pa.array([u[e[i]:e[i + 1]].tobytes() for i in rows], pa.binary()), pa.array([c[e[i]:e[i + 1]].tobytes() for i in rows], pa.binary()),
                        pa.array([upper[pe[i]:pe[i + 1]].tobytes() + lower[pe[i]:pe[i + 1]].tobytes() for i in rows], pa.binary()),
                        pa.array([pc[pe[i]:pe[i + 1]].tobytes() for i in rows], pa.binary())], names=["segment", "chunk", "tokens", "n_tokens", "pairs", "n_pairs"])

    return (chunks.select("chunk", "held", "sizes", "tokens", "places")
            .mapInArrow(run, "segment int, chunk long, tokens binary, n_tokens binary, pairs binary, n_pairs binary"))


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, their counts, which of them each key is)."""
    u, where = np.unique(np.concatenate(keys), return_inverse=True)
    return u, np.bincount(where, weights=np.concatenate(counts), minlength=len(u)).astype(np.int64), where


def level_of(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(count)).astype(np.int64)


def _spots(key: np.ndarray, level: int, probe: int, bits: int) -> np.ndarray:
    salt = odd_numbers(LEVELS * PROBES, 29)[level * PROBES + probe]
    return (mixed(key ^ salt) >> np.uint64(20)).astype(np.int64) % bits


def bits_for(counts: np.ndarray) -> int:
    """Bits that hold all levels of n-grams with these counts at the aimed load."""
    units = int(level_of(counts).sum()) if len(counts) else 0
    return 64 * (1 + math.ceil(-units * PROBES / math.log(1 - LOAD) / 64))


def filled(keys: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """One segment with every n-gram."""
    spots = np.zeros(bits, bool)
    levels = level_of(counts) if len(counts) else np.zeros(0, np.int64)
    for level in range(1, int(levels.max(initial=0)) + 1):
        at = keys[levels >= level]
        for probe in range(PROBES):
            spots[_spots(at, level, probe, bits)] = True
    return np.packbits(spots, bitorder="little").tobytes()


def single(keys: np.ndarray) -> np.ndarray:
    """Keys of single tokens, apart from those of pairs."""
    return keys ^ np.uint64(0x5A5A5A5A5A)


@dataclass
class Model:
    """One segment of the filter; how many training tokens it has, and how many distinct ones."""

    filter: np.ndarray
    segment: int
    total: int
    distinct: int

    def levels(self, key: np.ndarray) -> np.ndarray:
        """Level of each n-gram, given by its bits within the segment; 0 if it is not in the filter."""
        bits = 8 * len(self.filter)
        out, alive = np.zeros(len(key), np.int64), np.arange(len(key))
        for level in range(1, LEVELS):
            for probe in range(PROBES):
                at = _spots(key[alive], level, probe, bits)
                alive = alive[(self.filter[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            if not len(alive):
                break
            out[alive] = level
        return out


def log10(u: np.ndarray, where: np.ndarray, one: np.ndarray, two: np.ndarray, denominator: float) -> np.ndarray:
    """log10 probability of each token of a chunk after the one before it, from the levels of its distinct tokens and pairs."""
    share = (np.where(one > 0, 2.0 ** (one - 1.0), 0.0) + ADDED) / denominator
    before = np.concatenate([[np.searchsorted(u, END)], where[:-1]])  # every chunk has ends
    both = two[np.unique(pairs(u[where], END), return_inverse=True)[1]]
    context = one[before]
    follows = np.where((both > 0) & (context > 0), np.minimum(1.0, 2.0 ** (both - 1.0 - context)), 0.0)
    return np.log10(PAIR_WEIGHT * follows + (1 - PAIR_WEIGHT) * share[where])


def segments_for(chars: int) -> int:
    wanted = max(1, -(-chars // SEGMENT_CHARS))
    return min(MAX_SEGMENTS, max(16, 1 << (wanted - 1).bit_length()))


def learned(segment: int, segments: int, tokens: list[np.ndarray], n_tokens: list[np.ndarray], pairs: list[np.ndarray], n_pairs: list[np.ndarray]) -> tuple[Model, tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """(the segment's model, its exact token counts, the level of each given token, that of each given pair)."""
    (u, c, at), (p, m, p_at) = merged(tokens, n_tokens), merged(pairs, n_pairs)
    seen, key = c > 0, np.concatenate([single(within(u, segments)), p])
    count = np.concatenate([c, m])
    known = count[count > 0]
    model = Model(np.frombuffer(filled(key[count > 0], known, bits_for(known)), np.uint8), segment, int(c.sum()), int(seen.sum()))
    levels = model.levels(key).astype(np.uint8)
    return model, (u[seen], c[seen]), levels[:len(u)][at], levels[len(u):][p_at]


def train(chunks: DataFrame, segments: int) -> DataFrame:
    """Per segment a row (segment, total, distinct, h, c) with the exact token counts; per segment and chunk a row (segment, chunk, one, two) with the levels that
    the filter holds of the chunk's tokens and pairs, sorted by hash."""
    def merge(table: pa.Table) -> pa.Table:
        columns = [[], [], [], []]
        for t, n, p, m in zip(*(table[c].to_pylist() for c in ("tokens", "n_tokens", "pairs", "n_pairs"))):
            k = len(m) // 4
            low = (np.frombuffer(p[:k], np.uint8).astype(np.uint64) << np.uint64(32)) | np.frombuffer(p[k:], np.uint32)
            for has, new in zip(columns, (np.frombuffer(t, np.uint64), np.frombuffer(n, np.uint32), low, np.frombuffer(m, np.uint32))):
                has.append(new)
        segment = table["segment"][0].as_py()
        model, (h, c), one, two = learned(segment, segments, *columns)
        split = [[x.tobytes() for x in np.split(levels, np.cumsum([len(x) for x in own])[:-1])] for levels, own in ((one, columns[0]), (two, columns[2]))]
        n = table.num_rows
        return pa.table({"segment": pa.array([segment] * (n + 1), pa.int32()), "chunk": pa.array([None, *table["chunk"].to_pylist()], pa.int64()),
                         "total": pa.array([model.total] + [None] * n, pa.int64()), "distinct": pa.array([model.distinct] + [None] * n, pa.int64()),
                         "h": pa.array([h.view(np.int64)] + [None] * n, pa.list_(pa.int64())), "c": pa.array([c] + [None] * n, pa.list_(pa.int64())),
                         "one": pa.array([None, *split[0]], pa.binary()), "two": pa.array([None, *split[1]], pa.binary())})

    return stored(counted(chunks, segments).groupBy("segment").applyInArrow(
        merge, "segment int, chunk long, total long, distinct long, h array<long>, c array<long>, one binary, two binary"), "segments")


def head_of(counts: DataFrame, most: int = HEAD) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the highest count levels, ``most`` at most, sorted by hash."""
    by_level = {r["l"]: r["n"] for r in counts.groupBy(F.floor(F.log2("c")).alias("l")).agg(F.count("*").alias("n")).collect()}
    level, n = max(by_level, default=0) + 1, 0
    while level > 0 and n + by_level.get(level - 1, 0) <= most:
        level -= 1
        n += by_level.get(level, 0)
    found = counts.where(F.col("c") >= (1 << level)).toArrow()
    h, c = found["h"].to_numpy().astype(np.int64).view(np.uint64), found["c"].to_numpy().astype(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    chunks = chunks_of(docs, doc_id, text)
    made = train(chunks, segments_for(docs.agg(F.sum(F.length(text))).first()[0] or 0))
    counts = made.where("chunk IS NULL").select(F.explode(F.arrays_zip("h", "c")).alias("x")).select("x.h", "x.c")
    total, distinct = made.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    denominator = total + ADDED * (distinct + 1)
    shared = docs.sparkSession.sparkContext.broadcast(head_of(counts))
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), T.StructField("held_out", T.BooleanType()),
                           *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")],
                           *[T.StructField(c, T.DoubleType()) for c in ("base", "score")],
                           T.StructField("rare", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])

    def score(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        head, head_counts = shared.value
        u, where = unpacked(chunk["tokens"][0].as_buffer(), chunk["places"][0].as_buffer())
        answers = answers.sort_by("segment")
        one, two = (np.frombuffer(b"".join(answers[c].to_pylist()), np.uint8).astype(np.int64) for c in ("one", "two"))
        sizes = chunk["sizes"][0].values.to_numpy()
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at = np.searchsorted(head, u).clip(max=max(0, len(head) - 1))
        known = head[at] == u if len(head) else np.zeros(len(u), bool)
        base = np.where(known, np.log10((head_counts[at] + ADDED) / denominator), 0.0) if len(head) else np.zeros(len(u))
        known, token = known[where], u[where]
        rare = [np.unique(t[~k], return_counts=True) for t, k in zip(np.split(token, starts[1:]), np.split(known, starts[1:]))]
        return pa.table([chunk["ids"][0].values, chunk["held"][0].values, pa.array(sizes), pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                         pa.array(np.add.reduceat(base[where], starts)), pa.array(np.add.reduceat(log10(u, where, one, two, denominator), starts)),
                         pa.array([u.view(np.int64) for u, _ in rare], pa.list_(pa.int64())), pa.array([n for _, n in rare], pa.list_(pa.int64()))], names=schema.names)

    first = chunks.groupBy("chunk").cogroup(made.where("chunk IS NOT NULL").select("chunk", "segment", "one", "two").groupBy("chunk")).applyInArrow(score, schema)
    first = stored(first.withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = (
        first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), "x.times")
        .join(counts, "h", "left")
        .groupBy("row").agg(
            F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + ADDED) / F.lit(denominator))).alias("more"),
            F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("also")))
    return (
        first.drop("rare", "times").join(rest, "row", "left")
        .select(F.col("id").alias(doc_id), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"),
                F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score"))
