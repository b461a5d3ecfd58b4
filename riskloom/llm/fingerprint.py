"""Document fingerprints by a homomorphic multiset hash.

Each paragraph (line) is hashed to a wide vector and a document's fingerprint is the sum of its paragraphs' vectors:
``STRONG`` words modulo 2^64 that tell multisets of paragraphs apart, and ``LANES`` words modulo 2^24 in which each run of ``GRAM`` characters of the paragraph
adds or takes one at a place drawn by its hash. Sums do not depend on order, and ``combine`` adds or removes
paragraphs without the rest of the text. The lanes are a linear sketch, so the cosine of two fingerprints estimates how alike
the texts are; equal fingerprints are alike by 1.

``with_next`` pairs every document with the next one by id: ids are cut into ranges, each range's first document is copied to
the range before, and each range is read in order. One shuffle moves the texts; only range bounds
(``RANGES_PER_PARTITION`` for each shuffle partition) reach the driver.

Defined cases: null is the empty text, whose fingerprint is zero; two empty texts are alike by 1, an empty and another by 0. A null
doc_id comes first. Rows that repeat an id follow each other by a hash of their text. A single document is its own next. Further
columns are ignored. Ids must be numbers.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.text import mixed

STRONG = 4
LANES = 128
MODULUS = 1 << 24
GRAM = 8
RANGES_PER_PARTITION = 4
BASE = 0x9E3779B97F4A7C15


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(strong, lanes): the sum over the paragraphs of a text; nothing for the empty text."""
    strong, lanes = np.zeros(STRONG, np.uint64), np.zeros(LANES, np.int64)
    if not text:
        return strong, lanes
    paragraphs = text.split("\n")
    digests = b"".join(xxhash.xxh3_128_digest(p.encode(), seed) for p in paragraphs for seed in (1, 2))
    strong = np.frombuffer(digests, np.uint64).reshape(-1, STRONG).sum(axis=0, dtype=np.uint64)
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    short = [p for p in paragraphs if 0 < len(p) < GRAM]
    h = np.array([xxhash.xxh64_intdigest(p.encode()) for p in short], np.uint64)
    if len(c) >= GRAM:
        line = np.concatenate([[0], np.cumsum(c == 10)])
        whole = line[GRAM:] == line[:-GRAM]  # runs that do not cross into the next paragraph
        x, step = c, 1
        power = BASE
        while step < GRAM:
            x = x[:-step] * np.uint64(power) + x[step:]
            power, step = power * power % (1 << 64), step * 2
        h = np.concatenate([mixed(x[whole]), h])
    if len(h):
        place, sign = (h >> np.uint64(40)).astype(np.int64) % LANES, (h & np.uint64(1)).astype(np.int64)
        both = np.bincount(place * 2 + sign, minlength=2 * LANES)
        lanes = both[1::2] - both[::2]
    return strong, reduced(lanes)


def reduced(lanes: np.ndarray) -> np.ndarray:
    """Modulo 2^24, as numbers around zero."""
    return (lanes + MODULUS // 2) % MODULUS - MODULUS // 2


def combine(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], remove: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of both multisets of paragraphs, or of the first without the second."""
    if remove:
        return one[0] - other[0], reduced(one[1] - other[1])
    return one[0] + other[0], reduced(one[1] + other[1])


def likeness(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    if np.array_equal(one[0], other[0]) and np.array_equal(one[1], other[1]):
        return 1.0
    a, b = one[1].astype(float), other[1].astype(float)
    norm = float(np.sqrt((a @ a) * (b @ b)))
    return min(1.0, max(0.0, float(a @ b) / norm)) if norm else 0.0


def written(v: tuple[np.ndarray, np.ndarray]) -> str:
    """Base64 of the strong words and of three bytes per lane."""
    lanes = (v[1] % MODULUS).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    return base64.b64encode(v[0].astype("<u8").tobytes() + lanes.tobytes()).decode()


def edit(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many first ones of the following text."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(to, copy, id, text): every document in its range, and behind it the first document of the next range,
    sorted within partitions; ranges do not span partitions."""
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = d.select(F.col("id").cast("double").alias("x")).where("x IS NOT NULL")
    bounds = sorted(set(ids.approxQuantile("x", [i / n for i in range(1, n)], 0.25 / n)))
    splits = [float("-inf"), *(bounds or [0.0]), float("inf")]
    d = (Bucketizer(splits=splits, inputCol="x", outputCol="range", handleInvalid="keep").transform(d.withColumn("x", F.col("id").cast("double")))
         .withColumn("range", F.when(F.col("x").isNull(), -1).otherwise(F.col("range").cast("int"))).drop("x")
         .withColumn("tag", F.xxhash64("text")))
    heads = [(r["range"], r["head"]["id"], r["head"]["tag"]) for r in
             d.groupBy("range").agg(F.min(F.struct("id", "tag")).alias("head")).collect()]  # one row per range
    heads.sort()
    moved = [(r, i, t, heads[k - 1][0]) for k, (r, i, t) in enumerate(heads)]  # the first range's goes to the last
    schema = T.StructType([T.StructField("h_range", T.IntegerType()), T.StructField("h_id", d.schema["id"].dataType),
                           T.StructField("h_tag", T.LongType()), T.StructField("before", T.IntegerType())])
    here = (F.col("range") == F.col("h_range")) & F.col("id").eqNullSafe(F.col("h_id")) & (F.col("tag") == F.col("h_tag"))
    own = F.struct(F.col("range").alias("to"), F.lit(0).alias("copy"))
    copied = F.struct(F.col("before").alias("to"), F.lit(1).alias("copy"))
    d = (d.join(F.broadcast(spark.createDataFrame(moved, schema)), here, "left")  # one row per range
         .withColumn("place", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copied))))
         .select("place.to", "place.copy", "id", "tag", "text"))
    return (d.repartition(max(1, n // RANGES_PER_PARTITION), "to").sortWithinPartitions("to", "copy", F.col("id").asc_nulls_first(), "tag")
            .select("to", "copy", "id", "text"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("n_chars", T.LongType()),
                           *[T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")],
                           *[T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document that waits for its next one
        for batch in batches:
            out: list[list] = [[] for _ in schema.fields]
            for to, copy, i, t in zip(*(c.to_pylist() for c in batch.columns)):
                v = vector(t)
                if held is not None and held[0] == to:
                    _, own_id, own, own_v = held
                    edited = edit(own, t)
                    edited_v = vector(edited)
                    row = (own_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), written(own_v), written(edited_v),
                           likeness(own_v, edited_v), likeness(own_v, v))
                    for column, value in zip(out, row):
                        column.append(value)
                held = None if copy else (to, i, t, v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], batch.column(2).type), pa.array(out[1], pa.int64()),
                 *[pa.array(c, pa.string()) for c in out[2:5]], *[pa.array(c, pa.float64()) for c in out[5:]]],
                names=schema.names)

    return with_next(docs, doc_id, text).mapInArrow(run, schema)
