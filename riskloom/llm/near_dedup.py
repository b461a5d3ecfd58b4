"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

A document's set holds its distinct five-word shingles; documents link where the Jaccard similarity of
their sets reaches 0.75. Each class of equal sets is represented by its smallest id and signed with
``COORDINATES`` minima. A signature coordinate and its value form a key; representatives are posted
under their keys. Two sets are a candidate pair when at least ``MATCHES`` keys collide. Such a pair must meet under one of
the ``COORDINATES - MATCHES + 1`` rarest keys of both (prefix), so the commonest keys of each document are
skipped and the lists of common passages stay short.

Long lists are merged in star rounds: under every key all members are compared with the member whose
keys are most common, linked members become one component, and only keys that still hold several
components are visited again. What the stars leave is settled across components on the shingles
themselves, by the same prefix rule: no link between different components is lost, and no list is expanded into
pairs that it has already tied or that cannot link.
Candidates are counted on whole signatures and confirmed on the whole shingle sets.

At similarity 0.75 a pair fails to collide in ``MATCHES`` of ``COORDINATES`` keys with probability 1e-7 or less.

Defined cases: null, empty and blank texts have no set, link with nothing and are their own
representative. Rows that repeat a document carry its class each. A row without an id has a null
component and is kept. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.storage import stored
from riskloom.llm.links import components
from riskloom.llm.text import grams, odd_numbers, word_hashes

SHINGLE = 5
COORDINATES = 64
MATCHES = 28
PERCENT = 75
STARS = 1
BROADCAST_IDS = 500_000  # more candidate ids than this are joined by a shuffle
SLICE = 1024


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, one without words none."""
    h = word_hashes(text)
    if not len(h):
        return h
    return np.unique(grams(h, SHINGLE)) if len(h) >= SHINGLE else grams(h, len(h), seed=SHINGLE * 100 + len(h))


class RecentSets(dict):
    """Shingle sets by text, up to a number of shingles in all: a group's members meet again and again."""

    def __init__(self, limit: int = 4_000_000):
        super().__init__()
        self.limit, self.held = limit, 0

    def __missing__(self, text: str) -> np.ndarray:
        found = shingle_set(text)
        if self.held > self.limit:
            self.clear()
            self.held = 0
        self.held += len(found) + len(text) // 8
        self[text] = found
        return found


def signature(shingles: np.ndarray) -> np.ndarray:
    """One key per coordinate: the coordinate in the upper half, its least hash in the lower."""
    a, b = (odd_numbers(COORDINATES, seed).astype(np.uint32) for seed in (11, 13))
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), SLICE):
        least = np.minimum(least, ((x[i:i + SLICE, None] ^ a) * (b | np.uint32(1))).min(axis=0))
    return (np.arange(COORDINATES, dtype=np.int64) << 32) | least.astype(np.int64)


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, set_hash (equal sets only), keys (null without a set)."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_shingles", T.LongType()),
                           T.StructField("set_hash", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, same, keys = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text)
                n.append(len(s))
                same.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "n_shingles", "set_hash", "keys"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def postings(reps: DataFrame) -> DataFrame:
    """(key, id, weight) of the rarest keys of each representative, without keys that nobody shares.

    ``weight`` tells how common the keys of the document are: the centre of a group has the most."""
    posted = reps.select("id", F.explode("keys").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("length")).where("length > 1")
    ranked = (
        posted.join(shared, "key").groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("length", "key"))).alias("shared"), F.sum("length").alias("weight")))
    prefix = F.lit(COORDINATES - MATCHES + 1) - (F.lit(COORDINATES) - F.size("shared"))
    return (ranked.select("id", "weight", F.explode(F.slice("shared", F.lit(1), F.greatest(prefix, F.lit(0)))).alias("s"))
            .select("id", "weight", F.col("s.key").alias("key")))


def alike(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose set sizes allow a link and whose signatures collide often enough."""
    def side(x: str) -> DataFrame:
        return reps.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("keys").alias(f"k_{x}"))

    return (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .where(F.expr(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)"))
        .where(F.size(F.array_intersect("k_a", "k_b")) >= MATCHES)
        .select("a", "b"))


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that link on their full sets; ``texts`` is (id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = RecentSets()
        for batch in batches:
            ok = []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                one, other = sets[ta], sets[tb]
                both = len(np.intersect1d(one, other, assume_unique=True))
                ok.append(100 * both >= PERCENT * (len(one) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"))
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, pairs.select("a", "b").schema)


def _few(ids: DataFrame) -> DataFrame:
    """Broadcast a list of ids if it is short, else leave the join to a shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _star(posts: DataFrame) -> DataFrame:
    """Under each key, pairs of its most central member outside the first component with all members of other components."""
    centre = posts.groupBy("key").agg(F.max_by(F.struct("id", "label"), F.struct("turn", "weight", "id")).alias("c"))
    return (posts.join(centre, "key").where("label <> c.label")
            .select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct())


def shingles(texts: DataFrame) -> DataFrame:
    """(id, g): one row per distinct shingle of each text; ``texts`` is (id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                g = shingle_set(text).view(np.int64)
                at = pa.array(np.full(len(g), i), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(g)], names=["id", "g"])

    return texts.select("id", "text").mapInArrow(
        run, T.StructType([texts.schema["id"], T.StructField("g", T.LongType())]))


def _rest(docs: DataFrame) -> DataFrame:
    """All pairs (a, b) of different components that can still link; ``docs`` is (id, n_shingles, text, label).

    Sets of n and m link only if they share at least s = 3 (n + m) / 7 shingles. With the shingles of every set
    in one order, rarest first, such sets meet within the first n - s + 1 of the one and m - s + 1 of the
    other. A document with many shingles of its own so meets nobody, however common the rest of its text is."""
    each = stored(shingles(docs), "shingles")
    common = each.groupBy("g").agg(F.count("*").alias("c")).where("c > 1")
    sorted_sets = (each.join(common, "g").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "g"))).alias("common")))
    own = F.col("n_shingles") - F.size("common")
    first = F.expr("n_shingles - cast(ceil(n_shingles * 0.75) as int) + 1") - own  # as far as any partner allows
    posts = (
        sorted_sets.join(docs.select("id", "n_shingles", "label"), "id")
        .withColumns({"own": own, "first": F.slice("common", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))})
        .select("id", F.col("n_shingles").alias("n"), "label", "own", F.posexplode("first").alias("place", "s"))
        .select("id", "n", "label", (F.col("own") + F.col("place")).alias("place"), F.col("s.g").alias("g")))
    posts = stored(posts, "prefixes")
    other = posts.select("g", F.col("id").alias("b"), F.col("n").alias("m"), F.col("label").alias("label_b"), F.col("place").alias("place_b"))
    return (posts.join(other, "g").where("id < b AND label <> label_b AND 4 * least(n, m) >= 3 * greatest(n, m)")
            .where("7 * (n - place) >= 3 * (n + m) AND 7 * (m - place_b) >= 3 * (n + m)")
            .select(F.col("id").alias("a"), "b").distinct())


def near_links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between representatives that give the right components; ``docs`` is (id, text)."""
    posts = stored(postings(reps), "posts")
    ids = _few(stored(posts.select("id").distinct(), "ids"))
    near = reps.join(ids, "id", "left_semi").join(docs.join(ids, "id", "left_semi"), "id")
    near = stored(near.select("id", "n_shingles", "keys", "text"), "near")
    links = done = None
    for turn in range(STARS + 1):
        if links is None:
            open_posts = posts.withColumns({"label": F.col("id"), "turn": F.lit(0)})
        else:
            labels = components(links)
            named = (posts.join(labels.withColumnRenamed("node", "id"), "id", "left")
                     .withColumn("label", F.coalesce("label", "id")))
            mixed_keys = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
            # a star round takes its centre outside the component that the key's least label names, by turns
            open_posts = (named.join(mixed_keys, "key")
                          .withColumn("turn", F.when(F.lit(turn % 2 == 1), F.col("label") != F.col("lo"))
                                      .otherwise(F.col("label") != F.col("hi")).cast("int")).drop("lo", "hi"))
            open_posts = stored(open_posts, "open")
        if turn < STARS:
            pairs = alike(_star(open_posts), near)
        else:
            pairs = _rest(near.join(open_posts.select("id", "label").distinct(), "id"))
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if turn and not pairs.limit(1).count():
            if turn == STARS:
                break
            continue
        found = stored(confirm(pairs, near), "links")
        done = pairs if done is None else done.union(pairs)
        links = found if links is None else links.union(found)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (least id that can be reached), kept (the row is that document)."""
    signed = stored(sign(docs, id_col, text_col), "signed")
    classes = (signed.where("n_shingles > 0 AND id IS NOT NULL").groupBy("set_hash", "n_shingles")
               .agg(F.min("id").alias("rep")))
    classes = stored(classes, "classes")
    reps = signed.join(classes.select(F.col("rep").alias("id"), "set_hash"), ["id", "set_hash"], "left_semi").dropDuplicates(["id"])
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    labels = components(near_links(texts, stored(reps, "reps")))
    named = (classes.join(labels, classes["rep"] == labels["node"], "left")
             .select("set_hash", F.coalesce("label", "rep").alias("component_id")))
    return (
        signed.select("id", "n_shingles", "set_hash").join(named, "set_hash", "left")
        .select(F.col("id").alias(id_col), "n_shingles",
                F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that have a near duplicate of smaller id."""
    gone = near_duplicates(docs, id_col, text_col).where("NOT kept").select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")
