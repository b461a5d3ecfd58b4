"""Mixing sources to target weights with exact quotas per output shard.

A document's size is its number of words. Sources in code point order, null last, weigh 3, 1, 2, 3, 1, 2, ...; together they
get 150 % of all sizes, none more than twice its own, and what is above is shared again by weight. Documents are cut
into blocks of ``BLOCK`` words. A source's blocks have a fixed random order, and its quota is the run of that order,
passed through a second time if need be, that comes to its target; so nothing is taken more than twice.

The quotas, in blocks, are then dealt to the output shards by a splitting tree: the root holds the blocks of all
sources, and each node gives its left half a multivariate hypergeometric draw of its own, by one law at every size. Every shard so has exact block
quotas and the composition of a random sample. A shard's blocks are the next ones of each source's order, so shards are disjoint;
within a shard blocks are ordered by a hash.

Blocks are narrow rows (no text). Positions in the order of a source are found by adding the totals of earlier hash ranges, so a source with
a third of all rows is spread over ``RANGES`` ranges. Only one row per source reaches the driver, ``MAX_SOURCES`` at most.

Defined cases: a null or empty text has size 0 and takes nothing. Rows that repeat a doc_id are
distinct documents whose blocks are told apart by their text; equal rows take the same amount each. A null doc_id is an id like any other.
If all sizes are 0, all targets are 0. Further columns are ignored.
"""

from __future__ import annotations

import math
from decimal import Decimal, localcontext

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.storage import stored

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BLOCK = 128
SHARDS = 64
RANGES = 1024
MAX_SOURCES = 1_000_000
SEED = 7
LIBRARY = 10**9
PI = Decimal("3.1415926535897932384626433832795028841971693993751")
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def size_of(text: str) -> Column:
    """Number of words of a text column, 0 for null."""
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "^" + WORD_BREAK, "")
    return F.when(t == "", 0).otherwise(F.size(F.split(F.regexp_replace(t, WORD_BREAK + "$", ""), WORD_BREAK))).cast("long")


def targets(sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Shares of ``SHARE`` times the total by weight, each ``MOST`` times its size at most, the excess shared again."""
    sizes, out = sizes.astype(float), np.zeros(len(sizes))
    free, left = sizes > 0, SHARE * float(sizes.sum())
    while free.any():
        share = left * weights / weights[free].sum()
        full = free & (share >= MOST * sizes)
        if not full.any():
            out[free] = share[free]
            break
        out[full] = MOST * sizes[full]
        left -= out[full].sum()
        free &= ~full
    return out


def split_tree(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources): exact block quotas of each shard; columns add up to ``quotas``."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def deal(node: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = node
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = _draw(rng, node, int(node.sum()) * (mid - lo) // (hi - lo))
        deal(left, lo, mid)
        deal(node - left, mid, hi)

    deal(np.asarray(quotas, np.int64), 0, shards)
    return out


def _draw(rng: np.random.Generator, node: np.ndarray, n: int) -> np.ndarray:
    """One multivariate hypergeometric draw of n blocks, source by source."""
    out, rest = np.zeros_like(node), int(node.sum())
    for i, have in enumerate(node):
        rest -= int(have)
        if have and n:
            out[i] = k = hypergeometric(rng, int(have), rest, n)
            n -= k
    return out


def _log_factorial(n: int) -> Decimal:
    """ln n! to some forty digits, by Stirling's series from 1000 on."""
    if n < 1000:
        return Decimal(math.factorial(n)).ln()
    x = Decimal(n)
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7) + 1 / (1188 * x**9)
    return (x + Decimal("0.5")) * x.ln() - x + (2 * PI).ln() / 2 + series


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good; the same law at every size.

    The library's sampler ends at a total of 10^9. Beyond it the ratio of uniforms does the same (Stadlober, 1990), with logarithms of enough digits
    that differences between large factorials keep their value."""
    total = good + bad
    if total < LIBRARY:
        return int(rng.hypergeometric(good, bad, n))
    least, most = max(0, n - bad), min(good, n)
    if least == most:
        return least
    with localcontext() as context:
        context.prec = 50

        def log_share(k: int) -> Decimal:
            return -sum(map(_log_factorial, (k, good - k, n - k, bad - n + k)))

        mean = n * (good / total)
        spread = math.sqrt(mean * (bad / total) * ((total - n) / (total - 1)) + 0.5)
        width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
        top = log_share(min(max((n + 1) * (good + 1) // (total + 2), least), most))
        while True:
            u, v = rng.random(), rng.random()
            k = math.floor(mean + 0.5 + width * (v - 0.5) / u) if u else -1
            if least <= k <= most and 2 * Decimal(u).ln() <= log_share(k) - top:
                return k


def _tag(doc_id: str, text: str) -> Column:
    """Tells documents of one id apart."""
    return F.xxhash64(F.lit(SEED), doc_id, text)


def _blocks(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """One row per document: doc, source, size, and the hash that tells its blocks apart."""
    return docs.select(F.col(doc_id).alias("doc"), F.col(source).alias("source"), size_of(text).alias("size"),
                       _tag(doc_id, text).alias("tag"))


def plan(docs: DataFrame) -> list[dict]:
    """One entry per source of the narrow documents: name, size and target in words."""
    totals = docs.groupBy("source").agg(F.sum("size").alias("size"))
    found = totals.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources to weigh")
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))  # Python orders by code point
    sizes = np.array([r["size"] for r in found], np.int64)
    weights = np.resize(np.array(WEIGHTS), len(found))
    return [{"source": r["source"], "source_size": int(s), "target": float(t)}
            for r, s, t in zip(found, sizes, targets(sizes, weights))]


def assign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(documents, blocks).

    documents: doc, source, size, tag, source_size, target. blocks: one row per taken block and pass: doc, tag, block,
    words, shard, place (order within the shard)."""
    spark = docs.sparkSession
    narrow = stored(_blocks(docs, doc_id, text, source), "sizes")
    sources = spark.createDataFrame(
        [(p["source"], p["source_size"], p["target"]) for p in plan(narrow)] or [(None, 0, 0.0)],
        "s_source string, source_size long, target double")
    narrow = narrow.withColumn("source", F.col("source").cast("string"))
    documents = (narrow.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("s_source")))
                 .drop("s_source"))
    blocks = (
        documents.where("size > 0")
        .select("doc", "tag", "source", "source_size", "target", "size",
                F.explode(F.expr(f"sequence(0L, (size - 1) div {BLOCK})")).alias("block"))
        .withColumn("words", F.least(F.lit(BLOCK).cast("long"), F.col("size") - F.col("block") * BLOCK))
        .withColumn("key", F.xxhash64(F.lit(SEED), "tag", "block"))
        .withColumn("range", F.shiftrightunsigned("key", 64 - (RANGES.bit_length() - 1))))
    blocks = stored(blocks, "blocks")
    at_range = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    ranges = (blocks.groupBy("source", "range").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
              .select(F.col("source").alias("r_source"), F.col("range").alias("r_range"),
                      F.coalesce(F.sum("n").over(at_range), F.lit(0)).alias("n_before"),
                      F.coalesce(F.sum("w").over(at_range), F.lit(0)).alias("w_before")))
    totals = blocks.groupBy("source").agg(F.count("*").alias("n_source")).withColumnRenamed("source", "t_source")
    within = Window.partitionBy("source", "range").orderBy("key", "doc", "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        blocks.withColumns({"n_in": F.count("*").over(within), "w_in": F.coalesce(F.sum("words").over(within), F.lit(0))})
        .join(ranges, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")))
        .join(F.broadcast(totals), F.col("source").eqNullSafe(F.col("t_source")))  # one row per source, MAX_SOURCES at most
        .withColumns({"rank": F.col("n_before") + F.col("n_in"), "at": F.col("w_before") + F.col("w_in")})
        .withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1))))
        # a block is taken if the middle of it lies before the target
        .where("at + turn * source_size + words / 2 <= target")
        .select("doc", "tag", "block", "words", "source", "key", "turn", (F.col("rank") + F.col("turn") * F.col("n_source")).alias("rank")))
    placed = stored(placed, "placed")
    quotas = {r["source"]: r["n"] for r in placed.groupBy("source").agg(F.count("*").alias("n")).collect()}  # one row per source
    names = sorted(quotas, key=lambda s: (s is None, s or ""))
    tree = split_tree(np.array([quotas[s] for s in names], np.int64), shards)
    ends = spark.createDataFrame([(s, [int(x) for x in tree[:, i].cumsum()]) for i, s in enumerate(names)] or [("", [0])],
                                 "e_source string, ends array<long>")
    blocks = (
        placed.join(F.broadcast(ends), F.col("source").eqNullSafe(F.col("e_source")))  # shards numbers per source
        .withColumn("shard", F.expr("size(filter(ends, e -> e <= rank))"))
        .select("doc", "tag", "block", "words", "source", "shard", F.xxhash64(F.lit(SEED), "key", "turn", "shard").alias("place")))
    return documents, blocks


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS) -> DataFrame:
    """Per document: id, size, source_size, target (of its source), taken (words of the mix), shards (in which it occurs)."""
    return _mixed(docs, doc_id, text, source, shards).drop("tag")


def _mixed(docs: DataFrame, doc_id: str, text: str, source: str, shards: int) -> DataFrame:
    documents, blocks = assign(docs, doc_id, text, source, shards)
    copies = documents.groupBy("doc", "tag", "source").agg(F.count("*").alias("copies"))
    taken = blocks.groupBy("doc", "tag", "source").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_set("shard")).alias("shards"))
    taken = taken.select(F.col("doc").alias("t_doc"), F.col("tag").alias("t_tag"), F.col("source").alias("t_source"), "taken", "shards")
    same = F.col("doc").eqNullSafe(F.col("t_doc")) & (F.col("tag") == F.col("t_tag")) & F.col("source").eqNullSafe(F.col("t_source"))
    per_doc = copies.join(taken, same, "left").select(
        F.col("doc").alias("t_doc"), F.col("tag").alias("t_tag"), F.col("source").alias("t_source"), "copies", "taken", "shards")
    return (
        documents.join(per_doc, same)
        .select(F.col("doc").alias(doc_id), "tag", "size", "source_size", "target",
                F.coalesce(F.expr("taken div copies"), F.lit(0)).cast("long").alias("taken"),
                F.coalesce("shards", F.array().cast("array<int>")).alias("shards")))


def mixed_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The documents the mix takes from, with their size, target and the words taken; documents of one id are told apart by their text."""
    chosen = (_mixed(docs, "doc_id", "text", "source", shards).where("taken > 0").drop("shards").withColumnsRenamed({"doc_id": "_id", "tag": "_tag"})
              .dropDuplicates(["_id", "_tag"]))  # equal rows have equal results
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (_tag("doc_id", "text") == F.col("_tag"))
    return docs.join(chosen, same).drop("_id", "_tag")
