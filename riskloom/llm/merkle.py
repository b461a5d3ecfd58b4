"""Merkle manifest of a table of documents, checked by a recursive query.

``H`` is SHA-256 of its inputs' hex digests, put together. A leaf is the digest of a row; the leaves of a language ascend by id, and every two
consecutive nodes become their ``H`` until one remains, the language's subroot; subroots by language become the root in the same way.

Levels are built from the bottom, ``STRIDE`` at once: nodes are grouped into blocks of 2^STRIDE, and what a block comes to is a node of the next
stored level. A node row holds its digest, the digests beside its path through its block, from the bottom, and the key of the block's node: its parent.
The climb is one recursive SQL query. It starts from the leaf rows; every step joins the parent rows, appends the siblings there and
folds them into the digest carried along, so the digest of an altered leaf arrives at the top as the root that the altered table would have. A
path of L levels takes L / STRIDE steps, and what a leaf carries from step to step is 32 bytes a level; with STRIDE = 1 every level is stored and is a step.

Blocks hold at most 2^STRIDE digests, however many leaves a language has. Node rows above the leaves are 2^STRIDE times fewer; they are
broadcast while there are ``BROADCAST_ROWS`` at most (some 400 bytes each) and joined by a shuffle beyond, where adaptive execution splits the leaves of a much-met parent.
Only the root comes to the driver.

Defined cases: a null column counts as ``-``; null languages and ids come first in their order. Rows with equal ids are ordered by their leaf,
so equal rows have equal leaves but places of their own, and each row of the table comes back. A null id is never tampered with, nor is a null n_chars changed. The largest n_chars
grows beyond 64 bits. An empty table has no rows and no root. Texts of any length are hashed as they are; further columns, with any names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scan import global_index
from riskloom.functions.storage import stored

STRIDE = 8
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32 << 20
TOP = 1000  # step of the subroots; the steps below are those of the languages' trees
TAMPER = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UNLIMITED = {"spark.sql.cteRecursionRowLimit": "-1"}  # the rows of the climb are those of the table


def _written(c: Column) -> Column:
    """A field as it is hashed: its bytes with their number before them."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(**changed: Column) -> Column:
    """Digest of a row, in binary; ``changed`` columns take the place of the row's own."""
    return F.unhex(F.sha2(F.concat(*[_written(changed.get(c, F.col(c))) for c in FIELDS]).cast("binary"), 256))


def tampered(doc_id: Column, every: int = TAMPER) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(every)) == 0, F.lit(False))


def _fold(digest: str, path: str) -> str:
    """SQL: H with each sibling of a path in turn; an entry has the sibling, or null, and whether it stands before."""
    return (f"aggregate({path}, {digest}, (d, p) -> unhex(sha2(cast(lower(hex(CASE WHEN p.digest IS NULL THEN d "
            "WHEN p.before THEN concat(p.digest, d) ELSE concat(d, p.digest) END)) AS binary), 256)))")


def _siblings(path: str) -> str:
    """SQL: the siblings of a path put together."""
    return f"aggregate({path}, cast('' AS binary), (s, p) -> concat(s, coalesce(p.digest, cast('' AS binary))))"


def _levels(nodes: str, levels: str) -> str:
    """SQL: an array of digests and the ``levels`` levels above it, from the bottom."""
    above = ("transform(sequence(0, (size(last) - 1) div 2), i -> unhex(sha2(cast(lower(hex(concat(get(last, cast(2 * i AS int)), "
             "coalesce(get(last, cast(2 * i + 1 AS int)), cast('' AS binary))))) AS binary), 256)))").replace("last", "element_at(a, -1)")
    return f"aggregate(sequence(0, {levels}), array({nodes}), (a, l) -> CASE WHEN l = 0 THEN a ELSE concat(a, array({above})) END)"


#: SQL: the path of the i-th node through the levels ``a`` of its block.
PATH = ("transform(slice(a, 1, size(a) - 1), (level, l) -> struct(get(level, cast(shiftright(i, l) ^ 1 AS int)) AS digest, "
        "(shiftright(i, l) & 1) = 1 AS before))")


def _stored_level(nodes: DataFrame, stride: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of the nodes (tree, place, digest, left, extra columns): tree, block, left, nodes with their path, top digest.

    ``left`` levels are still to be built in a tree; a block is as many levels high, ``stride`` at most. Only the last block of a
    tree can have fewer nodes, and then some without a sibling."""
    a = _levels("transform(members, m -> m.digest)", f"least({stride}, left)")
    member = ", ".join(f"m.{c} AS {c}" for c in ("place", "digest", *extra))
    return stored(
        nodes.groupBy("tree", F.shiftright("place", stride).alias("block"), "left")
        .agg(F.sort_array(F.collect_list(F.struct("place", "digest", *extra))).alias("members"))
        .withColumn("a", F.expr(a))
        .select("tree", "block", "left", F.expr(f"transform(members, (m, i) -> struct({member}, {PATH} AS path))").alias("members"),
                F.expr("get(element_at(a, -1), 0)").alias("top")), "merkle-level")


def _built(nodes: DataFrame, first: int, above: Column, stride: int, extra: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """All stored levels of some trees, from step ``first`` on, as node rows; and what each tree comes to (tree, digest).

    ``above``: key of the parent of a tree's uppermost stored nodes."""
    depth = nodes.agg(F.max("left")).first()[0] or 0
    rows, finished = [], []
    for step in range(first, first + max(1, -(-depth // stride))):
        blocks = _stored_level(nodes, stride, extra)
        parent = F.when(F.col("left") > stride, F.struct(F.lit(step + 1).alias("step"), F.col("tree").alias("tree"), F.col("block").alias("place"))).otherwise(above)
        rows.append(blocks.select("tree", parent.alias("parent"), F.explode("members").alias("m")).select(F.lit(step).alias("step"), "tree", "m.*", "parent"))
        finished.append(blocks.where(F.col("left") <= stride).select("tree", F.col("top").alias("digest")))
        nodes = blocks.where(F.col("left") > stride).select("tree", F.col("block").alias("place"), F.col("top").alias("digest"), (F.col("left") - stride).alias("left"))
        extra = ()
    return rows, reduce(DataFrame.union, finished)


def _depth(n: Column) -> Column:
    """Levels above n nodes: the least L with 2^L >= n."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n - 1))).cast("int")


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


CLIMB = f"""
WITH RECURSIVE climb AS (
    SELECT doc_id, digest AS leaf, parent.step AS step, parent.tree AS tree, parent.place AS place,
           {_fold("coalesce(altered, digest)", "path")} AS digest, {_siblings("path")} AS proof, cast(NULL AS binary) AS subroot
    FROM {{leaves}}
    UNION ALL
    SELECT c.doc_id, c.leaf, n.parent.step, n.parent.tree, n.parent.place,
           {_fold("c.digest", "n.path")}, concat(c.proof, {_siblings("n.path")}), CASE WHEN n.step = {TOP} THEN n.digest ELSE c.subroot END
    FROM climb c JOIN {{nodes}} n ON n.step = c.step AND n.tree = c.tree AND n.place = c.place
)
SELECT doc_id, leaf, subroot, proof, digest AS folded FROM climb WHERE step IS NULL"""


def proofs(docs: DataFrame, stride: int = STRIDE, every: int = TAMPER) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof (the siblings from the leaf to the root, 32 bytes
    each), folded_root (from the tampered leaf where ``every`` divides the crc32 of the id) and verified. Digests are in binary."""
    spark = docs.sparkSession
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    altered = F.when(tampered(F.col("doc_id"), every) & F.col("n_chars").isNotNull(), leaf_digest(n_chars=more))
    leaves = global_index(stored(docs.select("doc_id", "lang", leaf_digest().alias("digest"), altered.alias("altered")), "merkle-leaves"),
                          ["lang", "doc_id", "digest"], "at")
    langs = stored(global_index(leaves.groupBy("lang").agg(F.min("at").alias("start"), F.count("*").alias("n")), ["start"], "tree"), "merkle-langs")
    trees, size = langs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("lang")), F.lit(0)) + 64 * F.count("*")).first()
    named = F.broadcast(langs) if size <= BROADCAST_BYTES else langs
    nodes = leaves.join(named, leaves["lang"].eqNullSafe(named["lang"])).select(
        "tree", (F.col("at") - F.col("start")).alias("place"), "digest", _depth(F.col("n")).alias("left"), "doc_id", "altered")

    upper = F.struct(F.lit(TOP).alias("step"), F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("place"))
    rows, subroots = _built(nodes, 0, upper, stride, ("doc_id", "altered"))
    top = subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("place"), "digest", _depth(F.lit(trees)).alias("left"))
    upper_rows, one = _built(top, TOP, F.lit(None).cast("struct<step:int,tree:bigint,place:bigint>"), stride)
    root = one.first()
    parents = reduce(DataFrame.union, [*rows[1:], *upper_rows])
    if parents.count() <= BROADCAST_ROWS:  # a row has stride digests and two keys
        parents = F.broadcast(parents)
    with _settings(spark, UNLIMITED):
        found = stored(spark.sql(CLIMB, leaves=rows[0], nodes=parents), "merkle-climb")
    known = F.lit(bytes(root["digest"]) if root else None).cast("binary")
    return found.select("doc_id", "leaf", "subroot", known.alias("root"), "proof", F.col("folded").alias("folded_root"), (F.col("folded") == known).alias("verified"))


def digest(found: DataFrame) -> DataFrame:
    """The proofs as hex digests."""
    def text(c: str) -> Column:
        return F.lower(F.hex(c))

    return found.select("doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
                        F.sha2(text("proof").cast("binary"), 256).alias("proof_sha256"), text("folded_root").alias("folded_root"), "verified")
