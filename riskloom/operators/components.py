"""Size of a client's connected component just before each transaction.

Clients are linked to the devices, addresses and recipients they use. The link graph only grows, so
only the first use of a link matters, and component sizes change only when two components merge.

1. ``links``: first use of every (client, entity) pair.
2. ``thinned``: of any set of links, one that closes a circle of earlier ones never joins two components. Bounded runs of
   links, those of a client together, are rid of such links, which leaves little more than one link per client and run.
3. ``merges``: the merge log, at most one row per node. Time is halved again and again. At each
   level the first half of every span is contracted by min-label propagation, for all spans at once,
   and the second half is relabelled with the result; a link inside one component disappears. When
   a span holds few links its merges are replayed in order. Depth grows with the logarithm of the
   number of links, and a giant component is only ever a label.
4. A component is named by the smallest node hash in it. Hashes are random with respect to time, so
   the name of a client's component changes a logarithmic number of times; these changes are kept as
   a short history per client.
5. Each transaction looks up the name in its client's history and then the latest size of that
   component, as a running "last value before me" over one narrow table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import scan
from riskloom.functions.storage import saved, stored
from riskloom.operators.entity_features import KINDS, _entity

DEFAULT_SPAN_LINKS = 500_000
MERGE_SCHEMA = "us long, tx_id {tx}, part int, kept long, gone long, clients long, nodes long"


def span_links(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.riskloom.spanLinks", str(DEFAULT_SPAN_LINKS)))


def client_node(name: str = "client_id"):
    return F.xxhash64(F.lit("client"), F.col(name).cast("string"))


def entity_nodes():
    """The entities of a transaction: array of (v, part)."""
    parts = [F.when(F.col(c) != "", F.struct(
        F.xxhash64(F.lit("entity"), _entity(k)).alias("v"), F.lit(i).alias("part")))
        for i, (k, c) in enumerate(KINDS.items())]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


# what a client node (u) and an entity node (v) count before they are linked
ALONE = {"uc": 1, "un": 1, "vc": 0, "vn": 1}


def links(tx: DataFrame) -> DataFrame:
    """First use of each (client, entity) pair: u (client node), v (entity node), us, tx_id, part.
    ``part`` orders the links one transaction adds."""
    return (tx.select(client_node().alias("u"), "us", "tx_id", F.explode(entity_nodes()).alias("e"))
            .groupBy("u", F.col("e.v").alias("v"))
            .agg(F.min(F.struct("us", "tx_id", "e.part")).alias("at"))
            .select("u", "v", "at.us", "at.tx_id", "at.part"))


def min_labels(edges: DataFrame) -> DataFrame:
    """Connected components of many small or large graphs at once: (g, a, b) -> (g, node, label) for
    every node that is not the smallest of its component. Alternates two steps until nothing
    moves: every node hands its larger neighbours, then its smaller ones, to its smallest
    neighbour (large-star and small-star)."""
    cur = edges.select("g", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    before = None
    while True:
        both = cur.unionByName(cur.select("g", F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("g", "a").agg(F.min("b").alias("m")).select("g", "a", F.least("m", "a").alias("m"))
        large = (both.join(low, ["g", "a"]).where("b > a")
                 .select("g", F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low2 = large.groupBy("g", "a").agg(F.min("b").alias("m"))
        small = (large.join(low2, ["g", "a"])
                 .select("g", F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                                                F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select("g", "e.a", "e.b").where("a <> b").distinct())
        new = saved(small)
        # stable when a round changes nothing
        after = tuple(new.agg(F.count("*"), F.bit_xor(F.xxhash64("g", "a", "b"))).first())
        if before == after:
            return new.select("g", F.col("a").alias("node"), F.col("b").alias("label"))
        cur, before = new, after


def _replay(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Merges of one short span in time order; the smaller name stays."""
    pdf = pdf.sort_values(["us", "tx_id", "part"], kind="stable")
    parent: dict[int, int] = {}
    size: dict[int, tuple[int, int]] = {}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for us, tx, part, u, v, uc, un, vc, vn in pdf[
            ["us", "tx_id", "part", "u", "v", "uc", "un", "vc", "vn"]].itertuples(index=False, name=None):
        for node, s in ((u, (uc, un)), (v, (vc, vn))):
            if node not in parent:
                parent[node], size[node] = node, s
        a, b = root(u), root(v)
        if a == b:
            continue
        kept, gone = min(a, b), max(a, b)
        parent[gone] = kept
        size[kept] = (size[a][0] + size[b][0], size[a][1] + size[b][1])
        out.append((us, tx, part, kept, gone, *size[kept]))
    return pd.DataFrame(out, columns=["us", "tx_id", "part", "kept", "gone", "clients", "nodes"])


def _spanning(links: pa.Table) -> pa.Table:
    """The links that join two components when these links alone are added in time order."""
    ordered = links.select(["us", "tx_id", "part"]).to_pandas().sort_values(["us", "tx_id", "part"], kind="stable").index.to_numpy()
    _, ends = np.unique(np.concatenate([links.column(c).to_numpy() for c in ("u", "v")]), return_inverse=True)
    u, v = ends[:len(links)][ordered].tolist(), ends[len(links):][ordered].tolist()
    parent = list(range(len(ends)))
    kept = []
    for i, (a, b) in enumerate(zip(u, v)):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[a] = b
            kept.append(i)
    return links.take(pa.array(ordered[kept], pa.int64()))


def thinned(first_links: DataFrame, max_links: int) -> DataFrame:
    """The links without some that cannot merge anything: at most ``max_links`` at a time are held against each other, those of a client
    next to each other. All that do merge stay, and with them every node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for start in range(0, len(batch), max_links):
                part = batch.slice(start, max_links)
                if held and sum(map(len, held)) + len(part) > max_links:
                    yield from _spanning(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(part)
        if held:
            yield from _spanning(pa.Table.from_batches(held)).to_batches()

    return first_links.repartition("u").mapInArrow(run, first_links.schema)


def merges(first_links: DataFrame, max_links: int | None = None) -> DataFrame:
    """The merge log: at (us, tx_id, part) component ``gone`` joined ``kept``, which then has
    ``clients`` clients and ``nodes`` nodes. Nodes that stand for more than themselves come with their sizes (uc, un, vc, vn)."""
    spark = first_links.sparkSession
    max_links = max_links or span_links(spark)
    order = ["us", "tx_id", "part"]
    # spans are ranges of time, stored so that a retry cannot move an edge
    first_links = saved(thinned(first_links, max_links))
    spans = max(1, -(-first_links.count() // max_links))
    dealt = first_links.repartitionByRange(spans, *order) if spans > 1 else first_links
    levels = (spans - 1).bit_length()
    # client nodes are always on the u side
    e = stored(dealt.withColumn("leaf", F.spark_partition_id() if spans > 1 else F.lit(0)), "spans").select(
        "leaf", *order, "u", "v", *[(F.col(c) if c in first_links.columns else F.lit(n)).cast("long").alias(c) for c, n in ALONE.items()])
    for level in range(levels):
        half = 1 << (levels - 1 - level)
        span = F.floor(F.col("leaf") / (2 * half)).cast("long")
        late = F.floor(F.col("leaf") / half) % 2 == 1
        e = e.withColumns({"g": span, "late": late})
        early = e.where("NOT late")
        lab = min_labels(early.select("g", F.col("u").alias("a"), F.col("v").alias("b")))
        nodes = early.select("g", F.explode(F.array(
            F.struct(F.col("u").alias("node"), F.col("uc").alias("c"), F.col("un").alias("n")),
            F.struct(F.col("v").alias("node"), F.col("vc").alias("c"), F.col("vn").alias("n")))).alias("x"))
        nodes = nodes.select("g", "x.*").groupBy("g", "node").agg(F.first("c").alias("c"), F.first("n").alias("n"))
        named = nodes.join(lab, ["g", "node"], "left").withColumn("label", F.coalesce("label", "node"))
        total = named.groupBy("g", "label").agg(F.sum("c").alias("lc"), F.sum("n").alias("ln"))
        named = saved(named.select("g", "node", "label").join(total, ["g", "label"]))
        moved = e.where("late")
        for side, c, n in (("u", "uc", "un"), ("v", "vc", "vn")):
            dim = named.select("g", F.col("node").alias(side), F.col("label").alias("_l"), "lc", "ln")
            moved = moved.join(dim, ["g", side], "left").withColumns({
                c: F.coalesce("lc", c), n: F.coalesce("ln", n)})
            moved = moved.withColumn("_new", F.coalesce("_l", side)).drop("_l", "lc", "ln", side)
            moved = moved.withColumnRenamed("_new", side)
        keep = ["leaf", *order, "u", "v", "uc", "un", "vc", "vn"]
        e = saved(early.select(*keep).unionByName(moved.where("u <> v").select(*keep)))
    tx_type = dict(first_links.dtypes)["tx_id"]
    return saved(e.groupBy("leaf").applyInPandas(_replay, MERGE_SCHEMA.format(tx=tx_type)))


def name_history(merge_log: DataFrame) -> DataFrame:
    """node -> array of (us, tx_id, part, label), oldest first: the names the node's component took on.
    Every node starts with its own next name and appends the names of the last one it knows, so the
    known part doubles each round. Histories have logarithmic length."""
    cur = merge_log.select(F.col("gone").alias("node"), F.array(
        F.struct("us", "tx_id", "part", F.col("kept").alias("label"))).alias("names"))
    while True:
        last = F.element_at("names", -1)["label"]
        more = cur.select(F.col("node").alias("_last"), F.col("names").alias("_more"))
        grown = saved(cur.withColumn("_last", last).join(more, "_last", "left").select(
            "node", F.when(F.col("_more").isNull(), F.col("names")).otherwise(F.concat("names", "_more")).alias("names"),
            F.col("_more").isNotNull().alias("grew")))
        cur = grown.select("node", "names")
        if grown.where("grew").isEmpty():
            return cur


def sizes_before(log: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes`` (node, us, tx_id, further columns) with ``label``, ``clients`` and ``nodes`` of the node's component before that position; the
    sizes are null for a node that no link has touched by then."""
    names = name_history(log)
    order = ["us", "tx_id", "part"]
    extra = [c for c in probes.columns if c not in ("node", "us", "tx_id")]
    sized = log.select(F.col("kept").alias("label"), *order, F.struct("clients", "nodes").alias("size"))

    def named(p: DataFrame) -> DataFrame:
        """Component name before the position: the last renaming at an earlier one."""
        earlier = F.filter("names", lambda x: (x["us"] < F.col("us")) | ((x["us"] == F.col("us")) & (x["tx_id"] < F.col("tx_id"))))
        p = p.join(names, "node", "left")
        return p.select("us", "tx_id", *extra, "node", F.coalesce(F.try_element_at(earlier, F.lit(-1))["label"], F.col("node")).alias("label"))

    # labels with many rows: resolve the names of the few sampled probes only
    rows = scan.chunk_rows(log.sparkSession)
    sample = probes.where(F.pmod(F.xxhash64("us", "tx_id", "node"), F.lit(rows)) == 0)
    hot = scan.find_hot(named(sample), ["label"], ["us", "tx_id", "node"], 1)
    asked = named(probes).withColumns({"part": F.lit(-1), "size": F.lit(None).cast("struct<clients:bigint,nodes:bigint>")})
    run = scan.running(asked.unionByName(sized, allowMissingColumns=True), ["label"], order, lasts={"now": "size"}, hot=hot)
    return run.where("part = -1").select("us", "tx_id", *extra, "node", "label", F.col("now.clients").alias("clients"), F.col("now.nodes").alias("nodes"))


def component_features(tx: DataFrame, max_links: int | None = None) -> DataFrame:
    """tx_id, component_clients, component_size: the component of the client before the transaction."""
    d = tx.select("tx_id", "us", "client_id", *KINDS.values())
    found = sizes_before(merges(links(d), max_links), d.select("tx_id", "us", client_node().alias("node")))
    return found.select("tx_id", F.coalesce("clients", F.lit(1)).cast("double").alias("component_clients"),
                        F.coalesce("nodes", F.lit(1)).cast("double").alias("component_size"))
