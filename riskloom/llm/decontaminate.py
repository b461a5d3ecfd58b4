"""Benchmark decontamination by winnowed fingerprints.

A text is its words, A-Z lower-cased; a word is a run of digits, letters and anything beyond ASCII. A window is 13
consecutive words of a benchmark item; an item of fewer words is one window. A document word is hit if
it lies inside an occurrence of a window.

Fingerprints: every text keeps, of each 9 consecutive hashes of 5 words, the least (winnowing). Any shared span of
5 + 9 - 1 = 13 words therefore shares a kept hash, so no window can be missed. Documents are joined with
the benchmark on kept hashes; a hit at a word is extended to every window that can have produced it, and
extended windows are compared as texts. Items shorter than a window are fingerprinted whole, one
hash per start (winnowing of width 1), for each length that occurs.

Only DataFrame functions are used. Fingerprints stay inside the row of their document until they are
joined; only hits are shuffled. The benchmark is broadcast while its fingerprints are few; beyond
``BROADCAST_ROWS`` the join is a shuffle.

Defined cases: a null or wordless document has no words, no hits and is clean; a null or wordless item has no
windows. Rows that repeat a doc_id are one document whose counts cover the union of the hits, and whose
length is that of its longest text. Repeated items count as one per distinct item_id; a null item_id has windows that hit but is not
listed or counted. A null doc_id is an id like any other. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.storage import stored

WINDOW = 13
GRAM = 5
WIDTH = WINDOW - GRAM + 1
BROADCAST_ROWS = 2_000_000
PLACE_BITS = 28  # places of a kept hash within its text: 268 million words
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: str) -> Column:
    """The words of a text column; an empty array for null."""
    return F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often a lambda inside it looks at it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(n: Column, length: int) -> Column:
    """0, 1, ... of the spans of a length in n words; empty if there are none."""
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column, length: int) -> Column:
    """The kept part of the hash of ``length`` words from each place, with the place below it.

    Later places have smaller values, so that the least value is the last of equal hashes."""
    def packed(i: Column) -> Column:
        h = F.xxhash64(*[F.get(hashes, i + j) for j in range(length)])
        return F.shiftleft(F.shiftrightunsigned(h, PLACE_BITS + 1), PLACE_BITS) + (F.lit((1 << PLACE_BITS) - 1) - i)

    return F.transform(_starts(F.size(hashes), length), packed)


def fingerprints(df: DataFrame, text: str, length: int) -> DataFrame:
    """Add ``kept``: packed fingerprints that find every shared span of ``length`` words; and ``n_words``."""
    gram, width = (GRAM, WIDTH) if length == WINDOW else (length, 1)
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))

    def least(grams: Column) -> Column:
        return F.array_distinct(F.transform(_starts(F.size(grams), width), lambda i: F.array_min(F.slice(grams, i + 1, width))))

    def marked(h: Column) -> Column:
        kept = bound(_grams(h, gram), least) if width > 1 else _grams(h, gram)
        return F.struct(F.size(h).alias("n_words"), kept.alias("kept"))

    return df.withColumn("_m", bound(hashes, marked)).withColumns({"n_words": F.col("_m.n_words"), "kept": F.col("_m.kept")}).drop("_m")


def _hash(packed: Column | str) -> Column:
    return F.shiftright(packed, PLACE_BITS)


def _place(packed: str) -> Column:
    return F.expr(f"cast({(1 << PLACE_BITS) - 1} - ({packed} & {(1 << PLACE_BITS) - 1}) as int)")


def _span(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


def bounded(df: DataFrame) -> DataFrame:
    """Broadcast a stored table if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_windows(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, length, window): the distinct windows of every item."""
    def spans(w: Column) -> Column:
        length = F.least(F.size(w), F.lit(WINDOW))
        return F.transform(F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - length)),
                           lambda i: F.struct(length.alias("length"), _span(w, i, length).alias("window")))

    return (items.select(F.col(item_id).alias("item"), F.explode(bound(words(text), spans)).alias("s"))
            .select("item", "s.length", "s.window").distinct())


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items (sorted ids as strings), contaminated (5 % of its words or more are hit)."""
    windows = stored(item_windows(items, item_id, item_text), "windows")
    lengths = sorted({WINDOW} | {r[0] for r in windows.select("length").distinct().collect()})  # 13 values at most
    source = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    found = []
    for length in lengths:
        wanted = (fingerprints(windows.where(F.col("length") == length), "window", length)
                  .select(F.explode(F.transform("kept", _hash)).alias("h")).distinct())
        marks = fingerprints(source, "text", length)
        if length == WINDOW:  # one row without a hash for each document, so that it is counted
            marks = marks.withColumn("kept", F.expr("array_append(kept, cast(null as bigint))"))
        marks = (marks.select("doc", "n_words", F.explode("kept").alias("packed"))
                 .withColumn("h", _hash("packed")))
        wanted = bounded(stored(wanted, "wanted")).withColumn("met", F.lit(True))
        hit = marks.join(wanted, "h", "left").where("met OR packed IS NULL")
        first = F.greatest(_place("packed") - (WIDTH - 1 if length == WINDOW else 0), F.lit(0))
        found.append(hit.select("doc", "n_words", F.lit(length).alias("length"),
                                F.when(F.col("met"), F.struct(first.alias("lo"), _place("packed").alias("hi"))).alias("span")))
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    # a document's hits are bounded by its own length
    hits = stored(hits.groupBy("doc").agg(F.max("n_words").alias("n_words"),
                                          F.collect_set(F.when(F.col("span").isNotNull(), F.struct("length", "span"))).alias("spans")), "hits")
    met = hits.where(F.size("spans") > 0).select(F.col("doc").alias("hit_doc"), "spans")
    candidates = (
        source.join(bounded(met), F.col("doc").eqNullSafe(F.col("hit_doc")))
        .withColumn("starts", F.expr("""array_distinct(flatten(transform(spans, s -> transform(
            sequence(s.span.lo, s.span.hi), i -> struct(s.length AS length, i AS start)))))"""))
        .select("doc", F.explode(bound(words("text"), lambda w: F.transform("starts", lambda s: F.struct(
            s["length"].alias("length"), s["start"].alias("start"), _span(w, s["start"], s["length"]).alias("window"))))).alias("spot"))
        .select("doc", "spot.*"))
    held = bounded(windows)
    occurs = candidates.join(held, ["length", "window"]).select("doc", "length", "start", "item")
    covered = """aggregate(array_sort(spots), struct(0 AS upto, 0L AS total), (a, s) -> struct(
        greatest(a.upto, s.start + s.length) AS upto,
        a.total + greatest(0, s.start + s.length - greatest(a.upto, s.start)) AS total), a -> a.total)"""
    per_doc = (
        occurs.groupBy("doc").agg(
            F.collect_set(F.struct("start", "length")).alias("spots"),
            F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
        .select(F.col("doc").alias("per_doc"), F.expr(covered).alias("n_hit"), "items"))
    return (
        hits.join(per_doc, F.col("doc").eqNullSafe(F.col("per_doc")), "left")
        .select(F.col("doc").alias(doc_id), F.col("n_words").cast("long").alias("n_words"),
                F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                F.coalesce("items", F.array().cast("array<string>")).alias("items"))
        .withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words")))


def keep_clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that are not contaminated."""
    marked = stored(contamination(docs, items, doc_id).where("contaminated").select(F.col(doc_id).alias("bad")), "contaminated")
    return docs.join(bounded(marked), F.col(doc_id).eqNullSafe(F.col("bad")), "left_anti")
