"""Secret scan with linked credential parts.

Three patterns stand alone: assignments to a secret name, access identifiers and long hex runs. Other parts are weak:
an identifier named by its key, a 40-character token, an endpoint. They are reported only where complementary
parts lie within ``REACH`` code points of each other in one document: a weak identifier beside a secret, a
weak secret beside an identifier or an endpoint, an endpoint beside an identifier or a secret.

Only DataFrame functions are used. Texts without any part are passed over by one test per
pattern. A match's place is the length of the gaps and matches before it, in code points. Linking is an interval join:
parts are dealt to bins of ``REACH`` code points, each to the bins of its ends and of what is near them, and compared within a bin, so a document with very many parts
spreads over its bins and a part of any length is in a few; parts do not overlap within a pattern, which bounds a bin.

Defined cases: a null or empty text has no spans. Rows that repeat a document get its spans each. A null doc_id is an
id like any other. Further columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.storage import stored

REACH = 200
BROADCAST_ROWS = 200_000
MASK = "[secret]"

# The base patterns, their order, and the least length of what they report.
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
BASE = {"assign": (ASSIGN, 6), "access": (ACCESS, 20), "hex": (HEX, 24)}

# Weak parts: pattern, least and greatest length (None: any) of the reported text, and a text that must occur for it to be tried.
WEAK = {
    "name": ("(?i:access_?key(?:_?id)?|client_?id|user_?name|login)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9_.@-]+)", 3, None),
    "key40": ("[A-Za-z0-9+/]+", 40, 40),
    "endpoint": ("(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp)://([A-Za-z0-9_.:@/-]+)", 4, None),
}
NEEDED = {
    "assign": "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]",
    "access": "AKIA[A-Z0-9]{16}",
    "hex": "[0-9a-f]{24}",
    "name": "(?i:access_?key(?:_?id)?|client_?id|user_?name|login)[\"']?\\x20*[:=]",
    "key40": "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])",
    "endpoint": "(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp)://",
}
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "name": "identifier", "key40": "secret", "endpoint": "endpoint"}
ORDER = {k: i for i, k in enumerate([*BASE, *WEAK])}


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def matches(text: Column, kind: str) -> Column:
    """Array of (start, end) of the non-overlapping matches of one kind that are long enough."""
    pattern, least, most = (*BASE[kind], None) if kind in BASE else WEAK[kind]
    grouped = kind in ("assign", "name", "endpoint")
    walk = f"(?s)(.*?)(?:({pattern})|\\z)"
    gaps, found = F.regexp_extract_all(text, F.lit(walk), F.lit(1)), F.regexp_extract_all(text, F.lit(walk), F.lit(2))
    values = F.regexp_extract_all(text, F.lit(walk), F.lit(3)) if grouped else found
    steps = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), values.alias("value"))
    nothing = F.array().cast("array<struct<start:int,end:int,ok:boolean>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        size = F.length(x["value"])
        ok = (size >= least) & (size <= most) if most else size >= least
        if kind == "key40":  # a plain word or number of that length is no token
            ok = ok & x["value"].rlike("[0-9]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[a-z]")
        return F.struct(end.alias("at"), F.concat(acc["out"], F.when(
            ok & (F.length(x["hit"]) > 0), F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(True).alias("ok"))))
            .otherwise(nothing)).alias("out"))

    walked = F.aggregate(steps, F.struct(F.lit(0).alias("at"), nothing.alias("out")), step, lambda a: a["out"])
    spans = F.transform(walked, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.when(text.rlike(NEEDED[kind]), spans).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def parts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc, a hash of the text, one array of spans per kind."""
    return docs.select(F.col(doc_id).alias("doc"), F.xxhash64(_text(text)).alias("tag"),
                       *[matches(_text(text), k).alias(k) for k in ORDER])


def link(found: DataFrame) -> DataFrame:
    """(doc, tag, weak): weak spans that a complementary part supports; ``found`` is the result of ``parts``."""
    each = [f"transform({k}, s -> struct('{k}' AS kind, '{ROLES[k]}' AS role, {str(k in BASE).lower()} AS strong, "
            f"s.start AS start, s.end AS end))" for k in ORDER]
    flat = (found.where(" + ".join(f"size({k})" for k in ORDER) + " > 1").where(" + ".join(f"size({k})" for k in WEAK) + " > 0")
            .withColumn("p", F.explode(F.expr(f"concat({', '.join(each)})"))).select("doc", "tag", "p.*").distinct())
    bins = F.expr(f"array_distinct(concat(sequence(floor(greatest(start - {REACH}, 0) / {REACH}), floor(start / {REACH})), "
                  f"sequence(floor(end / {REACH}), floor((end + {REACH}) / {REACH}))))")
    weak = flat.where("NOT strong").withColumn("bin", F.explode(bins))
    other = flat.select(F.col("doc").alias("doc_o"), F.col("tag").alias("tag_o"), F.col("role").alias("role_o"), F.col("kind").alias("kind_o"), F.col("start").alias("start_o"),
                        F.col("end").alias("end_o"), F.explode(F.expr(f"array_distinct(array(floor(start / {REACH}), floor(end / {REACH})))")).alias("bin_o"))
    near = (
        weak.join(other, F.col("doc").eqNullSafe(F.col("doc_o")) & (F.col("tag") == F.col("tag_o")) & (F.col("bin") == F.col("bin_o")))
        .where(f"start_o <= end + {REACH} AND end_o >= start - {REACH}")
        .where("NOT (start_o < end AND end_o > start)")  # a text does not support itself
        .where("(role = 'identifier' AND role_o = 'secret') OR (role = 'secret' AND role_o IN ('identifier', 'endpoint')) "
               "OR (role = 'endpoint' AND role_o <> 'endpoint')"))
    return near.groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "kind", "end")).alias("weak"))


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then by the order of kinds."""
    ordered = F.array_sort(spans)
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _keyed(kind: Column, span: Column) -> Column:
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv]), kind)
    return F.struct(span["start"].alias("start"), rank.alias("rank"), kind.alias("kind"), span["end"].alias("end"))


def _all_of(kind: str) -> Column:
    return F.transform(F.col(kind), lambda s: _keyed(F.lit(kind), s))


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc, tag, ``n_<kind>`` of the base kinds, base (their spans) and linked (weak spans with support),
    each an array of (start, rank, kind, end). The texts are read once; what is stored is narrow."""
    found = stored(parts(docs, doc_id, text), "parts")
    linked = link(found).select(F.col("doc").alias("doc_l"), F.col("tag").alias("tag_l"), "weak")
    weak = F.transform(F.col("weak"), lambda s: _keyed(s["kind"], s))
    return (
        found.select("doc", "tag", F.concat(*[_all_of(k) for k in BASE]).alias("base"),
                     *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE])
        .join(linked, F.col("doc").eqNullSafe(F.col("doc_l")) & (F.col("tag") == F.col("tag_l")), "left")
        .select("doc", "tag", *[f"n_{k}" for k in BASE], "base",
                F.coalesce(weak, F.slice(F.col("base"), 1, 0)).alias("linked")))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, counts, base and linked spans as ``spans`` gives them."""
    return spans(docs, doc_id, text).select(F.col("doc").alias(doc_id), *[f"n_{k}" for k in BASE], "base", "linked")


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The spans as one text, and the SHA-256 of the base ones."""
    return found.select(doc_id, *[f"n_{k}" for k in BASE], F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        _joined(F.concat("base", "linked")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with every span replaced by a mask; overlapping spans share one. ``length`` follows the new text.

    Documents with spans are joined back by id and text hash, by a broadcast while they are few."""
    bare = F.transform(F.concat("base", "linked"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    found = stored(spans(docs, "doc_id", text).select(F.col("doc").alias("_doc"), F.col("tag").alias("_tag"), F.array_sort(bare).alias("_spans"))
                   .where(F.size("_spans") > 0).distinct(), "spans")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    d = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64(_text(text)) == F.col("_tag")), "left")
    masked = F.expr(f"""aggregate(_spans, struct(0 AS at, '' AS out), (a, s) -> struct(
        greatest(a.at, s.end) AS at,
        CASE WHEN s.start >= a.at THEN concat(a.out, substring({text}, a.at + 1, s.start - a.at), '{MASK}') ELSE a.out END AS out),
        a -> concat(a.out, substring({text}, a.at + 1)))""")
    d = d.withColumn(text, F.when(F.size("_spans") > 0, masked).otherwise(F.col(text)))
    if length:
        d = d.withColumn(length, F.when(F.size("_spans") > 0, F.length(text).cast("long")).otherwise(F.col(length)))
    return d.select(docs.columns)
