"""WARC archives of pages with a two-level capture index.

``write`` turns every page into a WARC record; of records with equal payloads that with the smallest page_id holds the payload, the others
revisit it. Archives are the part files of Spark's text writer, on whatever file system the shared folder is.
Every record starts with a mark drawn for the archive, so records can be told apart
whatever payloads hold, and large archives can be read in pieces by many tasks.

``build_index`` is the two-level index: captures are sorted by reversed host, packed into compressed blocks of ``LINES`` lines, and a sparse directory
holds the first and last key of each block. ``lookup`` (a list of URLs) and ``locate`` (a table of any size) binary-search the directory for each URL and
open only those blocks; ``fetch`` reads only the byte ranges they point to, in tasks, from whatever file system the archives are on.

Defined cases: a null payload is empty. Equal payloads below ``LEAST_BYTES`` are all responses. A null url has the empty key. A null
page_id takes no part in choosing the smallest; if no other has its payload it is a response. Rows that repeat a page are each a record. Without pages there
are no archives and no records. Further columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions.storage import new_path, stored

LEAST_BYTES = 0
LINES = 500
BROADCAST_ROWS = 200_000
MAX_URLS = 100_000
PIECE = 64 << 20  # bytes of an archive that one task fetches
SPAN, GAP = 4 << 20, 64 << 10  # ranges no further apart than the gap are read at once, up to a span
CRLF = "\r\n"
END = CRLF + CRLF
DATE = "2026-01-01T00:00:00Z"
DIGITS32, ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text's UTF-8: eight times five hex digits, each four base32 digits."""
    h = F.sha1(text)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS32, ALPHABET)


@dataclass
class Archive:
    """Where the records are, and the mark that starts each."""

    spark: SparkSession
    path: str
    mark: str

    @property
    def opening(self) -> str:
        return f"WARC/1.1{CRLF}WARC-Archive-Mark: {self.mark}{CRLF}"


def _target(url: Column) -> Column:
    """A url as its record states it."""
    return F.regexp_replace(url.cast("string"), "[\\r\\n]", "")


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES) -> Archive:
    """Write one record per row."""
    d = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    d = d.withColumns({"same": F.sha2(F.col("payload").cast("binary"), 256), "bytes": F.octet_length("payload")})
    firsts = stored(d.groupBy("same", "bytes").agg(F.count("*").alias("n"), F.min("id").alias("first"))
                    .where((F.col("n") > 1) & (F.col("bytes") >= least_bytes)).select(F.col("same").alias("f_same"), "first"), "firsts")
    if firsts.count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    d = d.join(firsts, F.col("same") == F.col("f_same"), "left").withColumn(
        "refers_to", F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id")), F.col("first")))
    archive = Archive(pages.sparkSession, new_path(pages.sparkSession, "warc"), uuid.uuid4().hex)
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    fields = {
        "WARC-Type": F.when(revisit, "revisit").otherwise("response"),
        "WARC-Record-ID": F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">")),
        "WARC-Date": F.lit(DATE),
        "WARC-Target-URI": _target(F.col("url")),
        "WARC-Payload-Digest": F.concat(F.lit("sha1:"), base32_sha1(F.col("payload"))),
        "WARC-Refers-To": F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")),
        "WARC-Profile": F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        "Content-Type": F.lit("application/http; msgtype=response"),
        "Content-Length": F.octet_length(block).cast("string"),
    }
    head = F.concat(*[F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit(CRLF)), F.lit("")) for k, v in fields.items()])
    d.select(F.concat(F.lit(archive.opening), head, F.lit(CRLF), block).alias("value")).write.option("lineSep", END).text(archive.path)
    return archive


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, f"(?m)^{name}: ([^\\r\\n]*)", 1)
    return F.when(found != "", found)


def read(archive: Archive, files: list[str] | None = None) -> DataFrame:
    """Every record of the archive (or of some of its files): id, url, type, payload, payload_bytes, payload_digest, refers_to, file, offset, length.

    Digests and lengths of responses are taken from the payloads read; a revisit states those of what it refers to."""
    spark = archive.spark
    between = END + archive.opening
    lines = (spark.read.option("lineSep", between).text(files or archive.path)
             .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"))
             .withColumn("seq", F.monotonically_increasing_id()))
    lead = len(archive.opening)
    first = F.col("value").startswith(archive.opening)
    d = lines.withColumn("body", F.when(first, F.substring("value", lead + 1, 1 << 30)).otherwise(F.col("value")))
    d = d.withColumn("head", F.substring_index("body", END, 1))
    d = d.withColumn("block", F.expr(f"substring(body, length(head) + {len(END) + 1})"))
    d = d.withColumn("payload", F.expr(f"substring(block, length(substring_index(block, '{END}', 1)) + {len(END) + 1})"))
    stated = _field(F.col("head"), "Content-Length").cast("long")
    # the last record of a file still has its closing line ends
    d = d.withColumn("payload", F.when(F.octet_length("block") > stated, F.expr(f"left(payload, length(payload) - {len(END)})")).otherwise(F.col("payload")))
    said = _field(F.substring_index("block", END, 1), "Content-Length").cast("long")
    kind = _field(F.col("head"), "WARC-Type")
    number = "^<urn:page:(.*)>$"
    d = d.withColumn("size", (F.octet_length("value") - F.when(first, lead).otherwise(0)).cast("long"))
    within = Window.partitionBy("file").orderBy("piece", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one file's records
    narrow = d.select(
        F.regexp_extract(_field(F.col("head"), "WARC-Record-ID"), number, 1).alias("id"), _field(F.col("head"), "WARC-Target-URI").alias("url"), kind.alias("type"),
        F.when(kind == "response", F.octet_length("payload")).otherwise(said).cast("long").alias("payload_bytes"),
        F.when(kind == "response", base32_sha1(F.col("payload"))).otherwise(F.substring(_field(F.col("head"), "WARC-Payload-Digest"), 6, 32)).alias("payload_digest"),
        F.regexp_extract(F.coalesce(_field(F.col("head"), "WARC-Refers-To"), F.lit("")), number, 1).alias("refers_to"),
        "file", "piece", "seq", "size", *(["payload"] if files else []))
    return narrow.withColumns({
        "refers_to": F.when(F.col("refers_to") != "", F.col("refers_to")),
        "offset": F.coalesce(F.sum(F.col("size") + len(between)).over(within), F.lit(0)),
        "length": F.col("size") + len(between)}).drop("piece", "seq", "size")


def url_key(url: str | None) -> str:
    """Reversed host, then the path: http://a.example.com/x?y becomes com,example,a)/x?y."""
    if not url:
        return ""
    try:
        p = urlsplit(url.strip())
    except ValueError:
        return url
    host = (p.hostname or "").lower().split(".")
    return ",".join(reversed(host)) + ")" + (p.path or "/") + (f"?{p.query}" if p.query else "")


@dataclass
class CaptureIndex:
    """``blocks``: (block, first, last, lines, data); ``directory``: the same without the data."""

    blocks: DataFrame
    directory: DataFrame


COLUMNS = ("key", "id", "file", "offset", "length")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The key of a url for the url, with the columns that follow it."""
    for b in batches:
        keys = pa.array([url_key(u) for u in b.column(0).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([keys, *b.columns[1:]], names=["key", *b.schema.names[1:]])


def build_index(records: DataFrame) -> CaptureIndex:
    """Sort captures by key into compressed blocks, and keep a directory of the blocks."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def block(some: list[tuple]) -> pa.RecordBatch:
            data = gzip.compress("\n".join(json.dumps(r, ensure_ascii=False) for r in some).encode(), mtime=0)
            return pa.RecordBatch.from_arrays([pa.array([some[0][0]]), pa.array([some[-1][0]]), pa.array([len(some)], pa.int32()), pa.array([data], pa.binary())],
                                              names=["first", "last", "lines", "data"])

        for b in batches:
            rows.extend(zip(*(c.to_pylist() for c in b.columns)))
            while len(rows) >= LINES:
                yield block(rows[:LINES])
                rows = rows[LINES:]
        if rows:
            yield block(rows)

    keys = records.select("url", "id", "file", "offset", "length").mapInArrow(_keyed, "key string, id string, file string, offset long, length long")
    ordered = keys.repartitionByRange("key", "id", "file", "offset").sortWithinPartitions("key", "id", "file", "offset")
    blocks = ordered.mapInArrow(packed, "first string, last string, lines int, data binary").withColumn("block", F.monotonically_increasing_id())
    blocks = stored(blocks, "capture-blocks")
    return CaptureIndex(blocks, stored(blocks.drop("data"), "capture-directory"))


def opened(blocks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The captures of some blocks: key, id, file, offset, length; only those of the sorted ``keys`` if given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = [json.loads(x) for x in gzip.decompress(data).decode().split("\n")]
                if keys is not None:
                    rows = [r for r in rows if (i := bisect.bisect_left(keys, r[0])) < len(keys) and keys[i] == r[0]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)] if rows else [pa.array([], t) for t in (pa.string(),) * 3 + (pa.int64(),) * 2],
                                                 names=list(COLUMNS))

    return blocks.select("data").mapInArrow(run, "key string, id string, file string, offset long, length long")


def lookup(index: CaptureIndex, urls: list[str]) -> DataFrame:
    """The captures of up to ``MAX_URLS`` urls: each directory row finds by binary search whether a wanted key can lie in its block."""
    if len(urls) > MAX_URLS:
        raise ValueError(f"more than {MAX_URLS} urls at once")
    keys = sorted({url_key(u) for u in urls})

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = [bisect.bisect_left(keys, lo) < bisect.bisect_right(keys, hi) for lo, hi in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["block"]).filter(pa.array(hit, pa.bool_()))

    found = index.directory.select("block", "first", "last").mapInArrow(wanted, "block long")
    return opened(index.blocks.join(F.broadcast(found), "block", "left_semi"), keys)  # MAX_URLS blocks and their neighbours at most


def locate(index: CaptureIndex, urls: DataFrame, url: str = "url") -> DataFrame:
    """The captures of a table of urls, as :func:`lookup` finds those of a list.

    The directory, a row per ``LINES`` captures, is sent to the tasks; they binary-search it for the blocks that a key can lie in."""
    keys = stored(urls.select(_target(F.col(url)).alias("key")).distinct().mapInArrow(_keyed, "key string").distinct(), "wanted-keys")
    table = index.directory.select("first", "last", "block").toArrow()
    # block numbers ascend with the keys, so both ends of the blocks are sorted
    ends = sorted(zip(*(table.column(c).to_pylist() for c in ("block", "first", "last"))))
    shared = urls.sparkSession.sparkContext.broadcast(tuple([e[i] for e in ends] for i in range(3)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, firsts, lasts = shared.value
        for b in batches:
            hit = {n for k in b.column(0).to_pylist() for n in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))}
            yield pa.RecordBatch.from_arrays([pa.array([blocks[n] for n in sorted(hit)], pa.int64())], names=["block"])

    found = keys.mapInArrow(run, "block long").distinct()
    return opened(index.blocks.join(found, "block", "left_semi")).join(keys, "key", "left_semi")


FETCHED = "id string, url string, type string, payload string, payload_bytes long, payload_digest string, refers_to string, file string, offset long, length long"
URN = re.compile(r"^<urn:page:(.*)>$")


def _parsed(data: memoryview, lead: int, with_payload: bool) -> tuple:
    """The columns of :func:`read` for the record whose bytes these are."""
    raw = bytes(data[lead:])
    head, _, rest = raw.partition(END.encode())
    said = dict(line.split(": ", 1) for line in head.decode().split(CRLF) if ": " in line)
    http, _, payload = rest[:int(said["Content-Length"])].partition(END.encode())
    response = said["WARC-Type"] == "response"
    size = len(payload) if response else int(http.rsplit(b"Content-Length: ", 1)[1].split(CRLF.encode())[0])
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if response else said["WARC-Payload-Digest"].removeprefix("sha1:")
    refers = URN.match(said.get("WARC-Refers-To", ""))
    return (URN.match(said["WARC-Record-ID"]).group(1), said.get("WARC-Target-URI") or None, said["WARC-Type"], payload.decode() if with_payload else None,
            size, digest, refers.group(1) if refers else None)


def fetch(archive: Archive, captures: DataFrame, payload: bool = True) -> DataFrame:
    """The records that a lookup found, as :func:`read` gives them; only their byte ranges are read. ``payload`` says whether to bring the payloads."""
    spark, lead = archive.spark, len(archive.opening)
    wanted = stored(captures.select("file", "offset", "length").distinct(), "wanted-ranges")
    total = wanted.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    parts = max(spark.sparkContext.defaultParallelism, -(-total // PIECE))
    dealt = wanted.repartition(parts, "file", F.floor(F.col("offset") / (PIECE // 8))).sortWithinPartitions("file", "offset")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """Runs of ranges that lie close together in one file."""
        at, some = None, []
        for b in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if some and (file != at or offset - sum(some[-1]) > GAP or offset + length - some[0][0] > SPAN):
                    yield at, some
                    some = []
                at = file
                some.append((offset, length))
        if some:
            yield at, some

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, source = None, None
        for file, some in spans(batches):
            if file != at:
                system, path = fs.FileSystem.from_uri(file)
                at, source = file, system.open_input_file(path)
            start = some[0][0]
            data = memoryview(source.read_at(sum(some[-1]) - start, start))
            rows = [(*_parsed(data[o - start:o - start + n], lead, payload), file, o, n) for o, n in some]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i in (4, 8, 9) else pa.string()) for i, c in enumerate(zip(*rows))],
                                             names=[f.split(" ")[0] for f in FETCHED.split(", ")])

    return dealt.mapInArrow(run, FETCHED)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the pages, index the archives, look every url up in the index and fetch what it points to."""
    archive = write(pages, page_id, url, html)
    records = stored(read(archive).select("url", "id", "file", "offset", "length"), "records")
    captures = locate(build_index(records), pages, url)
    kind = pages.schema[page_id].dataType
    return fetch(archive, captures, payload=False).select(
        F.when(F.col("id") != "", F.col("id")).cast(kind).alias(page_id), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"))
