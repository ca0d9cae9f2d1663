"""WARC archives with a two-level capture index.

Pages are dealt out by ranges of their reversed-host keys and written in that
order, one archive a task: a gzip member for every record, so any record can be
read by its range.  The same task writes the index beside the archive:

* blocks: ``BLOCK`` lines "key <tab> archive offset, length, ..." compressed;
* directory: a row a block with its first and last key and where it lies.  For
  lookups one task writes it sorted to a file with an offset for every row.

The same key deals rows out and is indexed, so blocks follow each other in the
order of keys.  A lookup binary-searches the directory file by range reads for
the blocks that can hold its key, on executors; a second exchange deals these
blocks out, and their tasks decompress them, binary-search their lines and read
the records' ranges.  So neither the directory nor a key of many blocks passes
through the driver.  As archives have the index's order, a block's records are
neighbours.  op1 asks for every record and so reads all blocks without a search.

Records with equal payloads of at least ``REVISIT_BYTES`` are stored once: the
one with the largest page_id is the response, the others are revisits of it.

Defined cases: a null html is an empty payload; a null url has the key "" and
no WARC-Target-URI; several rows of one page_id and payload are all the response
if theirs is the largest page_id; a null page_id keeps its row and is nobody's
response; an empty table writes nothing and reads back as no rows.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import batched, fresh_dir, read_table, save
from .files import Reader, write_new

REVISIT_BYTES = 1000
BLOCK = 1000
_DATE = "2000-01-01T00:00:00Z"
_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


#: Host, port, and path with query of a URL, in Java's and Python's syntax.
_URL = r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]*)(?::([0-9]*))?((?:[/?][^#]*)?)(?:#.*)?$"
_DEFAULT_PORTS = ("", "80", "443")


def url_key_column(url: Column) -> Column:
    """Reversed host, then the rest: com,example)/path?query; what is no URL is its own key."""
    host, port, rest = (F.regexp_extract(url, _URL, i) for i in (1, 2, 3))
    host = F.array_join(F.reverse(F.split(F.regexp_replace(F.lower(host), r"\.+$", ""), r"\.")), ",")
    port = F.when(port.isin(*_DEFAULT_PORTS), "").otherwise(F.concat(F.lit(":"), port))
    key = F.concat(host, port, F.lit(")"), F.when(rest.startswith("/"), "").otherwise("/"), rest)
    return F.when(F.coalesce(url, F.lit("")) == "", "").when(url.rlike(_URL), key).otherwise(url)


def url_key(url: str | None) -> str:
    """``url_key_column`` of one URL."""
    if not url or not (m := re.match(_URL, url)):
        return url or ""
    host, port, rest = m[1].lower().rstrip("."), m[2] or "", m[3]
    return ",".join(reversed(host.split("."))) + ("" if port in _DEFAULT_PORTS else ":" + port) + ")" + ("" if rest.startswith("/") else "/") + rest


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit without the payload."""
    revisit = refers_to is not None
    name = "null" if page_id is None else str(page_id)
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {_DATE}",
        *([f"WARC-Target-URI: {''.join(url.split())}"] if url else []),
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields and its payload (after the HTTP head)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def _page(name: str) -> int | None:
    name = name.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else int(name)


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, digest, refers_to) of the pages of (page_id, url, digest, size) that revisit another.

    No payload travels: counts are summed before they are sent, and a digest of
    any number of pages meets its one row in a sorted join that adaptive
    execution splits.
    """
    large = pages.where(F.col("size") >= REVISIT_BYTES)
    shared = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("refers_to"))
    return large.join(shared, "digest").where(other).select("page_id", "url", "digest", "refers_to")


def write_archives(pages: DataFrame) -> DataFrame:
    """Write (page_id, url, html) as archives and index blocks; returns the directory.

    Directory: first_key, last_key, n (lines), file (of blocks), start, length.
    """
    spark = pages.sparkSession
    folder = fresh_dir(spark, "warc")
    typed = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    hashed = typed.select("page_id", "url", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("size"), "html")
    # A note on each revisit goes the way of its page and lies just before it, so the payloads move once.
    notes = revisits(hashed.drop("html")).select("page_id", "url", "digest", "refers_to", F.lit(None).cast("string").alias("html"))
    rows = notes.unionByName(hashed.select("page_id", "url", "digest", F.lit(None).cast("long").alias("refers_to"), "html"))
    order = ["key", "page_id", "digest"]
    ordered = rows.withColumn("key", url_key_column(F.col("url"))).repartitionByRange(*order).sortWithinPartitions(*order, F.col("html").isNotNull())

    def write(batches):
        lines: list[tuple[str, str]] = []

        def archive():
            offset, note = 0, None
            for batch in batches:
                for first in range(0, batch.num_rows, 500):
                    for page, url, digest, refers, html, key in zip(*(c.to_pylist() for c in batch.slice(first, 500).columns), strict=True):
                        if html is None:
                            note = (page, digest, refers)
                            continue
                        refers = note[2] if note and note[:2] == (page, digest) else None
                        raw = record(page, url, html.encode(), digest, refers)
                        z = zlib.compressobj(4, zlib.DEFLATED, 31)
                        packed = z.compress(raw) + z.flush()
                        line = json.dumps({"url": url, "digest": digest, "offset": offset, "length": len(packed)}, ensure_ascii=True)
                        lines.append((key, line))
                        offset += len(packed)
                        yield packed

        chunks = archive()
        head = next(chunks, None)
        if head is None:
            return
        file = write_new(folder, ".warc.gz", (c for some in ((head,), chunks) for c in some))
        lines.sort()
        out, blocks, start = [], [], 0
        for first in range(0, len(lines), BLOCK):
            some = lines[first : first + BLOCK]
            packed = zlib.compress("\n".join([file, *(f"{k}\t{line}" for k, line in some)]).encode(), 6)
            blocks.append(packed)
            out.append((some[0][0], some[-1][0], len(some), start, len(packed)))
            start += len(packed)
        index = write_new(folder, ".cdx.zz", blocks)
        first, last, n, at, length = zip(*out, strict=True)
        yield pa.RecordBatch.from_pydict({"first_key": first, "last_key": last, "n": pa.array(n, pa.int64()), "file": [index] * len(n), "start": pa.array(at, pa.int64()), "length": pa.array(length, pa.int64())})

    return save(ordered.mapInArrow(write, "first_key string, last_key string, n long, file string, start long, length long"), "warc-directory")


def _block(raw: bytes) -> tuple[str, list[str]]:
    archive, *lines = zlib.decompress(raw).decode().split("\n")
    return archive, lines


def _result(packed: bytes, entry: dict) -> tuple:
    """The row of one record; its payload is checked against its digest."""
    fields, payload = parse(zlib.decompress(packed, 31))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"damaged record at {entry['offset']}")
    size = len(payload) if kind == "response" else int(fields["X-Payload-Length"])
    refers = _page(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return _page(fields["WARC-Record-ID"]), entry["url"], size, digest, kind, refers


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archives(directory: DataFrame) -> DataFrame:
    """Every record, by way of the index; neighbouring ranges are read at once."""

    def read(batches):
        for batch in batches:
            for path, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with Reader(path) as blocks:
                    archive, lines = _block(blocks.read(start, length))
                entries = sorted((json.loads(line.partition("\t")[2]) for line in lines), key=lambda e: e["offset"])
                with Reader(archive) as file:
                    for first in range(0, len(entries), 100):
                        some = entries[first : first + 100]
                        spans = [(e["offset"], e["length"]) for e in some]
                        lo, hi = spans[0][0], sum(spans[-1])
                        if hi - lo < 4 * sum(n for _, n in spans):
                            raw = file.read(lo, hi - lo)
                            packed = [raw[at - lo : at - lo + n] for at, n in spans]
                        else:
                            packed = [file.read(*span) for span in spans]
                        yield _rows([_result(p, e) for p, e in zip(packed, some, strict=True)])

    n = max(1, int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return directory.select("file", "start", "length").repartition(n).mapInArrow(read, _SCHEMA)


class SortedDirectory:
    """A directory file: rows of (first key, last key, file, start, length) in order, any of which a range read finds.

    Layout: rows as JSON lines | a uint64 offset of each row, and of their end | their number.
    """

    def __init__(self, path: str):
        self.file = Reader(path)
        self.n = int.from_bytes(self.file.read(self.file.size - 8, 8), "little")
        self.offsets = self.file.size - 8 - 8 * (self.n + 1)
        self._row = lru_cache(maxsize=4096)(self._read)

    @staticmethod
    def chunks(rows) -> Iterator[bytes]:
        offsets = [0]
        for row in rows:
            line = json.dumps(row).encode()
            offsets.append(offsets[-1] + len(line))
            yield line
        yield struct.pack(f"<{len(offsets) + 1}Q", *offsets, len(offsets) - 1)

    def _read(self, i: int) -> list:
        start, end = struct.unpack("<2Q", self.file.read(self.offsets + 8 * i, 16))
        return json.loads(self.file.read(start, end - start))

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, start, length) of the blocks that can hold ``key``: the first by binary search, then its neighbours."""
        i = bisect.bisect_left(range(self.n), key, key=lambda j: self._row(j)[1])
        while i < self.n and (row := self._row(i))[0] <= key:
            yield tuple(row[2:])
            i += 1


def sorted_directory(directory: DataFrame) -> str:
    """The path of the directory's file, which one task writes once (a row stands for BLOCK records)."""
    if getattr(directory, "_sorted_at", None) is None:
        folder = fresh_dir(directory.sparkSession, "warc-sorted")

        def write(batches):
            rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            yield pa.RecordBatch.from_pydict({"path": [write_new(folder, ".directory", SortedDirectory.chunks(rows))]})

        columns = ["first_key", "last_key", "file", "start", "length"]
        ordered = directory.select(*columns).repartition(1).sortWithinPartitions(*columns)
        directory._sorted_at = save(ordered.mapInArrow(write, "path string"), "warc-sorted-path").first().path
    return directory._sorted_at


def blocks_of(directory: DataFrame, key: str) -> list[tuple[str, int, int]]:
    """(file, start, length) of the blocks that can hold ``key``."""
    return list(SortedDirectory(sorted_directory(directory)).blocks(key))


def read_urls(directory: DataFrame, urls: DataFrame) -> DataFrame:
    """The records of a table (url) of URLs (null: the records without one), each URL's once however often it is asked for."""
    path = sorted_directory(directory)
    n = int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def search(batches):
        known = SortedDirectory(path)
        for batch in batches:
            out = [(*block, key, url) for url, key in zip(*(c.to_pylist() for c in batch.columns), strict=True) for block in known.blocks(key)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["file", "start", "length", "key", "url"])

    def read(batches):
        last, archive, lines = None, "", []
        for batch in batches:
            out = []
            for path, start, length, key, url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last != (path, start):
                    with Reader(path) as blocks:
                        archive, lines = _block(blocks.read(start, length))
                    last = path, start
                i = bisect.bisect_left(lines, key, key=lambda line: line.partition("\t")[0])
                with Reader(archive) as file:
                    while i < len(lines) and lines[i].startswith(key + "\t"):
                        entry = json.loads(lines[i].partition("\t")[2])
                        i += 1
                        if entry["url"] == url:
                            out.append(_result(file.read(entry["offset"], entry["length"]), entry))
                        if len(out) >= 500:
                            yield _rows(out)
                            out = []
            if out:
                yield _rows(out)

    asked = urls.select("url").distinct().withColumn("key", url_key_column(F.col("url"))).sortWithinPartitions("key")
    found = asked.mapInArrow(search, "file string, start long, length long, key string, url string")
    return found.repartition(n, "file", "start").sortWithinPartitions("file", "start", "key").mapInArrow(read, _SCHEMA)


def read_url(directory: DataFrame, url: str | None) -> DataFrame:
    """The records of one URL (null: those without)."""
    return read_urls(directory, directory.sparkSession.createDataFrame([(url,)], "url string"))


def lookup(directory: DataFrame, url: str | None) -> list[tuple]:
    """``read_url``'s records, collected."""
    return [tuple(r) for r in read_url(directory, url).collect()]


@batched
def op1_warc(spark, sf_dir: str) -> DataFrame:
    directory = write_archives(read_table(spark, sf_dir, "pages"))
    return read_archives(directory).drop("url")


@batched
def warc_lookup(spark, sf_dir: str) -> DataFrame:
    """Every page looked up by its URL: directory, block, record."""
    pages = read_table(spark, sf_dir, "pages")
    return read_urls(write_archives(pages), pages).select("page_id", "url", "payload_digest")


LOOKUP_SQL = "SELECT page_id, url, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages"

OP1_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
k AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to FROM k
"""
