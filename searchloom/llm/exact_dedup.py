"""Exact dedup by progressive refinement: group by length, then by a prefix's hash, then by the full hash.

Texts are equal when they are the same after white space (``WHITE``) is deleted.

1. One scan writes each row's length and prefix hash, 16 bytes a row; counts by
   length, summed before they are sent, leave the lengths that repeat.
2. Rows of these lengths are counted by (length, prefix hash).
3. A second scan takes the full SHA-256 of those rows alone whose (length, prefix
   hash) repeats; only these rows' hashes are shuffled, and groups are of them.

What repeats travels to the next step as a bitmap of ``BITS`` bits, 8 MB at most
whatever the input: two keys on one bit only cost a needless count or hash, and
the next level tells them apart.  Hot groups are counted before they are sent;
rows learn of their group in a sorted join, which adaptive execution splits.

Defined cases: a null text counts as empty; of a group the row of most code
points in the original text stays, then that of the least doc_id (a null one
last), then the first in the input; so of repeated rows exactly one stays.
Other columns pass through; one with the name of a new column is replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc, fs, parquet
from pyspark.sql import Column, DataFrame, functions as F

from ..session import fresh_dir, ship
from .common import batched, besides, read_table, save, unused
from .files import filesystem
from .line_dedup import numbered

#: Fixed value: the characters that don't count.
WHITE = b" \t\n\x0b\x0c\r"
#: Bytes of the hashed prefix, and bits of a bitmap.
PREFIX, BITS = 256, 1 << 26


def _bodies(texts: pa.Array):
    """The texts' bytes without white space; null counts as empty."""
    for text in texts.cast(pa.binary()):
        yield (text.as_py() or b"").translate(None, WHITE)


def _prefix_hash(body: bytes) -> int:
    """64 bits of the length and the first PREFIX bytes."""
    return int.from_bytes(hashlib.blake2b(body[:PREFIX], digest_size=8, salt=len(body).to_bytes(8, "little")).digest(), "little", signed=True)


def _sized(batches):
    for batch in batches:
        found = [(len(b), _prefix_hash(b)) for b in _bodies(batch.column(0))]
        n, p = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_pydict({"n": pa.array(n, pa.int64()), "p": pa.array(p, pa.int64())})


def _key(value: Column) -> Column:
    """A long's place in a bitmap, from 1."""
    return value.bitwiseAND(F.lit(BITS - 1)) + 1


def _bitmap(keys: DataFrame, path: str) -> DataFrame:
    """(bucket, bits) of a table of keys ``k``, written to the path: at most BITS / 32768 rows of 4096 bytes."""
    found = keys.groupBy(F.bitmap_bucket_number("k").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("bits"))
    found.write.parquet(path)
    return keys.sparkSession.read.schema("bucket long, bits binary").parquet(path)


def _among(rows: DataFrame, key: Column, bitmap: DataFrame) -> DataFrame:
    """The rows whose key's bit is set; the bitmap is broadcast, at most BITS / 8 bytes."""
    at = F.bitmap_bit_position(key)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0
    return rows.join(F.broadcast(bitmap), (F.bitmap_bucket_number(key) == F.col("bucket")) & is_set, "left_semi")


def _read_bits(path: str) -> np.ndarray:
    """The bytes of a bitmap, read in a task: BITS / 8 of them."""
    system, base = filesystem(path)
    out = np.zeros((BITS // 32768, 4096), np.uint8)
    for info in system.get_file_info(fs.FileSelector(base)):
        if info.base_name.endswith(".parquet"):
            with system.open_input_file(info.path) as file:
                found = parquet.read_table(file, columns=["bucket", "bits"])
            for bucket, bits in zip(found["bucket"].to_pylist(), found["bits"], strict=True):
                out[bucket - 1] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out.ravel()


def _hashed(path: str):
    """(row, doc_id, text) to (r, d, chars, n, h) of the rows whose length and prefix hash are in the bitmap."""

    def run(batches):
        bits = None
        for batch in batches:
            bits = _read_bits(path) if bits is None else bits
            at, n, h = [], [], []
            for i, body in enumerate(_bodies(batch.column(2))):
                key = _prefix_hash(body) & (BITS - 1)
                if bits[key >> 3] >> (key & 7) & 1:
                    at.append(i)
                    n.append(len(body))
                    h.append(hashlib.sha256(body).digest())
            chars = pc.fill_null(pc.utf8_length(batch.column(2)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in (batch.column(0), batch.column(1), chars)), pa.array(n, pa.int64()), pa.array(h, pa.binary())], names=["r", "d", "chars", "n", "h"])

    return run


def copies(base: DataFrame, row: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(row, keep_id, group_size, kept) of the rows that have equals, of a table whose column ``row`` numbers its rows.

    Which row of its equals stays, how many there are, and whether it is this one.
    """
    folder = fresh_dir(base.sparkSession, "copies")
    facts = save(base.select(text).mapInArrow(_sized, "n long, p long"), "lengths")
    lengths = _bitmap(facts.groupBy("n").count().where("count > 1").select(_key(F.col("n")).alias("k")), f"{folder}/lengths")
    prefixes = _among(facts, _key(F.col("n")), lengths).groupBy("n", "p").count().where("count > 1")
    _bitmap(prefixes.select(_key(F.col("p")).alias("k")), f"{folder}/prefixes")

    kind = base.schema[doc_id].dataType.simpleString()
    hashed = save(base.select(row, doc_id, text).mapInArrow(_hashed(f"{folder}/prefixes"), f"r long, d {kind}, chars long, n long, h binary"), "full-hashes")
    order = F.struct((-F.col("chars")).alias("c"), F.col("d").isNull().alias("no_id"), "d", "r")
    groups = save(hashed.groupBy("n", "h").agg(F.min(order).alias("best"), F.count("*").alias("size")).where("size > 1"), "copy-groups")
    found = hashed.select("r", "n", "h").join(groups, ["n", "h"])
    return save(found.select(F.col("r").alias(row), F.col("best.d").alias("keep_id"), F.col("size").alias("group_size"), (F.col("best.r") == F.col("r")).alias("kept")), "copies")


def _with_groups(base: DataFrame, row: str, found: DataFrame, doc_id: str, shown: list[str]) -> DataFrame:
    """The ``shown`` columns of ``base`` and what ``copies`` found; a row without equals stays alone."""
    c = lambda side, name: F.col(f"{side}.`{name}`")
    alone = c("found", "group_size").isNull()
    keep = F.when(alone, c("base", doc_id)).otherwise(c("found", "keep_id")).alias("keep_id")
    size, kept = F.coalesce(c("found", "group_size"), F.lit(1).cast("long")).alias("group_size"), F.coalesce(c("found", "kept"), F.lit(True)).alias("kept")
    return base.alias("base").join(found.alias("found"), c("base", row) == c("found", row), "left").select(*(c("base", x) for x in shown), keep, size, kept)


def mark_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with keep_id, group_size and kept."""
    row = unused(docs, "_row")
    ship(docs.sparkSession)
    base = numbered(docs, row)
    return _with_groups(base, row, copies(base, row, text, doc_id), doc_id, [docs.columns[i] for i in besides(docs, ("keep_id", "group_size", "kept"))])


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that ``mark_copies`` doesn't keep."""
    row = unused(docs, "_row")
    ship(docs.sparkSession)
    base = numbered(docs, row)
    gone = copies(base, row, text, doc_id).where("not kept").select(row)
    return base.join(gone, row, "left_anti").select(*docs.columns)


def _digested(batches):
    """(row, doc_id, text) to (row, doc_id, the normalised text's SHA-256)."""
    for batch in batches:
        digests = [hashlib.sha256(b).hexdigest() for b in _bodies(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.string())], names=["row", "doc_id", "text_sha256"])


@batched
def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    base = numbered(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "row")
    digests = base.select("row", "doc_id", "text").mapInArrow(_digested, "row long, doc_id long, text_sha256 string")
    return _with_groups(digests, "row", copies(base, "row"), "doc_id", ["doc_id", "text_sha256"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


_BODY = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"
OP11_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(length(text), 0) AS chars, {_BODY} AS body, row_number() OVER () AS r FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY chars DESC, doc_id NULLS LAST, r) AS place, count(*) OVER (PARTITION BY body) AS n FROM t),
best AS (SELECT body, doc_id AS keep_id FROM o WHERE place = 1)
SELECT doc_id, keep_id, n AS group_size, place = 1 AS kept, sha256(o.body) AS text_sha256 FROM o JOIN best ON best.body = o.body"""
