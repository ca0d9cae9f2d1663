"""Token-id shards: fixed-width bit packing with random access.

Every id takes the fewest bits that hold the vocabulary.  A shard is

    blocks | block offsets | document starts | document ids | id present | footer (struct ``FOOTER``)

Blocks hold ``BLOCK`` ids each (the last may hold fewer), padded to whole bytes;
their byte offsets, and the documents' starts in ids, are uint64 arrays, so any
span of ids is one range read and one vectorised unpacking.  Blocks are written
as they fill; a task holds one block and the tables, 25 bytes a document.

Documents are dealt out by ranges of doc_id (and of their texts' beginnings, so
that one id's many rows are spread) and sorted in each, one shard a task; only
the shards' id counts (a row a shard) reach the driver, which turns them into the
shards' first positions.

Defined cases: null and empty texts are the end id alone; a null doc_id sorts
first and stays null; rows with one doc_id keep an order by text; an empty table
writes nothing and reads back as no rows; other columns aren't stored.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import encoder, forget
from .common import batched, fresh_dir, read_table, save
from .files import Reader, write_new

MAGIC = b"SLTOKEN1"
#: magic, bits an id, ids a block, ids, blocks, documents
FOOTER = struct.Struct("<8sIIQQQ")
#: Characters of a text that deal out rows of one id.
BEGINNING = 8
BLOCK = 4096


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0..vocabulary-1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as ``bits``-bit big-endian fields, padded to whole bytes."""
    if bits == 16:
        return ids.astype(">u2").tobytes()
    field = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(field.ravel()).tobytes()


def unpack(data: bytes, bits: int, skip: int, count: int) -> np.ndarray:
    """``count`` ids after the first ``skip`` of packed ``data``."""
    if bits == 16:
        return np.frombuffer(data, ">u2", count, skip * 2).astype("<u4")
    field = np.unpackbits(np.frombuffer(data, np.uint8), count=(skip + count) * bits)[skip * bits :].reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - bits :] = field
    return np.packbits(wide, axis=1).view(">u4").ravel().astype("<u4")


class ShardWriter:
    """The bytes of one shard, as its documents come."""

    def __init__(self, bits: int):
        self.bits, self.total, self.written = bits, 0, 0
        self.rest: list[np.ndarray] = []
        self.held = 0
        self.offsets, self.starts, self.doc_ids, self.present = array("Q"), array("Q"), array("q"), array("B")

    def _blocks(self, ids: np.ndarray) -> Iterator[bytes]:
        for i in range(0, len(ids), BLOCK):
            block = pack(ids[i : i + BLOCK], self.bits)
            self.offsets.append(self.written)
            self.written += len(block)
            yield block

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[bytes]:
        """Takes a document; the blocks that are full now."""
        self.doc_ids.append(doc_id or 0)
        self.present.append(doc_id is not None)
        self.starts.append(self.total)
        self.total += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= 16 * BLOCK:
            some = np.concatenate(self.rest)
            full = len(some) // BLOCK * BLOCK
            self.rest, self.held = [some[full:]], len(some) - full
            yield from self._blocks(some[:full])

    def end(self) -> Iterator[bytes]:
        """The last block, the tables and the footer."""
        yield from self._blocks(np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32))
        for table, kind in ((self.offsets, "<u8"), (self.starts, "<u8"), (self.doc_ids, "<i8"), (self.present, "u1")):
            yield np.array(table, kind).tobytes()
        yield FOOTER.pack(MAGIC, self.bits, BLOCK, self.total, len(self.offsets), len(self.starts))


class ShardReader:
    """Random access to the ids and documents of one shard."""

    def __init__(self, path: str):
        self.file = Reader(path)
        magic, self.bits, self.block, self.total, blocks, docs = FOOTER.unpack(self.file.read(self.file.size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token shard")
        tail = blocks * 8 + docs * 17
        self.end = self.file.size - FOOTER.size - tail
        raw = self.file.read(self.end, tail)
        self.offsets = np.append(np.frombuffer(raw, "<u8", blocks), np.uint64(self.end)).astype(np.int64)
        self.starts = np.append(np.frombuffer(raw, "<u8", docs, blocks * 8), np.uint64(self.total)).astype(np.int64)
        self.doc_ids = np.frombuffer(raw, "<i8", docs, blocks * 8 + docs * 8)
        self.present = np.frombuffer(raw, np.uint8, docs, blocks * 8 + docs * 16).astype(bool)

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from position ``start``: one range read."""
        if not count:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (start + count - 1) // self.block
        data = self.file.read(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        return unpack(data, self.bits, start - first * self.block, count)  # BLOCK ids fill whole bytes, whatever the width

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1] - self.starts[i]))

    def documents(self, span: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in this shard, ids) of every document, read in spans of about ``span`` ids."""
        i, n = 0, len(self.doc_ids)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + span, "right")) - 1)
            some = self.ids(int(self.starts[i]), int(self.starts[j] - self.starts[i]))
            for k in range(i, j):
                at = self.starts[k] - self.starts[i]
                yield (int(self.doc_ids[k]) if self.present[k] else None), int(self.starts[k]), some[at : at + self.starts[k + 1] - self.starts[k]]
            i = j


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write all texts as token shards; returns the manifest.

    Manifest: shard long (in doc_id order), file, n_docs, n_ids, base (ids of all shards before).
    """
    spark = docs.sparkSession
    folder = fresh_dir(spark, "tokens")

    def shards(batches):
        enc = encoder(tokenizer)
        writer = ShardWriter(bits_for(max(enc.vocab_size, end_id + 1)))
        end = np.array([end_id], "<u4")

        def chunks():
            for batch in batches:
                for first in range(0, batch.num_rows, 256):
                    some = batch.slice(first, 256)
                    ids, at = enc.encode(some.column(1).to_pylist())
                    for i, d in enumerate(some.column(0).to_pylist()):
                        yield from writer.add(d, np.concatenate((ids[at[i] : at[i + 1]], end)))
            yield from writer.end()

        head = next((b for b in batches if b.num_rows), None)
        if head is not None:
            batches = chain((head,), batches)
            path = write_new(folder, ".tok", chunks())
            yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int64()), "file": [path], "n_docs": pa.array([len(writer.starts)], pa.int64()), "n_ids": pa.array([writer.total], pa.int64())})

    typed = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    ordered = typed.repartitionByRange(F.col("d").asc_nulls_first(), F.substring("t", 1, BEGINNING).asc_nulls_first()).sortWithinPartitions(F.col("d").asc_nulls_first(), "t")
    manifest = save(ordered.mapInArrow(shards, "shard long, file string, n_docs long, n_ids long"), "token-manifest")
    total, bases = 0, []
    for r in manifest.select("shard", "n_ids").orderBy("shard").collect():  # a row a shard
        bases.append((r.shard, total))
        total += r.n_ids
    return manifest.join(spark.createDataFrame(bases, "shard long, base long"), "shard")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document, from the files: start counts the ids of all documents before."""

    def rows(batches):
        forget()
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out: list[tuple] = []
                size = 0
                for d, start, ids in ShardReader(path).documents():
                    out.append((d, base + start, ids.tobytes()))
                    size += len(ids)
                    if size > 1 << 20:
                        yield _batch(out)
                        out, size = [], 0
                if out:
                    yield _batch(out)

    def _batch(out):
        d, start, ids = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])

    return _one_a_task(manifest).mapInArrow(rows, "doc_id long, start long, ids binary")


def _one_a_task(manifest: DataFrame) -> DataFrame:
    """Deals the shards' rows out, so that they are read in parallel."""
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("file", "base").repartition(n)


@batched
def op2_token_file(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)

    def digests(batches):
        forget()
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(d, base + start, len(ids), zlib.crc32(ids.tobytes())) for d, start, ids in ShardReader(path).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _one_a_task(manifest).mapInArrow(digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
