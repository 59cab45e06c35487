"""Token ids of documents in blocks of patched frames of reference.

A block has up to ``BLOCK`` ids: its least id, a width in bits that the
``PERCENTILE`` of its differences from that id fits into, these differences
packed at that width, and a list of exceptions (place and whole difference) for
the rest. A segment is a run of whole documents with about ``SEGMENT`` ids:

    "TPF1", u32 ids, u32 blocks, u32 start of each block and the end of the last,
    blocks: u32 least, u8 width, u8 exceptions, packed differences
            (bit 0 of a byte first), u8 place of each exception, u32 each value

All numbers are little-endian. Segments are rows of a table (shard, segment,
start within the shard, document ids and lengths, data) that Spark's own writer
commits, so a lost executor leaves no torn file and any store will do. Shards
are ranges of doc_id in ascending order, each sorted.

A null text is empty and has the end id alone. Null ids come first; rows that
share an id stand together, in an order that their texts fix. Other columns are
ignored. A document is never split, as its text is one row, too.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.chunk_encoder import encoder, give_back, text_slices

BLOCK, PERCENTILE, SEGMENT = 128, 0.9, 1 << 16
MAGIC = b"TPF1"


def pack(ids: np.ndarray) -> bytes:
    """A segment of ids (unsigned 32-bit)."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not blocks:
        return MAGIC + struct.pack("<3I", 0, 0, 0)
    padded = np.full(blocks * BLOCK, ids[-1], dtype="<u4")
    padded[:n] = ids
    padded = padded.reshape(blocks, BLOCK)
    least = padded.min(axis=1)
    rest = padded - least[:, None]
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)  # bit lengths, exact below 2**53
    widths = np.partition(bits, int(PERCENTILE * (BLOCK - 1)), axis=1)[:, int(PERCENTILE * (BLOCK - 1))]
    odd = bits > widths[:, None]
    bodies: list = [b""] * blocks
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        low = np.where(odd[own], 0, rest[own])
        flat = np.unpackbits(np.ascontiguousarray(low).view(np.uint8).reshape(len(own), BLOCK, 4), axis=2, bitorder="little")[:, :, :width]
        packed = np.packbits(flat.reshape(len(own), -1), axis=1, bitorder="little")
        for i, body in zip(own, packed, strict=True):
            bodies[i] = body.tobytes()
    rows, places = np.nonzero(odd)
    values, places = rest[rows, places].astype("<u4").tobytes(), places.astype(np.uint8).tobytes()
    counts = np.bincount(rows, minlength=blocks)
    heads = np.rec.fromarrays([least, widths, counts], dtype=[("least", "<u4"), ("width", "u1"), ("odd", "u1")]).tobytes()
    ends = np.cumsum(counts).tolist()
    parts = [heads[6 * i : 6 * i + 6] + bodies[i] + places[a:b] + values[4 * a : 4 * b] for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False))]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return MAGIC + struct.pack("<2I", n, blocks) + starts.astype("<u4").tobytes() + b"".join(parts)


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a segment, or of its blocks from first to last (exclusive) alone."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    n, blocks = struct.unpack_from("<2I", data, 4)
    last = blocks if last is None else min(last, blocks)
    if first >= last:
        return np.empty(0, dtype="<u4")
    starts = np.frombuffer(data, "<u4", blocks + 1, 12).astype(np.int64) + 12 + 4 * (blocks + 1)
    raw = np.frombuffer(data, np.uint8)
    at = starts[first:last]
    least = raw[at[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    widths, odd = raw[at + 4].astype(np.int64), raw[at + 5].astype(np.int64)
    out = np.zeros((last - first, BLOCK), dtype="<u4")
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        if width:
            packed = raw[at[own][:, None] + 6 + np.arange(BLOCK * width // 8)]
            flat = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(own), BLOCK, width)
            whole = np.zeros((len(own), BLOCK, 32), dtype=np.uint8)
            whole[:, :, :width] = flat
            out[own] = np.packbits(whole, axis=2, bitorder="little").view("<u4")[:, :, 0]
    own = np.repeat(np.arange(last - first), odd)
    within = np.arange(len(own)) - np.repeat(np.cumsum(odd) - odd, odd)
    base = (at + 6 + BLOCK * widths // 8)[own]
    values = raw[(base + odd[own] + 4 * within)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    out[own, raw[base + within]] = values
    return (out + least[:, None]).reshape(-1)[: n - first * BLOCK]


SEGMENTS = "shard long, segment long, start long, doc_ids array<bigint>, doc_tokens array<bigint>, data binary"


def encode(docs: DataFrame, tokenizer: str, end_id: int, kind: str = "byte_level") -> DataFrame:
    """Segments of the documents (doc_id, text), in order of doc_id over shards and segments."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        codec, shard = encoder(tokenizer, kind), TaskContext.get().partitionId()
        doc_ids, counts, parts, start, segment = [], [], [], 0, 0

        def flush():
            nonlocal doc_ids, counts, parts, start, segment
            ids = np.concatenate(parts)
            row = [[shard], [segment], [start], [doc_ids], [counts], [pack(ids)]]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            doc_ids, counts, parts, start, segment = [], [], [], start + len(ids), segment + 1
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], ["shard", "segment", "start", "doc_ids", "doc_tokens", "data"])

        for batch in batches:
            for piece in text_slices(batch):
                names = piece.column(0).to_pylist()
                for first, _, ids, ends in codec.encode(piece.column(1), end_id):
                    sizes, at = np.diff(ends, prepend=0), 0
                    while at < len(ends):  # documents up to the one that fills a segment
                        begin, held = (ends[at - 1] if at else 0), sum(counts)
                        end = min(len(ends), int(np.searchsorted(ends, begin + SEGMENT - held)) + 1)
                        doc_ids += names[first + at : first + end]
                        counts += sizes[at:end].tolist()
                        parts.append(ids[begin : ends[end - 1]])
                        if held + ends[end - 1] - begin >= SEGMENT:
                            yield flush()
                        at = end
        if doc_ids:
            yield flush()
        give_back()

    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    return ordered.select("doc_id", "text").mapInArrow(run, SEGMENTS)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, kind: str = "byte_level") -> None:
    encode(docs, tokenizer, end_id, kind).write.option("compression", "none").parquet(path)


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document in files of write(); start counts all ids before it."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    # One row for each shard: as many as write() had tasks.
    sizes = segments.select("shard", F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before = sizes.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start, doc_ids, counts, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids, at = memoryview(unpack(data).tobytes()), 0
                rows: list = [[], [], [], [], []]
                for doc_id, n in zip(doc_ids, counts, strict=True):
                    own = ids[4 * at : 4 * (at + n)]
                    for column, x in zip(rows, (doc_id, start + at, n, zlib.crc32(own), bytes(own) if with_ids else None), strict=True):
                        column.append(x)
                    at += n
                kept = rows[: 4 + with_ids]
                types = [pa.int64()] * 4 + [pa.binary()] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(kept, types, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(kept)])
        give_back()

    return (
        segments.join(F.broadcast(before), "shard")
        .select((F.col("start") + F.col("before")).alias("start"), "doc_ids", "doc_tokens", "data")
        .mapInArrow(run, schema)
    )
