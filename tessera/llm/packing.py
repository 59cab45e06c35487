"""Bounded-space packing of token ids into sequences of a fixed length.

Each partition keeps ``OPEN`` windows. A document gives full sequences first;
what remains goes into the open window that it fits best. If it fits none, and
all windows are open, the fullest is emitted: as it is if at most ``SLACK`` places
are free, else filled with the beginning of the document (documents may be cut).
At the end the open windows of up to ``MERGE`` partitions are packed together in
the same way, and what is then left is laid end to end and cut into full
sequences and, last, into lengths that are powers of two, which need no padding.

Memory: OPEN windows for a partition, MERGE times OPEN for a merging task. What the
first tasks make is written to the shared folder, from where finished pieces go to
the result as they are. Only leftovers are shuffled, with their ids: up to OPEN
windows of each partition, whatever its size.

A null text is empty and has the end id alone. Repeated rows are packed each for
itself. Other columns are ignored. An empty table gives no piece.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame

from tessera.llm.chunk_encoder import encoder, give_back, text_slices
from tessera.llm.common import written

LENGTH, OPEN, SLACK, MERGE = 4096, 16, 32, 64
#: Bytes of text that are encoded at once, and chunks that are kept; a pipeline's executors have little memory to spare.
SLICE, KEEP = 4_000_000, 100_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class Packer:
    """Pieces are (doc_id, start, ids, doc_tokens); emit gets a list of them for each sequence."""

    def __init__(self, emit, length: int = LENGTH, most: int = OPEN, slack: int = SLACK):
        self.emit, self.length, self.most, self.slack = emit, length, most, slack
        self.windows: list[list] = []  # [free, pieces]

    def add(self, doc_id, start: int, ids, doc_tokens: int) -> None:
        while (n := len(ids) // 4) >= self.length:
            self.emit([(doc_id, start, ids[: 4 * self.length], doc_tokens)])
            ids, start = ids[4 * self.length :], start + self.length
        while n:
            if fits := [w for w in self.windows if w[0] >= n]:
                self._put(min(fits, key=lambda w: w[0]), doc_id, start, ids, doc_tokens)
                return
            if len(self.windows) < self.most:
                self.windows.append([self.length, []])
                continue
            fullest = min(self.windows, key=lambda w: w[0])
            free = fullest[0]
            if free <= self.slack:
                self._close(fullest)
                continue
            self._put(fullest, doc_id, start, ids[: 4 * free], doc_tokens)
            ids, start, n = ids[4 * free :], start + free, n - free

    def _put(self, window: list, doc_id, start: int, ids, doc_tokens: int) -> None:
        window[1].append((doc_id, start, ids, doc_tokens))
        window[0] -= len(ids) // 4
        if not window[0]:
            self._close(window)

    def _close(self, window: list) -> None:
        self.windows = [w for w in self.windows if w is not window]
        self.emit(window[1])

    def finish(self) -> None:
        """Lays the open windows end to end; full sequences, then powers of two."""
        queue = [p for w in sorted(self.windows, key=lambda w: w[0]) for p in w[1]]
        self.windows, left, at = [], sum(len(p[2]) // 4 for p in queue), 0
        while left:
            size = self.length if left >= self.length else 1 << (left.bit_length() - 1)
            left, pieces = left - size, []
            while size:
                doc_id, start, ids, doc_tokens = queue[at]
                n = min(size, len(ids) // 4)
                pieces.append((doc_id, start, ids[: 4 * n], doc_tokens))
                size -= n
                if 4 * n == len(ids):
                    at += 1
                else:
                    queue[at] = (doc_id, start + n, ids[4 * n :], doc_tokens)
            self.emit(pieces)


def _rows(sequence: int, pieces: list, keep_ids: bool) -> list[tuple]:
    rows, at = [], 0
    for doc_id, start, ids, doc_tokens in pieces:
        n = len(ids) // 4
        rows.append((doc_id, start, n, zlib.crc32(ids), doc_tokens, sequence, at, bytes(ids) if keep_ids else None))
        at += n
    return rows


def _batch(rows: list[tuple], extra: tuple = ()):
    import pyarrow as pa

    names = [x.split()[0] for x in PIECES.split(", ")]
    types = [pa.int64()] * 7 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)] + [pa.array([x] * len(rows), pa.int64()) for x in extra], names + ["bucket"] * len(extra))


def pack(docs: DataFrame, tokenizer: str, end_id: int, kind: str = "word", with_ids: bool = False, slice_bytes: int = SLICE) -> DataFrame:
    """A row for each piece of the documents (doc_id, text), as PIECES; ids (little-endian, 32 bits) are null unless asked for.

    Larger slices have fewer distinct chunks to look up a text, and take a few times their size of a worker's memory.
    """

    def first(batches):
        from pyspark import TaskContext

        codec, part = encoder(tokenizer, kind, KEEP), TaskContext.get().partitionId()
        rows, count = [], 0

        def emit(pieces):
            nonlocal count
            rows.extend(_rows(part << 36 | count, pieces, with_ids))
            count += 1

        packer = Packer(emit)
        for batch in batches:
            for piece in text_slices(batch, slice_bytes):
                names = piece.column(0).to_pylist()
                for a, b, ids, ends in codec.encode(piece.column(1), end_id):
                    data, at = memoryview(ids.tobytes()), 0
                    for doc_id, end in zip(names[a:b], ends.tolist(), strict=True):
                        packer.add(doc_id, 0, data[4 * at : 4 * end], end - at)
                        at = end
                if rows:
                    yield _batch(rows, (-1,))
                    rows.clear()
        left = [r for i, w in enumerate(packer.windows) for r in _rows(part << 36 | count + i, w[1], True)]
        if left:
            yield _batch(left, (part // MERGE,))
        give_back()

    def second(batches):
        from pyspark import TaskContext

        part, count, rows = TaskContext.get().partitionId(), 0, []
        left = [r for batch in batches for r in batch.to_pylist()]

        def emit(pieces):
            nonlocal count
            rows.extend(_rows(1 << 62 | part << 36 | count, pieces, with_ids))
            count += 1

        packer = Packer(emit)
        for r in sorted(left, key=lambda r: (r["sequence_id"], r["offset"])):  # fetched in any order
            packer.add(r["doc_id"], r["start"], memoryview(r["ids"]), r["doc_tokens"])
        packer.finish()
        if rows:
            yield _batch(rows)

    placed, _ = written(docs.sparkSession, docs.select("doc_id", "text").mapInArrow(first, PIECES + ", bucket long"), "pieces")
    left = placed.filter("bucket >= 0").repartition("bucket").drop("bucket").mapInArrow(second, PIECES)
    return placed.filter("bucket < 0").drop("bucket").unionByName(left)
