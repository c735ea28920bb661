"""Best-fit packing of token sequences: bounded space, online."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isopleth.llm.common import Rows, cut, text_or_empty
from isopleth.llm.tokens import WordTokens, by_size


class BestFit:
    """Bounded-space best fit: each piece goes to the fullest open bin that has room.

    A bitset has bit f set while a bin with f free tokens is open, so the best bin for n tokens is the lowest set
    bit from n up. Beyond `open_bins` open bins the fullest closes first; a full bin closes at once.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.free, self.bins, self.count, self.opened, self.done = 0, {}, 0, 0, []

    def _take(self, free: int) -> int:
        stack = self.bins[free]
        number = stack.pop()
        if not stack:
            del self.bins[free]
            self.free &= ~(1 << free)
        self.count -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of 1 to capacity tokens."""
        fitting = self.free >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.opened
            self.opened += 1
        offset, left = self.capacity - free, free - length
        if left:
            self.bins.setdefault(left, []).append(number)
            self.free |= 1 << left
            self.count += 1
            if self.count > self.most:
                self.done.append(self._take((self.free & -self.free).bit_length() - 1))
        else:
            self.done.append(number)
        return number, offset

    def closed(self) -> list[int]:
        """The bins that closed since the last call."""
        done, self.done = self.done, []
        return done


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Sequences of the second pass have numbers from here on.
SECOND = 1 << 62


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, open_bins: int = 1024, id_col: str = "doc_id", text_col: str = "text", second: int = 500_000) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens; one row per piece.

    A document is the ids of its text (missing: none) and the end id. Only longer documents are cut, into pieces
    of `capacity` tokens and a rest. Each input partition is packed on its own as it streams by: memory is the open
    bins with their pieces and one batch. A partition's bins that are still open at its end, at most `open_bins`, are
    given up, and a second pass packs their pieces, from all partitions and the longest first, in groups of up to
    `second` pieces. So only a group's last bins, at most `open_bins` in each, stay partly empty. Rows with equal or
    missing identifiers are packed like any other; an empty table gives no rows; other columns are ignored.
    sequence_id is the partition's number times 2^32 plus the bin's; in the second pass 2^62 more.
    """

    def first_pass(batches):
        encoder, end = WordTokens.load(tokenizer), struct.pack("<I", end_id)
        fit, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 32
        rows, step, held = Rows(PIECES, 5000), 4 * capacity, {}
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for some in by_size(texts):
                for key, ids in zip(keys[some], encoder.encode_all(texts[some])):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        number, offset = fit.place(len(part) // 4)
                        held.setdefault(number, []).append((key, piece, at // 4, len(part) // 4, zlib.crc32(part), base + number, offset))
                        for closed in fit.closed():
                            for row in held.pop(closed):
                                rows.add(*row)
                if rows.full():
                    yield rows.take()
        for left in held.values():
            for row in left:
                rows.add(*row[:5], None, None)
        yield rows.take()

    def second_pass(batches):
        fit, base, rows = BestFit(capacity, open_bins), SECOND + (TaskContext.get().partitionId() << 32), Rows(PIECES, 5000)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in PIECES.names[:5])):
                number, offset = fit.place(row[3])
                rows.add(*row, base + number, offset)
                if rows.full():
                    yield rows.take()
        yield rows.take()

    found = cut(docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(first_pass, DDL))
    left = found.where("sequence_id is null")
    groups = max(1, -(-left.count() // second))
    again = left.repartition(groups).sortWithinPartitions(F.desc("length"), "doc_id", "piece", "start").mapInArrow(second_pass, DDL)
    return found.where("sequence_id is not null").union(again)
