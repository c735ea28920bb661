"""Even packing of token sequences: Karmarkar-Karp differencing over many windows at once."""

from __future__ import annotations

import heapq
import struct
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isopleth.llm.bytetokens import ByteTokens
from isopleth.llm.common import Rows, text_or_empty, written
from isopleth.llm.tokens import by_size


def _merged(a: list, b: list, k: int) -> list:
    """Two partial partitions as one: the largest sums of one meet the smallest of the other.

    A partial partition lists the (sum, pieces) that aren't empty, the largest first; pieces are nested pairs.
    """
    zeros = k - len(b)  # of b: they meet the first of a
    both = [(a[i][0] + b[k - 1 - i][0], (a[i][1], b[k - 1 - i][1])) for i in range(zeros, len(a))]
    left = b[: k - max(zeros, len(a))]
    return sorted(a[: min(zeros, len(a))] + both + left, key=lambda x: x[0], reverse=True)


def differencing(sizes: list[int], windows: int) -> list[int]:
    """The window of each size, by multiway differencing: the two partial partitions with the widest spread merge."""
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    if windows == 1 or not sizes:
        return [0] * len(sizes)
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        one = heapq.heappop(heap)[2]
        both = _merged(one, heapq.heappop(heap)[2], windows)
        spread = both[0][0] - (both[-1][0] if len(both) == windows else 0)
        heapq.heappush(heap, (-spread, number, both))
        number += 1
    out = [0] * len(sizes)
    for window, (_, pieces) in enumerate(heap[0][2]):
        stack = [pieces]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            else:
                out[x] = window
    return out


def even_windows(sizes: list[int], capacity: int) -> list[int]:
    """The window of each size in as few near-equal windows as differencing fits into the capacity: their count rises
    while the fullest exceeds it."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found, sums = differencing(sizes, windows), [0] * windows
        for size, window in zip(sizes, found):
            sums[window] += size
        if max(sums) <= capacity:
            return found
        windows += 1


def _shift_cuts(spans: list[list[int]], window: list[int], windows: int, capacity: int) -> None:
    """Moves cuts inside documents, so that windows which hold neighbouring pieces of one even out their sums.

    spans has (document, start, end) of each piece. Windows are joined by the documents that are cut between them; along
    a forest of those, from its leaves, what a window has too much or too little moves over the cut to its parent.
    """
    sums, beside = [0] * windows, [[] for _ in range(windows)]
    for i, (doc, start, end) in enumerate(spans):
        sums[window[i]] += end - start
        if i + 1 < len(spans) and spans[i + 1][0] == doc and window[i + 1] != window[i]:
            beside[window[i]].append((window[i + 1], i))
            beside[window[i + 1]].append((window[i], i))
    parent, order = {}, []
    for root in range(windows):
        if root in parent:
            continue
        parent[root], level = None, [root]
        for node in level:
            for other, cut in beside[node]:
                if other not in parent:
                    parent[other] = (node, cut)
                    level.append(other)
        order += level
    for node in reversed(order):
        if parent[node] is None:
            continue
        above, cut = parent[node]
        left, right = spans[cut], spans[cut + 1]
        more = sums[node] - capacity
        by = -more if window[cut] == node else more  # the cut moves right by so much; both pieces keep a token
        by = max(left[1] + 1 - left[2], min(by, right[2] - right[1] - 1))
        left[2] += by
        right[1] += by
        moved = -by if window[cut] == node else by
        sums[node] -= moved
        sums[above] += moved


class EvenPacker:
    """Packs documents' tokens as they come, a group of windows at a time.

    A long document's own full windows are sequences as they are. The rests wait until they have `windows` times the
    capacity; the last of them is cut there. They are cut into pieces of at most `grain` tokens, dealt by
    differencing, and their cuts shift to even the windows out. What a window still has over its capacity is cut off
    and waits, so it opens a further window later.
    """

    def __init__(self, capacity: int, windows: int, grain: int):
        self.capacity, self.windows, self.grain = capacity, windows, grain
        self.waiting, self.tokens, self.number = [], 0, 0

    def add(self, key, total: int, start: int, ids: bytes):
        """Takes a document's ids from `start` on; gives rows of pieces in sequences that are done."""
        step = 4 * self.capacity
        full = len(ids) // step * step
        for at in range(0, full, step):
            yield self._row(key, total, start + at // 4, ids[at : at + step], self.number, 0)
            self.number += 1
        if full < len(ids):
            self.waiting.append((key, total, start + full // 4, ids[full:]))
            self.tokens += (len(ids) - full) // 4
        if self.tokens >= self.windows * self.capacity:
            yield from self._group(self.windows)

    def finish(self):
        """Rows of all that waits: full windows, then sequences of powers of two, which need no padding."""
        while self.tokens >= self.capacity:
            yield from self._group(min(self.windows, self.tokens // self.capacity))
        while self.tokens:
            size = 1 << self.tokens.bit_length() - 1
            offset = 0
            for key, total, start, ids in self._take(size):
                yield self._row(key, total, start, ids, self.number, offset)
                offset += len(ids) // 4
            self.number += 1

    def _take(self, tokens: int) -> list:
        """The first waiting rests with that many tokens together; the last is cut."""
        taken, left = [], 4 * tokens
        for i, (key, total, start, ids) in enumerate(self.waiting):
            taken.append((key, total, start, ids[:left]))
            if len(ids) >= left:
                rest = [(key, total, start + left // 4, ids[left:])] if len(ids) > left else []
                self.waiting = rest + self.waiting[i + 1 :]
                break
            left -= len(ids)
        self.tokens -= tokens
        return taken

    def _group(self, windows: int):
        rests = self._take(windows * self.capacity)
        spans = []
        for doc, (*_, ids) in enumerate(rests):
            size = len(ids) // 4
            parts = -(-size // self.grain)
            spans += [[doc, size * i // parts, size * (i + 1) // parts] for i in range(parts)]
        window = differencing([end - start for _, start, end in spans], windows)
        _shift_cuts(spans, window, windows, self.capacity)
        held, over = [[] for _ in range(windows)], []
        for (doc, start, end), w in zip(spans, window):
            if held[w] and held[w][-1][0] == doc and held[w][-1][2] == start:
                held[w][-1][2] = end
            else:
                held[w].append([doc, start, end])
        for pieces in held:
            offset = 0
            for doc, start, end in pieces:
                key, total, first, ids = rests[doc]
                fits = min(end, start + self.capacity - offset)
                if fits > start:
                    yield self._row(key, total, first + start, ids[4 * start : 4 * fits], self.number, offset)
                    offset += fits - start
                if fits < end:
                    start = max(start, fits)
                    over.append((key, total, first + start, ids[4 * start : 4 * end]))
            self.number += 1
        self.waiting += over
        self.tokens += sum(len(ids) // 4 for *_, ids in over)

    @staticmethod
    def _row(key, total, start, ids, number, offset):
        return key, start, len(ids) // 4, zlib.crc32(ids), total, number, offset, None


PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Sequences of the second pass have numbers from here on.
SECOND = 1 << 62


def pack_even(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, windows: int = 64, grain: int = 256, id_col: str = "doc_id", text_col: str = "text", second: int = 1 << 20) -> DataFrame:
    """Packs all documents into sequences of `capacity` tokens (a power of two); one row per piece.

    A document is the ids of its text (missing: none) and the end id; pieces may begin and end anywhere in it. Each
    input partition is packed as it streams by, `windows` sequences at a time (see EvenPacker): memory is one group
    and one batch. What a partition has left, under `windows` sequences' tokens, goes to a second pass with its ids,
    where tasks of about `second` tokens pack it in the same way; what is left there is less than one sequence, which is
    cut into sequences of powers of two. So no sequence needs padding, unless a window shares no cut with others.
    Rows with equal or missing identifiers are packed like any other; an empty table gives no rows; other columns are
    ignored. sequence_id is the partition's number times 2^32 plus the sequence's; in the second pass 2^62 more.
    """

    def streamed(packer, base, rests, last):
        rows = Rows(PIECES, 5000)

        def done(found):
            for key, start, length, crc, total, number, offset, ids in found:
                rows.add(key, start, length, crc, total, base + number, offset, ids)
                if rows.full():
                    yield rows.take()

        for rest in rests:
            yield from done(packer.add(*rest))
        if last:
            yield from done(packer.finish())
        for key, total, start, ids in packer.waiting if not last else ():
            rows.add(key, start, len(ids) // 4, None, total, None, None, ids)
        yield rows.take()

    def first_pass(batches):
        encoder, end = ByteTokens.load(tokenizer), struct.pack("<I", end_id)

        def rests():
            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()
                for some in by_size(texts):
                    for key, ids in zip(keys[some], encoder.encode_all(texts[some])):
                        yield key, len(ids) // 4 + 1, 0, ids + end

        yield from streamed(EvenPacker(capacity, windows, grain), TaskContext.get().partitionId() << 32, rests(), False)

    def second_pass(batches):
        rests = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "start", "ids"))))
        yield from streamed(EvenPacker(capacity, windows, grain), SECOND + (TaskContext.get().partitionId() << 32), rests, True)

    found = written(docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(first_pass, DDL), "pieces")
    left = found.where("sequence_id is null")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    again = left.repartition(max(1, tokens // second)).sortWithinPartitions("doc_id", "start", "ids").mapInArrow(second_pass, DDL)
    return found.where("sequence_id is not null").union(again).drop("ids")
