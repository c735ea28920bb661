"""Language-model scoring by online logistic context mixing.

A text is a sequence of tokens, and a token a sequence of binary decisions: words of a bounded vocabulary by a Huffman
code of their corpus counts; any other word by the code of an escape symbol and then its bytes by a Huffman code of
bytes, which is averaged with its share of the corpus among such words. Three predictors know each decision's odds from counts under hashed contexts: the place in the code alone; with
the word (or byte) before; with the two before. Their logits are added with weights that a gate picks by what is known
of the contexts, and an adaptive map from the mixed logit to observed frequencies refines the result.

Learning is online within a part: training documents are dealt by hash into parts of about PART tokens, in each part in
a fixed order, and each small batch of decisions is predicted with what the part learnt before it, then weights, map and
counts learn from it. Parts' counts are added and their weights averaged over all training documents in a fixed order,
so the result does not depend on how the input is partitioned. Word counts grow with the input without a bound; the
context tables have `slots` places each, which is what every task holds in memory, and share places beyond that.
Texts are worked on in runs of a bounded number of words; a longer text is several runs that carry on its contexts.
"""

import heapq
import math
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isopleth.llm.common import cut, shuffle_partitions, text_or_empty
from isopleth.llm.fingerprints import WordHashes, words_of
from isopleth.llm.tokens import by_size

#: Slots of the three predictors, gates, steps of the adaptive map, decisions learnt at once.
SLOTS = (1 << 20, 1 << 20, 1 << 20)
SHIFT = np.uint64(64 - 20)
GATES, STEPS, BATCH = 32, 33, 1 << 14
VOCABULARY, PART, RUN = 262_144, 1 << 22, 30_000
_M = np.uint64(0x9E3779B97F4A7C15)


def huffman(weights: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length per symbol; inner nodes and bits of all codes, one after another)."""
    n = len(weights)
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    up, bit, new = [0] * (2 * n - 1), [0] * (2 * n - 1), n
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        up[i] = up[j] = new
        bit[j] = 1
        heapq.heappush(heap, (a + b, new))
        new += 1
    up, bit, root = np.array(up, np.int32), np.array(bit, np.uint8), new - 1
    at, steps = np.arange(n, dtype=np.int32), []
    while (at != root).any():  # all codes at once, from their ends to the root
        open_ = np.flatnonzero(at != root)
        steps.append((open_, up[at[open_]] - n, bit[at[open_]]))
        at[open_] = up[at[open_]]
    lengths = np.zeros(n, np.int64)
    for open_, _, _ in steps:
        lengths[open_] += 1
    starts = np.cumsum(lengths) - lengths
    nodes, bits = np.zeros(int(lengths.sum()), np.int64), np.zeros(int(lengths.sum()), np.uint8)
    for back, (open_, node, value) in enumerate(steps, 1):
        place = starts[open_] + lengths[open_] - back
        nodes[place], bits[place] = node, value
    return starts, lengths, nodes, bits


class Code:
    """The binary decisions of tokens. Symbols: 0 the end of a text, 1 the escape, from 2 the vocabulary."""

    def __init__(self, words: list[str], counts: list[int], end: int, rest: int, byte_counts: list[int]):
        self.words, self.places = pa.array(words, pa.string()), None
        self.starts, self.lengths, nodes, self.bits = huffman([end + 1, rest + 1, *counts])
        self.nodes = nodes.astype(np.intp)
        self.hashes = np.concatenate([np.zeros(2, np.uint64), WordHashes(len(words) + 1).of(words)])
        self.byte_codes = huffman([c + 1 for c in byte_counts])
        self.inner = len(words) + 2  # byte nodes are numbered from here

    @property
    def index(self) -> dict[str, int]:
        """The symbols of words, built where texts are read and never sent."""
        if self.places is None:
            self.places = {w: i + 2 for i, w in enumerate(self.words.to_pylist())}
        return self.places

    def spelled(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(number of decisions per word; bits, slots of the decisions) of spelling words outside the vocabulary.

        The predictors' contexts are the two, three and four bytes before.
        """
        starts, lengths, nodes, bits = self.byte_codes
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(r) + 1 for r in raw], np.int64)
        symbols = np.full(int(sizes.sum()), 256, np.int64)
        inside = np.ones(len(symbols), bool)
        inside[np.cumsum(sizes) - 1] = False
        symbols[inside] = np.frombuffer(b"".join(raw), np.uint8)
        first = np.cumsum(sizes) - sizes
        place_in_word = np.arange(len(symbols)) - np.repeat(first, sizes)
        last = [np.concatenate([np.zeros(k, np.int64), symbols[:-k]]) for k in range(1, 5)] if len(symbols) > 4 else [np.zeros(len(symbols), np.int64)] * 4
        last = [np.where(place_in_word >= k, x, 300).astype(np.uint64) for k, x in enumerate(last, 1)]
        two = last[0] * np.uint64(512) + last[1] + np.uint64(1)
        three = two * np.uint64(512) + last[2]
        four = three * np.uint64(512) + last[3]
        place, owner = spread(starts[symbols], lengths[symbols])
        word = np.repeat(np.arange(len(words)), sizes)
        nodes = nodes[place] + self.inner
        turned = nodes.astype(np.uint64) * _M
        slots = [((c[owner] * _M + turned + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93) >> SHIFT).astype(np.int32) for k, c in enumerate((two, three, four))]
        slots[0] = slots[0] >> 1 | SLOTS[0] >> 1  # the lower half is for the nodes of the words' code
        return np.bincount(word[owner], minlength=len(words)), bits[place], slots


def spread(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of places: all places one after another, and the run that each belongs to."""
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.repeat((starts - ends + lengths).astype(np.intp), lengths)
    place += np.arange(len(owner))
    return place, owner


def decisions(code: Code, texts: list["Piece"], memo: WordHashes, homes: bool = True):
    """(slots of the three predictors, bits, text of each decision; escaped words; symbol and text of each token) of some runs of texts."""
    words = [w for t in texts for w in t.words]
    sizes = np.array([len(t.words) + t.ends for t in texts], np.int64)
    inside = np.ones(int(sizes.sum()), bool)
    inside[(np.cumsum(sizes) - 1)[[t.ends for t in texts]]] = False
    symbols = np.zeros(len(inside), np.int64)
    found = code.index.get
    symbols[inside] = [found(w, 1) for w in words]
    escaped = [words[i] for i in ((np.cumsum(inside) - 1)[symbols == 1]).tolist()]
    hashes = np.take(code.hashes, symbols)
    hashes[symbols == 1] = memo.of(escaped)
    before = np.concatenate([np.zeros(1, np.uint64), hashes[:-1]])[: len(hashes)]
    before2 = np.concatenate([np.zeros(1, np.uint64), before[:-1]])[: len(hashes)]
    first = np.cumsum(sizes) - sizes
    for at, size, text in zip(first.tolist(), sizes.tolist(), texts):
        # a text begins after nothing, a later run of it after the two words before
        last, last2 = np.concatenate([memo.of(text.before), np.zeros(2, np.uint64)])[:2]
        if size > 0:
            before[at], before2[at] = last, last2
        if size > 1:
            before2[at + 1] = last
    both = before * np.uint64(3) + before2 * _M
    place, owner = spread(code.starts[symbols], code.lengths[symbols])
    nodes = np.take(code.nodes, place)
    turned = nodes.astype(np.uint64) * _M
    slots = [nodes]
    for context, factor in ((before, 0xC2B2AE3D27D4EB4F), (both, 0xD6E8FEB86659FD93)):
        hashed = np.take(context, owner)
        hashed += turned
        hashed *= np.uint64(factor)
        hashed >>= SHIFT
        slots.append(hashed.view(np.intp))
    home = np.repeat(np.array([t.number for t in texts], np.intp), sizes)
    return slots, np.take(code.bits, place), np.take(home, owner) if homes else None, escaped, symbols, home


class Mixer:
    """Counts under contexts, gated weights and the adaptive map."""

    def __init__(self):
        self.counts = [np.zeros((n, 2), np.float32) for n in SLOTS]
        self.weights = np.tile(np.array([0.3, 0.4, 0.4, 0.0], np.float32), (GATES, 1))
        self.seen = np.zeros((GATES * STEPS, 2))
        self.total = 0
        self.batches, self.steep = [0, 0], np.zeros((2, 4, GATES))

    def prepare(self) -> "Mixer":
        """Ready to score: logits and how well known each slot is, and the map's refined probabilities."""
        self.logits = [np.log((c[:, 1] + 0.4) / (c[:, 0] + 0.4)).astype(np.float32) for c in self.counts]
        self.known = [self._known(c.sum(1)) for c in self.counts]
        centre = 1 / (1 + np.exp(-(np.arange(STEPS) - STEPS // 2) / 2))
        prior = np.tile(centre, GATES)
        self.refined = ((self.seen[:, 1] + 4 * prior) / (self.seen.sum(1) + 4)).astype(np.float32)
        self.counts = None
        return self

    @staticmethod
    def _known(n: np.ndarray) -> np.ndarray:
        return (n > 0).astype(np.int8) + (n > 4) + (n > 40)

    def _mix(self, logits, known1, known2, level: int):
        gate = (known2 * np.int8(4) + known1 + np.int8(16 * level)).astype(np.intp)  # as indexes are, once for all look-ups
        mixed = np.take(np.ascontiguousarray(self.weights[:, 3]), gate)
        for i, x in enumerate(logits):
            part = np.take(np.ascontiguousarray(self.weights[:, i]), gate)
            part *= x
            mixed += part
        np.clip(mixed, -12, 12, out=mixed)
        place = mixed * np.float32(2)
        np.rint(place, out=place)
        np.clip(place, -(STEPS // 2), STEPS // 2, out=place)
        step = gate * STEPS
        step += place.astype(np.intp)
        step += STEPS // 2
        return gate, mixed, step

    def learn(self, slots, bits, level: int) -> None:
        # both counts of a slot are fetched as one 64-bit number
        found = [np.take(c.view(np.uint64)[:, 0], s).view(np.float32).reshape(-1, 2) for c, s in zip(self.counts, slots)]
        zeros, ones = [f[:, 0] + np.float32(0) for f in found], [f[:, 1] + np.float32(0) for f in found]
        logits = [np.log((b + np.float32(0.4)) / (a + np.float32(0.4))) for a, b in zip(zeros, ones)]
        gate, mixed, step = self._mix(logits, self._known(zeros[1] + ones[1]), self._known(zeros[2] + ones[2]), level)
        p = 1 / (1 + np.exp(-mixed))
        error, curve = bits - p, p * (1 - p)
        for i, x in enumerate([*logits, np.float32(1)]):
            slope = np.bincount(gate, error * x, GATES)
            if self.batches[level] % 8 == 0:  # how steep the loss is only sets the step's size
                self.steep[level, i] = np.bincount(gate, curve * x * x, GATES)
            self.weights[:, i] += (0.3 * slope / (self.steep[level, i] + 20)).astype(np.float32)
        self.batches[level] += 1
        self.seen += np.bincount(2 * step + bits, minlength=2 * GATES * STEPS).reshape(-1, 2)
        for c, s in zip(self.counts, slots):
            np.add.at(c.reshape(-1), 2 * s + bits, np.float32(1))
        self.total += len(bits)

    def learn_all(self, slots, bits, level: int) -> None:
        for at in range(0, len(bits), BATCH):
            self.learn([s[at : at + BATCH] for s in slots], bits[at : at + BATCH], level)

    def log2(self, slots, bits, level: int) -> np.ndarray:
        """log2 of the probability of each decision."""
        out = np.empty(len(bits), np.float64)
        for at in range(0, len(bits), BATCH):
            some, these = [s[at : at + BATCH] for s in slots], bits[at : at + BATCH]
            logits = [np.take(x, s) for x, s in zip(self.logits, some)]
            _, mixed, step = self._mix(logits, np.take(self.known[1], some[1]), np.take(self.known[2], some[2]), level)
            np.negative(mixed, out=mixed)
            np.exp(mixed, out=mixed)
            mixed += np.float32(1)
            p = np.reciprocal(mixed, out=mixed)
            p += np.take(self.refined, step)
            p *= np.float32(0.5)
            np.log2(np.where(these, p, np.float32(1) - p), out=p)
            out[at : at + BATCH] = p
        return out


class Piece(NamedTuple):
    """A run of a text's words: the text's number, up to two words before it, the nearest first, whether the text ends with it."""

    number: int
    words: list[str]
    before: list[str]
    ends: bool


def runs(texts, most: int = RUN):
    """Runs of texts, given as lists of words, with about `most` words together; a longer text is cut."""
    some, size = [], 0
    for number, words in enumerate(texts):
        for at in range(0, max(len(words), 1), most):
            piece = Piece(number, words[at : at + most], words[max(0, at - 2) : at][::-1], at + most >= len(words))
            some.append(piece)
            size += len(piece.words) + piece.ends
            if size >= most:
                yield some
                some, size = [], 0
    if some:
        yield some


def in_training(column: str = "doc_id") -> Column:
    """Whether a document is learnt from: crc32 of its identifier as text, mod 7, is not 2; without an identifier it is held out."""
    return F.coalesce(F.crc32(F.col(column).cast("long").cast("string").cast("binary")) % 7 != 2, F.lit(False))


def _pieces(mixer: Mixer, tile: int = 1 << 16):
    """A mixer's parts as (name, number, packed array); counts in tiles."""
    for k, counts in enumerate(mixer.counts):
        for at in range(0, SLOTS[k], tile):
            yield f"c{k}", at // tile, counts[at : at + tile].astype("<f8")
    yield "weights", 0, np.append(mixer.weights.ravel() * float(mixer.total), mixer.total)
    yield "seen", 0, mixer.seen


PIECES = pa.schema([("name", pa.string()), ("tile", pa.int64()), ("salt", pa.int64()), ("part", pa.int64()), ("data", pa.binary())])
PIECES_DDL = "name string, tile long, salt long, part long, data binary"


def _add_up(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums packed arrays by key in the order of parts as they stream by, so a task holds one sum at a time."""

    def run(batches):
        name, total, first = None, None, 0
        pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        out = lambda: pa.RecordBatch.from_pydict({"name": [name[0]], "tile": [name[1]], "salt": [0 if len(name) < 3 else name[2]], "part": [first], "data": [pack.compress(total.tobytes())]}, schema=PIECES)
        for batch in batches:
            for *key, part, data in zip(*(batch.column(c).to_pylist() for c in (*keys, "part", "data"))):
                values = np.frombuffer(unpack.decompress(data), "<f8")
                if key != name:
                    if name is not None:
                        yield out()
                    name, total, first = key, values.copy(), part
                else:
                    total += values
        if name is not None:
            yield out()

    return rows.repartition(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, "part").mapInArrow(run, PIECES_DDL)


def learn(docs: DataFrame, code_of, tokens: int, salts: int = 8) -> Mixer:
    """Learns from all rows of docs (doc_id, text); what comes to the driver is one table of fixed size (about 18 MB unpacked)."""

    def run(batches):
        mixer, memo, code, part = Mixer(), WordHashes(), code_of.value, None

        def close():
            pack = zstandard.ZstdCompressor(level=1)
            for name, tile, values in _pieces(mixer):
                yield pa.RecordBatch.from_pydict({"name": [name], "tile": [tile], "salt": [part % salts], "part": [part], "data": [pack.compress(np.ascontiguousarray(values, "<f8").tobytes())]}, schema=PIECES)

        for batch in batches:
            parts, texts = batch.column("part").to_numpy(), batch.column("text")
            for at in np.flatnonzero(np.diff(parts, prepend=-1)).tolist():
                if mixer.total and parts[at] != part:
                    yield from close()
                    mixer = Mixer()
                part = int(parts[at])
                own = texts.slice(at, int(np.argmin(np.append(parts[at:], -1) == part))).to_pylist()
                for some in by_size(own, 4_000_000):
                    for pieces in runs([words_of(t) for t in own[some]]):
                        slots, bits, _, escaped, _, _ = decisions(code, pieces, memo, homes=False)
                        mixer.learn_all(slots, bits, 1)
                        # spelling is learnt from words, not from their repeats: it tells words that are new
                        _, bits, slots = code.spelled(list(dict.fromkeys(escaped)))
                        mixer.learn_all(slots, bits, 0)
        if mixer.total:
            yield from close()

    n = max(1, math.ceil(tokens / PART))
    name = F.xxhash64("doc_id", "text")
    dealt = docs.select("doc_id", "text", F.pmod(name, F.lit(n)).alias("part"), name.alias("name")).repartition(min(n, shuffle_partitions(docs.sparkSession)), "part")
    parts = dealt.sortWithinPartitions("part", "name", "doc_id").select("part", "text").mapInArrow(run, PIECES_DDL)
    rows = cut(_add_up(_add_up(parts, ["name", "tile", "salt"]), ["name", "tile"]))
    mixer, unpack = Mixer(), zstandard.ZstdDecompressor()
    for row in rows.toLocalIterator():
        values = np.frombuffer(unpack.decompress(row.data), "<f8")
        if row.name == "weights":
            mixer.total = int(values[-1])
            mixer.weights = (values[:-1] / max(1, mixer.total)).reshape(GATES, 4).astype(np.float32)
        elif row.name == "seen":
            mixer.seen = values.reshape(-1, 2).copy()
        else:
            values = values.reshape(-1, 2)
            mixer.counts[int(row.name[1])][row.tile << 16 : (row.tile << 16) + len(values)] = values
    return mixer


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows of docs; words are counted within runs of texts before they are shuffled."""

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for some in by_size(texts, 16_000_000):
                found = Counter()
                for text in texts[some]:
                    found.update(words_of(text))
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "c"])

    return docs.select(text_or_empty().alias("text")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _byte_counts(counts: DataFrame, common: int) -> list[int]:
    """How often each byte, and the end of a word (256), is spelled in words as rare as or rarer than `common`."""

    def run(batches):
        for batch in batches:
            total = np.zeros(257)
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[256] += c
                for b in word.encode("utf-8", "surrogatepass"):
                    total[b] += c
            yield pa.RecordBatch.from_pydict({"b": np.arange(257), "c": total.astype(np.int64)})

    found = dict(map(tuple, counts.where(F.col("c") <= common).select("word", "c").mapInArrow(run, "b long, c long").groupBy("b").agg(F.sum("c")).collect()))
    return [found.get(b, 0) for b in range(257)]


def score(docs: DataFrame, vocabulary: int = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits, bits_per_byte.

    The base is a unigram with one added to each count over the words of the training documents and one class of unseen
    words; score is the model's log10 probability of the text as a sequence of the same events, end included.
    bits (total, and per byte) is the length of the whole text's code, in which unseen words are spelled out. Counts cover all training documents. The `vocabulary` most frequent words of those seen twice (ties by the word) have their counts in every task; counts of all other
    words come by a join on the word, which no frequent word takes part in. A missing text is empty; a document without an
    identifier is held out; repeated rows are scored each; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    train = rows.where(in_training())
    counts = cut(token_counts(train))
    ends = train.count()
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, types = total + ends, types + (ends > 0)
    top = counts.where("c > 1").orderBy(F.desc("c"), "word").limit(vocabulary).toArrow()
    words, times = top["word"].combine_chunks(), top["c"].to_numpy()
    common = int(times[-1]) if len(times) == vocabulary else 1
    rest = total - ends - int(times.sum())
    once = counts.where("c = 1").count()
    new = (once + 1) / (rest + once + 2)  # how much of what is escaped was never seen before: as much as was seen once
    code = Code(words.to_pylist(), times.tolist(), ends, rest, _byte_counts(counts, common))
    code_of = spark.sparkContext.broadcast(code)
    mixer_of = spark.sparkContext.broadcast(learn(train, code_of, total).prepare())
    known_of = spark.sparkContext.broadcast(np.concatenate([[ends, 0], times]).astype(np.float64))
    base = math.log10(total + types + 1)
    schema = pa.schema([("uid", pa.int64()), ("word", pa.string()), ("tf", pa.int64()), ("spelled", pa.float64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("bytes", pa.int64())])

    def run(batches):
        code, mixer, found, memo = code_of.value, mixer_of.value, known_of.value, WordHashes()
        logs = np.log10(found + 1)
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for some in by_size(texts, 4_000_000):
                ids, raw = keys[some], texts[some]
                n = len(raw)
                values, sums, out = np.zeros(n), np.zeros(n), []
                n_known, n_tokens = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for pieces in runs([words_of(t) for t in raw]):
                    slots, bits, home, escaped, symbols, of = decisions(code, pieces, memo)
                    values += np.bincount(home, mixer.log2(slots, bits, 1), n) * math.log10(2)
                    distinct = list(dict.fromkeys(escaped))
                    lengths, bits, slots = code.spelled(distinct)
                    spelled = np.bincount(np.arange(len(distinct)).repeat(lengths), mixer.log2(slots, bits, 0), len(distinct)) * math.log10(2)
                    spelled = dict(zip(distinct, spelled.tolist()))
                    n_known += np.bincount(of[(np.take(found, symbols) > 0) & (symbols != 1)], minlength=n)
                    n_tokens += np.bincount(of, minlength=n)
                    sums += np.bincount(of, np.where(symbols != 1, np.take(logs, symbols), 0.0), n)
                    rare = Counter(zip(of[symbols == 1].tolist(), escaped))
                    out += [(uid + i, w, c, spelled[w], None, None, None, None, None, None, None) for (i, w), c in rare.items()]
                for i, (key, text) in enumerate(zip(ids, raw)):
                    held = key is None or zlib.crc32(str(key).encode()) % 7 == 2
                    out.append((uid + i, f" {uid + i}", 0, 0.0, key, held, int(n_tokens[i]), int(n_known[i]), float(sums[i]), float(values[i]), len(text.encode("utf-8", "surrogatepass"))))
                uid += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    scored = rows.mapInArrow(run, "uid long, word string, tf long, spelled double, doc_id long, held_out boolean, n_tokens long, known long, logs double, score double, bytes long")
    joined = scored.join(counts.where(F.col("c") <= common), "word", "left")
    tf, seen = F.col("tf"), F.coalesce(F.lit((1 - new) / max(1, rest)) * F.col("c"), F.lit(0.0))
    among_types = F.log10(F.when(F.col("c").isNull(), F.lit(new)).otherwise(seen))
    as_bytes = F.log10(F.lit(new) * F.pow(F.lit(10.0), "spelled") + seen)
    joined = joined.groupBy("uid").agg(
        *(F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens", "bytes")),
        (F.max("score") + F.sum(F.when(tf > 0, tf * among_types).otherwise(0.0))).alias("score"),
        (F.max("score") + F.sum(F.when(tf > 0, tf * as_bytes).otherwise(0.0))).alias("coded"),
        (F.max("known") + F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0))).alias("n_known"),
        (F.max("logs") + F.sum(F.when(F.col("c").isNotNull(), F.col("tf") * F.log10(F.col("c") + 1)).otherwise(0.0))).alias("logs"),
    )
    return joined.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(base)).alias("base_score"), "score",
        (-F.col("coded") * math.log2(10)).alias("bits"), (-F.col("coded") * math.log2(10) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )


def corpus_bits(scores: DataFrame, docs: DataFrame) -> DataFrame:
    """One row for each of held_out: n_docs, n_bytes, bits and bits_per_byte over the whole texts. scores as of score(docs)."""
    sizes = docs.select(in_training().alias("training"), F.octet_length(text_or_empty()).alias("bytes")).groupBy((~F.col("training")).alias("held_out")).agg(F.sum("bytes").alias("n_bytes"))
    bits = scores.groupBy("held_out").agg(F.count("*").alias("n_docs"), F.sum("bits").alias("bits"))
    return bits.join(sizes, "held_out").select("held_out", "n_docs", "n_bytes", "bits", (F.col("bits") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))
