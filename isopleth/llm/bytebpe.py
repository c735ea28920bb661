"""Byte-level BPE: encoding by a fold of ranked merges in Spark's higher-order functions, decoding by joined pieces.

Texts are cut into words, and each different word of all texts is folded once: higher-order functions merge its bytes'
pieces, with the ranks as a literal map. Words and their ids travel in packed rows, a row per part of the documents and
bucket of words, so Spark moves few rows. Within a bucket the steps before and after the fold run in one task, one after
the other on the same rows; a row says how many words were known before it, and a mismatch ends the task.
"""

import base64
import hashlib
import json
import zlib

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isopleth.llm.common import Rows, filesystem, new_folder, shuffle_partitions, text_or_empty

#: Places of the literal rank map, each a small map of the pairs whose hash falls in it.
BUCKETS = 16384
#: Bytes from which a word is folded by its different pairs, not by their places.
LONG = 200
#: Stands for a pair that makes no piece; sorts after all pieces.
NONE = "\U0010ffff"


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank of each piece of a rank file: lines of a base64 piece and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def marks_of(ranks: dict[bytes, int]) -> dict[bytes, str]:
    """Each piece as one character; characters order as ranks do (surrogates are left out).

    An odd code point tells that all pieces made of this one rank above it, so that merging to it brings no lower rank.
    """
    unsafe = set()
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
            if a is not None and b is not None:
                unsafe.update(x for x in (a, b) if x > rank)
    codes = {piece: 2 * rank + 2 + (rank not in unsafe) for piece, rank in ranks.items()}
    return {piece: chr(code if code < 0xD800 else code + 0x800) for piece, code in codes.items()}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal: the piece that each pair of pieces makes, in an array of small maps, as Spark searches a map from its start."""
    buckets: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    marks = marks_of(ranks)
    for piece, made in marks.items():
        for k in range(1, len(piece)):
            a, b = marks.get(piece[:k]), marks.get(piece[k:])
            if a and b:
                buckets[xxhash.xxh64_intdigest((a + b).encode(), 42) % BUCKETS][a + b] = made
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>")


def let(value: Column, body) -> Column:
    """body of a value that is computed once: the variable of a transform of one element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_merges(word: Column, ranks: Column) -> Column:
    """The pieces of a word, given as its bytes' pieces: the adjacent pair of lowest rank, leftmost first, is merged until none has a rank.

    The state is two strings: the pieces, and for each adjacent pair the piece that it makes. After a merge only the
    two pairs beside it are looked up again. Where the same pair comes again and no lower rank can arise, all its
    places are merged in one step, as one place at a time would do.
    """

    def part(text: Column, start, length=None) -> Column:
        return F.substring(text, F.lit(start) if isinstance(start, int) else start, F.length(text) if length is None else F.lit(length) if isinstance(length, int) else length)

    def made(pieces: Column, i: Column) -> Column:
        pair = part(pieces, i, 2)
        return F.coalesce(F.element_at(ranks, F.xxhash64(pair).bitwiseAND(F.lit(BUCKETS - 1)).cast("int") + 1)[pair], F.lit(NONE))

    def all_made(pieces: Column) -> Column:
        return F.when(F.length(pieces) < 2, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(pieces) - 1), lambda i: made(pieces, i)), ""))

    def state(pieces: Column, pairs: Column) -> Column:
        return F.struct(pieces.alias("pieces"), pairs.alias("pairs"))

    def step(acc: Column, _: Column) -> Column:
        pieces, pairs = acc["pieces"], acc["pairs"]

        def merge(best: Column, at: Column) -> Column:
            before, pair, rest = part(pieces, 1, at - 1), part(pieces, at, 2), part(pieces, at + 2)
            others = F.exists(F.sequence(F.lit(1), F.length(pairs)), lambda i: (part(pairs, i, 1) == best) & (part(pieces, i, 2) != pair))
            every = F.contains(rest, pair) & (F.ascii(best) % 2 == 1) & ~others
            left = lambda after: F.when(at > 1, made(after, at - 1)).otherwise("")
            right = lambda after: F.when(at < F.length(after), made(after, at)).otherwise("")
            one = let(F.concat(before, best, rest), lambda after: state(after, F.concat(part(pairs, 1, at - 2), left(after), right(after), part(pairs, at + 2))))
            return F.when(every, let(F.concat(before, F.replace(part(pieces, at), pair, best)), lambda after: state(after, all_made(after)))).otherwise(one)

        # where no pair has a rank the pairs are emptied, which ends the fold
        lowest = let(F.array_min(F.split(pairs, "")), lambda best: F.when(best == NONE, state(pieces, F.lit(""))).otherwise(let(F.call_function("instr", pairs, best), lambda at: merge(best, at))))
        return F.when(pairs == "", acc).otherwise(lowest)

    return F.when(F.length(word) < 2, word).otherwise(F.aggregate(F.sequence(F.lit(1), F.length(word)), state(word, all_made(word)), step, lambda acc: acc["pieces"]))


def fold_long(word: Column, ranks: Column) -> Column:
    """The same pieces of a long word, without a look at all its places in each step.

    The state is the pieces and the different pairs that may be there, each as the piece it makes and the pair, so the
    least of them comes next. One that isn't there any more goes. Otherwise it is replaced, everywhere where no lower rank
    can arise, else in its first place, and the pairs beside the places of the new piece join the others. A step is a few
    searches by Spark's own string functions; what is looked up one by one are as many pairs as there are merges.
    Where two pairs make the least piece, the first of both places is merged alone.
    """

    def made(pair: Column) -> Column:
        return F.element_at(ranks, F.xxhash64(pair).bitwiseAND(F.lit(BUCKETS - 1)).cast("int") + 1)[pair]

    def known(pairs: Column) -> Column:
        return F.filter(F.transform(F.array_distinct(pairs), lambda pair: F.concat(made(pair), pair)), lambda x: x.isNotNull())

    def beside(pieces: Column, best: Column) -> Column:
        """The pairs at the places of a piece."""

        def ends(between: Column) -> Column:
            left = F.transform(F.slice(between, F.lit(1), F.size(between) - 1), lambda x: F.when(x != "", F.concat(F.right(x, F.lit(1)), best)).otherwise(F.concat(best, best)))
            right = F.transform(F.slice(between, F.lit(2), F.size(between) - 1), lambda x: F.when(x != "", F.concat(best, F.left(x, F.lit(1)))).otherwise(F.concat(best, best)))
            return F.array_distinct(F.concat(left, right))

        return known(let(F.split(pieces, F.concat(F.lit("\\Q"), best, F.lit("\\E")), -1), ends))

    def state(pieces: Column, pairs: Column) -> Column:
        return F.struct(pieces.alias("pieces"), pairs.alias("pairs"))

    def step(acc: Column, _: Column) -> Column:
        pieces, pairs = acc["pieces"], acc["pairs"]

        def merge(least: Column) -> Column:
            best, pair = F.substring(least, 1, 1), F.substring(least, 2, 2)
            rest = F.array_remove(pairs, least)
            # in their order, what makes the same piece comes next
            same = F.filter(rest, lambda x: F.startswith(x, best) & F.contains(pieces, F.substring(x, 2, 2)))
            rivals = F.when(F.startswith(F.array_min(rest), best), same).otherwise(F.array().cast("array<string>"))

            def one() -> Column:
                place = lambda x: F.struct(F.call_function("instr", pieces, F.substring(x, 2, 2)).alias("at"), x.alias("x"))
                first = F.array_min(F.transform(F.concat(F.array(least), rivals), place))
                after = let(first, lambda f: F.concat(F.substring(pieces, F.lit(1), f["at"] - 1), best, F.substring(pieces, f["at"] + 2, F.length(pieces))))
                return let(after, lambda a: state(a, F.array_union(pairs, beside(a, best))))

            every = let(F.replace(pieces, pair, best), lambda a: state(a, F.array_union(rest, beside(a, best))))
            chosen = F.when((F.ascii(best) % 2 == 1) & (F.size(rivals) == 0), every).otherwise(one())
            return F.when(F.contains(pieces, pair), chosen).otherwise(state(pieces, rest))

        return F.when(F.size(pairs) == 0, acc).otherwise(let(F.array_min(pairs), merge))

    singles = F.split(word, "")
    first = known(F.zip_with(F.slice(singles, F.lit(1), F.length(word) - 1), F.slice(singles, F.lit(2), F.length(word) - 1), lambda a, b: F.concat(a, b)))
    # a step merges or drops a pair; each merge brings two pairs at most
    return F.aggregate(F.sequence(F.lit(1), 4 * F.length(word)), state(word, first), step, lambda acc: acc["pieces"])


class Numbers(dict):
    """The numbers of words, in the order in which they first came."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


_CUT = pa.schema([("part", pa.int64()), ("bucket", pa.int32()), ("id", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("words", pa.binary()), ("lengths", pa.binary()), ("numbers", pa.binary())])
_CUT_DDL = "part long, bucket int, id long, low binary, high binary, words binary, lengths binary, numbers binary"
_NEW = pa.schema([("part", pa.int64()), ("bucket", pa.int32()), ("numbers", pa.binary()), ("places", pa.binary()), ("at", pa.int64()), ("new", pa.list_(pa.string()))])
_IDS = pa.schema([("part", pa.int64()), ("numbers", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary())])


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest takes, after a byte that says how many."""
    kind = "<u1" if (most := values.max(initial=0)) < 1 << 8 else "<u2" if most < 1 << 16 else "<u4"
    return bytes([int(kind[-1])]) + values.astype(kind).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _split(raw: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def cut_words(docs: DataFrame, pattern: str, buckets: int, part_docs: int, part_chars: int, part_words: int) -> DataFrame:
    """Texts (id, text) as numbers of words, per part of the documents, and each part's different words by bucket.

    A part is a run of a partition's documents. Words are numbered as they come, so frequent ones have small numbers; a
    document's numbers are kept as their lower sixteen bits and the rest, a bucket's words with the steps between their
    numbers. A part always has a row of words.
    """
    words = regex.compile(pattern).findall

    def close(part: int, known: Numbers):
        strings = list(map(str.encode, known))
        number = np.fromiter(map(zlib.crc32, strings), np.int64, len(strings)) % buckets
        order = np.argsort(number, kind="stable")
        bounds = np.searchsorted(number[order], np.arange(buckets + 1))
        for bucket in range(buckets):
            own = order[bounds[bucket] : bounds[bucket + 1]]
            if len(own) or bucket == part % buckets:
                some = [strings[i] for i in own.tolist()]
                yield part, bucket, None, None, None, b"".join(some), _pack(np.fromiter(map(len, some), np.int64, len(some))), _pack(np.diff(own, prepend=0))

    def run(batches):
        part, known, n_docs, size, rows = TaskContext.get().partitionId() << 32, Numbers(), 0, 0, Rows(_CUT, 1000)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, key in enumerate(keys):
                text = texts[i].as_py()
                order = np.fromiter(map(known.__getitem__, words(text)), np.int64)
                rows.add(part, None, key, (order & 0xFFFF).astype("<u2").tobytes(), (order >> 16).astype("<u2").tobytes(), None, None, None)
                n_docs, size = n_docs + 1, size + len(text)
                if n_docs >= part_docs or size >= part_chars or len(known) >= part_words:
                    for row in close(part, known):
                        rows.add(*row)
                    part, known, n_docs, size = part + 1, Numbers(), 0, 0
                if rows.full():
                    yield rows.take()
        if n_docs:
            for row in close(part, known):
                rows.add(*row)
        yield rows.take()

    return docs.mapInArrow(run, _CUT_DDL)


def encode(docs: DataFrame, ranks_path: str, pattern: str, finish, ddl: str, schema: pa.Schema, part_docs: int = 16_384, part_chars: int = 16_000_000, part_words: int = 1_000_000) -> DataFrame:
    """One row per document: finish(id, number of ids, ids as decimal numbers joined by commas, decoded bytes) of whole texts.

    Texts are cut into parts of numbered words, which are written; each different word of all parts comes to one bucket,
    is folded there once, and its ids go back to the parts that have it, where each document's words are joined. Memory is a part's or a bucket's
    different words. There are as many buckets as shuffle partitions.
    """
    spark, marks = docs.sparkSession, marks_of(read_ranks(ranks_path))
    buckets = shuffle_partitions(spark)
    singles = {b: marks[bytes([b])] for b in range(256)}
    kind = "<u2" if max(read_ranks(ranks_path).values()) < 1 << 16 else "<u4"
    path = new_folder(spark, "words")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text"))
    cut_words(texts, pattern, buckets, part_docs, part_chars, part_words).write.option("compression", "zstd").partitionBy("part").parquet(path)

    def gather(batches):
        """Of each part's words those that the bucket has not met before, and the place of each among the bucket's."""
        known, current = Numbers(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["bucket"] != current:
                    known, current = Numbers(), row["bucket"]
                words, at = _split(row["words"], _unpack(row["lengths"])), len(known)
                # a word that is a piece is that piece; a part has no word twice
                new = [marks.get(w) or w.decode("latin-1").translate(singles) for w in words if w not in known]
                places = np.fromiter(map(known.__getitem__, words), "<u4", len(words))
                out.append((row["part"], row["bucket"], row["numbers"], places.tobytes(), at, new))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _NEW)] if out else [pa.array([], f.type) for f in _NEW], schema=_NEW)

    def give_back(batches):
        """The ids of each part's words; rows come in the order in which gather met them."""
        ranks = read_ranks(ranks_path)
        rank_of, current, ids = {m: ranks[piece] for piece, m in marks_of(ranks).items()}, None, []
        for batch in batches:
            rows = Rows(_IDS, 1 << 30)
            for row in batch.to_pylist():
                if row["bucket"] != current:
                    ids, current = [], row["bucket"]
                if row["at"] != len(ids):
                    raise ValueError("rows did not come in the order in which their words were met")
                ids += [np.fromiter(map(rank_of.__getitem__, w), kind, len(w)).tobytes() for w in row["new"]]
                own = [ids[i] for i in np.frombuffer(row["places"], "<u4").tolist()]
                rows.add(row["part"], row["numbers"], _pack(np.fromiter(map(len, own), np.int64, len(own))), b"".join(own))
            yield rows.take()

    def assemble(batches):
        piece_of = {rank: piece for piece, rank in read_ranks(ranks_path).items()}
        name_of, rows, part, held = {rank: str(rank) for rank in piece_of}, Rows(schema, 500), None, []

        def close():
            numbers = np.concatenate([np.cumsum(_unpack(r["numbers"])) for r in held]).tolist()
            lengths = np.concatenate([_unpack(r["lengths"]) for r in held]) // np.dtype(kind).itemsize
            flat, ends = np.frombuffer(b"".join(r["ids"] for r in held), kind).tolist(), np.cumsum(lengths).tolist()
            counts, names, pieces = np.zeros(len(numbers), np.int64), [""] * len(numbers), [b""] * len(numbers)
            counts[numbers] = lengths
            for number, a, b in zip(numbers, [0, *ends], ends):
                own = flat[a:b]
                names[number] = name_of[own[0]] if b - a == 1 else ",".join([name_of[i] for i in own])
                pieces[number] = piece_of[own[0]] if b - a == 1 else b"".join([piece_of[i] for i in own])
            for doc in _documents(path, part):
                order = np.frombuffer(doc["low"], "<u2").astype(np.int64) | np.frombuffer(doc["high"], "<u2").astype(np.int64) << 16
                own = order.tolist()
                rows.add(*finish(doc["id"], int(counts[order].sum()), ",".join(map(names.__getitem__, own)), b"".join(map(pieces.__getitem__, own))))
                if rows.full():
                    yield rows.take()

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if held:
                        yield from close()
                    part, held = row["part"], []
                held.append(row)
        if held:
            yield from close()
        yield rows.take()

    literal = rank_literal(read_ranks(ranks_path))  # bound to a variable, so the plan has it once
    words = spark.read.schema(_CUT_DDL).parquet(path).where("bucket is not null").select("part", "bucket", "words", "lengths", "numbers")
    met = words.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "part").mapInArrow(gather, "part long, bucket int, numbers binary, places binary, at long, new array<string>")
    folded = met.select("part", "bucket", "numbers", "places", "at", let(literal, lambda ranks: F.transform("new", lambda w: F.when(F.length(w) < LONG, fold_merges(w, ranks)).otherwise(fold_long(w, ranks)))).alias("new"))
    back = folded.mapInArrow(give_back, "part long, numbers binary, lengths binary, ids binary")
    return back.repartitionById(buckets, F.expr(f"cast(pmod(shiftright(part, 32), {buckets}) as int)")).sortWithinPartitions("part").mapInArrow(assemble, ddl)


def _documents(path: str, part: int):
    """The documents of a part, as cut_words wrote them."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, plain = filesystem(path)
    for info in system.get_file_info(fs.FileSelector(f"{plain}/part={part}")):
        if info.path.endswith(".parquet"):
            for batch in pq.ParquetFile(info.path, filesystem=system).iter_batches(500, columns=["bucket", "id", "low", "high"]):
                yield from (row for row in batch.to_pylist() if row["bucket"] is None)


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digest_bpe(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encodes all texts, decodes the ids by joining their binary pieces, and digests both.

    A missing text counts as empty; repeated rows, repeated and missing identifiers are encoded like any other; an
    empty table gives no rows; other columns are ignored.
    """

    def finish(key, total, ids, decoded):
        return key, total, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return encode(docs, ranks_path, pattern, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", DIGEST)
