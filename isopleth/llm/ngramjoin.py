"""N-gram Jaccard join: components of documents whose sets of 3-word shingles are at least 90 % alike.

First a count puts aside what can be linked with nothing: of linked sets each has at least 90 % of its shingles in
common with another document, so a document with fewer shingles that occur elsewhere is done. Occurrences are found by
40 bits of the shingles' hashes, which takes some for shared that are not, never the reverse. Most documents are put
aside by a quarter of the range of hashes alone (a half at 80 %): a document with more shingles there that occur nowhere else than a tenth of
its whole set is done too. Linked documents stay together, so the whole range is counted among those that are left.

Candidates among the others come without loss from a pigeonhole argument. Sizes fall into bands so narrow that linked sets are in the
same or in neighbouring bands. At a level (two neighbouring bands) linked sets differ in at most d elements; the hash
range is cut into d + 2 parts, so at least two parts hold the same elements in both sets, and the hash of a part's elements is
a key that both share. (A set in which two or more parts are empty gives keys for its empty parts too; otherwise a
common part that isn't empty exists.) Sets that share a key are joined to the least identifier of that key, first within
a batch and then over all, so a key that very many sets share gives each of them one row.

The keys are a filter ahead of the tiles: they decide which documents meet, the tiles compare them. Where common
shingles chain many sets into a group of more than a tile, it is split: with the shingles of a group ordered from rare
to frequent, linked sets share one of the first of each (of size s, the first s - ceil(0.9 s) + 1), so what those connect
are the new groups. Groups are verified in tiles. A group too large for one tile is cut into size bands, and bands into blocks;
each pair of blocks of the same or neighbouring bands is a tile. In a tile, hashed bitmaps bound the overlap of a pair from above by
bit counts; pairs that could reach the threshold are compared exactly by intersecting sorted arrays, but for pairs
already connected in the tile.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isopleth.llm.common import cut, fresh_name, shuffle_partitions, text_or_empty
from isopleth.llm.components import components
from isopleth.llm.fingerprints import WordHashes, mix, shingles, words_of
from isopleth.llm.tokens import by_size

PROFILE, SHARED, EXACT, CANDIDATE = 0, 1, 2, 3
#: Bits of a shingle's hash that are left out where occurrences are counted; counts gathered in a task before they are handed on.
LEFT_OUT, TOGETHER = 24, 2_000_000
#: Shingles in a tile's half at most, and rows that may be broadcast; beyond it a shuffled join is taken.
TILE, BROADCAST_ROWS = 1_500_000, 500_000


def shingle_set(text: str, memo: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of a shorter text the whole sequence; none without words."""
    return np.unique(shingles(memo.of(words_of(text)), n))


class Bands:
    """Size bands for a threshold of percent / 100, a little wider than the threshold so that rounding loses nothing."""

    def __init__(self, percent: int):
        self.percent, self.width = percent, -np.log(percent / 100 - 0.001)

    def band(self, size: int) -> int:
        return int(np.log(size) / self.width)

    def parts(self, level: int) -> int:
        """Two more than the most elements in which linked sets of bands level and level + 1 differ."""
        largest = int(np.exp((level + 2) * self.width)) + 1
        return (2 * (100 - self.percent) * largest) // (100 + self.percent) + 2

    def keys(self, elements: np.ndarray) -> np.ndarray:
        """The keys of a set at both levels that its band is part of."""
        out, mixed, high = [], mix(elements), elements >> np.uint64(32)
        band = self.band(len(elements))
        for level in (band - 1, band):
            if level < 0:
                continue
            m = self.parts(level)
            part = ((high * np.uint64(m)) >> np.uint64(32)).astype(np.intp)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1])
            sums, names = np.add.reduceat(mixed, starts), part[starts]
            if m - len(names) >= 2:
                filled = np.zeros(m, np.uint64)
                filled[names] = sums
                sums, names = filled, np.arange(m)
            out.append(mix(mix(sums) + mix(names.astype(np.uint64) + np.uint64(level << 32))))
        return np.concatenate(out)


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, least id of each, ids linked to another least id, that least id)."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    start = np.concatenate([[True], keys[1:] != keys[:-1]])
    first = ids[start][np.cumsum(start) - 1]
    links = np.unique(np.column_stack([ids, first])[ids != first], axis=0)
    return keys[start], ids[start], links[:, 0], links[:, 1]


def _frame(kind: int, key, a, b) -> pa.RecordBatch:
    as_long = lambda x: pa.array(np.asarray(x).astype(np.int64)) if not isinstance(x, pa.Array) else x
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), as_long(key), as_long(a), as_long(b)], ["kind", "key", "a", "b"])


DDL = "kind int, key long, a long, b long"
COUNTS = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n", pa.int64())])


def shared_counts(docs: DataFrame, words: int, id_col: str, text_col: str, share: float = 1) -> DataFrame:
    """Rows of kind, a, b: PROFILE (document, set size << 32 | shingles counted) of each row, SHARED (document, shingles that occur elsewhere too), to be added up.

    Counted are shingles whose hash lies in the first `share` of the range.

    A shingle that several texts of a run have is counted there and sent on once, without a document, so one that very
    many texts have gives each run one row.
    """

    def emit(batches):
        memo = WordHashes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for some in by_size(texts, 4_000_000):
                own = pa.array(ids[some], pa.int64())
                sets = [shingle_set(t, memo, words) for t in texts[some]]
                whole = np.array([len(s) for s in sets], np.int64)
                if share < 1:
                    sets = [s[: np.searchsorted(s, np.uint64(int(share * 2**64)))] for s in sets]
                sizes = np.array([len(s) for s in sets], np.int64)
                spread = -1 - np.arange(len(sets))
                yield pa.RecordBatch.from_arrays([pa.array(spread), own, pa.array(whole << 32 | sizes)], schema=COUNTS)
                there = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0))
                if not len(there):
                    continue
                hashes = (np.concatenate([sets[i] for i in there]) >> np.uint64(LEFT_OUT)).astype(np.int64)
                owner = np.repeat(there, sizes[there])
                order = np.argsort(hashes)
                hashes, owner = hashes[order], owner[order]
                starts = np.flatnonzero(np.diff(hashes, prepend=-1))
                repeats = np.diff(np.append(starts, len(hashes)))
                several = repeats > 1
                counted = np.bincount(owner[np.repeat(several, repeats)], minlength=len(sets))
                found = np.flatnonzero(counted)
                yield pa.RecordBatch.from_arrays([pa.array(spread[found]), own.take(pa.array(found)), pa.array(-counted[found])], schema=COUNTS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[starts]), own.take(pa.array(owner[starts], mask=several)), pa.array(np.zeros(len(starts), np.int64))], schema=COUNTS
                )

    def add(batches):
        last, waiting, gathered, n_gathered = None, None, [], 0
        as_batch = lambda kind, a, b: pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), a, pa.array(b)], ["kind", "a", "b"])

        def hand_on():
            ids, n = np.unique(np.concatenate(gathered), return_counts=True)
            return as_batch(SHARED, pa.array(ids), n.astype(np.int64))

        for batch in batches:
            key, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for kind, which in ((PROFILE, (key < 0) & (n >= 0)), (SHARED, (key < 0) & (n < 0))):
                if which.any():
                    yield as_batch(kind, batch.column(1).filter(pa.array(which)), np.abs(n[which]))
            if not (key >= 0).any():
                continue
            at = int(np.argmax(key >= 0))  # rows are sorted by key
            key, ids = key[at:], batch.column(1).slice(at)
            valid, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            same = key[1:] == key[:-1]
            shared = np.append(False, same) | np.append(same, False)
            if last == key[0]:  # goes on from the batch before
                shared[0] = True
                if waiting is not None:
                    gathered.append(np.array([waiting]))
                waiting = None
            gathered.append(ids[shared & valid])
            n_gathered += len(gathered[-1])
            last, waiting = key[-1], ids[-1] if valid[-1] and not shared[-1] else None
            if n_gathered >= TOGETHER:
                yield hand_on()
                gathered, n_gathered = [], 0
        if gathered:
            yield hand_on()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(emit, "key long, id long, n long")
    return rows.repartition(shuffle_partitions(docs.sparkSession), "key").sortWithinPartitions("key").mapInArrow(add, "kind int, a long, b long")


def able_to_link(counted: DataFrame, percent: int) -> DataFrame:
    """(id, size) of the documents that may be linked. counted: of shared_counts.

    A row of a linked set has at most 100 - percent of a hundred of its shingles for itself, wherever they are counted;
    of several rows with one identifier it is enough that one may be linked.
    """
    profiles = counted.where((F.col("kind") == PROFILE) & F.col("a").isNotNull()).select(F.col("a").alias("id"), F.shiftright("b", 32).alias("size"), F.expr("b & 4294967295").alias("n"))
    need = F.expr(f"100 * n - {100 - percent} * size")
    sizes = profiles.where("size > 0").groupBy("id").agg(F.max("size").alias("size"), F.min(need).alias("need"))
    shared = counted.where(F.col("kind") == SHARED).groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("shared"))
    return cut(sizes.join(shared, "id", "left").where("100 * coalesce(shared, 0) >= need").select("id", "size"))


def set_links(docs: DataFrame, percent: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of kind, a, b: EXACT (document, one with the same set), CANDIDATE (document, one with a common key)."""

    def emit(batches):
        memo, bands = WordHashes(), Bands(percent)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for some in by_size(texts, 4_000_000):
                own = ids[some]
                sets = [shingle_set(t, memo, words) for t in texts[some]]
                there = [i for i, s in enumerate(sets) if len(s) and own[i] is not None]
                if not there:
                    continue
                whole = np.array([mix(mix(sets[i]).sum(keepdims=True) + np.uint64(len(sets[i])))[0] for i in there], np.uint64)
                names = np.array([own[i] for i in there], np.int64)
                keys, firsts, a, b = _stars(whole, names)
                yield _frame(EXACT, keys, firsts, firsts)
                yield _frame(EXACT, mix(a.astype(np.uint64)), a, b)
                new = set(firsts.tolist())
                kept, done = [], set()
                for i in there:
                    if own[i] in new and own[i] not in done:
                        done.add(own[i])
                        kept.append((own[i], bands.keys(sets[i])))
                every = np.concatenate([k for _, k in kept])
                keys, firsts, a, b = _stars(every, np.repeat(np.array([i for i, _ in kept], np.int64), [len(k) for _, k in kept]))
                yield _frame(CANDIDATE, keys, firsts, firsts)
                yield _frame(CANDIDATE, mix(a.astype(np.uint64)), a, b)

    def join(batches):
        last = {}
        for batch in batches:
            kind, key, a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "key", "a", "b"))
            ready = a != b
            if ready.any():
                yield batch.filter(pa.array(ready))
            for which in (EXACT, CANDIDATE):
                rows = (kind == which) & (a == b)
                if rows.any():
                    keys, ids = key[rows], a[rows].astype(np.int64)
                    if which in last and last[which][0] == keys[0]:  # goes on from the batch before
                        keys, ids = np.concatenate([[last[which][0]], keys]), np.concatenate([[last[which][1]], ids])
                    start = np.concatenate([[True], keys[1:] != keys[:-1]])
                    first = ids[start][np.cumsum(start) - 1]
                    last[which] = (keys[-1], first[-1])
                    links = np.unique(np.column_stack([ids, first])[ids != first], axis=0)
                    if len(links):
                        yield _frame(which, links[:, 0], links[:, 0], links[:, 1])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(emit, DDL)
    return rows.repartition(shuffle_partitions(docs.sparkSession), "key").sortWithinPartitions("key", "a").mapInArrow(join, DDL).select("kind", "a", "b")


def tile_links(sets: list[np.ndarray], side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links that connect all linked sets of a tile (places in the list); with sides, only across sides."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order])
    sides = None if side is None else side[order]
    bits = min(4096, max(256, 1 << int(2 * sizes[-1]).bit_length()))
    maps = np.zeros((len(sets), bits // 64), np.uint64)
    for row, i in enumerate(order):
        filled = np.zeros(bits, np.uint8)
        filled[(sets[i] & np.uint64(bits - 1)).astype(np.intp)] = 1
        maps[row] = np.packbits(filled, bitorder="little").view(np.uint64)
    root, links = np.arange(len(sets)), []
    last = np.searchsorted(sizes, sizes * 100 // percent, side="right")
    for i in range(len(sets) - 1):
        near = np.arange(i + 1, last[i])
        near = near[root[near] != root[i]]
        if sides is not None:
            near = near[sides[near] != sides[i]]
        if not len(near):
            continue
        only_i = np.bitwise_count(maps[i] & ~maps[near]).sum(1, dtype=np.int64)
        only_j = np.bitwise_count(maps[near] & ~maps[i]).sum(1, dtype=np.int64)
        most = np.minimum(sizes[i] - only_i, sizes[near] - only_j)
        for j in near[(100 + percent) * most >= percent * (sizes[i] + sizes[near])].tolist():
            if root[i] == root[j]:
                continue
            both = len(np.intersect1d(sets[order[i]], sets[order[j]], assume_unique=True))
            if (100 + percent) * both >= percent * (sizes[i] + sizes[j]):
                links.append((int(order[i]), int(order[j])))
                root[root == root[j]] = root[i]
    return links


def verified_links(docs: DataFrame, members: DataFrame, percent: int, words: int, id_col: str, text_col: str, tile: int = TILE) -> DataFrame:
    """(a, b): links that connect all linked documents. members: id, size, group; linked documents have the same group."""
    band = F.floor(F.log("size") / F.lit(float(Bands(percent).width))).cast("int")
    members = members.withColumn("band", band)
    whole = members.groupBy("group").agg(F.sum("size").alias("all"))
    blocks = members.groupBy("group", "band").agg(F.ceil(F.sum("size") / tile).cast("int").alias("blocks"))
    large = cut(blocks.join(whole.where(F.col("all") > 2 * tile), "group", "left_semi"))
    next_band = large.select("group", (F.col("band") - 1).alias("band"), F.col("blocks").alias("blocks_up"))
    last_band = large.select("group", (F.col("band") + 1).alias("band"), F.col("blocks").alias("blocks_down"))
    plan = large.join(next_band, ["group", "band"], "left").join(last_band, ["group", "band"], "left")
    placed = members.join(plan, ["group", "band"], "left").withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int"))
    tiles = F.expr(
        """if(blocks is null, array(struct(band as band, 0 as low, 0 as high, cast(null as int) as side)), concat(
             transform(sequence(0, blocks - 1), o -> struct(band as band, least(o, block) as low, greatest(o, block) as high, if(o = block, cast(null as int), if(block < o, 0, 1)) as side)),
             if(blocks_up is null, array(), transform(sequence(0, blocks_up - 1), o -> struct(-1 - band as band, block as low, o as high, 0 as side))),
             if(blocks_down is null, array(), transform(sequence(0, blocks_down - 1), o -> struct(-band as band, o as low, block as high, 1 as side)))))"""
    )
    placed = placed.select("id", "group", F.when(F.col("blocks").isNull(), F.lit(True)).otherwise(F.lit(False)).alias("single"), F.explode(tiles).alias("t"))
    placed = placed.select("id", F.col("group").alias("g"), F.when(F.col("single"), F.lit(0)).otherwise(F.col("t.band")).alias("band"), "t.low", "t.high", "t.side")
    placed = cut(placed)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    small = placed.count() <= BROADCAST_ROWS
    rows = texts.join(F.broadcast(placed) if small else placed, "id")
    n = shuffle_partitions(docs.sparkSession)
    rows = rows.repartition(n, "g", "band", "low", "high").sortWithinPartitions("g", "band", "low", "high", "id")

    def verify(batches):
        memo, name, ids, sets, sides = WordHashes(), None, [], [], []

        def close():
            mixed = None if not any(s is not None for s in sides) else np.array([-1 if s is None else s for s in sides])
            found = tile_links(sets, mixed, percent) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for *tile_name, key, text, side in zip(*(batch.column(c).to_pylist() for c in ("g", "band", "low", "high", "id", "text", "side"))):
                if tile_name != name:
                    if ids:
                        yield close()
                    name, ids, sets, sides = tile_name, [], [], []
                own = shingle_set(text, memo, words)
                if len(own):
                    ids.append(key)
                    sets.append(own)
                    sides.append(side)
        if ids:
            yield close()

    return rows.mapInArrow(verify, "a long, b long")


def split_groups(docs: DataFrame, members: DataFrame, percent: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """members with groups that are connected by rare shared shingles alone; those that share none with others are left out. Linked ones stay together."""

    def emit(batches):
        memo = WordHashes()
        for batch in batches:
            for some in by_size(texts := batch.column(2).to_pylist(), 4_000_000):
                sets = [shingle_set(t, memo, words) for t in texts[some]]
                sizes = np.array([len(s) for s in sets], np.int64)
                row = np.repeat(np.arange(len(sets)), sizes)
                whole = np.array([mix(s).sum() for s in sets], np.uint64)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[some].take(pa.array(row)), batch.column(1)[some].take(pa.array(row)), pa.array(whole[row].view(np.int64)), pa.array(sizes[row]), pa.array(np.concatenate(sets).view(np.int64))],
                        ["id", "group", "whole", "size", "h"],
                    )

    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    small = members.count() <= BROADCAST_ROWS
    named = members.select("id", "group")
    rows = cut(texts.join(F.broadcast(named) if small else named, "id").select("id", "group", "text").mapInArrow(emit, "id long, group long, whole long, size long, h long"))
    often = rows.groupBy("group", "h").agg(F.count("*").alias("n")).where("n > 1")
    one = Window.partitionBy("id", "whole")
    shared = rows.join(often, ["group", "h"]).withColumns({"place": F.row_number().over(one.orderBy("n", "h")), "all": F.count("*").over(one)})
    # shingles that no other set of the group has come first
    first = cut(shared.where(F.expr(f"place + size - all <= size - ceil({percent} * size / 100) + 1")).select("id", "group", "h"))
    links = first.join(first.groupBy("group", "h").agg(F.min("id").alias("least")), ["group", "h"]).where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    found = components(links)
    return members.drop("group").join(found.select(F.col("node").alias("id"), F.col("component").alias("group")), "id")


def near_components(docs: DataFrame, percent: int = 90, words: int = 3, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest identifier reachable by links, itself included).

    Two documents link when 100 * intersection >= percent * union of their shingle sets. A missing text is empty;
    empty texts and documents without an identifier are linked with nothing; rows with the same identifier are one node;
    an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias(id_col), text_or_empty(text_col).alias(text_col))

    def only(ids: DataFrame) -> DataFrame:
        names = ids.select(F.col("id").alias(id_col))
        return docs.join(F.broadcast(names) if ids.count() <= BROADCAST_ROWS else names, id_col, "left_semi")

    share = min(1, 2.5 * (100 - percent) / 100)
    counted = cut(shared_counts(docs, words, id_col, text_col, share))
    profiles = counted.where(F.col("kind") == PROFILE).select(F.col("a").alias("id"), F.shiftright("b", 32).alias("size"))
    able = able_to_link(counted, percent)
    if share < 1:
        able = able_to_link(cut(shared_counts(only(able), words, id_col, text_col)), percent)
    some = only(able)
    rows = cut(set_links(some, percent, words, id_col, text_col))
    exact = rows.where(F.col("kind") == EXACT).select("a", "b")
    candidates = rows.where(F.col("kind") == CANDIDATE).select("a", "b")
    # a set's copies hang on the least identifier of a batch, those on the least of all; only that one is compared
    groups = components(candidates.union(exact))
    heads = groups.withColumnRenamed("node", "id").join(exact.select(F.col("a").alias("id")), "id", "left_anti")
    several = heads.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(heads.join(several, "component", "left_semi").join(able, "id").select("id", "size", F.col("component").alias("group")))
    large = cut(members.groupBy("group").agg(F.sum("size").alias("all")).where(F.col("all") > tile).select("group"))
    if not large.isEmpty():
        split = split_groups(some, cut(members.join(large, "group", "left_semi")), percent, words, id_col, text_col)
        members = cut(members.join(large, "group", "left_anti").select("id", "size", "group").union(split.select("id", "size", "group")))
    links = exact if members.isEmpty() else exact.union(cut(verified_links(some, members, percent, words, id_col, text_col, tile)))
    found = components(links)
    return profiles.join(found, profiles["id"] == found["node"], "left").select(
        F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def keep_first(docs: DataFrame, percent: int = 90, words: int = 3) -> DataFrame:
    """The documents with the smallest identifier of their component, with all their columns; documents without an identifier stay."""
    name = fresh_name(docs, "gone_")
    gone = cut(near_components(docs, percent, words).where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, docs["doc_id"].cast("long") == F.col(name), "left_anti")
