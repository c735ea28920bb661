"""Prefix trie of conversations: vertical bitmaps in shards of sorted conversations, borders added up between shards."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isopleth.llm.common import Rows, cut, text_or_empty

#: Conversations and turns that a shard has at most (a longer conversation is a shard of its own).
SHARD, SHARD_TURNS = 2048, 200_000
SALTS = 16
_WORD_COUNT = r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')"
_NODES = pa.schema([("key", pa.binary()), ("above", pa.binary()), *((c, pa.int64()) for c in ("shard", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends", pa.string()), ("ends_sha256", pa.string())])
_DDL = "key binary, above binary, shard long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, ends_sha256 string"


def rebuild(conversations: DataFrame, family: int = 20, most_shared: int = 4) -> DataFrame:
    """One row per conversation, rebuilt: conv_id, and its turns' digests (16 bytes) and words in order.

    Conversation c begins with the first h = crc32(c) % most_shared turns of conversation c - c % family (the remainder
    has c's sign), and goes on with its own turns after its first h. Turns are ordered by `turn` (missing first), ties
    by the digest of role and text, which tells apart all that differ. Missing roles and texts are ''. Rows without a
    conv_id belong to no conversation and are left out.
    """
    plain = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), text_or_empty("role").alias("role"), text_or_empty("text").alias("text")).where("conv_id is not null")
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    turns = plain.select("conv_id", F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), digest.alias("digest"), F.expr(_WORD_COUNT).cast("long").alias("words")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.expr("transform(array_sort(collect_list(t)), x -> struct(x.digest, x.words))").alias("turns"))
    heads = whole.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most_shared).alias("head"))
    keyed = whole.withColumn("h", F.expr(f"int(crc32(cast(cast(conv_id as string) as binary)) % {most_shared})")).withColumn("base", F.expr(f"conv_id - conv_id % {family}"))
    rebuilt = F.expr("concat(slice(coalesce(head, array()), 1, h), slice(turns, h + 1, greatest(size(turns) - h, 0)))")
    return keyed.join(heads, "base", "left").select("conv_id", rebuilt.alias("turns")).select("conv_id", F.col("turns.digest").alias("path"), F.col("turns.words").alias("words"))


def _common(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Shard:
    """The trie of some conversations, in path order: (conv_id, path, words) each.

    For each position, each turn has a bitset of the conversations that have it there. A node is the bitset of its
    members: the lowest member that isn't dealt yet names the next child's turn, and the child is the node's bitset
    without its ends, intersected with that turn's. `before` and `after` are how many turns the first conversation
    shares with the one before the shard, the last one with the one after it: nodes up to there are parts of nodes that
    other shards have too.
    """

    def __init__(self, convs: list[tuple], before: int, after: int):
        self.convs, self.before, self.after = convs, before, after
        self.postings: list[dict] = []
        self.ended: list[int] = []
        for i, (_, path, _) in enumerate(convs):
            while len(self.ended) <= len(path):
                self.ended.append(0)
                self.postings.append({})
            self.ended[len(path)] |= 1 << i
            for at, turn in enumerate(path):
                posting = self.postings[at]
                posting[turn] = posting.get(turn, 0) | 1 << i

    def nodes(self):
        """(depth, first, members, n_children, n_leaves, saved, ends, continued, continues, parent's first) of each node.

        Sums run over the shard's own part of the subtree. A node that began before the shard (continued) counts there
        as a child and its words are taken off there; one that goes on after it (continues) is no leaf here: in path
        order a conversation that ends comes before those that go on, so a node's last shard knows.
        """
        last = len(self.convs) - 1
        stack, done = [], []
        # frame: bitset, depth, members left to deal, children, leaves, saved, ends, continued, continues, parent's first member
        stack.append(self._frame((1 << len(self.convs)) - 1, 0, last, 0))
        while stack:
            frame = stack[-1]
            if frame["left"]:
                low = (frame["left"] & -frame["left"]).bit_length() - 1
                child = frame["left"] & self.postings[frame["depth"]][self.convs[low][1][frame["depth"]]]
                frame["left"] &= ~child
                stack.append(self._frame(child, frame["depth"] + 1, last, frame["least"]))
                continue
            stack.pop()
            depth, first = frame["depth"], frame["first"]
            words = self.convs[first][2][depth - 1] if depth else 0
            frame["saved"] += (frame["n"] - (not frame["continued"])) * words
            if not frame["grown"] and not frame["continues"]:
                frame["leaves"] += 1
            if stack:
                up = stack[-1]
                up["leaves"] += frame["leaves"]
                up["saved"] += frame["saved"]
                up["children"] += not frame["continued"]
                up["grown"] = True
            done.append(frame)
        return done

    def _frame(self, bits: int, depth: int, last: int, parent: int) -> dict:
        first = (bits & -bits).bit_length() - 1
        ends = bits & self.ended[depth]
        return {
            "bits": bits, "depth": depth, "first": first, "n": bits.bit_count(), "ends": [self.convs[i][0] for i in _ones(ends)], "left": bits & ~ends, "children": 0, "leaves": 0, "saved": 0, "grown": False,
            "least": min(self.convs[i][0] for i in _ones(bits)), "parent": parent, "continued": first == 0 and depth <= self.before, "continues": bits >> last & 1 == 1 and depth <= self.after,
        }

    def rows(self, number: int):
        """Rows for _NODES: whole nodes have their hash; parts of shared nodes their key, ends and, unless they are the
        root's, their parent's key; whole nodes under shared ones their parent's key."""
        for f in self.nodes():
            depth, shared = f["depth"], f["continued"] or f["continues"]
            path = self.convs[f["first"]][1]
            above_shared = depth > 0 and self._shared(depth - 1, f)
            ends = ",".join(map(str, sorted(f["ends"])))
            yield (
                _key(path, depth) if shared else None, _key(path, depth - 1) if above_shared else None, number, depth, f["least"], f["parent"] if depth and not above_shared else None, f["n"], f["children"], f["leaves"], f["saved"],
                ends if shared else None, None if shared else hashlib.sha256(ends.encode()).hexdigest(),
            )

    def _shared(self, depth: int, below: dict) -> bool:
        """Whether the node at that depth above another one is shared."""
        path = self.convs[below["first"]][1]
        return any(depth <= n and self.convs[i][1][:depth] == path[:depth] for n, i in ((self.before, 0), (self.after, len(self.convs) - 1)))


def _ones(bits: int):
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def _key(path: list[bytes], depth: int) -> bytes:
    return hashlib.sha256(b"".join(path[:depth])).digest()


def _convs(batches):
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(3)))


def _edges(batches):
    """The first and last path of a partition."""
    first = last = None
    for _, path, _ in _convs(batches):
        first, last = path if first is None else first, path
    if first is not None:
        yield pa.RecordBatch.from_pydict({"number": pa.array([TaskContext.get().partitionId()], pa.int32()), "first": pa.array([first], pa.list_(pa.binary())), "last": pa.array([last], pa.list_(pa.binary()))})


def _sum_shared(batches):
    """Shared nodes from their parts, which come in the order of shards, so that ends come in the order of ids."""
    rows, held, digest = Rows(pa.schema([f for f in _NODES if f.name not in ("shard", "ends", "parent_conv_id")]), 2000), None, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            row = dict(zip(_NODES.names, row))
            if held is not None and held["key"] == row["key"]:
                held["conv_id"] = min(held["conv_id"], row["conv_id"])
                for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    held[c] += row[c]
                held["above"] = held["above"] or row["above"]
            else:
                if held is not None:
                    rows.add(*(held[c] for c in rows.schema.names[:-1]), digest.hexdigest())
                held, digest, begun = row, hashlib.sha256(), False
            if row["ends"]:
                digest.update((("," if begun else "") + row["ends"]).encode())
                begun = True
        if rows.full():
            yield rows.take()
    if held is not None:
        rows.add(*(held[c] for c in rows.schema.names[:-1]), digest.hexdigest())
    yield rows.take()


def prefix_trie(conversations: DataFrame, family: int = 20, most_shared: int = 4, shard: int = SHARD, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of all rebuilt conversations (see rebuild); one row per node.

    conv_id is the smallest member's, parent_conv_id the parent's; n_convs counts members, repeated conversations each,
    n_children children, n_leaves the childless nodes of the subtree; saved_tokens sums over the subtree each node's
    (n_convs - 1) times the words of its last turn; ends_sha256 hashes the conv_ids of conversations that end there.

    Conversations are sorted by path and id over all tasks and cut into shards, so a subtree is a run of shards, and
    only nodes that neighbouring conversations of two shards share are parts of more than one. A shard's trie comes from
    bitsets (see Shard). Parts of shared nodes are added up: sums leave out, in all but the node's first part, what
    would count twice. A shared node's ends are hashed as a stream. A task holds one shard; a conversation is 16 bytes
    a turn; the driver holds two numbers per partition. A repeated (conv_id, turn) is a further turn; an empty table
    gives no rows; extra columns are ignored.
    """
    convs = cut(rebuild(conversations, family, most_shared).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id"))
    edges = convs.mapInArrow(_edges, "number int, first array<binary>, last array<binary>")
    by_number = Window.orderBy("number")
    alike = "coalesce(aggregate(sequence(1, least(size({0}), size({1}))), 0, (n, i) -> if(n = i - 1 and element_at({0}, i) = element_at({1}, i), i, n)), 0)"
    pairs = edges.withColumns({"before": F.lag("last").over(by_number), "after": F.lead("first").over(by_number)})
    shares = {r["number"]: (r["b"], r["a"]) for r in pairs.select("number", *(F.expr(f"case when {o} is null then -1 when least(size({o}), size({p})) = 0 then 0 else {alike.format(o, p)} end").alias(n) for n, o, p in (("b", "before", "first"), ("a", "after", "last")))).collect()}

    def shards(batches):
        task = TaskContext.get().partitionId()
        before, after = shares.get(task, (-1, -1))
        rows, held, turns, number = Rows(_NODES, 5000), [], 0, task << 32
        for conv in _convs(batches):
            if held and (len(held) >= shard or turns + len(conv[1]) > shard_turns):
                shared = _common(held[-1][1], conv[1])
                for row in Shard(held, before, shared).rows(number):
                    rows.add(*row)
                    if rows.full():
                        yield rows.take()
                before, held, turns, number = shared, [], 0, number + 1
            held.append(conv)
            turns += len(conv[1])
        for row in Shard(held, before, after).rows(number) if held else ():
            rows.add(*row)
            if rows.full():
                yield rows.take()
        yield rows.take()

    found = cut(convs.mapInArrow(shards, _DDL))
    order = ["key", "shard"]
    summed = found.where("key is not null").repartition("key").sortWithinPartitions(*order)
    shared = cut(summed.mapInArrow(_sum_shared, ", ".join(f"{f.name} {'binary' if f.name in ('key', 'above') else 'string' if f.name == 'ends_sha256' else 'long'}" for f in _NODES if f.name not in ("shard", "ends", "parent_conv_id"))))
    own = found.where("key is null")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    parents = shared.select(F.col("key").alias("above"), F.col("conv_id").alias("parent"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    hanging = own.where("above is not null").drop("key", "parent_conv_id", "shard", "ends").unionByName(shared.where("above is not null").drop("key"))
    hanging = hanging.withColumn("salt", F.expr(f"pmod(hash(conv_id, depth), {SALTS})")).join(parents, ["above", "salt"]).withColumn("parent_conv_id", F.col("parent"))
    tops = shared.where("above is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return own.where("above is null").select(*names).unionByName(hanging.select(*names)).unionByName(tops.select(*names))
