"""How the sources of a language differ in their terms: chunk factorization, exact counts, integer divergences."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isopleth.llm.common import shuffle_partitions, text_or_empty, written

#: Terms: runs of ASCII letters and of whatever is not ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents and characters of which a part consists at most (one longer text is a part of its own).
PART_DOCS, PART_CHARS = 16_384, 48_000_000
#: Entries that are summed before more are taken.
HELD = 4_000_000

_POSTINGS = "bucket int, part long, words binary, lengths binary, docs binary, counts binary, groups string"
_ENTRIES = "bucket int, lang string, terms binary, lengths binary, source binary, n binary, n_docs binary, sources string"
_ENTRY = pa.struct([("source", pa.string()), ("n", pa.int64()), ("n_docs", pa.int64())])
_FOUND = pa.schema([("lang", pa.string()), ("term", pa.string()), ("n_docs", pa.int64()), ("sources", pa.list_(_ENTRY))])


def _starts(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


def _bucketed(strings: list | np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings by the bucket of their hash, and the bounds of the buckets in it."""
    number = (pd.util.hash_array(np.asarray(strings, object), categorize=False) % np.uint64(buckets)).astype(np.int64) if len(strings) else np.zeros(0, np.int64)
    order = np.argsort(number, kind="stable")
    return order, np.searchsorted(number[order], np.arange(buckets + 1))


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(raw, kind).astype(np.int64)


def _count_part(number: int, langs: pa.Array, sources: pa.Array, texts: pa.Array, buckets: int) -> pa.RecordBatch:
    """Chunks of a part with the documents that have them and how often, one row per bucket of chunks.

    Documents are numbered by language and source; one row has the groups with their first numbers.
    """
    places = pa.table({"lang": langs, "source": sources, "at": np.arange(len(texts))}).sort_by([("lang", "ascending"), ("source", "ascending")])
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.take(places["at"].combine_chunks())))
    words = split.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))
    strings = words.dictionary.to_numpy(zero_copy_only=False)
    order, bounds = _bucketed(strings, buckets)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    key = place[words.indices.to_numpy(zero_copy_only=False)] << 16 | doc
    key.sort()
    at = _starts(key)
    counts, key = np.diff(np.append(at, len(key))), key[at]
    first = np.searchsorted(key >> 16, np.arange(len(order) + 1))  # every word has a document, so these rise
    lengths, docs = np.diff(first).astype("<u2"), (key & 0xFFFF).astype("<u2")
    pairs = list(zip(places["lang"].to_pylist(), places["source"].to_pylist()))
    groups = json.dumps([[*pairs[i], i] for i in range(len(pairs)) if i == 0 or pairs[i] != pairs[i - 1]])
    rows = []
    for bucket in range(buckets):
        low, high = bounds[bucket], bounds[bucket + 1]
        head = groups if bucket == number % buckets else None
        if low < high or head:
            own = slice(first[low], first[high])
            kind = "<u1" if counts[own].max(initial=0) < 256 else "<u4"
            rows.append((bucket, number, "\n".join(strings[order[low:high]]).encode(), lengths[low:high].tobytes(), docs[own].tobytes(), counts[own].astype(kind).tobytes(), head))
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "part", "words", "lengths", "docs", "counts", "groups"])


def count_chunks(docs: DataFrame, buckets: int, part_docs: int = PART_DOCS, part_chars: int = PART_CHARS) -> DataFrame:
    """White-space chunks, A-Z lowered, per part of the documents and bucket of chunks: which documents have them and
    how often.

    docs has lang, source, text. A part is a run of a partition's documents, at most 65,536. A row has a bucket's
    chunks of a part, packed as columns are, so that Spark moves a few rows instead of one per chunk.
    """

    def parts(batches):
        base, number, held, n_docs, size = TaskContext.get().partitionId() << 32, 0, [], 0, 0
        close = lambda: _count_part(base + number, *(c.combine_chunks() for c in pa.Table.from_batches(held).columns), buckets)
        for batch in batches:
            lengths, at = pc.binary_length(batch.column(2)).to_numpy().astype(np.int64), 0
            while at < len(batch):
                room = int(np.searchsorted(np.cumsum(lengths[at:]), part_chars - size, "right"))
                take = min(max(room, 0 if n_docs else 1), part_docs - n_docs, len(batch) - at)
                if take:
                    held.append(batch.slice(at, take))
                    n_docs, size, at = n_docs + take, size + int(lengths[at : at + take].sum()), at + take
                if at < len(batch) or n_docs >= part_docs:
                    yield close()
                    number, held, n_docs, size = number + 1, [], 0, 0
        if held:
            yield close()

    return docs.select("lang", "source", "text").mapInArrow(parts, _POSTINGS)


def to_terms(chunks: DataFrame, buckets: int) -> DataFrame:
    """The counted chunks as terms, still by part; each different chunk of all documents is cut into its terms once.

    A chunk's bucket is one task's, which remembers the terms of the chunks that it has seen. A chunk that has a term
    twice gives it twice.
    """

    def cut_up(batches):
        pattern, known = re.compile(TERM.encode()), {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                words = row["words"].split(b"\n")
                for word in set(words).difference(known):
                    known[word] = pattern.findall(word)
                found = list(map(known.__getitem__, words))
                lengths = _numbers(row["lengths"], "<u2")
                if len(lengths):
                    counts = np.frombuffer(row["counts"], "<u1" if len(row["counts"]) == len(row["docs"]) // 2 else "<u4")
                    of_word = np.repeat(np.arange(len(words)), np.fromiter(map(len, found), np.int64, len(found)))
                    take = lengths[of_word]
                    begin = (np.cumsum(lengths) - lengths)[of_word]
                    places = np.arange(int(take.sum())) + np.repeat(begin - (np.cumsum(take) - take), take)
                    row |= {"words": b"\n".join([t for f in found for t in f]), "lengths": take.astype("<u2").tobytes(), "docs": np.frombuffer(row["docs"], "<u2")[places].tobytes(), "counts": counts[places].tobytes()}
                if row["lengths"] or row["groups"]:
                    out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return chunks.repartitionById(buckets, F.col("bucket")).mapInArrow(cut_up, _POSTINGS)


def _sum_part(rows: list[dict], buckets: int) -> list[dict]:
    """Terms of one part: for each language its sources with occurrences and different documents, by bucket of terms."""
    groups = json.loads(next(r["groups"] for r in rows if r["groups"]))
    names = list(dict.fromkeys(source for _, source, _ in groups))
    source_of = np.array([names.index(source) for _, source, _ in groups])
    langs = list(dict.fromkeys(lang for lang, _, _ in groups))
    lang_of, begins = np.array([langs.index(lang) for lang, _, _ in groups]), np.array([first for *_, first in groups])
    words, lengths, docs, counts = [], [], [], []
    for r in rows:
        if r["lengths"]:
            words += r["words"].split(b"\n")
            lengths.append(_numbers(r["lengths"], "<u2"))
            docs.append(_numbers(r["docs"], "<u2"))
            counts.append(_numbers(r["counts"], "<u1" if len(r["counts"]) == len(r["docs"]) // 2 else "<u4"))
    if not words:
        return []
    terms = pa.array(words, pa.binary()).dictionary_encode()
    key = np.repeat(terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(lengths)) << 16 | np.concatenate(docs)
    order = np.argsort(key, kind="stable")
    key, n = key[order], np.concatenate(counts)[order]
    at = _starts(key)  # a term's documents, each once
    key, n = key[at], _sums(n, at)
    term, group = key >> 16, np.searchsorted(begins, key & 0xFFFF, "right") - 1
    at = _starts(term * len(groups) + group)  # a term's groups
    n, n_docs, term, group = _sums(n, at), np.diff(np.append(at, len(key))), term[at], group[at]
    strings, out = terms.dictionary.cast(pa.string()).to_numpy(zero_copy_only=False), []
    for number, lang in enumerate(langs):
        own = np.flatnonzero(lang_of[group] == number)
        begin = _starts(term[own])
        mine = strings[term[own][begin]]
        sizes = np.diff(np.append(begin, len(own)))
        order, bounds = _bucketed(mine, buckets)
        places = np.arange(len(own)) + np.repeat(begin[order] - (np.cumsum(sizes[order]) - sizes[order]), sizes[order]) if len(own) else own
        entries, ends = own[places], np.concatenate([[0], np.cumsum(sizes[order])])
        for bucket in range(buckets):
            low, high = bounds[bucket], bounds[bucket + 1]
            if low < high:
                some = entries[ends[low] : ends[high]]
                used, source = np.unique(source_of[group[some]], return_inverse=True)
                out.append({
                    "bucket": bucket, "lang": lang, "terms": "\n".join(mine[order[low:high]]).encode(), "lengths": sizes[order[low:high]].astype("<u2").tobytes(), "source": source.astype("<u2").tobytes(),
                    "n": n[some].astype("<u4").tobytes(), "n_docs": n_docs[some].astype("<u2").tobytes(), "sources": json.dumps([names[i] for i in used]),
                })
    return out


class _Terms:
    """Adds up packed entries of one language and bucket."""

    def __init__(self):
        self.terms, self.sources, self.new, self.size = {}, {}, [], 0

    def add(self, row: dict) -> None:
        terms = [self.terms.setdefault(t, len(self.terms)) for t in row["terms"].split(b"\n")]
        names = np.array([self.sources.setdefault(s, len(self.sources)) for s in json.loads(row["sources"])])
        self.new.append((np.repeat(np.array(terms), _numbers(row["lengths"], "<u2")) << 32 | names[_numbers(row["source"], "<u2")], _numbers(row["n"], "<u4"), _numbers(row["n_docs"], "<u2")))
        self.size += len(self.new[-1][0])
        if self.size > HELD + len(self.new[0][0]) * (len(self.new) > 1):
            self.new = [self.summed()]
            self.size = len(self.new[0][0])

    def summed(self) -> tuple:
        key, n, n_docs = (np.concatenate(c) for c in zip(*self.new))
        order = np.argsort(key, kind="stable")
        at = _starts(key[order])
        return key[order][at], _sums(n[order], at), _sums(n_docs[order], at)

    def batch(self, lang: str, least_docs: int) -> pa.RecordBatch:
        key, n, n_docs = self.summed()
        at = _starts(key >> 32)
        total = _sums(n_docs, at)
        kept = total >= least_docs
        sizes = np.diff(np.append(at, len(key)))
        inside = np.repeat(kept, sizes)
        offsets = np.concatenate([[0], np.cumsum(sizes[kept])]).astype(np.int32)
        strings = pa.array(list(self.terms), pa.binary()).cast(pa.string()).take(pa.array((key >> 32)[at][kept]))
        entries = pa.StructArray.from_arrays([pa.array(list(self.sources), pa.string()).take(pa.array((key & 0xFFFFFFFF)[inside])), pa.array(n[inside]), pa.array(n_docs[inside])], fields=list(_ENTRY))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(strings), pa.string()), strings, pa.array(total[kept]), pa.ListArray.from_arrays(pa.array(offsets), entries)], schema=_FOUND)


def term_counts(docs: DataFrame, least_docs: int = 1, part_docs: int = PART_DOCS, part_chars: int = PART_CHARS) -> DataFrame:
    """Each language's terms in at least `least_docs` of its documents: n_docs, how many have it, and for each source
    its occurrences and documents.

    Chunks are counted by document and part (see count_chunks), each different chunk is cut into terms once, the terms
    go back to their part, where documents with several chunks of one term count once, and parts are added up. Chunks
    and terms are dealt to as many buckets as there are shuffle partitions, and come there as one packed row per part,
    which are taken one at a time: memory is a part, or a bucket's different chunks or terms. However frequent a term is, it has one entry
    per part and source.
    """
    buckets = shuffle_partitions(docs.sparkSession)
    wanted = docs.select(*(text_or_empty(c).alias(c) for c in ("lang", "source", "text")))

    def by_part(batches):
        part, held = None, []

        def close():
            return pa.RecordBatch.from_pylist(_sum_part(held, buckets), schema=schema)

        schema = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), *((c, pa.binary()) for c in ("terms", "lengths", "source", "n", "n_docs")), ("sources", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if held:
                        yield close()
                    part, held = row["part"], []
                held.append(row)
        if held:
            yield close()

    def by_bucket(batches):
        key, held = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["bucket"], row["lang"]) != key:
                    if held:
                        yield held.batch(key[1], least_docs)
                    key, held = (row["bucket"], row["lang"]), _Terms()
                held.add(row)
        if held:
            yield held.batch(key[1], least_docs)

    terms = to_terms(count_chunks(wanted, buckets, part_docs, part_chars), buckets)
    back = F.expr(f"cast(pmod(shiftright(part, 32), {buckets}) as int)")
    of_parts = terms.repartitionById(buckets, back).sortWithinPartitions("part").mapInArrow(by_part, _ENTRIES)
    return of_parts.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "lang").mapInArrow(by_bucket, "lang string, term string, n_docs long, sources array<struct<source string, n long, n_docs long>>")


def _share(count: str, total: str, kept: str) -> str:
    """p of a count; decimals, as a billion times a count may pass 64 bits."""
    return f"1 + cast(1000000000 as decimal(10,0)) * cast({count} + 2 as decimal(20,0)) div cast(greatest({total} + 2 * {kept}, 1) as decimal(20,0))"


def _apart(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def divergence(docs: DataFrame, least_docs: int = 10, best_terms: int = 10) -> DataFrame:
    """Divergence of each source of a language from each other one, and the terms that set it apart most.

    docs has lang, source and text; missing ones are ''. A language keeps the terms that at least `least_docs` of its
    documents have. p of a count is 1 + floor(10^9 (count + 2) / (N + 2 V)), N the group's occurrences of kept terms, V
    how many terms are kept; two shares are floor((p - q)^2 / (p + q)) apart. Rows of part `pair` have another source of
    the language and that summed over all kept terms, 0 if there are none; rows of part `term` the terms with p above
    the whole language's, only the first `best_terms`. Ranks run by value downwards, then by the item's bytes.

    A term's sources without it all have the same share, so its pairs are added up for sources that have it: with p0 for
    a count of 0, sum f(p, q) = V f(p0, q0) + sum over the first's terms (f(p, q0) - f(p0, q0)) + the same for the
    second + sum over common terms (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)). The first's terms are summed by count.
    A repeated row is another document; extra columns are ignored; an empty table gives no rows.
    """
    wanted = docs.select(*(text_or_empty(c).alias(c) for c in ("lang", "source", "text")))
    terms = written(term_counts(wanted, least_docs).withColumn("n_lang", F.expr("aggregate(sources, 0L, (a, s) -> a + s.n)")), "terms")
    kept = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    entries = terms.select("lang", "term", "n_lang", F.inline("sources")).drop("n_docs")
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = wanted.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["total", "v", "total_lang"])
    groups = written(groups.withColumn("p0", F.expr(_share("0", "total", "v"))), "groups")

    shares = entries.join(groups, ["lang", "source"]).withColumns({"p": F.expr(_share("n", "total", "v")), "q": F.expr(_share("n_lang", "total_lang", "v"))})
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    apart = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_apart("p", "q")).alias("value"))
    best = apart.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= best_terms)

    ends = groups.select("lang", "source", "p0", "v")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    both = ends.join(other, "lang").where("source <> item")
    by_count = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("times"))
    own = by_count.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.expr(f"times * ({_apart('p', 'q0')} - {_apart('p0', 'q0')})")).alias("own"))
    lists = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("a"))
    common = lists.select("lang", "a", F.explode("a").alias("x")).select("lang", "x", F.explode(F.expr("filter(a, y -> y.source > x.source)")).alias("y"))
    common = common.select("lang", F.col("x.source").alias("low"), F.col("y.source").alias("high"), F.expr(f"{_apart('x.p', 'y.p')} - {_apart('x.p', 'y.p0')} - {_apart('x.p0', 'y.p')} + {_apart('x.p0', 'y.p0')}").alias("more"))
    common = common.groupBy("lang", "low", "high").agg(F.sum("more").alias("more"))
    value = F.expr(f"if(v = 0, 0L, v * {_apart('p0', 'q0')} + coalesce(own, 0L) + coalesce(own_other, 0L) + coalesce(more, 0L))")
    found = (
        both.join(own, ["lang", "source", "item"], "left")
        .join(own.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col("own").alias("own_other")), ["lang", "source", "item"], "left")
        .withColumns({"low": F.least("source", "item"), "high": F.greatest("source", "item")})
        .join(common, ["lang", "low", "high"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    )
    return found.withColumn("rank", F.row_number().over(ranked)).unionByName(best)
