"""Line dedup: near-equal lines by MinHash, verified exactly, one line kept per component. DataFrame operations alone.

1. Each distinct line (in lower case, without blanks around it) gets twenty minima of its hashed character 8-grams, one
   per residue class of the hash, in one pre-aggregated pass over all of them. Of a long line only hashes below a bound
   that falls with its length count, about 160 of them; where a minimum is missing then, as in lines of few distinct
   8-grams, the line is signed again over all of its 8-grams. Unlike lines of one language have many of the 5-shingles
   in common that are verified later (long ones 3 %), and so more and more neighbours the more lines there are, but hardly
   any 8-gram (0.1 %). Of lines whose 5-shingles are alike by J = 0.8, edited at random places, the 8-grams are alike by 0.70 to 0.73. Lines of up to 16
   characters, and those of few distinct shingles, whose 8-grams may differ more, are signed a second time by 5-shingles.
2. Banding: twenty bands of three minima, each minimum in three. Of pairs of J = 0.7 of 8-grams 0.5 % share no band, of J = 0.8 0.02 %.
   In buckets of up to 32 lines each line meets each. Lines of larger buckets are keyed again by 36 bands of four minima,
   which takes apart what only templates or common passages brought together (of pairs of J = 0.7 2 % share none of these,
   of J = 0.8 0.2 %: what is lost where pairs meet in large buckets alone). In buckets of these bands that are still larger, each line meets two hubs first; all
   pairs that links do not join by then follow, in salted blocks, where sketches are compared.
3. Pairs that agree in six minima (at J = 0.7 all but one in ten thousand do) are compared by sketches, 1,024 bits of a
   line's distinct 5-shingles, which lose no similar pair (see likely). What is left is verified by the exact Jaccard
   similarity of the 5-shingles, at 0.8: each line with one neighbour first, then the pairs that no links join.
4. Distributed union-find joins the verified pairs; the first line of a component by (document, text, line number) stays.

Lines are named by 128 bits of hashes, in pairs by 64 of them; shingles are compared by 64-bit hashes.
"""

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isopleth.llm.common import cut, fresh_name, named, new_folder, shuffle_partitions, text_or_empty, written
from isopleth.llm.components import components

SHINGLE, GRAM, MINIMA, SAMPLE = 5, 8, 20, 160
#: Characters up to which a line is signed by its shingles too.
SHORT = 16
#: Twenty bands of three minima: each minimum is in three, two bands share one at most.
BANDS = [(x, (x + 1) % MINIMA, (x + 4) % MINIMA) for x in range(MINIMA)]
#: Bands of four minima for the lines of large buckets.
DEEP = [tuple(sorted(random.Random(number).sample(range(MINIMA), 4))) for number in range(36)]
POSITIVE = (1 << 63) - 1
#: Minima in which a pair must agree to be compared; at J = 0.7 of 8-grams one pair in ten thousand agrees in fewer.
AGREE = 6
#: Minima of a line up to which one in a band is enough for a key.
FEW = 10
#: Lines of a bucket that all meet each other; of a larger one, lines that are compared as one block.
SMALL, BLOCK = 32, 512
#: Numbers of 64 bits in a line's sketch, and shingles that a task makes sketches of.
WORDS, GRAMS = 16, 1_000_000
#: Bytes that may be broadcast; beyond it a shuffled join is taken.
BROADCAST_BYTES = 16 << 20
#: Blanks around a line, besides the line feeds that end it.
BLANKS = " \t\r\x0b\x0c"


def _maybe_broadcast(df: DataFrame, row_bytes: int = 16) -> DataFrame:
    """df must be cut, so that counting it is cheap."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def norm_of(line: str = "line") -> Column:
    """A line in lower case, without blanks around it."""
    return F.lower(F.btrim(F.col(line), F.lit(BLANKS)))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, version (a hash of the whole text), pos, norm, h1, h2 of each line with more than blanks, of documents with an identifier."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.posexplode(F.split(text_or_empty(), "\n")).alias("pos", "line")).where("doc_id is not null")
    rows = rows.select("doc_id", "version", "pos", norm_of().alias("norm")).where("norm <> ''")
    return rows.withColumns({"h1": F.xxhash64("norm"), "h2": F.xxhash64(F.lit(1), F.col("norm"))})


def minima_of(lines: DataFrame, sampled: bool) -> DataFrame:
    """One row per distinct line (h1, h2): the least doc_id, copies, n (its 8-grams), held (how many minima), minima m0 to m19; sampled: of a long line, of hashes below its bound alone.

    A line of up to SHORT characters, and any that is not sampled, has a second row, of its shingles (small).
    """
    names = ("h1", "h2", "doc_id", "n")
    grams = lines.select("h1", "h2", "doc_id", F.encode("norm", "UTF-16BE").alias("units"))
    number = lambda size: F.greatest(F.lit(1), F.floor(F.length("units") / 2).cast("int") - (size - 1))
    second = F.when(F.length("units") <= 2 * SHORT, number(SHINGLE)).otherwise(0) if sampled else number(SHINGLE)
    grams = grams.withColumns({"n": number(GRAM), "second": second})
    grams = grams.select(*names, "units", F.explode(F.expr("sequence(0, n + second - 1)")).alias("i"))
    most = f"if(n <= {SAMPLE}, {POSITIVE}L, ({POSITIVE}L div n) * {SAMPLE})" if sampled else f"{POSITIVE}L"
    piece = f"substring(units, 2 * if(i < n, i, i - n) + 1, if(i < n, {2 * GRAM}, {2 * SHINGLE}))"
    grams = grams.select(*names, "i", F.expr(f"xxhash64({piece}) & {POSITIVE}L").alias("h")).where(f"i = 0 or h <= {most}")
    grams = grams.select(*names, F.expr("i >= n").alias("small"), F.expr("if(i = 0, 1L, 0L)").alias("one"), F.expr("cast(shiftright(h, 32) as int)").alias("h"), F.expr(f"if(h <= {most}, cast(h % {MINIMA} as int), -1)").alias("j"))
    return grams.groupBy("h1", "h2", "small").agg(
        F.min("doc_id").alias("doc_id"), F.sum("one").alias("copies"), F.max("n").alias("n"), F.expr("bit_count(bit_or(if(j < 0, 0, shiftleft(1, j))))").alias("held"), *(F.min(F.expr(f"if(j = {j}, h, null)")).alias(f"m{j}") for j in range(MINIMA))
    )


def signatures(lines: DataFrame) -> DataFrame:
    """Rows of distinct lines: p (a line's name in pairs), h2, small (minima of shingles), doc_id, copies, minima m0 to m19, thin.

    A long line that lacks a minimum, and one of few minima, as one of few distinct 8-grams, is thin: it is still to be signed again.
    """
    lacks = (F.col("n") > SAMPLE) & (F.col("held") < MINIMA) | (F.col("n") > SHORT - GRAM + 1) & (F.col("held") <= FEW)
    return minima_of(lines, True).select(F.col("h1").alias("p"), "h2", "small", "doc_id", "copies", (~F.col("small") & lacks).alias("thin"), *(f"m{j}" for j in range(MINIMA)))


def thin_signatures(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """p, h2, small, doc_id, copies and the minima of thin lines over all of their 8-grams, and of few distinct shingles over these, from the first document of each."""
    thin = cut(signed.where("thin").select("p", "h2", "doc_id", "copies"))
    homes = _maybe_broadcast(cut(thin.select(F.col("doc_id").alias("home")).distinct()))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(homes, F.col("doc_id") == F.col("home"), "left_semi")
    names = _maybe_broadcast(thin.select("p", "h2", "doc_id"), 32)
    lines = lines_of(some).where(F.octet_length("norm") > SHORT).withColumnRenamed("h1", "p").join(names, ["p", "h2", "doc_id"], "left_semi").withColumnRenamed("p", "h1")
    again = minima_of(lines, False).where(f"not small or held <= {FEW}").select(F.col("h1").alias("p"), "h2", "small", *(f"m{j}" for j in range(MINIMA)))
    return thin.join(again, ["p", "h2"]).select("p", "h2", "small", "doc_id", "copies", *(f"m{j}" for j in range(MINIMA)))


def keyed(signed: DataFrame, bands: list[tuple[int, ...]] = BANDS) -> DataFrame:
    """(p, key): the buckets of each line. Bands with one minimum count for lines of few minima alone."""
    there = lambda places: sum(F.col(f"m{j}").isNotNull().cast("int") for j in places)
    few = there(range(MINIMA)) <= FEW  # without a name of its own: the optimizer would rewrite that by each of its minima
    keys = [
        F.when((there(band) >= 2) | few & (there(band) == 1), F.xxhash64(F.lit(number), *(F.coalesce(f"m{j}", F.lit(-1)) for j in band)))
        for number, band in enumerate(bands)
    ]
    return signed.select("p", F.explode(F.array_compact(F.array(*keys))).alias("key"))


def buckets_of(rows: DataFrame) -> DataFrame:
    """key, n, top (the bucket's first line), end, drawn (a line by the bucket's own order), mixed (all of its lines by exclusive or) of each bucket of several lines.

    Rows are dealt by key before they are counted: hardly any key repeats within a task, and two numbers a row are a
    third less to write than sums of one row each.
    """
    turned = F.expr("p ^ key")
    dealt = rows.select("p", "key").repartition("key")
    buckets = dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("p").alias("top"), F.max("p").alias("end"), F.min(turned).alias("drawn"), F.bit_xor("p").alias("mixed")).where("n > 1")
    return cut(buckets.select("key", "n", "top", "end", F.expr("drawn ^ key").alias("drawn"), "mixed"))


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where("p <> q").select(F.greatest("p", "q").alias("p"), F.least("p", "q").alias("q"))


def small_pairs(rows: DataFrame, buckets: DataFrame, small: int = SMALL) -> DataFrame:
    """(p, q), p > q: all pairs of the buckets of up to `small` lines; a row per bucket that they share."""
    two = buckets.where("n <= 3").select(F.col("end").alias("p"), F.col("top").alias("q"))
    third = F.expr("mixed ^ top ^ end")
    three = buckets.where("n = 3").select(F.explode(F.array("top", "end")).alias("p"), third.alias("q"))
    some = cut(buckets.where(f"n between 4 and {small}").select("key"))
    members = cut(rows.join(_maybe_broadcast(some), "key"))
    return _pairs(two.union(three).union(members.alias("a").join(members.alias("b"), F.expr("a.key = b.key and a.p > b.p")).select("a.p", F.col("b.p").alias("q"))))


def large_members(rows: DataFrame, buckets: DataFrame, small: int = SMALL) -> DataFrame:
    """p, key, top, drawn of the lines of larger buckets."""
    large = cut(buckets.where(f"n > {small}").select("key", "top", "drawn"))
    return cut(rows.join(_maybe_broadcast(large, 32), "key").select("p", "key", "top", "drawn"))


def hub_pairs(members: DataFrame) -> DataFrame:
    """(p, q), p > q: each line of a large bucket with its two hubs."""
    return _pairs(members.select("p", F.explode(F.array("top", "drawn")).alias("q"))).distinct()


def likely() -> Column:
    """Whether sketches x and y allow a Jaccard similarity of 0.8.

    A bit can differ only where a shingle falls that one line alone has, and of these similar lines have at most a ninth
    of the sum of their distinct shingles, so no similar pair is lost.
    """
    return F.expr(f"9 * ({' + '.join(f'bit_count(xw{k} ^ yw{k})' for k in range(WORDS))}) <= xn + yn")


def other_pairs(members: DataFrame, labels: DataFrame, done: DataFrame, block: int = BLOCK, sketched: DataFrame | None = None) -> DataFrame:
    """(p, q), p > q: all other pairs of large buckets but those that links join already. labels: p, component; done: pairs compared.

    A bucket's lines are dealt into blocks, and each pair of blocks is a group of its own, so none has more than about
    block * block pairs. sketched: sketches of the lines; pairs that these show to be unlike are left out as blocks meet.
    """
    left = members.where("p <> top and p <> drawn").select("p", "key")
    left = cut(left.join(_maybe_broadcast(labels), "p", "left").select("p", "key", F.coalesce("component", "p").alias("c")))
    open_ = left.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    open_ = cut(open_.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    dealt = left.join(_maybe_broadcast(open_), "key")
    if sketched is not None:
        dealt = dealt.join(_maybe_broadcast(cut(sketched.join(_maybe_broadcast(cut(dealt.select("p").distinct())), "p", "left_semi")), 8 * WORDS + 16), "p")
    dealt = dealt.withColumn("own", F.expr("cast(pmod(xxhash64(p), blocks) as int)"))
    held = ["n", *(f"w{k}" for k in range(WORDS))] if sketched is not None else []
    one = dealt.select("key", F.col("own").alias("i"), F.explode(F.expr("sequence(own, blocks - 1)")).alias("j"), "p", "c", *(F.col(c).alias(f"x{c}") for c in held))
    two = dealt.select("key", F.explode(F.expr("sequence(0, own)")).alias("i"), F.col("own").alias("j"), F.col("p").alias("q"), F.col("c").alias("d"), *(F.col(c).alias(f"y{c}") for c in held))
    same = F.expr("one.key = two.key and one.i = two.i and one.j = two.j and c <> d and (one.i < one.j or p > q)")
    pairs = one.alias("one").join(two.alias("two"), same & likely() if held else same)
    return _pairs(pairs.select("p", "q")).distinct().join(done, ["p", "q"], "left_anti")


def ends_of(pairs: DataFrame) -> DataFrame:
    """p: the lines of pairs."""
    return cut(pairs.select(F.explode(F.array("p", "q")).alias("p")).distinct())


def alike(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The distinct pairs that agree in at least AGREE minima, as six bits of each tell: agreeing minima are never taken for others."""
    parts = [" | ".join(f"shiftleft(cast(coalesce(hash(m{j}) & 63, 0) as bigint), {6 * (j - at)})" for j in range(at, at + 10)) for at in range(0, MINIMA, 10)]
    own, other = ([F.expr(part).alias(f"{name}{i}") for i, part in enumerate(parts)] for name in "st")
    pairs = cut(pairs.distinct())
    signed = signed.join(_maybe_broadcast(ends_of(pairs)), "p", "left_semi")
    both = pairs.join(signed.select("p", "small", *own), "p").join(signed.select(F.col("p").alias("q"), "small", *other), ["q", "small"])
    agree = " + ".join(f"if((shiftright(s{j // 10} ^ t{j // 10}, {6 * (j % 10)}) & 63) = 0, 1, 0)" for j in range(MINIMA))
    return both.where(f"{agree} >= {AGREE}").select("p", "q").distinct()


def shingle_hashes(norm: str) -> Column:
    """The hashes of the distinct character shingles of a line; a shorter line is its own."""
    at = lambda units, i: F.xxhash64(F.substring(units, 4 * i + 1, F.lit(4 * SHINGLE)))
    last = F.greatest(F.char_length(norm) - SHINGLE, F.lit(0))
    # the variable of a transform of one element is the line in UTF-32, encoded once
    return F.element_at(F.transform(F.array(F.encode(norm, "UTF-32")), lambda units: F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: at(units, i)))), 1)


def texts_of(docs: DataFrame, signed: DataFrame, ends: DataFrame) -> DataFrame:
    """p, norm of lines, in the shared folder. A line's text comes from its first document."""
    homes = cut(signed.where("not small").select("p", "doc_id").join(_maybe_broadcast(ends), "p", "left_semi"))
    texts = lines_of(docs).select(F.col("h1").alias("p"), "doc_id", "norm").join(_maybe_broadcast(homes), ["p", "doc_id"], "left_semi")
    return written(texts.select("p", "norm").dropDuplicates(["p"]), "texts")


def sketches(texts: DataFrame) -> DataFrame:
    """p, n (distinct shingles), w0 and on: bits that tell of how many of a line's distinct shingles fall on them, whether that is odd."""
    # of so many tasks that each one's shingles fit its memory
    total = texts.agg(F.sum(F.char_length("norm"))).first()[0] or 0
    grams = texts.repartition(max(shuffle_partitions(texts.sparkSession), total // GRAMS), "p").select("p", F.encode("norm", "UTF-32").alias("units"), F.greatest(F.lit(0), F.char_length("norm") - SHINGLE).alias("last"))
    grams = grams.select("p", "units", F.explode(F.sequence(F.lit(0), "last")).alias("i")).select("p", F.expr(f"xxhash64(substring(units, 4 * i + 1, {4 * SHINGLE}))").alias("h")).distinct()
    grams = grams.select("p", F.expr(f"cast(h & {WORDS - 1} as int)").alias("w"), F.expr("shiftleft(1L, cast(shiftright(h, 8) & 63 as int))").alias("bit"))
    return written(grams.groupBy("p").agg(F.count("*").alias("n"), *(F.expr(f"bit_xor(if(w = {k}, bit, 0L))").alias(f"w{k}") for k in range(WORDS))), "sketches")


def likely_pairs(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """The pairs that their sketches allow to be similar."""
    held = ["n", *(f"w{k}" for k in range(WORDS))]
    one, two = (sketched.select(F.col("p").alias(end), *(F.col(c).alias(f"{side}{c}") for c in held)) for end, side in (("p", "x"), ("q", "y")))
    return pairs.join(one, "p").join(two, "q").where(likely()).select("p", "q")


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): the pairs of lines whose Jaccard similarity is at least 0.8."""
    both = pairs.join(texts.withColumnRenamed("norm", "x"), "p").join(texts.select(F.col("p").alias("q"), F.col("norm").alias("y")), "q")
    # exists() over one struct computes either array once; common / (all - common) >= 0.8
    sets = F.array(F.struct(shingle_hashes("x").alias("s"), shingle_hashes("y").alias("t")))
    near = F.exists(sets, lambda v: 18 * F.size(F.array_intersect(v["s"], v["t"])) >= 8 * (F.size(v["s"]) + F.size(v["t"])))
    return both.where(near).select(F.col("p").alias("a"), F.col("q").alias("b"))


def labels_of(links: DataFrame) -> DataFrame:
    """p, component of the lines that have links."""
    return cut(components(links).select(F.col("node").alias("p"), "component"))


def unjoined(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs whose ends no links join."""
    labels = labels_of(links)
    label = lambda end: _maybe_broadcast(labels.select(F.col("p").alias(end), F.col("component").alias(f"{end}_")))
    return pairs.join(label("p"), "p", "left").join(label("q"), "q", "left").where("p_ is null or q_ is null or p_ <> q_").select("p", "q")


def near_links(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """(a, b): links between near-equal distinct lines; pairs that other links join already aren't all compared."""
    rows = keyed(signed)
    buckets = buckets_of(rows)
    large = cut(large_members(rows, buckets).select("p").distinct())
    deep = keyed(signed.join(_maybe_broadcast(large), "p", "left_semi"), DEEP)
    deep_buckets = buckets_of(deep)
    members = large_members(deep, deep_buckets)
    first = small_pairs(rows, buckets).union(small_pairs(deep, deep_buckets)).union(hub_pairs(members))
    pairs = cut(alike(first, signed))
    texts = texts_of(docs, signed, cut(ends_of(pairs).union(members.select("p")).distinct()))
    sketched = sketches(texts)
    pairs = cut(likely_pairs(pairs, sketched))
    # each line with its first likely one, the pairs that those links do not join, and what is not joined then
    least = cut(pairs.groupBy("p").agg(F.min("q").alias("q")))
    links = cut(verified(texts, least))
    links = links.union(cut(verified(texts, cut(unjoined(pairs, links).join(least, ["p", "q"], "left_anti")))))
    if members.isEmpty():
        return links
    others = cut(other_pairs(members, labels_of(links), pairs, sketched=sketched))
    return links if others.isEmpty() else links.union(cut(verified(texts, others)))


def gone_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, version, gone): for each text with lines to drop, their places in it."""
    spark, path = docs.sparkSession, new_folder(docs.sparkSession, "signatures")
    signatures(lines_of(docs)).write.parquet(path)
    signed = spark.read.parquet(path)
    signed = signed.where("not thin").drop("thin").unionByName(cut(thin_signatures(docs, signed)))
    found = cut(components(near_links(docs, signed)).select(F.col("node").alias("p"), "component"))
    # lines that are copied or joined to others, by the name of what they are one of
    near = signed.where("not small").select("p", "h2", "copies").join(_maybe_broadcast(found), "p", "left").where("copies > 1 or component is not null")
    near = cut(near.select("p", "h2", F.coalesce("component", "p").alias("c"), F.when(F.col("component").isNull(), F.col("h2")).otherwise(F.lit(0)).alias("c2")))
    places = lines_of(docs).select("doc_id", "version", "pos", F.col("h1").alias("p"), "h2").join(_maybe_broadcast(near, 40), ["p", "h2"]).select("doc_id", "version", "pos", "c", "c2")
    places = cut(places)
    first = cut(places.groupBy("c", "c2").agg(F.min(F.struct("doc_id", "version", "pos")).alias("first")))
    gone = places.join(_maybe_broadcast(first, 64), ["c", "c2"]).where(F.struct("doc_id", "version", "pos") != F.col("first"))
    return gone.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("gone"))


def later_copies(docs: DataFrame, mark: str) -> DataFrame:
    """docs with a column that is true of rows with the identifier and the text of an earlier row; of such rows any one is first."""
    ids = cut(docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(f"{mark}id")))
    if ids.isEmpty():
        return docs.withColumn(mark, F.lit(False))
    ids, number, version, least = _maybe_broadcast(ids), f"{mark}number", f"{mark}version", f"{mark}least"
    same = docs["doc_id"].cast("long") == F.col(f"{mark}id")
    # numbered rows are written first, so that the numbers stay
    some = cut(docs.join(ids, same, "left_semi").withColumns({number: F.monotonically_increasing_id(), version: F.xxhash64("text"), f"{mark}doc": F.col("doc_id").cast("long")}))
    firsts = some.groupBy(f"{mark}doc", version).agg(F.min(number).alias(least))
    some = some.join(firsts, [f"{mark}doc", version]).withColumn(mark, F.col(number) > F.col(least)).select(*map(named, docs.columns), mark)
    return docs.join(ids, same, "left_anti").withColumn(mark, F.lit(False)).select(*map(named, docs.columns), mark).union(some)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text without the lines that repeat, or nearly repeat, an earlier line of any document; n_lines, n_kept.

    Earlier is by doc_id, then by a hash of the text (of rows with the same identifier), then by line number. Lines of
    blanks alone always stay and are not counted. A missing text stays missing; a document without an identifier is
    left as it is; of rows with the same identifier and text one keeps its lines; an empty table gives no rows; other
    columns stay as they are, whatever their names.
    """
    name = fresh_name(docs, "line_")
    gone = cut(gone_lines(docs).select(F.col("doc_id").alias(f"{name}doc"), F.col("version").alias(f"{name}version"), F.col("gone").alias(f"{name}gone")))
    rows, total = gone.agg(F.count("*"), F.coalesce(F.sum(F.size(f"{name}gone")), F.lit(0))).first()
    few = 64 * rows + 4 * total <= BROADCAST_BYTES
    marked = later_copies(docs, f"{name}copy")
    there = (marked["doc_id"].cast("long") == gone[f"{name}doc"]) & (F.xxhash64(marked["text"]) == gone[f"{name}version"])
    joined = marked.join(F.broadcast(gone) if few else gone, there, "left")
    blank = lambda line: F.btrim(line, F.lit(BLANKS)) == ""
    lines, dropped = F.split("text", "\n"), F.col(f"{name}gone")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped), lambda i: F.element_at(lines, i + 1))
    left = F.when(F.col(f"{name}copy"), F.array_join(F.filter(lines, blank), "\n")).when(dropped.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    count = F.coalesce(F.size(F.filter(lines, lambda line: ~blank(line))), F.lit(0))
    count = F.when(F.col("text").isNull(), 0).otherwise(count)
    columns = [c for c in docs.columns if c not in ("text", "n_lines", "n_kept")]
    return joined.select(
        *map(named, columns), left.alias("text"), count.alias("n_lines"),
        F.when(F.col(f"{name}copy"), 0).otherwise(count - F.coalesce(F.size(dropped), F.lit(0))).alias("n_kept"),
    )
