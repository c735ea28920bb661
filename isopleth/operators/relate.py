"""Joins and windows of the bookkeeping: latest rows, resume sets, overrides, ranges, forward fill, sliding counts."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isopleth.sources.scratch import folder


def latest_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key that is last by the given columns."""
    return df.groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), F.struct(*order)).alias("row")).select(key, "row.*")


def pending(entries: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    """Entries not yet completed."""
    return entries.join(completed.select(key), key, "left_anti")


def already_full(entries: DataFrame, chunks: DataFrame, key: str, least: int = 10) -> DataFrame:
    """Entries that have at least `least` chunks."""
    return entries.join(chunks.groupBy(key).count().where(F.col("count") >= least), key, "left_semi")


def fan_out(left: DataFrame, right: DataFrame, left_key: str, right_key: str, each: int = 4_000_000, most: int = 1 << 18, parts: int = 8) -> DataFrame:
    """Inner join on keys that many rows of both sides have: all pairs, dealt over tasks however few keys there are.

    Left rows are dealt over tasks of about four times `each` pairs, and the right side is broadcast in up to `parts`
    parts of about `most` rows that meet all left rows, so what is shuffled are the left rows alone, whatever the number
    of pairs. A larger right side comes by a shuffled join (see dealt_cells).
    """
    n_left, n_right = (df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias(name)) for df, key, name in ((left, left_key, "_l"), (right, right_key, "_r")))
    pairs, rows, n = n_left.join(n_right, "_key").agg(F.sum(F.col("_l").cast("double") * F.col("_r")), F.sum("_r"), F.sum("_l")).first()
    several = -(-(rows or 0) // most)
    part = F.pmod(F.xxhash64(*right.columns), F.lit(several)) if several > 1 else F.lit(0)
    if several > parts or several > 1 and right.groupBy(part.alias("_part")).count().agg(F.max("count")).first()[0] > 2 * most:
        return dealt_cells(left, right, left_key, right_key, n_left, n_right, each)
    dealt = left.where(F.col(left_key).isNotNull()).repartition(int(min(n or 1, 1 + (pairs or 0) // (4 * each))))
    joined = None
    for number in range(max(1, several)):
        some = right.where(F.col(right_key).isNotNull() & (part == number))
        found = dealt.join(F.broadcast(some), dealt[left_key] == some[right_key])
        joined = joined.union(found) if joined is not None else found
    return joined


def dealt_cells(left: DataFrame, right: DataFrame, left_key: str, right_key: str, n_left: DataFrame, n_right: DataFrame, each: int) -> DataFrame:
    """The same by a shuffled join. n_left, n_right: rows of each _key, as _l and _r.

    A key's left rows are dealt into cells of about `each` pairs, and its right rows go to each cell of the key. A task
    gets a few cells and holds one key's right rows at a time of each, so none makes a key's pairs alone.
    """
    cells = n_left.join(n_right, "_key").select("_key", F.least("_l", F.ceil(F.col("_l").cast("double") * F.col("_r") / each)).cast("int").alias("_cells"))
    parts = 1 + (cells.agg(F.sum("_cells")).first()[0] or 0) // 4
    one = left.join(cells, F.col(left_key) == F.col("_key")).withColumn("_cell", F.pmod(F.xxhash64(*left.columns), "_cells").cast("int")).drop("_cells").repartition(parts, "_key", "_cell")
    other = right.join(cells.withColumnRenamed("_key", "_other"), F.col(right_key) == F.col("_other")).withColumn("_n", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1))).drop("_cells")
    joined = one.join(other.hint("shuffle_hash"), (F.col("_key") == F.col("_other")) & (F.col("_cell") == F.col("_n")))
    return joined.drop("_key", "_cell", "_other", "_n")


def first_found(entries: DataFrame, lookups: list[tuple[DataFrame, str, str]], fallback: Column, name: str) -> DataFrame:
    """Prioritized lookup: the first of several left joins that has a value, else the fallback. lookups: (frame, key, value column)."""
    found, tries = entries, []
    for i, (frame, key, value) in enumerate(lookups):
        found = found.join(frame.select(F.col(key), F.col(value).alias(f"_{i}")), key, "left")
        tries.append(F.nullif(F.trim(F.col(f"_{i}")), F.lit("")))
    return found.select(*entries.columns, F.coalesce(*tries, fallback).alias(name))


def year_overlap(start: Column, end: Column, first: int, last: int) -> Column:
    """Whether [start, end], compared by ISO date prefixes, meets the years; missing or empty ends are open."""
    low = F.coalesce(F.nullif(F.substring(start, 1, 10), F.lit("")), F.lit("0000-01-01"))
    high = F.coalesce(F.nullif(F.substring(end, 1, 10), F.lit("")), F.lit("9999-12-31"))
    return (low <= f"{last:04d}-12-31") & (high >= f"{first:04d}-01-01")


def cited(rows: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that agree with some cited pair."""
    return rows.join(pairs.select(*keys).distinct(), keys, "left_semi")


def cited_datasets(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows that fit a cited pair: by its dataset name where it has one, else by its source id, and by its variable where it has one.

    rows and pairs: dataset_name, source_id, variable. A pair that says nothing is no pair.
    """
    given = pairs.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) for c in ("dataset_name", "source_id", "variable")))
    given = given.withColumn("source_id", F.when(F.col("dataset_name").isNull(), F.col("source_id"))).distinct()
    found = None
    for keys in (["dataset_name", "variable"], ["dataset_name"], ["source_id", "variable"], ["source_id"], ["variable"]):
        own = given.where(F.expr(" and ".join(f"{c} is {'not ' if c in keys else ''}null" for c in ("dataset_name", "source_id", "variable"))))
        marked = own.select(*keys).withColumn("_" + "_".join(keys), F.lit(True))
        rows = rows.join(marked, keys, "left")
        hit = F.coalesce(F.col("_" + "_".join(keys)), F.lit(False))
        found = hit if found is None else found | hit
    kept = rows.where(found)
    return kept.select(*(c for c in kept.columns if not c.startswith(("_dataset_name", "_source_id", "_variable"))))


def short_circuit(rows: DataFrame, url: str, order: list[str], outcome: DataFrame) -> DataFrame:
    """Rows with what became of their URL: the first row of a URL is done, the others take over its status; adds is_first and status.

    outcome: a frame of the URL and its status, of the rows that were done; a URL without one is pending.
    """
    place = F.row_number().over(Window.partitionBy(url).orderBy(*order))
    known = outcome.select(F.col(url).alias("_u"), F.col("status"))
    return rows.withColumn("is_first", place == 1).join(known, F.col(url) == F.col("_u"), "left").withColumn("status", F.coalesce("status", F.lit("pending"))).drop("_u")


def forward_fill(df: DataFrame, partition: str, order: list[str], value: str, name: str) -> DataFrame:
    """The last value that isn't missing up to each row."""
    frame = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(frame))


def sliding_count(df: DataFrame, key: str, time: str, seconds: int, most: int) -> DataFrame:
    """Per row the key's rows in the last `seconds`, up to and including it, whether they reach `most`, and for how long it must wait."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    frame = Window.partitionBy(key).orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    out = df.withColumn("_at", at).withColumn("n_recent", F.count("*").over(frame)).withColumn("_oldest", F.min("_at").over(frame))
    wait = F.ceil((F.col("_oldest") + seconds * 1_000_000 - F.col("_at")) / 1_000_000).cast("long")
    blocked = F.col("n_recent") >= most
    return out.withColumn("blocked", blocked).withColumn("retry_after", F.when(blocked, wait)).drop("_at", "_oldest")


def suffix_match(host: Column, domains: list[tuple[str, str]]) -> Column:
    """The name of the first domain that a host equals or is below."""
    found = F.lit(None).cast("string")
    for domain, name in reversed(domains):
        found = F.when((host == domain) | host.endswith("." + domain), name).otherwise(found)
    return found


def in_boxes(lat: Column, lon: Column, boxes: list[tuple]) -> Column:
    """The description of the first box (south, north, west, east, description) that holds a point."""
    found = F.lit(None).cast("string")
    for south, north, west, east, text in reversed(boxes):
        found = F.when(lat.between(south, north) & lon.between(west, east), text).otherwise(found)
    return found


def best_fuzzy(names: DataFrame, catalog: DataFrame, least: float = 0.4, block: int = 2000) -> DataFrame:
    """The best catalog name for each name: name, match, score (ties by match).

    The score is shared words over the larger number of words, at least 0.7 where one name contains the other, 1 where they
    are equal. The catalog is laid out in blocks of names; each name meets each block once, as one array, and hands
    on its best of the block, so the plan does not grow with the catalog and no pairs are formed.
    """
    entry = catalog.select(F.col(catalog.columns[0]).alias("m")).where("m is not null").distinct()
    blocks = max(1, -(-entry.count() // block))
    words_of = lambda c: F.array_distinct(F.split(c, r"\s+"))
    parts = entry.select("m", F.lower(F.trim("m")).alias("e")).select(F.struct("m", "e", words_of(F.col("e")).alias("w")).alias("x"), F.pmod(F.xxhash64("m"), F.lit(blocks)).alias("b"))
    parts = parts.groupBy("b").agg(F.collect_list("x").alias("entries"))
    column = names.columns[0]
    rows = names.where(F.col(column).isNotNull()).select(F.col(column).alias("name")).distinct()
    rows = rows.select("name", F.lower(F.trim("name")).alias("low")).withColumn("words", words_of(F.col("low"))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = rows.join(F.broadcast(parts) if blocks <= 10 else parts, "b")

    def scored(x: Column) -> Column:
        ratio = F.size(F.array_intersect(F.col("words"), x["w"])) / F.greatest(F.size("words"), F.size(x["w"]))
        inside = F.contains(x["e"], F.col("low")) | F.contains(F.col("low"), x["e"])
        value = F.when(F.col("low") == x["e"], 1.0).when(inside, F.greatest(ratio, F.lit(0.7))).otherwise(ratio)
        return F.struct((-F.round(value, 6)).alias("s"), x["m"].alias("m"))

    best = met.select("name", F.array_min(F.transform("entries", scored)).alias("b")).groupBy("name").agg(F.min("b").alias("b")).where(F.col("b.s") <= -least)
    return names.select(F.col(column).alias("name")).join(best, "name").select("name", F.col("b.m").alias("match"), (-F.col("b.s")).alias("score"))


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Rows with their number from 0 within their group, by the given columns.

    Rows are sorted over all tasks and written with their place; what a task has of a group is numbered on from the
    counts of the tasks before it. So a group may be of any size. Rows that agree in group and order are numbered in
    no certain order.
    """
    spark, path = df.sparkSession, folder(df.sparkSession, "numbered")
    df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("_task", F.shiftright("_at", 33))
    starts = placed.groupBy(F.struct(group).alias("_group"), "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_group").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("_group", "_task", (before - F.col("_first")).alias("_shift"))
    # a group is compared as a struct, which a missing one equals too
    return placed.withColumn("_group", F.struct(group)).join(starts, ["_group", "_task"]).withColumn(name, F.col("_at") + F.col("_shift")).select(*df.columns, name)


def _contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs (a, b) whose texts contain each other, a's in b's: of inner (a, a_text) and outer (b, b_text), texts not empty.

    Each outer text is listed under its runs of one, two and three characters; an inner text looks into the shortest
    list among those of its own runs (of three, or of its length), and into none if one of them is empty.
    """
    runs = lambda t, k: f"if(char_length({t}) < {k}, array(), transform(sequence(1, char_length({t}) - {k} + 1), i -> substring({t}, i, {k})))"
    lists = outer.select("b", "b_text", F.explode(F.expr(f"array_distinct(concat({', '.join(runs('b_text', k) for k in (1, 2, 3))}))")).alias("run"))
    lengths = lists.groupBy("run").agg(F.count("*").alias("n"))
    own = F.expr(f"array_distinct(case char_length(a_text) when 1 then {runs('a_text', 1)} when 2 then {runs('a_text', 2)} else {runs('a_text', 3)} end)")
    shortest = inner.select("a", "a_text", F.explode(own).alias("run")).join(lengths, "run", "left").groupBy("a", "a_text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("s"))
    return shortest.where("s.n > 0").select("a", "a_text", F.col("s.run").alias("run")).join(lists, "run").where(F.contains("b_text", "a_text")).select("a", "b")


def fuzzy_candidates(names: DataFrame, catalog: DataFrame, least: float = 0.4) -> DataFrame:
    """Pairs (name, match) that may score `least` by best_fuzzy, from inverted lists; each pair once.

    Sharing enough words: words are ordered by how many catalog names have them, rare ones first. Of n words at least
    least * n must be shared, so two names share one of their first n - that + 1, and only those are listed and looked
    up, for names of fitting sizes. Containing: by lists of character runs, in both directions (see _contained). A blank
    name is contained in all: it meets the first of the catalog, and a blank catalog name meets all names.
    """
    clean = lambda df, c, a: df.select(F.col(c).alias(a)).where(f"{a} is not null").distinct().withColumn(f"{a}_text", F.lower(F.trim(a)))
    left, right = clean(names, names.columns[0], "a"), clean(catalog, catalog.columns[0], "b")
    words = lambda df, a: df.select(a, F.array_distinct(F.split(f"{a}_text", r"\s+")).alias("words")).select(a, F.size("words").alias("n"), F.explode("words").alias("word"))
    known = words(right, "b").groupBy("word").agg(F.count("*").alias("rarity"))

    def first(df: DataFrame, a: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("rarity", F.lit(0)).alias("r"), "word")))
        rows = words(df, a).join(known, "word", "left").groupBy(a, "n").agg(ordered.alias("ordered"))
        most = F.col("n") - F.greatest(F.ceil(F.lit(least) * F.col("n") - 1e-9), F.lit(1)) + 1
        return rows.select(a, F.col("n").alias(f"{a}_n"), F.explode(F.slice("ordered", F.lit(1), most.cast("int"))).alias("o")).select(a, f"{a}_n", F.col("o.word").alias("word"))

    shared = first(left, "a").join(first(right, "b"), "word").where(F.least("a_n", "b_n") >= F.lit(least) * F.greatest("a_n", "b_n") - 1e-9).select("a", "b")
    texts, entries = left.where("a_text <> ''"), right.where("b_text <> ''")
    inside = _contained(texts, entries)
    around = _contained(entries.toDF("a", "a_text"), texts.toDF("b", "b_text")).select(F.col("b").alias("a"), F.col("a").alias("b"))
    one = lambda df: F.broadcast(df.agg(F.min("b").alias("b")).where("b is not null"))  # noqa: E731  one row
    blank = left.where("a_text = ''").select("a").crossJoin(one(right)).unionByName(left.select("a").crossJoin(one(right.where("b_text = ''"))))
    return shared.unionByName(inside).unionByName(around).unionByName(blank).distinct().select(F.col("a").alias("name"), F.col("b").alias("match"))


def best_fuzzy_indexed(names: DataFrame, catalog: DataFrame, least: float = 0.4) -> DataFrame:
    """best_fuzzy's rows, from the candidates of inverted lists alone. `least` is at most 0.7."""
    low, entry = F.lower(F.trim("name")), F.lower(F.trim("match"))
    own, other = (F.array_distinct(F.split(t, r"\s+")) for t in (low, entry))
    ratio = F.size(F.array_intersect(own, other)) / F.greatest(F.size(own), F.size(other))
    score = F.when(low == entry, 1.0).when(F.contains(entry, low) | F.contains(low, entry), F.greatest(ratio, F.lit(0.7))).otherwise(ratio)
    best = fuzzy_candidates(names, catalog, least).select("name", F.struct((-F.round(score, 6)).alias("s"), F.col("match").alias("m")).alias("b")).groupBy("name").agg(F.min("b").alias("b")).where(F.col("b.s") <= -least)
    return names.select(F.col(names.columns[0]).alias("name")).join(best, "name").select("name", F.col("b.m").alias("match"), (-F.col("b.s")).alias("score"))
