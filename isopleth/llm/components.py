"""Connected components by distributed union-find, in DataFrame operations alone."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isopleth.llm.common import cut


#: Links up to which the least neighbours are broadcast; beyond it they come by a shuffled join.
BROADCAST_ROWS = 250_000
#: Tasks that hold so few links; more would write more files than rows.
FEW_TASKS = 8


def _hooked(pairs: DataFrame, smaller_only: bool, few: bool) -> DataFrame:
    """Each node's neighbours hang on the least of the node and its neighbours.

    smaller_only: a node counts smaller neighbours alone and hangs itself too (small star); otherwise the larger
    neighbours hang (large star). The least is found by a pre-aggregated minimum and joined back, so a node with very
    many links is no group of one task.
    """
    if smaller_only:
        near = pairs.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    else:
        near = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = near.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    hung = near.join(F.broadcast(least) if few else least, "node")
    if smaller_only:
        hung = hung.select(F.col("other").alias("a"), F.col("least").alias("b")).union(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    else:
        hung = hung.where("other > node").select(F.col("other").alias("a"), F.col("least").alias("b"))
    hung = hung.where("a <> b").distinct()
    return hung.coalesce(FEW_TASKS) if few else hung


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links; component is the smallest node reachable.

    Large and small stars take turns (Kiveris et al., Connected Components in MapReduce and Beyond) until nothing
    changes, which takes about the logarithm of the longest path's length in rounds. Every round's links, never more
    than the first's, are written to the shared folder. Links with a missing end and links of a node to itself add
    no link; repeated ones count once; no links give no rows.
    """
    pairs = cut(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a is not null and b is not null and a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")).distinct())
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(pairs)
    if before[0] <= BROADCAST_ROWS:
        pairs = pairs.coalesce(FEW_TASKS)
    while before[0]:
        few = before[0] <= BROADCAST_ROWS
        pairs = cut(_hooked(_hooked(pairs, False, few), True, few))
        after = mark(pairs)
        if tuple(after) == tuple(before):
            break
        before = after
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.select(F.col("b"), F.col("b")).distinct())
