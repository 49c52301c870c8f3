"""Problem 3: per-key results where a few keys hold most rows.

Method: value-frequency compression. Rows are grouped by key *and* value
before they are grouped by key. The first grouping spreads a hot key over all
tasks (its values differ) and is combined before the shuffle; what is left are
weighted values, of which distinct counts, modes, totals and percentiles are
derived exactly. The second grouping is combined before its shuffle too, so
each task sends one row for each key however hot it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackloom.plans.durable import Rounds, cut


def compress(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value, weight)``: how often each value occurs for each key. A
    null value is a value of its own, of which no statistic but the row count
    takes notice; a null key is kept as a key."""
    return df.select(F.col(key).alias("key"), F.col(value).alias("value")).groupBy("key", "value").agg(F.count(F.lit(1)).alias("weight"))


def distinct_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, n_rows, n_distinct)``, exactly; null values are no value."""
    return compress(df, key, value).groupBy("key").agg(F.sum("weight").alias("n_rows"), F.count("value").alias("n_distinct"))


def mode_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, mode, mode_weight)``: the most frequent value, the smallest of
    equally frequent ones. Keys without a value have null."""
    # two steps that are both combined early: the largest weight, then the smallest value that has it
    weighted = compress(df, key, value)
    pair = F.when(F.col("value").isNotNull(), F.struct((-F.col("weight")).alias("w"), F.col("value").alias("v")))
    return weighted.groupBy("key").agg(F.min(pair).alias("m")).select("key", F.col("m.v").alias("mode"), (-F.col("m.w")).alias("mode_weight"))


def percentile_per_key(df: DataFrame, key: str, value: str, share: float, bins: int = 1024) -> DataFrame:
    """``(key, percentile)``: the smallest value with at least ``share`` of the
    key's non-null rows at or below it (the discrete percentile), exactly.

    The weighted values of each key are counted in ``bins`` equal ranges, and the range that holds the wanted rank is parted
    again between its own least and largest value until it holds at most ``bins`` different values; only those
    are ranked. So no task holds all values of a hot key, however they lie (an outlier costs one more round)."""
    weighted = cut(compress(df, key, value).where(F.col("value").isNotNull()))
    rank = F.greatest(F.ceil(F.sum("weight") * F.lit(share)), F.lit(1))
    tables = Rounds(df.sparkSession, "percentile")
    state = tables.write("state", weighted.groupBy("key").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.lit(0).cast("bigint").alias("before"), rank.alias("rank"), F.count(F.lit(1)).alias("kinds")))

    def inside(state: DataFrame) -> DataFrame:
        both = weighted.alias("w").join(state.alias("s"), F.col("w.key").eqNullSafe(F.col("s.key")) & F.col("w.value").between(F.col("s.lo"), F.col("s.hi")))
        return both.select("w.key", "w.value", "w.weight", "s.lo", "s.hi", "s.before", "s.rank")

    while (state.agg(F.max("kinds")).first()[0] or 0) > bins:
        width = (F.col("hi").cast("double") - F.col("lo").cast("double")) / bins
        bin_ = F.when(width > 0, F.least(F.floor((F.col("value").cast("double") - F.col("lo").cast("double")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
        counted = inside(state).groupBy("key", bin_.alias("bin")).agg(F.sum("weight").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.first("before").alias("before"), F.first("rank").alias("rank"), F.count(F.lit(1)).alias("kinds"))
        below = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most `bins` rows for each key
        chosen = counted.withColumn("before", F.col("before") + below).where("before < rank and before + n >= rank")
        state = tables.write("state", chosen.select("key", "lo", "hi", "before", "rank", "kinds"))
    upto = F.sum("weight").over(Window.partitionBy("key").orderBy("value"))
    return inside(state).withColumn("upto", F.col("before") + upto).where("upto >= rank").groupBy("key").agg(F.min("value").alias("percentile"))


def heavy_keys(per_key: DataFrame, measure: str, share: float = 0.05) -> DataFrame:
    """The rows of ``per_key`` whose ``measure`` is at least ``share`` of its
    total; a null key counts toward neither."""
    known = per_key.where(F.col("key").isNotNull())
    total = known.agg(F.sum(measure).alias("all_keys"))
    return known.join(F.broadcast(total)).where(F.col(measure) >= F.col("all_keys") * share).drop("all_keys")  # one row


def plain_sample(column):
    """A technical replicate's sample name without its suffix."""
    return F.regexp_replace(column, "(?s)-technical-replicate-.*$", "")


def reads_per_sample(reads: DataFrame) -> DataFrame:
    """``(key, n_rows, n_distinct)``: rows and distinct reads of each plain
    sample. Reads without a sample are left out."""
    named = reads.where(F.col("sample").isNotNull()).select(plain_sample(F.col("sample")).alias("sample"), "read_id")
    return distinct_per_key(named, "sample", "read_id")


def deep_clusters_per_sample(clusters: DataFrame, min_depth: int = 6) -> DataFrame:
    """``(key, n_clusters, n_deep)``: clusters of each sample and those whose
    size, summed over the distinct hit ranks, is at least ``min_depth``. A
    repeated hit counts once, a null size as nothing."""
    hits = clusters.where(F.col("sample").isNotNull()).groupBy("sample", "cluster_id", "hit_rank").agg(F.max("size").alias("size"))
    depth = hits.groupBy("sample", "cluster_id").agg(F.sum(F.coalesce("size", F.lit(0).cast("bigint"))).alias("depth"))
    # depths by frequency: a hot sample is a few weighted values before it is one key
    n = compress(depth, "sample", "depth")
    return n.groupBy("key").agg(F.sum("weight").alias("n_clusters"), F.sum(F.when(F.col("value") >= min_depth, F.col("weight")).otherwise(0)).alias("n_deep"))
