"""Operators on genomic intervals, half-open and counted from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackloom.functions.sequence import portable_draw, text_number


def merge_intervals(intervals: DataFrame, gap: int = 0, part: int = 1 << 20) -> DataFrame:
    """``chrom, p0, p1, n``: overlapping or touching intervals of each chromosome (or within ``gap``) made one.

    A chromosome is swept in ranges of ``part`` positions: intervals are merged within
    ranges, then the few merged ones across, so a long chromosome with
    most intervals is not ordered in one task."""
    counted = intervals.groupBy("chrom", "p0", "p1").agg(F.count(F.lit(1)).alias("n"))  # equal intervals once, so that the order is total
    first = _islands(counted.withColumn("part", F.floor(F.col("p0") / part)), ["chrom", "part"], gap)
    # an island can only go on across ranges if it ends beyond its own range, or is begun within reach of one that does
    first = first.withColumn("part", F.floor(F.col("p0") / part)).withColumn("crosses", F.floor((F.col("p1") + gap) / part) > F.col("part"))
    reached = first.where("crosses").select("chrom", F.explode(F.sequence(F.col("part") + 1, F.floor((F.col("p1") + gap) / part))).alias("part"), (F.col("p1") + gap).alias("reach")).groupBy("chrom", "part").agg(F.max("reach").alias("reach"))
    marked = first.join(reached, ["chrom", "part"], "left").withColumn("open", F.col("crosses") | F.coalesce(F.col("p0") <= F.col("reach"), F.lit(False)))
    few = _islands(marked.where("open"), ["chrom"], gap)
    return few.unionByName(marked.where("not open").select("chrom", "p0", "p1", "n"))


def _islands(rows: DataFrame, keys: list[str], gap: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("p0", "p1")
    reach = F.max("p1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.withColumn("fresh", (reach.isNull() | (F.col("p0") > reach + gap)).cast("int"))
    island = starts.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min("p0").alias("p0"), F.max("p1").alias("p1"), F.sum("n").alias("n")).select("chrom", "p0", "p1", "n")


def range_join(points: DataFrame, ranges: DataFrame, bin_size: int) -> DataFrame:
    """``points`` (``chrom, pos``) with the ``ranges`` (``chrom, p0, p1``) that hold them: ranges are spread over bins, so the join has equal keys."""
    spread = ranges.where("p1 > p0").withColumn("bin", F.explode(F.sequence(F.floor(F.col("p0") / bin_size), F.floor((F.col("p1") - 1) / bin_size))))
    placed = points.withColumn("bin", F.floor(F.col("pos") / bin_size))
    return placed.join(spread, ["chrom", "bin"]).where("pos >= p0 and pos < p1").drop("bin")


def overlap_join(left: DataFrame, right: DataFrame, bin_size: int) -> DataFrame:
    """``chrom, a0, a1, b0, b1``: overlapping intervals of both sides, each pair once: it is taken in the bin where the overlap starts."""
    spread = lambda df, lo, hi: df.where(F.col(hi) > F.col(lo)).withColumn("bin", F.explode(F.sequence(F.floor(F.col(lo) / bin_size), F.floor((F.col(hi) - 1) / bin_size))))
    a = spread(left.select("chrom", F.col("p0").alias("a0"), F.col("p1").alias("a1")), "a0", "a1")
    b = spread(right.select("chrom", F.col("p0").alias("b0"), F.col("p1").alias("b1")), "b0", "b1")
    return a.join(b, ["chrom", "bin"]).where("a0 < b1 and b0 < a1").where(F.floor(F.greatest("a0", "b0") / bin_size) == F.col("bin")).drop("bin")


def sliding_windows(lengths: DataFrame, width: int, step: int) -> DataFrame:
    """``chrom, start, end``: windows over each chromosome (``chrom, length``); a partial last one is dropped."""
    return lengths.where(F.col("length") > width).select("chrom", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - width - 1, F.lit(step).cast("bigint"))).alias("start")).withColumn("end", F.col("start") + width)


def points_per_window(points: DataFrame, width: int, step: int) -> DataFrame:
    """``chrom, start, n``: points in each sliding window. A point knows its windows by arithmetic, so nothing is joined."""
    last = F.floor(F.col("pos") / step)
    first = F.greatest(F.floor((F.col("pos") - width) / step) + 1, F.lit(0))
    return points.where("chrom is not null and pos is not null").select("chrom", F.explode(F.sequence(first, last)).alias("k")).groupBy("chrom", (F.col("k") * step).alias("start")).agg(F.count(F.lit(1)).alias("n"))


def scaffold_coverage(points: DataFrame, regions: DataFrame) -> DataFrame:
    """``chrom, n_regions, covered, n_points`` for each chromosome."""
    a = regions.groupBy("chrom").agg(F.count(F.lit(1)).alias("n_regions"), F.sum(F.col("p1") - F.col("p0")).alias("covered"))
    b = points.where("chrom is not null").groupBy("chrom").agg(F.count(F.lit(1)).alias("n_points"))
    return a.join(b, "chrom", "full").fillna(0, ["n_regions", "covered", "n_points"])


def extract_window(cells: DataFrame, chrom: int, start: int, end: int) -> DataFrame:
    """The cells (``chrom, position`` and others) in a genomic range; the predicate reaches the scan."""
    return cells.where((F.col("chrom") == chrom) & F.col("position").between(start, end - 1))


def window_filter(cells: DataFrame, min_coverage: int = 2, min_row_share: float = 0.0) -> DataFrame:
    """Cells of the sites with at least ``min_coverage`` bases, of the samples whose share of bases over those sites is at least ``min_row_share``."""
    site = cells.groupBy("locus", "pos").agg(F.count_if(~F.col("base").isin("N", "-")).alias("n")).where(F.col("n") >= min_coverage).select("locus", "pos")
    kept = cells.join(site, ["locus", "pos"])
    sample = kept.groupBy("sample").agg((F.count_if(~F.col("base").isin("N", "-")) / F.count(F.lit(1))).alias("share")).where(F.col("share") >= min_row_share).select("sample")
    return kept.join(sample, "sample")


def consensus_reduce(cells: DataFrame, pops: DataFrame, seed: int = 42) -> DataFrame:
    """``locus, pos, pop, base``: one base for each population and site, drawn by the share of its samples with a seeded number."""
    n = cells.where(~F.col("base").isin("N", "-")).join(pops, "sample").groupBy("locus", "pos", "pop", "base").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("locus", "pos", "pop")
    upto, total = F.sum("n").over(own.orderBy("base")), F.sum("n").over(own)
    # the draw depends on its key modulo 2^31 - 1 only, so each product is reduced before the next and none overflows
    site = F.pmod(F.pmod("locus", F.lit(2147483647)) * 7919 + F.col("pos"), F.lit(2147483647))
    draw = portable_draw(site * 1048583 + text_number(F.col("pop")), seed) / 2147483647.0
    placed = n.withColumn("upto", upto).withColumn("total", total).withColumn("draw", draw).where("draw * total < upto")
    return placed.groupBy("locus", "pos", "pop").agg(F.min_by("base", "upto").alias("base"))


def insert_size(pairs: DataFrame) -> DataFrame:
    """One row: the distance beyond which mates are not joined, from ``insert, length``; 300 where nothing is known.

    Mean + 3 deviations, less twice the mean length where the mates do not overlap, once otherwise."""
    s = pairs.agg(F.avg("insert").alias("m"), F.ceil(F.stddev_samp("insert")).alias("sd"), F.avg("length").alias("l"))
    apart = F.col("m") > 2 * F.col("l")
    size = F.when(apart, F.col("m") + 3 * F.col("sd") - 2 * F.col("l")).otherwise(F.col("m") - F.col("l") + 3 * F.col("sd"))
    return s.select(F.coalesce(F.round(size, 4), F.lit(300.0)).alias("max_insert"))
