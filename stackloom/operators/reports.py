"""Tables that summarise runs of outside programs and whole projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evanno_table(reps: DataFrame) -> DataFrame:
    """``k, n, mean_lnl, sd_lnl, d1, d2, delta_k`` from ``reps(k, rep, lnl)``: mean and sample deviation for each number of groups,
    first differences, absolute second differences and their ratio to the deviation; only between consecutive k."""
    own = reps.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg("lnl").alias("mean"), F.stddev_samp("lnl").alias("sd"))
    order = Window.orderBy("k")  # a row for each number of groups
    near = own.withColumn("p", F.when(F.lag("k").over(order) == F.col("k") - 1, F.lag("mean").over(order))).withColumn("x", F.when(F.lead("k").over(order) == F.col("k") + 1, F.lead("mean").over(order)))
    d2 = F.abs(F.col("x") - 2 * F.col("mean") + F.col("p"))
    return near.select("k", "n", F.round("mean", 6).alias("mean_lnl"), F.round("sd", 6).alias("sd_lnl"), F.round(F.col("mean") - F.col("p"), 6).alias("d1"), F.round(d2, 6).alias("d2"), F.round(d2 / F.col("sd"), 6).alias("delta_k"))


def converged(reps: DataFrame, most: float) -> DataFrame:
    """``reps(k, rep, v)`` with ``converged``: variance at most ``most`` times the smallest of its k."""
    return reps.withColumn("converged", F.col("v") <= most * F.min("v").over(Window.partitionBy("k")))


def combine_posteriors(samples: DataFrame) -> DataFrame:
    """``parameter, mean, sd, lower, upper, n``: posterior draws of all replicates put together, with the central 95 %."""
    return samples.groupBy("parameter").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.expr("percentile_approx(value, 0.025, 10000)").alias("lower"), F.expr("percentile_approx(value, 0.975, 10000)").alias("upper"), F.count(F.lit(1)).alias("n"))


def divergence_times(samples: DataFrame, generation: float, mutation: float) -> DataFrame:
    """Posterior draws turned into years (``tau``) and population sizes (``theta``)."""
    scaled = F.when(F.col("parameter").startswith("tau"), F.col("value") * generation / mutation).when(F.col("parameter").startswith("theta"), F.col("value") / (4 * mutation)).otherwise(F.col("value"))
    return samples.withColumn("value", scaled)


def sample_groups(samples: DataFrame) -> DataFrame:
    """``sample, part``: samples by name in even contiguous groups for clustering in tiers: of 20 up to 100 samples, of 50 up to 500, else of 100."""
    n = samples.select("sample").distinct().withColumn("k", F.row_number().over(Window.orderBy("sample"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))  # the samples of a study
    size = F.when(F.col("n") <= 100, 20).when(F.col("n") <= 500, 50).otherwise(100)
    groups = F.ceil(F.col("n") / size)
    return n.select("sample", F.floor((F.col("k") - 1) / F.ceil(F.col("n") / groups)).cast("int").alias("part"))


def site_pattern_test(counts: DataFrame) -> DataFrame:
    """``f1, f2, h, gamma`` of rows ``aabb, abba, baba, sites``: Hils' H and gamma from counts of site patterns: f1 = aabb - baba,
    f2 = abba - baba, each over the sites; H compares f1 and f2 by their covariances, gamma = 1 - f1 / (f1 + f2)."""
    n = F.greatest(F.col("sites").cast("double"), F.lit(1.0))
    shares = counts.select(n.alias("n"), *[(F.col(k) / n).alias(x) for k, x in (("aabb", "a"), ("abba", "b"), ("baba", "c"))])
    own = shares.selectExpr("n", "a - c f1", "b - c f2", "(a * (1 - a) + c * (1 - c) + 2 * a * c) / n v1", "(b * (1 - b) + c * (1 - c) + 2 * b * c) / n v2", "(-a * b + a * c + b * c + c * (1 - c)) / n cov")
    ratio = own.withColumn("ratio", F.when(F.col("f2") != 0, F.col("f1") / F.col("f2")).otherwise(0.0)).withColumn("scale", F.expr("v2 * ratio * ratio - 2 * cov * ratio + v1"))
    h = F.when(F.col("scale") > 0, F.col("f2") * (F.col("ratio") - 1) / F.sqrt("scale")).otherwise(0.0)
    gamma = F.when(F.col("f1") + F.col("f2") != 0, 1 - F.col("f1") / (F.col("f1") + F.col("f2"))).otherwise(0.0)
    return ratio.select(*[F.round(c, 6).alias(x) for c, x in ((F.col("f1"), "f1"), (F.col("f2"), "f2"), (h, "h"), (gamma, "gamma"))])
