"""Operators on loci: columns of bases over samples.

A cell table has one row for each locus, position and sample: ``locus, pos,
sample, base`` with upper-case IUPAC codes, ``N`` and ``-``. Row tables have
one row for each locus and sample with the whole sequence in ``seq``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.functions.sequence import allele_of


def _counts() -> list[Column]:
    """Alleles of each base in a group of cells; an ambiguity code counts once for each of its bases."""
    first, second = allele_of(F.col("base"), 0), allele_of(F.col("base"), 1)
    het = first != second
    return [F.sum(F.when(first == b, 1).otherwise(0) + F.when(het & (second == b), 1).otherwise(0)).alias(b.lower()) for b in "ACGT"]


def site_classes(cells: DataFrame) -> DataFrame:
    """``locus, pos, a, c, g, t, mark``: ``*`` informative, ``-`` one odd
    allele, blank invariant, by the second-largest allele count."""
    n = cells.groupBy("locus", "pos").agg(*_counts())
    second = F.sort_array(F.array("a", "c", "g", "t"))[2]
    return n.withColumn("mark", F.when(second == 0, " ").when(second == 1, "-").otherwise("*"))


def informative_sites(classes: DataFrame) -> DataFrame:
    """``locus, n_sites, n_var, n_pis``."""
    return classes.groupBy("locus").agg(F.count(F.lit(1)).alias("n_sites"), F.count_if(F.col("mark") == "-").alias("n_var"), F.count_if(F.col("mark") == "*").alias("n_pis"))


def ranked_alleles(classes: DataFrame) -> DataFrame:
    """``locus, pos, ranked``: the alleles of each site by count, ties by letter."""
    pairs = F.array(*[F.struct((-F.col(b)).alias("n"), F.lit(b.upper()).alias("b")) for b in "acgt"])
    held = F.filter(F.sort_array(pairs), lambda p: p["n"] < 0)
    return classes.select("locus", "pos", F.array_join(F.transform(held, lambda p: p["b"]), "").alias("ranked"))


def duplicate_samples(rows: DataFrame) -> DataFrame:
    """``locus, n_rows, n_samples, duplicated``: loci in which a sample occurs twice."""
    return rows.groupBy("locus").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("sample").alias("n_samples")).withColumn("duplicated", F.col("n_rows") != F.col("n_samples"))


def min_samples(rows: DataFrame, pops: DataFrame, least: int = 4, pop_least: int = 1, pops_needed: int = 1) -> DataFrame:
    """``locus, n_samples, pops_met, keep``: at least ``least`` samples, and ``pop_least`` of them in ``pops_needed`` populations."""
    present = rows.select("locus", "sample").distinct()
    per_pop = present.join(pops, "sample").groupBy("locus", "pop").agg(F.count(F.lit(1)).alias("n")).groupBy("locus").agg(F.count_if(F.col("n") >= pop_least).alias("pops_met"))
    total = present.groupBy("locus").agg(F.count(F.lit(1)).alias("n_samples"))
    both = total.join(per_pop, "locus", "left").fillna(0, ["pops_met"])
    return both.withColumn("keep", (F.col("n_samples") >= least) & (F.col("pops_met") >= pops_needed))


def coverage_edges(cells: DataFrame, least: int = 4) -> DataFrame:
    """``locus, left, right``: the first and last position at which at least ``least`` rows (or all, of fewer) have a base."""
    covered = cells.groupBy("locus", "pos").agg(F.count_if(~F.col("base").isin("N", "-")).alias("n"))
    rows = cells.groupBy("locus").agg(F.countDistinct("sample").alias("rows"))
    good = covered.join(rows, "locus").where(F.col("n") >= F.least(F.lit(least), F.col("rows")))
    return good.groupBy("locus").agg(F.min("pos").alias("left"), F.max("pos").alias("right"))


def overhang_trim(rows: DataFrame, overhang: str, share: float = 0.75) -> DataFrame:
    """``locus, trim``: the overhang's length where at least ``share`` of the bases seen under it agree with it, else 0."""
    n = len(overhang)
    seen = [F.substring("seq", k + 1, 1) for k in range(n)]
    hit = sum(((s == c).cast("int") for s, c in zip(seen, overhang)), F.lit(0))
    observed = sum((s.isin(*"ACGT").cast("int") for s in seen), F.lit(0))
    both = rows.groupBy("locus").agg(F.sum(hit).alias("hits"), F.sum(observed).alias("seen"))
    return both.select("locus", F.when((F.col("seen") > 0) & (F.col("hits") >= share * F.col("seen")), n).otherwise(0).alias("trim"))


def trim_rows(rows: DataFrame, edges: DataFrame, min_length: int = 1) -> DataFrame:
    """``locus, sample, seq, empty`` cut to ``left..right`` (inclusive, from 0); loci shorter than ``min_length`` are gone, rows without a base are marked."""
    cut = rows.join(edges, "locus").where(F.col("right") - F.col("left") + 1 >= min_length)
    seq = F.substring("seq", F.col("left") + 1, F.col("right") - F.col("left") + 1)
    return cut.select("locus", "sample", seq.alias("seq"), (F.regexp_replace(seq, "[N-]", "") == "").alias("empty"))


def max_gaps(rows: DataFrame, most: int = 8) -> DataFrame:
    """``locus, gaps, keep``: the most internal gaps of a row."""
    inner = F.regexp_replace("seq", "^-+|-+$", "")
    gaps = F.length(inner) - F.length(F.replace(inner, F.lit("-"), F.lit("")))
    return rows.groupBy("locus").agg(F.max(gaps).alias("gaps")).withColumn("keep", F.col("gaps") <= most)


def max_variable(sites: DataFrame, share: float = 0.2) -> DataFrame:
    """``locus, variable, keep``: variable sites at most ``share`` of all."""
    return sites.select("locus", (F.col("n_var") + F.col("n_pis")).alias("variable"), (F.col("n_var") + F.col("n_pis") <= F.col("n_sites") * share).alias("keep"))


def shared_het(cells: DataFrame, share: float = 0.5) -> DataFrame:
    """``locus, most_het, keep``: the largest number of ambiguity codes at a site, at most ``share`` of the rows."""
    n = cells.groupBy("locus", "pos").agg(F.count_if(F.col("base").isin(*"RKSYWM")).alias("het"))
    rows = cells.groupBy("locus").agg(F.countDistinct("sample").alias("rows"))
    return n.groupBy("locus").agg(F.max("het").alias("most_het")).join(rows, "locus").select("locus", "most_het", (F.col("most_het") <= share * F.col("rows")).alias("keep"))


def filter_table(flags: DataFrame, names: Sequence[str]) -> DataFrame:
    """``filter, total, applied, retained``: loci each filter drops, those it drops after the ones before it, and what is left."""
    aggs, before = [F.count(F.lit(1)).alias("loci")], F.lit(False)
    for n in names:
        aggs += [F.count_if(F.col(n)).alias(f"{n}_total"), F.count_if(F.col(n) & ~before).alias(f"{n}_applied")]
        before = before | F.col(n)
    one = flags.agg(*aggs)
    rows, left = [F.struct(F.lit("prefiltered").alias("filter"), F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("applied"), F.col("loci").alias("retained"))], F.col("loci")
    for n in names:
        left = left - F.col(f"{n}_applied")
        rows.append(F.struct(F.lit(n).alias("filter"), F.col(f"{n}_total").alias("total"), F.col(f"{n}_applied").alias("applied"), left.alias("retained")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def sample_coverage(rows: DataFrame) -> DataFrame:
    """``sample, n_loci``."""
    return rows.groupBy("sample").agg(F.countDistinct("locus").alias("n_loci"))


def coverage_histogram(rows: DataFrame) -> DataFrame:
    """``n_samples, n_loci, cumulative``: loci by how many samples they have, summed from the fewest."""
    each = rows.groupBy("locus").agg(F.countDistinct("sample").alias("n_samples")).groupBy("n_samples").agg(F.count(F.lit(1)).alias("n_loci"))
    return each.withColumn("cumulative", F.sum("n_loci").over(Window.orderBy("n_samples")))  # a row for each number of samples


def variable_histogram(sites: DataFrame) -> DataFrame:
    """``n_pis, n_loci, cumulative``: loci by informative sites; ``cumulative`` sums sites times loci."""
    each = sites.groupBy("n_pis").agg(F.count(F.lit(1)).alias("n_loci"))
    return each.withColumn("cumulative", F.sum(F.col("n_pis") * F.col("n_loci")).over(Window.orderBy("n_pis")))  # a row for each number of sites


def running_offsets(lengths: DataFrame, part: int = 4096) -> DataFrame:
    """``locus, start, end``: where each locus lies when all are joined in the order of their numbers.

    Lengths are summed by ranges of loci first, so no task orders all of them."""
    ranged = lengths.select("locus", "length", F.floor(F.col("locus") / part).alias("part"))
    sums = ranged.groupBy("part").agg(F.sum("length").alias("total"))
    before = sums.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each range
    inner = F.sum("length").over(Window.partitionBy("part").orderBy("locus"))
    placed = ranged.withColumn("upto", inner).join(before, "part")
    return placed.select("locus", (F.col("before") + F.col("upto") - F.col("length")).alias("start"), (F.col("before") + F.col("upto")).alias("end"))


def seed_groups(hits: DataFrame, records: DataFrame) -> DataFrame:
    """``locus, sample, rec_id, seq``: the seed of each hit list and the records that hit it. Seeds
    without hits are left out; a record is once in a group.

    ``hits(query, target)`` and ``records(rec_id, sample, seq)``."""
    links = hits.select("query", "target").where("query is not null and target is not null").distinct()
    members = links.select(F.col("target").alias("locus"), F.col("query").alias("rec_id")).unionByName(links.select(F.col("target").alias("locus"), F.col("target").alias("rec_id"))).distinct()
    return members.join(records, "rec_id").select("locus", "sample", "rec_id", "seq")


def two_tier_groups(first: DataFrame, second: DataFrame) -> DataFrame:
    """``locus, rec_id``: hits of hits under the seed of the second tier. ``first`` and ``second`` have ``query, target``."""
    a = first.select("query", "target").distinct()
    b = second.select(F.col("query").alias("target"), F.col("target").alias("locus")).distinct()
    through = a.join(b, "target").select("locus", F.col("query").alias("rec_id"))
    direct = b.select("locus", F.col("target").alias("rec_id"))
    return through.unionByName(direct).unionByName(b.select("locus", F.col("locus").alias("rec_id"))).distinct()


def merge_duplicates(cells: DataFrame) -> DataFrame:
    """``locus, sample, merged, seq``: rows of one sample in a locus made one where no column has two bases.

    ``cells`` has ``locus, sample, pos, base``, several rows a column."""
    column = cells.groupBy("locus", "sample", "pos").agg(F.collect_set(F.when(~F.col("base").isin("N", "-"), F.col("base"))).alias("bases"))
    one = column.select("locus", "sample", "pos", (F.size("bases") <= 1).alias("ok"), F.coalesce(F.get("bases", F.lit(0)), F.lit("N")).alias("base"))
    return one.groupBy("locus", "sample").agg(F.bool_and("ok").alias("merged"), F.array_join(F.array_sort(F.collect_list(F.struct("pos", "base")))["base"], "").alias("seq"))


def concatenated(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """``sample, seq``: all columns of each sample in order, N where it has none; as in a phylip file.

    A sample's row is as long as the data; it is built for export only."""
    columns = cells.select("locus", "pos").distinct()
    grid = columns.join(samples.select("sample").distinct()).join(cells.select("locus", "pos", "sample", "base"), ["locus", "pos", "sample"], "left")
    return grid.groupBy("sample").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("locus", "pos", F.coalesce("base", F.lit("N")).alias("base")))), lambda s: s["base"]), "").alias("seq"))


# ------------------------------------------------------------ diversity


def allele_table(cells: DataFrame, pops: DataFrame) -> DataFrame:
    """``locus, pos, pop, a, c, g, t, n``: allele counts of each site and population."""
    n = cells.join(pops, "sample").groupBy("locus", "pos", "pop").agg(*_counts())
    return n.withColumn("n", F.expr("a + c + g + t"))


def diversity(alleles: DataFrame, parity: bool = False) -> DataFrame:
    """``locus, pop, n_sites, seg, n, pi, theta, tajima_d`` of each locus and population.

    ``n`` is the largest number of alleles at a site. Watterson's theta is
    S over the sum of 1/i for i below n; with ``parity`` up to n."""
    squares = F.expr("a * a + c * c + g * g + t * t")
    site_pi = F.when(F.col("n") > 1, (F.col("n") * F.col("n") - squares) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    segregating = F.greatest("a", "c", "g", "t") < F.col("n")
    per = alleles.where("n > 0").groupBy("locus", "pop").agg(F.count(F.lit(1)).alias("n_sites"), F.count_if(segregating).alias("seg"), F.max("n").alias("n"), F.sum(site_pi).alias("pi"))
    steps = F.sequence(F.lit(1), F.greatest(F.col("n") - (0 if parity else 1), F.lit(1)).cast("int"))
    harmonic = F.aggregate(steps, F.lit(0.0), lambda s, i: s + 1 / i.cast("double"))
    usual = F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1)).cast("int"))
    staged = per.withColumn("h", harmonic).withColumn("a1", F.aggregate(usual, F.lit(0.0), lambda s, i: s + 1 / i.cast("double"))).withColumn("a2", F.aggregate(usual, F.lit(0.0), lambda s, i: s + 1 / (i * i).cast("double")))
    staged = staged.withColumn("theta", F.col("seg") / F.col("h"))
    n, s = F.col("n").cast("double"), F.col("seg").cast("double")
    e1 = ((n + 1) / (3 * (n - 1)) - 1 / F.col("a1")) / F.col("a1")
    e2 = (2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (n * F.col("a1")) + F.col("a2") / (F.col("a1") * F.col("a1"))) / (F.col("a1") * F.col("a1") + F.col("a2"))
    variance = F.when(n > 1, e1 * s + e2 * s * (s - 1))
    d = F.when(variance > 0, (F.col("pi") - F.col("seg") / F.col("a1")) / F.sqrt(variance))
    return staged.withColumn("tajima_d", d).drop("h", "a1", "a2")


def divergence(alleles: DataFrame) -> DataFrame:
    """``pop_a, pop_b, n_sites, dxy, within, fst, fst_adjusted, nm`` of each pair of populations over sites both have.

    ``dxy``: mean share of differing allele pairs between; ``within``: the mean of both
    populations' own; fst = 1 - within / between. Populations of a site are
    gathered once and paired inside the row (their number is that of the
    study's populations)."""
    at = alleles.where("n > 1").groupBy("locus", "pos").agg(F.array_sort(F.collect_list(F.struct("pop", "a", "c", "g", "t", "n"))).alias("p"))
    pairs = at.select(F.explode(F.flatten(F.transform("p", lambda x: F.transform(F.filter("p", lambda y: y["pop"] > x["pop"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))).alias("q")).select("q.x", "q.y")
    same = sum((F.col(f"x.{b}") * F.col(f"y.{b}") for b in "acgt"), F.lit(0))
    between = 1 - same / (F.col("x.n") * F.col("y.n"))
    own = lambda k: (F.col(f"{k}.n") * F.col(f"{k}.n") - sum((F.col(f"{k}.{b}") * F.col(f"{k}.{b}") for b in "acgt"), F.lit(0))) / (F.col(f"{k}.n") * (F.col(f"{k}.n") - 1))
    sums = pairs.groupBy(F.col("x.pop").alias("pop_a"), F.col("y.pop").alias("pop_b")).agg(F.count(F.lit(1)).alias("n_sites"), F.avg(between).alias("b"), F.avg((own("x") + own("y")) / 2).alias("w"))
    d = 2.0
    adjusted = 1 - F.col("w") / (F.col("w") / d + (d - 1) * F.col("b") / d)
    nm = (d - 1) / d * 0.5 * F.col("w") / (F.col("b") - F.col("w"))
    held = F.col("b") > 0
    return sums.select("pop_a", "pop_b", "n_sites", F.round("b", 6).alias("dxy"), F.round("w", 6).alias("within"), F.when(held, F.round(1 - F.col("w") / F.col("b"), 6)).alias("fst"), F.when(held, F.round(adjusted, 6)).alias("fst_adjusted"), F.when(F.col("b") != F.col("w"), F.round(nm, 6)).alias("nm"))


def diversity_summary(per_locus: DataFrame) -> DataFrame:
    """``pop, n_loci, pi, theta, tajima_d``: means over loci."""
    return per_locus.groupBy("pop").agg(F.count(F.lit(1)).alias("n_loci"), F.round(F.avg("pi"), 6).alias("pi"), F.round(F.avg("theta"), 6).alias("theta"), F.round(F.avg("tajima_d"), 6).alias("tajima_d"))
