"""Operators on SNP genotypes in long form.

A call table has one row for each site and sample: ``snp_id, sample, a0, a1,
base, depth``; missing values are null. ``g`` is the number of derived alleles
(``a0 + a1``) of biallelic calls.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.functions.sequence import allele_of, code_of_pair, portable_draw, text_number

_BASES = "^[ACGTRKSYWM]$"


def clean_calls(genos: DataFrame) -> DataFrame:
    """Repeated rows once, missing values as null, ``is_gap`` where the base is a gap."""
    legal = F.col("a0").between(0, 3) & F.col("a1").between(0, 3)
    return genos.select(
        "snp_id", "sample", F.when(legal, F.col("a0")).alias("a0"), F.when(legal, F.col("a1")).alias("a1"), F.when(F.col("base").rlike(_BASES), F.col("base")).alias("base"), F.when(F.col("depth") >= 0, F.col("depth")).alias("depth"), F.coalesce(F.col("base") == "-", F.lit(False)).alias("is_gap")
    ).distinct()


def populations(imap: DataFrame) -> DataFrame:
    """``sample, pop`` of the samples whose population is known."""
    return imap.where(F.col("pop").rlike("^pop_[a-l]$") & F.col("sample").isNotNull()).select("sample", "pop").distinct()


def site_table(sites: DataFrame) -> DataFrame:
    """The sites, each once."""
    return sites.dropDuplicates(["snp_id"])


def select_samples(calls: DataFrame, wanted: DataFrame) -> DataFrame:
    """The calls of the samples in ``wanted``."""
    return calls.join(wanted.select("sample").distinct(), "sample", "left_semi")


def exclude_samples(calls: DataFrame, unwanted: DataFrame) -> DataFrame:
    """The calls of the samples not in ``unwanted``."""
    return calls.join(unwanted.select("sample").distinct(), "sample", "left_anti")


def _dosage() -> Column:
    return F.col("a0") + F.col("a1")


def snp_masks(calls: DataFrame, pops: DataFrame, mincov: int | float = 0.0, minmap: int | float = 1, maf: int | float = 0.0) -> DataFrame:
    """``snp_id`` with one boolean for each reason to drop a site, and ``keep``.

    In order: a gap among the selected bases; an allele beyond the first two;
    coverage below ``mincov`` (a count, or a share of all selected samples if a float); below
    ``minmap`` in a population (count, or share of the population's samples); all
    observed genotypes equal to their rounded mean; minor allele frequency
    below ``maf`` (folded share, or an unfolded count of derived alleles if an int)."""
    size = pops.groupBy("pop").agg(F.count(F.lit(1)).alias("size"))
    here = calls.join(pops, "sample")
    g = F.when((F.col("a0") < 2) & (F.col("a1") < 2), _dosage())
    any_g = _dosage()
    per_pop = here.groupBy("snp_id", "pop").agg(F.count(any_g).alias("seen"))
    weak = F.col("seen") < minmap if isinstance(minmap, int) else F.col("seen") / F.col("size") < minmap
    # a population without any row at a site is short there too
    short = per_pop.join(F.broadcast(size), "pop").groupBy("snp_id").agg(F.count_if(~weak).alias("enough"))  # one row for each population
    total = size.agg(F.count(F.lit(1)).alias("pops"), F.sum("size").alias("samples"))
    site = here.groupBy("snp_id").agg(
        F.bool_or("is_gap").alias("indel"), F.coalesce(F.bool_or((F.col("a0") > 1) | (F.col("a1") > 1)), F.lit(False)).alias("multi"), F.count(any_g).alias("nobs"), F.sum(any_g).alias("total"), F.min(any_g).alias("lo"), F.max(any_g).alias("hi"), F.bround(F.avg(any_g)).alias("common")
    )
    both = site.join(short, "snp_id").join(F.broadcast(total))  # one row
    low = F.col("nobs") < mincov if isinstance(mincov, int) else F.col("nobs") < mincov * F.col("samples")
    share = F.try_divide(F.col("total"), 2 * F.col("nobs"))
    rare = F.col("total") < maf if isinstance(maf, int) else F.least(share, 1 - share) < maf
    masks = both.select(
        "snp_id", "indel", "multi", low.alias("low_coverage"), (F.col("enough") < F.col("pops")).alias("low_population"), F.coalesce((F.col("lo") == F.col("common")) & (F.col("hi") == F.col("common")), F.lit(True)).alias("invariant"), F.coalesce(rare, F.lit(True)).alias("rare")
    )
    kept = ~reduce(lambda a, b: a | b, [F.col(c) for c in ("indel", "multi", "low_coverage", "low_population", "invariant", "rare")])
    return masks.withColumn("keep", kept)


def filter_snps(calls: DataFrame, pops: DataFrame, **limits) -> DataFrame:
    """The calls of the selected samples at the sites that no mask drops."""
    kept = snp_masks(calls, pops, **limits).where("keep").select("snp_id")
    return calls.join(pops, "sample").join(kept, "snp_id", "left_semi")


def sample_missing(calls: DataFrame) -> DataFrame:
    """``sample, n_sites, n_missing, missing``: the share of missing genotypes of each sample."""
    return calls.groupBy("sample").agg(F.count(F.lit(1)).alias("n_sites"), F.count_if(F.col("a0").isNull()).alias("n_missing")).withColumn("missing", F.round(F.col("n_missing") / F.col("n_sites"), 6))


def site_coverage(calls: DataFrame, pops: DataFrame) -> DataFrame:
    """``snp_id, pop, covered``: called samples at each site of each population and, under ``all``, of all."""
    grouped = calls.join(pops, "sample").where("a0 is not null").rollup("snp_id", "pop").agg(F.count(F.lit(1)).alias("covered"))
    return grouped.where("snp_id is not null").select("snp_id", F.coalesce("pop", F.lit("all")).alias("pop"), "covered")


def allele_counts(calls: DataFrame, pops: DataFrame) -> DataFrame:
    """``snp_id, pop, anc, der``: ancestral and derived alleles of each population, biallelic calls only."""
    here = calls.where("a0 < 2 and a1 < 2").join(pops, "sample")
    return here.groupBy("snp_id", "pop").agg(F.sum(2 - _dosage()).alias("anc"), F.sum(_dosage()).alias("der"))


def allele_frequency(calls: DataFrame, pops: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row for each site, the derived frequency of each population in a column."""
    counts = allele_counts(calls, pops).withColumn("f", F.round(F.try_divide("der", F.col("anc") + F.col("der")), 6))
    return counts.groupBy("snp_id").pivot("pop", list(names)).agg(F.first("f"))


def unlinked(sites: DataFrame, seed: int = 42) -> DataFrame:
    """One site of each locus, drawn by a seeded number."""
    draw = F.struct(portable_draw(F.col("snp_id"), seed).alias("draw"), "snp_id")
    return sites.groupBy("locus").agg(F.min(draw)["snp_id"].alias("snp_id"))


def random_loci(sites: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` loci drawn without replacement."""
    return sites.select("locus").distinct().orderBy(portable_draw(F.col("locus"), seed), "locus").limit(n)


# ------------------------------------------------------------ D-statistics


def _population_frequencies(calls: DataFrame, pops: DataFrame, sites: DataFrame, names: Sequence[str]) -> DataFrame:
    """``snp_id, locus, f1..fn`` of the sites that every population covers, polarised by the last."""
    here = pops.where(F.col("pop").isin(list(names)))
    counts = allele_counts(calls, here).withColumn("f", F.try_divide("der", F.col("anc") + F.col("der")))
    wide = counts.groupBy("snp_id").pivot("pop", list(names)).agg(F.first("f")).dropna()
    flip = F.col(names[-1]) >= 0.5
    return wide.join(site_table(sites).select("snp_id", "locus"), "snp_id").select("snp_id", "locus", *[F.when(flip, 1 - F.col(p)).otherwise(F.col(p)).alias(f"f{k + 1}") for k, p in enumerate(names)])


def abba_baba(calls: DataFrame, pops: DataFrame, sites: DataFrame, names: Sequence[str]) -> DataFrame:
    """``locus, n_snps, abba, baba`` of populations p1, p2, p3 and the outgroup p4."""
    f = _population_frequencies(calls, pops, sites, names)
    abba = (1 - F.col("f1")) * F.col("f2") * F.col("f3") * (1 - F.col("f4"))
    baba = F.col("f1") * (1 - F.col("f2")) * F.col("f3") * (1 - F.col("f4"))
    return f.groupBy("locus").agg(F.count(F.lit(1)).alias("n_snps"), F.sum(abba).alias("abba"), F.sum(baba).alias("baba"))


def d_statistic(per_locus: DataFrame) -> DataFrame:
    """One row: ``dstat, n_snps, n_loci``."""
    return per_locus.agg(F.sum("abba").alias("a"), F.sum("baba").alias("b"), F.sum("n_snps").alias("n_snps"), F.count(F.lit(1)).alias("n_loci")).select(F.round(F.try_divide(F.col("a") - F.col("b"), F.col("a") + F.col("b")), 6).alias("dstat"), "n_snps", "n_loci")


def bootstrap_d(per_locus: DataFrame, replicates: int = 100, seed: int = 42) -> DataFrame:
    """``replicate, dstat``: loci resampled with replacement.

    Each locus gets a Poisson(1) weight in each replicate, which for many loci is the
    bootstrap and needs neither an index of loci nor a shuffle of them; the
    per-locus sums are aggregated first, sites are never multiplied."""
    replicate = F.explode(F.sequence(F.lit(1), F.lit(replicates)))
    draw = (portable_draw(F.col("locus") * 1009 + F.col("replicate"), seed) + 0.5) / 2147483647.0
    # the cumulative probabilities of a Poisson(1) count
    weight = sum(((draw > p).cast("int") for p in (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815)), F.lit(0))
    w = per_locus.withColumn("replicate", replicate).withColumn("w", weight)
    sums = w.groupBy("replicate").agg(F.sum(F.col("w") * F.col("abba")).alias("a"), F.sum(F.col("w") * F.col("baba")).alias("b"))
    return sums.select("replicate", F.try_divide(F.col("a") - F.col("b"), F.col("a") + F.col("b")).alias("dstat"))


def d_test(per_locus: DataFrame, replicates: int = 100, seed: int = 42) -> DataFrame:
    """One row: ``dstat, bootstd, z, n_snps, n_loci``."""
    spread = bootstrap_d(per_locus, replicates, seed).agg(F.stddev_pop("dstat").alias("bootstd"))
    return d_statistic(per_locus).join(spread).select("dstat", F.round("bootstd", 6).alias("bootstd"), F.round(F.try_divide(F.abs("dstat"), F.col("bootstd")), 6).alias("z"), "n_snps", "n_loci")


def d_tests(calls: DataFrame, pops: DataFrame, sites: DataFrame, tests: Sequence[Sequence[str]]) -> DataFrame:
    """``test, p1, p2, p3, p4, dstat, n_snps``: many tests in one pass; the
    tests are an array column, so sites are read and pivoted once."""
    names = sorted({p for t in tests for p in t})
    counts = allele_counts(calls, pops.where(F.col("pop").isin(names))).withColumn("f", F.try_divide("der", F.col("anc") + F.col("der")))
    wide = counts.groupBy("snp_id").pivot("pop", names).agg(F.first("f"))
    rows = []
    for k, t in enumerate(tests):
        present = reduce(lambda a, b: a & b, [F.col(p).isNotNull() for p in t])
        flip = F.col(t[3]) >= 0.5
        rows.append(F.struct(F.lit(k).alias("test"), *[F.lit(p).alias(f"p{j + 1}") for j, p in enumerate(t)], *[F.when(present, F.when(flip, 1 - F.col(p)).otherwise(F.col(p))).alias(f"f{j + 1}") for j, p in enumerate(t)]))
    long = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("f1 is not null")
    abba, baba = F.expr("(1 - f1) * f2 * f3 * (1 - f4)"), F.expr("f1 * (1 - f2) * f3 * (1 - f4)")
    sums = long.groupBy("test", "p1", "p2", "p3", "p4").agg(F.sum(abba).alias("a"), F.sum(baba).alias("b"), F.count(F.lit(1)).alias("n_snps"))
    return sums.select("test", "p1", "p2", "p3", "p4", F.round(F.try_divide(F.col("a") - F.col("b"), F.col("a") + F.col("b")), 6).alias("dstat"), "n_snps")


def partitioned_d(calls: DataFrame, pops: DataFrame, sites: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: the partitioned statistics of five populations (p1, p2, p3_1, p3_2, outgroup)."""
    f = _population_frequencies(calls, pops, sites, names)
    x = {k: F.col(f"f{k}") for k in range(1, 6)}
    n = {k: 1 - v for k, v in x.items()}
    patterns = {
        "abbba": n[1] * x[2] * x[3] * x[4] * n[5], "babba": x[1] * n[2] * x[3] * x[4] * n[5], "abbaa": n[1] * x[2] * x[3] * n[4] * n[5],
        "babaa": x[1] * n[2] * x[3] * n[4] * n[5], "ababa": n[1] * x[2] * n[3] * x[4] * n[5], "baaba": x[1] * n[2] * n[3] * x[4] * n[5],
    }
    s = f.agg(*[F.sum(v).alias(k) for k, v in patterns.items()], F.count(F.lit(1)).alias("n_snps"))
    ratio = lambda a, b: F.round(F.try_divide(F.col(a) - F.col(b), F.col(a) + F.col(b)), 6)
    return s.select(ratio("abbba", "babba").alias("d12"), ratio("abbaa", "babaa").alias("d1"), ratio("ababa", "baaba").alias("d2"), "n_snps")


# ------------------------------------------------------------ pairs of samples


def pair_sums(calls: DataFrame, max_samples: int = 4000) -> tuple[list[str], DataFrame]:
    """The sample names, and ``i, j, shared, distance, product, missed`` for each pair of samples
    ``i <= j`` by place among them.

    Sites are gathered as short arrays and each task adds up sample-by-sample
    matrices, so what is shuffled is a site's calls once and one
    matrix for each task; no pair of calls is ever a row. The matrices grow with the samples
    of the study, not with its sites; more than ``max_samples`` is refused."""
    names = [r["sample"] for r in calls.select("sample").distinct().orderBy("sample").limit(max_samples + 1).collect()]
    if len(names) > max_samples:
        raise ValueError(f"more than {max_samples} samples")
    place = {s: k for k, s in enumerate(names)}
    n = len(names)
    at_site = calls.where("sample is not null").groupBy("snp_id").agg(F.collect_list("sample").alias("who"), F.collect_list(F.coalesce(F.when((F.col("a0") < 2) & (F.col("a1") < 2), _dosage()), F.lit(-1))).alias("g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, square, product, missed = (np.zeros((n, n)) for _ in range(4))
        for batch in batches:
            who = batch.column(1)
            size = np.diff(who.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), size)
            column = np.array([place[s] for s in who.flatten().to_pylist()], dtype=np.int64)
            value = batch.column(2).flatten().to_numpy().astype(float)
            g, seen, absent = np.zeros((batch.num_rows, n)), np.zeros((batch.num_rows, n)), np.zeros((batch.num_rows, n))
            g[row, column], seen[row, column], absent[row, column] = np.where(value < 0, 0, value), value >= 0, value < 0
            shared += seen.T @ seen
            product += g.T @ g
            square += (g * g).T @ seen
            missed += absent.T @ absent
        i, j = np.triu_indices(n)
        gap = square[i, j] + square[j, i] - 2 * product[i, j]
        yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *(pa.array(v) for v in (shared[i, j], gap, product[i, j], missed[i, j]))], names=["i", "j", "shared", "distance", "product", "missed"])

    parts = at_site.mapInArrow(run, "i int, j int, shared double, distance double, product double, missed double")
    return names, parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("shared", "distance", "product", "missed")])


def _named(names: list[str]) -> tuple[Column, Column]:
    table = F.array(*[F.lit(s) for s in names]) if names else F.array().cast("array<string>")
    return F.get(table, F.col("i")).alias("sample_a"), F.get(table, F.col("j")).alias("sample_b")


def genotype_distance(calls: DataFrame) -> DataFrame:
    """``sample_a, sample_b, n_sites, distance``: mean squared difference over sites both have."""
    names, sums = pair_sums(calls)
    return sums.where("i < j and shared > 0").select(*_named(names), F.col("shared").cast("bigint").alias("n_sites"), F.round(F.col("distance") / F.col("shared"), 6).alias("distance"))


def sharing(calls: DataFrame) -> DataFrame:
    """``sample_a, sample_b, shared, missed``: sites both have called, and sites at which both are present and missing."""
    names, sums = pair_sums(calls)
    return sums.where("i < j").select(*_named(names), F.col("shared").cast("bigint").alias("shared"), F.col("missed").cast("bigint").alias("missed"))


def pca(calls: DataFrame, components: int = 4) -> tuple[DataFrame, list[float]]:
    """(``sample, pc1..pcn``, explained shares) from the centred sample-by-sample
    product matrix; missing calls count as the ancestral genotype. Signs are arbitrary."""
    names, sums = pair_sums(calls)
    table = sums.select("i", "j", "product").toArrow()  # samples squared / 2
    n = len(names)
    gram = np.zeros((n, n))
    i, j, v = (table.column(c).to_numpy() for c in ("i", "j", "product"))
    gram[i, j] = gram[j, i] = v
    centre = np.eye(n) - 1 / max(1, n)
    value, vector = np.linalg.eigh(centre @ gram @ centre)
    order = np.argsort(value)[::-1][:components]
    value, total = np.maximum(value, 0), max(value[value > 0].sum(), 1e-12)
    axes = vector[:, order] * np.sqrt(value[order])
    rows = [(s, *map(float, axes[k])) for k, s in enumerate(names)]
    return calls.sparkSession.createDataFrame(rows, ["sample", *[f"pc{k + 1}" for k in range(len(order))]]), [float(x / total) for x in value[order]]


def kmeans(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``sample, cluster`` of the samples' coordinates, by the library's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    made = VectorAssembler(inputCols=[c for c in points.columns if c.startswith("pc")], outputCol="features").transform(points)
    return KMeans(k=k, seed=seed).fit(made).transform(made).select("sample", F.col("prediction").alias("cluster"))


def _cell_draw(seed: int) -> Column:
    """A seeded number for each site and sample."""
    return portable_draw(F.pmod(F.col("snp_id"), F.lit(2147483647)) * 1048583 + text_number(F.col("sample")), seed)


def impute(calls: DataFrame, pops: DataFrame, method: str | None = "random", seed: int = 42) -> DataFrame:
    """``snp_id, sample, g, imputed`` by one of the methods that PCA offers: ``sample`` draws from the population's frequencies,
    ``random`` one of 0, 1 and 2 evenly, and None sets 0."""
    if method == "sample":
        return impute_sampled(calls, pops, seed)
    known = F.when((F.col("a0") < 2) & (F.col("a1") < 2), _dosage())
    drawn = F.pmod(_cell_draw(seed), F.lit(3)).cast("int") if method == "random" else F.lit(0)
    return calls.select("snp_id", "sample", F.coalesce(known, drawn).alias("g"), known.isNull().alias("imputed"))


def _as_calls(imputed: DataFrame) -> DataFrame:
    """Imputed genotypes as calls of two alleles."""
    return imputed.select("snp_id", "sample", F.floor(F.col("g") / 2).cast("int").alias("a0"), (F.col("g") - F.floor(F.col("g") / 2)).cast("int").alias("a1"))


def unlinked_replicates(sites: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """``replicate, snp_id``: for each replicate one site of each locus, drawn anew."""
    out = None
    for k in range(replicates):
        one = unlinked(sites, seed + k).select(F.lit(k).alias("replicate"), "snp_id")
        out = one if out is None else out.unionByName(one)
    return out


def pca_replicates(calls: DataFrame, sites: DataFrame, replicates: int = 3, components: int = 4, seed: int = 42) -> tuple[DataFrame, list[list[float]]]:
    """(``replicate, sample, pc1..pcn``, explained shares of each): PCA of each replicate's unlinked sites. Axes that run against those of
    the first replicate are turned."""
    drawn, out, shares, first = unlinked_replicates(sites, replicates, seed), None, [], None
    for k in range(replicates):
        points, share = pca(calls.join(drawn.where(F.col("replicate") == k).select("snp_id"), "snp_id", "left_semi"), components)
        names = [c for c in points.columns if c != "sample"]
        rows = {r["sample"]: np.array([r[c] for c in names]) for r in points.collect()}  # the samples of the study
        first = first or rows
        both = [s for s in rows if s in first]
        turn = [-1.0 if sum(rows[s][j] * first[s][j] for s in both if j < len(first[s])) < 0 else 1.0 for j in range(len(names))]
        one = points.select(F.lit(k).alias("replicate"), "sample", *[(F.col(c) * t).alias(c) for c, t in zip(names, turn)])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        shares.append(share)
    return out, shares


def impute_kmeans(calls: DataFrame, sites: DataFrame, k: int, topcov: float = 0.9, mincov: float = 0.5, rounds: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(``snp_id, sample, g, imputed``, ``sample, cluster``): missing genotypes drawn by clusters that are found by turns. Each round keeps
    the sites that enough samples cover (from ``topcov`` down to ``mincov``), imputes by the clusters of the round before
    (at first one of all), and clusters the samples by the components of unlinked sites."""
    samples = calls.select("sample").distinct()
    groups = samples.select("sample", F.lit("0").alias("pop"))
    number = samples.count()
    for step in range(rounds):
        least = topcov + (mincov - topcov) * step / max(1, rounds - 1)
        good = F.when((F.col("a0") < 2) & (F.col("a1") < 2), 1)
        kept = calls.groupBy("snp_id").agg(F.count(good).alias("n")).where(F.col("n") >= least * number).select("snp_id")
        part = impute_sampled(calls.join(kept, "snp_id", "left_semi"), groups, seed + step)
        if step == rounds - 1:
            return part, groups.select("sample", F.col("pop").alias("cluster"))
        if not kept.head(1):
            continue  # no site is covered so well: the next round asks for less
        some = unlinked(sites.join(kept, "snp_id", "left_semi"), seed + step).select("snp_id")
        points = pca(_as_calls(part.join(some, "snp_id", "left_semi")), min(4, max(1, number - 1)))[0]
        made = kmeans(points, k, seed + step).collect()  # the samples of the study
        groups = calls.sparkSession.createDataFrame([(r["sample"], str(r["cluster"])) for r in made], "sample string, pop string")


def fill_bases(calls: DataFrame, sites: DataFrame) -> DataFrame:
    """``snp_id, sample, letter``: the base or ambiguity code that a genotype stands for, N where it is missing or has no such allele."""
    own = sites.select("snp_id", "alleles")
    at = lambda c: F.get(F.col("alleles"), F.col(c))
    return calls.join(own, "snp_id").select("snp_id", "sample", F.when(at("a0").isNotNull() & at("a1").isNotNull(), code_of_pair(at("a0"), at("a1"))).otherwise("N").alias("letter"))


def masked_frequencies(calls: DataFrame, pops: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row for each site that every population covers and at which the populations but the last (the outgroup) are not all alike:
    ``snp_id`` and the derived frequency of each in a column."""
    wide = allele_frequency(calls, pops.where(F.col("pop").isin(list(names))), names).dropna()
    return wide.where(reduce(lambda a, b: a | b, [F.col(n) != F.col(names[0]) for n in names[1:-1]], F.lit(False)))


def locus_dstat(cells: DataFrame, pops: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: ``dstat, abba, baba, n_sites, n_loci`` from the bases of loci (``locus, pos, sample, base``) of three populations and an outgroup.

    The ancestral base of a site is the outgroup's most frequent one (the first letter of equals); a population's frequency is the share of its
    alleles that are others. Sites that a population lacks or at which the first three are alike do not count."""
    own = cells.join(pops.where(F.col("pop").isin(list(names))), "sample")
    alleles = own.select("locus", "pos", "pop", F.explode(F.array(allele_of(F.col("base"), 0), allele_of(F.col("base"), 1))).alias("x")).where("x is not null")
    counted = alleles.groupBy("locus", "pos", "pop", "x").agg(F.count(F.lit(1)).alias("n"))
    ancestral = counted.where(F.col("pop") == names[-1]).groupBy("locus", "pos").agg(F.min(F.struct((-F.col("n")).alias("n"), "x"))["x"].alias("anc"))
    share = F.sum(F.when(F.col("x") != F.col("anc"), F.col("n")).otherwise(0)) / F.sum("n")
    wide = counted.join(ancestral, ["locus", "pos"]).groupBy("locus", "pos").pivot("pop", list(names)).agg(share).dropna().toDF("locus", "pos", "f1", "f2", "f3", "f4")
    kept = wide.where("f1 <> f2 or f1 <> f3")
    abba, baba = F.sum(F.expr("(1 - f1) * f2 * f3 * (1 - f4)")), F.sum(F.expr("f1 * (1 - f2) * f3 * (1 - f4)"))
    sums = kept.agg(abba.alias("a"), baba.alias("b"), F.count(F.lit(1)).alias("n_sites"), F.countDistinct("locus").alias("n_loci"))
    return sums.select(F.round(F.try_divide(F.col("a") - F.col("b"), F.col("a") + F.col("b")), 6).alias("dstat"), F.round("a", 6).alias("abba"), F.round("b", 6).alias("baba"), "n_sites", "n_loci")


def order_by_sharing(shared: DataFrame) -> DataFrame:
    """``sample, mean_shared, place``: samples by the mean number of sites they share with others, from the most, ties by name."""
    long = shared.select(F.explode(F.array("sample_a", "sample_b")).alias("sample"), "shared")
    mean = long.groupBy("sample").agg(F.round(F.avg("shared"), 6).alias("mean_shared"))
    return mean.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean_shared"), "sample")))  # the samples of the study


def impute_sampled(calls: DataFrame, pops: DataFrame, seed: int = 42) -> DataFrame:
    """``snp_id, sample, g, imputed``: missing genotypes drawn as two alleles of their population's derived frequency at the
    site (0 where the population has none), by a seeded number."""
    freq = allele_counts(calls, pops).select("snp_id", "pop", F.try_divide("der", F.col("anc") + F.col("der")).alias("f"))
    draw = lambda k: _cell_draw(seed + k) / 2147483647.0
    drawn = (draw(1) < F.col("f")).cast("int") + (draw(2) < F.col("f")).cast("int")
    known = F.when((F.col("a0") < 2) & (F.col("a1") < 2), _dosage())
    joined = calls.join(pops, "sample", "left").join(freq, ["snp_id", "pop"], "left")
    return joined.select("snp_id", "sample", F.coalesce(known, drawn, F.lit(0)).alias("g"), known.isNull().alias("imputed"))


def ld_blocks(sites: DataFrame, size: int = 20000) -> DataFrame:
    """``snp_id, block``: sites of a scaffold in fixed ranges of positions; blocks are numbered over those that hold sites."""
    placed = site_table(sites).where("scaf is not null").select("snp_id", "scaf", F.floor(F.col("scafpos") / size).alias("range"))
    used = placed.select("scaf", "range").distinct()
    # occupied ranges are numbered within scaffolds and offset by the scaffolds before: no window over all rows
    local = used.withColumn("k", F.row_number().over(Window.partitionBy("scaf").orderBy("range")))
    each = local.groupBy("scaf").agg(F.max("k").alias("n"))
    offset = each.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("scaf").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row for each scaffold
    return placed.join(local, ["scaf", "range"]).join(offset, "scaf").select("snp_id", "scaf", (F.col("before") + F.col("k") - 1).alias("block"))


def filter_report(masks: DataFrame) -> DataFrame:
    """``mask, dropped``: how many sites each mask drops, and all together."""
    names = ["indel", "multi", "low_coverage", "low_population", "invariant", "rare"]
    counted = masks.agg(*[F.count_if(F.col(c)).alias(c) for c in names], F.count_if(~F.col("keep")).alias("combined"))
    return counted.unpivot([], [*names, "combined"], "mask", "dropped")
