"""Operators of the reference-mapped route: regions, placed reads, depths of sites, and imported genotypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackloom.functions.sequence import apply_cigar
from stackloom.operators.intervals import merge_intervals, range_join


def regions_of(alignments: DataFrame, gap: int = 0) -> DataFrame:
    """``chrom, p0, p1, n``: merged stretches covered by alignments (``chrom, pos, cigar, seq``)."""
    return merge_intervals(_laid(alignments).select("chrom", F.col("pos").alias("p0"), (F.col("pos") + F.length("row")).alias("p1")), gap)


def _laid(alignments: DataFrame) -> DataFrame:
    return alignments.withColumn("row", apply_cigar(F.col("seq"), F.col("cigar")))


def pair_by_name(alignments: DataFrame) -> DataFrame:
    """``qname, chrom, pos, insert, n``: the mates of a name put together: first position, and the distance from it to the last end."""
    laid = _laid(alignments)
    return laid.groupBy("qname", "chrom").agg(F.min("pos").alias("pos"), (F.max(F.col("pos") + F.length("row")) - F.min("pos")).alias("insert"), F.count(F.lit(1)).alias("n"))


def region_stacks(alignments: DataFrame, regions: DataFrame, bin_size: int = 1024) -> DataFrame:
    """``chrom, p0, p1, qname, row``: each alignment as a row over the region it lies in, gaps at both sides."""
    laid = _laid(alignments).select("qname", "chrom", "pos", "row")
    placed = range_join(laid, regions.select("chrom", "p0", "p1"), bin_size)
    left = F.repeat(F.lit("-"), (F.col("pos") - F.col("p0")).cast("int"))
    right = F.repeat(F.lit("-"), F.greatest(F.col("p1") - F.col("pos") - F.length("row"), F.lit(0)).cast("int"))
    return placed.select("chrom", "p0", "p1", "qname", F.concat(left, "row", right).alias("row"))


def site_places(sites: DataFrame) -> DataFrame:
    """``snp_id, rec_id, pos`` of ``sites(snp_id, rec_id, pos, offset, gaps)``: where each site lies in its consensus read, ``pos + offset - gaps``."""
    return sites.select("snp_id", "rec_id", (F.col("pos") + F.col("offset") - F.col("gaps")).alias("pos"))


def site_depths(sites: DataFrame, columns: DataFrame) -> DataFrame:
    """``snp_id, rec_id, c, a, t, g, dp``: base depths of each site in each consensus read.

    ``sites(snp_id, rec_id, pos, offset, gaps)`` says where a site lies in the
    locus, how much was cut before it and how many gaps precede it; its place in the read is ``pos + offset - gaps``.
    ``columns(rec_id, pos, c, a, t, g)``; a place outside the read counts nothing."""
    # merged: columns are many times the size that a plan takes them for, too large to broadcast
    joined = site_places(sites).join(columns.hint("merge"), ["rec_id", "pos"], "left").fillna(0, ["c", "a", "t", "g"])
    return joined.select("snp_id", "rec_id", "c", "a", "t", "g", F.expr("c + a + t + g").alias("dp"))


def snp_database(variants: DataFrame, block: int = 20000) -> tuple[DataFrame, DataFrame]:
    """(sites, genotypes) of long VCF rows (``chrom, pos, ref, alts, sample, a0, a1, depth``).

    Sites have ``snp_id, scaf, scafpos, locus, alleles``: scaffolds by name,
    loci are ranges of ``block`` positions. Only single-letter alleles are kept."""
    single = (F.length("ref") == 1) & F.forall("alts", lambda a: F.length(a) == 1)
    rows = variants.where(single)
    place = F.xxhash64("chrom", F.floor((F.col("pos") - 1) / block))
    sites = rows.groupBy("chrom", "pos").agg(F.first("ref").alias("ref"), F.first("alts").alias("alts")).select(F.xxhash64("chrom", "pos").alias("snp_id"), F.col("chrom").alias("scaf"), (F.col("pos") - 1).alias("scafpos"), place.alias("locus"), F.array_union(F.array("ref"), "alts").alias("alleles"))
    genos = rows.select(F.xxhash64("chrom", "pos").alias("snp_id"), "sample", "a0", "a1", "depth")
    return sites, genos


def flip_axes(replicates: DataFrame) -> DataFrame:
    """``replicate, flip``: whether an axis of a replicate runs against the first one's: the slope of its
    coordinates on those of replicate 0 is negative. ``replicates(replicate, sample, x)``."""
    first = replicates.where("replicate = 0").select("sample", F.col("x").alias("x0"))
    return replicates.join(first, "sample").groupBy("replicate").agg((F.regr_slope("x", "x0") < 0).alias("flip"))


def locus_spans(sites: DataFrame) -> DataFrame:
    """``locus, first, last, n``: the range of site numbers of each locus, for resampling by locus."""
    return sites.groupBy("locus").agg(F.min("snp_id").alias("first"), F.max("snp_id").alias("last"), F.count(F.lit(1)).alias("n"))


def check_names(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``sample, side``: names that only one of two tables has."""
    a, k = asked.select("sample").distinct(), known.select("sample").distinct()
    return a.join(k, "sample", "left_anti").withColumn("side", F.lit("unknown")).unionByName(k.join(a, "sample", "left_anti").withColumn("side", F.lit("unused")))


def coordinate_sort(alignments: DataFrame, part: int = 1 << 20) -> DataFrame:
    """``alignments`` (with ``chrom, pos, qname``) and their ``place`` on the chromosome, from 0, by position and name: ordered in ranges of ``part``
    positions that are offset by the ranges before, so a hot chromosome is not ordered in one task."""
    ranged = alignments.withColumn("part", F.floor(F.col("pos") / part))
    sizes = ranged.groupBy("chrom", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("chrom", "part", F.coalesce(F.sum("n").over(Window.partitionBy("chrom").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = ranged.withColumn("k", F.row_number().over(Window.partitionBy("chrom", "part").orderBy("pos", "qname")) - 1)
    return inner.join(before, ["chrom", "part"]).withColumn("place", F.col("k") + F.col("before")).drop("part", "k", "before")


def scaffold_numbers(scaffolds: DataFrame) -> DataFrame:
    """``scaffold, chrom``: scaffolds (``name, length``) numbered from 1, in the order of a genome's index: longest first, ties by name."""
    return scaffolds.select(F.col("name").alias("scaffold"), F.row_number().over(Window.orderBy(F.desc("length"), "name")).alias("chrom"))  # the scaffolds of a genome
