"""Operators on within-sample clusters: stacks of aligned reads with abundances.

A stack table has one row for each read of a cluster: ``sample, cluster_id,
hit_rank, size, orient, aligned_seq``; column tables have one row for each
cluster and position with the counts ``c, a, t, g``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.functions.sequence import code_of_pair, count_letter, internal_gaps, trim_terminal
from stackloom.plans.durable import cut, python_tasks

_MAX_DEPTH = 500


def stack_rows(clusters: DataFrame) -> DataFrame:
    """The reads of all clusters, each (cluster, rank) once."""
    return clusters.dropDuplicates(["cluster_id", "hit_rank"])


def cluster_depths(stacks: DataFrame) -> DataFrame:
    """``sample, cluster_id, depth, longest, n_reads``."""
    return stacks.groupBy("sample", "cluster_id").agg(F.sum("size").alias("depth"), F.max(F.length("aligned_seq")).alias("longest"), F.count(F.lit(1)).alias("n_reads"))


def depth_stats(depths: DataFrame, majrule: int = 6, statistical: int = 6) -> DataFrame:
    """For each sample the mean and population deviation of depth over all clusters, those deep enough for
    majority calls and for statistical calls, and the length cap mean + 2 deviations."""
    aggs = [F.count(F.lit(1)).alias("n_clusters")]
    for name, least in (("all", 0), ("mj", majrule), ("stat", statistical)):
        kept = F.when(F.col("depth") >= least, F.col("depth"))
        aggs += [F.count(kept).alias(f"n_{name}"), F.round(F.avg(kept), 6).alias(f"mean_{name}"), F.round(F.stddev_pop(kept), 6).alias(f"sd_{name}")]
    length = F.when(F.col("depth") >= majrule, F.col("longest"))
    return depths.groupBy("sample").agg(*aggs, F.floor(F.avg(length) + 2 * F.stddev_pop(length)).alias("max_len"))


def depth_histogram(depths: DataFrame, bins: int = 25) -> DataFrame:
    """``sample, depth_bin, n``: depths 1 to ``bins``; the last bin holds all deeper clusters."""
    return depths.groupBy("sample", F.least("depth", F.lit(bins)).alias("depth_bin")).agg(F.count(F.lit(1)).alias("n"))


def filter_depth(depths: DataFrame, majrule: int = 6, most: int = 10000) -> DataFrame:
    """Clusters within the depth limits."""
    return depths.where(F.col("depth").between(majrule, most))


def indel_filter(stacks: DataFrame, most: int = 8) -> DataFrame:
    """``cluster_id, gaps, keep``: the largest number of internal gaps of a row, mates apart."""
    parts = F.split("aligned_seq", "nnnn")
    gaps = F.array_max(F.transform(parts, internal_gaps))
    return stacks.groupBy("cluster_id").agg(F.max(gaps).alias("gaps")).withColumn("keep", F.col("gaps") <= most)


def columns_of(stacks: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """``cluster_id, pos, c, a, t, g, depth, gaps, n_rows``: counts of each column weighted by abundance; with ``places(cluster_id, pos)`` of these columns only.

    Letters are exploded and combined in the same stage, before the shuffle."""
    if places is None:
        letters = stacks.select("cluster_id", "size", F.posexplode(F.split(F.upper("aligned_seq"), "")).alias("pos", "base"))
    else:  # merged, since a plan takes compressed sequences for small enough to broadcast
        here = stacks.hint("merge").join(places.select("cluster_id", "pos").distinct(), "cluster_id").where(F.col("pos").between(0, F.length("aligned_seq") - 1)).withColumn("pos", F.col("pos").cast("int"))
        letters = here.select("cluster_id", "size", "pos", F.substring(F.upper("aligned_seq"), F.col("pos") + 1, F.lit(1)).alias("base"))
    n = lambda b: F.sum(F.when(F.col("base") == b, F.col("size")).otherwise(0)).alias(b.lower())
    grouped = letters.groupBy("cluster_id", "pos").agg(*[n(b) for b in "CATG"], F.sum("size").alias("n_all"), F.sum(F.when(F.col("base") == "-", F.col("size")).otherwise(0)).alias("gaps"))
    return grouped.withColumn("depth", F.expr("c + a + t + g"))


def unique_columns(columns: DataFrame) -> DataFrame:
    """``c, a, t, g, n``: identical count patterns and how often they occur."""
    return columns.groupBy("c", "a", "t", "g").agg(F.count(F.lit(1)).alias("n"))


def genotype_posterior(b1: int, b2: int, het: float, error: float) -> tuple[bool, float]:
    """(is heterozygous, probability) of counts ``b1 >= b2`` under binomial sampling with
    heterozygosity ``het`` and error rate ``error``."""
    choose = math.lgamma(b1 + b2 + 1) - math.lgamma(b1 + 1) - math.lgamma(b2 + 1)
    h = het * math.exp(choose - (b1 + b2) * math.log(2))
    first = (1 - het) / 2 * math.exp(choose + b2 * math.log(error) + b1 * math.log(1 - error))
    second = (1 - het) / 2 * math.exp(choose + b1 * math.log(error) + b2 * math.log(1 - error))
    return h > first, max(h, first, second) / (h + first + second)


def posterior_limits(het: float, error: float, least: float = 0.95) -> tuple[list[int], list[int]]:
    """For each total of 0 to 500 the largest second count that is called homozygous, and the smallest
    called heterozygous; between them no call is sure enough. (The posterior is monotone in the second count.)"""
    hom, heterozygous = [], []
    for n in range(_MAX_DEPTH + 1):
        low, high = -1, n + 1
        for b2 in range(n // 2 + 1):
            is_het, prob = genotype_posterior(n - b2, b2, het, error)
            if prob >= least and not is_het:
                low = b2
            if prob >= least and is_het and high > n:
                high = b2
        hom.append(low)
        heterozygous.append(high)
    return hom, heterozygous


def call_columns(columns: DataFrame, het: float = 0.01, error: float = 0.001, majrule: int = 6, statistical: int = 6) -> DataFrame:
    """``columns`` with ``call``: the base, an ambiguity code, N or a gap.

    Only gaps: a gap. Fewer than ``majrule`` bases: N. One kind of base: that
    base. Else of the two most frequent (ties: the smaller letter) by the
    binomial posterior where they are at least ``statistical`` (N under 0.95),
    by majority below (a tie is heterozygous)."""
    ranked = F.sort_array(F.array(*[F.struct((-F.col(b.lower())).alias("n"), F.lit(b).alias("b")) for b in "ACGT"]))
    r = columns.withColumn("r", ranked)
    n1, n2 = -F.col("r")[0]["n"], -F.col("r")[1]["n"]
    b1, b2 = F.col("r")[0]["b"], F.col("r")[1]["b"]
    r = r.select(*columns.columns, n1.cast("int").alias("n1"), n2.cast("int").alias("n2"), b1.alias("b1"), b2.alias("b2"))
    total = F.col("n1") + F.col("n2")
    scale = lambda c: F.when(total > _MAX_DEPTH, F.floor(_MAX_DEPTH * F.col(c) / total)).otherwise(F.col(c)).cast("int")
    # the posterior's decision is two limits on the second count, looked up by the total: cheap, and small when inlined
    hom, heterozygous = (F.array(*[F.lit(x) for x in limits]) for limits in posterior_limits(het, error))
    r = r.withColumn("m2", scale("n2")).withColumn("m", scale("n1") + F.col("m2"))
    both = code_of_pair(F.col("b1"), F.col("b2"))
    statistically = F.when(F.col("m2") <= F.get(hom, F.col("m")), F.col("b1")).when(F.col("m2") >= F.get(heterozygous, F.col("m")), both).otherwise(F.lit("N"))
    majority = F.when(F.col("n1") == F.col("n2"), both).otherwise(F.col("b1"))
    call = (
        F.when((F.col("gaps") == F.col("n_all")) & (F.col("n_all") > 0), "-")
        .when(F.col("depth") < majrule, "N")
        .when(F.col("n2") == 0, F.col("b1"))
        .when(total < majrule, "N")
        .when(total >= statistical, statistically)
        .otherwise(majority)
    )
    return r.select(*columns.columns, call.alias("call"))


def mask_repeats(columns: DataFrame, share: float = 0.8) -> DataFrame:
    """Columns without those of which at least ``share`` of the rows are gaps."""
    return columns.where(F.col("gaps") < share * F.col("n_all"))


def consensus(called: DataFrame) -> DataFrame:
    """``cluster_id, seq, length, n_het, n_missing, cut_left``: the calls of each cluster in order, without terminal N and gaps.

    A cluster's columns are as many as its reads are long, so its array is small."""
    row = called.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "call")))["call"], "").alias("full"))
    seq = row.withColumn("seq", trim_terminal(F.col("full"), "N-"))
    het = F.length("seq") - F.length(F.regexp_replace("seq", "[RKSYWM]", ""))
    return seq.select("cluster_id", "seq", F.length("seq").alias("length"), het.alias("n_het"), count_letter(F.col("seq"), "N").alias("n_missing"), (F.length("full") - F.length(F.regexp_replace("full", "^[N-]+", ""))).alias("cut_left"))


def consensus_filters(cons: DataFrame, max_het: float = 0.05, max_missing: float = 0.05, min_length: int = 35) -> DataFrame:
    """``cons`` with one boolean for each filter it fails, and ``keep``."""
    marked = cons.withColumn("fails_het", F.col("n_het") > F.col("length") * max_het).withColumn("fails_missing", F.col("n_missing") > F.col("length") * max_missing).withColumn("fails_length", F.col("length") < min_length)
    return marked.withColumn("keep", ~(F.col("fails_het") | F.col("fails_missing") | F.col("fails_length")))


def consensus_counters(depths: DataFrame, marked: DataFrame, majrule: int = 6, most: int = 10000) -> DataFrame:
    """``sample`` with the clusters in, dropped by each filter in turn, and kept."""
    both = depths.join(marked, "cluster_id", "left")
    deep = F.col("depth").between(majrule, most)
    return both.groupBy("sample").agg(
        F.count(F.lit(1)).alias("n_clusters"), F.count_if(~deep).alias("filtered_by_depth"), F.count_if(deep & F.col("fails_het")).alias("filtered_by_het"), F.count_if(deep & ~F.col("fails_het") & (F.col("fails_missing") | F.col("fails_length"))).alias("filtered_by_missing"), F.count_if(deep & F.coalesce(F.col("keep"), F.lit(False))).alias("reads_consens")
    )


def haplotypes(stacks: DataFrame, called: DataFrame) -> DataFrame:
    """``cluster_id, haplotype, n``: the bases of each read at the cluster's heterozygous columns, weighted."""
    het = called.where(F.col("call").isin(list("RKSYWM"))).select("cluster_id", "pos")
    letters = stacks.select("cluster_id", "hit_rank", "size", F.posexplode(F.split(F.upper("aligned_seq"), "")).alias("pos", "base")).join(het, ["cluster_id", "pos"])
    each = letters.groupBy("cluster_id", "hit_rank", "size").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "base")))["base"], "").alias("haplotype"))
    return each.where(F.col("haplotype").rlike("^[ACGT]+$")).groupBy("cluster_id", "haplotype").agg(F.sum("size").alias("n"))


def allele_numbers(haps: DataFrame) -> DataFrame:
    """``cluster_id, n_alleles``: haplotypes, of more than two only those with more than max(1, depth // 10) reads."""
    own = haps.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("depth"))
    kept = haps.join(own, "cluster_id").withColumn("counts", (F.col("kinds") <= 2) | (F.col("n") > F.greatest(F.lit(1), F.floor(F.col("depth") / 10))))
    return kept.groupBy("cluster_id").agg(F.count_if("counts").alias("n_alleles"))


def edge_trim(stacks: DataFrame) -> DataFrame:
    """``cluster_id, left, right``: the columns between the start of the seed and the least extended reverse match, from 0, ``right`` exclusive; a
    cluster without reverse matches keeps its right end."""
    seed_start = F.when(F.col("hit_rank") == 0, F.length("aligned_seq") - F.length(F.regexp_replace("aligned_seq", "^-+", "")))
    end = F.when(F.col("orient") == "-", F.length(F.regexp_replace("aligned_seq", "-+$", "")))
    return stacks.groupBy("cluster_id").agg(F.max(seed_start).alias("left"), F.coalesce(F.min(end), F.max(F.length("aligned_seq"))).alias("right"))


def renumber(stacks: DataFrame) -> DataFrame:
    """``sample, cluster_id, name``: clusters of each sample under contiguous numbers, by id."""
    ids = stacks.select("sample", "cluster_id").distinct()
    # numbers by range of ids: ranked within ranges, offset by the ranges before, so a hot sample's ids are ranked in parts
    ranged = ids.withColumn("part", F.floor(F.col("cluster_id") / 65536))
    inner = ranged.withColumn("k", F.row_number().over(Window.partitionBy("sample", "part").orderBy("cluster_id")))
    sizes = ranged.groupBy("sample", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("sample").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return inner.join(before, ["sample", "part"]).select("sample", "cluster_id", F.concat_ws("_", "sample", (F.col("k") + F.col("before") - 1).cast("string")).alias("name"))


# -------------------------------------------------- heterozygosity and error


def _simplex(f, start: np.ndarray, steps: int = 50) -> tuple[np.ndarray, float]:
    """Nelder and Mead's method with the usual coefficients (1, 2, 1/2, 1/2)."""
    n = len(start)
    points = [start] + [start + np.eye(n)[k] * (0.05 * start[k] if start[k] else 0.00025) for k in range(n)]
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values)
        points, values = [points[k] for k in order], [values[k] for k in order]
        middle = np.mean(points[:-1], axis=0)
        reflected = 2 * middle - points[-1]
        at = f(reflected)
        if values[0] <= at < values[-2]:
            points[-1], values[-1] = reflected, at
        elif at < values[0]:
            further = 3 * middle - 2 * points[-1]
            far = f(further)
            points[-1], values[-1] = (further, far) if far < at else (reflected, at)
        else:
            nearer = 0.5 * (middle + (reflected if at < values[-1] else points[-1]))
            near = f(nearer)
            if near < min(at, values[-1]):
                points[-1], values[-1] = nearer, near
            else:
                points = [points[0]] + [0.5 * (points[0] + p) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    k = int(np.argmin(values))
    return points[k], values[k]


class Patterns:
    """Count patterns with what their likelihoods need whatever the parameters."""

    def __init__(self, counts: np.ndarray, weight: np.ndarray, base_share: np.ndarray):
        self.counts, self.weight, self.share = counts, weight, base_share
        self.total = counts.sum(axis=1)
        values, at = np.unique(np.column_stack([counts, self.total]), return_inverse=True)
        log_factorial = np.array([math.lgamma(n + 1) for n in values])[at.reshape(-1, 5)]
        self.multinomial = log_factorial[:, 4] - log_factorial[:, :4].sum(axis=1)

    def negative_log_likelihood(self, het: float, error: float) -> float:
        """Of unordered count patterns, as a mixture of homozygous and heterozygous sites."""
        if not 0 <= het < 1 or not 0 < error < 1:
            return math.inf
        counts, total, share = self.counts, self.total, self.share
        norm = 2 / max(1e-12, 1 - float((share**2).sum()))
        # sums of logarithms: the terms of deep columns are below the smallest float
        like = np.full(len(counts), -np.inf)
        for i in range(4):
            if share[i] > 0:
                like = np.logaddexp(like, math.log((1 - het) * share[i]) + counts[:, i] * math.log(1 - error) + (total - counts[:, i]) * math.log(error / 3))
            for j in range(i + 1, 4):
                if het * share[i] * share[j] > 0:
                    pair = counts[:, i] + counts[:, j]
                    like = np.logaddexp(like, math.log(het * norm * share[i] * share[j]) + pair * math.log(0.5 * (1 - 2 * error / 3)) + (total - pair) * math.log(error / 3))
        return -float((self.weight * (self.multinomial + like)).sum())


def estimate_het_error(columns_by_sample: DataFrame, min_depth: int = 6, block: int = 100_000) -> DataFrame:
    """``sample, hetero_est, error_est, n_columns`` by maximum likelihood, one row for each sample of the input.

    Columns are first reduced to their different count patterns with
    multiplicities (there are few however many columns), so each sample's fit
    reads a small table, ``block`` patterns at a time. All columns of at least
    ``min_depth`` are fitted with their whole counts, however deep. Where the
    fit fails or a sample has no such column, 0.01 and 0.001 stand."""
    usable = F.col("depth") >= min_depth
    patterns = columns_by_sample.select("sample", *[F.when(usable, F.col(b)).alias(b) for b in "catg"]).groupBy("sample", "c", "a", "t", "g").agg(F.count(F.lit(1)).alias("n"))

    def fit(group: pa.Table) -> pa.Table:
        sample, group = group.column("sample")[0].as_py(), group.filter(pc.is_valid(group.column("c")))
        counts = np.column_stack([group.column(b).to_numpy() for b in "catg"]).astype(np.int64)
        weight = group.column("n").to_numpy().astype(float)
        het, error = 0.01, 0.001
        if len(weight):
            bases = (counts * weight[:, None]).sum(axis=0)
            share = bases / max(1.0, bases.sum())
            own = [Patterns(counts[k : k + block], weight[k : k + block], share) for k in range(0, len(weight), block)]
            best, value = _simplex(lambda p: sum(x.negative_log_likelihood(p[0], p[1]) for x in own), np.array([het, error]))
            het, error = best if math.isfinite(value) else (het, error)
        return pa.table({"sample": pa.array([sample], pa.string()), "hetero_est": pa.array([float(het)]), "error_est": pa.array([float(error)]), "n_columns": pa.array([int(weight.sum())])})

    return patterns.repartition(python_tasks(patterns.sparkSession), "sample").groupBy("sample").applyInArrow(fit, "sample string, hetero_est double, error_est double, n_columns bigint")


# ------------------------------------------------------------ alignment


def _align(seed: str, other: str, match: int = 2, mismatch: int = -1, gap: int = -2) -> tuple[str, str]:
    """Global alignment of two sequences; rows of the table are computed at once."""
    n, m = len(seed), len(other)
    if n == m and sum(x != y for x, y in zip(seed, other)) * (match - mismatch) <= match - 2 * gap:
        return seed, other  # two gaps cost as much as these few mismatches
    s, o = np.frombuffer(seed.encode("latin-1", "replace"), np.uint8), np.frombuffer(other.encode("latin-1", "replace"), np.uint8)
    score = np.zeros((n + 1, m + 1), dtype=np.int64)
    score[0] = np.arange(m + 1) * gap
    steps = np.arange(m + 1) * gap
    for i in range(1, n + 1):
        diagonal = score[i - 1, :-1] + np.where(o == s[i - 1], match, mismatch)
        best = np.empty(m + 1, dtype=np.int64)
        best[0] = i * gap
        best[1:] = np.maximum(diagonal, score[i - 1, 1:] + gap)
        score[i] = np.maximum.accumulate(best - steps) + steps  # gaps in the seed, any number in a row
    a, b, i, j = [], [], n, m
    while i or j:
        if i and j and score[i, j] == score[i - 1, j - 1] + (match if s[i - 1] == o[j - 1] else mismatch):
            i, j = i - 1, j - 1
            a.append(seed[i])
            b.append(other[j])
        elif i and score[i, j] == score[i - 1, j] + gap:
            i -= 1
            a.append(seed[i])
            b.append("-")
        else:
            j -= 1
            a.append("-")
            b.append(other[j])
    return "".join(reversed(a)), "".join(reversed(b))


def centre_star(seqs: list[str]) -> list[str]:
    """Rows of a multiple alignment to the first sequence; without their gaps they are the inputs."""
    if not seqs:
        return []
    known = {s: _align(seqs[0], s) for s in dict.fromkeys(seqs[1:])}
    seed, pairs = seqs[0], [known[s] for s in seqs[1:]]
    room = [0] * (len(seed) + 1)
    for a, _ in pairs:
        for at, n in _inserted(a).items():
            room[at] = max(room[at], n)
    return [_lay(seed, seed, room), *[_lay(a, b, room) for a, b in pairs]]


def _inserted(a: str) -> dict[int, int]:
    """How many letters a row puts before each letter of the seed, whose side of the alignment is ``a``."""
    out, at = {}, 0
    for c in a:
        if c == "-":
            out[at] = out.get(at, 0) + 1
        else:
            at += 1
    return out


def _lay(a: str, b: str, room: list[int]) -> str:
    """The row ``b`` with ``room`` columns before each letter of the seed."""
    out, at, run = [], 0, []
    for c, x in zip(a, b):
        if c == "-":
            run.append(x)
        else:
            out.append("".join(run) + "-" * (room[at] - len(run)) + x)
            at, run = at + 1, []
    return "".join(out) + "".join(run) + "-" * (room[at] - len(run))


def align_stacks(stacks: DataFrame, most: int | None = None) -> DataFrame:
    """``cluster_id, hit_rank, aligned``: the reads of each cluster aligned to its seed, mates apart.

    Each read is aligned to the seed for itself; only the largest number of letters put before each letter of the
    seed is gathered by cluster, so a deep cluster is spread over tasks. With ``most`` a cluster keeps its first
    ``most`` reads by rank (the reference's aligner: 200); by default it keeps all."""
    plain = (stacks if most is None else stacks.where(F.col("hit_rank") < most)).select("cluster_id", "hit_rank", F.regexp_replace("aligned_seq", "-", "").alias("seq")).where("length(seq) > 0")
    seeds = plain.groupBy("cluster_id").agg(F.min(F.struct("hit_rank", "seq"))["seq"].alias("seed"), F.bool_and(F.size(F.split("seq", "nnnn")) == 2).alias("mates"))
    each = plain.join(seeds, "cluster_id").select("cluster_id", "hit_rank", "seq", "seed", "mates").repartition(python_tasks(stacks.sparkSession), "cluster_id", "hit_rank")
    spot = "array<struct<part:int,at:int,n:int>>"

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, rooms = [], [], []
            for seq, seed, mates in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                pairs = [_align(x, y) for x, y in zip(seed.split("nnnn"), seq.split("nnnn"))] if mates else [_align(seed, seq)]
                a.append([x for x, _ in pairs])
                b.append([y for _, y in pairs])
                rooms.append([{"part": k, "at": at, "n": n} for k, x in enumerate(a[-1]) for at, n in _inserted(x).items()])
            kinds = pa.list_(pa.struct([("part", pa.int32()), ("at", pa.int32()), ("n", pa.int32())]))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(a, pa.list_(pa.string())), pa.array(b, pa.list_(pa.string())), pa.array(rooms, kinds)], names=["cluster_id", "hit_rank", "a", "b", "room"])

    aligned = cut(each.mapInArrow(align, f"cluster_id bigint, hit_rank int, a array<string>, b array<string>, room {spot}"))
    most_at = aligned.select("cluster_id", F.explode("room").alias("r")).groupBy("cluster_id", "r.part", "r.at").agg(F.max("r.n").alias("n"))
    room = most_at.groupBy("cluster_id").agg(F.collect_list(F.struct("part", "at", "n")).alias("room"))  # at most a seed's letters

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, spots in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                rooms = [[0] * (len(x.replace("-", "")) + 1) for x in a]
                for r in spots or []:
                    rooms[r["part"]][r["at"]] = r["n"]
                out.append("nnnn".join(_lay(x, y, z) for x, y, z in zip(a, b, rooms)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["cluster_id", "hit_rank", "aligned"])

    return aligned.drop("room").join(room, "cluster_id", "left").select("cluster_id", "hit_rank", "a", "b", "room").mapInArrow(lay, "cluster_id bigint, hit_rank int, aligned string")
