"""Skewed keys, rejected rows and filled values on small hand-made tables."""

import math
import random

import pytest

from stackloom.operators.fill import fill_genotypes, fill_population_map, filled_cells, mine_dependencies
from stackloom.operators.rejects import parse_barcode_lines, parse_fastq_records
from stackloom.operators.skew import deep_clusters_per_sample, distinct_per_key, heavy_keys, mode_per_key, percentile_per_key, reads_per_sample


def got(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


# ------------------------------------------------------------ problem 3


def test_distinct_and_mode_with_nulls_ties_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 2, "x"), ("a", 2, "z"), ("b", None, "q"), (None, 3, "q")], "k string, v int, weight string")
    assert got(distinct_per_key(df, "k", "v"), "key", "n_rows", "n_distinct") == sorted([("a", 4, 2), ("b", 1, 0), (None, 1, 1)], key=str)
    assert got(mode_per_key(df, "k", "v"), "key", "mode", "mode_weight") == sorted([("a", 1, 2), ("b", None, None), (None, 3, 1)], key=str)


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_percentile_matches_sorting(spark, share):
    import math

    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("ab"), rng.choice([rng.randrange(10), rng.randrange(100000), None])) for _ in range(3000)] + [("one", 5)] * 4 + [("none", None)]
    out = {r["key"]: r["percentile"] for r in percentile_per_key(spark.createDataFrame(rows, "k string, v int"), "k", "v", share, bins=16).collect()}
    for k in ("hot", "a", "b", "one"):
        values = sorted(v for key, v in rows if key == k and v is not None)
        assert out[k] == values[max(1, math.ceil(len(values) * share)) - 1]
    assert "none" not in out


def test_an_outlier_does_not_gather_a_hot_key(spark):
    from pyspark.sql import functions as F

    values = [*range(3000), 10**12, -(10**9)]
    df = spark.createDataFrame([("hot", v) for v in values] + [("b", 5)], "k string, v bigint")
    for share in (0.01, 0.5, 0.999):
        out = {r["key"]: r["percentile"] for r in percentile_per_key(df, "k", "v", share, bins=16).collect()}
        assert out["hot"] == sorted(values)[math.ceil(len(values) * share) - 1]
    assert percentile_per_key(df.where(F.lit(False)), "k", "v", 0.5).count() == 0


def test_skew_on_empty_tables(spark):
    empty = spark.createDataFrame([], "sample string, read_id bigint, cluster_id bigint, hit_rank int, size bigint")
    assert heavy_keys(reads_per_sample(empty), "n_distinct").count() == 0
    assert heavy_keys(deep_clusters_per_sample(empty), "n_deep").count() == 0


def test_replicates_and_repeats_count_once(spark):
    reads = spark.createDataFrame([(1, "s-technical-replicate-0"), (1, "s-technical-replicate-0"), (2, "s-technical-replicate-1"), (3, None)], "read_id bigint, sample string")
    assert got(reads_per_sample(reads), "key", "n_rows", "n_distinct") == [("s", 3, 2)]
    clusters = spark.createDataFrame([(1, "s", 0, 4), (1, "s", 0, 4), (1, "s", 1, 1), (2, "s", 0, 6), (3, "s", 0, None)], "cluster_id bigint, sample string, hit_rank int, size bigint")
    assert got(deep_clusters_per_sample(clusters), "key", "n_clusters", "n_deep") == [("s", 3, 1)]


# ------------------------------------------------------------ problem 4

FASTQ = {
    "@r\nACGT\n+\nIIII\n": None, "@r\r\nacgn\r\n+r\r\nI!J\"\r\n": None, "@r\nACGT\n+\nIIII": None, "@r x\x1f\x1by\nA\n+\n,": None, "@a\rb\nA\n+\nI": None, "@" + "n" * 5000 + "\n" + "ACGT" * 20000 + "\n+\n" + "I" * 80000: None,
    "@r\nACGT\n+\nIII\n": "quality and sequence differ in length", "@r\nACGX\n+\nIIII": "sequence letter that is not A, C, G, T or N", "@\nA\n+\nI": "empty name", "r\nA\n+\nI": "name line does not start with @", "@r\nA\n-\nI": "third line does not start with +",
    "@r\nA\n+\nK": "quality character outside ! to J", "@r\n\n+\n\n": "empty sequence", "@r\nA\n+": "3 lines instead of 4", "@r\nA\n+\nI\n\n": "5 lines instead of 4", "@r\nA\n+\nI\n@r\nA\n+\nI": "8 lines instead of 4", "": "blank record", " \n": "blank record", None: "null record",
    "@r\nA C\n+\nIII": "sequence letter that is not A, C, G, T or N", "@r\nAC\n+\nI I": "quality character outside ! to J", "@r\nAC\n+\nI\r\n": "quality and sequence differ in length",
}


def test_fastq_rejects(spark):
    texts = list(FASTQ)
    df = spark.createDataFrame([(k, "f", t, k) for k, t in enumerate(texts)], "rec_id int, fastq string, raw string, ok int").repartition(3)
    out = {r["rec_id"]: r for r in parse_fastq_records(df).collect()}
    assert {texts[k]: r["reason"] for k, r in out.items()} == FASTQ
    assert all(r["ok"] == (r["reason"] is None) for r in out.values())
    odd = out[texts.index("@r x\x1f\x1by\nA\n+\n,")]
    assert (odd["name"], odd["seq"], odd["qual"]) == ("r x\x1f\x1by", "A", ",")
    assert out[texts.index("@a\rb\nA\n+\nI")]["name"] == "a\rb"


BARCODES = {
    ("s1 ACGT", "rad"): None, (" s1\t\"acgt\" \r", "rad"): None, ('"s 1" ACGT', "rad"): None, ("s1 ACGT RYK", "pair3rad"): None,
    ("s1 ACGT", "pair3rad"): "2 fields instead of 3", ("s1", "rad"): "1 fields instead of 2", ("s1 ACGT TT", "rad"): "3 fields instead of 2", ('"s1 ACGT', "rad"): "broken quoting", ('s1" ACGT', "rad"): "broken quoting",
    ('"s1"x ACGT', "rad"): "broken quoting", ("s1 ACGU", "rad"): "letter of barcode1 that is no nucleotide code", ("s1 ACG N", "pair3rad"): "letter of barcode2 that is no nucleotide code", ('" " ACGT', "rad"): "blank sample name",
    ('s1 ""', "rad"): "empty barcode1", ("", "rad"): "blank line", (None, "rad"): "null line", ("s1 ACGT", "gbs"): "unknown datatype", ("s1 ACGT", None): "unknown datatype", ("s1\nACGT", "rad"): "line end within a line",
}


def test_barcode_rejects(spark):
    lines = list(BARCODES)
    df = spark.createDataFrame([(k, "f", kind, raw) for k, (raw, kind) in enumerate(lines)], "rec_id bigint, barcodes_file string, datatype string, raw string")
    out = {lines[r["rec_id"]]: r for r in parse_barcode_lines(df).collect()}
    assert {k: r["reason"] for k, r in out.items()} == BARCODES
    assert (out[('"s 1" ACGT', "rad")]["sample"], out[(" s1\t\"acgt\" \r", "rad")]["barcode1"]) == ("s 1", "ACGT")


def test_parsing_empty_tables(spark):
    assert parse_fastq_records(spark.createDataFrame([], "rec_id bigint, fastq string, raw string")).count() == 0
    assert parse_barcode_lines(spark.createDataFrame([], "rec_id bigint, barcodes_file string, datatype string, raw string")).count() == 0


# ------------------------------------------------------------ problem 5


def test_population_map(spark):
    rows = [("a", "pop_a", "s1", 100.0, 1), ("b", "NA", "s1", float("nan"), 1), ("b", "NA", "s1", float("nan"), 1), ("c", None, "s2", 99999.0, 2), ("d", "pop_b", "s3", 50.0, 2), ("e", "pop_b", "s3", None, 2)]
    df = spark.createDataFrame(rows, "sample string, pop string, site string, elev_m double, plate int")
    out = {r["sample"]: r for r in fill_population_map(df).collect()}
    assert len(out) == 5
    assert (out["b"]["pop"], out["b"]["pop_missing"], out["b"]["elev_m"], out["b"]["elev_source"]) == ("pop_a", True, 100.0, "site")
    assert out["c"]["pop"] is not None and out["c"]["elev_missing"]
    assert (out["a"]["pop_missing"], out["a"]["pop_source"]) == (False, None)


def test_dependencies_are_verified(spark):
    df = spark.createDataFrame([("x", "1", "p"), ("x", "1", "q"), ("y", "2", "q"), ("y", "2", "p"), ("z", None, "p")], "a string, b string, c string")
    assert [(d, t) for d, t, _, _ in mine_dependencies(df, [(["a"], "b"), (["a"], "c")])] == [(["a"], "b")]


def test_genotypes(spark):
    sites = spark.createDataFrame([(1, 1, ["A", "C"]), (2, 1, ["G", "T"])], "snp_id bigint, locus bigint, alleles array<string>")
    imap = spark.createDataFrame([(s, "pop_a", "x", 1.0, 1) for s in "pqrstu"], "sample string, pop string, site string, elev_m double, plate int")
    cells = [(1, "p", "A", 0, 0, 5), (1, "q", "M", 0, 1, 7), (1, "r", "M", 9, 9, -1), (1, "s", "N", 0, 0, 9), (1, "t", "", None, None, None), (1, "u", "M", 1, 0, 3), (1, "p", "A", 0, 0, 5), (2, "p", "G", 0, 0, 4)]
    genos = spark.createDataFrame(cells, "snp_id bigint, sample string, base string, a0 int, a1 int, depth int")
    filled = fill_genotypes(genos, sites, imap)
    out = {(r["snp_id"], r["sample"]): r for r in filled.collect()}
    assert len(out) == 7
    r = out[(1, "r")]
    assert (r["a0"], r["a1"], r["geno_missing"], r["depth_missing"]) == (0, 1, True, True) and r["geno_source"].startswith("dependency")
    assert (out[(1, "s")]["base"], out[(1, "s")]["base_missing"]) == ("A", True)
    assert out[(1, "t")]["a0"] is not None and out[(1, "t")]["base"] is not None and out[(1, "t")]["depth"] == 5
    assert (out[(1, "u")]["a0"], out[(1, "u")]["a1"]) == (1, 0)
    found = got(filled_cells(filled, fill_population_map(imap)), "metric", "snp_id", "sample")
    assert found == sorted([("geno", 1, "r"), ("depth", 1, "r"), ("base", 1, "s"), ("geno", 1, "t"), ("base", 1, "t"), ("depth", 1, "t")], key=str)


def test_fill_empty(spark):
    imap = spark.createDataFrame([], "sample string, pop string, site string, elev_m double, plate int")
    genos = spark.createDataFrame([], "snp_id bigint, sample string, base string, a0 int, a1 int, depth int")
    sites = spark.createDataFrame([], "snp_id bigint, locus bigint, alleles array<string>")
    assert fill_genotypes(genos, sites, imap).count() == 0 and fill_population_map(imap).count() == 0


def test_found_cells_need_the_fill(spark):
    from oracle import SF

    from stackloom.plans.problem_queries import p5_found

    plan = p5_found(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "dependency snp_id+base -> genotype" in plan and "locus_call" in plan and "sample_depth" in plan and "Aggregate" in plan


def hidden_cells(spark, folder, share=20):
    """Known cells of every kind hidden by turns, and how many of them each source filled rightly: {(metric, source): (n, right)}."""
    from pyspark.sql import functions as F

    genos, sites, imap = (spark.read.parquet(f"{folder}/{n}.parquet").distinct() for n in ("genos", "snp_sites", "imap"))
    known = fill_genotypes(genos, sites, imap)
    out = {}
    for k, (metric, columns) in enumerate((("geno", ["a0", "a1"]), ("base", ["base"]), ("depth", ["depth"]))):
        turn = F.pmod(F.xxhash64("snp_id", "sample", F.lit(k)), F.lit(share)) == 0
        part = genos.select(*[F.when(turn, None).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in genos.columns])
        truth = known.where(turn & ~F.col(f"{metric}_missing")).select("snp_id", "sample", *[F.col(c).alias(f"{c}_") for c in columns])
        same = F.array_sort(F.array(*columns)) == F.array_sort(F.array(*[f"{c}_" for c in columns])) if metric != "depth" else F.abs(F.col("depth") - F.col("depth_")) <= 0.25 * F.col("depth_")
        filled = fill_genotypes(part, sites, imap).join(truth, ["snp_id", "sample"]).groupBy(f"{metric}_source").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("right"))
        out |= {(metric, r[0]): (r["n"], r["right"]) for r in filled.collect()}
    return out


def test_hidden_cells_come_back(spark):
    from oracle import SF

    out = hidden_cells(spark, SF.replace("0.001", "0.01"))
    print(out)
    right = lambda metric, source: out[metric, source][1] / out[metric, source][0]
    assert right("geno", "dependency snp_id+base -> genotype") > 0.95 and right("base", "dependency snp_id+genotype -> base") > 0.95
