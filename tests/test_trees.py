"""Trees, mapping and streaming on small inputs."""

import numpy as np
from oracle import SF

from stackloom.operators import cluster_join, mapping, stacks, trees
from stackloom.plans import mapped_queries
from stackloom.streaming import reads as streams


def test_newick_and_tests():
    root = trees.parse_newick("((a:1,b:2)x:0.5,(c,d[note]));")
    assert root.tips() == ["a", "b", "c", "d"] and root.children[0].name == "x" and root.children[0].children[1].length == 2
    assert trees.tests_from_tree("(((a,b),c),d);") == [("a", "b", "c", "d")]
    assert trees.tests_from_tree("((((a,b),c),d),e);", {"p4": {"e"}, "p3": {"d"}}) == [("a", "b", "d", "e"), ("a", "c", "d", "e"), ("b", "c", "d", "e")]


def test_neighbour_joining_recovers_an_additive_tree():
    names = list("abcde")
    d = np.array([[0, 5, 9, 9, 8], [5, 0, 10, 10, 9], [9, 10, 0, 8, 7], [9, 10, 8, 0, 3], [8, 9, 7, 3, 0]], float)
    splits = {frozenset(n.tips()) for n in trees.parse_newick(trees.neighbour_joining(names, d)).walk()}
    both = splits | {frozenset(names) - s for s in splits}
    assert {frozenset("ab"), frozenset("de")} <= both


def test_clade_support(spark):
    df = spark.createDataFrame([(1, "((a,b),(c,d));"), (2, "((a,c),(b,d));"), (3, None)], "tree_id bigint, newick string")
    out = {r["tree_id"]: r["support"] for r in trees.clade_support(df, {"ab": ["a", "b"]}).collect()}
    assert out == {1: 1.0, 2: 0.0}
    assert trees.tree_nodes(df).where("parent is null").count() == 2


def test_reads_map_to_both_strands(spark):
    import random

    rng = random.Random(1)
    ref = "".join(rng.choice("ACGT") for _ in range(400))
    flip = ref[200:260].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    reads = spark.createDataFrame([(1, ref[100:160]), (2, flip), (3, "A" * 60), (4, ref[300:330] + "T" + ref[331:360])], "read_id bigint, seq string")
    out = {r["read_id"]: (r["pos"], r["strand"]) for r in cluster_join.map_reads(reads, spark.createDataFrame([("c", ref)], "chrom string, seq string")).collect()}
    assert out == {1: (100, "+"), 2: (200, "-"), 4: (300, "+")}


def test_snp_database_and_axes(spark):
    v = spark.createDataFrame([("c", 5, "A", ["C", "G"], "s", 0, 2, 7), ("c", 5, "A", ["C", "G"], "t", None, None, None), ("c", 9, "AT", ["A"], "s", 0, 1, 3)], "chrom string, pos bigint, ref string, alts array<string>, sample string, a0 int, a1 int, depth int")
    sites, genos = mapping.snp_database(v)
    assert [(r["scafpos"], r["alleles"]) for r in sites.collect()] == [(4, ["A", "C", "G"])] and genos.count() == 2
    axes = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0), (0, "c", 4.0), (1, "a", -1.0), (1, "b", -2.1), (1, "c", -3.9)], "replicate int, sample string, x double")
    assert {r["replicate"]: r["flip"] for r in mapping.flip_axes(axes).collect()} == {0: False, 1: True}


def test_dereplicated_stream(spark, tmp_path):
    spark.createDataFrame([("s", "AC"), ("s", "AC"), ("t", "AC")], "sample string, seq string").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = streams.event_stream(spark, str(tmp_path / "in"), "sample string, seq string")
    out = streams.drain(streams.dereplicated_stream(stream), "derep_test")
    assert sorted(map(tuple, out.collect())) == [("s", "AC", 2), ("t", "AC", 1)]


def test_reads_with_mismatches_in_every_stretch_are_placed(spark):
    import random

    rng = random.Random(2)
    other = lambda c: rng.choice([x for x in "ACGT" if x != c])
    refs = ["".join(rng.choice("ACGT") for _ in range(500)) for _ in range(4)]
    rows, want = [], {}
    for k in range(60):
        n, c = rng.choice([15, 36, 60, 90, 101]), rng.randrange(4)
        p, wrong = rng.randrange(500 - n), rng.randrange(n // 10 + 1)
        s = list(refs[c][p : p + n])
        for at in range(wrong):  # evenly spread: no 20 letters stay whole
            at = (2 * at + 1) * n // (2 * wrong)
            s[at] = other(s[at])
        rows.append((k, "".join(s)))
        want[k] = (f"c{c}", p, "+", wrong)
    flipped = [(k + 100, s.translate(str.maketrans("ACGT", "TGCA"))[::-1]) for k, s in rows]
    want |= {k + 100: (c, p, "-", w) for k, (c, p, _, w) in list(want.items())}
    rows += [*flipped, (900, refs[0][450:] + "ACGTA"), (901, "ACGT" * 20), (902, refs[1][100:145] + "T" + refs[1][145:190])]
    want[900] = ("c0", 450, "+", 5)
    reads = spark.createDataFrame(rows, "read_id bigint, seq string")
    reference = spark.createDataFrame([(f"c{k}", r) for k, r in enumerate(refs)], "chrom string, seq string")
    for cell in ({}, {"stretch": 120}):
        found = cluster_join.map_reads(reads, reference, **cell).collect()
        assert len(found) == len(want) and {r["read_id"]: (r["chrom"], r["pos"], r["strand"], r["mismatches"]) for r in found} == want


def test_streams_are_drained_into_files(spark, tmp_path):
    rows = [(str(k % 3), "AC" * (k % 2)) for k in range(12)]
    spark.createDataFrame(rows, "sample string, seq string").repartition(3).write.parquet(str(tmp_path / "in" / "edits.parquet"))  # a table of several files
    spark.createDataFrame(rows, "sample string, seq string").write.parquet(str(tmp_path / "in" / "others.parquet"))
    read = lambda n: streams.event_stream(spark, str(tmp_path / "in"), "sample string, seq string", "edits.parquet", n)
    for n in (1, None):
        out = streams.drain(streams.dereplicated_stream(read(n)), "derep_files")
        assert sorted(map(tuple, out.collect())) == [(s, q, 2) for s in "012" for q in ("", "AC")]
        assert out.inputFiles() and len({f.rpartition("/")[0] for f in out.inputFiles()}) == 1  # not in the driver, and the last batch only
        every = streams.drain(read(n), "all_files", "append")
        assert every.inputFiles() and sorted(map(tuple, every.collect())) == sorted(rows)
    assert streams.drain(streams.event_stream(spark, str(tmp_path), "sample string", "none.parquet"), "no_files", "append").count() == 0


def test_site_depths_take_only_the_columns_of_sites(spark):
    rows = [(1, 0, 5, "ACgT"), (1, 1, 2, "A-CT"), (1, 2, 1, None), (2, 0, 3, "NA"), (3, 0, 4, "")]
    df = spark.createDataFrame(rows, "cluster_id bigint, hit_rank int, size bigint, aligned_seq string")
    sites = spark.createDataFrame([(10 + k, c, p, o, g) for k, (c, p, o, g) in enumerate([(1, 0, 0, 0), (1, 1, 2, 1), (1, 4, 1, 0), (1, 0, 0, 2), (2, 0, 1, 0), (3, 0, 0, 0), (9, 0, 0, 0)])], "snp_id bigint, rec_id bigint, pos int, offset bigint, gaps bigint")
    want = [(10, 1, 0, 7, 0, 0, 7), (11, 1, 2, 0, 0, 5, 7), (12, 1, 0, 0, 0, 0, 0), (13, 1, 0, 0, 0, 0, 0), (14, 2, 0, 3, 0, 0, 3), (15, 3, 0, 0, 0, 0, 0), (16, 9, 0, 0, 0, 0, 0)]
    for places in (None, mapping.site_places(sites).withColumnRenamed("rec_id", "cluster_id")):
        columns = stacks.columns_of(df, places).select(stacks.F.col("cluster_id").alias("rec_id"), "pos", "c", "a", "t", "g")
        assert sorted(map(tuple, mapping.site_depths(sites, columns).collect())) == want
    plan = mapped_queries.j14_site_depths(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("strategy=merge") == 2  # neither letters nor columns can be broadcast


def test_mapping_joins_are_merged(spark, monkeypatch):
    plans, real = [], cluster_join.cut
    monkeypatch.setattr(cluster_join, "cut", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df))[1])
    ref = "".join("ACGT"[k * k % 7 % 4] for k in range(300))
    reads = spark.createDataFrame([(1, ref[20:80]), (2, ref[100:130] + "T" * 30)], "read_id bigint, seq string")
    assert {r["read_id"]: r["pos"] for r in cluster_join.map_reads(reads, spark.createDataFrame([("c", ref)], "chrom string, seq string")).collect()}[1] >= 0
    # pieces, reads and reference would pass for small enough to broadcast
    assert [p.count("strategy=merge") for p in plans] == [p.count("Join ") for p in plans] == [3, 1]
