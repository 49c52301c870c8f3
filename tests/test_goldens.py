"""Hand-computed results and properties of the reference operators."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from stackloom.functions import sequence as Q
from stackloom.functions.editdist import EncodedStrings, long_distance, pair_distances
from stackloom.operators import cluster_join, intervals, loci, reads, stacks
from stackloom.operators.reports import sample_groups, site_pattern_test
from stackloom.plans.params import DEFAULTS, check
from stackloom.sources import formats, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_edit_distance_against_plain():
    rng = random.Random(1)
    words = ["".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 130, 200]))) for _ in range(40)]
    words += [w[: len(w) // 2] + w[len(w) // 2 + 1 :] for w in words]
    a, b = np.array([rng.randrange(80) for _ in range(150)]), np.array([rng.randrange(80) for _ in range(150)])
    want = [plain_distance(words[i], words[j]) for i, j in zip(a, b)]
    assert pair_distances(EncodedStrings(words), a, b).tolist() == want
    assert [long_distance(words[i], words[j]) for i, j in zip(a, b)] == want
    limit = np.full(150, 10)
    assert all((x == w) if w <= 10 else x > 10 for x, w in zip(pair_distances(EncodedStrings(words), a, b, limit), want))


def test_sequence_functions(spark):
    assert one(spark, Q.complement(F.lit("ACGTn"))) == "TGCAn"
    assert one(spark, Q.full_complement(F.lit("RKYMSW"))) == "YMRKSW"
    s = "ACGTRKYMSWNn-acgt"
    assert one(spark, Q.reverse_complement(Q.reverse_complement(F.lit(s)))) == s
    assert [one(spark, Q.code_of_pair(F.lit(a), F.lit(b))) for a, b in ("AG", "GA", "CC", "AN")] == ["R", "R", "C", "N"]
    assert Q.expand_ambiguous("CWGR") == ["CAGA", "CAGG", "CTGA", "CTGG"]
    assert one(spark, Q.apply_cigar(F.lit("AACCGGTT"), F.lit("2S2M1I1M2D2M"))) == "CCG--TT"
    assert one(spark, Q.make_cigar(F.lit("AC--GT-"))) == "2M2D2M1D"
    assert one(spark, Q.mask_motif(F.lit("TTGCAGTCTGCAA"), "TGCAG")) == "TNNNNNTNNNNNA"
    assert one(spark, Q.genotype_index(F.array(F.lit("A"), F.lit("C")), F.lit("G"))) == 9
    assert [one(spark, g) for g in Q.vcf_genotype(F.lit("0/1:12"))] == [0, 1] and one(spark, Q.vcf_genotype(F.lit("./.:0"))[0]) is None
    assert [one(spark, Q.merge_column(F.lit(a), F.lit(b))) for a, b in ("AA", "AN", "-C", "AC")] == ["A", "A", "C", "N"]
    assert one(spark, Q.clean_name(F.lit("a b/c;d"))) == "a_b_c_d"


def test_sql_functions(spark):
    Q.register(spark)
    assert spark.sql("select revcomp('AACG') a, abundance('x;size=7;+') b, internal_gaps('-A--C-') c").first()[:] == ("CGTT", 7, 2)


def test_base_caller(spark):
    cols = "cluster_id int, pos int, c int, a int, t int, g int, n_all int, gaps int, depth int"
    rows = [(1, 0, 0, 5, 0, 1, 6, 0, 6), (1, 1, 3, 3, 0, 0, 6, 0, 6), (1, 2, 0, 3, 0, 0, 3, 0, 3), (1, 3, 0, 0, 0, 0, 6, 6, 0), (1, 4, 0, 9, 0, 0, 9, 0, 9), (1, 5, 0, 600, 600, 0, 1200, 0, 1200)]
    called = [r["call"] for r in stacks.call_columns(spark.createDataFrame(rows, cols)).orderBy("pos").collect()]
    assert called == ["N", "M", "N", "-", "A", "W"]
    het, prob = stacks.genotype_posterior(5, 1, 0.01, 0.001)
    assert not het and abs(prob - 0.7592) < 5e-4


def test_posterior_limits_are_the_posterior():
    hom, het = stacks.posterior_limits(0.02, 0.005)
    for n in (6, 17, 80, 200):
        for b2 in range(n // 2 + 1):
            is_het, prob = stacks.genotype_posterior(n - b2, b2, 0.02, 0.005)
            want = "N" if prob < 0.95 else "het" if is_het else "hom"
            assert ("hom" if b2 <= hom[n] else "het" if b2 >= het[n] else "N") == want


def test_site_classes(spark):
    rows = [(p, s, b) for p, column in enumerate(["AACC", "AAAC", "AAR", "AAA"]) for s, b in enumerate(column)]
    df = spark.createDataFrame([(1, p, str(s), b) for p, s, b in rows], "locus int, pos int, sample string, base string")
    assert [r["mark"] for r in loci.site_classes(df).orderBy("pos").collect()] == ["*", "-", "-", " "]


def test_watterson(spark):
    df = spark.createDataFrame([(1, p, "p", 3, 1, 0, 0, 4) for p in range(3)], "locus int, pos int, pop string, a int, c int, g int, t int, n int")
    assert round(loci.diversity(df).first()["theta"], 6) == 1.636364
    assert round(loci.diversity(df, parity=True).first()["theta"], 2) == 1.44


def test_intervals(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 25, 30)], "chrom int, p0 bigint, p1 bigint")
    assert [(r["p0"], r["p1"]) for r in intervals.merge_intervals(df).orderBy("p0").collect()] == [(0, 20), (25, 30)]
    rng = random.Random(5)
    spans = [(rng.randrange(3), a, a + rng.randrange(1, 40)) for a in (rng.randrange(3000) for _ in range(300))]
    df = spark.createDataFrame(spans, "chrom int, p0 bigint, p1 bigint")
    whole = intervals.merge_intervals(df).collect()
    assert sorted((r["chrom"], r["p0"], r["p1"], r["n"]) for r in whole) == sorted((r["chrom"], r["p0"], r["p1"], r["n"]) for r in intervals.merge_intervals(df, part=64).collect())
    covered = {(c, x) for c, a, b in spans for x in range(a, b)}
    assert covered == {(r["chrom"], x) for r in whole for x in range(r["p0"], r["p1"])} and sum(r["n"] for r in whole) == 300
    w = intervals.sliding_windows(spark.createDataFrame([(1, 100)], "chrom int, length bigint"), 30, 20).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in w] == [(0, 30), (20, 50), (40, 70), (60, 90)]


def test_barcodes(spark):
    table = spark.createDataFrame([("s", "CATCAT"), ("t", "CATCAA")], "sample string, barcode string")
    out = reads.barcode_neighbours(table.where("sample = 's'"))
    assert out.count() == 25
    both = {r["observed"]: (r["sample"], r["distance"]) for r in reads.barcode_neighbours(table).collect()}
    assert both["CATCAT"] == ("s", 0) and both["CATCAA"] == ("t", 0) and both["CATCAG"] == ("s", 1)


def test_trimming(spark):
    cuts = lambda *quals, **more: list(zip(*(x.tolist() for x in reads.quality_cuts(*reads._matrix(["".join(chr(q + 33) for q in row) for row in quals]), 20, **more))))
    assert cuts([40, 40, 40, 10, 5], [2, 2], [40], []) == [(0, 3), (0, 0), (0, 1), (0, 0)]
    assert cuts([2, 30, 30], [30, 2, 30], both_ends=True) == [(1, 3), (0, 3)]
    starts = lambda adapter, *seqs: reads.adapter_starts(*reads._matrix(list(seqs)), adapter).tolist()
    assert starts("AGATCGGAAGAGC", "ACGTACGTAGATCGGAAG", "ACGTACGTACGTCC", "AGATCGGAAGAGCAGATCGGAAGAGC", "AC") == [8, 14, 0, 2]
    assert reads.adapter_of("TGCAG", "CAT").startswith("CTGCAATG")
    odd = spark.createDataFrame([(1, None, "II"), (2, "ACG", "I"), (3, "", ""), (4, "ACGT", "IIII")], "read_id int, seq string, qual string")
    assert [tuple(r) for r in reads.trim_reads(odd, 20, "AGATCGG").orderBy("read_id").collect()] == [(1, None, "II", None), (2, "ACG", "I", None), (3, "", "", "none"), (4, "ACGT", "IIII", "none")]


def test_merging_and_digest(spark):
    a, b = "A" * 10 + "ACGTTGCATGCATGCAAGTCC", "ACGTTGCATGCATGCAAGTCC" + "G" * 10
    out = reads.merge_overlapping(spark.createDataFrame([(1, a, b), (2, "A" * 30, "C" * 30), (3, None, "A")], "pair bigint, a string, b string")).orderBy("pair").collect()
    assert (out[0]["merged"], out[0]["seq"]) == (True, "A" * 10 + "ACGTTGCATGCATGCAAGTCC" + "G" * 10)
    assert (out[1]["merged"], out[1]["seq"], out[2]["seq"]) == (False, "A" * 30 + "nnnn" + "C" * 30, None)
    d = reads.digest(spark.createDataFrame([(1, "xxGAaaaGAbbbbGAyy")], "rec_id int, seq string"), "GA")
    assert [r["seq"] for r in d.orderBy("fragment").collect()] == ["aaa", "bbbb"]


def test_alignment_keeps_letters():
    rng = random.Random(2)
    seed = "".join(rng.choice("ACGT") for _ in range(60))
    others = [seed[:k] + rng.choice(["", "AC", "T"]) + seed[k + rng.randrange(3) :] for k in (5, 20, 40)]
    out = stacks.centre_star([seed, *others])
    assert len({len(x) for x in out}) == 1 and [x.replace("-", "") for x in out] == [seed, *others]


def test_greedy_clusters_match_plain_greedy(spark):
    rng = random.Random(4)
    seqs = []
    for _ in range(25):
        base = [rng.choice("ACGT") for _ in range(80)]
        for _ in range(rng.randrange(1, 6)):
            s = base.copy()
            for _ in range(rng.randrange(0, 4)):
                s[rng.randrange(80)] = rng.choice("ACGT")
            seqs.append("".join(s))
    rows = [("x", k, s, k) for k, s in enumerate(seqs)]
    out = {r["rec_id"]: r["seed"] for r in cluster_join.cluster_sequences(spark.createDataFrame(rows, "scope string, rec_id bigint, seq string, rank int")).collect()}
    seeds, want = [], {}
    for k, s in enumerate(seqs):
        hit = next((x for x in seeds if 1 - plain_distance(s, seqs[x]) / 80 >= 0.85), None)
        want[k] = k if hit is None else hit
        if hit is None:
            seeds.append(k)
    assert out == want


def test_settings_and_groups(spark):
    assert check({})["clust_threshold"] == 0.85
    back = formats.parse_params(sinks.params_text(DEFAULTS), list(DEFAULTS))
    assert list(back) == list(DEFAULTS) and back["maxdepth"] == "10000"
    g = sample_groups(spark.createDataFrame([(f"s{k:02d}",) for k in range(45)], "sample string"))
    assert sorted(r["count"] for r in g.groupBy("part").count().collect()) == [15, 15, 15]
    counts = spark.createDataFrame([(10.0, 4.0, 2.0, 1000)], "aabb double, abba double, baba double, sites bigint")
    assert [round(x, 6) for x in site_pattern_test(counts).first()[:2]] == [0.008, 0.002] and site_pattern_test(counts).first()["gamma"] == 0.2


def test_project_roundtrip(tmp_path):
    project = {"a": (1, 2), "b": [1, {"c": (3,)}]}
    sinks.save_project(project, str(tmp_path / "p.json"))
    assert formats.load_project(str(tmp_path / "p.json")) == project


def test_text_formats_roundtrip(spark, tmp_path):
    fq = tmp_path / "a.fastq"
    fq.write_text("".join(f"@r{k}\nACGT\n+\n@I+I\n" for k in range(50)))
    back = formats.read_fastq(spark, str(fq))
    assert back.count() == 50 and back.select("seq", "qual").distinct().collect()[0][:] == ("ACGT", "@I+I")
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "37")  # borders fall everywhere in records
    fq.write_text("".join(f"@r{k}\nACGTAC\n+\n{'@@@I@@' if k % 2 else '@II@II'}\n" for k in range(40)))
    split = formats.read_fastq(spark, str(fq))
    assert sorted((r["name"], r["qual"]) for r in split.collect()) == sorted((f"r{k}", "@@@I@@" if k % 2 else "@II@II") for k in range(40))
    spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    (tmp_path / "g.fa").write_text(">one x\nACG\nTT\n>two\nGG\n")
    assert [tuple(r) for r in formats.read_fasta(spark, str(tmp_path / "g.fa")).orderBy("name").collect()] == [("one", "ACGTT", 5), ("two", "GG", 2)]
    (tmp_path / "pops").write_text("a p1\nb p2\n# p1:1 p2:3\n")
    table, least = formats.read_populations(spark, str(tmp_path / "pops"))
    assert table.count() == 2 and least == {"p1": 1, "p2": 3}
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\tt\nc\t5\t.\tA\tC,G\t13\tPASS\t.\tGT:DP\t0/2:7\t./.:0\n")
    v = {r["sample"]: r for r in formats.read_vcf(spark, str(tmp_path / "v.vcf")).collect()}
    assert (v["s"]["a0"], v["s"]["a1"], v["s"]["depth"], v["t"]["a0"]) == (0, 2, 7, None)
    (tmp_path / "c.clust").write_text(">a;size=3;*\nACG\n>b;size=1;+\nAC-\n//\n//\n>d;size=2;*\nTTT\n//\n//\n")
    c = formats.read_clusters(spark, str(tmp_path / "c.clust"))
    assert sorted((r["name"], r["rank"], r["size"], r["orient"], r["seq"]) for r in c.collect()) == [("a", 0, 3, "*", "ACG"), ("b", 1, 1, "+", "AC-"), ("d", 0, 2, "*", "TTT")]
    (tmp_path / "s.sam").write_text("@HD\nq\t0\tc\t11\t60\t4M\t*\t0\t0\tACGT\tIIII\nz\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    kept, rejected = formats.split_alignments(formats.read_sam(spark, str(tmp_path / "s.sam")))
    assert [r["pos"] for r in kept.collect()] == [10] and rejected.count() == 1
    rows = spark.createDataFrame([(1, "a", "acg"), (1, "bb", "ACT")], "locus bigint, sample string, seq string")
    sinks.write_text(sinks.loci_rows(rows, spark.createDataFrame([(1, "  -")], "locus bigint, marks string")), str(tmp_path / "loci"), ["locus"])
    assert sorted((r["locus"], r["sample"], r["seq"]) for r in formats.read_loci(spark, str(tmp_path / "loci")).collect()) == [(1, "a", "ACG"), (1, "bb", "ACT")]
    assert formats.sample_names(["/x/a_R1_.fastq.gz", "/x/a_R2_.fastq.gz"], paired=True) == {"a": ("/x/a_R1_.fastq.gz", "/x/a_R2_.fastq.gz")}


def plain_pairs(seqs, least=0.85):
    enc, n = EncodedStrings(seqs), len(seqs)
    a, b = np.triu_indices(n, 1)
    longer = np.maximum(enc.lengths[a], enc.lengths[b])
    good = 1 - pair_distances(enc, a, b) / longer >= least - 1e-12
    return set(zip(a[good].tolist(), b[good].tolist()))


def found_pairs(spark, seqs, cell=10_000):
    df = spark.createDataFrame([("x", k, s) for k, s in enumerate(seqs)], "scope string, rec_id bigint, seq string")
    found = [(r["a"], r["b"]) for r in cluster_join.similar_records(df, cell=cell).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_a_deep_locus_keeps_all_its_pairs(spark):
    rng = random.Random(7)
    base = "".join(rng.choice("ACGT") for _ in range(90))
    seqs = {base: None}
    while len(seqs) < 1100:  # more than a block, and far more than 200
        s = list(base)
        for at in rng.sample(range(90), 2):
            s[at] = rng.choice([c for c in "ACGT" if c != s[at]])
        seqs["".join(s)] = None
    seqs = list(seqs)
    want = plain_pairs(seqs)
    assert len(want) == 1100 * 1099 // 2 and found_pairs(spark, seqs, 400) == want
    rows = [("x", k, s, k) for k, s in enumerate(seqs)]
    out = cluster_join.cluster_sequences(spark.createDataFrame(rows, "scope string, rec_id bigint, seq string, rank int")).collect()
    assert len(out) == 1100 and {r["seed"] for r in out} == {0}


def test_pairs_near_the_threshold_need_no_shared_kmer(spark):
    rng = random.Random(8)
    seqs = []
    for _ in range(40):
        base = [rng.choice("ACGT") for _ in range(100)]
        other = base.copy()
        edits = rng.randrange(6, 16)
        for at in range(100 // (edits + 1), 100, 100 // (edits + 1))[:edits]:  # no 16 letters stay whole
            other[at] = rng.choice([c for c in "ACGT" if c != base[at]])
        seqs += ["".join(base), "".join(other)]
    want = plain_pairs(seqs)
    assert len(want) == 40 and found_pairs(spark, seqs) == want


def test_long_records_go_the_same_way(spark):
    """Long sequences among short ones, a third of the records one locus, cells of a few records."""
    rng = random.Random(11)
    seqs = []
    for length in (590, 600, 640, 700, 1500, 80, 80):
        base = [rng.choice("ACGT") for _ in range(length)]
        for edits in (0, 3, length // 12, length // 8):
            s = base.copy()
            for _ in range(edits):
                at = rng.randrange(len(s))
                s[at : at + 1] = rng.choice([[], ["A"], [s[at], "C"]])
            seqs.append("".join(s))
    seqs = list(dict.fromkeys(seqs))
    want = plain_pairs(seqs)
    assert len(want) > 20 and found_pairs(spark, seqs) == want and found_pairs(spark, seqs, 12) == want


def test_het_error_uses_deep_columns_all_patterns_and_all_samples(spark):
    rng = np.random.default_rng(3)
    rows = []
    for sample, depth, n in (("deep", 2000, 1500), ("mixed", 40, 1500), ("mixed", 2000, 500)):
        for _ in range(n):
            i, j = rng.permutation(4)[:2]
            p = np.full(4, 0.002 / 3)
            p[i] = 1 - 0.002
            if rng.random() < 0.05:
                p[i] = p[j] = 0.5 * (1 - 2 * 0.002 / 3)
            rows.append((sample, *map(int, rng.multinomial(depth, p / p.sum())), depth))
    rows += [("shallow", 3, 0, 0, 0, 3)] * 4 + [("none", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "sample string, c bigint, a bigint, t bigint, g bigint, depth bigint")
    out = {r["sample"]: r for r in stacks.estimate_het_error(df).collect()}
    assert {s: r["n_columns"] for s, r in out.items()} == {"deep": 1500, "mixed": 2000, "shallow": 0, "none": 0}
    for s in ("deep", "mixed"):
        assert abs(out[s]["hetero_est"] - 0.05) < 0.015 and abs(out[s]["error_est"] - 0.002) < 0.0003
    assert all((out[s]["hetero_est"], out[s]["error_est"]) == (0.01, 0.001) for s in ("shallow", "none"))
    blocks = {r["sample"]: r for r in stacks.estimate_het_error(df, block=7).collect()}
    assert all(abs(blocks[s]["hetero_est"] - out[s]["hetero_est"]) < 1e-6 and blocks[s]["n_columns"] == out[s]["n_columns"] for s in out)


def test_all_reads_of_a_deep_cluster_are_aligned(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("ACGT") for _ in range(50))
    read = lambda s: s[: (k := rng.randrange(1, 49))] + rng.choice(["", "A", "CG", "TTT"]) + s[k + rng.randrange(3) :]
    single = [base, *[read(base) for _ in range(299)]]
    paired = [f"{base}nnnn{base[::-1]}", *[f"{read(base)}nnnn{read(base[::-1])}" for _ in range(249)]]
    mixed = [base, paired[1], base[5:]]
    rows = [(c, k, s) for c, some in enumerate((single, paired, mixed)) for k, s in enumerate(some)]
    df = spark.createDataFrame(rows, "cluster_id bigint, hit_rank int, aligned_seq string")
    out = {(r["cluster_id"], r["hit_rank"]): r["aligned"] for r in stacks.align_stacks(df).collect()}
    halves = [stacks.centre_star([s.split("nnnn")[k] for s in paired]) for k in (0, 1)]
    want = [stacks.centre_star(single), ["nnnn".join(x) for x in zip(*halves)], stacks.centre_star(mixed)]
    assert out == {(c, k): s for c, some in enumerate(want) for k, s in enumerate(some)}
    assert stacks.align_stacks(df, most=200).count() == 403


def test_draws_of_large_locus_numbers(spark):
    at = [(locus, pos) for locus in (5, 1_200_000_000, 2_147_483_646, 2_147_483_647, 8_000_014_968, 2**62) for pos in (0, 3, 80)]
    cells = spark.createDataFrame([(*x, f"s{k}", b) for x in at for k, b in enumerate("AACGTN")], "locus bigint, pos int, sample string, base string")
    pops = spark.createDataFrame([(f"s{k}", "pop_b") for k in range(6)], "sample string, pop string")
    out = {(r["locus"], r["pos"]): r["base"] for r in intervals.consensus_reduce(cells, pops).collect()}
    prime, number = 2**31 - 1, int(hashlib.md5(b"pop_b").hexdigest()[:7], 16)

    def drawn(locus, pos):
        key = (locus % prime * 7919 + pos) * 1048583 + number
        share = ((key % prime * 48271 + 42 * 40503 + 11) % prime * 69621 + 42) % prime / prime
        return next(b for b, upto in zip("ACGT", (2, 3, 4, 5)) if share * 5 < upto)

    assert out == {x: drawn(*x) for x in at}
