"""Queries that start from files: text made of the tables is written to the shared folder and read back, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from stackloom.functions.sequence import make_cigar, reverse_complement
from stackloom.operators import loci as L
from stackloom.operators import reads as B
from stackloom.operators import stacks as K
from stackloom.operators.mapping import snp_database
from stackloom.operators.rejects import parse_fastq_records
from stackloom.plans import format_queries as X
from stackloom.plans import locus_queries as LQ
from stackloom.plans import params as P
from stackloom.plans import read_queries as RQ
from stackloom.plans import snp_queries as SQ
from stackloom.plans import stack_queries as KQ
from stackloom.plans.durable import shared_folder
from stackloom.sources import formats as R
from stackloom.sources import sinks as W
from stackloom.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _written(lines, name: str, order=(), partition=()) -> str:
    """The folder that the rows of text were written to."""
    path = shared_folder(lines.sparkSession, name)
    W.write_text(lines, path, order, partition)
    return path


def _raw_text(spark, d):
    """FASTQ text in which bad records stand between good ones, in a folder for each lane."""
    raw = table(spark, d, "fastqs_raw").where("raw is not null").select("rec_id", "fastq", F.col("raw").alias("line")).distinct()
    return _written(raw, "fastq", ["fastq", "rec_id"], ["fastq"])


#: in SQL every line end is doubled, so that records that follow each other do not share one
_RECORDS = r"""tx as (select rec_id, fastq, chr(10) || replace(replace(raw, chr(13) || chr(10), chr(10)), chr(10), chr(10) || chr(10)) || chr(10) t from (select distinct rec_id, fastq, raw from fastqs_raw where raw is not null)),
  cand as (select rec_id, fastq, unnest(regexp_extract_all(t, '\n@[^\n]+\n\n[ACGTNacgtn]+\n\n\+[^\n]*\n\n[!-J]+\n')) r from tx),
  rec as (select rec_id, fastq, regexp_extract(r, '^\n@([^\n]+)\n', 1) name, regexp_extract(r, '^\n@[^\n]+\n\n([^\n]+)\n', 1) seq, regexp_extract(r, '\n([^\n]+)\n$', 1) qual from cand),
  good as (select * from rec where length(seq) = length(qual))"""


@query(f"with {_RECORDS} select name, seq, qual from good")
def s01_scan_fastq(spark, d):
    return R.read_fastq(spark, _raw_text(spark, d)).select("name", "seq", "qual")


@query("with f as (select fastq, sum(1 + length(raw) - length(replace(raw, chr(10), ''))) - sum((raw like '%' || chr(10))::int) n from (select distinct rec_id, fastq, raw from fastqs_raw where raw is not null and raw not like '%' || chr(10)) group by 1) select fastq, cast(floor(n / 4) as bigint) records from f")
def s05_file_records(spark, d):
    raw = table(spark, d, "fastqs_raw").where("raw is not null and not endswith(raw, '\n')").select("rec_id", "fastq", F.col("raw").alias("line")).distinct()
    path = shared_folder(spark, "counted")
    W.write_text(raw.repartition("fastq").sortWithinPartitions("rec_id"), path, (), ["fastq"])
    return R.record_counts(spark, path).select(F.regexp_extract("file", "fastq=([^/]*)/", 1).alias("fastq"), "records")


def _lanes(spark, d):
    """The valid records of each lane and their reverse complements as second mates, in the same order; two folders of files."""
    good = parse_fastq_records(table(spark, d, "fastqs_raw")).where("ok").dropDuplicates(["rec_id"])
    good = good.select("rec_id", F.pmod("rec_id", F.lit(8)).alias("bucket"), "name", "seq", "qual").repartition(8, "bucket").sortWithinPartitions("bucket", "rec_id")
    first = F.format_string("@%s\n%s\n+\n%s", "name", "seq", "qual")
    second = F.format_string("@%s\n%s\n+\n%s", F.replace("name", F.lit(" 1:"), F.lit(" 2:")), reverse_complement(F.col("seq")), F.reverse("qual"))
    paths = [shared_folder(spark, n) for n in ("R1", "R2")]
    for path, line in zip(paths, (first, second)):
        W.write_text(good.select("bucket", line.alias("line")), path, (), ["bucket"])
    return paths


_GOOD = r"""gd as (select rec_id, any_value(fastq) fastq, regexp_extract(any_value(raw), '^@([^\n]*?)\r?\n', 1) name, regexp_extract(any_value(raw), '^[^\n]*\n([ACGTNacgtn]+)\r?\n', 1) seq, regexp_extract(any_value(raw), '\n\+[^\n]*\n([!-J]+)(\r?\n)?$', 1) qual
  from fastqs_raw where regexp_full_match(raw, '@[^\n]*[^\r\n][^\n]*\n[ACGTNacgtn]+\r?\n\+[^\n]*\n[!-J]+(\r?\n)?')
  and length(regexp_extract(raw, '^[^\n]*\n([ACGTNacgtn]+)\r?\n', 1)) = length(regexp_extract(raw, '\n\+[^\n]*\n([!-J]+)(\r?\n)?$', 1)) group by rec_id)"""
_RC = "reverse(translate({}, 'ATCGRKYMatcgrkym', 'TAGCYMRKtagcymrk'))"


@query(f"with {_GOOD} select name, seq, qual, {_RC.format('seq')} seq2, reverse(qual) qual2, row_number() over (partition by rec_id % 8 order by rec_id) - 1 ordinal from gd")
def s02_scan_pairs(spark, d):
    return R.read_fastq_pairs(spark, *_lanes(spark, d), key=r"(bucket=\d+)").drop("pair_file")


@query("select fastq, count(distinct rec_id) records from fastqs_raw where raw is not null and trim(raw, ' ' || chr(9) || chr(10) || chr(13)) <> '' group by 1")
def s06_estimate_records(spark, d):
    even = table(spark, d, "fastqs_raw").where(F.col("raw").rlike(r"[^ \t\r\n]")).select("rec_id", "fastq").distinct().select("rec_id", "fastq", F.format_string("@%d\nACGT\n+\nIIII", "rec_id").alias("line"))
    path = shared_folder(spark, "estimated")
    W.write_text(even.repartition("fastq").sortWithinPartitions("rec_id"), path, (), ["fastq"])
    return R.estimate_records(spark, path).select(F.regexp_extract("file", "fastq=([^/]*)/", 1).alias("fastq"), F.col("estimate").alias("records"))


# ------------------------------------------------------------ names and small files


@query("with f as (select distinct fastq from raw_reads) select fastq, regexp_replace(regexp_replace(fastq, '[.](fastq|fq)([.]gz)?$', ''), '_R1_?$', '') name from f")
def s03_sample_names(spark, d):
    paths = [r["fastq"] for r in table(spark, d, "raw_reads").where("fastq is not null").select("fastq").distinct().collect()]  # the files of a study
    names = R.sample_names(paths)
    return spark.createDataFrame([(p, n) for n, (p, *_) in names.items()] if len(names) == len(paths) else [(p, next(iter(R.sample_names([p])))) for p in paths], "fastq string, name string")


@query("select distinct fastq, split_part(regexp_replace(fastq, '[.](fastq|fq)([.]gz)?$', ''), '_', 1) name from raw_reads where fastq is not null")
def s04_name_fields(spark, d):
    return table(spark, d, "raw_reads").where("fastq is not null").select("fastq").distinct().select("fastq", R.name_from_path(F.col("fastq"), "_", [0]).alias("name"))


@query(f"with {SQ._BASE}, n as (select pop, 1 + (ascii(substr(pop, 5, 1)) - 97) % 3 least from p group by 1) select sample, pop, cast(least as bigint) least from p join n using (pop)")
def s08_population_file(spark, d):
    pops = SQ._pops(spark, d)
    least = pops.select("pop").distinct().select(F.concat(F.lit("# "), "pop", F.lit(":"), (1 + (F.ascii(F.substring("pop", 5, 1)) - 97) % 3).cast("string")).alias("line"))
    rows, minima = R.read_populations(spark, _written(pops.select(F.concat_ws(" ", "sample", "pop").alias("line")).unionByName(least), "pops"))
    return rows.withColumn("least", F.create_map(*[F.lit(x) for p in sorted(minima.items()) for x in p])[F.col("pop")].cast("bigint"))


@query("with " + KQ._ROWS + """ select cast(cluster_id as varchar) || '_' || hit_rank name, cast(row_number() over (partition by cluster_id order by hit_rank) - 1 as int) rank, coalesce(size, 0) size, seq from r where seq is not null""")
def s09_clusters_file(spark, d):
    rows = K.stack_rows(table(spark, d, "clusters")).where("aligned_seq is not null")
    path = _written(W.cluster_rows(rows.select("cluster_id", "hit_rank", F.concat_ws("_", F.col("cluster_id").cast("string"), F.col("hit_rank").cast("string")).alias("name"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("orient", F.lit("+")).alias("orient"), F.col("aligned_seq").alias("seq"))), "clust", ["cluster_id"])
    return R.read_clusters(spark, path).select("name", "rank", "size", "seq")


@query(f"with {SQ._BASE}, v as (select if(scaf is not null, 'scaf_' || scaf, 'RAD_' || (locus - 1)) chrom, coalesce(scafpos, locpos + 1) pos, alleles[1] ref, sample, a0, a1, coalesce(depth, 0) depth from g join s using (snp_id)) select chrom, pos, ref, sample, a0, a1, if(a0 is null, 0, depth) depth from v")
def s12_vcf_file(spark, d):
    return _read_vcf(spark, d).where("a0 is not null or known").select("chrom", "pos", "ref", "sample", "a0", "a1", "depth")


def _read_vcf(spark, d):
    """The genotypes written as VCF and read back; cells that the table has not (they are written as missing too) are left out."""
    calls = SQ._calls(spark, d)
    names = [r["sample"] for r in calls.select("sample").distinct().orderBy("sample").collect()]  # the samples of the study
    lines = W.vcf_rows(calls, SQ._sites(spark, d), names)
    head = spark.createDataFrame([("", -1, line) for line in W.vcf_header(names).split("\n")], "chrom string, pos bigint, line string")
    read = R.read_vcf(spark, _written(head.unionByName(lines), "vcf", ["chrom", "pos"]))
    places = SQ._sites(spark, d).select("snp_id", F.when(F.col("scaf").isNotNull(), F.format_string("scaf_%d", "scaf")).otherwise(F.format_string("RAD_%d", F.col("locus") - 1)).alias("chrom"), F.coalesce("scafpos", F.col("locpos") + 1).alias("pos"), F.get("alleles", F.lit(0)).alias("ref"))
    present = calls.select("snp_id", "sample").join(places, "snp_id").select("chrom", "pos", "ref", "sample", F.lit(True).alias("known"))
    return read.join(present, ["chrom", "pos", "ref", "sample"])


@query(f"with {SQ._BASE} select if(scaf is not null, 'scaf_' || scaf, 'RAD_' || (locus - 1)) scaf, coalesce(scafpos, locpos + 1) - 1 scafpos, alleles from s where snp_id in (select snp_id from g)")
def m31_snp_database(spark, d):
    return snp_database(_read_vcf(spark, d))[0].select("scaf", "scafpos", "alleles")


@query("select distinct label name, seqs seq, length(seqs) length from clust_database where label is not null and seqs is not null")
def s13_fasta_file(spark, d):
    return R.read_fasta(spark, _written(X.k17_fasta_rows(spark, d), "fasta", ["name"]))


@query(f"with {X._ROWS} select locus, sample, upper(seq) seq from lr")
def s17_loci_file(spark, d):
    return R.read_loci(spark, _written(X.k02_loci_blocks(spark, d), "loci", ["locus"]))


def _shown(value) -> str:
    return (", ".join(map(str, value)) if isinstance(value, tuple) else "" if value is None else str(value)).strip().strip(",").strip()


@query(" union all ".join(f"select {k} k, '{n}' \"name\", '{_shown(v)}' \"value\"" for k, (n, v) in enumerate(P.DEFAULTS.items())))
def s15_params_file(spark, d):
    text = W.params_text(P.check({}))
    path = _written(spark.createDataFrame([(k, line) for k, line in enumerate(text.splitlines())], "k int, line string").coalesce(1).sortWithinPartitions("k"), "params")
    read = R.parse_params("\n".join(r["value"] for r in spark.read.text(path).collect()), list(P.DEFAULTS))  # some thirty lines
    return spark.createDataFrame([(k, n, _shown(v)) for k, (n, v) in enumerate(read.items())], "k int, name string, value string")


@query(" union all ".join(f"select '{n}' \"name\", {'true' if isinstance(v, tuple) else 'false'} \"is_tuple\", '{_shown(v)}' \"value\"" for n, v in P.DEFAULTS.items()))
def s16_k19_project_file(spark, d):
    path = _written(spark.createDataFrame([(json.dumps(W.marked(P.check({}))),)], "line string").coalesce(1), "project")
    back = R.restored(json.loads(spark.read.text(path).first()["value"]))
    return spark.createDataFrame([(n, isinstance(v, tuple), _shown(v)) for n, v in back.items()], "name string, is_tuple boolean, value string")


_WINDOWS = f"with {RQ._PT}, w as (select chrom, pos // 5000 * 5000 start, count(*) n from pt group by 1, 2) select 'chrom_' || chrom scaffold, start, start + 5000 \"end\", 5000 sites, n snps, 0 samples, round(n / 5000, 6) missing, '(a,b);' tree from w"


@query(_WINDOWS)
def s18_tree_table(spark, d):
    own = RQ._points(spark, d).groupBy("chrom", (F.floor(F.col("pos") / 5000) * 5000).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    rows = own.select(F.format_string("chrom_%d", "chrom").alias("scaffold"), "start", (F.col("start") + 5000).alias("end"), F.lit(5000).alias("sites"), F.col("n").alias("snps"), F.lit(0).alias("samples"), F.round(F.col("n") / 5000, 6).alias("missing"), F.lit("(a,b);").alias("tree"))
    path = shared_folder(spark, "trees")
    rows.write.option("header", True).csv(path)
    return R.read_tree_table(spark, path)


@query("with r as (select 1 + event_id % 6 k, event_id % 10 rep, min(round(-1000 - value, 1)) lnl from events group by 1, 2) select k, lnl est_lnlik, lnl - 5 mean_lnlik, 12.5::double var_lnlik from r")
def s20_structure_output(spark, d):
    reps = table(spark, d, "events").groupBy((1 + F.col("event_id") % 6).alias("k"), (F.col("event_id") % 10).alias("rep")).agg(F.min(F.round(-1000 - F.col("value"), 1)).alias("lnl"))
    text = F.format_string("Run parameters:\n   %d populations assumed\nEstimated Ln Prob of Data   = %.1f\nMean value of ln likelihood = %.1f\nVariance of ln likelihood   = 12.5", "k", "lnl", F.col("lnl") - 5)
    path = shared_folder(spark, "structure")
    W.write_text(reps.select("k", "rep", text.alias("line")), path, (), ["k", "rep"])
    return R.parse_structure_output(spark, f"{path}/*/*/*.txt").drop("file")


@query("with r as (select event_id % 4 m, event_id % 9 rep, round(max(value) * 10, 3) l from events group by 1, 2) select m migrations, -l llik from r")
def s20_treemix_output(spark, d):
    reps = table(spark, d, "events").groupBy((F.col("event_id") % 4).alias("m"), (F.col("event_id") % 9).alias("rep")).agg(F.round(F.max("value") * 10, 3).alias("l"))
    path = shared_folder(spark, "treemix")
    W.write_text(reps.select("m", "rep", F.format_string("Starting ln(likelihood) with 0 migration events: -99999.5 \nExiting ln(likelihood) with %d migration events: %.3f ", "m", -F.col("l")).alias("line")), path, (), ["m", "rep"])
    return R.parse_treemix_llik(spark, f"{path}/*/*/*.txt").select("migrations", "llik")


@query("select event_type parameter, round(avg(value), 4) mean, count(*) draws from events group by 1")
def s20_posterior_table(spark, d):
    rows = table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("m"), F.count(F.lit(1)).alias("n"))
    lines = rows.select(F.lit(2).alias("k"), F.concat_ws("\t", "event_type", F.col("m").cast("string"), F.col("n").cast("string")).alias("line"))
    head = spark.createDataFrame([(0, "[ID: 0123456789]"), (1, "Parameter\tMean\tDraws")], "k int, line string")
    read = R.parse_posterior_table(spark, _written(head.unionByName(lines).coalesce(1).sortWithinPartitions("k"), "pstat"))
    return read.select(F.col("row").alias("parameter"), F.col("values")["Mean"].try_cast("double").alias("mean"), F.col("values")["Draws"].try_cast("bigint").alias("draws"))


@query("with b as (select seq_id, any_value(sample) sample, any_value(depth) depth from clust_database group by 1) select cast(seq_id as varchar) qname, seq_id % 7 * 10 mapq from b where seq_id % 7 * 10 >= 30 and seq_id % 5 not in (1, 2)")
def f32_alignment_filter(spark, d):
    base = table(spark, d, "clust_database").groupBy("seq_id").agg(F.first("sample").alias("sample"))
    flag = F.when(F.col("seq_id") % 5 == 1, 4).when(F.col("seq_id") % 5 == 2, 0x904).when(F.col("seq_id") % 5 == 3, 16).otherwise(0)
    line = F.concat_ws("\t", F.col("seq_id").cast("string"), flag.cast("string"), F.lit("c"), F.lit("1"), (F.col("seq_id") % 7 * 10).cast("string"), F.lit("4M"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("ACGT"), F.lit("IIII"))
    kept, _ = R.split_alignments(R.read_sam(spark, _written(base.select(line.alias("line")), "sam")))
    return kept.select("qname", "mapq")


# ------------------------------------------------------------ databases, windows and reports


_DATABASE = f"with {X._ROWS} select locus, sample, seq from lr where locus between 10 and 60"


@query(_DATABASE)
def k14_s10_seq_database(spark, d):
    """Sequences of loci as a database partitioned by ranges of loci, of which a slice is read."""
    path = shared_folder(spark, "seqs")
    W.write_database(X._locus_rows(spark, d), path, "locus", 32)
    return W.read_slice(spark, path, "locus", 10, 60, 32)


@query(f"with {SQ._BASE} select snp_id, sample, a0, a1, depth from g where snp_id between 100 and 300")
def k14_s11_snp_database(spark, d):
    path = shared_folder(spark, "snps")
    W.write_database(SQ._calls(spark, d).select("snp_id", "sample", "a0", "a1", "depth"), path, "snp_id", 128)
    return W.read_slice(spark, path, "snp_id", 100, 300, 128)


@query(f"with {KQ._COLS} select cluster_id, pos, c, a, t, g from cols where cluster_id between 50 and 400")
def k15_depth_database(spark, d):
    path = shared_folder(spark, "catg")
    W.write_database(KQ._deep_columns(spark, d).select("cluster_id", "pos", "c", "a", "t", "g"), path, "cluster_id", 256)
    return W.read_slice(spark, path, "cluster_id", 50, 400, 256)


def _text(sql: str, stage: str, columns: list[tuple[str, int]]) -> str:
    head = "".join(n.ljust(w) if not k else n.rjust(w) for k, (n, w) in enumerate(columns))
    cells = " || ".join(f"rpad(coalesce(cast({n} as varchar), ''), {w}, ' ')" if not k else f"lpad(coalesce(cast({n} as varchar), ''), {w}, ' ')" for k, (n, w) in enumerate(columns))
    return f"select '{stage}' stage, '' k, '{head}' line union all select '{stage}', coalesce(cast({columns[0][0]} as varchar), ''), {cells} from ({sql})"


_S1 = [("fastq", 35), ("total", 13), ("with_barcode", 13), ("matched", 13)]
_S3 = [("sample", 35), ("n_clusters", 13), ("n_mj", 13), ("n_stat", 13)]
_S5 = [("sample", 35), ("n_clusters", 13), ("filtered_by_depth", 19), ("filtered_by_het", 17), ("filtered_by_missing", 21), ("reads_consens", 15)]
_S7 = [("sample", 35), ("n_loci", 13)]


@query(" union all ".join(_text(sql, stage, columns) for sql, stage, columns in ((RQ.ORACLE_SQL["a02_demux_counts"], "s1", _S1), (KQ.ORACLE_SQL["a05_depth_stats"], "s3", _S3), (KQ.ORACLE_SQL["a11_step_counters"], "s5", _S5), (LQ.ORACLE_SQL["a16_sample_coverage"], "s7", _S7))))
def k18_stats_text(spark, d):
    tables = (("s1", RQ.a02_demux_counts, _S1), ("s3", KQ.a05_depth_stats, _S3), ("s5", KQ.a11_step_counters, _S5), ("s7", LQ.a16_sample_coverage, _S7))
    out = None
    for stage, made, columns in tables:
        one = W.stats_rows(made(spark, d), columns).select(F.lit(stage).alias("stage"), "k", "line")
        out = one if out is None else out.unionByName(one)
    return out


_WINDOW = f"""with {SQ._BASE}, n as (select distinct sample from g), u as (select snp_id from s where scaf = 3 and scafpos between 0 and 49999 and snp_id in (select snp_id from g)), q as (select n.sample, string_agg(coalesce(base, 'N'), '' order by u.snp_id) seq from u cross join n left join g on g.snp_id = u.snp_id and g.sample = n.sample group by 1)"""


def _window_rows(spark, d):
    """The bases of all samples at the sites of a window, as sequences."""
    from stackloom.operators.intervals import extract_window

    sites = extract_window(SQ._sites(spark, d).select("snp_id", F.col("scaf").alias("chrom"), F.col("scafpos").alias("position")), 3, 0, 50000)
    calls = SQ._calls(spark, d)
    cells = calls.join(sites.select("snp_id"), "snp_id").select(F.lit(0).alias("locus"), F.col("snp_id").alias("pos"), "sample", F.coalesce("base", F.lit("N")).alias("base"))
    return L.concatenated(cells, calls.select("sample"))


@query(_WINDOW + ", h as (select count(*) n, coalesce(max(length(seq)), 0) m from q) select '' k, n || ' ' || m line from h union all select sample, sample || ' ' || seq from q")
def k20_window_phylip(spark, d):
    return W.phylip_rows(_window_rows(spark, d), plain=True)


@query(_WINDOW + " select sample name, '>' || sample || chr(10) || seq line from q")
def k20_window_fasta(spark, d):
    return W.fasta_rows(_window_rows(spark, d).select(F.col("sample").alias("name"), "seq"))


@query(f"with {X._ROWS}, k as (select locus from sites where n_pis >= 2), w as (select locus, count(*) n, max(length(seq)) m from lr where locus in (select locus from k) group by 1) select locus, '' \"name\", n || ' ' || m line from w union all select locus, sample, sample || ' ' || seq from lr where locus in (select locus from k)")
def m26_extract_loci(spark, d):
    chosen = L.informative_sites(L.site_classes(X._cells(spark, d))).where("n_pis >= 2").select("locus")
    return W.locus_phylip_rows(X._locus_rows(spark, d).join(chosen, "locus", "left_semi"))


# ------------------------------------------------------------ streams


@query(RQ.ORACLE_SQL["j01_j02_demultiplex"].replace("r as (select distinct * from raw_reads) select read_id", "r as (select * from raw_reads) select read_id").replace('read_id, nn.sample "match", distance', 'read_id, nn.sample "match"'))
def st_demultiplex(spark, d):
    from stackloom.streaming import reads as T

    stream = T.event_stream(spark, d, table(spark, d, "raw_reads").schema, "raw_reads.parquet", None)
    return T.drain(T.demultiplexed_stream(stream, RQ._barcodes(spark, d)).select("read_id", "match"), "demultiplexed", "append")


@query("select sample, seq, count(*) size from edits group by 1, 2")
def st_dereplicate(spark, d):
    from stackloom.streaming import reads as T

    stream = T.event_stream(spark, d, table(spark, d, "edits").schema, "edits.parquet", None)
    return T.drain(T.dereplicated_stream(stream), "dereplicated")
