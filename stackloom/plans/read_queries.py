"""Queries over reads, barcodes, similarity clusters and intervals, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stackloom.functions import sequence as Q
from stackloom.operators import cluster_join as C
from stackloom.operators import intervals as I
from stackloom.operators import reads as R
from stackloom.operators.rejects import parse_barcode_lines, parse_fastq_records
from stackloom.operators.snps import site_table
from stackloom.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _edits(spark, d):
    return table(spark, d, "edits").distinct()


def _fastq(spark, d):
    return parse_fastq_records(table(spark, d, "fastqs_raw")).where("ok").dropDuplicates(["rec_id"])


def _barcodes(spark, d):
    """The most frequent barcode of each sample stands for its barcode file."""
    named = table(spark, d, "raw_reads").where("sample is not null and trim(barcode) <> ''")
    n = named.groupBy(F.regexp_replace("sample", "-technical-replicate-.*$", "").alias("sample"), F.upper(F.trim("barcode")).alias("barcode")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("sample").agg(F.min(F.struct((-F.col("n")).alias("n"), "barcode"))["barcode"].alias("barcode"))


_E = "e as (select distinct * from edits)"
_RC = "reverse(translate({}, 'ATCGRKYMatcgrkym', 'TAGCYMRKtagcymrk'))"
_BC = """bn as (select regexp_replace(sample, '-technical-replicate-.*$', '') sample, upper(trim(barcode)) barcode, count(*) n from raw_reads where sample is not null and trim(barcode) <> '' group by 1, 2),
  bc as (select sample, barcode from bn qualify row_number() over (partition by sample order by n desc, barcode) = 1),
  nb as (select barcode observed, sample, barcode, 0 distance from bc union select substr(barcode, 1, i - 1) || l || substr(barcode, i + 1), sample, barcode, 1 from (select *, unnest(range(1, length(barcode) + 1)) i from bc), (select unnest(['C', 'A', 'T', 'G', 'N']) l) where substr(barcode, i, 1) <> l),
  nn as (select observed, sample, distance from nb qualify row_number() over (partition by observed order by distance, sample, barcode) = 1)"""


@query(f"with {_E} select edit_id, substr(seq, 1, 8) barcode, substr(seq, 9) rest from e")
def f01_f04_fixed_barcode(spark, d):
    code = R.fixed_barcode(F.col("seq"), 8)
    return _edits(spark, d).select("edit_id", code.alias("barcode"), R.trim_barcode(F.col("seq"), code).alias("rest"))


@query(f"with {_E} select edit_id, coalesce(nullif(regexp_extract(substr(seq, 1, 24), '^(.*)TGC', 1), ''), nullif(regexp_extract(substr(seq, 1, 24), '^(.*)AGC', 1), '')) barcode from e")
def f02_variable_barcode(spark, d):
    return _edits(spark, d).select("edit_id", R.variable_barcode(F.col("seq"), ["TGC", "AGC"], 20).alias("barcode"))


@query("select read_id, regexp_extract('@x:1:N:0:' || barcode, '([^:+]*)(?:\\+[^:]*)?$', 1) i7 from (select distinct read_id, barcode from raw_reads)")
def f03_header_barcode(spark, d):
    return table(spark, d, "raw_reads").select("read_id", "barcode").distinct().select("read_id", R.header_barcode(F.concat(F.lit("@x:1:N:0:"), "barcode")).alias("i7"))


@query(f"with {_E} select edit_id, substr(seq, 4, greatest(length(seq) - 3 - 5, 0)) trimmed_seq from e")
def f07_hard_trim(spark, d):
    return _edits(spark, d).select("edit_id", R.hard_trim(F.col("seq"), 3, 5).alias("trimmed_seq"))


@query(f"""with {_E}, t as (select edit_id, regexp_replace(seq, '^[Nn]+|[Nn]+$', '', 'g') s from e) select edit_id, s trimmed_seq from t
  where length(s) - length(regexp_replace(s, '[Nn]', '', 'g')) <= 5 and length(s) >= 35""")
def f08_trim_n_filters(spark, d):
    return R.pass_filters(_edits(spark, d)).select("edit_id", "trimmed_seq")


@query(f"with {_E} select sample, edit_id read_id from e where sample is not null qualify row_number() over (partition by sample order by edit_id) <= 100")
def f09_cap_reads(spark, d):
    reads = _edits(spark, d).where("sample is not null").select("sample", F.col("edit_id").alias("read_id"))
    return R.cap_per_sample(reads, 100)


_TRIM = r"""gd as (select rec_id, regexp_extract(any_value(raw), '^[^\n]*\n([ACGTNacgtn]+)\r?\n', 1) seq, regexp_extract(any_value(raw), '\n\+[^\n]*\n([!-J]+)(\r?\n)?$', 1) qual
  from fastqs_raw where regexp_full_match(raw, '@[^\n]*[^\r\n][^\n]*\n[ACGTNacgtn]+\r?\n\+[^\n]*\n[!-J]+(\r?\n)?')
  and length(regexp_extract(raw, '^[^\n]*\n([ACGTNacgtn]+)\r?\n', 1)) = length(regexp_extract(raw, '\n\+[^\n]*\n([!-J]+)(\r?\n)?$', 1)) group by rec_id),
  u as (select rec_id, qual, unnest(range(1, length(qual) + 1)) i from gd), s as (select rec_id, i, sum(53 - ascii(substr(qual, i, 1))) over (partition by rec_id order by i desc) t from u),
  ng as (select rec_id, max(i) ni from s where t < 0 group by 1), bt as (select rec_id, first(i order by t desc, i desc) bi, max(t) mt from s left join ng using (rec_id) where ni is null or i > ni group by 1),
  q as (select rec_id, seq, qual, case when mt > 0 then bi - 1 else length(seq) end stop from gd left join bt using (rec_id)),
  t as (select rec_id, length(seq) whole, substr(seq, 1, stop) seq, substr(qual, 1, stop) qual, instr(substr(seq, 1, stop), 'CTGCAAGATCGGAAGAGC') ex from q),
  c as (select rec_id, seq, unnest(range(0, greatest(length(seq) - 2, 0))) i from t), h as (select rec_id, i, least(18, length(seq) - i) n, hamming(substr('CTGCAAGATCGGAAGAGC', 1, cast(least(18, length(seq) - i) as int)), substr(seq, i + 1, least(18, length(seq) - i))) w from c),
  b as (select rec_id, first(i order by n - 2 * w desc, i) spot from h where w <= floor(0.1::double * n) and n - 2 * w > 0 group by 1),
  f as (select t.*, case when ex > 0 then ex - 1 else coalesce(spot, length(seq)) end kept from t left join b using (rec_id))"""


@query(f"with {_TRIM} select rec_id read_id, substr(seq, 1, kept) seq, substr(qual, 1, kept) qual, case when kept < length(seq) then 'trim_adapter' when length(seq) < whole then 'trim_q' else 'none' end trimmed from f")
def f05_f06_trim_reads(spark, d):
    reads = _fastq(spark, d).select(F.col("rec_id").alias("read_id"), "seq", "qual")
    return R.trim_reads(reads, 20, R.adapter_of("TGCAG"))


@query(f"with {_BC} select observed, sample, distance from nn")
def j01_barcode_neighbours(spark, d):
    return R.barcode_neighbours(_barcodes(spark, d), 1)


@query(f"with {_BC}, r as (select distinct * from raw_reads) select read_id, nn.sample \"match\", distance from r left join nn on observed = upper(trim(r.barcode))")
def j01_j02_demultiplex(spark, d):
    return R.demultiplex(table(spark, d, "raw_reads").distinct(), _barcodes(spark, d)).select("read_id", "match", "distance")


@query(f"with {_BC}, r as (select distinct * from raw_reads) select fastq, count(*) total, count(*) filter (where trim(r.barcode) <> '') with_barcode, count(nn.sample) matched from r left join nn on observed = upper(trim(r.barcode)) group by 1")
def a02_demux_counts(spark, d):
    return R.demultiplex_counts(R.demultiplex(table(spark, d, "raw_reads").distinct(), _barcodes(spark, d)))


@query(f"with {_E} select sample, upper(seq) seq, count(*) size, md5(upper(seq)) md5 from e where length(seq) > 0 group by 1, 2")
def a01_dereplicate(spark, d):
    return R.dereplicate(_edits(spark, d))


@query(f"with {_E}, k as (select sample, least(upper(seq), {_RC.format('upper(seq)')}) seq from e where length(seq) > 0) select sample, seq, count(*) size, md5(seq) md5 from k group by 1, 2")
def a01_dereplicate_strands(spark, d):
    return R.dereplicate(_edits(spark, d), True)


@query("with r as (select distinct * from clusters), t as (select cluster_id, substr(aligned_seq, 1, 1) tag, aligned_seq seq, size from r) select cluster_id, tag, arg_max(seq, struct_pack(a := size, b := seq)) seq, cast(sum(size) as bigint) size from t group by 1, 2")
def a03_declone(spark, d):
    rows = table(spark, d, "clusters").distinct().select("cluster_id", F.substring("aligned_seq", 1, 1).alias("tag"), F.col("aligned_seq").alias("seq"), "size")
    return R.declone(rows)


@query(f"with {_E}, m as (select edit_id, split_part(seq, 'nnnn', 1) a, split_part(seq, 'nnnn', 2) b from e where seq like '%nnnn%') select edit_id pair, a || 'nnnn' || {_RC.format('b')} seq from m")
def j03_x15_pair_join(spark, d):
    both = _edits(spark, d).where(F.contains("seq", F.lit("nnnn")))
    a, b = Q.mates(F.col("seq"))
    return R.join_mates(both.select(F.col("edit_id").alias("pair"), a.alias("seq")), both.select(F.col("edit_id").alias("pair"), b.alias("seq")))


@query(f"""with {_E}, m as (select edit_id, split_part(seq, 'nnnn', 1) a, split_part(seq, 'nnnn', 2) b from e where seq like '%nnnn%'), s as (select *, unnest(range(-(length(b) - 20), length(a) - 19)) st from m where length(a) > 0 and length(b) > 0),
  o as (select *, greatest(0, st) lo, least(length(a), st + length(b)) hi from s), w as (select *, hamming(substr(a, lo + 1, hi - lo), substr(b, lo - st + 1, hi - lo)) wrong from o where hi - lo >= 20),
  k as (select edit_id, first(st order by hi - lo - 4 * wrong desc, st) st from w where wrong <= 4 group by 1), j as (select m.*, st, greatest(0, st) lo, least(length(a), st + length(b)) hi from m left join k using (edit_id)),
  g as (select *, substr(a, 1, lo) || array_to_string(list_transform(range(lo, hi), lambda i: case when substr(a, i + 1, 1) = substr(b, i - st + 1, 1) then substr(a, i + 1, 1) when substr(a, i + 1, 1) = 'N' then substr(b, i - st + 1, 1) when substr(b, i - st + 1, 1) = 'N' then substr(a, i + 1, 1) else 'N' end), '') || if(st + length(b) > length(a), substr(b, hi - st + 1), '') one from j)
  select edit_id pair, coalesce(st is not null and length(one) >= 32, false) merged, case when st is not null and length(one) >= 32 then one else a || 'nnnn' || b end seq from g""")
def j04_merge_pairs(spark, d):
    a, b = Q.mates(F.col("seq"))
    return R.merge_overlapping(_edits(spark, d).where(F.contains("seq", F.lit("nnnn"))).select(F.col("edit_id").alias("pair"), a.alias("a"), b.alias("b")))


@query(f"with {_E} select edit_id, {_RC.format('seq')} rc, translate(seq, 'ACGTacgt', 'TGCATGCA') comp, least(seq, {_RC.format('seq')}) canonical from e")
def x01_x02_x03_complements(spark, d):
    s = F.col("seq")
    return _edits(spark, d).select("edit_id", Q.reverse_complement(s).alias("rc"), Q.complement(s).alias("comp"), Q.canonical_strand(s).alias("canonical"))


@query("with b as (select distinct seq_id, seqs from clust_database) select seq_id, translate(seqs, 'RKSYWMrksywm', 'GGGTTCATCCAA') first, translate(seqs, 'RKSYWMrksywm', 'ATCCAAGGGTTC') \"second\" from b")
def x05_k03_split_alleles(spark, d):
    first, second = Q.split_alleles(F.col("seqs"))
    return table(spark, d, "clust_database").select("seq_id", "seqs").distinct().select("seq_id", first.alias("first"), second.alias("second"))


@query("""with b as (select distinct seq_id, seqs from clust_database), c as (select unnest(['A','C','G','T']) x), p as (select a.x || b.x k, a.x a, b.x b from c a, c b)
  select a, b, coalesce(map {'AG': 'R', 'GA': 'R', 'GT': 'K', 'TG': 'K', 'CG': 'S', 'GC': 'S', 'CT': 'Y', 'TC': 'Y', 'AT': 'W', 'TA': 'W', 'AC': 'M', 'CA': 'M'}[k], a) code from p""")
def x06_x07_pair_codes(spark, d):
    base = spark.createDataFrame([(c,) for c in "ACGT"], "x string")
    pairs = base.select(F.col("x").alias("a"), F.explode(F.array(*[F.lit(c) for c in "ACGT"])).alias("b"))
    return pairs.select("a", "b", Q.code_of_pair(F.col("a"), F.col("b")).alias("code"))


@query("select distinct pair_id, coalesce(cast(nullif(regexp_extract(query_label, 'size=(\\d+)', 1), '') as bigint), 1) size from hit_pairs where query_label is not null")
def x14_abundance(spark, d):
    return table(spark, d, "hit_pairs").where("query_label is not null").select("pair_id", Q.abundance(F.col("query_label")).alias("size")).distinct()


@query(f"with {_E} select edit_id, replace(replace(seq, 'TGCAG', 'NNNNN'), 'CTGCA', 'NNNNN') masked from e")
def f27_x16_mask_motif(spark, d):
    return _edits(spark, d).select("edit_id", Q.mask_motif(F.col("seq"), "TGCAG").alias("masked"))


@query("select distinct rec_id, regexp_replace(raw, '[\\s\"''`!@#$%^&*()+={}\\[\\]|\\\\:;<>,?/]', '_', 'g') clean from barcodes_raw")
def x18_clean_names(spark, d):
    return table(spark, d, "barcodes_raw").select("rec_id", Q.clean_name(F.col("raw")).alias("clean")).distinct()


@query("""with b as (select distinct seq_id, seqs seq from clust_database), s as (select seq_id rec_id, string_split(seq, 'GA') p from b), f as (select rec_id, unnest(range(0, len(p) - 2)) fragment, unnest(p[2:len(p) - 1]) seq from s where len(p) > 2)
  select rec_id, fragment, seq from f where length(seq) > 3 and length(seq) <= 60""")
def x17_m30_digest(spark, d):
    base = table(spark, d, "clust_database").select(F.col("seq_id").alias("rec_id"), F.col("seqs").alias("seq")).distinct()
    return R.digest(base, "GA", None, 3, 60)


@query("with r as (select distinct cluster_id, hit_rank, aligned_seq from clusters), t as (select cluster_id, hit_rank, aligned_seq s, regexp_extract_all(aligned_seq, '-+|[^-]+') runs from r) select cluster_id, hit_rank, list_reduce(list_transform(runs, lambda x: length(x) || if(x[1] = '-', 'D', 'M')), lambda a, b: a || b) cigar, s laid from t")
def x11_x12_cigar(spark, d):
    rows = table(spark, d, "clusters").select("cluster_id", "hit_rank", "aligned_seq").distinct().withColumn("cigar", Q.make_cigar(F.col("aligned_seq")))
    return rows.select("cluster_id", "hit_rank", "cigar", Q.apply_cigar(F.replace("aligned_seq", F.lit("-"), F.lit("")), F.col("cigar")).alias("laid"))


@query("""with b as (select distinct pair_id, substr(query_label, 1, 1) a, substr(target_label, 1, 1) b from hit_pairs)
  select pair_id, case when upper(a) = upper(b) then upper(a) when a is null then upper(b) when b is null then upper(a) else case when upper(a) in ('N', '-') then upper(b) when upper(b) in ('N', '-') then upper(a) else 'N' end end merged from b""")
def x13_merge_columns(spark, d):
    h = table(spark, d, "hit_pairs").select("pair_id", F.upper(F.substring("query_label", 1, 1)).alias("a"), F.upper(F.substring("target_label", 1, 1)).alias("b")).distinct()
    return h.select("pair_id", Q.merge_column(F.col("a"), F.col("b")).alias("merged"))


@query("""with g as (select distinct snp_id, sample, base from genos where regexp_full_match(base, '[ACGT]')), n as (select snp_id, base, count(*) n from g group by 1, 2), s as (select snp_id, n::double / sum(n) over (partition by snp_id) p from n)
  select snp_id, cast(count(*) as double) h0, round(exp(-sum(p * ln(p))), 6) h1, round(1 / sum(p * p), 6) h2 from s group by 1""")
def x20_hill_numbers(spark, d):
    n = table(spark, d, "genos").select("snp_id", "sample", "base").distinct().where(F.col("base").rlike("^[ACGT]$")).groupBy("snp_id", "base").agg(F.count(F.lit(1)).cast("double").alias("n"))
    s = n.groupBy("snp_id").agg(F.collect_list("n").alias("n")).withColumn("p", F.transform("n", lambda x: x / F.aggregate("n", F.lit(0.0), lambda a, y: a + y)))
    return s.select("snp_id", Q.hill_numbers(F.col("p"), 0).alias("h0"), F.round(Q.hill_numbers(F.col("p"), 1), 6).alias("h1"), F.round(Q.hill_numbers(F.col("p"), 2), 6).alias("h2"))


@query(f"with {_E} select edit_id, row_number() over (order by length(seq) desc nulls last, edit_id) place from e")
def t01_t04_length_order(spark, d):
    # the place is a report over all rows: ranked within lengths, offset by the longer ones, so no task orders everything
    e = _edits(spark, d).select("edit_id", F.coalesce(F.length("seq"), F.lit(-1)).alias("len"))
    inner = e.withColumn("k", F.row_number().over(Window.partitionBy("len").orderBy("edit_id")))
    sizes = e.groupBy("len").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("len", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return inner.join(before, "len").select("edit_id", (F.col("k") + F.col("before")).alias("place"))


@query(f"with {_E} select edit_id read_id, -length(seq) length, (((edit_id % 2147483647 * 48271 + 1701137) % 2147483647) * 69621 + 42) % 2147483647 draw from e")
def t02_length_shuffle(spark, d):
    keyed = R.length_shuffle(_edits(spark, d).select(F.col("edit_id").alias("read_id"), "seq"))
    return keyed.select("read_id", "order_key.length", "order_key.draw")


@query("with n as (select sample, count(*) n from raw_reads where sample is not null group by 1) select sample, n, row_number() over (order by n desc, sample) place from n")
def t05_largest_samples(spark, d):
    sizes = table(spark, d, "raw_reads").where("sample is not null").groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "sample")))  # the samples of a study


@query(f"with {_E} select distinct upper(seq) seq from e where seq is not null and upper(seq) not in (select upper(replace(aligned_seq, '-', '')) from clusters where aligned_seq is not null)")
def f33_contaminant_anti_join(spark, d):
    known = table(spark, d, "clusters").select(F.upper(F.replace("aligned_seq", F.lit("-"), F.lit(""))).alias("seq")).distinct()
    return _edits(spark, d).where("seq is not null").select(F.upper("seq").alias("seq")).distinct().join(known, "seq", "left_anti")


@query("select 'edits' source, sample from edits where sample is not null union select 'clusters', sample from clusters where sample is not null")
def u01_u04_union_distinct(spark, d):
    pick = lambda n: table(spark, d, n).where("sample is not null").select(F.lit(n).alias("source"), "sample")
    return pick("edits").unionByName(pick("clusters")).distinct()


@query("(select sample from imap except select sample from edits) union all (select sample from imap intersect select sample from genos)")
def u03_set_operations(spark, d):
    m, e, g = (table(spark, d, n).select("sample") for n in ("imap", "edits", "genos"))
    return m.subtract(e).unionAll(m.intersect(g))


@query("with a as (select sample, count(*) n from edits group by 1), b as (select sample, count(*) n from clusters group by 1) select sample, cast(sum(n) as bigint) n from (select * from a union all select * from b) group by 1")
def j20_u02_merge_assemblies(spark, d):
    n = lambda t: table(spark, d, t).groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
    return n("edits").unionByName(n("clusters")).groupBy("sample").agg(F.sum("n").alias("n"))


@query("with p as (select sample, 'reads' stat, count(*) v from edits group by 1 union all select sample, 'clusters', count(distinct cluster_id) from clusters group by 1) select sample, max(v) filter (where stat = 'reads') reads, max(v) filter (where stat = 'clusters') clusters from p group by 1")
def a28_stats_pivot(spark, d):
    long = table(spark, d, "edits").groupBy("sample").agg(F.count(F.lit(1)).alias("v")).withColumn("stat", F.lit("reads")).unionByName(table(spark, d, "clusters").groupBy("sample").agg(F.countDistinct("cluster_id").alias("v")).withColumn("stat", F.lit("clusters")))
    return long.groupBy("sample").pivot("stat", ["reads", "clusters"]).agg(F.max("v"))


@query("""with r as (select 1 + event_id % 6 k, event_id % 10 rep, min(round(-1000 - value, 6)) lnl from events group by 1, 2), m as (select k, count(*) n, avg(lnl) mean, stddev_samp(lnl) sd from r group by 1),
  a as (select *, lag(mean) over (order by k) p, lead(mean) over (order by k) x from m) select k, n, round(mean, 6) mean_lnl, round(sd, 6) sd_lnl, round(mean - p, 6) d1, round(abs(x - 2 * mean + p), 6) d2, round(abs(x - 2 * mean + p) / sd, 6) delta_k from a""")
def a26_w09_evanno(spark, d):
    from stackloom.operators.reports import evanno_table

    reps = table(spark, d, "events").groupBy((1 + F.col("event_id") % 6).alias("k"), (F.col("event_id") % 10).alias("rep")).agg(F.min(F.round(-1000 - F.col("value"), 6)).alias("lnl"))
    return evanno_table(reps)


@query("with r as (select 1 + event_id % 6 k, event_id % 10 rep, var_pop(value) v from events group by 1, 2) select k, rep, v <= 1.2::double * min(v) over (partition by k) converged from r")
def f36_convergence(spark, d):
    from stackloom.operators.reports import converged

    reps = table(spark, d, "events").groupBy((1 + F.col("event_id") % 6).alias("k"), (F.col("event_id") % 10).alias("rep")).agg(F.var_pop("value").alias("v"))
    return converged(reps, 1.2).select("k", "rep", "converged")


# ------------------------------------------------------------ intervals


def _intervals(spark, d):
    at = F.col("l_partkey") * 37 + F.col("l_linenumber") * 11 + F.col("l_orderkey") % 13
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("chrom"), at.alias("p0"), (at + 20 + F.col("l_quantity").cast("bigint") % 30).alias("p1"))


def _points(spark, d):
    return site_table(table(spark, d, "snp_sites")).where("scaf is not null").select("snp_id", F.col("scaf").alias("chrom"), F.col("scafpos").alias("pos"))


def _loci_spans(spark, d):
    return site_table(table(spark, d, "snp_sites")).where("scaf is not null").groupBy("locus", F.col("scaf").alias("chrom")).agg(F.min("scafpos").alias("p0"), (F.max("scafpos") + 1).alias("p1"))


_IV = "iv as (select l_suppkey % 5 chrom, l_partkey * 37 + l_linenumber * 11 + l_orderkey % 13 p0, l_partkey * 37 + l_linenumber * 11 + l_orderkey % 13 + 20 + cast(l_quantity as bigint) % 30 p1 from lineitem)"
_PT = "pt as (select distinct snp_id, scaf chrom, scafpos pos, locus from snp_sites where scaf is not null), sp as (select locus, chrom, min(pos) p0, max(pos) + 1 p1 from pt group by 1, 2)"
_MERGED = f"{_IV}, u as (select chrom, p0, p1, count(*) n from iv group by all), a as (select *, max(p1) over (partition by chrom order by p0, p1 rows between unbounded preceding and 1 preceding) reach from u), b as (select *, sum((reach is null or p0 > reach)::int) over (partition by chrom order by p0, p1 rows unbounded preceding) island from a), mg as (select chrom, min(p0) p0, max(p1) p1, cast(sum(n) as bigint) n from b group by chrom, island)"


@query(f"with {_MERGED} select * from mg")
def j10_w04_interval_merge(spark, d):
    return I.merge_intervals(_intervals(spark, d))


@query(f"with {_PT} select pt.snp_id, sp.locus, pt.chrom, pos from pt join sp on pt.chrom = sp.chrom and pos >= p0 and pos < p1")
def j09_j11_range_join(spark, d):
    return I.range_join(_points(spark, d), _loci_spans(spark, d), 512).select("snp_id", "locus", "chrom", "pos")


@query(f"with {_PT} select a.chrom, a.p0 a0, a.p1 a1, b.p0 b0, b.p1 b1 from sp a join sp b on a.chrom = b.chrom and a.p0 < b.p1 and b.p0 < a.p1")
def j09_overlap_join(spark, d):
    s = _loci_spans(spark, d)
    return I.overlap_join(s, s, 512)


@query(f"with {_PT}, l as (select chrom, max(pos) + 1 length from pt group by 1) select chrom, unnest(range(0, length - 5000, 2500)) start, unnest(range(0, length - 5000, 2500)) + 5000 \"end\" from l where length > 5000")
def w07_sliding_windows(spark, d):
    return I.sliding_windows(_points(spark, d).groupBy("chrom").agg((F.max("pos") + 1).alias("length")), 5000, 2500)


@query(f"with {_PT}, w as (select *, unnest(range(greatest(cast(floor((pos - 5000) / 2500) as bigint) + 1, 0), pos // 2500 + 1)) k from pt) select chrom, k * 2500 start, count(*) n from w group by 1, 2")
def a22_m27_window_counts(spark, d):
    return I.points_per_window(_points(spark, d), 5000, 2500)


@query(f"with {_PT} select coalesce(a.chrom, b.chrom) chrom, coalesce(n_regions, 0) n_regions, coalesce(covered, 0) covered, coalesce(n_points, 0) n_points from (select chrom, count(*) n_regions, cast(sum(p1 - p0) as bigint) covered from sp group by 1) a full join (select chrom, count(*) n_points from pt group by 1) b using (chrom)")
def a25_scaffold_coverage(spark, d):
    return I.scaffold_coverage(_points(spark, d), _loci_spans(spark, d))


@query("with s as (select distinct snp_id, scaf, scafpos from snp_sites) select snp_id, scaf chrom, scafpos \"position\" from s where scaf = 3 and scafpos between 0 and 49999")
def m25_extract_window(spark, d):
    return I.extract_window(site_table(table(spark, d, "snp_sites")).select("snp_id", F.col("scaf").alias("chrom"), F.col("scafpos").alias("position")), 3, 0, 50000)


def _cells(spark, d):
    from stackloom.plans.locus_queries import _cells

    return _cells(spark, d)


@query("""with c as (select locus, locpos pos, sample, if(regexp_full_match(base, '[ACGTRKSYWM-]'), base, 'N') base from (select distinct * from genos) join (select distinct snp_id, locus, locpos from snp_sites) using (snp_id)),
  s as (select locus, pos from c group by 1, 2 having count(*) filter (where base not in ('N', '-')) >= 10), k as (select c.* from c join s using (locus, pos)), r as (select sample from k group by 1 having count(*) filter (where base not in ('N', '-')) / count(*) >= 0.9)
  select k.* from k join r using (sample)""")
def f30_f31_window_filter(spark, d):
    return I.window_filter(_cells(spark, d), 10, 0.9)


@query("""with c as (select locus, locpos pos, sample, base from (select distinct * from genos) join (select distinct snp_id, locus, locpos from snp_sites) using (snp_id) where regexp_full_match(base, '[ACGTRKSYWM]')),
  p as (select distinct sample, pop from imap where regexp_full_match(pop, 'pop_[a-l]')), n as (select locus, pos, pop, base, count(*) n from c join p using (sample) group by all),
  u as (select *, sum(n) over (partition by locus, pos, pop order by base) upto, sum(n) over (partition by locus, pos, pop) total, (((((locus % 2147483647 * 7919 + pos) * 1048583 + ('0x' || substr(md5(pop), 1, 7))::bigint) % 2147483647 * 48271 + 1701137) % 2147483647) * 69621 + 42) % 2147483647 draw from n)
  select locus, pos, pop, first(base order by upto) base from u where draw / 2147483647::double * total < upto group by 1, 2, 3""")
def a23_consensus_reduce(spark, d):
    from stackloom.operators.snps import populations

    return I.consensus_reduce(_cells(spark, d), populations(table(spark, d, "imap")))


@query("select scaf chrom, count(distinct snp_id) n from snp_sites where scaf is not null group by 1 having max(scafpos) >= 40000")
def f37_scaffold_min_length(spark, d):
    return site_table(table(spark, d, "snp_sites")).where("scaf is not null").groupBy(F.col("scaf").alias("chrom")).agg(F.count(F.lit(1)).alias("n"), F.max("scafpos").alias("longest")).where("longest >= 40000").drop("longest")


@query("with m as (select distinct edit_id, length(split_part(seq, 'nnnn', 1)) + length(split_part(seq, 'nnnn', 2)) ins, length(split_part(seq, 'nnnn', 1)) len from edits where seq like '%nnnn%'), s as (select avg(ins) m, ceil(stddev_samp(ins)) sd, avg(len) l from m) select coalesce(round(if(m > 2 * l, m + 3 * sd - 2 * l, m - l + 3 * sd), 4), 300) max_insert from s")
def m33_insert_size(spark, d):
    a, b = Q.mates(F.col("seq"))
    return I.insert_size(_edits(spark, d).where(F.contains("seq", F.lit("nnnn"))).select((F.length(a) + F.length(b)).alias("insert"), F.length(a).alias("length")))


# ------------------------------------------------------------ similarity


def _ranked(spark, d):
    unique = R.dereplicate(_edits(spark, d).where("sample is not null").withColumn("seq", F.regexp_replace("seq", "nnnn|-", "")))
    # abundance, then length, then the digest: one number that orders as the three do
    rank = F.struct((-F.col("size")).alias("a"), (-F.length("seq")).alias("b"), F.col("md5").alias("c"))
    return unique.select(F.col("sample").alias("scope"), F.xxhash64("sample", "seq").alias("rec_id"), "seq", rank.alias("rank"))


@query(f"""with {_E}, u as (select distinct sample, upper(regexp_replace(seq, 'nnnn|-', '', 'g')) seq from e where sample is not null and length(regexp_replace(seq, 'nnnn|-', '', 'g')) > 0),
  p as (select a.sample, least(a.seq, b.seq) a, greatest(a.seq, b.seq) b, levenshtein(a.seq, b.seq) d, greatest(length(a.seq), length(b.seq)) longer from u a join u b on a.sample = b.sample and a.seq < b.seq and abs(length(a.seq) - length(b.seq)) <= 0.15 * greatest(length(a.seq), length(b.seq)) + 1)
  select sample, a, b, round(1 - d / longer::double, 6) "identity" from p where d <= floor(0.15::double * longer + 1e-9)""")
def j05_similar_pairs(spark, d):
    """The pairs among which centroids are chosen, of the same strand."""
    unique = _ranked(spark, d)
    seq = unique.select(F.col("scope").alias("sample"), "rec_id", "seq")
    pairs = C.similar_records(unique).select(F.col("scope").alias("sample"), "a", "b", F.round("identity", 6).alias("identity"))
    both = pairs.join(seq.select("sample", F.col("rec_id").alias("a"), F.col("seq").alias("x")), ["sample", "a"]).join(seq.select("sample", F.col("rec_id").alias("b"), F.col("seq").alias("y")), ["sample", "b"])
    return both.select("sample", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "identity")


@query()
def j05_cluster_within(spark, d):
    return C.cluster_sequences(_ranked(spark, d))


@query()
def j18_map_reads(spark, d):
    reference = table(spark, d, "clusters").where("hit_rank = 0").select(F.col("label").alias("chrom"), F.upper(F.replace("aligned_seq", F.lit("-"), F.lit(""))).alias("seq")).distinct()
    reads = table(spark, d, "clusters").where("hit_rank > 0").select((F.col("cluster_id") * 1000 + F.col("hit_rank")).alias("read_id"), F.upper(F.replace("aligned_seq", F.lit("-"), F.lit(""))).alias("seq")).distinct()
    return C.map_reads(reads, reference)


@query("with b as (select barcodes_file, count(*) n from barcodes_raw group by 1) select * from b")
def s05_record_count(spark, d):
    return table(spark, d, "barcodes_raw").groupBy("barcodes_file").agg(F.count(F.lit(1)).alias("n"))


_LINE = """bl as (select rec_id, barcodes_file, datatype, regexp_extract(raw, '^[ \\t\\r]*("[^"\\n]*[^"\\s][^"\\n]*"|[^ \\t\\r\\n"]+)', 1) s, regexp_extract_all(raw, '("[RKSYWMCATGrksywmcatg]+"|[RKSYWMCATGrksywmcatg]+)[ \\t\\r]*$', 1) last, raw from barcodes_raw
    where (datatype = 'rad' and regexp_full_match(raw, '[ \\t\\r]*("[^"\\n]*[^"\\s][^"\\n]*"|[^ \\t\\r\\n"]+)[ \\t\\r]+("[RKSYWMCATGrksywmcatg]+"|[RKSYWMCATGrksywmcatg]+)[ \\t\\r]*'))
       or (datatype = 'pair3rad' and regexp_full_match(raw, '[ \\t\\r]*("[^"\\n]*[^"\\s][^"\\n]*"|[^ \\t\\r\\n"]+)([ \\t\\r]+("[RKSYWMCATGrksywmcatg]+"|[RKSYWMCATGrksywmcatg]+)){2}[ \\t\\r]*'))),
  bp as (select rec_id, barcodes_file, trim(s, '"') sample, upper(replace(regexp_replace(trim(substr(trim(raw, ' ' || chr(9) || chr(13)), length(s) + 1), ' ' || chr(9) || chr(13)), '[ \\t\\r]+', '+'), '"', '')) barcode from bl)"""


@query(f"with {_LINE} select barcodes_file, sample, barcode, row_number() over (partition by barcodes_file, sample order by rec_id) - 1 replicate from bp")
def s07_barcode_table(spark, d):
    good = parse_barcode_lines(table(spark, d, "barcodes_raw")).where("ok")
    replicate = Window.partitionBy("barcodes_file", "sample").orderBy("rec_id")
    return good.select("barcodes_file", "sample", F.concat_ws("+", "barcode1", "barcode2").alias("barcode"), (F.row_number().over(replicate) - 1).alias("replicate"))
