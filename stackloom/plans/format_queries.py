"""Queries that make the rows of output files, and streaming ones, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stackloom.functions.sequence import make_cigar
from stackloom.operators import loci as L
from stackloom.operators.reads import digest
from stackloom.operators.rejects import parse_fastq_records
from stackloom.operators.reports import combine_posteriors, divergence_times
from stackloom.operators.snps import allele_counts, clean_calls, populations, site_table, unlinked
from stackloom.plans.locus_queries import _CELLS, _cells
from stackloom.plans.snp_queries import _BASE, _DRAW
from stackloom.sources import sinks as W
from stackloom.sources.tables import table
from stackloom.streaming import reads as T

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _calls(spark, d):
    return clean_calls(table(spark, d, "genos"))


def _sites(spark, d):
    return site_table(table(spark, d, "snp_sites"))


def _locus_rows(spark, d):
    """Each locus as rows of SNP letters; a sample without a column has N."""
    cells = _cells(spark, d)
    columns = cells.groupBy("locus").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    rows = cells.groupBy("locus", "sample").agg(F.map_from_entries(F.collect_list(F.struct("pos", "base"))).alias("m"))
    return rows.join(columns, "locus").select("locus", "sample", F.array_join(F.transform("at", lambda p: F.coalesce(F.col("m")[p], F.lit("N"))), "").alias("seq"))


_ROWS = f"{_CELLS}, lr as (select c.locus, s.sample, string_agg(coalesce(x.base, 'N'), '' order by c.pos) seq from (select distinct locus, pos from cells) c join (select distinct locus, sample from cells) s using (locus) left join cells x on x.locus = c.locus and x.pos = c.pos and x.sample = s.sample group by 1, 2)"


@query(f"""with {_ROWS}, m as (select locus, string_agg(mark, '' order by pos) marks from cls group by 1), w as (select locus, cast(max(length(sample)) + 5 as int) w from lr group by 1),
  b as (select locus, string_agg(rpad(sample, w, ' ') || upper(seq), chr(10) order by rpad(sample, w, ' ') || upper(seq)) body from lr join w using (locus) group by 1)
  select locus, body || chr(10) || rpad('//', w, ' ') || marks || '|' || locus || '|' line from b join w using (locus) join m using (locus)""")
def k02_loci_blocks(spark, d):
    marks = L.site_classes(_cells(spark, d)).groupBy("locus").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mark"))), lambda x: x["mark"]), "").alias("marks"))
    return W.loci_rows(_locus_rows(spark, d), marks)


@query(f"with {_ROWS} select locus, sample || '_' || k sample, case k when 0 then translate(seq, 'RKSYWM', 'GGGTTC') else translate(seq, 'RKSYWM', 'ATCCAA') end seq from lr, (select unnest([0, 1]) k)")
def k03_alleles(spark, d):
    return W.allele_rows(_locus_rows(spark, d))


@query(f"with {_ROWS}, b as (select locus, count(*) n, max(length(seq)) m, string_agg(sample || chr(9) || seq, chr(10) order by sample || chr(9) || seq) body from lr group by 1) select locus, 'locus' || locus || ' ' || n || ' ' || m || chr(10) || body || chr(10) line from b")
def k10_gphocs(spark, d):
    return W.gphocs_rows(_locus_rows(spark, d))


@query(f"with {_ROWS}, b as (select locus, count(*) n, max(length(seq)) m, string_agg('^' || rpad(sample, 20, ' ') || seq, chr(10) order by '^' || rpad(sample, 20, ' ') || seq) body from lr group by 1) select locus, n || ' ' || m || chr(10) || body || chr(10) line from b")
def k21_bpp(spark, d):
    return W.bpp_rows(_locus_rows(spark, d))


@query(f"with {_ROWS} select pop, locus, rpad(sample, 10, ' ') || seq line from lr join pops using (sample)")
def k13_migrate(spark, d):
    return W.migrate_rows(_locus_rows(spark, d), populations(table(spark, d, "imap")))


@query(f"""with {_CELLS}, col as (select distinct locus, pos from cells), s as (select distinct sample from cells), q as (select s.sample, string_agg(coalesce(base, 'N'), '' order by locus, pos) seq from col cross join s left join cells using (locus, pos, sample) group by 1),
  h as (select count(*) n, max(length(seq)) m, max(length(sample)) w from q) select '' k, n || ' ' || m line from h union all select sample, rpad(sample, cast(w + 4 as int), ' ') || seq from q, h""")
def k04_phylip_file(spark, d):
    cells = _cells(spark, d)
    return W.phylip_rows(L.concatenated(cells, cells))


@query(f"""with {_CELLS}, col as (select distinct locus, pos from cells), s as (select distinct sample from cells), q as (select s.sample, string_agg(coalesce(base, 'N'), '' order by locus, pos) seq from col cross join s left join cells using (locus, pos, sample) group by 1), h as (select count(*) n, max(length(seq)) m from q),
  o as (select locus, cast(sum(n_sites) over (order by locus) as bigint) e, n_sites from sites)
  select -1 k, '' sample, '#nexus' || chr(10) || 'begin data;' || chr(10) || '  dimensions ntax=' || n || ' nchar=' || m || ';' || chr(10) || '  format datatype=dna missing=N gap=- interleave=yes;' || chr(10) || '  matrix' line from h
  union all select k, sample, sample || '    ' || substr(seq, k * 100 + 1, 100) from (select sample, seq, unnest(range(0, cast(ceil(length(seq) / 100) as bigint))) k from q)
  union all select 1073741824, '', '  ;' || chr(10) || 'end;' || chr(10) || 'begin sets;' from h union all select 1073741825, lpad(locus::varchar, 12, '0'), '  charset locus_' || locus || ' = ' || (e - n_sites + 1) || '-' || e || ';' from o union all select 1073741826, '', 'end;' from h""")
def k05_nexus_file(spark, d):
    cells = _cells(spark, d)
    sets = L.running_offsets(cells.groupBy("locus").agg(F.countDistinct("pos").alias("length")))
    return W.nexus_rows(L.concatenated(cells, cells), sets)


@query(f"with {_BASE} select sample, rpad(sample, 20, ' ') || string_agg(coalesce(base, 'N'), '' order by snp_id) line from g group by sample")
def k06_snps_rows(spark, d):
    return W.snps_rows(_calls(spark, d))


@query(f"with {_BASE} select snp_id, concat_ws(chr(9), locus, if(scaf is not null, 'scaf' || scaf || ':' || scafpos, 'loc' || locus || '_snp' || locidx || '_pos' || locpos), locpos + 1, snp_id) line from s")
def k06_snpsmap_rows(spark, d):
    return W.snpsmap_rows(_sites(spark, d))


@query(f"with {_BASE}, u as (select snp_id from s qualify row_number() over (partition by locus order by {_DRAW.format('snp_id', 42, 42 * 40503 + 11)}, snp_id) = 1) select sample, rpad(sample, 20, ' ') || string_agg(coalesce(base, 'N'), '' order by snp_id) line from g where snp_id in (select snp_id from u) group by sample")
def k07_unlinked_rows(spark, d):
    return W.snps_rows(_calls(spark, d).join(unlinked(_sites(spark, d)).select("snp_id"), "snp_id", "left_semi"))


_STR = "coalesce(map {{'A': 0, 'T': 1, 'G': 2, 'C': 3}}[translate(base, 'RKSYWM', '{}')], -9)"


@query(f"with {_BASE} select sample, 0 k, rpad(sample, 20, ' ') || repeat(chr(9), 5) || string_agg({_STR.format('GGGTTC')}, chr(9) order by snp_id) line from g group by sample union all select sample, 1, rpad(sample, 20, ' ') || repeat(chr(9), 5) || string_agg({_STR.format('ATCCAA')}, chr(9) order by snp_id) from g group by sample")
def k08_structure_rows(spark, d):
    return W.structure_rows(_calls(spark, d))


@query(f"with {_BASE} select snp_id, string_agg(case when a0 is null or a0 > 1 or a1 > 1 then 9 else 2 - a0 - a1 end, '' order by sample) line from g group by 1")
def k09_geno_rows(spark, d):
    return W.geno_rows(_calls(spark, d))


_POPS = [f"pop_{c}" for c in "abcdefghijkl"]


@query(f"with {_BASE}, t as (select snp_id, string_agg(anc || ',' || der, ' ' order by pop) line, count(*) n from c group by 1) select snp_id, line from t where n = 12")
def k12_treemix_rows(spark, d):
    return W.treemix_rows(allele_counts(_calls(spark, d), populations(table(spark, d, "imap"))), _POPS)


@query(f"""with {_BASE}, n as (select distinct sample from g), u as (select distinct snp_id from g), x as (select u.snp_id, n.sample, if(a0 is null, './.:0', a0 || '/' || a1 || ':' || coalesce(depth, 0)) cell from u cross join n left join g on g.snp_id = u.snp_id and g.sample = n.sample),
  y as (select snp_id, string_agg(cell, chr(9) order by sample) cells from x group by 1), z as (select snp_id, count(a0) ns, coalesce(sum(depth), 0) dp from g group by 1)
  select if(scaf is not null, 'scaf_' || scaf, 'RAD_' || (locus - 1)) chrom, coalesce(scafpos, locpos + 1) pos,
    concat_ws(chr(9), if(scaf is not null, 'scaf_' || scaf, 'RAD_' || (locus - 1)), coalesce(scafpos, locpos + 1), 'loc' || (locus - 1) || '_pos' || locpos, alleles[1], array_to_string(alleles[2:], ','), '13', 'PASS', 'NS=' || ns || ';DP=' || dp, 'GT:DP', cells) line
  from y join z using (snp_id) join s using (snp_id)""")
def k11_vcf_rows(spark, d):
    calls = _calls(spark, d)
    names = [r["sample"] for r in calls.select("sample").distinct().orderBy("sample").collect()]  # the samples of the study
    return W.vcf_rows(calls, _sites(spark, d), names)


@query(f"with {_BASE} select sample, sample || chr(9) || pop line from p")
def k21_map_rows(spark, d):
    return W.map_rows(populations(table(spark, d, "imap")))


@query(r"""select distinct fastq sample, '@' || regexp_extract(raw, '^@([^\n]*?)\r?\n', 1) || chr(10) || regexp_extract(raw, '^[^\n]*\n([ACGTNacgtn]+)\r?\n', 1) || chr(10) || '+' || chr(10) || regexp_extract(raw, '\n\+[^\n]*\n([!-J]+)(\r?\n)?$', 1) line
  from fastqs_raw where regexp_full_match(raw, '@[^\n]*[^\r\n][^\n]*\n[ACGTNacgtn]+\r?\n\+[^\n]*\n[!-J]+(\r?\n)?')
  and length(regexp_extract(raw, '^[^\n]*\n([ACGTNacgtn]+)\r?\n', 1)) = length(regexp_extract(raw, '\n\+[^\n]*\n([!-J]+)(\r?\n)?$', 1))""")
def k01_fastq_rows(spark, d):
    good = parse_fastq_records(table(spark, d, "fastqs_raw")).where("ok")
    return W.fastq_rows(good.select(F.col("fastq").alias("sample"), "name", "seq", "qual")).distinct()


@query("select distinct label name, '>' || label || chr(10) || seqs line from clust_database where label is not null and seqs is not null")
def k17_fasta_rows(spark, d):
    return W.fasta_rows(table(spark, d, "clust_database").select(F.col("label").alias("name"), F.col("seqs").alias("seq")).distinct())


@query("""with b as (select distinct seq_id, sample, label, seqs from clust_database), c as (select *, list_reduce(list_transform(regexp_extract_all(seqs, '-+|[^-]+'), lambda x: length(x) || if(x[1] = '-', 'D', 'M')), lambda a, b: a || b) cigar from b)
  select sample chrom, seq_id * 100 pos, concat_ws(chr(9), label, '0', sample, seq_id * 100 + 1, '30', cigar, '*', '0', '0', replace(seqs, '-', ''), '*') line from c""")
def k16_sam_rows(spark, d):
    base = table(spark, d, "clust_database").distinct().select(F.col("label").alias("name"), F.col("sample").alias("chrom"), (F.col("seq_id") * 100).alias("pos"), make_cigar(F.col("seqs")).alias("cigar"), F.col("seqs").alias("seq"))
    return W.sam_rows(base)


@query("""with b as (select distinct seq_id, seqs seq from clust_database), s as (select seq_id rec_id, string_split(seq, 'GAC') p from b), f as (select rec_id, unnest(range(0, len(p) - 2)) fragment, unnest(p[2:len(p) - 1]) seq from s where len(p) > 2)
  select rec_id, '@' || rec_id || '_' || fragment || '_' || c || chr(10) || seq || chr(10) || '+' || chr(10) || repeat('I', length(seq)) line from f, (select unnest(range(0, 3)) c) where length(seq) > 10""")
def k22_digested_fastq(spark, d):
    base = table(spark, d, "clust_database").select(F.col("seq_id").alias("rec_id"), F.col("seqs").alias("seq")).distinct()
    return W.digested_rows(digest(base, "GAC", None, 10), 3)


@query("select event_type parameter, round(avg(value), 6) mean, round(stddev_samp(value), 6) sd, count(*) n from events group by 1")
def a27_combine_posteriors(spark, d):
    draws = table(spark, d, "events").select(F.col("event_type").alias("parameter"), "value")
    return combine_posteriors(draws).select("parameter", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n")


@query("with p as (select if(event_id % 2 = 0, 'tau_1', 'theta_1') parameter, event_id, value from events) select event_id, parameter, round(if(parameter = 'tau_1', value * 2 / 0.5, value / (4 * 0.5)), 6) \"value\" from p")
def x21_posterior_transform(spark, d):
    draws = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "tau_1").otherwise("theta_1").alias("parameter"), "value")
    return divergence_times(draws, 2.0, 0.5).select("event_id", "parameter", F.round("value", 6).alias("value"))


@query("select l_returnflag, l_linestatus, count(*) n, round(sum(l_quantity), 2) qty from lineitem group by cube (l_returnflag, l_linestatus)")
def a31_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("with e as (select distinct edit_id, sample, mean_q from edits where sample is not null) select edit_id, rank() over w r, dense_rank() over w dr, lag(mean_q) over (partition by sample order by mean_q, edit_id) before from e window w as (partition by sample order by mean_q)")
def w10_ranks(spark, d):
    e = table(spark, d, "edits").where("sample is not null").select("edit_id", "sample", "mean_q").distinct()
    own = Window.partitionBy("sample")
    return e.select("edit_id", F.rank().over(own.orderBy(F.col("mean_q").asc_nulls_last())).alias("r"), F.dense_rank().over(own.orderBy(F.col("mean_q").asc_nulls_last())).alias("dr"), F.lag("mean_q").over(own.orderBy(F.col("mean_q").asc_nulls_last(), "edit_id")).alias("before"))


# ------------------------------------------------------------ streaming


@query("select time_bucket(interval '10 minutes', ts) as start, event_type as \"key\", count(*) n from events group by 1, 2")
def st_windowed_counts(spark, d):
    stream = T.event_stream(spark, d, table(spark, d, "events").schema, "events.parquet", None)
    return T.drain(T.windowed_counts(stream, "event_type"), f"windowed_{abs(hash(d))}").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""with o as (select user_id k, ts, lag(ts) over (partition by user_id order by ts) p from events), s as (select k, ts, sum((p is null or ts >= p + interval '30 minutes')::int) over (partition by k order by ts rows unbounded preceding) i from o)
  select k as "key", min(ts) as start, max(ts) + interval '30 minutes' as "end", count(*) n from s group by k, i""")
def st_sessions(spark, d):
    stream = T.event_stream(spark, d, table(spark, d, "events").schema, "events.parquet", None)
    out = T.drain(T.sessions(stream, "user_id"), f"sessions_{abs(hash(d))}")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))
