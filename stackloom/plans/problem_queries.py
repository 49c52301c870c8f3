"""The queries of the general data problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackloom.operators.fill import fill_genotypes, fill_population_map, filled_cells
from stackloom.operators.rejects import parse_barcode_lines, parse_fastq_records
from stackloom.operators.skew import deep_clusters_per_sample, heavy_keys, mode_per_key, percentile_per_key, plain_sample, reads_per_sample
from stackloom.sources.tables import table


def p3_found(spark, d):
    reads = heavy_keys(reads_per_sample(table(spark, d, "raw_reads")), "n_distinct")
    deep = heavy_keys(deep_clusters_per_sample(table(spark, d, "clusters")), "n_deep")
    return reads.select(F.lit("reads_raw").alias("metric"), F.col("key").alias("sample")).unionByName(deep.select(F.lit("clusters_hidepth").alias("metric"), F.col("key").alias("sample")))


def p3_per_sample(spark, d):
    """Reads and clusters of each sample, the modal barcode and the median read length."""
    raw = table(spark, d, "raw_reads").where("sample is not null").select(plain_sample(F.col("sample")).alias("sample"), "read_id", "barcode", "read_len")
    reads = reads_per_sample(table(spark, d, "raw_reads")).select(F.col("key").alias("sample"), F.col("n_rows").alias("reads_rows"), F.col("n_distinct").alias("reads_raw"))
    modal = mode_per_key(raw, "sample", "barcode").select(F.col("key").alias("sample"), F.col("mode").alias("modal_barcode"))
    median = percentile_per_key(raw, "sample", "read_len", 0.5).select(F.col("key").alias("sample"), F.col("percentile").alias("median_len"))
    deep = deep_clusters_per_sample(table(spark, d, "clusters")).select(F.col("key").alias("sample"), "n_clusters", F.col("n_deep").alias("clusters_hidepth"))
    return reads.join(modal, "sample", "left").join(median, "sample", "left").join(deep, "sample", "full")


def p4_found(spark, d):
    reads = parse_fastq_records(table(spark, d, "fastqs_raw")).where("not ok").select(F.lit("fastqs").alias("record_kind"), "rec_id")
    lines = parse_barcode_lines(table(spark, d, "barcodes_raw")).where("not ok").select(F.lit("barcodes").alias("record_kind"), "rec_id")
    return reads.unionByName(lines).distinct()


def p4_fastqs(spark, d):
    return parse_fastq_records(table(spark, d, "fastqs_raw"))


def p4_barcodes(spark, d):
    return parse_barcode_lines(table(spark, d, "barcodes_raw"))


def _filled(spark, d):
    imap = table(spark, d, "imap")
    return fill_genotypes(table(spark, d, "genos"), table(spark, d, "snp_sites"), imap), fill_population_map(imap)


def p5_found(spark, d):
    return filled_cells(*_filled(spark, d)).select("metric", "snp_id", "sample").distinct()


def p5_genotypes(spark, d):
    return _filled(spark, d)[0]


def p5_populations(spark, d):
    return fill_population_map(table(spark, d, "imap"))


QUERIES = {f.__name__: f for f in (p3_found, p3_per_sample, p4_found, p4_fastqs, p4_barcodes, p5_found, p5_genotypes, p5_populations)}

_PLAIN = "regexp_replace(sample, '-technical-replicate-.*$', '')"
_DEEP = """select sample, cluster_id, sum(coalesce(size, 0)) depth from
           (select sample, cluster_id, hit_rank, max(size) size from clusters where sample is not null group by all) group by all"""

_PEOPLE = """
        m as (select distinct sample, case when regexp_full_match(pop, 'pop_[a-l]') then pop end pop, site, case when elev_m between 0 and 4500 then elev_m end elev_m, plate from imap),
        d1 as (select site, if(min(pop) = max(pop), min(pop), null) fd1, count(*) n from m where site is not null and pop is not null group by 1),
        d2 as (select plate, if(min(pop) = max(pop), min(pop), null) fd2, count(*) n from m where plate is not null and pop is not null group by 1),
        d3 as (select site, plate, if(min(pop) = max(pop), min(pop), null) fd3, count(*) n from m where site is not null and plate is not null and pop is not null group by 1, 2),
        v as (select coalesce((select sum(n) filter (where fd1 is null) / sum(n) from d1 where n > 1), if((select count(*) from d1 where n > 1) > 0, 0, 1)) s1, coalesce((select sum(n) filter (where fd2 is null) / sum(n) from d2 where n > 1), if((select count(*) from d2 where n > 1) > 0, 0, 1)) s2,
          coalesce((select sum(n) filter (where fd3 is null) / sum(n) from d3 where n > 1), if((select count(*) from d3 where n > 1) > 0, 0, 1)) s3),
        sm as (select site, pop site_pop from (select site, pop, count(*) n from m where pop is not null group by 1, 2) qualify row_number() over (partition by site order by n desc, pop) = 1),
        am as (select pop any_pop from (select pop, count(*) n from m where pop is not null group by 1) order by n desc, pop limit 1),
        j as (select m.*, if(s1 <= 0.02, fd1, null) f1, if(s2 <= 0.02, fd2, null) f2, if(s3 <= 0.02, fd3, null) f3, site_pop, any_pop from m cross join v left join am on true left join d1 using (site) left join d2 using (plate) left join d3 on d3.site = m.site and d3.plate = m.plate left join sm on sm.site = m.site),
        k as (select sample, coalesce(pop, f1, f2, f3, site_pop, any_pop) pop, site, elev_m e, plate, pop is null pop_missing,
          case when pop is null then case when f1 is not null then 'dependency site -> pop' when f2 is not null then 'dependency plate -> pop' when f3 is not null then 'dependency site+plate -> pop' when site_pop is not null then 'site' when any_pop is not null then 'all' else 'unfilled' end end pop_source from j),
        w as (select k.*, se, pe, ae from k left join (select site, avg(e) se from k group by 1) using (site) left join (select pop, avg(e) pe from k group by 1) using (pop) cross join (select avg(e) ae from k)),
        people as (select sample, pop, site, coalesce(e, se, pe, ae) elev_m, plate, pop_missing, pop_source, e is null elev_missing, case when e is null then case when se is not null then 'site' when pe is not null then 'pop' when ae is not null then 'all' else 'unfilled' end end elev_source from w)"""
#: cells as lists that order as their versions do, and the statistics of each site by kind and key
_CELLS = _PEOPLE + """,
        x as (select snp_id, sample, if(a0 between 0 and 3 and a1 between 0 and 3, a0, null) a0, if(a0 between 0 and 3 and a1 between 0 and 3, a1, null) a1, if(regexp_full_match(base, '[ACGTRKSYWM]'), ascii(base), null) base, if(depth >= 0, depth, null) depth from genos),
        y as (select snp_id, sample, max([(a0 is not null)::int + (base is not null)::int + (depth is not null)::int, coalesce(least(a0, a1) * 4 + greatest(a0, a1) + 1, 0), coalesce(a0 + 1, 0), coalesce(a1 + 1, 0), coalesce(base + 1, 0), coalesce(depth + 1, 0)]) l from x group by 1, 2),
        c as (select y.snp_id, y.sample, p.pop, locus, nullif(l[2], 0) - 1 call, nullif(l[3], 0) - 1 a0, nullif(l[4], 0) - 1 a1, nullif(l[5], 0) - 1 base, nullif(l[6], 0) - 1 depth from y left join (select sample, min(pop) pop from people group by 1) p using (sample) left join (select snp_id, min(locus) locus from snp_sites group by 1) s using (snp_id)),
        f as (select snp_id, 'sc' kind, '' key, call value from c union all select snp_id, 'sb', '', base from c union all select snp_id, 'pc', pop, call from c union all select snp_id, 'pb', pop, base from c union all select snp_id, 'bc', base::varchar, call from c union all select snp_id, 'cb', call::varchar, base from c),
        fn as (select snp_id, kind, key, value, count(*) n from f where key is not null and value is not null group by all),
        st as (select snp_id, kind, key, first(value order by n desc, value) value, sum(n) support, count(*) = 1 one from fn group by all),
        vi as (select kind, sum(support) filter (where not one) / sum(support) share from st where support > 1 group by 1),
        dm as (select snp_id, 'sd' kind, '' key, quantile_disc(depth, 0.5) value from c where depth is not null group by 1 union all select snp_id, 'pd', pop, quantile_disc(depth, 0.5) from c where depth is not null and pop is not null group by 1, 3),
        lc as (select locus, first(call order by n desc, call) locus_call from (select locus, call, count(*) n from c where call is not null group by 1, 2) group by 1),
        sd as (select sample, quantile_disc(depth, 0.5) sample_depth from c where depth is not null group by 1),
        ab as (select first(base order by n desc, chr(base)) any_base from (select base, count(*) n from c where base is not null group by 1)),
        z as (select c.*, (select coalesce(max(share), 0) <= 0.02 from vi where kind = 'bc') vbc, (select coalesce(max(share), 0) <= 0.02 from vi where kind = 'cb') vcb, bc.value fbc, cb.value fcb, pc.value fpc, pb.value fpb, sc.value fsc, sb.value fsb, pd.value fpd, xd.value fsd, locus_call, sample_depth, any_base, (select cast(floor(quantile_cont(depth, 0.5)) as int) from c) any_depth from c
          left join st bc on bc.snp_id = c.snp_id and bc.kind = 'bc' and bc.key = c.base::varchar and bc.one left join st cb on cb.snp_id = c.snp_id and cb.kind = 'cb' and cb.key = c.call::varchar and cb.one
          left join st pc on pc.snp_id = c.snp_id and pc.kind = 'pc' and pc.key = c.pop left join st pb on pb.snp_id = c.snp_id and pb.kind = 'pb' and pb.key = c.pop left join st sc on sc.snp_id = c.snp_id and sc.kind = 'sc' left join st sb on sb.snp_id = c.snp_id and sb.kind = 'sb'
          left join dm pd on pd.snp_id = c.snp_id and pd.kind = 'pd' and pd.key = c.pop left join dm xd on xd.snp_id = c.snp_id and xd.kind = 'sd' left join lc on lc.locus = c.locus left join sd on sd.sample = c.sample cross join ab),
        q as (select *, coalesce(call, if(vbc, fbc, null), fpc, fsc, locus_call, 0) g from z)"""

ORACLE_SQL = {
    "p5_populations": f"with {_PEOPLE} select * from people",
    "p5_genotypes": f"""with {_CELLS} select snp_id, sample, cast(coalesce(a0, g // 4) as int) a0, cast(coalesce(a1, g % 4) as int) a1, chr(cast(coalesce(base, if(vcb, fcb, null), fpb, fsb, any_base) as int)) base, cast(coalesce(depth, fpd, fsd, sample_depth, any_depth) as int) depth,
        call is null geno_missing, case when call is null then case when vbc and fbc is not null then 'dependency snp_id+base -> genotype' when fpc is not null then 'site and population' when fsc is not null then 'site' when locus_call is not null then 'locus' else 'first allele' end end geno_source,
        base is null base_missing, case when base is null then case when vcb and fcb is not null then 'dependency snp_id+genotype -> base' when fpb is not null then 'site and population' when fsb is not null then 'site' when any_base is not null then 'all' else 'unfilled' end end base_source,
        depth is null depth_missing, case when depth is null then case when fpd is not null then 'site and population' when fsd is not null then 'site' when sample_depth is not null then 'sample' when any_depth is not null then 'all' else 'unfilled' end end depth_source from q""",
    "p3_found": f"""
        with r as (select {_PLAIN} sample, count(distinct read_id) n from raw_reads where sample is not null group by 1),
        c as (select sample, count(*) filter (where depth >= 6) n from ({_DEEP}) group by 1)
        select 'reads_raw' metric, sample from r where n >= 0.05 * (select sum(n) from r)
        union all select 'clusters_hidepth', sample from c where n >= 0.05 * (select sum(n) from c)""",
    "p3_per_sample": f"""
        with raw as (select {_PLAIN} sample, read_id, barcode, read_len from raw_reads where sample is not null),
        r as (select sample, count(*) reads_rows, count(distinct read_id) reads_raw, quantile_disc(read_len, 0.5) median_len from raw group by 1),
        w as (select sample, barcode, count(*) n from raw where barcode is not null group by 1, 2),
        m as (select sample, barcode modal_barcode from w qualify row_number() over (partition by sample order by n desc, barcode) = 1),
        c as (select sample, count(*) n_clusters, count(*) filter (where depth >= 6) clusters_hidepth from ({_DEEP}) group by 1)
        select sample, reads_rows, reads_raw, modal_barcode, median_len, n_clusters, clusters_hidepth
        from r left join m using (sample) full join c using (sample)""",
    "p4_found": r"""
        select distinct 'fastqs' record_kind, rec_id from fastqs_raw where raw is null or not (
          regexp_full_match(raw, '@[^\n]*[^\r\n][^\n]*\n[ACGTNacgtn]+\r?\n\+[^\n]*\n[!-J]+(\r?\n)?')
          and length(regexp_extract(raw, '^[^\n]*\n([ACGTNacgtn]+)\r?\n', 1)) = length(regexp_extract(raw, '\n\+[^\n]*\n([!-J]+)(\r?\n)?$', 1)))
        union all
        select distinct 'barcodes', rec_id from barcodes_raw where raw is null or not (case datatype
          when 'rad' then regexp_full_match(raw, '[ \t\r]*("[^"\n]*[^"\s][^"\n]*"|[^ \t\r\n"]+)[ \t\r]+("[RKSYWMCATGrksywmcatg]+"|[RKSYWMCATGrksywmcatg]+)[ \t\r]*')
          when 'pair3rad' then regexp_full_match(raw, '[ \t\r]*("[^"\n]*[^"\s][^"\n]*"|[^ \t\r\n"]+)([ \t\r]+("[RKSYWMCATGrksywmcatg]+"|[RKSYWMCATGrksywmcatg]+)){2}[ \t\r]*')
          else false end)""",
    "p4_fastqs": r"""
        with a as (select rec_id, fastq, raw, replace(raw, chr(13) || chr(10), chr(10)) t from fastqs_raw),
        b as (select rec_id, fastq, raw, string_split(if(t like '%' || chr(10), substr(t, 1, length(t) - 1), t), chr(10)) l from a),
        c as (select *, case when raw is null then 'null record' when regexp_full_match(raw, '\s*') then 'blank record' when len(l) <> 4 then len(l) || ' lines instead of 4' when l[1] not like '@%' then 'name line does not start with @'
          when length(l[1]) < 2 then 'empty name' when l[2] = '' then 'empty sequence' when not regexp_full_match(l[2], '[ACGTNacgtn]*') then 'sequence letter that is not A, C, G, T or N' when l[3] not like '+%' then 'third line does not start with +'
          when not regexp_full_match(l[4], '[!-J]*') then 'quality character outside ! to J' when length(l[4]) <> length(l[2]) then 'quality and sequence differ in length' end reason from b)
        select rec_id, fastq, if(reason is null, substr(l[1], 2), null) name, if(reason is null, l[2], null) seq, if(reason is null, l[4], null) qual, reason is null ok, reason from c""",
    "p4_barcodes": r"""
        with a as (select *, trim(raw, ' ' || chr(9) || chr(13)) t from barcodes_raw),
        b as (select *, regexp_extract_all(t, '"[^"]*"|[^ \t\r"]+') f, regexp_full_match(t, '("[^"]*"|[^ \t\r"]+)([ \t\r]+("[^"]*"|[^ \t\r"]+))*') whole, if(datatype = 'rad', 2, 3) want from a),
        c as (select *, trim(f[1], '"') s, upper(trim(f[2], '"')) b1, upper(trim(f[3], '"')) b2 from b),
        d as (select *, case when raw is null then 'null line' when regexp_full_match(raw, '\s*') then 'blank line' when datatype is null or datatype not in ('rad', 'pair3rad') then 'unknown datatype' when not whole then 'broken quoting' when contains(t, chr(10)) then 'line end within a line'
          when len(f) <> want then len(f) || ' fields instead of ' || want when not regexp_matches(s, '[^\s]') then 'blank sample name' when b1 = '' then 'empty barcode1' when not regexp_full_match(b1, '[RKSYWMCATG]*') then 'letter of barcode1 that is no nucleotide code'
          when want = 3 and b2 = '' then 'empty barcode2' when want = 3 and not regexp_full_match(b2, '[RKSYWMCATG]*') then 'letter of barcode2 that is no nucleotide code' end reason from c)
        select rec_id, barcodes_file, datatype, if(reason is null, s, null) sample, if(reason is null, b1, null) barcode1, if(reason is null and want = 3, b2, null) barcode2, reason is null ok, reason from d""",
    "p5_found": """
        with g as (select distinct * from genos)
        select distinct metric, snp_id, sample from (
          select 'geno' metric, snp_id, sample from g where not coalesce(a0 between 0 and 3 and a1 between 0 and 3, false)
          union all select 'base', snp_id, sample from g where not coalesce(regexp_full_match(base, '[ACGTRKSYWM]'), false)
          union all select 'depth', snp_id, sample from g where not coalesce(depth >= 0, false)
          union all select 'pop', 0, sample from imap where not coalesce(regexp_full_match(pop, 'pop_[a-l]'), false)
          union all select 'elev_m', 0, sample from imap where not coalesce(elev_m between 0 and 4500, false))""",
}
