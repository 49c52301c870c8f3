"""Queries of the reference-mapped route, trees and small joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackloom.functions.sequence import make_cigar
from stackloom.operators import mapping as M
from stackloom.operators import snps as S
from stackloom.operators import stacks as K
from stackloom.operators import trees as T
from stackloom.operators.mapping import check_names
from stackloom.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _alignments(spark, d):
    """The reads of clusters as alignments to their cluster laid end to end on the scaffold of their sample."""
    rows = table(spark, d, "clusters").dropDuplicates(["cluster_id", "hit_rank"])
    return rows.select(F.concat_ws("/", F.col("cluster_id").cast("string"), F.floor(F.col("hit_rank") / 2).cast("string")).alias("qname"), F.col("sample").alias("chrom"), (F.col("cluster_id") * 100).alias("pos"), make_cigar(F.col("aligned_seq")).alias("cigar"), F.replace("aligned_seq", F.lit("-"), F.lit("")).alias("seq"))


_AL = "al as (select cluster_id || '/' || hit_rank // 2 qname, any_value(sample) chrom, cluster_id * 100 pos, any_value(aligned_seq) laid from clusters group by cluster_id, hit_rank)"


@query(f"with {_AL}, r as (select chrom, pos p0, pos + length(laid) p1, count(*) n from al group by all), a as (select *, max(p1) over (partition by chrom order by p0, p1 rows between unbounded preceding and 1 preceding) reach from r), b as (select *, sum((reach is null or p0 > reach)::int) over (partition by chrom order by p0, p1 rows unbounded preceding) i from a) select chrom, min(p0) p0, max(p1) p1, cast(sum(n) as bigint) n from b group by chrom, i")
def m34_regions(spark, d):
    return M.regions_of(_alignments(spark, d))


@query(f"with {_AL} select qname, chrom, min(pos) pos, max(pos + length(laid)) - min(pos) \"insert\", count(*) n from al group by 1, 2")
def j12_pair_by_name(spark, d):
    return M.pair_by_name(_alignments(spark, d))


@query(f"with {_AL}, r as (select chrom, pos p0, pos + length(laid) p1, count(*) n from al group by all), a as (select *, max(p1) over (partition by chrom order by p0, p1 rows between unbounded preceding and 1 preceding) reach from r), b as (select *, sum((reach is null or p0 > reach)::int) over (partition by chrom order by p0, p1 rows unbounded preceding) i from a), g as (select chrom, min(p0) p0, max(p1) p1 from b group by chrom, i) select g.chrom, p0, p1, qname, repeat('-', pos - p0) || laid || repeat('-', greatest(p1 - pos - length(laid), 0)) \"row\" from al join g on g.chrom = al.chrom and pos >= p0 and pos < p1")
def m34_region_stacks(spark, d):
    al = _alignments(spark, d)
    return M.region_stacks(al, M.regions_of(al))


@query("""with r as (select cluster_id, hit_rank, any_value(size) size, any_value(aligned_seq) seq from clusters group by 1, 2), s as (select distinct snp_id, locpos from snp_sites), p as (select s.snp_id, c.cluster_id, s.locpos + s.snp_id % 7 - s.snp_id % 3 pos from s join (select distinct cluster_id from r) c on c.cluster_id = s.snp_id)
  select p.snp_id, p.cluster_id rec_id, cast(coalesce(sum(size) filter (where upper(substr(seq, pos + 1, 1)) = 'C'), 0) as bigint) c, cast(coalesce(sum(size) filter (where upper(substr(seq, pos + 1, 1)) = 'A'), 0) as bigint) a, cast(coalesce(sum(size) filter (where upper(substr(seq, pos + 1, 1)) = 'T'), 0) as bigint) t,
    cast(coalesce(sum(size) filter (where upper(substr(seq, pos + 1, 1)) = 'G'), 0) as bigint) g, cast(coalesce(sum(size) filter (where upper(substr(seq, pos + 1, 1)) in ('A', 'C', 'G', 'T')), 0) as bigint) dp from p join r using (cluster_id) group by 1, 2""")
def j14_site_depths(spark, d):
    stacks = K.stack_rows(table(spark, d, "clusters"))
    sites = S.site_table(table(spark, d, "snp_sites")).join(stacks.select(F.col("cluster_id").alias("snp_id")).distinct(), "snp_id").select("snp_id", F.col("snp_id").alias("rec_id"), F.col("locpos").alias("pos"), (F.col("snp_id") % 7).alias("offset"), (F.col("snp_id") % 3).alias("gaps"))
    columns = K.columns_of(stacks, M.site_places(sites).withColumnRenamed("rec_id", "cluster_id")).select(F.col("cluster_id").alias("rec_id"), "pos", "c", "a", "t", "g")
    return M.site_depths(sites, columns)


@query("select locus, min(snp_id) first, max(snp_id) last, count(*) n from (select distinct snp_id, locus from snp_sites) group by 1")
def a29_locus_spans(spark, d):
    return M.locus_spans(S.site_table(table(spark, d, "snp_sites")))


@query("with a as (select distinct sample from edits where sample is not null), k as (select distinct sample from imap) select sample, 'unknown' side from a where sample not in (select sample from k where sample is not null) union all select sample, 'unused' from k where sample not in (select sample from a)")
def j19_check_names(spark, d):
    return check_names(table(spark, d, "edits").where("sample is not null"), table(spark, d, "imap").where("sample is not null"))


@query("with s as (select distinct sample from genos union select 'reference') select sample, row_number() over (order by sample <> 'reference', sample) place from s")
def t09_sample_order(spark, d):
    from pyspark.sql import Window

    names = table(spark, d, "genos").select("sample").distinct().union(spark.createDataFrame([("reference",)], "sample string")).distinct()
    return names.select("sample", F.row_number().over(Window.orderBy(F.col("sample") != "reference", "sample")).alias("place"))  # the samples of a study


@query("with n as (select distinct sample from imap), k as (select sample, row_number() over (order by sample) k, count(*) over () n from n), g as (select *, ceil(n / if(n <= 100, 20, if(n <= 500, 50, 100))) groups from k) select sample, cast(floor((k - 1) / ceil(n / groups)) as int) part from g")
def m37_sample_groups(spark, d):
    from stackloom.operators.reports import sample_groups

    return sample_groups(table(spark, d, "imap").select("sample"))


_TREE = "((((pop_a:1,pop_b:1):1,pop_c:2):1,(pop_d:2,pop_e:2):1):1,pop_f:4);"


@query()
def m09_tests_from_tree(spark, d):
    pops, calls, sites = S.populations(table(spark, d, "imap")), S.clean_calls(table(spark, d, "genos")), table(spark, d, "snp_sites")
    return S.d_tests(calls, pops, sites, T.tests_from_tree(_TREE))


def _window_trees(spark, d):
    sites = S.site_table(table(spark, d, "snp_sites")).where("scaf is not null").select("snp_id", F.col("scaf").alias("scaffold"), (F.floor(F.col("scafpos") / 20000) * 20000).alias("start"))
    freq = S.allele_counts(S.clean_calls(table(spark, d, "genos")), S.populations(table(spark, d, "imap"))).select("snp_id", "pop", F.try_divide("der", F.col("anc") + F.col("der")).alias("freq"))
    return T.window_trees(sites.join(freq, "snp_id"))


@query()
def m27_window_trees(spark, d):
    return _window_trees(spark, d)


@query()
def m28_clade_support(spark, d):
    trees = _window_trees(spark, d).where("tree is not null").select((F.col("scaffold") * 1000000 + F.col("start")).alias("tree_id"), F.col("tree").alias("newick"))
    return T.clade_support(trees, {"ab": ["pop_a", "pop_b"], "abc": ["pop_a", "pop_b", "pop_c"]})


@query()
def d21_tree_nodes(spark, d):
    return T.tree_nodes(_window_trees(spark, d).where("tree is not null").select((F.col("scaffold") * 1000000 + F.col("start")).alias("tree_id"), F.col("tree").alias("newick")))


@query("""with p as (select distinct sample, pop from imap where regexp_full_match(pop, 'pop_[a-l]')), s as (select distinct snp_id, locus from snp_sites), g as (select distinct snp_id, sample, a0, a1 from genos where a0 between 0 and 1 and a1 between 0 and 1),
  n as (select snp_id, pop, sum(a0 + a1) d, 2 * count(*) n from g join p using (sample) group by 1, 2) select locus, snp_id site, pop, round(2.0::double * d * (n - d) / (n * (n - 1.0::double)), 6) pi from n join s using (snp_id)""")
def k23_popgen_sites(spark, d):
    n = S.allele_counts(S.clean_calls(table(spark, d, "genos")), S.populations(table(spark, d, "imap"))).join(S.site_table(table(spark, d, "snp_sites")).select("snp_id", "locus"), "snp_id")
    total = F.col("anc") + F.col("der")
    return n.select("locus", F.col("snp_id").alias("site"), "pop", F.round(2.0 * F.col("der") * F.col("anc") / (total * (total - 1)), 6).alias("pi"))


@query("""with p as (select distinct sample, pop from imap where regexp_full_match(pop, 'pop_[a-l]')), g as (select distinct snp_id, sample, a0, a1 from genos where a0 between 0 and 1 and a1 between 0 and 1),
  h as (select snp_id, sum(a0 + a1) filter (where pop = 'pop_a') a, 2 * count(*) filter (where pop = 'pop_a') na, sum(a0 + a1) filter (where pop = 'pop_b') b, 2 * count(*) filter (where pop = 'pop_b') nb, sum(a0 + a1) filter (where pop = 'pop_c') c, 2 * count(*) filter (where pop = 'pop_c') nc from g join p using (sample) group by 1),
  f as (select a / na::double a, b / nb::double b, c / nc::double c from h where na > 0 and nb > 0 and nc > 0) select round(sum(a * b * (1 - c) + (1 - a) * (1 - b) * c), 6) aabb, round(sum((1 - a) * b * c + a * (1 - b) * (1 - c)), 6) abba, round(sum(a * (1 - b) * c + (1 - a) * b * (1 - c)), 6) baba, count(*) sites from f""")
def m29_site_patterns(spark, d):
    counts = S.allele_counts(S.clean_calls(table(spark, d, "genos")), S.populations(table(spark, d, "imap")).where("pop in ('pop_a', 'pop_b', 'pop_c')")).withColumn("f", F.try_divide("der", F.col("anc") + F.col("der")))
    w = counts.groupBy("snp_id").pivot("pop", ["pop_a", "pop_b", "pop_c"]).agg(F.first("f")).dropna().toDF("snp_id", "a", "b", "c")
    both = lambda x, y: F.round(F.sum(F.expr(f"{x} + {y}")), 6)
    return w.agg(both("a * b * (1 - c)", "(1 - a) * (1 - b) * c").alias("aabb"), both("(1 - a) * b * c", "a * (1 - b) * (1 - c)").alias("abba"), both("a * (1 - b) * c", "(1 - a) * b * (1 - c)").alias("baba"), F.count(F.lit(1)).alias("sites"))


@query(f"""with w as ({ORACLE_SQL["m29_site_patterns"]}), n as (select aabb / greatest(sites, 1)::double a, abba / greatest(sites, 1)::double b, baba / greatest(sites, 1)::double c, greatest(sites, 1)::double n from w),
  v as (select a - c f1, b - c f2, (a * (1 - a) + c * (1 - c) + 2 * a * c) / n v1, (b * (1 - b) + c * (1 - c) + 2 * b * c) / n v2, (-a * b + a * c + b * c + c * (1 - c)) / n cov from n), r as (select *, if(f2 <> 0, f1 / f2, 0) q from v), z as (select *, v2 * q * q - 2 * cov * q + v1 s from r)
  select round(f1, 6) f1, round(f2, 6) f2, round(if(s > 0, f2 * (q - 1) / sqrt(s), 0), 6) h, round(if(f1 + f2 <> 0, 1 - f1 / (f1 + f2), 0), 6) gamma from z""")
def m29_hils_test(spark, d):
    from stackloom.operators.reports import site_pattern_test

    return site_pattern_test(m29_site_patterns(spark, d))
