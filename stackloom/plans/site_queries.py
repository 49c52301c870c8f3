"""Queries over sites, samples and scalar functions that stand for themselves, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stackloom.functions import sequence as Q
from stackloom.operators import loci as L
from stackloom.operators import mapping as M
from stackloom.operators import snps as S
from stackloom.plans.locus_queries import _CELLS, ORACLE_SQL as _LOCUS_SQL, _cells
from stackloom.plans.snp_queries import _BASE, _DRAW, _FREQ, _WHO, ORACLE_SQL as _SNP_SQL, _calls, _pops, _sites
from stackloom.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}
_FOUR = ["pop_a", "pop_b", "pop_c", "pop_d"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""with {_BASE}, x as (select g.snp_id, g.sample, alleles[a0 + 1] b0, alleles[a1 + 1] b1 from g join s using (snp_id))
  select snp_id, sample, case when b0 is null or b1 is null then 'N' when b0 = b1 then b0 else coalesce(map {{'AG': 'R', 'GT': 'K', 'CG': 'S', 'CT': 'Y', 'AT': 'W', 'AC': 'M'}}[least(b0, b1) || greatest(b0, b1)], 'N') end letter from x""")
def x10_fill_bases(spark, d):
    return S.fill_bases(_calls(spark, d), _sites(spark, d))


@query(f"with {_FREQ} select snp_id, round(p1, 6) pop_a, round(p2, 6) pop_b, round(p3, 6) pop_c, round(p4, 6) pop_d from w where p1 + p2 + p3 + p4 is not null and (round(p2, 6) <> round(p1, 6) or round(p3, 6) <> round(p1, 6))")
def f38_masked_frequencies(spark, d):
    return S.masked_frequencies(_calls(spark, d), _pops(spark, d), _FOUR)


@query(f"""with {_CELLS}, x as (select locus, pos, pop, unnest(string_split(if(length(e) = 1, e || e, e), '')) x from al join pops using (sample) where e <> '' and pop in ('pop_a', 'pop_b', 'pop_c', 'pop_d')),
  n as (select locus, pos, pop, x, count(*) n from x group by all), a as (select locus, pos, first(x order by n desc, x) anc from n where pop = 'pop_d' group by 1, 2),
  f as (select locus, pos, pop, sum(n) filter (where x <> anc) k, sum(n) t from n join a using (locus, pos) group by 1, 2, 3), v as (select locus, pos, pop, coalesce(k, 0)::double / t v from f),
  w as (select locus, pos, max(v) filter (where pop = 'pop_a') f1, max(v) filter (where pop = 'pop_b') f2, max(v) filter (where pop = 'pop_c') f3, max(v) filter (where pop = 'pop_d') f4 from v group by 1, 2),
  k as (select * from w where f1 + f2 + f3 + f4 is not null and (f1 <> f2 or f1 <> f3)), s as (select sum((1 - f1) * f2 * f3 * (1 - f4)) a, sum(f1 * (1 - f2) * f3 * (1 - f4)) b, count(*) n_sites, count(distinct locus) n_loci from k)
  select round((a - b) / (a + b), 6) dstat, round(a, 6) abba, round(b, 6) baba, n_sites, n_loci from s""")
def m10_locus_dstat(spark, d):
    return S.locus_dstat(_cells(spark, d), _pops(spark, d), _FOUR)


@query(f"with {_BASE} select snp_id, sample, if(a0 < 2 and a1 < 2, a0 + a1, {_DRAW.format(_WHO, 42, 42 * 40503 + 11)} % 3) g, not coalesce(a0 < 2 and a1 < 2, false) imputed from g")
def m18_impute_random(spark, d):
    return S.impute(_calls(spark, d), _pops(spark, d), "random")


@query(f"with {_BASE} select snp_id, sample, if(a0 < 2 and a1 < 2, a0 + a1, 0) g, not coalesce(a0 < 2 and a1 < 2, false) imputed from g")
def m18_impute_zero(spark, d):
    return S.impute(_calls(spark, d), _pops(spark, d), None)


@query()
def m19_impute_kmeans(spark, d):
    return S.impute_kmeans(_calls(spark, d), _sites(spark, d), 4, 0.12, 0.05, 2)[0]


@query("with {0} {1}".format(_BASE, " union all ".join(f"(select {k} replicate, snp_id from s qualify row_number() over (partition by locus order by {_DRAW.format('snp_id', 42 + k, (42 + k) * 40503 + 11)}, snp_id) = 1)" for k in range(3))))
def m20_unlinked_replicates(spark, d):
    return S.unlinked_replicates(_sites(spark, d), 3)


@query()
def m20_pca_replicates(spark, d):
    return S.pca_replicates(_calls(spark, d), _sites(spark, d), 3)[0]


@query("with v as (select event_id % 4 replicate, cast(user_id as varchar) sample, avg(value) v from events group by 1, 2), r as (select replicate, sample, v * if(replicate in (1, 2), -1, 1) x from v), z as (select sample, x x0 from r where replicate = 0) select replicate, regr_slope(x, x0) < 0 flip from r join z using (sample) group by 1")
def m22_axis_flip(spark, d):
    turned = F.when((F.col("event_id") % 4).isin(1, 2), -1).otherwise(1)
    reps = table(spark, d, "events").groupBy((F.col("event_id") % 4).alias("replicate"), F.col("user_id").cast("string").alias("sample"), turned.alias("t")).agg(F.avg("value").alias("v"))
    return M.flip_axes(reps.select("replicate", "sample", (F.col("v") * F.col("t")).alias("x")))


@query("with h as (select distinct tier, target_label target, query_label query from hit_pairs where target_label is not null and query_label is not null) select tier, target, query, row_number() over (partition by tier, target order by query) - 1 place from h")
def t03_hits_by_seed(spark, d):
    hits = table(spark, d, "hit_pairs").where("target_label is not null and query_label is not null").select("tier", F.col("target_label").alias("target"), F.col("query_label").alias("query")).distinct()
    return hits.select("tier", "target", "query", (F.row_number().over(Window.partitionBy("tier", "target").orderBy("query")) - 1).alias("place"))


@query("with c as (select distinct sample, cluster_id from clusters where sample is not null) select sample, cluster_id from c qualify row_number() over (partition by sample order by cluster_id) <= 20")
def t06_first_clusters(spark, d):
    from stackloom.operators.reads import cap_per_sample

    own = table(spark, d, "clusters").where("sample is not null").select("sample", F.col("cluster_id").alias("read_id")).distinct()
    return cap_per_sample(own, 20).select("sample", F.col("read_id").alias("cluster_id"))


@query("with a as (select sample chrom, cluster_id * 100 + hit_rank pos, cluster_id || '/' || hit_rank qname from clusters group by all) select chrom, pos, qname, row_number() over (partition by chrom order by pos, qname) - 1 place from a")
def t08_coordinate_sort(spark, d):
    rows = table(spark, d, "clusters").select(F.col("sample").alias("chrom"), (F.col("cluster_id") * 100 + F.col("hit_rank")).alias("pos"), F.concat_ws("/", F.col("cluster_id").cast("string"), F.col("hit_rank").cast("string")).alias("qname")).distinct()
    known = M.coordinate_sort(rows.where("chrom is not null"), 4096)
    return known.unionByName(M.coordinate_sort(rows.where("chrom is null").withColumn("chrom", F.lit("")), 4096).withColumn("chrom", F.lit(None).cast("string")))


@query(f"with sh as ({_SNP_SQL['m24_sharing']}), l as (select sample_a sample, shared from sh union all select sample_b, shared from sh), m as (select sample, round(avg(shared), 6) mean_shared from l group by 1) select *, row_number() over (order by mean_shared desc, sample) place from m")
def t10_by_mean_sharing(spark, d):
    return S.order_by_sharing(S.sharing(_calls(spark, d)))


@query(f"with {_BASE}, n as (select 'scaf_' || scaf scaffold, max(scafpos) + 1 length from s where scaf is not null group by 1), k as (select scaffold, row_number() over (order by length desc, scaffold) chrom from n) select snp_id, scaffold, chrom from s join k on scaffold = 'scaf_' || scaf")
def j15_scaffold_names(spark, d):
    sites = _sites(spark, d).where("scaf is not null").withColumn("scaffold", F.format_string("scaf_%d", "scaf"))
    numbers = M.scaffold_numbers(sites.groupBy(F.col("scaffold").alias("name")).agg((F.max("scafpos") + 1).alias("length")))
    return sites.join(numbers, "scaffold").select("snp_id", "scaffold", "chrom")


@query("with s as (select unnest(['CWGR', 'TGCAG', 'SY']) motif), w as (select motif, string_split(motif, '') l from s), m as (select map {'R': ['G', 'A'], 'K': ['G', 'T'], 'S': ['G', 'C'], 'Y': ['T', 'C'], 'W': ['T', 'A'], 'M': ['C', 'A']} m), e as (select motif, list_transform(l, lambda x: coalesce(m[x], [x])) o from w, m) select motif, a || b || c || d || f plain from (select motif, unnest(o[1]) a, o from e), (select 1), lateral (select unnest(o[2]) b), lateral (select unnest(coalesce(o[3], [''])) c), lateral (select unnest(coalesce(o[4], [''])) d), lateral (select unnest(coalesce(o[5], [''])) f)")
def x04_expand_cut_site(spark, d):
    return spark.createDataFrame([(m, p) for m in ("CWGR", "TGCAG", "SY") for p in Q.expand_ambiguous(m)], "motif string, plain string")


@query(f"with {_BASE} select snp_id, sample, a0, a1 from g")
def x09_vcf_genotype(spark, d):
    cell = F.concat(F.coalesce(F.col("a0").cast("string"), F.lit(".")), F.lit("/"), F.coalesce(F.col("a1").cast("string"), F.lit(".")), F.lit(":"), F.coalesce(F.col("depth").cast("string"), F.lit("0")))
    a0, a1 = Q.vcf_genotype(F.col("cell"))
    return _calls(spark, d).select("snp_id", "sample", cell.alias("cell")).select("snp_id", "sample", a0.alias("a0"), a1.alias("a1"))


@query("with c as (select distinct cluster_id, hit_rank, size from clusters where size is not null) select cluster_id, hit_rank, size, round(if(hit_rank <= size, exp(lgamma(size + 1) - lgamma(hit_rank + 1) - lgamma(size - hit_rank + 1) + hit_rank * ln(0.01::double) + (size - hit_rank) * ln(0.99::double)), 0), 9) pmf, round(if(hit_rank <= size, lgamma(size + 1) - lgamma(hit_rank + 1) - lgamma(size - hit_rank + 1), null), 6) log_choose from c")
def x19_binomial(spark, d):
    rows = table(spark, d, "clusters").where("size is not null").select("cluster_id", "hit_rank", "size").distinct()
    n, k = F.col("size"), F.col("hit_rank").cast("bigint")
    return rows.select("cluster_id", "hit_rank", "size", F.round(Q.binomial_pmf(n, k, 0.01), 9).alias("pmf"), F.when(k <= n, F.round(Q.log_choose(n, k), 6)).alias("log_choose"))


@query("select doc_id, strftime(filed_at, '%Y%m%d') \"day\", date_diff('day', filed_at::date, loaded_at::date) \"days\" from documents")
def x25_dates(spark, d):
    return table(spark, d, "documents").select("doc_id", F.date_format("filed_at", "yyyyMMdd").alias("day"), F.datediff("loaded_at", "filed_at").alias("days"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) k from events")
def x26_json_key(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query(f"select locus, \"left\", \"right\", start, \"end\", start + \"left\" kept_start, start + \"right\" + 1 kept_end from ({_LOCUS_SQL['f20_coverage_edges']}) join ({_LOCUS_SQL['w03_running_offsets']}) using (locus)")
def m38_locus_index(spark, d):
    """Where each locus lies among all, and what its trimming cut, for looking up depths."""
    cells = _cells(spark, d)
    offsets = L.running_offsets(L.informative_sites(L.site_classes(cells)).select("locus", F.col("n_sites").alias("length")))
    return L.coverage_edges(cells).join(offsets, "locus").select("locus", "left", "right", "start", "end", (F.col("start") + F.col("left")).alias("kept_start"), (F.col("start") + F.col("right") + 1).alias("kept_end"))
