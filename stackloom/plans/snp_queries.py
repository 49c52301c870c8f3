"""Queries over genotypes, sites and populations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackloom.functions.sequence import genotype_index
from stackloom.operators import snps as S
from stackloom.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _calls(spark, d):
    return S.clean_calls(table(spark, d, "genos"))


def _pops(spark, d):
    return S.populations(table(spark, d, "imap"))


def _sites(spark, d):
    return S.site_table(table(spark, d, "snp_sites"))


_BASE = """
  g as (select distinct snp_id, sample, case when a0 between 0 and 3 and a1 between 0 and 3 then a0 end a0,
          case when a0 between 0 and 3 and a1 between 0 and 3 then a1 end a1,
          case when regexp_full_match(base, '[ACGTRKSYWM]') then base end base, case when depth >= 0 then depth end depth,
          coalesce(base = '-', false) is_gap from genos),
  p as (select distinct sample, pop from imap where regexp_full_match(pop, 'pop_[a-l]')),
  s as (select distinct snp_id, locus, locidx, locpos, scaf, scafpos, alleles from snp_sites),
  c as (select snp_id, pop, cast(sum(2 - a0 - a1) as bigint) anc, cast(sum(a0 + a1) as bigint) der
        from g join p using (sample) where a0 < 2 and a1 < 2 group by 1, 2)"""
_FREQ = (
    _BASE
    + """,
  w as (select snp_id, max(der * 1.0::double / (anc + der)) filter (where pop = 'pop_a') p1, max(der * 1.0::double / (anc + der)) filter (where pop = 'pop_b') p2,
          max(der * 1.0::double / (anc + der)) filter (where pop = 'pop_c') p3, max(der * 1.0::double / (anc + der)) filter (where pop = 'pop_d') p4,
          max(der * 1.0::double / (anc + der)) filter (where pop = 'pop_e') p5 from c group by 1)"""
)
_FOUR = (
    _FREQ
    + """,
  f as (select snp_id, locus, if(p4 >= 0.5, 1 - p1, p1) f1, if(p4 >= 0.5, 1 - p2, p2) f2, if(p4 >= 0.5, 1 - p3, p3) f3, if(p4 >= 0.5, 1 - p4, p4) f4
        from w join s using (snp_id) where p1 + p2 + p3 + p4 is not null),
  l as (select locus, count(*) n_snps, sum((1 - f1) * f2 * f3 * (1 - f4)) abba, sum(f1 * (1 - f2) * f3 * (1 - f4)) baba from f group by 1)"""
)
_MASKS = (
    _BASE
    + """,
  h as (select g.*, pop, a0 + a1 d from g join p using (sample)),
  site as (select snp_id, bool_or(is_gap) indel, coalesce(bool_or(a0 > 1 or a1 > 1), false) multi, count(d) nobs, sum(d) total, min(d) lo, max(d) hi, round_even(avg(d), 0) common from h group by 1),
  pp as (select snp_id, count(*) filter (where seen >= 1) enough from (select snp_id, pop, count(d) seen from h group by 1, 2) group by 1),
  m as (select snp_id, indel, multi, nobs < 0.1 * (select count(*) from p) low_coverage, enough < (select count(distinct pop) from p) low_population,
          coalesce(lo = common and hi = common, true) invariant, coalesce(least(total / (2.0::double * nobs), 1 - total / (2.0::double * nobs)) < 0.05, true) rare from site join pp using (snp_id)),
  k as (select *, not (indel or multi or low_coverage or low_population or invariant or rare) keep from m)"""
)
_LIMITS = {"mincov": 0.1, "minmap": 1, "maf": 0.05}
_FOUR_POPS = ["pop_a", "pop_b", "pop_c", "pop_d"]


@query(f"with {_MASKS} select * from k")
def f28_snp_masks(spark, d):
    return S.snp_masks(_calls(spark, d), _pops(spark, d), **_LIMITS)


@query(f"with {_MASKS} select h.snp_id, h.sample, h.pop, h.d g from h join k using (snp_id) where keep")
def f28_snp_filter(spark, d):
    return S.filter_snps(_calls(spark, d), _pops(spark, d), **_LIMITS).select("snp_id", "sample", "pop", (F.col("a0") + F.col("a1")).alias("g"))


@query(f"""with {_MASKS} select 'indel' mask, count(*) filter (where indel) dropped from k union all select 'multi', count(*) filter (where multi) from k
  union all select 'low_coverage', count(*) filter (where low_coverage) from k union all select 'low_population', count(*) filter (where low_population) from k
  union all select 'invariant', count(*) filter (where invariant) from k union all select 'rare', count(*) filter (where rare) from k union all select 'combined', count(*) filter (where not keep) from k""")
def f28_filter_report(spark, d):
    return S.filter_report(S.snp_masks(_calls(spark, d), _pops(spark, d), **_LIMITS))


@query(f"with {_BASE} select g.snp_id, g.sample, a0, a1, base, depth, is_gap from g join p using (sample) where pop in ('pop_a', 'pop_b')")
def f29_subset_samples(spark, d):
    return S.select_samples(_calls(spark, d), _pops(spark, d).where("pop in ('pop_a', 'pop_b')"))


@query(f"with {_BASE} select g.snp_id, g.sample, a0, a1, base, depth, is_gap from g where sample not in (select sample from p where pop in ('pop_a', 'pop_b'))")
def f34_drop_samples(spark, d):
    return S.exclude_samples(_calls(spark, d), _pops(spark, d).where("pop in ('pop_a', 'pop_b')"))


@query(f"with {_BASE} select sample, count(*) n_sites, count(*) filter (where a0 is null) n_missing, round(count(*) filter (where a0 is null) / count(*), 6) missing from g group by 1")
def a18_sample_missing(spark, d):
    return S.sample_missing(_calls(spark, d))


@query(f"with {_BASE} select snp_id, coalesce(pop, 'all') pop, count(*) covered from g join p using (sample) where a0 is not null group by grouping sets ((snp_id, pop), (snp_id))")
def a19_site_coverage(spark, d):
    return S.site_coverage(_calls(spark, d), _pops(spark, d))


@query(f"with {_BASE} select count(*) cells, count(*) filter (where a0 is null) missing, round(100.0 * count(*) filter (where a0 is null) / count(*), 6) pct from g")
def a17_missing_percent(spark, d):
    return _calls(spark, d).agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("a0").isNull()).alias("missing")).withColumn("pct", F.round(100 * F.col("missing") / F.col("cells"), 6))


@query(f"with {_BASE} select snp_id, pop, anc || ',' || der counts from c")
def a20_pop_counts(spark, d):
    return S.allele_counts(_calls(spark, d), _pops(spark, d)).select("snp_id", "pop", F.concat_ws(",", "anc", "der").alias("counts"))


@query(f"with {_FREQ} select snp_id, round(p1, 6) pop_a, round(p2, 6) pop_b, round(p3, 6) pop_c, round(p4, 6) pop_d from w")
def a21_pop_frequency(spark, d):
    pops = _pops(spark, d)
    return S.allele_frequency(_calls(spark, d), pops, _FOUR_POPS)


@query(f"with {_BASE} select count(distinct locus) n_loci, count(*) n_snps from s")
def a30_distinct_loci(spark, d):
    return _sites(spark, d).agg(F.countDistinct("locus").alias("n_loci"), F.count(F.lit(1)).alias("n_snps"))


_DRAW = "(((({0} * 48271 + {2}) % 2147483647) * 69621 + {1}) % 2147483647)"


@query(f"with {_BASE} select locus, snp_id from s qualify row_number() over (partition by locus order by {_DRAW.format('snp_id', 42, 42 * 40503 + 11)}, snp_id) = 1")
def w01_unlinked_snps(spark, d):
    return S.unlinked(_sites(spark, d))


@query(f"with {_BASE} select locus from (select distinct locus from s) order by {_DRAW.format('locus', 42, 42 * 40503 + 11)}, locus limit 50")
def t07_random_loci(spark, d):
    return S.random_loci(_sites(spark, d), 50)


@query(f"with {_BASE}, r as (select snp_id, scaf, scafpos // 20000 x from s where scaf is not null) select snp_id, scaf, dense_rank() over (order by scaf, x) - 1 block from r")
def w08_ld_blocks(spark, d):
    return S.ld_blocks(table(spark, d, "snp_sites"))


@query(f"with {_FOUR} select round((sum(abba) - sum(baba)) / nullif(sum(abba) + sum(baba), 0), 6) dstat, cast(sum(n_snps) as bigint) n_snps, count(*) n_loci from l")
def m05_dstat(spark, d):
    return S.d_statistic(S.abba_baba(_calls(spark, d), _pops(spark, d), table(spark, d, "snp_sites"), _FOUR_POPS))


@query(f"with {_FOUR} select locus, n_snps, round(abba, 6) abba, round(baba, 6) baba from l")
def m05_dstat_per_locus(spark, d):
    return S.abba_baba(_calls(spark, d), _pops(spark, d), table(spark, d, "snp_sites"), _FOUR_POPS).select("locus", "n_snps", F.round("abba", 6).alias("abba"), F.round("baba", 6).alias("baba"))


_BOOT = f"""with {_FOUR}, u as (select unnest(range(1, 101)) replicate),
  b as (select replicate, abba, baba, ({_DRAW.format("(locus * 1009 + replicate)", 42, 42 * 40503 + 11)} + 0.5::double) / 2147483647.0::double x from l, u),
  v as (select replicate, abba, baba, (x > 0.367879441)::int + (x > 0.735758882)::int + (x > 0.919698603)::int + (x > 0.981011843)::int + (x > 0.996340153)::int + (x > 0.999405815)::int k from b),
  t as (select replicate, (sum(k * abba) - sum(k * baba)) / nullif(sum(k * abba) + sum(k * baba), 0) dstat from v group by 1)"""


@query(f"{_BOOT} select replicate, round(dstat, 6) dstat from t")
def m06_bootstrap_d(spark, d):
    per = S.abba_baba(_calls(spark, d), _pops(spark, d), table(spark, d, "snp_sites"), _FOUR_POPS)
    return S.bootstrap_d(per).select("replicate", F.round("dstat", 6).alias("dstat"))


@query(f"""{_BOOT}, bs as (select stddev_pop(dstat) sd from t), o as (select round((sum(abba) - sum(baba)) / nullif(sum(abba) + sum(baba), 0), 6) dstat, cast(sum(n_snps) as bigint) n_snps, count(*) n_loci from l)
  select dstat, round(sd, 6) bootstd, round(abs(dstat) / nullif(sd, 0), 6) z, n_snps, n_loci from o, bs""")
def m06_d_test(spark, d):
    return S.d_test(S.abba_baba(_calls(spark, d), _pops(spark, d), table(spark, d, "snp_sites"), _FOUR_POPS))


@query(f"""with {_FREQ}, f as (select if(p5 >= 0.5, 1 - p1, p1) a, if(p5 >= 0.5, 1 - p2, p2) b, if(p5 >= 0.5, 1 - p3, p3) c, if(p5 >= 0.5, 1 - p4, p4) e, if(p5 >= 0.5, 1 - p5, p5) o from w where p1 + p2 + p3 + p4 + p5 is not null),
  t as (select sum((1-a)*b*c*e*(1-o)) abbba, sum(a*(1-b)*c*e*(1-o)) babba, sum((1-a)*b*c*(1-e)*(1-o)) abbaa, sum(a*(1-b)*c*(1-e)*(1-o)) babaa, sum((1-a)*b*(1-c)*e*(1-o)) ababa, sum(a*(1-b)*(1-c)*e*(1-o)) baaba, count(*) n_snps from f)
  select round((abbba - babba) / nullif(abbba + babba, 0), 6) d12, round((abbaa - babaa) / nullif(abbaa + babaa, 0), 6) d1, round((ababa - baaba) / nullif(ababa + baaba, 0), 6) d2, n_snps from t""")
def m07_partitioned_d(spark, d):
    return S.partitioned_d(_calls(spark, d), _pops(spark, d), table(spark, d, "snp_sites"), [*_FOUR_POPS, "pop_e"])


_TESTS = [["pop_a", "pop_b", "pop_c", "pop_d"], ["pop_b", "pop_a", "pop_c", "pop_d"], ["pop_a", "pop_c", "pop_b", "pop_d"], ["pop_b", "pop_c", "pop_a", "pop_d"], ["pop_a", "pop_b", "pop_d", "pop_c"]]


def _test_sql(k, t):
    at = {f"pop_{c}": f"p{j}" for j, c in enumerate("abcde", 1)}
    a, b, c, o = (at[x] for x in t)
    f = lambda x: f"if({o} >= 0.5, 1 - {x}, {x})"
    abba, baba = f"(1 - {f(a)}) * {f(b)} * {f(c)} * (1 - {f(o)})", f"{f(a)} * (1 - {f(b)}) * {f(c)} * (1 - {f(o)})"
    return f"select {k} test, '{t[0]}' p1, '{t[1]}' p2, '{t[2]}' p3, '{t[3]}' p4, round((sum({abba}) - sum({baba})) / nullif(sum({abba}) + sum({baba}), 0), 6) dstat, count(*) n_snps from w where {a} + {b} + {c} + {o} is not null"


@query(f"with {_FREQ} " + " union all ".join(_test_sql(k, t) for k, t in enumerate(_TESTS)))
def m08_batch_d_tests(spark, d):
    return S.d_tests(_calls(spark, d), _pops(spark, d), table(spark, d, "snp_sites"), _TESTS)


_PAIRS = f"with {_BASE}, q as (select snp_id, sample, case when a0 < 2 and a1 < 2 then a0 + a1 end d from g) "


@query(_PAIRS + "select a.sample sample_a, b.sample sample_b, count(*) n_sites, round(avg((a.d - b.d) * (a.d - b.d)), 6) distance from q a join q b on a.snp_id = b.snp_id and a.sample < b.sample where a.d is not null and b.d is not null group by 1, 2")
def m23_distance(spark, d):
    return S.genotype_distance(_calls(spark, d))


@query(_PAIRS + """, n as (select distinct sample from q),
  e as (select a.sample sample_a, b.sample sample_b, count(*) filter (where a.d is not null and b.d is not null) shared, count(*) filter (where a.d is null and b.d is null) missed from q a join q b on a.snp_id = b.snp_id and a.sample < b.sample group by 1, 2)
  select a.sample sample_a, b.sample sample_b, coalesce(shared, 0) shared, coalesce(missed, 0) missed from n a join n b on a.sample < b.sample left join e on e.sample_a = a.sample and e.sample_b = b.sample""")
def m24_sharing(spark, d):
    return S.sharing(_calls(spark, d))


@query()
def m20_pca(spark, d):
    return S.pca(_calls(spark, d))[0]


@query()
def m19_kmeans(spark, d):
    return S.kmeans(S.pca(_calls(spark, d))[0], 4)


_WHO = "(snp_id % 2147483647 * 1048583 + ('0x' || substr(md5(sample), 1, 7))::bigint) % 2147483647"


@query(f"""with {_BASE}, j as (select g.*, pop from g left join p using (sample)), f as (select j.*, der / (anc + der)::double f from j left join c using (snp_id, pop))
  select snp_id, sample, if(a0 < 2 and a1 < 2, a0 + a1, coalesce(({_DRAW.format(_WHO, 43, 43 * 40503 + 11)} / 2147483647::double < f)::int + ({_DRAW.format(_WHO, 44, 44 * 40503 + 11)} / 2147483647::double < f)::int, 0)) g, not coalesce(a0 < 2 and a1 < 2, false) imputed from f""")
def m17_impute_sampled(spark, d):
    return S.impute_sampled(_calls(spark, d), _pops(spark, d))


@query(f"with {_BASE} select snp_id, sample, case when list_position(alleles, base) > 0 then list_position(alleles, base) - 1 else 9 end idx from g join s using (snp_id) where base in ('A', 'C', 'G', 'T')")
def x08_geno_index(spark, d):
    return _calls(spark, d).where("base in ('A', 'C', 'G', 'T')").join(_sites(spark, d), "snp_id").select("snp_id", "sample", genotype_index(F.col("alleles"), F.col("base")).alias("idx"))


@query(f"with {_BASE} select snp_id, count(base) ns, cast(coalesce(sum(depth), 0) as bigint) dp from g group by 1")
def a24_vcf_info(spark, d):
    return _calls(spark, d).groupBy("snp_id").agg(F.count("base").alias("ns"), F.coalesce(F.sum("depth"), F.lit(0)).alias("dp"))


@query(f"with {_BASE} select snp_id, sample, case when a0 is null or a0 > 1 or a1 > 1 then 9 else 2 - a0 - a1 end geno from g")
def k09_geno(spark, d):
    return _calls(spark, d).select("snp_id", "sample", F.when((F.col("a0") < 2) & (F.col("a1") < 2), 2 - F.col("a0") - F.col("a1")).otherwise(9).alias("geno"))
