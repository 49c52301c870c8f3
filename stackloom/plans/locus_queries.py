"""Queries over loci, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackloom.operators import loci as L
from stackloom.operators.snps import populations, site_table
from stackloom.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _cells(spark, d):
    """The SNP columns of each locus as an alignment; what is no base is N."""
    base = F.when(F.col("base").rlike("^[ACGTRKSYWM-]$"), F.col("base")).otherwise("N")
    sites = site_table(table(spark, d, "snp_sites")).select("snp_id", "locus", F.col("locpos").alias("pos"))
    return table(spark, d, "genos").distinct().join(sites, "snp_id").select("locus", "pos", "sample", base.alias("base"))


def _rows(spark, d):
    """Consensus sequences as rows of their own locus group: the hit lists of the database tier."""
    strip = lambda c: F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^[ \t]*>?", ""), "(?s);.*$", ""), "^[ \t]+|[ \t]+$", ""))
    base = table(spark, d, "clust_database").select("seq_id", "sample", strip(F.col("label")).alias("k"), F.upper("seqs").alias("seq")).distinct()
    hits = table(spark, d, "hit_pairs").where("tier = 'database'").select(strip(F.col("query_label")).alias("q"), strip(F.col("target_label")).alias("t"))
    named = hits.join(base.select(F.col("k").alias("q"), F.col("seq_id").alias("query")), "q").join(base.select(F.col("k").alias("t"), F.col("seq_id").alias("target")), "t").where("query <> target")
    return L.seed_groups(named, base.select(F.col("seq_id").alias("rec_id"), "sample", "seq"))


def _pops(spark, d):
    return populations(table(spark, d, "imap"))


_CELLS = """cells as (select locus, locpos pos, sample, if(regexp_full_match(base, '[ACGTRKSYWM-]'), base, 'N') base
    from (select distinct * from genos) join (select distinct snp_id, locus, locpos from snp_sites) using (snp_id)),
  pops as (select distinct sample, pop from imap where regexp_full_match(pop, 'pop_[a-l]')),
  al as (select locus, pos, sample, case base when 'R' then 'AG' when 'K' then 'GT' when 'S' then 'CG' when 'Y' then 'CT' when 'W' then 'AT' when 'M' then 'AC' when 'N' then '' when '-' then '' else base end e from cells),
  cnt as (select locus, pos, cast(sum((contains(e, 'A'))::int) as bigint) a, cast(sum((contains(e, 'C'))::int) as bigint) c, cast(sum((contains(e, 'G'))::int) as bigint) g, cast(sum((contains(e, 'T'))::int) as bigint) t from al group by 1, 2),
  cls as (select *, case list_reverse_sort([a, c, g, t])[2] when 0 then ' ' when 1 then '-' else '*' end mark from cnt),
  sites as (select locus, count(*) n_sites, count(*) filter (where mark = '-') n_var, count(*) filter (where mark = '*') n_pis from cls group by 1)"""
_STRIP = "lower(trim(regexp_replace(regexp_replace({}, '^[ \\t]*>?', ''), ';[\\s\\S]*$', ''), ' ' || chr(9)))"
_GROUPS = f"""base as (select distinct seq_id, sample, {_STRIP.format('label')} k, upper(seqs) seq from clust_database),
  links as (select distinct a.seq_id query, b.seq_id target from hit_pairs h join base a on a.k = {_STRIP.format('h.query_label')} join base b on b.k = {_STRIP.format('h.target_label')} where h.tier = 'database' and a.seq_id <> b.seq_id),
  mem as (select target locus, query rec_id from links union select target, target from links),
  rows_ as (select locus, sample, rec_id, seq from mem join base on rec_id = seq_id)"""
_ALLELES = f"""{_CELLS}, alt as (select locus, pos, pop, cast(sum((contains(e, 'A'))::int) as bigint) a, cast(sum((contains(e, 'C'))::int) as bigint) c, cast(sum((contains(e, 'G'))::int) as bigint) g, cast(sum((contains(e, 'T'))::int) as bigint) t from al join pops using (sample) group by 1, 2, 3),
  an as (select *, a + c + g + t n from alt),
  dv as (select locus, pop, count(*) n_sites, count(*) filter (where greatest(a, c, g, t) < n) seg, max(n) n, sum(if(n > 1, (n * n - a * a - c * c - g * g - t * t) / (n * (n - 1.0::double)), 0)) pi from an where n > 0 group by 1, 2),
  dh as (select *, list_sum([1.0::double / i for i in range(1, greatest(n, 2))]) a1, list_sum([1.0::double / (i * i) for i in range(1, greatest(n, 2))]) a2 from dv),
  ds as (select *, seg / a1 theta, if(n > 1, (((n + 1.0::double) / (3 * (n - 1)) - 1 / a1) / a1) * seg + ((2.0::double * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (n * a1) + a2 / (a1 * a1)) / (a1 * a1 + a2)) * seg * (seg - 1), null) v from dh),
  dt as (select locus, pop, n_sites, seg, n, pi, theta, if(v > 0, (pi - seg / a1) / sqrt(v), null) tajima_d from ds)"""


@query(f"with {_CELLS} select * from cls")
def a12_site_classes(spark, d):
    return L.site_classes(_cells(spark, d))


@query(f"with {_CELLS} select * from sites")
def a13_informative_sites(spark, d):
    return L.informative_sites(L.site_classes(_cells(spark, d)))


@query(f"""with {_CELLS}, r as (select locus, pos, unnest(['A', 'C', 'G', 'T']) b, unnest([a, c, g, t]) n from cls)
  select locus, pos, coalesce(string_agg(b, '' order by n desc, b) filter (where n > 0), '') ranked from r group by 1, 2""")
def a14_ranked_alleles(spark, d):
    return L.ranked_alleles(L.site_classes(_cells(spark, d)))


@query(f"with {_GROUPS} select locus, sample, rec_id from rows_")
def j06_j07_seed_groups(spark, d):
    return _rows(spark, d).select("locus", "sample", "rec_id")


@query(f"""with {_GROUPS}, f as (select distinct query, target from links), x as (select b.target locus, a.query rec_id from f a join f b on a.target = b.query union select target, query from f union select target, target from f) select * from x""")
def j08_two_tier_groups(spark, d):
    links = _rows(spark, d).where("locus <> rec_id").select(F.col("rec_id").alias("query"), F.col("locus").alias("target"))
    return L.two_tier_groups(links, links)


@query(f"with {_GROUPS} select locus, count(*) n_rows, count(distinct sample) n_samples, count(*) <> count(distinct sample) duplicated from rows_ group by 1")
def f18_duplicates(spark, d):
    return L.duplicate_samples(_rows(spark, d))


_MINSAMP = """pr as (select distinct locus, sample from {}), pp as (select locus, count(*) filter (where n >= 1) pops_met from (select locus, pop, count(*) n from pr join pops using (sample) group by 1, 2) group by 1),
  ms as (select locus, count(*) n_samples, coalesce(any_value(pops_met), 0) pops_met, count(*) >= 4 and coalesce(any_value(pops_met), 0) >= 2 keep from pr left join pp using (locus) group by 1)"""


@query(f"with {_CELLS}, {_MINSAMP.format('cells')} select * from ms")
def f19_min_samples(spark, d):
    return L.min_samples(_cells(spark, d), _pops(spark, d), 4, 1, 2)


@query(f"""with {_CELLS}, n as (select locus, pos, count(*) filter (where base not in ('N', '-')) n from cells group by 1, 2), r as (select locus, count(distinct sample) k from cells group by 1)
  select locus, min(pos) "left", max(pos) "right" from n join r using (locus) where n >= least(4, k) group by 1""")
def f20_coverage_edges(spark, d):
    return L.coverage_edges(_cells(spark, d))


@query(f"""with {_GROUPS}, o as (select locus, sum((substr(seq, 1, 1) = 'T')::int + (substr(seq, 2, 1) = 'G')::int + (substr(seq, 3, 1) = 'C')::int + (substr(seq, 4, 1) = 'A')::int + (substr(seq, 5, 1) = 'G')::int) hits,
  sum(list_sum([(substr(seq, k, 1) in ('A', 'C', 'G', 'T'))::int for k in [1, 2, 3, 4, 5]])) seen from rows_ group by 1) select locus, if(seen > 0 and hits >= 0.75::double * seen, 5, 0) trim from o""")
def f21_overhang_trim(spark, d):
    return L.overhang_trim(_rows(spark, d), "TGCAG")


@query(f"""with {_GROUPS}, e as (select locus, 5 l, max(length(seq)) - 6 r from rows_ group by 1), c as (select locus, sample, rec_id, substr(seq, l + 1, r - l + 1) seq from rows_ join e using (locus) where r - l + 1 >= 35)
  select locus, sample, seq, regexp_replace(seq, '[N-]', '', 'g') = '' "empty" from c""")
def f22_f23_trim_rows(spark, d):
    rows = _rows(spark, d)
    edges = rows.groupBy("locus").agg(F.lit(5).alias("left"), (F.max(F.length("seq")) - 6).alias("right"))
    return L.trim_rows(rows, edges, 35)


@query(f"""with {_GROUPS}, i as (select locus, regexp_replace(seq, '^-+|-+$', '', 'g') s from rows_) select locus, max(length(s) - length(replace(s, '-', ''))) gaps, max(length(s) - length(replace(s, '-', ''))) <= 8 keep from i group by 1""")
def f24_max_indels(spark, d):
    return L.max_gaps(_rows(spark, d))


@query(f"with {_CELLS} select locus, n_var + n_pis variable, n_var + n_pis <= n_sites * 0.2::double keep from sites")
def f25_max_snps(spark, d):
    return L.max_variable(L.informative_sites(L.site_classes(_cells(spark, d))))


_SHARED = """sh as (select locus, max(h) most_het from (select locus, pos, count(*) filter (where base in ('R', 'K', 'S', 'Y', 'W', 'M')) h from cells group by 1, 2) group by 1),
  sk as (select locus, most_het, most_het <= 0.5::double * k keep from sh join (select locus, count(distinct sample) k from cells group by 1) using (locus))"""


@query(f"with {_CELLS}, {_SHARED} select * from sk")
def f26_shared_het(spark, d):
    return L.shared_het(_cells(spark, d))


@query(f"""with {_CELLS}, {_SHARED}, {_MINSAMP.format('cells')}, fl as (select locus, not (n_var + n_pis <= n_sites * 0.8::double) maxvar, not sk.keep maxshared, not ms.keep minsamp from sites join sk using (locus) join ms using (locus)),
  t as (select count(*) loci, count(*) filter (where maxvar) v, count(*) filter (where maxshared) s, count(*) filter (where maxshared and not maxvar) sa, count(*) filter (where minsamp) m, count(*) filter (where minsamp and not maxvar and not maxshared) ma from fl)
  select 'prefiltered' "filter", 0 total, 0 applied, loci retained from t union all select 'maxvar', v, v, loci - v from t union all select 'maxshared', s, sa, loci - v - sa from t union all select 'minsamp', m, ma, loci - v - sa - ma from t""")
def a15_filter_table(spark, d):
    cells = _cells(spark, d)
    var = L.max_variable(L.informative_sites(L.site_classes(cells)), 0.8).select("locus", (~F.col("keep")).alias("maxvar"))
    het = L.shared_het(cells).select("locus", (~F.col("keep")).alias("maxshared"))
    samp = L.min_samples(cells, _pops(spark, d), 4, 1, 2).select("locus", (~F.col("keep")).alias("minsamp"))
    return L.filter_table(var.join(het, "locus").join(samp, "locus"), ["maxvar", "maxshared", "minsamp"])


@query(f"with {_CELLS} select sample, count(distinct locus) n_loci from cells group by 1")
def a16_sample_coverage(spark, d):
    return L.sample_coverage(_cells(spark, d))


@query(f"with {_CELLS}, k as (select locus, count(distinct sample) n_samples from cells group by 1), h as (select n_samples, count(*) n_loci from k group by 1) select n_samples, n_loci, cast(sum(n_loci) over (order by n_samples) as bigint) cumulative from h")
def w06_coverage_cumulative(spark, d):
    return L.coverage_histogram(_cells(spark, d))


@query(f"with {_CELLS}, h as (select n_pis, count(*) n_loci from sites group by 1) select n_pis, n_loci, cast(sum(n_pis * n_loci) over (order by n_pis) as bigint) cumulative from h")
def a16_pis_distribution(spark, d):
    return L.variable_histogram(L.informative_sites(L.site_classes(_cells(spark, d))))


@query(f"with {_CELLS} select locus, cast(sum(n_sites) over (order by locus) - n_sites as bigint) start, cast(sum(n_sites) over (order by locus) as bigint) \"end\" from sites")
def w03_running_offsets(spark, d):
    sites = L.informative_sites(L.site_classes(_cells(spark, d)))
    return L.running_offsets(sites.select("locus", F.col("n_sites").alias("length")))


@query(f"with {_CELLS}, col as (select distinct locus, pos from cells), s as (select distinct sample from cells) select s.sample, string_agg(coalesce(base, 'N'), '' order by locus, pos) seq from col cross join s left join cells using (locus, pos, sample) group by 1")
def k04_phylip_rows(spark, d):
    cells = _cells(spark, d)
    return L.concatenated(cells, cells)


@query(f"""with {_CELLS}, m as (select locus, sample, pos, list_distinct(list(base) filter (where base not in ('N', '-'))) b from cells group by 1, 2, 3)
  select locus, sample, bool_and(coalesce(len(b), 0) <= 1) merged, string_agg(coalesce(b[1], 'N'), '' order by pos) seq from m group by 1, 2""")
def j13_merge_duplicates(spark, d):
    return L.merge_duplicates(_cells(spark, d))


@query(f"with {_ALLELES} select locus, pop, n_sites, seg, n, round(pi, 6) pi, round(theta, 6) theta, round(tajima_d, 6) tajima_d from dt")
def m11_m12_m13_diversity(spark, d):
    out = L.diversity(L.allele_table(_cells(spark, d), _pops(spark, d)))
    return out.select("locus", "pop", "n_sites", "seg", "n", *[F.round(c, 6).alias(c) for c in ("pi", "theta", "tajima_d")])


@query(f"with {_ALLELES} select pop, count(*) n_loci, round(avg(pi), 6) pi, round(avg(theta), 6) theta, round(avg(tajima_d), 6) tajima_d from dt group by 1")
def m16_diversity_summary(spark, d):
    return L.diversity_summary(L.diversity(L.allele_table(_cells(spark, d), _pops(spark, d))))


@query(f"""with {_ALLELES}, v as (select * from an where n > 1), q as (select x.pop pop_a, y.pop pop_b, 1 - (x.a * y.a + x.c * y.c + x.g * y.g + x.t * y.t) / (x.n * y.n * 1.0::double) bt,
    ((x.n * x.n - x.a * x.a - x.c * x.c - x.g * x.g - x.t * x.t) / (x.n * (x.n - 1.0::double)) + (y.n * y.n - y.a * y.a - y.c * y.c - y.g * y.g - y.t * y.t) / (y.n * (y.n - 1.0::double))) / 2 wi
    from v x join v y on x.locus = y.locus and x.pos = y.pos and x.pop < y.pop), z as (select pop_a, pop_b, count(*) n_sites, avg(bt) b, avg(wi) w from q group by 1, 2)
  select pop_a, pop_b, n_sites, round(b, 6) dxy, round(w, 6) "within", if(b > 0, round(1 - w / b, 6), null) fst, if(b > 0, round(1 - w / (w / 2 + b / 2), 6), null) fst_adjusted, if(b <> w, round(0.25 * w / (b - w), 6), null) nm from z""")
def m14_m15_divergence(spark, d):
    return L.divergence(L.allele_table(_cells(spark, d), _pops(spark, d)))


@query("with s as (select distinct snp_id, locus from snp_sites), g as (select distinct snp_id, sample from genos) select locus, count(*) n_sites from s where locus in (select locus from s group by 1 having count(*) >= 3) group by 1")
def f35_loci_by_sites(spark, d):
    return site_table(table(spark, d, "snp_sites")).groupBy("locus").agg(F.count(F.lit(1)).alias("n_sites")).where("n_sites >= 3")
