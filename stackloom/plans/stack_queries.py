"""Queries over within-sample clusters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackloom.operators import stacks as K
from stackloom.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _stacks(spark, d):
    return K.stack_rows(table(spark, d, "clusters"))


def _deep_columns(spark, d):
    rows = _stacks(spark, d)
    deep = K.filter_depth(K.cluster_depths(rows)).select("cluster_id")
    return K.columns_of(rows.join(deep, "cluster_id", "left_semi"))


_ROWS = "r as (select any_value(sample) sample, cluster_id, hit_rank, any_value(size) size, any_value(orient) orient, any_value(aligned_seq) seq from clusters group by cluster_id, hit_rank)"
_DEPTH = f"{_ROWS}, d as (select sample, cluster_id, cast(sum(size) as bigint) depth, max(length(seq)) longest, count(*) n_reads from r group by 1, 2)"
_COLS = f"""{_DEPTH}, deep as (select cluster_id from d where depth between 6 and 10000),
  x as (select cluster_id, hit_rank, size, seq, unnest(range(0, length(seq))) pos from r where cluster_id in (select cluster_id from deep)),
  y as (select cluster_id, pos, size, upper(substr(seq, pos + 1, 1)) b from x),
  k as (select cluster_id, pos, cast(sum(size) filter (where b = 'C') as bigint) c0, cast(sum(size) filter (where b = 'A') as bigint) a0, cast(sum(size) filter (where b = 'T') as bigint) t0, cast(sum(size) filter (where b = 'G') as bigint) g0,
          cast(sum(size) as bigint) n_all, cast(coalesce(sum(size) filter (where b = '-'), 0) as bigint) gaps from y group by 1, 2),
  cols as (select cluster_id, pos, coalesce(c0, 0) c, coalesce(a0, 0) a, coalesce(t0, 0) t, coalesce(g0, 0) g, n_all, gaps, coalesce(c0, 0) + coalesce(a0, 0) + coalesce(t0, 0) + coalesce(g0, 0) depth from k)"""
_CALLS = f"""{_COLS}, o as (select *, list_sort([{{'n': -a, 'b': 'A'}}, {{'n': -c, 'b': 'C'}}, {{'n': -g, 'b': 'G'}}, {{'n': -t, 'b': 'T'}}]) r from cols),
  n as (select cluster_id, pos, depth, gaps, n_all, c, a, t, g, -r[1].n n1, -r[2].n n2, r[1].b b1, r[2].b b2 from o),
  z as (select *, if(n1 + n2 > 500, floor(500.0 * n1 / (n1 + n2)), n1)::double m1, if(n1 + n2 > 500, floor(500.0 * n2 / (n1 + n2)), n2)::double m2 from n),
  l as (select *, exp(lgamma(m1 + m2 + 1) - lgamma(m1 + 1) - lgamma(m2 + 1)) ch from z),
  p as (select *, 0.01 * ch / pow(2, m1 + m2) ht, 0.495 * ch * pow(0.001, m2) * pow(0.999, m1) h1, 0.495 * ch * pow(0.001, m1) * pow(0.999, m2) h2,
          coalesce(map {{'AG': 'R', 'GT': 'K', 'CG': 'S', 'CT': 'Y', 'AT': 'W', 'AC': 'M'}}[least(b1, b2) || greatest(b1, b2)], 'N') code from l),
  calls as (select cluster_id, pos, c, a, t, g, n_all, gaps, depth, case when gaps = n_all and n_all > 0 then '-' when depth < 6 then 'N' when n2 = 0 then b1 when n1 + n2 < 6 then 'N'
          else case when greatest(ht, h1, h2) / (ht + h1 + h2) < 0.95 then 'N' when ht > h1 then code else b1 end end call from p)"""
_CONS = f"""{_CALLS}, j as (select cluster_id, string_agg(call, '' order by pos) full_seq from calls group by 1),
  cons as (select cluster_id, regexp_replace(full_seq, '^[N-]+|[N-]+$', '', 'g') seq, length(full_seq) - length(regexp_replace(full_seq, '^[N-]+', '')) cut_left from j),
  e as (select cluster_id, seq, length(seq) length, length(seq) - length(regexp_replace(seq, '[RKSYWM]', '', 'g')) n_het, length(seq) - length(replace(seq, 'N', '')) n_missing, cut_left from cons),
  m as (select *, n_het > length * 0.05::double fails_het, n_missing > length * 0.05::double fails_missing, length < 35 fails_length from e)"""


@query(f"with {_DEPTH} select * from d")
def a04_cluster_depth(spark, d):
    return K.cluster_depths(_stacks(spark, d))


def _stat(name, least):
    return f"count(*) filter (where depth >= {least}) n_{name}, round(avg(depth) filter (where depth >= {least}), 6) mean_{name}, round(stddev_pop(depth) filter (where depth >= {least}), 6) sd_{name}"


@query(f"with {_DEPTH} select sample, count(*) n_clusters, {_stat('all', 0)}, {_stat('mj', 6)}, {_stat('stat', 6)}, cast(floor(avg(longest) filter (where depth >= 6) + 2 * stddev_pop(longest) filter (where depth >= 6)) as bigint) max_len from d group by 1")
def a05_depth_stats(spark, d):
    return K.depth_stats(K.cluster_depths(_stacks(spark, d)))


@query(f"with {_DEPTH} select sample, least(depth, 25) depth_bin, count(*) n from d group by 1, 2")
def a05_depth_histogram(spark, d):
    return K.depth_histogram(K.cluster_depths(_stacks(spark, d)))


@query(f"with {_DEPTH} select * from d where depth between 6 and 10000")
def f13_depth_filter(spark, d):
    return K.filter_depth(K.cluster_depths(_stacks(spark, d)))


@query(f"""with {_ROWS}, m as (select cluster_id, regexp_replace(unnest(string_split(seq, 'nnnn')), '^-+|-+$', '', 'g') s from r)
  select cluster_id, max(length(s) - length(replace(s, '-', ''))) gaps, max(length(s) - length(replace(s, '-', ''))) <= 8 keep from m group by 1""")
def f11_indel_filter(spark, d):
    return K.indel_filter(_stacks(spark, d))


@query("select distinct pair_id, indels from hit_pairs where indels <= 8")
def f10_hit_indel_cap(spark, d):
    return table(spark, d, "hit_pairs").where("indels <= 8").select("pair_id", "indels").distinct()


@query(f"""with {_ROWS} select cluster_id, max(if(hit_rank = 0, length(seq) - length(regexp_replace(seq, '^-+', '')), null)) "left",
  coalesce(min(if(orient = '-', length(regexp_replace(seq, '-+$', '')), null)), max(length(seq))) "right" from r group by 1""")
def f12_edge_trim(spark, d):
    return K.edge_trim(_stacks(spark, d))


@query(f"with {_COLS} select cluster_id, pos, c, a, t, g, depth from cols")
def a06_base_counts(spark, d):
    return _deep_columns(spark, d).select("cluster_id", "pos", "c", "a", "t", "g", "depth")


@query(f"with {_COLS} select c, a, t, g, count(*) n from cols group by all")
def a07_unique_stacks(spark, d):
    return K.unique_columns(_deep_columns(spark, d))


@query(f"with {_COLS} select cluster_id, pos, gaps, n_all from cols where gaps < 0.8::double * n_all")
def f14_repeat_mask(spark, d):
    return K.mask_repeats(_deep_columns(spark, d)).select("cluster_id", "pos", "gaps", "n_all")


@query(f"with {_CALLS} select cluster_id, pos, call from calls")
def m01_base_call(spark, d):
    return K.call_columns(_deep_columns(spark, d)).select("cluster_id", "pos", "call")


@query(f"with {_CONS} select * from e")
def m03_consensus(spark, d):
    return K.consensus(K.call_columns(_deep_columns(spark, d)))


@query(f"with {_CONS} select cluster_id, fails_het, fails_missing, fails_length, not (fails_het or fails_missing or fails_length) keep from m")
def f15_f16_consensus_filters(spark, d):
    return K.consensus_filters(K.consensus(K.call_columns(_deep_columns(spark, d)))).select("cluster_id", "fails_het", "fails_missing", "fails_length", "keep")


@query(f"""with {_CONS} select sample, count(*) n_clusters, count(*) filter (where not depth between 6 and 10000) filtered_by_depth, count(*) filter (where depth between 6 and 10000 and fails_het) filtered_by_het,
  count(*) filter (where depth between 6 and 10000 and not fails_het and (fails_missing or fails_length)) filtered_by_missing,
  count(*) filter (where depth between 6 and 10000 and not (fails_het or fails_missing or fails_length)) reads_consens from d left join m using (cluster_id) group by 1""")
def a11_step_counters(spark, d):
    marked = K.consensus_filters(K.consensus(K.call_columns(_deep_columns(spark, d))))
    return K.consensus_counters(K.cluster_depths(_stacks(spark, d)), marked)


_HAPS = f"""{_CALLS}, hs as (select cluster_id, pos from calls where call in ('R', 'K', 'S', 'Y', 'W', 'M')),
  hl as (select x.cluster_id, x.hit_rank, x.size, string_agg(upper(substr(x.seq, x.pos + 1, 1)), '' order by x.pos) haplotype from x join hs using (cluster_id, pos) group by 1, 2, 3),
  hc as (select cluster_id, haplotype, cast(sum(size) as bigint) n from hl where regexp_full_match(haplotype, '[ACGT]+') group by 1, 2)"""


@query(f"with {_HAPS} select * from hc")
def a10_haplotypes(spark, d):
    return K.haplotypes(_stacks(spark, d), K.call_columns(_deep_columns(spark, d)))


@query(f"with {_HAPS}, t as (select cluster_id, count(*) kinds, sum(n) depth from hc group by 1) select cluster_id, count(*) filter (where kinds <= 2 or n > greatest(1, floor(depth / 10))) n_alleles from hc join t using (cluster_id) group by 1")
def f17_allele_numbers(spark, d):
    return K.allele_numbers(K.haplotypes(_stacks(spark, d), K.call_columns(_deep_columns(spark, d))))


@query("with i as (select distinct sample, cluster_id from clusters) select sample, cluster_id, sample || '_' || (row_number() over (partition by sample order by cluster_id) - 1) name from i")
def w02_k17_renumber(spark, d):
    return K.renumber(_stacks(spark, d))


@query()
def a08_m04_het_error(spark, d):
    rows = _stacks(spark, d)
    owner = rows.select("cluster_id", "sample").distinct()
    return K.estimate_het_error(owner.join(_deep_columns(spark, d), "cluster_id", "left"))


@query()
def m32_align(spark, d):
    return K.align_stacks(_stacks(spark, d))


@query(f"with {_ROWS} select sample, cluster_id, hit_rank, row_number() over (partition by cluster_id order by (hit_rank <> 0), size desc, hit_rank) - 1 place from r")
def w05_hits_by_size(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("cluster_id").orderBy(F.col("hit_rank") != 0, F.desc("size"), "hit_rank")
    return _stacks(spark, d).select("sample", "cluster_id", "hit_rank", (F.row_number().over(order) - 1).alias("place"))
