"""The queries of the language-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm.components import consolidate_hits
from stackloom.llm.heavy_hitters import frequent_items, read_hits, top_items
from stackloom.llm.mixing import mix_sources, mixture_report
from stackloom.llm.near_edits import similar_groups, similar_pairs
from stackloom.llm.reading import reading_levels
from stackloom.llm.tokenizer import encode_documents
from stackloom.sources.tables import table


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """Reads and first reads of clusters as ``record_kind, rec_id, sample, seq``."""
    edits = table(spark, d, "edits").select(F.lit("edits").alias("record_kind"), F.col("edit_id").alias("rec_id"), "sample", "seq")
    firsts = table(spark, d, "clusters").where("hit_rank = 0").select(F.lit("clusters").alias("record_kind"), F.col("cluster_id").alias("rec_id"), "sample", F.col("aligned_seq").alias("seq"))
    return edits.unionByName(firsts)


def labelled_records(spark: SparkSession, d: str) -> DataFrame:
    """The records that hits compare, as ``tier, rec_id, label``."""
    base = table(spark, d, "clust_database").select(F.lit("database").alias("tier"), F.col("seq_id").alias("rec_id"), "label")
    return base.unionByName(table(spark, d, "clusters").select(F.lit("clusters").alias("tier"), F.col("cluster_id").alias("rec_id"), "label"))


def p1_found(spark, d):
    return similar_pairs(sequences(spark, d))


def p1_groups(spark, d):
    return similar_groups(sequences(spark, d))


def p2_found(spark, d):
    return top_items(read_hits(table(spark, d, "raw_reads")), 20).select("metric", "item")


def p2_hits(spark, d):
    return frequent_items(read_hits(table(spark, d, "raw_reads")), 20)


def p6_found(spark, d):
    return consolidate_hits(table(spark, d, "hit_pairs"), labelled_records(spark, d))


def p7_ids(spark, d):
    return encode_documents(table(spark, d, "documents"))


def p8_documents(spark, d):
    return mix_sources(table(spark, d, "documents"), table(spark, d, "source_targets"))


def p8_shares(spark, d):
    targets = table(spark, d, "source_targets")
    return mixture_report(mix_sources(table(spark, d, "documents"), targets), targets)


def p9_levels(spark, d):
    return reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_hits, p6_found, p7_ids, p8_documents, p8_shares, p9_levels)}

_LABEL = "lower(trim(regexp_replace(regexp_replace({}, '^[ \\t]*>?', ''), ';[\\s\\S]*$', ''), ' ' || chr(9)))"

ORACLE_SQL = {
    "p2_found": """
        with hits as (
          select 'barhits' metric, upper(trim(barcode, ' ' || chr(9) || chr(10) || chr(13))) item from raw_reads
          union all select 'samplehits', regexp_replace(sample, '-technical-replicate-.*$', '') from raw_reads),
        counted as (select metric, item, count(*) n from hits where item is not null and item <> '' group by 1, 2)
        select metric, item from counted qualify row_number() over (partition by metric order by n desc, item) <= 20""",
    "p6_found": f"""
        with recursive rec as (
          select 'database' tier, seq_id rec_id, {_LABEL.format("label")} k from clust_database where label is not null
          union select 'clusters', cluster_id, {_LABEL.format("label")} from clusters where label is not null),
        links as (
          select distinct h.tier, a.rec_id a, b.rec_id b from hit_pairs h
          join rec a on a.tier = h.tier and a.k = {_LABEL.format("h.query_label")}
          join rec b on b.tier = h.tier and b.k = {_LABEL.format("h.target_label")} where a.rec_id <> b.rec_id),
        both_ways as (select tier, a, b from links union select tier, b, a from links),
        reach(tier, a, b) as (select tier, a, a from both_ways union select r.tier, r.a, e.b from reach r join both_ways e on e.tier = r.tier and e.a = r.b)
        select tier, a rec_id, min(b) group_id from reach group by 1, 2""",
}
