"""Problem 1: records that differ by small edits, found without comparing all pairs.

Method: the generalised pigeonhole principle with unequal thresholds, allocated by dynamic programming on estimated candidate
counts, probe and verify (``functions/pigeonhole``), laid out in bounded cells (``operators/similarity``). Letters of two bits
each are the correlated bits that are grouped into partitions. No step is approximate: every pair within the bound is found.

Exact copies are collapsed before and expanded only where pairs are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm.components import connected_components
from stackloom.operators.similarity import similar_classes
from stackloom.plans.durable import cut


def normalise_sequence(column):
    """Upper-cased letters without gaps; the mates of a pair joined by ``|``."""
    joined = F.replace(column, F.lit("nnnn"), F.lit("|"))
    clean = F.replace(F.upper(joined), F.lit("-"), F.lit(""))
    return F.when(F.length(column) - F.length(joined) == 3, clean).otherwise(F.replace(clean, F.lit("|"), F.lit("")))


def distinct_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, classes) of ``records(record_kind, rec_id, sample, seq)``: ``clean(record_kind, sample, rec_id, letters)`` and,
    written out, one row for each different sequence of a sample, ``classes(record_kind, sample, letters, rep, n)``, with its
    smallest id and number of ids. Rows with a null or empty sequence or a null sample are in neither."""
    clean = (
        records.where(F.col("seq").isNotNull() & F.col("sample").isNotNull() & F.col("rec_id").isNotNull())
        .select("record_kind", "sample", F.col("rec_id").cast("bigint").alias("rec_id"), normalise_sequence(F.col("seq")).alias("letters"))
        .where(F.length(F.replace("letters", F.lit("|"), F.lit(""))) > 0)
        .distinct()
    )
    return clean, cut(clean.groupBy("record_kind", "sample", "letters").agg(F.min("rec_id").alias("rep"), F.count(F.lit(1)).alias("n")))


def _copies(clean: DataFrame, classes: DataFrame) -> DataFrame:
    """``record_kind, sample, rep, rec_id`` of the records that are not the first of their class; only classes of several are joined."""
    several = classes.where("n > 1").select("record_kind", "sample", "letters", "rep")
    return clean.join(several, ["record_kind", "sample", "letters"]).where("rec_id <> rep").select("record_kind", "sample", "rep", "rec_id")


def similar_pairs(records: DataFrame, min_identity: float = 0.85) -> DataFrame:
    """All pairs ``(record_kind, id_a, id_b)``, ``id_a < id_b``, of different
    records of one sample with an identity of at least ``min_identity``.

    ``records`` has ``record_kind, rec_id, sample, seq``; other columns are
    ignored. Null and empty sequences, null samples and null ids are in no
    pair; repeated rows count once; an empty table gives no rows."""
    clean, classes = distinct_records(records)
    found = cut(similar_classes(classes, min_identity).select("record_kind", "sample", "rep_a", "rep_b"))
    copies = cut(_copies(clean, classes))
    # pairs of first records, then those of their copies
    for side in ("rep_a", "rep_b"):
        more = found.join(copies.withColumnRenamed("rep", side), ["record_kind", "sample", side])
        found = found.unionByName(more.drop(side).withColumnRenamed("rec_id", side))
    # copies of each other: each with its first record, and with each later one
    own = copies.select("record_kind", "sample", "rep", F.col("rec_id").alias("y"))
    alike = own.select("record_kind", F.col("rep").alias("x"), "y").unionByName(own.join(copies.withColumnRenamed("rec_id", "x"), ["record_kind", "sample", "rep"]).where("x < y").select("record_kind", "x", "y"))
    pairs = found.select("record_kind", F.col("rep_a").alias("x"), F.col("rep_b").alias("y")).unionByName(alike)
    return pairs.where("x <> y").select("record_kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def similar_groups(records: DataFrame, min_identity: float = 0.85) -> DataFrame:
    """One row for each record that has a sequence: ``(record_kind, rec_id,
    group_id, links)``. ``group_id`` is the smallest id of the records joined
    by chains of matches; ``links`` counts matching classes of other
    sequences. Copies are not expanded into pairs."""
    clean, classes = distinct_records(records)
    found = cut(similar_classes(classes, min_identity).select("record_kind", "rep_a", "rep_b"))
    links = found.select("record_kind", F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("record_kind", "rep").agg(F.count(F.lit(1)).alias("links"))
    groups = connected_components(found.select(F.col("record_kind").alias("scope"), F.col("rep_a").alias("src"), F.col("rep_b").alias("dst")))
    groups = groups.select(F.col("scope").alias("record_kind"), F.col("node").alias("rep"), F.col("component").alias("group"))
    members = classes.select("record_kind", "rep", F.col("rep").alias("rec_id")).unionByName(_copies(clean, classes).select("record_kind", "rep", "rec_id"))
    return (
        members.join(links, ["record_kind", "rep"], "left")
        .join(groups, ["record_kind", "rep"], "left")
        .select("record_kind", "rec_id", F.coalesce("group", "rep").alias("group_id"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))
    )
