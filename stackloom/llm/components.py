"""Problem 6: pairwise matches consolidated into groups.

Method: minimum labels are propagated across edges and shortened by pointer
jumping (each node's label is replaced by the label of its label, twice a round) until no
label changes. After each round
links are contracted to the labels of their ends: links inside a group and repeated ones go, so
the rounds shrink with the number of groups that are left to join, and nodes are labelled
once, at the end, through the chain of their labels. Every round is
written to the checkpoint folder, so lineage stays short and a lost executor
costs one round. All state is distributed: no links, labels or components
reach the driver, only one count a round.

A hub (one record linked with a third of all) is not a problem: minimum
labels are partially aggregated before the shuffle, and the joins on labels
are left to adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.plans.durable import Rounds


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(scope, node, component)`` of every node of ``edges(scope, src,
    dst)``; ``component`` is the smallest node of the group.

    Edges with a null end or scope are ignored, loops keep their node as a group of
    its own, repeated edges count once, no edges give no rows, other columns
    are ignored."""
    clean = edges.where(F.col("scope").isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull()).select("scope", F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))
    tables = Rounds(edges.sparkSession, "components")
    links = tables.write("links", clean.select("scope", F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    labelled: list[DataFrame] = []
    for k in range(max_rounds):
        # every node hooks onto the smallest of itself and its neighbours; labels only fall, so no two hook onto each other
        ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("label")), F.struct(F.col("dst").alias("node"), F.col("dst").alias("label"))))
        hooked = links.select("scope", ends.alias("e")).select("scope", "e.*").groupBy("scope", "node").agg(F.min("label").alias("label"))
        # pointer jumping: the label of the label of the label; ``above`` is one more
        upper = hooked.select("scope", F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = hooked.join(upper, ["scope", "label"])
        for _ in range(2):
            jumped = jumped.select("scope", "node", F.col("above").alias("label")).join(upper, ["scope", "label"])
        labels = tables.write(f"labels{k}", jumped.select("scope", "node", "label", "above"))
        labelled.append(labels.select("scope", "node", "label"))
        # links between the labels of their ends, and from labels that are not their own; those inside a group are done with
        at = lambda end: labels.select("scope", F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
        between = links.where("src <> dst").join(at("src"), ["scope", "src"]).join(at("dst"), ["scope", "dst"]).where("src_label <> dst_label")
        left = labels.where("label <> above").select("scope", F.col("label").alias("src"), F.col("above").alias("dst"))
        links = tables.write("links", between.select("scope", F.greatest("src_label", "dst_label").alias("src"), F.least("src_label", "dst_label").alias("dst")).unionByName(left).distinct())
        if not links.head(1):
            tables.drop("links")
            break
    else:
        raise RuntimeError(f"labels still change after {max_rounds} rounds")
    # a node's label, the label of that in the next round, and so on; later rounds have ever fewer nodes
    known = labelled[0]
    for later in labelled[1:]:
        known = known.join(later.select("scope", F.col("node").alias("label"), F.col("label").alias("next")), ["scope", "label"], "left").select("scope", "node", F.coalesce("next", "label").alias("label"))
    return known.withColumnRenamed("label", "component")


def label_key(column):
    """Label as compared: lower case, without a leading ``>``, anything from
    the first ``;`` and surrounding blanks or tabs."""
    edge = "[ \\t]"
    bare = F.regexp_replace(column, f"^{edge}*>?", "")
    bare = F.regexp_replace(bare, "(?s);.*$", "")
    return F.lower(F.regexp_replace(bare, f"^{edge}+|{edge}+$", ""))


def consolidate_hits(hits: DataFrame, records: DataFrame) -> DataFrame:
    """``(tier, rec_id, group_id)`` of every record linked, directly or through
    others, with at least one other.

    ``hits`` has ``tier, query_label, target_label``; ``records`` has ``tier,
    rec_id, label``. A hit with a null, blank or unknown label links nothing;
    repeated hits count once. A hit of a record with itself links nothing."""
    known = records.where(F.col("label").isNotNull() & F.col("rec_id").isNotNull()).select("tier", F.col("rec_id").cast("bigint").alias("rec_id"), label_key(F.col("label")).alias("key")).where("key <> ''").distinct()
    asked = hits.select("tier", label_key(F.col("query_label")).alias("q"), label_key(F.col("target_label")).alias("t")).where("tier is not null and q <> '' and t <> ''").distinct()
    found = (
        asked.join(known.select("tier", F.col("key").alias("q"), F.col("rec_id").alias("src")), ["tier", "q"])
        .join(known.select("tier", F.col("key").alias("t"), F.col("rec_id").alias("dst")), ["tier", "t"])
        .where("src <> dst")
    )
    groups = connected_components(found.select(F.col("tier").alias("scope"), "src", "dst"))
    return groups.select(F.col("scope").alias("tier"), F.col("node").alias("rec_id"), F.col("component").alias("group_id"))
