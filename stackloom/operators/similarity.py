"""Similarity join: all pairs of different sequences of a sample within an edit distance.

Work is laid out in bounded cells: a sample with many records is split by
length band (records more than the bound apart in length never meet) and by
hash into blocks, so neither a hot sample nor a large band ends in one task.
Cells are bounded by letters, so long records have cells of few.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.functions.pigeonhole import match_cell
from stackloom.plans.durable import cut, python_tasks

#: ratio of neighbouring length bands; above 1 / 0.85, so that at this identity a text meets the patterns of two bands
_BAND = 1.18
#: records up to this length may share a cell whatever their lengths, and count as one of this many letters
_SHORT, _UNIT = 640, 128
#: tasks above which each takes more cells
_TASKS = 20_000


def _band(letters: Column) -> Column:
    return F.floor(F.log(F.length(F.replace(letters, F.lit("|"), F.lit(""))).cast("double")) / math.log(_BAND)).cast("int")


def similar_classes(classes: DataFrame, min_identity: float = 0.85, cell: int = 30_000, both_strands: bool = True) -> DataFrame:
    """Pairs of different sequences of one sample with an identity of at least
    ``min_identity``: ``(record_kind, sample, rep_a, rep_b, edits, longer)``, from ``classes(record_kind, sample, rep, letters)``,
    which is read more than once and should be a table or cut.

    ``cell`` bounds the patterns of a task (of 128 letters; long ones count as several); a task holds at most about twice as many texts
    (more at an identity under 0.85). Without ``both_strands`` sequences are compared as they stand."""
    reach, last = math.ceil(math.log(1 / min_identity) / math.log(_BAND) - 1e-9), math.floor(math.log(_SHORT) / math.log(_BAND))
    rows = classes.select("record_kind", "sample", "rep", "letters", _band(F.col("letters")).alias("band"))
    weight = F.count(F.lit(1)) * F.greatest(F.pow(F.lit(_BAND), F.col("band") + 1) / _UNIT, F.lit(1.0))
    counts = rows.groupBy("record_kind", "sample", "band").agg(weight.alias("n"))
    whole = counts.where(F.col("band") <= last).groupBy("record_kind", "sample").agg(F.sum("n").alias("total"))
    tiny = cell // 6
    bins = max(1, math.ceil((whole.where(F.col("total") <= tiny).agg(F.sum("total")).first()[0] or 0) / (cell // 3)))
    # samples of few records share cells; others up to the size of a cell have one each
    shared = F.when(F.col("total") <= tiny, F.pmod(F.xxhash64("record_kind", "sample"), F.lit(bins)))
    small = F.coalesce((F.col("total") <= cell) & (F.col("band") <= last), F.lit(False))
    sized = counts.join(whole, ["record_kind", "sample"], "left").select("record_kind", "sample", "band", small.alias("small"), F.when(small, shared).cast("int").alias("bin"), F.ceil(F.col("n") / cell).cast("int").alias("blocks"))
    sized = cut(sized)  # a row for each sample and band
    # the blocks of each band that a text of this band must meet
    meets = (
        sized.select("record_kind", "sample", F.col("band").alias("p_band"), F.col("small").alias("p_small"), F.col("blocks").alias("p_blocks"), F.explode(F.sequence(F.col("band") - reach, F.col("band"))).alias("band"))
        .where("not p_small")
        .groupBy("record_kind", "sample", "band")
        .agg(F.collect_list(F.struct("p_band", "p_blocks")).alias("meets"))
    )
    # the blocks of texts that a pattern of this band must meet
    parts = (
        sized.select("record_kind", "sample", "blocks", F.explode(F.sequence(F.col("band"), F.col("band") + reach)).alias("band"))
        .groupBy("record_kind", "sample", "band")
        .agg(F.max("blocks").alias("parts"))
    )
    layout = sized.join(meets, ["record_kind", "sample", "band"], "left").join(parts, ["record_kind", "sample", "band"])
    # a sample's cells: one for all of its short records, or one for each pair of blocks
    n_cells = layout.agg(F.sum(F.when(F.col("small"), F.lit(0.2)).otherwise(F.col("blocks") * F.col("parts")))).first()[0] or 0
    placed = rows.join(layout, ["record_kind", "sample", "band"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # each record goes to its sample's cell with both roles, or as a text to the cells of longer records and as a pattern to its own
    own, none = F.concat_ws("/", "record_kind", "sample"), F.lit(-1)
    place = lambda cell, bin, p_band, p_block, t_part, role: F.struct(cell.alias("cell"), bin.alias("bin"), p_band.alias("p_band"), p_block.alias("p_block"), t_part.alias("t_part"), F.lit(role).alias("role"))
    same = F.when(F.col("small"), F.array(place(F.when(F.col("bin").isNull(), own).otherwise(""), F.coalesce("bin", none), none, F.lit(0), F.lit(0), 2)))
    as_text = F.flatten(F.transform(F.col("meets"), lambda m: F.transform(F.sequence(F.lit(0), m["p_blocks"] - 1), lambda k: place(own, none, m["p_band"], k, F.col("block"), 0))))
    as_pattern = F.when(~F.col("small"), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: place(own, none, F.col("band"), F.col("block"), k, 1)))
    nowhere = F.array().cast("array<struct<cell:string,bin:int,p_band:int,p_block:int,t_part:int,role:int>>")
    everywhere = F.concat(*[F.coalesce(x, nowhere) for x in (same, as_text, as_pattern)])
    keys = ["cell", "bin", "p_band", "p_block", "t_part"]
    # a cell takes far more work than its bytes suggest, so partitions follow the number of cells and are not merged by size
    tasks = max(64, python_tasks(classes.sparkSession), min(_TASKS, int(n_cells / 4)))
    cells = placed.select("record_kind", "sample", "rep", "letters", F.explode(everywhere).alias("x")).select(*[f"x.{k}" for k in keys], "x.role", "record_kind", "sample", "rep", "letters").repartition(tasks, *keys)
    schema = "record_kind string, sample string, rep_a bigint, rep_b bigint, edits int, longer int"
    kinds = pa.schema([("record_kind", pa.string()), ("sample", pa.string()), ("rep_a", pa.int64()), ("rep_b", pa.int64()), ("edits", pa.int32()), ("longer", pa.int32())])

    def match(group: pa.Table) -> pa.Table:
        letters = group.column("letters").to_pylist()
        role, rank = group.column("role").to_numpy(), group.column("rep").to_numpy()
        kind, sample = (group.column(c).combine_chunks() for c in ("record_kind", "sample"))
        scope = pc.binary_join_element_wise(kind, sample, "/").dictionary_encode().indices.to_numpy()
        a, b, d = match_cell(letters, role >= 1, role != 1, rank, min_identity, scope, both_strands)
        longer = np.array([len(letters[i].replace("|", "")) for i in a], dtype=np.int32)
        at = pa.array(a)
        return pa.table([kind.take(at), sample.take(at), pa.array(np.minimum(rank[a], rank[b])), pa.array(np.maximum(rank[a], rank[b])), pa.array(d.astype(np.int32)), pa.array(longer)], schema=kinds)

    return cells.groupBy(*keys).applyInArrow(match, schema)
