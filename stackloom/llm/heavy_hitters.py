"""Problem 2: the most frequent items of a column, in bounded memory.

Method: Misra-Gries summaries. Every partition keeps at most ``counters``
counters for each metric; when there are more, the next-largest count (that of rank
``counters + 1``) is subtracted from all and those at or below zero go.
Summaries merge the same way (counters are added, then the next-largest is
subtracted), in a tree whose nodes hold at most ``fan_in`` summaries. An item
occurring f times keeps a counter between ``f - error`` and f, where ``error``
(the sum of what was subtracted) is at most N / (counters + 1): no item above
that frequency is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "metric string, item string, kept bigint, error bigint, seen bigint, node bigint"
_ARROW = pa.schema([("metric", pa.string()), ("item", pa.string()), ("kept", pa.int64()), ("error", pa.int64()), ("seen", pa.int64()), ("node", pa.int64())])


class Summary:
    """A Misra-Gries summary of at most ``counters`` items."""

    def __init__(self, counters: int):
        self.counters, self.kept, self.error, self.seen = counters, {}, 0, 0

    def add(self, items: list, counts: list) -> None:
        kept = self.kept
        for item, n in zip(items, counts):
            kept[item] = kept.get(item, 0) + n
        self._shrink()

    def _shrink(self) -> None:
        if len(self.kept) <= self.counters:
            return
        cut = sorted(self.kept.values(), reverse=True)[self.counters]
        self.kept = {k: n - cut for k, n in self.kept.items() if n > cut}
        self.error += cut

    def merge(self, items: list, counts: list, error: int, seen: int) -> None:
        self.error += error
        self.seen += seen
        self.add(items, counts)

    def rows(self, metric: str, node: int) -> pa.RecordBatch:
        """The counters, and one row with a null item that carries the totals
        even where no counter is left."""
        n = len(self.kept)
        return pa.record_batch(
            [pa.array([metric] * (n + 1), pa.string()), pa.array([*self.kept, None], pa.string()), pa.array([*self.kept.values(), 0], pa.int64()), pa.array([0] * n + [self.error], pa.int64()), pa.array([0] * n + [self.seen], pa.int64()), pa.array([node] * (n + 1), pa.int64())],
            schema=_ARROW,
        )


def summarise(columns: DataFrame, counters: int, fan_in: int = 16) -> DataFrame:
    """One merged summary for each column of ``columns`` (all strings), as rows
    ``(metric, item, kept, error, seen)``; nulls do not count."""
    metrics = columns.columns

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        node = TaskContext.get().partitionId()
        made = {m: Summary(counters) for m in metrics}
        for batch in batches:
            for m in metrics:
                column = batch.column(batch.schema.get_field_index(m)).drop_null()
                counted = pc.value_counts(column)
                made[m].seen += len(column)
                made[m].add(counted.field("values").to_pylist(), counted.field("counts").to_pylist())
        for m in metrics:
            yield made[m].rows(m, node)

    def merge(group: pa.Table) -> pa.Table:
        out = Summary(counters)
        for node in pc.unique(group.column("child")).to_pylist():
            part = group.filter(pc.equal(group.column("child"), node))
            named = part.filter(pc.is_valid(part.column("item")))
            out.merge(named.column("item").to_pylist(), named.column("kept").to_pylist(), pc.sum(part.column("error")).as_py(), pc.sum(part.column("seen")).as_py())
        return pa.Table.from_batches([out.rows(group.column("metric")[0].as_py(), group.column("node")[0].as_py())])

    rows, nodes = columns.mapInArrow(partial, _SCHEMA), columns.rdd.getNumPartitions()
    while True:
        nodes = -(-nodes // fan_in)
        level = rows.withColumn("child", F.col("node")).withColumn("node", F.floor(F.col("node") / fan_in))
        rows = level.groupBy("metric", "node").applyInArrow(merge, _SCHEMA)
        if nodes <= 1:
            return rows.drop("node")


#: counters of a metric above which all items are counted instead
_MOST = 1 << 20


def frequent_items(columns: DataFrame, top: int = 20, counters: int = 4096) -> DataFrame:
    """``(metric, item, approx_count, max_error)``: for each column all items that can be
    among its ``top`` most frequent. The true count lies between
    ``approx_count`` and ``approx_count + max_error``. Summaries are enlarged
    as for ``top_items``; where all items are counted, ``max_error`` is 0.

    Null items do not count; blank ones count like any other (clean before);
    an empty table gives no rows; ties at the border are all kept."""
    found = _candidates(columns, top, counters)
    if found is not None:
        return found
    from stackloom.plans.durable import cut

    counted = cut(_melted(columns).groupBy("metric", "item").agg(F.count(F.lit(1)).alias("approx_count")))
    best = None
    for m in columns.columns:
        own = counted.where(F.col("metric") == m)
        border = own.orderBy(F.desc("approx_count")).limit(top).agg(F.min("approx_count").alias("border"))  # one row
        one = own.join(F.broadcast(border), F.col("approx_count") >= F.col("border")).drop("border")
        best = one if best is None else best.unionByName(one)
    return best.withColumn("max_error", F.lit(0).cast("bigint"))


def _possible(rows: DataFrame, top: int) -> DataFrame:
    total = F.broadcast(rows.where("item is null").select("metric", F.col("error").alias("max_error")))  # one row for each metric
    named = rows.where("item is not null").join(total, "metric").select("metric", "item", F.col("kept").alias("approx_count"), "max_error")
    rank = F.sort_array(F.collect_list("approx_count"), asc=False)
    border = named.groupBy("metric").agg(F.coalesce(F.get(rank, F.lit(top - 1)), F.lit(0)).alias("border"))  # at most `counters` rows for each metric
    return named.join(border, "metric").where("approx_count + max_error >= border").drop("border")


def _candidates(columns: DataFrame, top: int, counters: int) -> DataFrame | None:
    """The items that can be among the ``top``, from a summary large enough to have a counter for each; None if that needs more than ``_MOST``."""
    from stackloom.plans.durable import cut

    while counters <= _MOST:
        rows = cut(summarise(columns, counters))
        # an item without a counter occurs at most `error` times; it must lie below the border
        state = rows.groupBy("metric").agg(F.max("error").alias("error"), F.slice(F.sort_array(F.collect_list(F.when(F.col("item").isNotNull(), F.col("kept"))), asc=False), top, 1).alias("last")).collect()
        if all(s["error"] == 0 or (s["last"] and s["last"][0] > s["error"]) for s in state):
            return _possible(rows, top)
        counters *= 8
    return None


def _melted(columns: DataFrame) -> DataFrame:
    return columns.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("item")) for m in columns.columns])).alias("x")).select("x.*").where("item is not null")


def top_items(columns: DataFrame, top: int = 20, counters: int = 4096) -> DataFrame:
    """``(metric, item, hits)``: the ``top`` most frequent items of each column
    with exact counts; ties by item. Candidates come from the summaries and
    are then counted. Where the error bound cannot part the candidates from
    the dropped items, the summary is made again with 8 times the counters;
    above a million counters all items are counted."""
    metrics = columns.columns
    found, melted = _candidates(columns, top, counters), _melted(columns)
    if found is not None:
        melted = melted.join(found.select("metric", "item"), ["metric", "item"], "left_semi")
    counted = melted.groupBy("metric", "item").agg(F.count(F.lit(1)).alias("hits"))
    best = None
    for m in metrics:
        one = counted.where(F.col("metric") == m).orderBy(F.desc("hits"), "item").limit(top)
        best = one if best is None else best.unionByName(one)
    return best


def read_hits(reads: DataFrame) -> DataFrame:
    """The two columns whose frequent values are wanted: barcodes (upper case,
    no surrounding blanks, null where blank) and samples (replicates under
    their plain name)."""
    barcode = F.upper(F.regexp_replace("barcode", r"^\s+|\s+$", ""))
    return reads.select(F.when(barcode != "", barcode).alias("barhits"), F.regexp_replace("sample", "(?s)-technical-replicate-.*$", "").alias("samplehits"))
