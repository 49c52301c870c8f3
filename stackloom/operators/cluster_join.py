"""Similarity clustering: greedy centroids over verified neighbours, and read mapping.

Neighbours are all pairs of a scope within the threshold, from the exact
similarity join; centroids are the
lexicographically first independent set by rank, found in rounds that each end
in the checkpoint folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.functions.sequence import reverse_complement
from stackloom.operators.similarity import similar_classes
from stackloom.plans.durable import Rounds, cut, python_tasks


def similar_records(records: DataFrame, min_identity: float = 0.85, both_strands: bool = False, cell: int = 10_000) -> DataFrame:
    """``scope, a, b, identity`` (a < b) of all pairs of ``records(scope, rec_id, seq)`` of a scope whose identity (1 - edits / longer
    length) is at least ``min_identity``; with ``both_strands`` the better of both counts.

    ``cell`` bounds the records of a block, so that neither a hot scope nor a deep locus ends in one task. No pair is
    lost, however many records are alike. Null and empty sequences are in no pair."""
    classes = cut(records.where("seq <> ''").select(F.lit("").alias("record_kind"), F.col("scope").alias("sample"), F.col("rec_id").alias("rep"), F.col("seq").alias("letters")))
    found = similar_classes(classes, min_identity, cell, both_strands)
    return found.select(F.col("sample").alias("scope"), F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), (1 - F.col("edits") / F.col("longer")).alias("identity"))


def greedy_centroids(records: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``scope, rec_id, seed``: greedy clustering by ``rank`` (1 is best) along ``edges(scope, a, b)``.

    A record that no better-ranked seed reaches is a seed; others join the
    best-ranked seed among their neighbours. Each round settles all records
    whose better-ranked neighbours are settled."""
    ranks = records.select("scope", "rec_id", "rank")
    both = edges.select("scope", F.col("a").alias("rec_id"), F.col("b").alias("other")).unionByName(edges.select("scope", F.col("b").alias("rec_id"), F.col("a").alias("other")))
    # only better-ranked neighbours matter
    better = cut(
        both.distinct().join(ranks, ["scope", "rec_id"]).join(ranks.select("scope", F.col("rec_id").alias("other"), F.col("rank").alias("other_rank")), ["scope", "other"]).where("other_rank < rank").select("scope", "rec_id", "other", "other_rank")
    )
    tables = Rounds(records.sparkSession, "centroids")
    state = tables.write("state", ranks.select("scope", "rec_id", F.lit(None).cast("boolean").alias("is_seed")))
    for _ in range(max_rounds):
        seen = better.join(state.select("scope", F.col("rec_id").alias("other"), F.col("is_seed").alias("other_seed")), ["scope", "other"]).groupBy("scope", "rec_id").agg(F.bool_or("other_seed").alias("hit"), F.count_if(F.col("other_seed").isNull()).alias("open"))
        nxt = state.join(seen, ["scope", "rec_id"], "left")
        settled = F.when(F.col("is_seed").isNotNull(), F.col("is_seed")).when(F.col("hit"), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state = tables.write("state", nxt.select("scope", "rec_id", settled.alias("is_seed")))
        if not state.where("is_seed is null").limit(1).count():
            break
    else:
        raise RuntimeError(f"records are unsettled after {max_rounds} rounds")
    seeds = state.where("is_seed").select("scope", F.col("rec_id").alias("other"))
    choice = better.join(seeds, ["scope", "other"]).groupBy("scope", "rec_id").agg(F.min(F.struct("other_rank", "other"))["other"].alias("seed"))
    return state.join(choice, ["scope", "rec_id"], "left").select("scope", "rec_id", F.when(F.col("is_seed"), F.col("rec_id")).otherwise(F.col("seed")).alias("seed"))


def cluster_sequences(records: DataFrame, min_identity: float = 0.85, both_strands: bool = False, cell: int = 10_000) -> DataFrame:
    """``scope, rec_id, seed`` for ``records(scope, rec_id, seq, rank)``. With ``both_strands`` sequences also match on the other strand."""
    kept = cut(records.select("scope", "rec_id", "seq", "rank"))
    return greedy_centroids(kept, cut(similar_records(kept, min_identity, both_strands, cell)))


#: reads of a cell
_READS = 20_000


def _placements(strands: DataFrame, reference: DataFrame, max_mismatch: float, stretch: int) -> DataFrame:
    """``read_id, mismatches, chrom, pos, strand``: every placement of ``strands(read_id, strand, seq, size)`` that holds
    one of the read's consecutive pieces of ``size`` letters exactly and has at most ``max_mismatch`` of its letters wrong.

    Short pieces occur everywhere by chance, so reads and stretches of the reference meet in bounded cells and only placements leave them."""
    letters = reference.agg(F.sum(F.length("seq"))).first()[0] or 0
    n, longest = strands.agg(F.count(F.lit(1)), F.max(F.length("seq"))).first()
    blocks, parts = max(1, -(-letters // stretch)), max(1, -(-n // _READS))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    # stretches overlap by the longest read; a placement belongs to the stretch it starts in
    stretches = reference.where("seq <> ''").select("chrom", F.explode(F.sequence(F.lit(0), F.length("seq") - 1, F.lit(stretch))).alias("start"), "seq").select("chrom", "start", F.expr(f"substring(seq, start + 1, {stretch + (longest or 0)})").alias("seq"))
    nothing = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    texts = stretches.select(F.pmod(F.xxhash64("chrom", "start"), F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part"), nothing(strands, "read_id"), F.lit(None).cast("string").alias("strand"), F.lit(0).alias("size"), "chrom", "start", "seq")
    reads = strands.where("seq <> ''").select(every(blocks).alias("block"), F.pmod(F.xxhash64("read_id", "strand"), F.lit(parts)).cast("int").alias("part"), "read_id", "strand", "size", nothing(reference, "chrom"), F.lit(0).alias("start"), "seq")
    cells = texts.unionByName(reads).repartition(python_tasks(strands.sparkSession), "block", "part")
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((strands, "read_id"), (reference, "chrom"))}

    def match(group: pa.Table) -> pa.Table:
        of_reads = pc.is_valid(group.column("strand"))
        text, read = group.filter(pc.invert(of_reads)), group.filter(of_reads)
        t, r, wrong, pos = _match_pieces(text.column("seq").to_pylist(), read.column("seq").to_pylist(), read.column("size").to_numpy(), max_mismatch, stretch)
        pos = text.column("start").to_numpy()[t] + pos
        return pa.table({"read_id": read.column("read_id").take(pa.array(r)), "mismatches": pa.array(wrong.astype(np.int32)), "chrom": text.column("chrom").take(pa.array(t)), "pos": pa.array(pos.astype(np.int32)), "strand": read.column("strand").take(pa.array(r))})

    return cells.groupBy("block", "part").applyInArrow(match, f"read_id {kinds['read_id']}, mismatches int, chrom {kinds['chrom']}, pos int, strand string")


def _match_pieces(texts: list[str], reads: list[str], size: np.ndarray, max_mismatch: float, stretch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, read, mismatches, position) of placements that start in the first ``stretch`` letters of a text."""
    encode = lambda strings: [x.encode("latin-1", "replace") for x in strings]
    texts, reads = encode(texts), encode(reads)
    length, text_length = (np.array([len(x) for x in some], dtype=np.int64) for some in (reads, texts))
    width = int(length.max(initial=1))
    joined = np.frombuffer(b"".join(texts) + bytes(width), np.uint8)
    end = np.cumsum(text_length)
    text_of = np.repeat(np.arange(len(texts)), text_length)
    windows, column = np.lib.stride_tricks.sliding_window_view(joined, width), np.arange(width)
    padded = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in reads), np.uint8).reshape(len(reads), width)

    def code(letters: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.uint64)  # equal codes of unlike pieces only make a candidate more
        for i in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + letters[at + i]
        return out

    kept = [(np.zeros(0, dtype=np.int64),) * 4]
    for k in np.unique(size):
        k, rows = int(k), np.flatnonzero((size == k) & (length >= k))
        pieces = length[rows] // k
        row = np.repeat(rows, pieces)
        at = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * k
        places = np.flatnonzero(np.arange(len(text_of)) + k <= end[text_of]) if len(text_of) else np.zeros(0, dtype=np.int64)
        codes = code(joined, places, k)
        order = np.argsort(codes)
        places, codes = places[order], codes[order]
        wanted = code(padded.reshape(-1), row * width + at, k)
        low = np.searchsorted(codes, wanted, "left")
        ends = np.cumsum(np.searchsorted(codes, wanted, "right") - low)
        step = max(1, (1 << 24) // width)
        for first in range(0, int(ends[-1]) if len(ends) else 0, step):  # candidates by number, so that a frequent piece is cut too
            number = np.arange(first, min(first + step, int(ends[-1])))
            which = np.searchsorted(ends, number, "right")
            begin = np.where(which > 0, ends[which - 1], 0)
            p = places[low[which] + number - begin]
            t, r = text_of[p], row[which]
            start = p - at[which]
            local = start - (end[t] - text_length[t])
            good = np.flatnonzero((local >= 0) & (local < stretch))
            t, r, start, local = t[good], r[good], start[good], local[good]
            differ = windows[start] != padded[r]
            differ |= column >= (end[t] - start)[:, None]
            differ &= column < length[r][:, None]
            wrong = differ.sum(axis=1)
            good = np.flatnonzero(wrong <= length[r] * max_mismatch)
            kept.append((t[good], r[good], wrong[good], local[good]))
    return tuple(np.concatenate(x) for x in zip(*kept))


def _best(placed: DataFrame) -> DataFrame:
    return placed.groupBy("read_id").agg(F.min(F.struct("mismatches", "chrom", "pos", "strand")).alias("m")).select("read_id", "m.chrom", "m.pos", "m.strand", "m.mismatches")


def map_reads(reads: DataFrame, reference: DataFrame, k: int = 20, max_mismatch: float = 0.1, stretch: int = 1 << 21) -> DataFrame:
    """``read_id, chrom, pos, strand, mismatches``: the best ungapped placement of each read with at most
    ``max_mismatch`` of its letters wrong.

    Of n consecutive pieces of a read, one is whole in every placement with fewer than n mismatches. The first pass has
    pieces of ``k`` letters; a read without a placement that it decides has a second one with more pieces than mismatches are allowed, in cells of about ``stretch`` letters of the reference."""
    strands = reads.select("read_id", F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("seq").alias("seq")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("seq")).alias("seq")))).alias("s")).select("read_id", "s.*")
    seeds = strands.select("read_id", "strand", "seq", F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - k, F.lit(0)), F.lit(k))).alias("at")).withColumn("kmer", F.substring("seq", F.col("at") + 1, F.lit(k)))
    index = reference.select("chrom", F.col("seq").alias("ref"), F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - k, F.lit(0)))).alias("p")).select("chrom", "p", F.substring("ref", F.col("p") + 1, F.lit(k)).alias("kmer"))
    # joins are merged, since a plan takes pieces and reads for little more than their compressed file, small enough to broadcast
    starts = seeds.join(index.hint("merge"), "kmer").select("read_id", "strand", "seq", "chrom", (F.col("p") - F.col("at")).alias("pos")).where("pos >= 0").distinct()
    placed = starts.join(reference.select("chrom", F.col("seq").alias("ref")).hint("merge"), "chrom").select("read_id", "strand", "seq", "chrom", "pos", F.substring("ref", F.col("pos") + 1, F.length("seq")).alias("under"))
    wrong = F.aggregate(F.sequence(F.lit(1), F.length("seq")), F.lit(0), lambda s, i: s + F.when(F.substring(F.col("seq"), i, F.lit(1)) == F.substring(F.col("under"), i, F.lit(1)), 0).otherwise(1))
    first = _best(placed.withColumn("mismatches", wrong).where(F.col("mismatches") <= F.length("seq") * max_mismatch))
    pieces = reads.groupBy("read_id").agg(F.min(F.floor(F.length("seq") / k)).alias("pieces"))
    decided = cut(first.join(pieces.hint("merge"), "read_id").where("mismatches < pieces").drop("pieces"))
    size = F.greatest(F.floor(F.length("seq") / (F.floor(F.length("seq") * max_mismatch) + 1)).cast("int"), F.lit(1))
    rest = cut(strands.join(decided.select("read_id").hint("merge"), "read_id", "left_anti").withColumn("size", size))
    return decided.unionByName(_best(_placements(rest, reference, max_mismatch, stretch)))
