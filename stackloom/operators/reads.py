"""Operators on raw reads: barcodes, trimming, dereplication, pairing, digestion.

A read table has ``read_id``, ``seq`` and, where qualities are used, ``qual``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.functions.sequence import canonical_strand, portable_draw, reverse_complement

# ------------------------------------------------------------ barcodes


def fixed_barcode(seq: Column, length: int) -> Column:
    """The first ``length`` letters."""
    return F.substring(seq, 1, length)


def variable_barcode(seq: Column, cutters: Sequence[str], longest: int) -> Column:
    """The text before the last cut site within the first ``longest + len(cut) + 1`` letters; the first cutter that occurs wins."""
    found = [F.nullif(F.regexp_extract(F.left(seq, F.lit(longest + len(c) + 1)), f"^(.*){c}", 1), F.lit("")) for c in cutters]
    return F.coalesce(*found)


def header_barcode(name: Column) -> Column:
    """The index in a header: what follows the last colon, up to a plus."""
    return F.regexp_extract(name, r"([^:+]*)(?:\+[^:]*)?$", 1)


def trim_barcode(seq: Column, barcode: Column) -> Column:
    """A sequence (or its qualities) without its leading barcode."""
    return F.substring(seq, F.length(barcode) + 1, F.length(seq))


def barcode_neighbours(barcodes: DataFrame, mismatches: int = 1) -> DataFrame:
    """``observed, sample, distance``: every barcode of ``barcodes(sample, barcode)`` with up to ``mismatches`` letters changed to
    one of C, A, T, G, N. An exact barcode always wins; of others the first by distance, sample and barcode.

    Neighbours are made in the plan; the table grows with the barcodes, not the reads."""
    level = barcodes.select("sample", "barcode", F.upper("barcode").alias("observed"), F.lit(0).alias("distance")).distinct()
    out = level
    for k in range(1, mismatches + 1):
        step = level.select("sample", "barcode", "observed", F.explode(F.sequence(F.lit(1), F.length("observed"))).alias("i")).select("sample", "barcode", "observed", "i", F.explode(F.array(*[F.lit(b) for b in "CATGN"])).alias("b"))
        level = step.where(F.substring("observed", F.col("i"), F.lit(1)) != F.col("b")).select("sample", "barcode", F.concat(F.substring("observed", F.lit(1), F.col("i") - 1), "b", F.substring("observed", F.col("i") + 1, F.length("observed"))).alias("observed"), F.lit(k).alias("distance")).distinct()
        out = out.unionByName(level)
    best = F.min(F.struct("distance", "sample", "barcode")).alias("m")
    return out.groupBy("observed").agg(best).select("observed", "m.sample", "m.distance")


def demultiplex(reads: DataFrame, barcodes: DataFrame, mismatches: int = 1) -> DataFrame:
    """``reads`` (with ``barcode``) and the matched ``match`` and ``distance``; unmatched reads keep nulls."""
    known = barcode_neighbours(barcodes, mismatches).select("observed", F.col("sample").alias("match"), "distance")
    return reads.withColumn("observed", F.upper(F.trim("barcode"))).join(known, "observed", "left")


def demultiplex_counts(matched: DataFrame) -> DataFrame:
    """``fastq, total, with_barcode, matched`` for each file."""
    return matched.groupBy("fastq").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(F.col("observed") != "", F.lit(False))).alias("with_barcode"), F.count("match").alias("matched"))


# ------------------------------------------------------------ trimming


def hard_trim(seq: Column, left: int = 0, right: int = 0) -> Column:
    """A sequence without its first ``left`` and last ``right`` letters."""
    return F.substring(seq, F.lit(left + 1), F.greatest(F.length(seq) - left - right, F.lit(0)))


def trim_ends_n(seq: Column) -> Column:
    """A sequence without terminal Ns."""
    return F.regexp_replace(seq, "^[Nn]+|[Nn]+$", "")


def pass_filters(reads: DataFrame, max_n: int = 5, min_length: int = 35) -> DataFrame:
    """Reads with terminal Ns trimmed that hold at most ``max_n`` Ns and ``min_length`` letters or more."""
    trimmed = reads.withColumn("trimmed_seq", trim_ends_n(F.col("seq")))
    n = F.length("trimmed_seq") - F.length(F.regexp_replace("trimmed_seq", "[Nn]", ""))
    return trimmed.where((n <= max_n) & (F.length("trimmed_seq") >= min_length))


def _matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters, lengths): texts as rows of bytes, zeros behind their ends."""
    raw = [t.encode("latin-1", "replace") for t in texts]
    length = np.array([len(r) for r in raw], dtype=np.int64)
    out = np.zeros((len(raw), int(length.max(initial=0))), dtype=np.uint8)
    out[np.arange(out.shape[1])[None, :] < length[:, None]] = np.frombuffer(b"".join(raw), dtype=np.uint8)
    return out, length


def _end_cut(lack: np.ndarray) -> np.ndarray:
    """For each row how many columns from the left to keep: the running sum of ``lack`` from the right is largest there, stopping
    where it turns negative; all where it is never positive."""
    n, width = lack.shape
    if not width:
        return np.zeros(n, dtype=np.int64)
    total = np.cumsum(lack[:, ::-1], axis=1)
    total[np.logical_or.accumulate(total < 0, axis=1)] = -1
    at = total.argmax(axis=1)
    return np.where(total[np.arange(n), at] > 0, width - 1 - at, width)


def quality_cuts(letters: np.ndarray, length: np.ndarray, cutoff: int, offset: int = 33, both_ends: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The part of each read to keep by partial sums of ``cutoff - quality``: where
    the running sum from an end is largest, stopping where it turns negative."""
    column = np.arange(letters.shape[1])[None, :]
    lack = np.where(column < length[:, None], cutoff + offset - letters.astype(np.int64), 0)
    stop = np.minimum(_end_cut(lack), length)
    start = np.zeros(len(length), dtype=np.int64)
    if both_ends:
        kept = _end_cut(lack[:, ::-1])
        start = np.where(kept < lack.shape[1], lack.shape[1] - kept, 0)
    empty = start >= stop
    return np.where(empty, 0, start), np.where(empty, 0, stop)


def adapter_starts(letters: np.ndarray, length: np.ndarray, adapter: str, error: float = 0.1, overlap: int = 3) -> np.ndarray:
    """Where a 3' adapter begins in each read (its length if nowhere): its first whole occurrence, else the best match
    of a prefix of the adapter that ends inside, or at the end of, the read, with at most ``error`` mismatches a letter."""
    pattern = np.frombuffer(adapter.encode("latin-1"), dtype=np.uint8)
    n, width = letters.shape
    best, at, exact = np.zeros(n, dtype=np.int64), length.copy(), np.full(n, -1, dtype=np.int64)
    for i in range(width - overlap + 1):
        size = np.minimum(len(pattern), length - i)
        rows = np.flatnonzero(size >= overlap)
        if not len(rows):
            break
        window = letters[rows, i : i + len(pattern)]
        column = np.arange(window.shape[1])[None, :]
        wrong = ((window != pattern[None, : window.shape[1]]) & (column < size[rows, None])).sum(axis=1)
        worth = size[rows] - 2 * wrong
        better = (wrong <= (error * size[rows]).astype(np.int64)) & (worth > best[rows])
        best[rows[better]], at[rows[better]] = worth[better], i
        whole = rows[(wrong == 0) & (size[rows] == len(pattern))]
        exact[whole] = np.where(exact[whole] < 0, i, exact[whole])
    return np.where(exact >= 0, exact, at)


def trim_reads(reads: DataFrame, cutoff: int = 20, adapter: str | None = None, offset: int = 33, both_ends: bool = False) -> DataFrame:
    """``read_id, seq, qual, trimmed``: quality trimming, then adapter trimming; ``trimmed`` says what was cut, null for a read
    without a sequence or with qualities of another length, which stays as it is.

    Partial sums with an early stop and error-tolerant matching have no column expression, so reads go through Arrow in blocks,
    all reads of a block at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, qual = batch.column(1), batch.column(2)
            good = pc.fill_null(pc.equal(pc.utf8_length(seq), pc.utf8_length(qual)), False)
            rows = np.flatnonzero(good.to_numpy(zero_copy_only=False))
            texts, quals = seq.take(pa.array(rows)).to_pylist(), qual.take(pa.array(rows)).to_pylist()
            q, length = _matrix(quals)
            start, stop = quality_cuts(q, length, cutoff, offset, both_ends)
            mark = np.where(stop - start < length, "trim_q", "none").astype(object)
            if adapter:
                letters, kept = _matrix([t[x:y] for t, x, y in zip(texts, start, stop)])
                at = adapter_starts(letters, kept, adapter)
                mark[at < kept] = "trim_adapter"
                stop = start + at
            mask = pa.array(good.to_numpy(zero_copy_only=False))
            seqs, cut_quals = ([t[x:y] for t, x, y in zip(some, start, stop)] for some in (texts, quals))
            out = [pc.replace_with_mask(column, mask, pa.array(made, pa.string())) for column, made in ((seq, seqs), (qual, cut_quals), (pa.nulls(batch.num_rows, pa.string()), mark.tolist()))]
            yield pa.record_batch([batch.column(0), *out], names=["read_id", "seq", "qual", "trimmed"])

    return reads.select(F.col("read_id").cast("bigint").alias("read_id"), F.col("seq").cast("string").alias("seq"), F.col("qual").cast("string").alias("qual")).mapInArrow(run, "read_id bigint, seq string, qual string, trimmed string")


def adapter_of(cut: str, barcode: str = "", tail: str = "AGATCGGAAGAGC") -> str:
    """The 3' adapter of a library: reverse complement of the second cut site and barcode, then the common tail."""
    flip = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    return flip(cut) + flip(barcode) + tail


def cap_per_sample(reads: DataFrame, most: int) -> DataFrame:
    """The first ``most`` reads of each sample by id: a feature of the reference's settings, off by default.

    Each range of ids keeps its own first ones before they are ranked together, so a hot sample is ranked in parts."""
    first = Window.partitionBy("sample", F.spark_partition_id()).orderBy("read_id")
    some = reads.withColumn("k", F.row_number().over(first)).where(F.col("k") <= most)
    return some.withColumn("k", F.row_number().over(Window.partitionBy("sample").orderBy("read_id"))).where(F.col("k") <= most).drop("k")


# ------------------------------------------------------------ dereplication and pairs


def dereplicate(reads: DataFrame, both_strands: bool = False) -> DataFrame:
    """``sample, seq, size, md5``: unique sequences of each sample with their abundance; with ``both_strands`` a sequence and its reverse complement count as one."""
    letters = F.upper("seq")
    key = canonical_strand(letters) if both_strands else letters
    return reads.where(F.length("seq") > 0).select("sample", key.alias("seq")).groupBy("sample", "seq").agg(F.count(F.lit(1)).alias("size")).withColumn("md5", F.md5("seq"))


def declone(tagged: DataFrame) -> DataFrame:
    """``cluster_id, tag, seq, size``: reads with one tag in a cluster are copies of one molecule; the most abundant stands for all, with their summed size."""
    return tagged.groupBy("cluster_id", "tag").agg(F.max_by("seq", F.struct("size", "seq")).alias("seq"), F.sum("size").alias("size"))


def join_mates(first: DataFrame, second: DataFrame) -> DataFrame:
    """``pair, seq``: the mates of each pair by their number, the second reversed and complemented, joined by ``nnnn``."""
    a = first.select("pair", F.col("seq").alias("a"))
    b = second.select("pair", F.col("seq").alias("b"))
    return a.join(b, "pair").select("pair", F.concat(F.col("a"), F.lit("nnnn"), reverse_complement(F.col("b"))).alias("seq"))


def merge_overlapping(pairs: DataFrame, least: int = 20, most_differences: int = 4, min_length: int = 32) -> DataFrame:
    """``pair, merged, seq``: mates ``a`` and ``b`` (``b`` already on the strand of ``a``) made one where they overlap by ``least`` letters
    with at most ``most_differences``; also where one extends beyond the start of the other. Others are joined by ``nnnn``."""

    def overlaps(firsts: list[str], seconds: list[str]) -> list[str | None]:
        """The merged sequence of each pair, by the offset with the best overlap (the first of equals)."""
        a, la = _matrix(firsts)
        b, lb = _matrix(seconds)
        n, wa, wb = len(la), a.shape[1], b.shape[1]
        best, start = np.full(n, -(1 << 30)), np.zeros(n, dtype=np.int64)
        column = np.arange(wa)[None, :]
        for s in range(-(wb - least), wa - least + 1):
            lo, hi = max(0, s), np.minimum(la, s + lb)
            size = hi - lo
            rows = np.flatnonzero((size >= least) & (s >= least - lb) & (s <= la - least))
            if not len(rows):
                continue
            end = min(wa, s + wb)
            differ = a[rows, lo:end] != b[rows, lo - s : end - s]
            wrong = (differ & (column[:, lo:end] < hi[rows, None])).sum(axis=1)
            worth = size[rows] - 4 * wrong
            better = (wrong <= most_differences) & (worth > best[rows])
            best[rows[better]], start[rows[better]] = worth[better], s
        out: list[str | None] = []
        for x, y, s, w in zip(firsts, seconds, start.tolist(), best.tolist()):
            if w == -(1 << 30):
                out.append(None)
                continue
            lo, hi = max(0, s), min(len(x), s + len(y))
            p, q = x[lo:hi], y[lo - s : hi - s]
            middle = p if p == q else "".join(c if c == e else (e if c == "N" else c if e == "N" else "N") for c, e in zip(p, q))
            out.append(x[:lo] + middle + (y[hi - s :] if s + len(y) > len(x) else ""))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, seconds = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            both = [k for k, (a, b) in enumerate(zip(firsts, seconds)) if a and b]
            merged = dict(zip(both, overlaps([firsts[k] for k in both], [seconds[k] for k in both]))) if both else {}
            flags, seqs = [], []
            for k, (a, b) in enumerate(zip(firsts, seconds)):
                one = merged.get(k)
                good = one is not None and len(one) >= min_length
                flags.append(good)
                seqs.append(one if good else None if a is None or b is None else f"{a}nnnn{b}")
            yield pa.record_batch([batch.column(0), pa.array(flags, pa.bool_()), pa.array(seqs, pa.string())], names=["pair", "merged", "seq"])

    return pairs.select(F.col("pair").cast("bigint").alias("pair"), "a", "b").mapInArrow(run, "pair bigint, merged boolean, seq string")


def digest(sequences: DataFrame, first: str, second: str | None = None, min_size: int = 0, max_size: int = 1 << 30) -> DataFrame:
    """``rec_id, fragment, seq``: the pieces of each sequence between cut sites, without the two ends, of more than ``min_size`` and at most ``max_size``
    letters. With a second cutter the piece up to its first site is kept."""
    parts = F.split("seq", first)
    inner = F.when(F.size(parts) > 2, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))))
    rows = sequences.select("rec_id", F.posexplode(inner).alias("fragment", "piece"))
    piece = F.split_part(F.col("piece"), F.lit(second), F.lit(1)) if second else F.col("piece")
    kept = rows.where(F.contains("piece", F.lit(second))) if second else rows
    return kept.select("rec_id", "fragment", piece.alias("seq")).where((F.length("seq") > min_size) & (F.length("seq") <= max_size))


def length_shuffle(reads: DataFrame, seed: int = 42) -> DataFrame:
    """Reads with the sort key of clustering: longest first, and a seeded order within a length."""
    return reads.withColumn("order_key", F.struct((-F.length("seq")).alias("length"), portable_draw(F.col("read_id"), seed).alias("draw")))


def collapse_ambiguity(seq: Column) -> Column:
    """Ambiguity codes replaced by one base each before clustering across samples."""
    return F.translate(seq, "WRMKSY", "AAATCC")
