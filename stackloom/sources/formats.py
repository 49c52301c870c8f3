"""Readers of the text formats, as lazy DataFrames over splittable text wherever the format allows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stackloom.operators.rejects import fastq_failure

#: endings stripped from file names to get sample names (fixed values)
_ENDINGS = (".fastq.gz", ".fq.gz", ".fastq", ".fq", ".gz")


#: what ``scan_fastq`` gives for each record or rejected piece of text
_SCANNED = pa.schema([("file", pa.string()), ("block", pa.int64()), ("k", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("seq", pa.string()), ("qual", pa.string()), ("reason", pa.string()), ("text", pa.string())])
_SCANNED_DDL = "file string, block bigint, k bigint, kind string, name string, seq string, qual string, reason string, text string"


def scan_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, block, k, name, seq, qual, reason, text`` from FASTQ files, plain or gzipped: valid records with a null
    ``reason`` and ``text``, all else with a reason and the text. ``block`` and ``k`` order a file's rows.

    The text is cut at line ends before ``@``, so plain files are split and read in parallel without counting lines,
    and every piece is judged by itself: a bad record never costs its neighbours. A piece of four lines or more is a
    record of its first four; lines beyond them are rejected. A quality line that starts with ``@`` leaves a piece of
    three lines and one that is no record itself, which are put together again, also across the border of two splits (at
    most two rows for each split are gathered by file)."""
    names = [paths] if isinstance(paths, str) else paths
    pieces = spark.read.option("lineSep", "\n@").text(names).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    scanned = pieces.mapInArrow(_scan_pieces, _SCANNED_DDL)
    whole = scanned.where("kind = 'whole'")

    def stitch(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("block", "kind", "k", "text"))), key=lambda r: (r[0], r[1] != "start"))
        texts, places, tail = [], [], None
        for block, kind, k, text in rows:
            if kind == "start":
                if text is not None and tail is not None and _goes_on(pa.array([tail[2]]), pa.array([text]))[0]:
                    tail = (*tail[:2], f"{tail[2]}\n@{text}")
                elif text is not None:
                    places.append((block, k))
                    texts.append(text)
                if tail is not None:
                    places.append(tail[:2])
                    texts.append(tail[2])
                tail = None
            else:
                tail = (block, k, text)
        if tail is not None:
            places.append(tail[:2])
            texts.append(tail[2])
        file = group.column("file")[0].as_py()
        made = _judge(pa.array(texts, pa.string()), np.zeros(len(texts), dtype=bool))
        return pa.Table.from_batches([_scanned(file, [places[i][0] for i in made[0]], [places[i][1] for i in made[0]], *made[1:])])

    borders = scanned.where("kind <> 'whole'").groupBy("file").applyInArrow(stitch, _SCANNED_DDL)
    return whole.unionByName(borders).drop("kind")


def _scanned(file: str, block: list, k: list, name: pa.Array, seq: pa.Array, qual: pa.Array, reason: pa.Array, text: pa.Array, kind: str = "whole") -> pa.RecordBatch:
    n = len(name)
    return pa.record_batch([pa.array([file] * n, pa.string()), pa.array(block, pa.int64()), pa.array(k, pa.int64()), pa.array([kind] * n, pa.string()), name, seq, qual, reason, text], schema=_SCANNED)


def _judge(texts: pa.Array, first: np.ndarray) -> tuple:
    """(row numbers, names, sequences, qualities, reasons, texts) of pieces of text, each without its leading ``@`` (save
    those marked ``first``, the first of a file). Lines past the fourth come out as a row of their own."""
    bare = pc.utf8_rtrim(pc.replace_substring(texts, "\r\n", "\n"), "\r\n")
    lines = pc.split_pattern(bare, "\n")
    size = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    flat = lines.flatten()
    line = lambda j: flat.take(pa.array(np.where(size > j, start + j, 0), mask=size <= j))
    name, seq, plus, qual = (line(j) for j in range(4))
    marked = pc.or_(pa.array(~first), pc.starts_with(name, "@"))
    name = pc.if_else(pa.array(first), pc.utf8_ltrim(name, "@"), name) if first.any() else name
    reason = fastq_failure(name, seq, plus, qual, marked)
    # fewer than four lines are told apart first
    short = pc.binary_join_element_wise(pa.array(size.astype(str)), pa.scalar("lines instead of 4"), " ")
    reason = pc.if_else(pa.array(size < 4), short, reason)
    good = pc.is_null(reason)
    keep = lambda column: pc.if_else(good, column, pa.scalar(None, pa.string()))
    out = [pa.array(np.arange(len(texts))), keep(name), keep(seq), keep(qual), reason, pc.if_else(good, pa.scalar(None, pa.string()), bare)]
    over = np.flatnonzero((size > 4) & good.to_numpy(zero_copy_only=False))
    if len(over):
        rest = [t.split("\n", 4)[4] for t in bare.take(pa.array(over)).to_pylist()]
        none = pa.nulls(len(over), pa.string())
        more = [pa.array(over), none, none, none, pa.array(["lines outside a record"] * len(over)), pa.array(rest, pa.string())]
        out = [pa.concat_arrays([a.cast(b.type), b]) for a, b in zip(out, more)]
    return out[0].to_numpy(zero_copy_only=False), *out[1:]


_RECORD = r"\A[^\n]+\n[ACGTNacgtn]+\n\+[^\n]*\n[!-J]+(\n|\z)"


def _goes_on(before: pa.Array, after: pa.Array) -> np.ndarray:
    """Whether each piece ``after`` begins with the quality line of the three-line piece ``before`` it: it is a line of its own, or
    no record and its first line is as long as the sequence."""
    size = lambda text, k: pc.utf8_length(pc.list_element(pc.split_pattern(text, "\n", max_splits=3), k)).to_numpy()
    plain = lambda text: pc.utf8_rtrim(pc.replace_substring(text, "\r\n", "\n"), "\r\n")
    before, after = plain(before), plain(after)
    alone = pc.invert(pc.match_substring(after, "\n")).to_numpy(zero_copy_only=False)
    fits = (size(after, 0) + 1 == size(before, 1)) & ~pc.match_substring_regex(after, _RECORD).to_numpy(zero_copy_only=False)
    return alone | fits


def _scan_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and rejects of whole pieces; the first piece of a split (kind ``start``, with its text only if it may be a
    rest of the split before) and a last one that may go on in the next split (kind ``tail``)."""
    at, held, k = None, None, 0  # a held piece has three lines and waits for a quality line

    def last() -> Iterator[pa.RecordBatch]:
        if held is not None:
            none = pa.nulls(1, pa.string())
            yield _scanned(at[0], [at[1]], [k], none, none, none, none, pa.array([held], pa.string()), "tail")

    for batch in batches:
        files, blocks = batch.column(0), batch.column(1).to_numpy()
        code = files.dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(blocks) != 0)) + 1
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
            if low == high:
                continue
            where, texts, fresh = (files[int(low)].as_py(), int(blocks[low])), batch.column(2).slice(low, high - low).cast(pa.string()), False
            if where != at:
                yield from last()
                at, held, k, fresh = where, None, 0, True
            if held is not None:
                texts, held = pa.concat_arrays([pa.array([held], pa.string()), texts]), None
            n_lines = pc.add(pc.count_substring(pc.utf8_rtrim(texts, "\r\n"), "\n"), 1).to_numpy()
            none = pa.nulls(1, pa.string())
            if fresh and where[1] > 0:
                alone = not pc.match_substring_regex(pc.replace_substring(texts.slice(0, 1), "\r\n", "\n"), _RECORD)[0].as_py() and n_lines[0] != 3
                yield _scanned(at[0], [at[1]], [k], none, none, none, none, pa.array([texts[0].as_py() if alone else None], pa.string()), "start")
                if alone:
                    texts, n_lines, k = texts.slice(1), n_lines[1:], k + 1
            if not len(texts):
                continue
            if n_lines[-1] == 3 and not (len(texts) > 1 and n_lines[-2] == 3 and _goes_on(texts.slice(len(texts) - 2, 1), texts.slice(len(texts) - 1))[0]):
                held = texts[len(texts) - 1].as_py()
                texts, n_lines = texts.slice(0, len(texts) - 1), n_lines[:-1]
                if not len(texts):
                    continue
            ends = np.flatnonzero(n_lines[:-1] == 3) + 1
            if len(ends):
                ends = ends[_goes_on(texts.take(pa.array(ends - 1)), texts.take(pa.array(ends)))]
                ends = np.array([e for k, e in enumerate(ends) if not k or ends[k - 1] != e - 1], dtype=np.int64)
            if len(ends):
                joined = pc.binary_join_element_wise(texts.take(pa.array(ends - 1)), texts.take(pa.array(ends)), "\n@")
                every = pa.concat_arrays([texts, joined])
                order = np.arange(len(texts))
                order[ends - 1] = len(texts) + np.arange(len(ends))
                texts = every.take(pa.array(np.delete(order, ends)))
            first = np.zeros(len(texts), dtype=bool)
            first[0] = fresh and where[1] == 0
            row, *made = _judge(texts, first)
            yield _scanned(at[0], [at[1]] * len(row), k + row, *made)
            k += len(texts)
    yield from last()


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, name, seq, qual`` of the valid records of FASTQ files; ``scan_fastq`` gives the others with their reasons."""
    return scan_fastq(spark, paths).where("reason is null").select("file", "name", "seq", "qual")


def numbered_records(scanned: DataFrame) -> DataFrame:
    """``file, ordinal, name, seq, qual, reason`` of ``scan_fastq``: records of each file numbered from 0 in order. Bad records
    have a number, so that those after them keep theirs; damaged text takes as many as a quarter of its lines, rounded. (Where
    damage lies side by side that can be off by one: match such files by name.)

    Rows are numbered inside their block and offset by the blocks before (a row for each split)."""
    outside = F.col("reason") == "lines outside a record"
    lines = F.round(F.size(F.split("text", "\n")) / 4).cast("bigint")
    rows = scanned.withColumn("n", F.when(outside, lines).when(F.col("text").isNotNull(), F.greatest(lines, F.lit(1))).otherwise(1))
    inner = rows.withColumn("upto", F.sum("n").over(Window.partitionBy("file", "block").orderBy("k", F.coalesce(outside, F.lit(False)))))
    sizes = rows.groupBy("file", "block").agg(F.sum("n").alias("total"))
    before = sizes.select("file", "block", F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return inner.where("n > 0").join(before, ["file", "block"]).select("file", (F.col("before") + F.col("upto") - F.col("n")).alias("ordinal"), "name", "seq", "qual", "reason")


def read_fastq_pairs(spark: SparkSession, first: str | list[str], second: str | list[str], key: str | None = None, by_name: bool = False) -> DataFrame:
    """``pair_file, ordinal, name, seq, qual, seq2, qual2``: the mates of two sets of files by their place in the file, or with
    ``by_name`` by their name up to a blank or ``/1``. A pair of which either record is bad is left out; the others keep their partners.

    Files belong together by the text that ``key`` (a regular expression with one group) finds in their path; by default by their
    name with ``_R1_`` and ``_R2_`` (or ``_1.``, ``_2.``) taken out."""
    own = F.regexp_extract("file", key, 1) if key else F.regexp_replace(F.regexp_extract("file", r"([^/]+)$", 1), r"_R?[12](?=[_.])", "")
    bare = F.regexp_replace("name", r"(/[12])?([ \t].*)?$", "")
    a = numbered_records(scan_fastq(spark, first)).where("reason is null").select(own.alias("pair_file"), "ordinal", bare.alias("mate"), "name", "seq", "qual")
    b = numbered_records(scan_fastq(spark, second)).where("reason is null").select(own.alias("pair_file"), "ordinal", bare.alias("mate"), F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    drop, on = ("ordinal", "mate") if by_name else ("mate", "ordinal")
    return a.join(b.drop(drop), ["pair_file", on]).select("pair_file", "ordinal", "name", "seq", "qual", "seq2", "qual2")


def record_counts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, records``: the lines of each file divided by four, as ``read_fastq`` need not be run for it."""
    lines = spark.read.text([paths] if isinstance(paths, str) else paths).select(F.col("_metadata.file_path").alias("file"))
    return lines.groupBy("file").agg(F.floor(F.count(F.lit(1)) / 4).alias("records"))


def estimate_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, estimate``: how many records each file holds, judged by its first block: its lines over four, times the file's
    size over the block's. Exact for files of one block and for gzipped ones."""
    lines = spark.read.text([paths] if isinstance(paths, str) else paths).where("_metadata.file_block_start = 0")
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_length").alias("block"))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.max("block").alias("block")).select("file", F.floor(F.col("n") / 4 * F.col("size") / F.greatest("block", F.lit(1))).alias("estimate"))


def name_from_path(path: Column, separator: str = "_", fields: list[int] | None = None) -> Column:
    """A sample's name from a file's path: without its folder and endings, and of its parts at ``separator`` those numbered in ``fields`` (all by default)."""
    ends = "|".join(re.escape(e) for e in _ENDINGS)
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), f"({ends})$", "")
    if fields is None:
        return name
    parts = F.split(name, re.escape(separator))
    return F.array_join(F.array(*[F.get(parts, F.lit(k)) for k in fields]), separator)


def sample_names(paths: list[str], paired: bool = False) -> dict[str, tuple[str, ...]]:
    """Sample names of file names: endings and the text all names end in are cut; paired files that differ only by 1 and 2 go together."""
    bare = {}
    for p in sorted(paths):
        name = Path(p).name
        for e in _ENDINGS:
            name = name[: -len(e)] if name.endswith(e) else name
        bare[p] = name
    if not paired:
        return {re.sub(r"_R1_?$", "", n): (p,) for p, n in bare.items()}
    out: dict[str, tuple[str, ...]] = {}
    for p, n in bare.items():
        for m in re.finditer("1", n):
            other = n[: m.start()] + "2" + n[m.end() :]
            mate = [q for q, k in bare.items() if k == other]
            if mate:
                out[re.sub(r"[_.]?R?$", "", n[: m.start()])] = (p, mate[0])
                break
    return out


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``name, seq, length`` from a FASTA file; records are cut at ``>``, so a record is whole in its task."""
    rows = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    name = F.regexp_extract("value", r"^(\S+)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return rows.select(name.alias("name"), seq.alias("seq"), F.length(seq).alias("length"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """``scaffold, length, offset`` of a FASTA index."""
    return spark.read.option("sep", "\t").schema("scaffold string, length bigint, offset bigint, linebases int, linewidth int").csv(path).select("scaffold", "length", "offset")


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """``sample, barcode`` from a barcodes file; two barcodes are joined by ``+``; repeated samples get a replicate suffix downstream."""
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(parts.alias("p"))
    return rows.select(F.get("p", F.lit(0)).alias("sample"), F.upper(F.array_join(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), "+")).alias("barcode"))


def read_populations(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int]]:
    """(``sample, pop``, minimum samples of each population) from a population file with a ``# pop:min`` line."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    note = [r["value"] for r in lines.where(F.startswith(F.ltrim("value"), F.lit("#"))).collect()]  # the comment lines of a small file
    least = {k: int(v) for line in note for k, v in re.findall(r"(\S+?):(\d+)", line.lstrip("# "))}
    parts = F.split(F.trim("value"), r"\s+")
    return lines.where(~F.startswith(F.ltrim("value"), F.lit("#"))).select(parts[0].alias("sample"), parts[1].alias("pop")), least


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """``block, rank, name, size, orient, seq`` from clusters in text form, blocks ended by two lines of ``//``."""
    blocks = spark.read.option("lineSep", "//\n//\n").text(path).where(F.length(F.trim("value")) > 0).withColumn("block", F.monotonically_increasing_id())
    lines = F.filter(F.split(F.trim("value"), "\n"), lambda x: F.length(x) > 0)
    rows = blocks.select("block", F.posexplode(lines).alias("i", "line"), lines.alias("all")).where("i % 2 = 0")
    head = F.col("line")
    return rows.select("block", (F.col("i") / 2).cast("int").alias("rank"), F.split_part(F.regexp_replace(head, "^>", ""), F.lit(";"), F.lit(1)).alias("name"), F.regexp_extract(head, r"size=(\d+)", 1).try_cast("bigint").alias("size"), F.regexp_extract(head, r";([*+-])$", 1).alias("orient"), F.get("all", F.col("i") + 1).alias("seq"))


def read_loci(spark: SparkSession, path: str) -> DataFrame:
    """``locus, sample, seq`` from a ``.loci`` file: rows of each block end in a line with the locus number between bars."""
    blocks = spark.read.option("lineSep", "|\n").text(path).where(F.contains("value", F.lit("//")))
    number = F.regexp_extract("value", r"\|(\d+)\|?\s*$", 1).try_cast("bigint")
    rows = blocks.select(number.alias("locus"), F.explode(F.split("value", "\n")).alias("line")).where(~F.startswith("line", F.lit("//")) & (F.length(F.trim("line")) > 0))
    parts = F.split(F.trim("line"), r"\s+")
    return rows.select("locus", parts[0].alias("sample"), parts[1].alias("seq"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, pos, ref, alts, sample, a0, a1, depth`` in long form; missing alleles are null. Only the header line is read on the driver."""
    lines = spark.read.text(path)
    header = lines.where(F.startswith("value", F.lit("#CHROM"))).first()
    names = header["value"].split("\t")[9:] if header else []
    rows = lines.where(~F.startswith("value", F.lit("#"))).select(F.split("value", "\t").alias("f"))
    samples = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    long = rows.select("f", F.posexplode(F.slice("f", F.lit(10), F.lit(max(1, len(names))))).alias("i", "cell"), samples.alias("names"))
    cell, at = F.split("cell", ":"), F.array_position(F.split(F.get("f", F.lit(8)), ":"), "DP")
    gt = F.split(F.get(cell, F.lit(0)), r"[/|]")
    return long.select(F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).cast("bigint").alias("pos"), F.get("f", F.lit(3)).alias("ref"), F.split(F.get("f", F.lit(4)), ",").alias("alts"), F.get("names", F.col("i")).alias("sample"), F.get(gt, F.lit(0)).try_cast("int").alias("a0"), F.get(gt, F.lit(1)).try_cast("int").alias("a1"), F.when(at > 0, F.get(cell, (at - 1).cast("int"))).try_cast("int").alias("depth"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """``qname, flag, chrom, pos, mapq, cigar, seq`` from SAM text; positions from 0."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("@")) & (F.length("value") > 0))
    return rows.select(f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("chrom"), (f[3].cast("bigint") - 1).alias("pos"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"), f[9].alias("seq"))


def split_alignments(alignments: DataFrame, paired: bool = False, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): mapped well enough, neither secondary nor supplementary, and in proper pairs if paired."""
    good = (F.col("mapq") >= least) & (F.col("flag").bitwiseAND(0x904) == 0)
    good = good & (F.col("flag").bitwiseAND(0x3) == 0x3) if paired else good
    return alignments.where(good), alignments.where(~F.coalesce(good, F.lit(False)))


def read_tree_table(spark: SparkSession, path: str) -> DataFrame:
    """``scaffold, start, end, sites, snps, samples, missing, tree`` of a window table, to resume from."""
    return spark.read.option("header", True).schema("scaffold string, start bigint, end bigint, sites bigint, snps bigint, samples int, missing double, tree string").csv(path)


def parse_params(text: str, names: list[str]) -> dict[str, str]:
    """A settings file: what stands before ``##`` on each line, in the order of ``names``."""
    lines = [line.split("##")[0].strip() for line in text.splitlines()[1:] if line.strip()]
    return dict(zip(names, lines))


def parse_structure_output(spark: SparkSession, path: str) -> DataFrame:
    """``file, k, est_lnlik, mean_lnlik, var_lnlik`` from the text of clustering runs."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    number = lambda label: F.regexp_extract("value", label + r"\s*=\s*(-?[0-9.]+)", 1).try_cast("double")
    return rows.select("file", F.regexp_extract("value", r"(\d+) populations assumed", 1).try_cast("int").alias("k"), number("Estimated Ln Prob of Data").alias("est_lnlik"), number("Mean value of ln likelihood").alias("mean_lnlik"), number("Variance of ln likelihood").alias("var_lnlik"))


def parse_trimming_report(text: str) -> dict[str, int]:
    """Counts of a trimming program's report by their labels."""
    return {k.strip(): int(v.replace(",", "")) for k, v in re.findall(r"^\s*([A-Za-z][\w ()/-]+?):\s+([\d,]+)(?= |$)", text, re.M)}


def restored(o):
    """What ``sinks.marked`` made of settings, as they were."""
    if isinstance(o, dict):
        return tuple(restored(x) for x in o["items"]) if o.get("__tuple__") else {k: restored(v) for k, v in o.items()}
    return [restored(x) for x in o] if isinstance(o, list) else o


def load_project(path: str) -> dict:
    """A project manifest; lists marked as tuples come back as such."""
    return restored(json.loads(Path(path).read_text()))


def parse_treemix_llik(spark: SparkSession, path: str) -> DataFrame:
    """``file, migrations, llik`` from the likelihood files of admixture graphs: the numbers of the last line."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_extract(F.rtrim(F.regexp_replace("value", r"\s+$", "")), r"([^\n]*)$", 1).alias("line"))
    return rows.select("file", F.regexp_extract("line", r"with (\d+) migration", 1).try_cast("int").alias("migrations"), F.regexp_extract("line", r"(\S+)$", 1).try_cast("double").alias("llik"))


def parse_posterior_table(spark: SparkSession, path: str) -> DataFrame:
    """``file, row, values`` from tab-separated tables of posteriors (species trees and Bayesian trees): after lines in brackets comes the
    header; ``values`` maps its names to a row's texts, without the first column, which is ``row``. Tables are small and read whole."""
    lines = F.filter(F.split("value", "\r?\n"), lambda x: (F.length(F.trim(x)) > 0) & ~F.startswith(x, F.lit("[")))
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), lines.alias("l")).where("size(l) > 1")
    head, cell = F.split(F.get("l", F.lit(0)), "\t"), F.split("line", "\t")
    each = rows.select("file", head.alias("head"), F.explode(F.slice("l", F.lit(2), F.size("l") - 1)).alias("line"))
    rest = lambda a: F.slice(a, F.lit(2), F.greatest(F.size(F.col("head")) - 1, F.lit(0)))
    return each.where(F.size(cell) == F.size("head")).select("file", F.get(cell, F.lit(0)).alias("row"), F.map_from_arrays(rest(F.col("head")), rest(cell)).alias("values"))


READ_SCHEMA = StructType([StructField(n, StringType()) for n in ("name", "seq", "qual")])
