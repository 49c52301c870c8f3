"""Writers of the output formats.

Each format is a function from long tables to the rows of its text (a
DataFrame), and ``write_text`` puts those rows into files. Rows are built and
ordered in Spark; wide rows (a sample's whole sequence) exist only here.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackloom.functions.sequence import allele_of, split_alleles

#: numbers of the bases in structure files (fixed values)
STRUCTURE_CODES = {"A": 0, "T": 1, "G": 2, "C": 3}


def write_text(rows: DataFrame, path: str, order: Sequence[str] = (), partition: Sequence[str] = (), gzip: bool = False) -> None:
    """The column ``line`` as text files, range-partitioned and sorted by ``order``; a folder of parts for each value of ``partition``."""
    out = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    writer = out.select(*partition, "line").write.mode("overwrite")
    writer = writer.option("compression", "gzip") if gzip else writer
    (writer.partitionBy(*partition) if partition else writer).text(path)


def fastq_rows(reads: DataFrame) -> DataFrame:
    """``sample, line``: the four lines of each read; a read without a sequence is none."""
    return reads.where("seq is not null and qual is not null").select("sample", F.format_string("@%s\n%s\n+\n%s", "name", "seq", "qual").alias("line"))


def loci_rows(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``locus, line``: one text block for each locus: padded names and sequences, then the marks of its sites and its number.

    ``rows(locus, sample, seq)``, ``marks(locus, marks)``."""
    width = F.max(F.length("sample")).over(Window.partitionBy("locus")) + 5
    lines = rows.where("sample <> 'reference'").withColumn("text", F.concat(F.rpad("sample", width, " "), F.upper("seq"))).withColumn("width", width)
    block = lines.groupBy("locus").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("body"), F.max("width").alias("width"))  # the samples of a study
    return block.join(marks, "locus").select("locus", F.concat("body", F.lit("\n"), F.rpad(F.lit("//"), F.col("width"), " "), "marks", F.lit("|"), F.col("locus").cast("string"), F.lit("|")).alias("line"))


def allele_rows(rows: DataFrame) -> DataFrame:
    """``locus, sample, seq``: both haplotypes of each sample under ``name_0`` and ``name_1``."""
    first, second = split_alleles(F.col("seq"))
    return rows.select("locus", F.explode(F.array(F.struct(F.concat("sample", F.lit("_0")).alias("sample"), first.alias("seq")), F.struct(F.concat("sample", F.lit("_1")).alias("sample"), second.alias("seq")))).alias("r")).select("locus", "r.*")


def phylip_rows(concatenated: DataFrame, plain: bool = False) -> DataFrame:
    """``k, line``: the header and one row for each sample of ``sample, seq``; names are padded to one width, or with ``plain`` parted by one blank."""
    head = concatenated.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.length("seq")), F.lit(0)).alias("m"), F.coalesce(F.max(F.length("sample")), F.lit(0)).alias("w"))
    body = concatenated.join(F.broadcast(head)).select(F.col("sample").alias("k"), F.concat(F.concat("sample", F.lit(" ")) if plain else F.rpad("sample", F.col("w") + 4, " "), "seq").alias("line"))  # one row
    return head.select(F.lit("").alias("k"), F.format_string("%d %d", "n", "m").alias("line")).unionByName(body)


def nexus_rows(concatenated: DataFrame, charsets: DataFrame, block: int = 100) -> DataFrame:
    """``k, sample, line``: interleaved blocks of ``block`` columns, then a set of columns for each locus (from 1, inclusive). ``charsets(locus, start, end)`` from 0, half-open."""
    n = F.ceil(F.length("seq") / block).cast("int")
    head = concatenated.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("seq")).alias("m"))
    top = head.select(F.lit(-1).alias("k"), F.lit("").alias("sample"), F.format_string("#nexus\nbegin data;\n  dimensions ntax=%d nchar=%d;\n  format datatype=dna missing=N gap=- interleave=yes;\n  matrix", "n", "m").alias("line"))
    body = concatenated.select("sample", "seq", F.explode(F.sequence(F.lit(0), n - 1)).alias("k")).select("k", "sample", F.concat("sample", F.lit("    "), F.substring("seq", F.col("k") * block + 1, F.lit(block))).alias("line"))
    big = 1 << 30
    end = head.select(F.lit(big).alias("k"), F.lit("").alias("sample"), F.lit("  ;\nend;\nbegin sets;").alias("line"))
    sets = charsets.select((F.lit(big) + 1).alias("k"), F.lpad(F.col("locus").cast("string"), 12, "0").alias("sample"), F.format_string("  charset locus_%d = %d-%d;", "locus", F.col("start") + 1, "end").alias("line"))
    last = head.select((F.lit(big) + 2).alias("k"), F.lit("").alias("sample"), F.lit("end;").alias("line"))
    return top.unionByName(body).unionByName(end).unionByName(sets).unionByName(last)


def _per_sample(calls: DataFrame, value: Column, separator: str) -> DataFrame:
    grouped = calls.select("sample", F.struct("snp_id", value.alias("v")).alias("s")).groupBy("sample").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return grouped.select("sample", F.array_join(F.transform("s", lambda x: x["v"].cast("string")), separator).alias("text"))


def snps_rows(calls: DataFrame) -> DataFrame:
    """``sample, line``: the SNP bases of each sample in the order of sites, N where missing."""
    return _per_sample(calls, F.coalesce("base", F.lit("N")), "").select("sample", F.concat(F.rpad("sample", 20, " "), "text").alias("line"))


def snpsmap_rows(sites: DataFrame) -> DataFrame:
    """``snp_id, line``: the linkage map: locus, label, position (from 1) and place of each site."""
    label = F.when(F.col("scaf").isNotNull(), F.format_string("scaf%d:%d", "scaf", "scafpos")).otherwise(F.format_string("loc%d_snp%d_pos%d", "locus", "locidx", "locpos"))
    return sites.select("snp_id", F.concat_ws("\t", F.col("locus").cast("string"), label, (F.col("locpos") + 1).cast("string"), F.col("snp_id").cast("string")).alias("line"))


def structure_rows(calls: DataFrame) -> DataFrame:
    """``sample, k, line``: two rows for each sample, bases by their numbers, -9 where missing."""
    table = F.create_map(*[F.lit(x) for p in STRUCTURE_CODES.items() for x in p])
    out = None
    for k in (0, 1):
        rows = _per_sample(calls, F.coalesce(table[allele_of(F.col("base"), k)], F.lit(-9)), "\t").select("sample", F.lit(k).alias("k"), F.concat(F.rpad("sample", 20, " "), F.lit("\t\t\t\t\t"), "text").alias("line"))
        out = rows if out is None else out.unionByName(rows)
    return out


def geno_rows(calls: DataFrame) -> DataFrame:
    """``snp_id, line``: 2 for two ancestral alleles, 1 for one, 0 for none, 9 missing; samples in the order of their names."""
    value = F.when((F.col("a0") < 2) & (F.col("a1") < 2), 2 - F.col("a0") - F.col("a1")).otherwise(9)
    grouped = calls.groupBy("snp_id").agg(F.array_sort(F.collect_list(F.struct("sample", value.alias("v")))).alias("s"))
    return grouped.select("snp_id", F.array_join(F.transform("s", lambda x: x["v"].cast("string")), "").alias("line"))


def treemix_rows(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """``snp_id, line``: the ancestral and derived counts of each population, of the sites all populations cover. ``counts(snp_id, pop, anc, der)``."""
    wide = counts.groupBy("snp_id").pivot("pop", list(names)).agg(F.first(F.concat_ws(",", "anc", "der"))).dropna()
    return wide.select("snp_id", F.concat_ws(" ", *names).alias("line"))


def vcf_rows(calls: DataFrame, sites: DataFrame, names: Sequence[str]) -> DataFrame:
    """``chrom, pos, line``: the data rows of a VCF file with GT:DP for each of ``names``. Sites without a scaffold are on their locus, positions from 1."""
    cell = F.when(F.col("a0").isNull(), F.lit("./.:0")).otherwise(F.concat(F.col("a0").cast("string"), F.lit("/"), F.col("a1").cast("string"), F.lit(":"), F.coalesce("depth", F.lit(0)).cast("string")))
    grouped = calls.groupBy("snp_id").agg(F.map_from_entries(F.collect_list(F.struct("sample", cell.alias("c")))).alias("m"), F.count("a0").alias("ns"), F.coalesce(F.sum("depth"), F.lit(0)).alias("dp"))
    both = grouped.join(sites, "snp_id")
    chrom = F.when(F.col("scaf").isNotNull(), F.format_string("scaf_%d", "scaf")).otherwise(F.format_string("RAD_%d", F.col("locus") - 1))
    pos = F.coalesce("scafpos", F.col("locpos") + 1)
    cells = F.array_join(F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.coalesce(F.col("m")[n], F.lit("./.:0"))), "\t")
    alt = F.array_join(F.slice("alleles", F.lit(2), F.greatest(F.size("alleles") - 1, F.lit(0))), ",")
    return both.select(chrom.alias("chrom"), pos.alias("pos"), F.concat_ws("\t", chrom, pos.cast("string"), F.format_string("loc%d_pos%d", F.col("locus") - 1, "locpos"), F.get("alleles", F.lit(0)), alt, F.lit("13"), F.lit("PASS"), F.format_string("NS=%d;DP=%d", "ns", "dp"), F.lit("GT:DP"), cells).alias("line"))


def vcf_header(names: Sequence[str], source: str = "stackloom") -> str:
    """The header of a VCF file."""
    return "\n".join(["##fileformat=VCFv4.0", f"##source={source}", '##INFO=<ID=NS,Number=1,Type=Integer,Description="Number of Samples With Data">', '##INFO=<ID=DP,Number=1,Type=Integer,Description="Total Depth">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Read Depth">', "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])])


def gphocs_rows(rows: DataFrame) -> DataFrame:
    """``locus, line``: ``locusN nsamples length`` and the sequences of each locus."""
    block = rows.groupBy("locus").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("seq")).alias("m"), F.array_join(F.array_sort(F.collect_list(F.concat("sample", F.lit("\t"), "seq"))), "\n").alias("body"))
    return block.select("locus", F.format_string("locus%d %d %d\n%s\n", "locus", "n", "m", "body").alias("line"))


def migrate_rows(rows: DataFrame, pops: DataFrame) -> DataFrame:
    """``pop, locus, line``: the sequences of each population by locus, names padded to 10 letters."""
    return rows.join(pops, "sample").select("pop", "locus", F.concat(F.rpad("sample", 10, " "), "seq").alias("line"))


def fasta_rows(records: DataFrame) -> DataFrame:
    """``name, line``: FASTA records; a record without a name or sequence is none."""
    return records.where("name is not null and seq is not null").select("name", F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("line"))


def sam_rows(records: DataFrame) -> DataFrame:
    """``chrom, pos, line``: consensus reads as SAM text from ``name, chrom, pos, cigar, seq``; positions from 0."""
    return records.select("chrom", "pos", F.concat_ws("\t", "name", F.lit("0"), "chrom", (F.col("pos") + 1).cast("string"), F.lit("30"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), F.replace("seq", F.lit("-"), F.lit("")), F.lit("*")).alias("line"))


def bpp_rows(rows: DataFrame) -> DataFrame:
    """``locus, line``: sequence blocks with names marked by ``^``."""
    block = rows.groupBy("locus").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("seq")).alias("m"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("^"), F.rpad("sample", 20, " "), "seq"))), "\n").alias("body"))
    return block.select("locus", F.format_string("%d %d\n%s\n", "n", "m", "body").alias("line"))


def map_rows(pops: DataFrame) -> DataFrame:
    """``sample, line``: which population a sample is of."""
    return pops.select("sample", F.concat_ws("\t", "sample", "pop").alias("line"))


def digested_rows(fragments: DataFrame, copies: int = 10) -> DataFrame:
    """``rec_id, line``: each fragment as ``copies`` FASTQ records of best quality."""
    rows = fragments.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return rows.select("rec_id", F.format_string("@%d_%d_%d\n%s\n+\n%s", "rec_id", "fragment", "c", "seq", F.repeat(F.lit("I"), F.length("seq"))).alias("line"))


def locus_phylip_rows(rows: DataFrame) -> DataFrame:
    """``locus, name, line``: each locus of ``rows(locus, sample, seq)`` as a phylip block of its own: its header (without a name) and a row for each sample."""
    head = rows.groupBy("locus").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("seq")).alias("m")).select("locus", F.lit("").alias("name"), F.format_string("%d %d", "n", "m").alias("line"))
    return head.unionByName(rows.select("locus", F.col("sample").alias("name"), F.concat_ws(" ", "sample", "seq").alias("line")))


def cluster_rows(rows: DataFrame) -> DataFrame:
    """``cluster_id, line``: each cluster of ``rows(cluster_id, hit_rank, name, size, orient, seq)`` as a block of names and sequences that two lines of ``//`` end.

    A block holds the reads of one cluster."""
    row = F.concat(F.lit(">"), "name", F.lit(";size="), F.col("size").cast("string"), F.lit(";"), "orient", F.lit("\n"), "seq")
    block = rows.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("hit_rank", row.alias("t")))).alias("s"))
    return block.select("cluster_id", F.concat(F.array_join(F.transform("s", lambda x: x["t"]), "\n"), F.lit("\n//\n//")).alias("line"))


def stats_rows(stats: DataFrame, columns: Sequence[tuple[str, int]]) -> DataFrame:
    """``k, line``: a table of statistics as text: a line of names, then one for each row, the first column to the left of its width and
    the others to the right of theirs. ``columns`` has names and widths; ``k`` is the first column, for order."""
    text = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n, _ in columns]
    cells = [F.rpad(t, w, " ") if not k else F.lpad(t, w, " ") for k, (t, (_, w)) in enumerate(zip(text, columns))]
    head = "".join(n.ljust(w) if not k else n.rjust(w) for k, (n, w) in enumerate(columns))
    first = stats.sparkSession.createDataFrame([("", head)], "k string, line string")
    return first.unionByName(stats.select(text[0].alias("k"), F.concat(*cells).alias("line")))


def write_database(rows: DataFrame, path: str, key: str, part: int) -> None:
    """Rows as Parquet in folders of ``part`` values of the integer ``key``, sorted by it, so that a slice reads only its folders and row groups."""
    ranged = rows.withColumn("range", F.floor(F.col(key) / part))
    ranged.repartitionByRange("range", key).sortWithinPartitions("range", key).write.mode("overwrite").partitionBy("range").parquet(path)


def read_slice(spark: SparkSession, path: str, key: str, first: int, last: int, part: int) -> DataFrame:
    """The rows of a database whose ``key`` lies in ``first`` to ``last``; both conditions reach the scan."""
    return spark.read.parquet(path).where(F.col("range").between(first // part, last // part) & F.col(key).between(first, last)).drop("range")


def marked(o):
    """A project's settings with its tuples marked, for JSON."""
    if isinstance(o, tuple):
        return {"__tuple__": True, "items": [marked(x) for x in o]}
    if isinstance(o, dict):
        return {k: marked(v) for k, v in o.items()}
    return [marked(x) for x in o] if isinstance(o, list) else o


def save_project(project: dict, path: str) -> None:
    """A project manifest as JSON; tuples are marked."""
    Path(path).write_text(json.dumps(marked(project), indent=1))


def params_text(values: dict[str, object]) -> str:
    """A settings file: the value, then its number and name."""
    lines = [f"------- params file {'-' * 60}"]
    for k, (name, v) in enumerate(values.items()):
        text = ", ".join(map(str, v)) if isinstance(v, (tuple, list)) else "" if v is None else str(v)
        lines.append(f"{text:<30} ## [{k}] [{name}]")
    return "\n".join(lines) + "\n"
