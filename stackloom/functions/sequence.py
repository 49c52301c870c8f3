"""Column functions on nucleotide sequences and genotypes, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ambiguity codes and the two bases each stands for (fixed values)
IUPAC = {"R": "GA", "K": "GT", "S": "GC", "Y": "TC", "W": "TA", "M": "CA"}


def complement(seq: Column) -> Column:
    """Upper-case complement of the four bases; the mate separator ``n`` and all else stay."""
    return F.translate(seq, "ACGTacgt", "TGCATGCA")


def full_complement(seq: Column) -> Column:
    """Complement with ambiguity codes, keeping case; S, W, N, gaps and ``n`` stay."""
    return F.translate(seq, "ATCGRKYMatcgrkym", "TAGCYMRKtagcymrk")


def reverse_complement(seq: Column) -> Column:
    """The other strand, read in its own direction."""
    return F.reverse(full_complement(seq))


def canonical_strand(seq: Column) -> Column:
    """The smaller of a sequence and its reverse complement."""
    return F.least(seq, reverse_complement(seq))


def _code_map(which: int) -> Column:
    pairs = [F.lit(x) for c, b in IUPAC.items() for x in (c, b[which])]
    return F.create_map(*pairs, *[F.lit(x) for b in "ACGT" for x in (b, b)])


def allele_of(base: Column, which: int) -> Column:
    """One of the two bases (0 or 1) a code stands for; null for N, gaps and all else."""
    return _code_map(which)[F.upper(base)]


def split_alleles(seq: Column) -> tuple[Column, Column]:
    """The two haplotypes of a diploid consensus: upper-case codes give their first base to the first
    haplotype, lower-case codes (the opposite phase) to the second."""
    upper, first, second = "".join(IUPAC), "".join(b[0] for b in IUPAC.values()), "".join(b[1] for b in IUPAC.values())
    codes = upper + upper.lower()
    return F.translate(seq, codes, first + second), F.translate(seq, codes, second + first)


def code_of_pair(a: Column, b: Column) -> Column:
    """The code of two bases: the base itself, an ambiguity code, N otherwise."""
    codes = {"".join(sorted(v)): k for k, v in IUPAC.items()} | {b * 2: b for b in "ACGT"}
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(table[F.concat(F.least(a, b), F.greatest(a, b))], F.lit("N"))


def genotype_index(alleles: Column, base: Column) -> Column:
    """Place of a base among ranked alleles, 9 where it is none of them."""
    at = F.array_position(alleles, base)
    return F.when(at > 0, (at - 1).cast("int")).otherwise(F.lit(9))


def vcf_genotype(field: Column) -> tuple[Column, Column]:
    """Both allele numbers of a sample field like ``0/1:12:...``; null where missing."""
    gt = F.split_part(field, F.lit(":"), F.lit(1))
    alleles = F.split(gt, r"[/|]")
    return F.get(alleles, F.lit(0)).try_cast("int"), F.get(alleles, F.lit(1)).try_cast("int")


def abundance(header: Column) -> Column:
    """The number in ``size=N`` of a read header, 1 where it has none."""
    return F.coalesce(F.nullif(F.regexp_extract(header, r"size=(\d+)", 1), F.lit("")).cast("bigint"), F.lit(1).cast("bigint"))


def mates(seq: Column) -> tuple[Column, Column]:
    """Both mates of a joined read; the second is null where there is one."""
    parts = F.split(seq, "nnnn")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def clean_name(name: Column) -> Column:
    """A name with every character that file formats trip over replaced by ``_``."""
    return F.regexp_replace(name, r"[\s\"'`!@#$%^&*()+={}\[\]|\\:;<>,?/]", "_")


def mask_motif(seq: Column, motif: str) -> Column:
    """All (non-overlapping) exact matches of a motif and its reverse complement replaced by Ns of the same length."""
    other = motif.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    masked = F.replace(seq, F.lit(motif), F.lit("N" * len(motif)))
    return masked if other == motif else F.replace(masked, F.lit(other), F.lit("N" * len(motif)))


def expand_ambiguous(motif: str) -> list[str]:
    """The plain motifs an ambiguous cut site stands for."""
    out = [""]
    for letter in motif.upper():
        out = [m + b for m in out for b in IUPAC.get(letter, letter)]
    return sorted(out)


def internal_gaps(seq: Column) -> Column:
    """Gaps inside a row, not at its ends."""
    inner = F.regexp_replace(seq, "^-+|-+$", "")
    return F.length(inner) - F.length(F.replace(inner, F.lit("-"), F.lit("")))


def count_letter(seq: Column, letter: str) -> Column:
    """How often one letter occurs."""
    return F.length(seq) - F.length(F.replace(seq, F.lit(letter), F.lit("")))


def trim_terminal(seq: Column, letters: str = "N-") -> Column:
    """A sequence without the given letters at its ends."""
    kinds = "".join("\\" + c if c in "-]\\^" else c for c in letters)
    return F.regexp_replace(seq, f"^[{kinds}]+|[{kinds}]+$", "")


def merge_column(a: Column, b: Column) -> Column:
    """One column of two overlapping mates: equal bases stay, N and gaps yield, a conflict is N."""
    return F.when(a == b, a).when(a.isNull() | a.isin("N", "-"), b).when(b.isNull() | b.isin("N", "-"), a).otherwise(F.lit("N"))


def apply_cigar(seq: Column, cigar: Column) -> Column:
    """A read laid out by its CIGAR string: matches kept, deletions as gaps, insertions and clips skipped."""
    ops = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), 1)
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(state: Column, op: Column) -> Column:
        n, kind = F.substring(op, F.lit(1), F.length(op) - 1).cast("int"), F.right(op, F.lit(1))
        piece = F.when(kind.isin("M", "=", "X"), F.substring(seq, state["at"], n)).when(kind.isin("D", "N"), F.repeat(F.lit("-"), n)).otherwise(F.lit(""))
        used = F.when(kind.isin("M", "=", "X", "I", "S"), n).otherwise(F.lit(0))
        return F.struct(F.concat(state["out"], piece).alias("out"), (state["at"] + used).alias("at"))

    return F.aggregate(ops, start, step, lambda s: s["out"])


def make_cigar(seq: Column) -> Column:
    """The CIGAR string of an aligned row: runs of letters are matches, runs of gaps deletions."""
    runs = F.regexp_extract_all(seq, F.lit("(-+|[^-]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.length(r).cast("string"), F.when(F.startswith(r, F.lit("-")), F.lit("D")).otherwise(F.lit("M")))), "")


def portable_draw(key: Column, seed: int) -> Column:
    """A seeded number below 2^31 - 1 for an integer key, by integer arithmetic that any engine repeats."""
    mixed = F.pmod(F.pmod(key.cast("bigint"), F.lit(2147483647)) * F.lit(48271) + F.lit(seed * 40503 + 11), F.lit(2147483647))
    return F.pmod(mixed * F.lit(69621) + F.lit(seed), F.lit(2147483647))


def text_number(text: Column) -> Column:
    """A number below 2^28 for a text, from its digest, that any engine repeats."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint")


def log_choose(n: Column, k: Column) -> Column:
    """The logarithm of the number of ways to choose ``k`` of ``n``."""
    least = F.least(k, n - k)
    steps = F.when(least > 0, F.sequence(F.lit(1).cast("bigint"), least.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.ln((n - least + i) / i))


def binomial_pmf(n: Column, k: Column, p: float) -> Column:
    """The probability of ``k`` successes of ``n``, 0 where that cannot be."""
    value = F.exp(log_choose(n, k) + k * F.ln(F.lit(p)) + (n - k) * F.ln(F.lit(1 - p)))
    return F.when((k >= 0) & (k <= n), value).otherwise(0.0)


def hill_numbers(shares: Column, order: float) -> Column:
    """The effective number of kinds of order 0, 1 or q from an array of shares; zero shares count for nothing."""
    held = F.filter(shares, lambda p: p > 0)
    if order == 0:
        return F.size(held).cast("double")
    if order == 1:
        return F.exp(-F.aggregate(held, F.lit(0.0), lambda a, p: a + p * F.ln(p)))
    return F.pow(F.aggregate(held, F.lit(0.0), lambda a, p: a + F.pow(p, F.lit(float(order)))), F.lit(1 / (1 - order)))


def register(spark) -> None:
    """The functions for use in SQL text, as temporary SQL functions that are inlined into plans."""
    spark.sql("create or replace temporary function revcomp(s string) returns string return reverse(translate(s, 'ATCGRKYMatcgrkym', 'TAGCYMRKtagcymrk'))")
    spark.sql("create or replace temporary function abundance(h string) returns bigint return coalesce(cast(nullif(regexp_extract(h, 'size=([0-9]+)', 1), '') as bigint), 1)")
    spark.sql("create or replace temporary function internal_gaps(s string) returns int return length(regexp_replace(s, '^-+|-+$', '')) - length(replace(regexp_replace(s, '^-+|-+$', ''), '-', ''))")
