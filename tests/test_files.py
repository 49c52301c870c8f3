"""Reading files with bad records in them, and mates by their place."""

import random

import pytest

from stackloom.sources import formats


def text_of(n, bad, rng):
    """FASTQ text of ``n`` records of which those in ``bad`` are broken, and the names of the others."""
    out, names = [], []
    for k in range(n):
        seq = "".join(rng.choice("ACGTN") for _ in range(rng.randrange(4, 12)))
        qual = rng.choice("@I+#") + "".join(rng.choice("@I#+5") for _ in range(len(seq) - 1))
        record = [f"@r{k} x", seq, rng.choice(["+", f"+r{k}"]), qual]
        kind = rng.randrange(6) if k in bad else None
        if kind == 0:
            record[3] = record[3][:-2]
        elif kind == 1:
            record = record[:3]
        elif kind == 2:
            record = record[:2]
        elif kind == 3:
            record[0] = record[0][1:]
        elif kind == 4:
            record[1] = record[1][:-1] + "X"
        elif kind == 5:
            record[2] = record[2].replace("+", "-")
        if kind is None:
            names.append(f"r{k} x")
        out.append("\n".join(record))
    return "\n".join(out) + "\n", names


@pytest.mark.parametrize("size", ["71", "501", "128m"])
def test_bad_records_cost_no_good_ones(spark, tmp_path, size):
    rng = random.Random(int(size.rstrip("m")))
    text, names = text_of(200, {0, 7, 9, 60, 111, 150, 199}, rng)
    (tmp_path / "a.fastq").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        scanned = formats.scan_fastq(spark, str(tmp_path / "a.fastq")).collect()
        numbered = formats.numbered_records(formats.scan_fastq(spark, str(tmp_path / "a.fastq"))).orderBy("ordinal").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r["name"] for r in scanned if r["reason"] is None) == sorted(names)
    assert all(r["text"] for r in scanned if r["reason"] is not None)
    assert [(r["ordinal"], r["name"]) for r in numbered if r["name"]] == [(int(n[1:-2]), n) for n in names]


def test_one_bad_record(spark, tmp_path):
    rows = [["@r%d" % k, "ACGT", "+", "IIII"] for k in range(100)]
    for broken in (0, 10, 99):
        for change in (["@x", "ACGT", "+", "II"], ["@x", "ACGT", "+"]):
            text = "".join("\n".join(change if k == broken else r) + "\n" for k, r in enumerate(rows))
            (tmp_path / "b.fq").write_text(text)
            assert formats.read_fastq(spark, str(tmp_path / "b.fq")).count() == 99


def test_mates_keep_their_partners(spark, tmp_path):
    rng = random.Random(4)
    first, _ = text_of(80, {3, 40}, random.Random(1))
    records = ["@r%d\n%s\n+\n%s\n" % (k, s, "I" * len(s)) for k, s in enumerate("".join(rng.choice("ACGT") for _ in range(9)) for _ in range(80))]
    records[5] = "@r5\nACGT\n+\nI\n"
    (tmp_path / "s_R1_.fastq").write_text("".join("@r%d\nACGT\n+\nIIII\n" % k if k not in (3, 40) else "@r%d\nACGT\n+\nIII\n" % k for k in range(80)))
    (tmp_path / "s_R2_.fastq").write_text("".join(records))
    pairs = formats.read_fastq_pairs(spark, str(tmp_path / "s_R1_.fastq"), str(tmp_path / "s_R2_.fastq")).orderBy("ordinal").collect()
    assert [r["name"] for r in pairs] == [f"r{k}" for k in range(80) if k not in (3, 5, 40)]
    assert all(records[r["ordinal"]].split("\n")[1] == r["seq2"] for r in pairs)
    estimate = formats.estimate_records(spark, str(tmp_path / "s_R1_.fastq")).first()["estimate"]
    assert estimate == formats.record_counts(spark, str(tmp_path / "s_R1_.fastq")).first()["records"] == 80
