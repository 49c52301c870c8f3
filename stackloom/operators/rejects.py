"""Problem 4: rows that fail to parse, parted from the valid ones with a reason.

Method: the records of a batch are handed to the CSV reader of Arrow as one
buffer, one row a record. Rows of a wrong column count or broken quoting come
back through its invalid-row callback (structural rejects); all fields of the
others are read as strings, and then whole columns are cast and checked at
once, which labels the failing cells. The callback is given rows singly, so
only bad rows cost Python work.

Every input row comes out exactly once for each ``rec_id`` it has: with ``ok`` true and its
fields, or with ``ok`` false, a null in each field and a ``reason``.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame

#: stands for a carriage return inside a line, a line end and a row end: characters
#: that the reader is told of, each replaced by _ESCAPED where a record holds it itself
_FIELD, _BARE_CR, _QUOTED_BLANK = "\x1f", "\x1e", "\x1d"
_OWN = re.compile("[\x1b\x1c\x1d\x1e\x1f]")
_ESCAPED = {"\x1b": "\x1b0", "\x1c": "\x1b1", "\x1d": "\x1b2", "\x1e": "\x1b3", "\x1f": "\x1b4"}
_BACK = {v: k for k, v in _ESCAPED.items()}


def _protect(text: str) -> str:
    return _OWN.sub(lambda m: _ESCAPED[m[0]], text)


def _restore(text: str) -> str:
    text = text.replace(_BARE_CR, "\r")
    return re.sub("\x1b[0-4]", lambda m: _BACK[m[0]], text) if "\x1b" in text else text


def _cleaned(raw: pa.Array) -> pa.Array:
    """The texts with the reader's own marks escaped; few or none hold any."""
    own = np.flatnonzero(pc.fill_null(pc.match_substring_regex(raw, _OWN.pattern), False).to_numpy(zero_copy_only=False))
    if not len(own):
        return raw
    texts = raw.to_pylist()
    for k in own:
        texts[k] = _protect(texts[k])
    return pa.array(texts, pa.string())


def _restored(column: pa.Array) -> pa.Array:
    """Escaped marks as they were."""
    column = pc.replace_substring(column, _BARE_CR, "\r")
    if not pc.any(pc.match_substring(column, "\x1b")).as_py():
        return column
    return pa.array([None if t is None else _restore(t) for t in column.to_pylist()], pa.string())


def _read(ordinals: np.ndarray, lines: pa.Array, names: list[str]) -> tuple[pa.Table, dict[int, int]]:
    """The well-formed rows, all columns as strings, and of the other rows the
    number of fields by their ordinal (the first field of each line)."""
    bad: dict[int, int] = {}

    def reject(row) -> str:
        bad[int(row.text.split(_FIELD, 1)[0])] = row.actual_columns - 1
        return "skip"

    everything = ["ordinal", *names]
    if not len(lines):
        return pa.table({"ordinal": pa.array([], pa.int64()), **{n: pa.array([], pa.string()) for n in names}}), bad
    data = ("\n".join(pc.binary_join_element_wise(pa.array(ordinals).cast(pa.string()), lines, _FIELD).to_pylist()) + "\n").encode("utf-8", "surrogatepass")
    table = pacsv.read_csv(
        io.BytesIO(data),
        read_options=pacsv.ReadOptions(column_names=everything, use_threads=False, block_size=len(data) + 1),
        parse_options=pacsv.ParseOptions(delimiter=_FIELD, quote_char=False, double_quote=False, escape_char=False, newlines_in_values=False, ignore_empty_lines=False, invalid_row_handler=reject),
        convert_options=pacsv.ConvertOptions(column_types={"ordinal": pa.int64(), **{n: pa.string() for n in names}}, strings_can_be_null=False, quoted_strings_can_be_null=False, check_utf8=False),
    )
    return table, bad


def _back(n: int, table: pa.Table) -> pa.Array:
    """For each of ``n`` rows its row in the reader's table, null where it has none."""
    at = np.full(n, -1, dtype=np.int64)
    at[table.column("ordinal").to_numpy()] = np.arange(len(table))
    return pa.array(np.maximum(at, 0), mask=at < 0)


def _wrong_count(reason: pa.Array, bad: dict[int, int], what: str, wanted: int) -> pa.Array:
    """Reasons with those of the rows of a wrong number of columns filled in."""
    if not bad:
        return reason
    mask = np.zeros(len(reason), dtype=bool)
    mask[list(bad)] = True
    rows = sorted(bad)
    return pc.replace_with_mask(reason, pa.array(mask), pa.array([f"{bad[k]} {what} instead of {wanted}" for k in rows], pa.string()))


def _first_failure(checks: list[tuple[pa.Array, str]], n: int) -> pa.Array:
    """The label of the first failing check of each row, null where none fails."""
    out = pa.nulls(n, pa.string())
    for good, label in reversed(checks):
        out = pc.if_else(pc.fill_null(good, False), out, pa.scalar(label))
    return out


def _batches(parse, columns: list[str], fields: list[str], out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = {c: batch.column(k) for k, c in enumerate(columns)}
            reason, values = parse(given)
            ok = pc.is_null(reason)
            kept = [given[c] for c in columns if c != "raw"]
            made = [pc.if_else(ok, values[f], pa.scalar(None, pa.string())) for f in fields]
            yield pa.record_batch([*kept, *made, ok, reason], schema=out)

    return run


def fastq_failure(name: pa.Array, seq: pa.Array, plus: pa.Array, qual: pa.Array, marked: pa.Array) -> pa.Array:
    """The reason why each of many FASTQ records is invalid, null for a valid one. ``name`` comes without its ``@``; ``marked`` says whether it had one."""
    return _first_failure(
        [
            (marked, "name line does not start with @"),
            (pc.greater(pc.binary_length(name), 0), "empty name"),
            (pc.greater(pc.binary_length(seq), 0), "empty sequence"),
            (pc.match_substring_regex(seq, r"\A[ACGTNacgtn]*\z"), "sequence letter that is not A, C, G, T or N"),
            (pc.starts_with(plus, "+"), "third line does not start with +"),
            (pc.match_substring_regex(qual, r"\A[!-J]*\z"), "quality character outside ! to J"),
            (pc.equal(pc.utf8_length(qual), pc.utf8_length(seq)), "quality and sequence differ in length"),
        ],
        len(name),
    )


def _parse_fastq(given: dict) -> tuple[pa.Array, dict[str, pa.Array]]:
    """Reasons and fields of a batch of records. Rows go to the reader and come back as whole columns; only rows that hold the
    reader's own marks are looked at singly."""
    raw = given["raw"]
    text = pc.replace_substring(_cleaned(raw), "\r\n", "\n")
    text = pc.if_else(pc.ends_with(text, "\n"), pc.utf8_slice_codeunits(text, 0, -1), text)
    # the ends of lines part the columns; a carriage return within a line stays a letter of it
    text = pc.replace_substring(pc.replace_substring(text, "\r", _BARE_CR), "\n", _FIELD)
    nothing, blank = pc.is_null(raw), pc.match_substring_regex(raw, r"\A\s*\z")
    rows = np.flatnonzero(pc.and_(pc.invert(nothing), pc.invert(pc.fill_null(blank, True))).to_numpy(zero_copy_only=False))
    table, bad = _read(rows, text.take(pa.array(rows)), ["name", "seq", "plus", "qual"])
    name, seq, plus, qual = (table.column(c).combine_chunks() for c in ("name", "seq", "plus", "qual"))
    failed = fastq_failure(pc.utf8_slice_codeunits(name, 1), seq, plus, qual, pc.starts_with(name, "@"))
    back = _back(len(raw), table)
    reason = pc.if_else(nothing, pa.scalar("null record"), pc.if_else(pc.fill_null(blank, False), pa.scalar("blank record"), failed.take(back)))
    return _wrong_count(reason, bad, "lines", 4), {"name": _restored(pc.utf8_slice_codeunits(name, 1)).take(back), "seq": seq.take(back), "qual": qual.take(back)}


#: one field of a barcode line: wholly quoted (then blanks may stand in it) or free of quotes
_BARCODE_FIELD = re.compile('"[^"]*"(?=[ \t\r]|$)|[^ \t\r"]+(?=[ \t\r]|$)')
_BLANKS = re.compile("[ \t\r]+")


#: fields added to a row of broken quoting, so that the reader rejects it by its column count
_BROKEN = 100


def _quoted_row(text: str) -> str:
    """The fields of a line with quotes, for the reader; with too many fields where the quoting is broken."""
    out, at, text = [], 0, text.strip(" \t\r")
    while at < len(text):
        m = _BARCODE_FIELD.match(text, at)
        if m is None:
            return _FIELD * _BROKEN
        out.append(m[0][1:-1] if m[0][0] == '"' else m[0])
        gap = _BLANKS.match(text, m.end())
        at = gap.end() if gap else m.end()
    return _FIELD.join(out)


def _parse_barcodes(given: dict) -> tuple[pa.Array, dict[str, pa.Array]]:
    """As for records; a line's fields are parted at blanks, lines with quotes one by one."""
    raw, kinds = given["raw"], given["datatype"]
    text = _cleaned(raw)
    plain = pc.replace_substring_regex(pc.utf8_trim(text, " \t\r"), "[ \t\r]+", _FIELD)
    quoted = np.flatnonzero(pc.fill_null(pc.match_substring(text, '"'), False).to_numpy(zero_copy_only=False))
    if len(quoted):
        mask = np.zeros(len(text), dtype=bool)
        mask[quoted] = True
        plain = pc.replace_with_mask(plain, pa.array(mask), pa.array([_quoted_row(t) for t in text.take(pa.array(quoted)).to_pylist()], pa.string()))
    plain = pc.replace_substring(plain, "\r", _BARE_CR)
    none = pa.scalar(None, pa.string())
    early = pc.case_when(
        pc.make_struct(pc.is_null(raw), pc.fill_null(pc.match_substring_regex(raw, r"\A\s*\z"), False), pc.invert(pc.fill_null(pc.is_in(kinds, pa.array(["rad", "pair3rad"])), False)), pc.fill_null(pc.match_substring(plain, "\n"), False)),
        pa.scalar("null line"), pa.scalar("blank line"), pa.scalar("unknown datatype"), pa.scalar("line end within a line"), none,
    )
    reason, values = early, {f: pa.nulls(len(raw), pa.string()) for f in ("sample", "barcode1", "barcode2")}
    for kind, codes in (("rad", ["barcode1"]), ("pair3rad", ["barcode1", "barcode2"])):
        rows = np.flatnonzero(pc.and_(pc.is_null(early), pc.fill_null(pc.equal(kinds, kind), False)).to_numpy(zero_copy_only=False))
        table, bad = _read(rows, plain.take(pa.array(rows)), ["sample", *codes])
        sample = table.column("sample").combine_chunks()
        checks = [(pc.match_substring_regex(sample, r"[^\s]"), "blank sample name")]
        for c in codes:
            own = table.column(c).combine_chunks()
            checks.append((pc.greater(pc.binary_length(own), 0), f"empty {c}"))
            checks.append((pc.match_substring_regex(own, r"\A[RKSYWMCATGrksywmcatg]*\z"), f"letter of {c} that is no nucleotide code"))
        back = _back(len(raw), table)
        reason = pc.coalesce(reason, _first_failure(checks, len(table)).take(back))
        broken = [k for k, n in bad.items() if n > _BROKEN // 2 and '"' in text[k].as_py()]
        reason = _wrong_count(reason, {k: n for k, n in bad.items() if k not in broken}, "fields", 1 + len(codes))
        if broken:
            mask = np.zeros(len(raw), dtype=bool)
            mask[broken] = True
            reason = pc.if_else(pa.array(mask), pa.scalar("broken quoting"), reason)
        values["sample"] = pc.coalesce(values["sample"], _restored(sample).take(back))
        for c in codes:
            values[c] = pc.coalesce(values[c], pc.utf8_upper(table.column(c).combine_chunks()).take(back))
    return reason, values


def parse_fastq_records(df: DataFrame) -> DataFrame:
    """``rec_id, fastq, name, seq, qual, ok, reason`` for each row of
    ``df(rec_id, fastq, raw)``; other columns are ignored."""
    columns, fields = ["rec_id", "fastq", "raw"], ["name", "seq", "qual"]
    out = pa.schema([("rec_id", pa.int64()), ("fastq", pa.string()), *((f, pa.string()) for f in fields), ("ok", pa.bool_()), ("reason", pa.string())])
    schema = "rec_id bigint, fastq string, name string, seq string, qual string, ok boolean, reason string"
    return df.selectExpr("cast(rec_id as bigint) rec_id", "fastq", "raw").mapInArrow(_batches(_parse_fastq, columns, fields, out), schema)


def parse_barcode_lines(df: DataFrame) -> DataFrame:
    """``rec_id, barcodes_file, datatype, sample, barcode1, barcode2, ok,
    reason`` for each row of ``df(rec_id, barcodes_file, datatype, raw)``;
    ``barcode2`` is null for datatype ``rad``; other columns are ignored."""
    columns, fields = ["rec_id", "barcodes_file", "datatype", "raw"], ["sample", "barcode1", "barcode2"]
    out = pa.schema([("rec_id", pa.int64()), ("barcodes_file", pa.string()), ("datatype", pa.string()), *((f, pa.string()) for f in fields), ("ok", pa.bool_()), ("reason", pa.string())])
    schema = "rec_id bigint, barcodes_file string, datatype string, sample string, barcode1 string, barcode2 string, ok boolean, reason string"
    return df.selectExpr("cast(rec_id as bigint) rec_id", "barcodes_file", "datatype", "raw").mapInArrow(_batches(_parse_barcodes, columns, fields, out), schema)
