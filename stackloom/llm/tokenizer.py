"""Problem 7: the whole corpus encoded with a public byte-level BPE tokenizer.

Method: a sentencepiece BPE model is serialised directly from the vocabulary
(token bytes and ranks): each byte is mapped to a printable character, every
token becomes a piece of score -rank, normalisation is the identity. Merging
the best-scored neighbouring pieces is then the byte-level merge by rank, so
the model's output on a pre-token is the token ids. Nothing is trained.
Decoding maps ids to their bytes.

Texts are cut where no pre-token can span: at a single blank between two
non-blank characters. These chunks repeat across the corpus, so each task
keeps the ids of the chunks it has met (a bounded store, emptied when full),
and only new chunks are pre-tokenised and encoded.

Defined ids: a null text and an empty text both have the empty list.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: where the vocabulary lies unless a path is given
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: the pre-token pattern of that public tokenizer (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_STORE = 400_000


def _byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is printable and
    no blank, else the next free one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free, out = 256, {}
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(free)
            free += 1
    return [out[b] for b in range(256)]


_LETTERS = _byte_letters()
_LATIN = str.maketrans({chr(b): c for b, c in enumerate(_LETTERS)})


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    """One protobuf field: int and bool as varint, float as 32 bits, else bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, int):
        return _varint(number << 3) + _varint(int(value))
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def read_ranks(path: str) -> list[bytes]:
    """The bytes of each token, by id."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(r): base64.b64decode(t) for t, r in pairs}
    return [ranks[i] for i in range(len(ranks))]


def build_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model with the unknown piece at 0 and
    token ``i`` at ``i + 1``."""
    out = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    for rank, token in enumerate(tokens):
        piece = token.decode("latin-1").translate(_LATIN).encode()
        out.append(_field(1, _field(1, piece) + _field(2, float(-rank))))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, 0) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


class Encoder:
    """Texts to ids and back, with a bounded store of known chunks."""

    def __init__(self, tokens: list[bytes]):
        import re

        import regex
        import sentencepiece

        self.tokens = tokens
        self.model = sentencepiece.SentencePieceProcessor(model_proto=build_model(tokens))
        self.pre_tokens = regex.compile(PATTERN).findall
        self.cut = re.compile(r"(?<=\S) (?=\S)").split
        self.known: dict[str, int] = {}
        self.flat, self.start, self.used = np.zeros(1 << 16, dtype=np.int32), [0], 0
        self.words: dict[str, list[int]] = {}

    def _encode_new(self, chunks: list[str]) -> None:
        """Ids of chunks not met before, appended to the store."""
        split = [self.pre_tokens(c) for c in chunks]
        words = self.words
        fresh = list(dict.fromkeys(w for ws in split for w in ws if w not in words))
        if len(words) + len(fresh) > _STORE:
            words.clear()
            fresh = list(dict.fromkeys(w for ws in split for w in ws))
        if fresh:
            mapped = [w.encode("utf-8", "replace").decode("latin-1").translate(_LATIN) for w in fresh]
            for w, ids in zip(fresh, self.model.encode(mapped, num_threads=1)):
                words[w] = [i - 1 for i in ids]
        for chunk, ws in zip(chunks, split):
            ids = [i for w in ws for i in words[w]]
            end = self.used + len(ids)
            if end > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(end, len(self.flat)), dtype=np.int32)])
            self.flat[self.used : end] = ids
            self.used = end
            self.known[chunk] = len(self.start) - 1
            self.start.append(end)

    def chunks(self, text: str) -> list[str]:
        """The pieces of a text; each but the first starts with the blank it
        was cut before. Their concatenation is the text."""
        first, *rest = self.cut(text)
        return [first, *[" " + c for c in rest]]

    def _store_rows(self, chunks: list[str]) -> list[int]:
        known = self.known
        new = list({c for c in chunks if c not in known})
        if new:
            self._encode_new(new)
        return [known[c] for c in chunks]

    def _rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Store rows of the chunks of all texts, and the number of each text's.

        All texts are cut at every blank at once, and only different pieces
        reach Python. A piece that is empty or has white space at an end was
        cut where a pre-token may span; the texts with such pieces are cut
        again with care."""
        if len(self.known) > _STORE:
            self.known, self.start, self.used = {}, [0], 0
        lists = pc.split_pattern(pa.array([t or "" for t in texts], pa.large_string()), " ")
        at = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        codes, pieces = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        good = np.array([p != "" and not p[0].isspace() and not p[-1].isspace() for p in pieces], dtype=bool)
        table = np.zeros(len(pieces), dtype=np.int64)
        table[good] = self._store_rows([" " + p for p, g in zip(pieces, good) if g])
        careful = np.flatnonzero(np.maximum.reduceat(~good[codes], at[:-1])) if len(codes) else []
        rows, count = table[codes], np.diff(at)
        first = [pieces[c] for c in codes[at[:-1]]]
        rows[at[:-1]] = self._store_rows(first)
        if not len(careful):
            return rows, count
        again, out, low = {k: self._store_rows(self.chunks(texts[k]) if texts[k] else []) for k in careful.tolist()}, [], 0
        for k in careful.tolist():
            out += [rows[low : at[k]], np.array(again[k], dtype=np.int64)]
            low = at[k + 1]
            count[k] = len(again[k])
        return np.concatenate([*out, rows[low:]]), count

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the offsets of the texts in them."""
        rows, count = self._rows(texts)
        start = np.array(self.start, dtype=np.int64)
        size = (start[1:] - start[:-1])[rows] if len(rows) else np.zeros(0, dtype=np.int64)
        ends = np.cumsum(size)
        flat_at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start[rows] - (ends - size), size) if len(rows) else np.zeros(0, dtype=np.int64)
        per_text = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])]
        return self.flat[flat_at], per_text

    def count_batch(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text."""
        rows, count = self._rows(texts)
        start = np.array(self.start, dtype=np.int64)
        size = (start[1:] - start[:-1])[rows] if len(rows) else np.zeros(0, dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        at = np.concatenate([[0], np.cumsum(count)])
        return total[at[1:]] - total[at[:-1]]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[int, Encoder] = {}


def encoder(tokens: list[bytes]) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    key = hash(tuple(tokens))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(tokens)
    return _ENCODERS[key]


_PART = 512


def encode_documents(documents: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, ids)`` for each row, whole texts, without special tokens (their
    strings are ordinary text). A null or empty text has the empty list;
    repeated rows come out as often as they are given."""
    tokens = documents.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))  # the fixed vocabulary, under 2 MB
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokens.value)
        for batch in batches:
            for at in range(0, batch.num_rows, _PART):
                part = batch.slice(at, _PART)
                flat, offsets = enc.encode_batch(part.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.record_batch([part.column(0), ids], schema=schema)

    picked = documents.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``: the inverse mapping."""
    tokens = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens.value
        for batch in batches:
            texts = [None if ids is None else b"".join(own[i] for i in ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint"), "ids").mapInArrow(run, "doc_id bigint, text string")
