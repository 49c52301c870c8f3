"""Problem 9: how demanding each document is to read.

Method: regularised ordinal regression (cumulative logits) over lexical
diversity, word rarity, connectives, a proxy of clause depth and length
features, calibrated to the graded documents. Word rarity uses the counts of
all words of the whole corpus, kept in a table of fixed size by hashed word
(2^18 counters), so what is broadcast does not grow with the corpus.

Two passes over the texts: word counts, then features (written to the
checkpoint folder). The regression is fitted on the driver over at most
``max_graded`` graded documents (those of the smallest hashes if there are
more); all documents are then scored by column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.llm.pieces import Pieces, Store, bucket, words_of
from stackloom.plans.durable import cut

BUCKETS = 1 << 18
FEATURES = ["log_words", "diversity", "rarity", "rare_share", "word_letters", "syllables", "long_share", "connectives", "clause_depth", "subordination", "sentence_words", "figures", "function_share"]

CONNECTIVES = frozenset("however therefore thus hence moreover furthermore nevertheless consequently accordingly whereas although though because since unless further additionally alternatively likewise similarly otherwise instead meanwhile nonetheless preferably particularly".split())
SUBORDINATORS = frozenset("which that who whom whose wherein whereby whereupon where when while if because although though since unless until such so after before as".split())
FUNCTION = frozenset("the of and a to in is for with on by an at as it this be are from or that".split())
_VOWELS = frozenset("aeiouy")


def _syllables(word: str) -> int:
    n, inside = 0, False
    for c in word:
        now = c in _VOWELS
        n += now and not inside
        inside = now
    return max(1, n - (word.endswith("e") and n > 1))


def word_counts(documents: DataFrame, text_column: str = "text") -> np.ndarray:
    """How often the words of each hash bucket occur in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(BUCKETS, dtype=np.int64), {}
        for batch in batches:
            p = Pieces(batch.column(0))
            seen = np.bincount(p.codes, minlength=len(p.names))
            if len(known) > 500_000:
                known.clear()
            where, weight = [], []
            for name, n in zip(p.names, seen.tolist()):
                if name not in known:
                    known[name] = [bucket(w, BUCKETS) for w in words_of(name.lower())]
                for b in known[name]:
                    where.append(b)
                    weight.append(n)
            np.add.at(total, where, weight)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    rows = documents.select(F.col(text_column).cast("string")).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, dtype=np.int64)  # at most BUCKETS rows came
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def reading_features(documents: DataFrame, counts: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_words`` and the features of each document."""
    total = max(1, int(counts.sum()))
    surprise = documents.sparkSession.sparkContext.broadcast((math.log2(total + 1) - np.log2(counts + 1)).astype(np.float32))  # BUCKETS numbers
    rare = math.log2(1e5)  # rarer than once in 100,000 words
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), *((f, pa.float64()) for f in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = surprise.value

        def worth(piece: str) -> tuple:
            words = words_of(piece.lower())
            s = [float(own[bucket(w, BUCKETS)]) for w in words]
            return (
                len(words),
                sum(map(len, words)),
                sum(map(_syllables, words)),
                sum(len(w) >= 7 for w in words),
                sum(w in CONNECTIVES for w in words),
                sum(w in SUBORDINATORS for w in words),
                sum(w in FUNCTION for w in words),
                sum(s),
                sum(x > rare for x in s),
                piece.count(",") + piece.count(";") + piece.count("("),
                piece.endswith((".", "!", "?", "。", ":")),
                any(c.isdigit() for c in piece),
            )

        store = Store(12, worth)
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                p = Pieces(batch.column(1))
                words, letters, syllables, long, connect, sub, function, s, n_rare, marks, ends, figures = p.sums(store.table(p.names)).T
                names: dict[str, int] = {}
                stem = np.array([names.setdefault(n.lower().strip(".,;:()"), len(names)) for n in p.names], dtype=np.int64)
                text = np.repeat(np.arange(batch.num_rows), np.diff(p.at))
                pair = np.unique(text * max(1, len(names)) + stem[p.codes]) if len(text) else np.zeros(0, dtype=np.int64)
                kinds = np.bincount(pair // max(1, len(names)), minlength=batch.num_rows)
                pieces, w, sentences = np.maximum(np.diff(p.at), 1), np.maximum(words, 1), np.maximum(ends, 1)
                made = [np.log1p(words), kinds / np.sqrt(2 * pieces), s / w, n_rare / w, letters / w, syllables / w, long / w, 100 * connect / w, marks / sentences, sub / sentences, np.log1p(w / sentences), figures / pieces, function / w]
                yield pa.record_batch([batch.column(0), pa.array(words.astype(np.int64)), *map(pa.array, made)], schema=schema)

    kinds = ", ".join(f"{f} double" for f in FEATURES)
    return documents.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, f"doc_id bigint, n_words bigint, {kinds}")


class OrdinalModel:
    """P(grade <= k) = sigmoid(cut_k - x.w) with an L2 penalty on w, fitted by gradient
    steps with momentum on standardised features."""

    def __init__(self, penalty: float = 1.0, steps: int = 1500, rate: float = 0.3):
        self.penalty, self.steps, self.rate = penalty, steps, rate

    def fit(self, x: np.ndarray, grade: np.ndarray, weight: np.ndarray) -> OrdinalModel:
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        n, share = weight.sum(), np.array([weight[grade <= k].sum() for k in range(1, 5)])
        start = np.clip(share / n, 1e-3, 1 - 1e-3)
        first = np.log(start / (1 - start))
        # cuts are kept in order as a first cut and the logs of their gaps
        params = np.concatenate([np.zeros(z.shape[1]), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
        m = z.shape[1]
        speed, square = np.zeros_like(params), np.zeros_like(params)
        k = grade - 1
        for step in range(1, self.steps + 1):
            w, cuts = params[:m], self._cuts(params[m:])
            edge = np.concatenate([[-50.0], cuts, [50.0]])
            at = z @ w
            hi, lo = 1 / (1 + np.exp(np.clip(at - edge[k + 1], -50, 50))), 1 / (1 + np.exp(np.clip(at - edge[k], -50, 50)))
            p = np.maximum(hi - lo, 1e-9)
            d_hi, d_lo = hi * (1 - hi) / p * weight, lo * (1 - lo) / p * weight
            grad_w = z.T @ (d_hi - d_lo) / n + self.penalty * w / n
            grad_cut = np.array([-(d_hi[k == j].sum() - d_lo[k == j + 1].sum()) / n for j in range(4)])
            gaps = np.exp(params[m + 1 :])
            grad = np.concatenate([grad_w, [grad_cut.sum()], [gaps[j] * grad_cut[j + 1 :].sum() for j in range(3)]])
            speed, square = 0.9 * speed + 0.1 * grad, 0.999 * square + 0.001 * grad**2
            params -= self.rate * 0.1 * (speed / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        self.weights, self.cuts = params[:m], self._cuts(params[m:])
        return self

    def uncalibrated(self, n: int) -> OrdinalModel:
        """The model of no grades at all: every document is of the middle level."""
        self.mean, self.scale, self.weights, self.cuts = np.zeros(n), np.ones(n), np.zeros(n), np.log(np.array([0.25, 2 / 3, 1.5, 4.0]))
        return self

    @staticmethod
    def _cuts(raw: np.ndarray) -> np.ndarray:
        return raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])

    def column(self, features: list[str]) -> tuple[Column, Column]:
        """The expected grade (1 to 5) and the most probable half: the median grade."""
        z = [F.greatest(F.least((F.col(f) - float(m)) / float(s), F.lit(5.0)), F.lit(-5.0)) * float(w) for f, m, s, w in zip(features, self.mean, self.scale, self.weights)]
        at = sum(z[1:], z[0])
        above = [1 - 1 / (1 + F.exp(at - float(c))) for c in self.cuts]
        return sum(above, F.lit(1.0)), sum(((a > 0.5).cast("int") for a in above), F.lit(1))

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.clip((x - self.mean) / self.scale, -5, 5) @ self.weights
        return 1 + (1 / (1 + np.exp(self.cuts[None, :] - at[:, None]))).sum(axis=1)


def graded(labels: DataFrame) -> DataFrame:
    """``doc_id, grade, weight``: the distinct (document, grader, grade) rows with a grade of 1 to 5, a
    document's weight shared by its graders."""
    rows = labels.where("doc_id is not null and grade between 1 and 5").select(F.col("doc_id").cast("bigint").alias("doc_id"), "grader", "grade").distinct()
    per = rows.groupBy("doc_id").agg(F.collect_list("grade").alias("grades"))  # a handful of graders for each document
    return per.select("doc_id", F.explode("grades").alias("grade"), (1 / F.size("grades")).alias("weight"))


def fit_reading_model(features: DataFrame, labels: DataFrame, max_graded: int = 50_000, penalty: float = 1.0) -> OrdinalModel:
    """The regression over the graded documents, at most ``max_graded`` rows."""
    rows = features.join(graded(labels), "doc_id").where("n_words > 0").orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(max_graded).select(*FEATURES, "grade", "weight").toArrow()
    x = np.column_stack([rows.column(f).to_numpy() for f in FEATURES]) if rows.num_rows else np.zeros((0, len(FEATURES)))
    if not len(x):
        return OrdinalModel(penalty).uncalibrated(len(FEATURES))
    return OrdinalModel(penalty).fit(x, rows.column("grade").to_numpy().astype(np.int64), rows.column("weight").to_numpy())


def reading_levels(documents: DataFrame, labels: DataFrame, max_graded: int = 50_000) -> DataFrame:
    """``doc_id, n_words, level, grade, basis`` for each document.

    ``level`` is the expected grade (1 easy to 5 hard), ``grade`` the median of the
    predicted grades. ``basis`` says how far to trust it: ``english``;
    ``other`` (hardly any English function words: the grades were given to
    English texts); ``short`` (under 30 words); ``no words`` (null, empty or
    without letters: level 1, there is nothing to read). Without any grades
    every other document has level 3. Repeated rows come
    out as often as given; an empty table gives no rows."""
    if not documents.head(1):
        return documents.sparkSession.createDataFrame([], "doc_id bigint, n_words bigint, level double, grade int, basis string")
    features = cut(reading_features(documents, word_counts(documents)))
    level, grade = fit_reading_model(features, labels, max_graded).column(FEATURES)
    none = F.col("n_words") == 0
    basis = F.when(none, "no words").when(F.col("n_words") < 30, "short").when(F.col("function_share") < 0.08, "other").otherwise("english")
    return features.select("doc_id", "n_words", F.when(none, 1.0).otherwise(F.round(level, 4)).alias("level"), F.when(none, 1).otherwise(grade).cast("int").alias("grade"), basis.alias("basis"))
