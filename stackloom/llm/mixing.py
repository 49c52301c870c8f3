"""Problem 8: sources mixed to target shares of all tokens.

Method: soft-membership mixing. A classifier (naive Bayes over hashed words)
is fitted on a bounded labelled sample, documents of each target source, and
predicts each document's posterior over the domains. Nonnegative document
rates are then fitted by projected-gradient least squares: the expected token totals by posterior are brought as near to the
targets as they can be while the totals by label meet them exactly (the statement asks for shares by source) and rates
stay within 0 and ``max_repeats``.

Documents of one label whose posteriors round to the same eighths have one rate. One distributed pass adds up the tokens and
the exact expected tokens of each such cell (their number is bounded by the domains, whatever the corpus), so the gradient
of the whole corpus is a sum over cells, and the steps are repeated until they stand still; that they do is checked.

Rates become whole copies by a threshold on a hash, placed for each source so
that its tokens reach the target to within a document or so. The targets of
sources without documents cannot be reached: the others keep their
proportions, and the report says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.llm.pieces import Pieces, bucket, words_of
from stackloom.llm.tokenizer import VOCABULARY, encoder, read_ranks
from stackloom.plans.durable import cut

_BUCKETS = 1 << 13


def _word_buckets(known: dict, name: str) -> list[int]:
    if name not in known:
        if len(known) > 400_000:
            known.clear()
        known[name] = [bucket(w, _BUCKETS) for w in words_of(name.lower())]
    return known[name]


def domain_classifier(documents: DataFrame, sources: list[str], sample: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """(log weights ``[domain, bucket]``, share of each domain) of naive Bayes: words are fitted on about ``sample`` documents
    of each source, those of the smallest hashes, shares on all documents."""
    size = {r["source"]: r["n"] for r in documents.where(F.col("source").isin(sources)).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each target source
    number = {s: k for k, s in enumerate(sources)}
    limit = F.create_map(*[F.lit(x) for s in sources for x in (s, min(1.0, sample / max(1, size.get(s, 0))))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    picked = documents.where(F.col("source").isin(sources) & (draw < limit[F.col("source")])).select("source", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros((len(sources), _BUCKETS), dtype=np.int64), {}
        for batch in batches:
            p = Pieces(batch.column(1))
            owner = np.repeat(np.array([number[s] for s in batch.column(0).to_pylist()], dtype=np.int64), np.diff(p.at))
            pair, n = np.unique(owner * max(1, len(p.names)) + p.codes, return_counts=True) if len(owner) else (np.zeros(0, dtype=np.int64), [])
            for key, c in zip(pair.tolist(), n):
                for b in _word_buckets(known, p.names[key % len(p.names)]):
                    total[key // len(p.names), b] += c
        d, b = np.nonzero(total)
        yield pa.record_batch([pa.array(d), pa.array(b), pa.array(total[d, b])], names=["domain", "bucket", "n"])

    rows = picked.mapInArrow(count, "domain bigint, bucket bigint, n bigint").groupBy("domain", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most domains x buckets rows
    counts = np.zeros((len(sources), _BUCKETS))
    counts[rows.column("domain").to_numpy(), rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    counts += 0.5
    prior = np.array([size.get(x, 0) + 0.5 for x in sources])
    return np.log(counts / counts.sum(axis=1, keepdims=True)), prior / prior.sum()


def profile(documents: DataFrame, sources: list[str], weights: np.ndarray, prior: np.ndarray, vocabulary: str, sharpness: float = 4.0) -> DataFrame:
    """``doc_id, domain, tokens, posterior`` of the documents of ``sources``.

    The posterior is the prior times a softmax of the mean log weight of a text's words times
    ``sharpness`` (words of a text are far from independent, so they count as that many); without words it is the prior."""
    sc = documents.sparkSession.sparkContext
    tokens, table = sc.broadcast(read_ranks(vocabulary)), sc.broadcast(weights.astype(np.float32))  # both of fixed size
    number = {s: k for k, s in enumerate(sources)}
    schema = pa.schema([("doc_id", pa.int64()), ("domain", pa.int32()), ("tokens", pa.int64()), ("posterior", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, w, known = encoder(tokens.value), table.value, {}
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                n = enc.count_batch(batch.column(2).to_pylist())
                p = Pieces(batch.column(2))
                own = [_word_buckets(known, x) for x in p.names]
                worth = np.array([[*w[:, b].sum(axis=1), len(b)] for b in own]).reshape(len(own), len(sources) + 1)
                total = p.sums(worth)
                mean = total[:, :-1] / np.maximum(total[:, -1:], 1)
                e = prior * np.exp(sharpness * (mean - mean.max(axis=1, keepdims=True)))
                e /= e.sum(axis=1, keepdims=True)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(e) + 1, dtype=np.int32) * len(sources)), pa.array(e.ravel()))
                yield pa.record_batch([batch.column(0), pa.array([number[s] for s in batch.column(1).to_pylist()], pa.int32()), pa.array(n), flat], schema=schema)

    picked = documents.where(F.col("source").isin(sources) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint"), "source", F.col("text").cast("string"))
    return picked.mapInArrow(run, "doc_id bigint, domain int, tokens bigint, posterior array<double>").where("tokens > 0")


#: posteriors are rounded to this part of one to form cells
_EIGHTHS = 8


def _cell() -> Column:
    """A document's label and rounded posterior as text: at most a composition of about eight eighths for each label."""
    return F.concat_ws("", F.array(F.col("domain").cast("string")), F.lit(":"), F.transform("posterior", lambda p: F.round(p * _EIGHTHS).cast("int").cast("string")))


def _project(y: np.ndarray, label: np.ndarray, tokens: np.ndarray, cap: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The nearest rates (weighted by tokens) within 0 and the cap whose tokens by label are those wanted: each label's are
    lowered by one number, found by halving."""
    k = len(wanted)
    low, high = np.full(k, np.inf), np.full(k, -np.inf)
    np.minimum.at(low, label, y - cap)
    np.maximum.at(high, label, y)
    low, high = np.where(np.isfinite(low), low, 0.0), np.where(np.isfinite(high), high, 0.0)
    for _ in range(60):
        middle = (low + high) / 2
        too_many = np.bincount(label, tokens * np.clip(y - middle[label], 0, cap), minlength=k) > wanted
        low, high = np.where(too_many, middle, low), np.where(too_many, high, middle)
    return np.clip(y - high[label], 0, cap)


def fit_rates(profiled: DataFrame, share: np.ndarray, cap: np.ndarray, total: float | None = None, ridge: float = 0.005, tolerance: float = 1e-6, rounds: int = 50_000) -> tuple[dict[str, float], np.ndarray]:
    """(rate of each cell, tokens wanted of each domain). ``total``: tokens of the mixture; by default the most that the
    caps allow. ``ridge`` draws rates to those that labels alone would give; it makes the least squares strictly convex,
    so the steps have one limit. Raises if they have not come to rest after ``rounds``."""
    k = len(share)
    sums = [F.sum(F.col("tokens") * F.col("posterior")[j]).alias(f"s{j}") for j in range(k)]
    rows = profiled.groupBy("domain", _cell().alias("cell")).agg(F.sum("tokens").alias("tokens"), *sums).orderBy("cell").collect()  # bounded by the domains
    label, tokens = np.array([r["domain"] for r in rows], dtype=np.int64), np.array([float(r["tokens"]) for r in rows])
    soft = np.array([[r[f"s{j}"] for j in range(k)] for r in rows]).reshape(len(rows), k)
    have = np.bincount(label, tokens, minlength=k)
    reached = (have > 0) & (share > 0)
    goal = np.where(reached, share, 0.0)
    goal = goal / max(goal.sum(), 1e-12)
    most = np.min((have * cap)[reached] / goal[reached]) if reached.any() else 0.0
    wanted = goal * min(most, total or most)
    if not len(rows) or not wanted.sum():
        return {r["cell"]: 0.0 for r in rows}, wanted
    size, top = wanted.sum(), cap[label]
    start = (wanted / np.maximum(have, 1))[label]
    membership = soft / tokens[:, None]
    rate = last = _project(start, label, tokens, top, wanted)
    # steps in the metric of tokens, with the momentum of a strongly convex problem
    steep = max(1e-9, float(np.linalg.eigvalsh(membership.T @ (membership * (tokens / size)[:, None]))[-1])) + ridge
    push = (1 - (ridge / steep) ** 0.5) / (1 + (ridge / steep) ** 0.5)
    for _ in range(rounds):
        at = rate + push * (rate - last)
        residual = (at @ soft - wanted) / size
        last, rate = rate, _project(at - (membership @ residual + ridge * (at - start)) / steep, label, tokens, top, wanted)
        if np.abs(rate - last).max() < tolerance:
            return dict(zip((r["cell"] for r in rows), rate.tolist())), wanted
    raise RuntimeError(f"rates still move by {np.abs(rate - last).max():.2e} after {rounds} steps")


def _grid(df: DataFrame, measure, bins: int = 2048) -> dict[int, np.ndarray]:
    """Tokens of each domain by bin of ``measure`` (0 to 1)."""
    at = F.least(F.floor(measure * bins), F.lit(bins - 1)).cast("int")
    out: dict[int, np.ndarray] = {}
    for r in df.groupBy("domain", at.alias("b")).agg(F.sum("tokens").alias("n")).collect():  # at most domains x bins rows
        out.setdefault(r["domain"], np.zeros(bins))[r["b"]] = r["n"]
    return out


def _threshold(df: DataFrame, need: np.ndarray, bins: int = 2048) -> np.ndarray:
    """For each domain the ``pick`` (0 to 1) up to which tokens add up to ``need``: two levels of bins."""
    first = _grid(df, F.col("pick"), bins)
    at, left = np.zeros(len(need), dtype=int), need.astype(float).copy()
    for k, n in first.items():
        upto = np.cumsum(n)
        at[k] = min(int(np.searchsorted(upto, need[k])), bins - 1)
        left[k] = need[k] - (upto[at[k]] - n[at[k]])
    own = F.create_map(*[F.lit(x) for k in range(len(need)) for x in (k, int(at[k]))])
    inside = df.withColumn("b", own[F.col("domain")]).where(F.least(F.floor(F.col("pick") * bins), F.lit(bins - 1)) == F.col("b"))
    second = _grid(inside, F.col("pick") * bins - F.col("b"), bins)
    out = at / bins
    for k, n in second.items():
        upto = np.cumsum(n)
        j = int(np.searchsorted(upto, left[k] + n.max(initial=0) / 2))
        out[k] = (at[k] + j / bins) / bins
    return out


def _goals(targets: DataFrame) -> list:
    """The reachable rows of the small table of sources, by name."""
    return targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).orderBy("source").collect()


def mix_sources(documents: DataFrame, targets: DataFrame, total: float | None = None, vocabulary: str = VOCABULARY, sample: int = 1500) -> DataFrame:
    """``doc_id, source, tokens, rate, copies, posterior``: every document of a target
    source that has tokens, and how often the mixture uses it (0 to
    ``max_repeats``). ``posterior`` has the target sources in the order of their names.

    Repeated target rows count once (the largest share of a source); a null
    source, share or cap is no target; documents of null or other sources and
    those without tokens are left out; no targets or no documents give no rows."""
    spark, goals = documents.sparkSession, _goals(targets)
    if not goals:
        return spark.createDataFrame([], "doc_id bigint, source string, tokens bigint, rate double, copies int, posterior array<double>")
    sources, share, cap = [g["source"] for g in goals], np.array([g["share"] for g in goals]), np.array([float(g["cap"]) for g in goals])
    weights, prior = domain_classifier(documents, sources, sample)
    known = cut(profile(documents, sources, weights, prior, vocabulary))
    rates, wanted = fit_rates(known, share, cap, total)
    table = spark.createDataFrame(sorted(rates.items()), "cell string, rate double")
    rated = known.withColumn("cell", _cell()).join(F.broadcast(table), "cell")  # bounded by the domains
    caps = F.create_map(*[F.lit(x) for k in range(len(sources)) for x in (k, float(cap[k]))])
    names = F.array(*[F.lit(s) for s in sources])
    draw = (F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    part = F.col("rate") - F.floor("rate")
    # the order in which documents get one more copy: by their draw against the fraction of their rate
    order = draw / (draw + F.greatest(part, F.lit(1e-6)))
    whole = rated.select("doc_id", "domain", "tokens", "posterior", "rate", F.floor("rate").alias("whole"), F.when(F.floor("rate") < caps[F.col("domain")], order).otherwise(F.lit(1.0)).alias("pick"))
    base = {r["domain"]: r["n"] for r in whole.groupBy("domain").agg(F.sum(F.col("tokens") * F.col("whole")).alias("n")).collect()}  # a row for each source
    need = np.array([max(0.0, wanted[k] - (base.get(k) or 0)) for k in range(len(sources))])
    cuts = _threshold(whole.where("pick < 1"), need)
    at = F.create_map(*[F.lit(x) for k in range(len(sources)) for x in (k, float(cuts[k]))])
    copies = F.col("whole") + ((F.col("pick") < 1) & (F.col("pick") < at[F.col("domain")])).cast("int")
    return whole.select("doc_id", F.element_at(names, F.col("domain") + 1).alias("source"), "tokens", F.round("rate", 6).alias("rate"), copies.cast("int").alias("copies"), "posterior")


def mixture_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, documents, used_documents, copies,
    tokens, actual_share, most_copies, label_gap, fitted_share, expected_share, posterior_gap`` for each target source.

    ``actual_share`` counts tokens by label; ``label_gap`` is its distance from the target, spread over the sources that have
    documents. ``expected_share`` counts tokens by posterior, ``fitted_share`` does so for the rates before they became
    copies: the nearest to the target that posteriors can come while the labels' totals hold; ``posterior_gap`` is how far that is."""
    per = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("copies") > 0).alias("used_documents"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies")
    )
    names = [g["source"] for g in _goals(targets)]
    used = {"expected": F.col("copies"), "fitted": F.col("rate")}
    totals = mixed.agg(*[F.sum(F.col("tokens") * n * (F.col("posterior")[j] if j >= 0 else 1)).alias(f"{u}{j}") for u, n in used.items() for j in range(-1, len(names))])
    rows = [F.struct(F.lit(s).alias("source"), *[F.round(F.try_divide(f"{u}{j}", f"{u}-1"), 6).alias(f"{u}_share") for u in used]) for j, s in enumerate(names)]
    soft = totals.select(F.explode(F.array(*rows) if rows else F.array().cast("array<struct<source:string,expected_share:double,fitted_share:double>>")).alias("x")).select("x.*")
    goals = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = goals.join(per, "source", "left").join(soft, "source", "left").fillna(0)
    reach = per.join(goals, "source").agg(F.sum("target_share").alias("reached"), F.sum("tokens").alias("all_tokens"))
    goal = F.when(F.col("documents") > 0, F.col("target_share") / F.col("reached")).otherwise(0.0)
    actual = F.col("tokens") / F.col("all_tokens")
    return both.join(F.broadcast(reach)).select(
        "source", "target_share", "max_repeats", "documents", "used_documents", "copies", "tokens", F.round(actual, 6).alias("actual_share"), "most_copies", F.round(actual - goal, 6).alias("label_gap"), "fitted_share", "expected_share", F.round(F.col("fitted_share") - goal, 6).alias("posterior_gap")
    )  # one row
