"""The language-data operators against brute force, exact round trips and held-out grades."""

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import SF, same  # noqa: E402

from stackloom.functions.pigeonhole import COMPLEMENT, allocate, match_cell  # noqa: E402
from stackloom.llm import queries as L  # noqa: E402
from stackloom.llm.components import connected_components, consolidate_hits  # noqa: E402
from stackloom.llm.heavy_hitters import Summary, frequent_items, top_items  # noqa: E402
from stackloom.llm.mixing import mix_sources, mixture_report  # noqa: E402
from stackloom.llm.near_edits import similar_groups, similar_pairs  # noqa: E402
from stackloom.llm.reading import FEATURES, OrdinalModel, graded, reading_features, reading_levels, word_counts  # noqa: E402
from stackloom.llm.tokenizer import VOCABULARY, Encoder, decode_documents, encode_documents, read_ranks  # noqa: E402


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("name", sorted(L.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    same(spark, L.QUERIES[name], L.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(L.QUERIES) - set(L.ORACLE_SQL)))
def test_query_gives_rows(spark, name):
    assert L.QUERIES[name](spark, SF).count() > 0


# ------------------------------------------------------------ problem 1


def orders(record):
    m = record.upper().replace("-", "").split("NNNN") if "nnnn" in record else [record.upper().replace("-", "")]
    return [m[0] + m[1], m[1] + m[0]] if len(m) == 2 else ["".join(m)]


def plain_pairs(rows, least=0.85):
    out = set()
    for x, (i, s, a) in enumerate(rows):
        for j, t, b in rows[x + 1 :]:
            if i != j and s == t and a and b and s:
                longer = max(len(orders(a)[0]), len(orders(b)[0]))
                best = min(plain_distance(p, v) for p in orders(a) for q in orders(b) for v in (q, q.translate(COMPLEMENT)[::-1]))
                if longer and 1 - best / longer >= least:
                    out.add((min(i, j), max(i, j)))
    return out


def family(rng, n, length, edits, low=False):
    base = [rng.choice("AC" if low else "ACGT") for _ in range(length)]
    out = []
    for _ in range(n):
        s = base.copy()
        for _ in range(rng.randrange(edits + 1)):
            k = rng.randrange(len(s))
            s[k : k + 1] = rng.choice([["A"], ["N"], [], ["G", s[k]], ["R"]])
        t = "".join(s)
        if rng.random() < 0.3:
            t = t.translate(COMPLEMENT)[::-1]
        if rng.random() < 0.3:
            cut = rng.randrange(10, max(11, len(t) - 10))
            t = f"{t[:cut]}nnnn{t[cut:]}" if rng.random() < 0.5 else f"{t[cut:]}nnnn{t[:cut]}"
        out.append(t.lower() if rng.random() < 0.2 and "N" not in t else t)
    return out


def test_pairs_against_brute_force(spark):
    rng = random.Random(7)
    rows, k = [], 0
    for n in range(30):
        for s in family(rng, rng.randrange(1, 5), rng.choice([12, 25, 40, 70, 90]), rng.choice([1, 4, 9]), low=n % 7 == 0):
            rows.append((k, rng.choice(["a", "a", "b"]), s))
            k += 1
    rows += [(k, "a", rows[0][2]), (k + 1, "a", None), (k + 2, "a", ""), (k + 3, None, rows[0][2]), (k + 4, "a", "A"), (k + 5, "a", "A"), (k + 6, "a", "---"), (k + 7, "a", "AC-GT" * 9), rows[3]]
    df = spark.createDataFrame([("edits", *r, "clash") for r in rows], "record_kind string, rec_id bigint, sample string, seq string, band string")
    want = plain_pairs([(i, s, None if t is None or not t.replace("-", "") else t) for i, s, t in dict.fromkeys(rows)])
    got = [(r["id_a"], r["id_b"]) for r in similar_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    groups = {r["rec_id"]: r["group_id"] for r in similar_groups(df).collect()}
    assert all(groups[i] == groups[j] for i, j in want) and set(groups) == {i for i, s, t in rows if s and t and t.replace("-", "")}


def test_cells_and_bands_lose_nothing(spark):
    """Tiny cells split a sample by bands and blocks; the pairs stay the same."""
    from stackloom.llm.near_edits import distinct_records
    from stackloom.operators.similarity import similar_classes

    rng = random.Random(9)
    rows = [("edits", k, "a", s) for k, s in enumerate(x for _ in range(25) for x in family(rng, 4, rng.randrange(40, 110), 8))]
    df = spark.createDataFrame(rows, "record_kind string, rec_id bigint, sample string, seq string")
    _, classes = distinct_records(df)
    classes = classes.drop("n")
    pick = lambda cell: {(r["rep_a"], r["rep_b"], r["edits"]) for r in similar_classes(classes, cell=cell).collect()}
    assert pick(10) == pick(5000) and len(pick(10)) > 20


def test_long_records_and_empty_table(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("ACGT") for _ in range(5000))
    df = spark.createDataFrame([("edits", 1, "a", base), ("edits", 2, "a", base[:2000] + "A" + base[2100:]), ("edits", 3, "a", base[::-1])], "record_kind string, rec_id bigint, sample string, seq string")
    assert [tuple(r) for r in similar_pairs(df).collect()] == [("edits", 1, 2)]
    assert similar_pairs(df.limit(0)).count() == 0 and similar_groups(df.limit(0)).count() == 0


def test_thresholds_fill_the_budget_at_least_cost():
    rng = np.random.default_rng(0)
    cost = np.concatenate([np.zeros((20, 3, 1)), rng.random((20, 3, 4))], axis=2)
    budget = np.full(20, 5)
    t = allocate(cost, budget)
    assert ((t + 1).sum(axis=1) == 5).all()
    for n in range(20):
        best = min(sum(cost[n, j, c[j]] for j in range(3)) for c in np.ndindex(5, 5, 5) if sum(c) == 5)
        assert abs(sum(cost[n, j, t[n, j] + 1] for j in range(3)) - best) < 1e-12


def test_low_complexity_shared_by_all():
    """A motif that every record starts with must not hide matches."""
    rng = random.Random(3)
    recs = ["A" * 30 + s.replace("nnnn", "") for s in family(rng, 12, 60, 6) + family(rng, 12, 60, 6)]
    recs = [r.upper() for r in recs]
    one = np.ones(len(recs), bool)
    a, b, _ = match_cell(recs, one, one, np.arange(len(recs)), 0.85)
    assert {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())} == plain_pairs([(k, "s", r) for k, r in enumerate(recs)])


def test_few_hits_among_unrelated_records(monkeypatch):
    """What is tested letter by letter is a small part of all pairs, or large samples take too long."""
    from stackloom.functions import pigeonhole

    tested = []

    def counted(f):
        def run(*args):
            tested.append(len(args[3] if f.__name__ == "_partition_holds" else args[0]))  # hits
            return f(*args)

        return run

    for name in ("_partition_holds", "_window_holds"):
        if hasattr(pigeonhole, name):
            monkeypatch.setattr(pigeonhole, name, counted(getattr(pigeonhole, name)))
    rng, n = random.Random(4), 4000
    recs = ["".join(rng.choices("ACGT", k=rng.randrange(60, 114))) for _ in range(n)]
    one = np.ones(n, bool)
    match_cell(recs, one, one, np.arange(n), 0.85)
    assert sum(tested) < 0.002 * n * n


def test_windows_lose_nothing(monkeypatch):
    """Families at the bound, several samples and both strands, in one block and in many, against all pairs."""
    from stackloom.functions import pigeonhole
    from stackloom.functions.editdist import EncodedStrings, pair_distances

    rng = random.Random(12)
    recs, scope = [], []
    for _ in range(90):
        base = rng.choices("ACGT", k=rng.randrange(54, 120))
        for _ in range(5):
            s = base.copy()
            for _ in range(rng.randrange(len(base) // 6 + 1)):
                k = rng.randrange(len(s))
                s[k : k + 1] = rng.choice([rng.choices("ACGTN"), [], [*rng.choices("ACGT"), s[k]]])
            t = "".join(s)
            recs.append(t.translate(COMPLEMENT)[::-1] if rng.random() < 0.5 else t)
            scope.append(rng.randrange(2))
    n, scope = len(recs), np.array(scope)
    x, y = np.triu_indices(n, 1)
    x, y = x[scope[x] == scope[y]], y[scope[x] == scope[y]]
    enc = EncodedStrings(recs + [r.translate(COMPLEMENT)[::-1] for r in recs])
    length = np.array([len(r) for r in recs])
    bound = np.floor(0.15 * np.maximum(length[x], length[y]) + 1e-9)
    near = np.minimum(pair_distances(enc, x, y), pair_distances(enc, x, y + n))
    want = {(i, j, d) for i, j, d, most in zip(x.tolist(), y.tolist(), near.tolist(), bound) if d <= most}
    one = np.ones(n, bool)
    for sizes in ((), (("_SORTED", 3000), ("_LOOKED_UP", 500), ("_CHUNK", 64), ("_KEPT", 100), ("_CROWDED", 8)), (("_CROWDED", 0),)):
        for name, value in sizes:
            monkeypatch.setattr(pigeonhole, name, value)
        a, b, d = match_cell(recs, one, one, np.arange(n), 0.85, scope)
        got = [(min(i, j), max(i, j), e) for i, j, e in zip(a.tolist(), b.tolist(), d.tolist())]
        assert len(got) == len(want) > 100 and set(got) == want


# ------------------------------------------------------------ problem 2


def test_summary_bounds():
    rng = random.Random(5)
    items = [f"x{int(rng.paretovariate(0.7))}" for _ in range(20000)]
    true, s = Counter(items), Summary(50)
    for k in range(0, len(items), 700):
        block = Counter(items[k : k + 700])
        s.seen += sum(block.values())
        s.add(list(block), list(block.values()))
    assert s.error <= len(items) / 51 and len(s.kept) <= 50
    assert all(true[i] - s.error <= s.kept.get(i, 0) <= true[i] for i in true)


def test_frequent_items(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, "hot", "hot", "warm", f"u{rng.randrange(5000)}"]), None if rng.random() < 0.5 else "z", 1) for _ in range(6000)]
    df = spark.createDataFrame(rows, "a string, b string, item int").repartition(40).select("a", "b")
    true = Counter(a for a, _, _ in rows if a)
    for r in frequent_items(df, 2, counters=20).where("metric = 'a'").collect():
        assert r["approx_count"] <= true[r["item"]] <= r["approx_count"] + r["max_error"]
    top = [(r["item"], r["hits"]) for r in top_items(df, 2, counters=20).where("metric = 'a'").collect()]
    assert top == true.most_common(2)
    flat = spark.createDataFrame([(f"v{k:03d}",) for k in range(300)], "a string")
    assert sorted(r["item"] for r in top_items(flat, 3, counters=4).collect()) == ["v000", "v001", "v002"]
    assert top_items(df.limit(0), 2).count() == 0


# ------------------------------------------------------------ problem 6


def test_components_against_union_find(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1300)] + [(5000, 5000 + k) for k in range(1, 200)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([("s", a, b, 0) for a, b in edges], "scope string, src bigint, dst bigint, label int")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(df.limit(0)).count() == 0


def test_hits_with_dirty_labels(spark):
    records = spark.createDataFrame([("database", 1, "S_1"), ("database", 2, "s_2"), ("database", 3, "s_3"), ("clusters", 1, "s_1"), ("database", 4, None)], "tier string, rec_id bigint, label string")
    hits = spark.createDataFrame([("database", ">s_1;size=3", " S_2\t"), ("database", "s_2", "s_3;*"), ("clusters", "s_1", "s_2"), ("database", None, "s_1"), ("database", "nope", "s_1"), (None, "s_1", "s_2"), ("clusters", "s_1", "s_1")], "tier string, query_label string, target_label string")
    assert sorted(map(tuple, consolidate_hits(hits, records).collect())) == [("database", 1, 1), ("database", 2, 1), ("database", 3, 1)]


# ------------------------------------------------------------ problem 7

ODD = ["", " ", "  ", "a  b", "  x", "x  ", "a \n b", "don't  'LL we've", "\x00\x01 \x1c a\x1cb", "<|endoftext|> x", "日本 語  x　y", "é́", " \n\n ", "a▁b ▁ c", "\x85 x\xa0y", "x" * 50000, "word " * 20000, "१२३ ٤٥", "a​b", "😀 😀😀"]


def test_tokens_match_the_library():
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(Path(VOCABULARY).parent / "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = [x for x in pq.read_table(f"{SF}/documents.parquet", columns=["text"]).column(0).to_pylist() if x is not None] + ODD
    flat, at = Encoder(read_ranks(VOCABULARY)).encode_batch(texts)
    assert [flat[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_tokens_round_trip(spark):
    rows = [(k, t, "ids") for k, t in enumerate([*ODD, None])] + [(0, "", "ids")]
    enc = encode_documents(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"))
    back = sorted((r["doc_id"], r["text"]) for r in decode_documents(enc).collect())
    assert back == sorted((k, t or "") for k, t, _ in rows)
    assert {r["doc_id"]: r["ids"] for r in enc.collect()}[len(ODD)] == []
    assert encode_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


# ------------------------------------------------------------ problem 8


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(2)
    words = {"a": "alpha beta gamma delta".split(), "b": "one two three four".split(), "c": "red green blue".split()}
    rows = [(k, s, " ".join(rng.choice(words[s]) for _ in range(rng.randrange(20, 60)))) for k, s in enumerate(rng.choices(["a", "b", "c"], [8, 2, 1], k=1500))]
    rows += [(9001, None, "alpha"), (9002, "other", "alpha"), (9003, "a", None), (9004, "a", "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, source string, text string, tokens int")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 3), ("c", 0.35, 4), ("gone", 0.05, 2), ("a", 0.3, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mix_sources(docs, targets).cache()
    assert mixed.where("doc_id > 9000").count() == 0 and mixed.count() == 1500
    cap = {"a": 1, "b": 3, "c": 4}
    assert all(0 <= r["copies"] <= cap[r["source"]] for r in mixed.collect())
    report = {r["source"]: r for r in mixture_report(mixed, targets).collect()}
    for s, share in (("a", 0.3), ("b", 0.3), ("c", 0.35)):
        assert abs(report[s]["actual_share"] - share / 0.95) < 0.01
        assert abs(report[s]["label_gap"]) < 0.01 and abs(report[s]["posterior_gap"]) < 0.02  # the words tell the sources apart
    assert report["gone"]["tokens"] == 0 and report["gone"]["actual_share"] == 0
    assert mix_sources(docs, targets.limit(0)).count() == 0 and mix_sources(docs.limit(0), targets).count() == 0


def test_rates_come_to_rest_at_the_least_residual(spark):
    """Against many plain projected steps from elsewhere: labels exact, posteriors as near as they get, within the caps."""
    from stackloom.llm.mixing import _project, fit_rates

    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        d = int(rng.choice(3, p=[0.6, 0.3, 0.1]))
        p = rng.dirichlet(np.where(np.arange(3) == d, 2.0, 1.0))
        rows.append((i, d, int(rng.integers(20, 400)), p.tolist()))
    df = spark.createDataFrame(rows, "doc_id bigint, domain int, tokens bigint, posterior array<double>")
    share, cap = np.array([0.3, 0.3, 0.4]), np.array([1.0, 2.0, 5.0])
    rates, wanted = fit_rates(df, share, cap)
    cells: dict = {}
    for _, d, t, p in rows:
        key = f"{d}" + "".join(str(int(x * 8 + 0.5)) for x in p)
        own = cells.setdefault(key, [d, 0.0, np.zeros(3)])
        own[1] += t
        own[2] += t * np.array(p)
    assert set(cells) == {c.replace(":", "") for c in rates}
    keys = sorted(cells)
    label, tokens, soft = np.array([cells[k][0] for k in keys]), np.array([cells[k][1] for k in keys]), np.array([cells[k][2] for k in keys])
    rate = np.array([{c.replace(":", ""): v for c, v in rates.items()}[k] for k in keys])
    assert np.allclose(np.bincount(label, tokens * rate), wanted, rtol=1e-6) and (rate >= 0).all() and (rate <= cap[label] + 1e-9).all()
    start, size = (wanted / np.bincount(label, tokens))[label], wanted.sum()
    loss = lambda r: 0.5 * (((r @ soft - wanted) / size) ** 2).sum() + 0.0025 * (tokens / size * (r - start) ** 2).sum()
    other = _project(rng.random(len(keys)), label, tokens, cap[label], wanted)
    for _ in range(4000):
        other = _project(other - 0.9 * (soft / tokens[:, None] @ ((other @ soft - wanted) / size) + 0.005 * (other - start)), label, tokens, cap[label], wanted)
    assert abs(loss(rate) - loss(other)) < 1e-7


def test_classifier_on_held_out_documents(spark):
    """Three of the sources hold copies of each other's patents; the others can be told apart."""
    from stackloom.llm.mixing import domain_classifier, profile

    docs = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet").where("source is not null")
    sources = ["mt_gateway", "norda_office", "old_scans", "plain_summaries", "selmar_office", "tavik_feed", "utility_notes"]
    held = docs.where("doc_id % 5 = 0")
    rows = profile(held, sources, *domain_classifier(docs.where("doc_id % 5 <> 0"), sources), VOCABULARY).collect()
    guess, truth = np.array([int(np.argmax(r["posterior"])) for r in rows]), np.array([r["domain"] for r in rows])
    apart = np.isin(truth, [0, 2, 3, 6])
    largest = np.bincount(truth).max() / len(truth)
    print("held-out accuracy", (guess == truth).mean(), "largest", largest, "of the four", (guess == truth)[apart].mean(), [round(float((guess == truth)[truth == k].mean()), 3) for k in range(7)])
    assert (guess == truth).mean() > largest and (guess == truth)[apart].mean() > 0.4


# ------------------------------------------------------------ problem 9


def test_reading_levels_follow_held_out_grades(spark):
    folder = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/reading_labels.parquet")
    rows = reading_features(docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi"), word_counts(docs)).join(graded(labels), "doc_id").where("n_words > 0").toPandas()
    held = rows.doc_id % 5 == 0
    fit = lambda part: (part[FEATURES].to_numpy(), part.grade.to_numpy().astype(int), part.weight.to_numpy())
    model = OrdinalModel().fit(*fit(rows[~held]))
    truth = rows[held].groupby("doc_id").grade.mean()
    test = rows[held].drop_duplicates("doc_id").set_index("doc_id").loc[truth.index]
    guess = model.predict(test[FEATURES].to_numpy())
    error, base = np.abs(guess - truth).mean(), np.abs(rows[~held].grade.mean() - truth).mean()
    print("held-out mean error", error, "of the mean", base, "correlation", np.corrcoef(guess, truth)[0, 1])
    assert error < 0.75 * base and np.corrcoef(guess, truth)[0, 1] > 0.6


def test_reading_edge_cases(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("the valve of a pump which opens wherein pressure is low.".split()) for _ in range(n))
    docs = [(k, text(30 + k), "x") for k in range(60)] + [(100, None, "x"), (101, "", "x"), (102, "12 34 !!", "x"), (103, "valve", "x"), (104, "word " * 100000, "x"), (0, "repeat me", "x")]
    labels = spark.createDataFrame([(k, "g", 1 + k % 5) for k in range(50)] + [(1, "h", None), (2, "h", 9), (999, "h", 2), (3, "g", 4)], "doc_id bigint, grader string, grade int")
    df = spark.createDataFrame(docs, "doc_id bigint, text string, level string")
    out = reading_levels(df, labels).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(docs) and all(1 <= r["level"] <= 5 and 1 <= r["grade"] <= 5 for r in out)
    assert [by[k]["basis"] for k in (100, 101, 102, 103)] == ["no words", "no words", "no words", "short"]
    assert reading_levels(df.limit(0), labels).count() == 0
    assert {r["level"] for r in reading_levels(df, labels.limit(0)).where("n_words > 0").collect()} == {3.0}


def test_frequent_items_of_a_flat_column(spark, monkeypatch):
    """A small summary has no counter for most items; none that can be among the top may be missing."""
    from stackloom.llm import heavy_hitters

    rows = [(f"v{k:03d}", "z") for k in range(300) for _ in range(k % 7 + 1)]
    df = spark.createDataFrame(rows, "a string, b string").repartition(8)
    true = Counter(a for a, _ in rows)
    for most in (heavy_hitters._MOST, 4):  # enlarged, and counted
        monkeypatch.setattr(heavy_hitters, "_MOST", most)
        out = {(r["metric"], r["item"]): (r["approx_count"], r["max_error"]) for r in frequent_items(df, 3, counters=4).collect()}
        assert out.pop(("b", "z")) == (len(rows), 0)
        assert {i for i, n in true.items() if n == 7} <= {i for _, i in out}
        assert all(n <= true[i] <= n + e for (_, i), (n, e) in out.items())
