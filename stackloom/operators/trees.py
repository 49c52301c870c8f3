"""Trees: reading newick text, tests and support values drawn from them, and trees of distance matrices."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Node:
    """A node of a rooted tree."""

    def __init__(self, name: str = "", length: float | None = None):
        self.name, self.length, self.children = name, length, []

    def tips(self) -> list[str]:
        return [self.name] if not self.children else [t for c in self.children for t in c.tips()]

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            yield from c.walk()


def parse_newick(text: str) -> Node:
    """The root of a newick tree; comments in brackets are skipped."""
    tokens = re.findall(r"[(),;]|[^(),;]+", re.sub(r"\[[^\]]*\]", "", text.strip()))
    root = current = Node()
    stack: list[Node] = []
    for t in tokens:
        if t == "(":
            stack.append(current)
            child = Node()
            current.children.append(child)
            current = child
        elif t == ",":
            current = Node()
            stack[-1].children.append(current)
        elif t == ")":
            current = stack.pop()
        elif t != ";":
            name, _, length = t.partition(":")
            current.name = name.strip()
            current.length = float(length) if length.strip() else None
    return root


def tree_nodes(trees: DataFrame) -> DataFrame:
    """``tree_id, node, parent, name, length, n_tips`` of each tree of ``trees(tree_id, newick)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tree, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                nodes = list(parse_newick(text).walk())
                number = {id(n): k for k, n in enumerate(nodes)}
                parent = {id(c): number[id(n)] for n in nodes for c in n.children}
                out += [(tree, number[id(n)], parent.get(id(n)), n.name or None, n.length, len(n.tips())) for n in nodes]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32())
            yield pa.record_batch([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["tree_id", "node", "parent", "name", "length", "n_tips"])

    return trees.select(F.col("tree_id").cast("bigint").alias("tree_id"), "newick").mapInArrow(run, "tree_id bigint, node int, parent int, name string, length double, n_tips int")


def tests_from_tree(newick: str, allowed: dict[str, set[str]] | None = None) -> list[tuple[str, str, str, str]]:
    """All four-taxon tests ((p1, p2), p3), p4 of tips that a rooted tree admits, each once (p1 < p2).

    ``allowed`` restricts a place (``p1`` to ``p4``) to a set of tips."""
    root, out = parse_newick(newick), set()
    allowed = allowed or {}
    fits = lambda t: all(x in allowed.get(p, {x}) for p, x in zip(("p1", "p2", "p3", "p4"), t))
    for top in root.walk():
        for i, far in enumerate(top.children):
            for j, near in enumerate(top.children):
                if i == j:
                    continue
                for mid in near.walk():
                    for k, third in enumerate(mid.children):
                        for m, pair in enumerate(mid.children):
                            if k == m:
                                continue
                            for node in pair.walk():
                                for x, y in combinations(node.children, 2):
                                    for a in x.tips():
                                        for b in y.tips():
                                            for c in third.tips():
                                                for o in far.tips():
                                                    t = (min(a, b), max(a, b), c, o)
                                                    if fits(t):
                                                        out.add(t)
    return sorted(out)


def _splits(root: Node) -> set[frozenset[str]]:
    return {frozenset(n.tips()) for n in root.walk() if n.children}


def clade_support(trees: DataFrame, clades: dict[str, list[str]], quartets: int = 200, seed: int = 42) -> DataFrame:
    """``tree_id, clade, support``: the share of quartets (two tips of the clade, two outside it) that the tree parts that way.

    All quartets count where there are at most ``quartets``; else as many seeded draws."""

    def share(splits: set[frozenset[str]], tips: set[str], clade: set[str], rng: np.random.Generator) -> float | None:
        inside, outside = sorted(clade & tips), sorted(tips - clade)
        if len(inside) < 2 or len(outside) < 2:
            return None
        pairs_in, pairs_out = list(combinations(inside, 2)), list(combinations(outside, 2))
        total = len(pairs_in) * len(pairs_out)
        draws = range(total) if total <= quartets else rng.integers(0, total, quartets)
        good = 0
        for d in draws:
            (a, b), (c, e) = pairs_in[d // len(pairs_out)], pairs_out[d % len(pairs_out)]
            good += any((a in s) == (b in s) and (c in s) == (e in s) and (a in s) != (c in s) for s in splits)
        return good / len(draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tree, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    root = parse_newick(text)
                    splits, tips, rng = _splits(root), set(root.tips()), np.random.default_rng([seed, tree])
                    out += [(tree, name, share(splits, tips, set(members), rng)) for name, members in clades.items()]
            yield pa.record_batch([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.float64())], names=["tree_id", "clade", "support"])

    return trees.select(F.col("tree_id").cast("bigint").alias("tree_id"), "newick").mapInArrow(run, "tree_id bigint, clade string, support double")


def neighbour_joining(names: list[str], distance: np.ndarray) -> str:
    """A newick tree of a distance matrix by neighbour joining."""
    d, labels = distance.astype(float).copy(), list(names)
    while len(labels) > 2:
        n = len(labels)
        q = (n - 2) * d - d.sum(axis=0)[None, :] - d.sum(axis=1)[:, None]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(divmod(int(np.argmin(q)), n))
        left = 0.5 * d[i, j] + (d[i].sum() - d[j].sum()) / (2 * (n - 2))
        row = 0.5 * (d[i] + d[j] - d[i, j])
        merged = f"({labels[i]}:{left:.6f},{labels[j]}:{d[i, j] - left:.6f})"
        keep = [k for k in range(n) if k not in (i, j)]
        d = np.block([[d[np.ix_(keep, keep)], row[keep][:, None]], [row[keep][None, :], np.zeros((1, 1))]])
        labels = [labels[k] for k in keep] + [merged]
    return (f"({labels[0]}:{d[0, 1] / 2:.6f},{labels[1]}:{d[0, 1] / 2:.6f});" if len(labels) == 2 else f"{''.join(labels)};")


def window_trees(cells: DataFrame, min_snps: int = 2) -> DataFrame:
    """``scaffold, start, samples, snps, tree``: a tree for each window of ``cells(scaffold, start, snp_id, pop, freq)`` by neighbour joining of the
    populations' mean frequency differences; null with fewer than ``min_snps`` sites.

    A window's rows are the sites of a bounded range times the study's populations."""
    grouped = cells.groupBy("scaffold", "start").agg(F.collect_list(F.struct("snp_id", "pop", "freq")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples, snps, trees = [], [], []
            for rows in batch.column(2).to_pylist():
                names, sites = sorted({r["pop"] for r in rows}), sorted({r["snp_id"] for r in rows})
                m = np.full((len(names), len(sites)), np.nan)
                for r in rows:
                    m[names.index(r["pop"]), sites.index(r["snp_id"])] = r["freq"]
                gap = np.abs(m[:, None, :] - m[None, :, :])
                seen = ~np.isnan(gap)
                d = np.where(seen, gap, 0).sum(axis=2) / np.maximum(seen.sum(axis=2), 1)
                samples.append(len(names))
                snps.append(len(sites))
                trees.append(neighbour_joining(names, d) if len(sites) >= min_snps and len(names) > 2 else None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(samples, pa.int32()), pa.array(snps, pa.int32()), pa.array(trees, pa.string())], names=["scaffold", "start", "samples", "snps", "tree"])

    return grouped.select(F.col("scaffold").cast("bigint").alias("scaffold"), F.col("start").cast("bigint").alias("start"), "rows").mapInArrow(run, "scaffold bigint, start bigint, samples int, snps int, tree string")
