"""Problem 5: missing values filled from similar records, with provenance.

Method: functional dependencies are mined from the complete records. A
candidate "determinant -> dependent" is measured by one aggregate per
determinant value (smallest and largest dependent, support) and is verified
when at most ``max_violations`` of its supported rows disagree; only determinant values with one
single dependent value enter its dictionary. Missing values are filled by left
joins with the dictionaries of verified dependencies, then by fallbacks over ever
wider groups (most frequent value, or median). Every filled value names its
source, and the original cell stays beside it in the flag ``*_missing``.

All statistics are grouped counts that are combined before the shuffle;
nothing is collected but the share of violations of each candidate.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.plans.durable import cut, python_tasks

#: legal letters of a genotype's base (fixed values)
BASES = "ACGTRKSYWM"


def dependency_dictionary(df: DataFrame, determinant: Sequence[str], dependent: str) -> DataFrame:
    """``determinant..., value, support, violating`` for each determinant value
    of the rows in which all of them are present. ``value`` is null where the
    determinant has several dependents."""
    complete = df.dropna(subset=[*determinant, dependent])
    grouped = complete.groupBy(*determinant).agg(F.min(dependent).alias("lo"), F.max(dependent).alias("hi"), F.count(F.lit(1)).alias("support"))
    one = F.col("lo") == F.col("hi")
    return grouped.select(*determinant, F.when(one, F.col("lo")).alias("value"), "support", F.when(one, 0).otherwise(F.col("support")).alias("violating"))


def violation_share(dictionary: DataFrame) -> float:
    """Share of supported rows (those whose determinant occurs twice or more)
    that contradict the dependency; 1 where nothing supports it."""
    row = dictionary.where("support > 1").agg((F.sum("violating") / F.sum("support")).alias("share")).first()
    return 1.0 if row is None or row["share"] is None else float(row["share"])


def mine_dependencies(df: DataFrame, candidates: Sequence[tuple[Sequence[str], str]], max_violations: float = 0.02) -> list[tuple[Sequence[str], str, float, DataFrame]]:
    """The verified ones of ``candidates`` as (determinant, dependent, share of
    violations, dictionary)."""
    out = []
    for determinant, dependent in candidates:
        dictionary = dependency_dictionary(df, determinant, dependent)
        share = violation_share(dictionary)
        if share <= max_violations:
            out.append((determinant, dependent, share, dictionary.where("value is not null").select(*determinant, "value")))
    return out


def possible_dependencies(columns: Sequence[str], dependents: Sequence[str], most: int = 2) -> list[tuple[list[str], str]]:
    """Every set of up to ``most`` other columns as a determinant of each dependent, small sets first."""
    return [(list(d), v) for v in dependents for k in range(1, most + 1) for d in combinations([c for c in columns if c != v], k)]


def group_mode(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The most frequent non-null value of each group (the smallest of ties)."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))["v"].alias(name))


def group_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The lower median of each group, from its weighted values: the cumulative
    weight is taken over distinct values, not over rows."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    if not keys:
        # no group: the distinct values alone are ranked, by Spark's own weighted percentile
        return counted.agg(F.expr(f"percentile({value}, 0.5, n)").cast("bigint").alias(name))
    own = Window.partitionBy(*keys)
    ranked = counted.withColumn("upto", F.sum("n").over(own.orderBy(value))).withColumn("total", F.sum("n").over(own))
    return ranked.where(F.col("upto") * 2 >= F.col("total")).groupBy(*keys).agg(F.min(value).alias(name))


def _filled(value: Column, missing: Column, sources: Sequence[tuple[Column, str]]) -> tuple[Column, Column]:
    """The first present value, and where a missing one came from."""
    filled = F.coalesce(value, *[c for c, _ in sources])
    origin = reduce(lambda rest, s: F.when(s[0].isNotNull(), F.lit(s[1])).otherwise(rest), reversed(sources), F.lit("unfilled"))
    return filled, F.when(missing, origin)


def fill_population_map(imap: DataFrame) -> DataFrame:
    """``sample, pop, site, elev_m, plate, pop_missing, pop_source,
    elev_missing, elev_source``, one row for each sample.

    ``pop`` is filled over the verified dependencies among ``site`` and ``plate`` -> pop, then by the most frequent of the site
    and of all; ``elev_m`` by the mean of the collecting site, then of the population,
    then of all. Illegal values count as missing. Repeated rows come out
    once; a null sample is kept as one."""
    clean = imap.select("sample", F.when(F.col("pop").rlike("^pop_[a-l]$"), F.col("pop")).alias("pop"), "site", F.when((F.col("elev_m") >= 0) & (F.col("elev_m") <= 4500), F.col("elev_m")).alias("elev_m"), "plate").distinct()
    pop_sources: list = []
    for k, (determinant, _, _, dictionary) in enumerate(mine_dependencies(clean, possible_dependencies(["site", "plate"], ["pop"]))):
        clean = clean.join(dictionary.withColumnRenamed("value", f"fd{k}"), list(determinant), "left")
        pop_sources.append((F.col(f"fd{k}"), f"dependency {'+'.join(determinant)} -> pop"))
    clean = clean.join(group_mode(clean, ["site"], "pop", "site_pop"), "site", "left")
    clean = clean.join(F.broadcast(group_mode(clean, [], "pop", "any_pop")), how="left")  # one row
    pop, pop_source = _filled(F.col("pop"), F.col("pop").isNull(), [*pop_sources, (F.col("site_pop"), "site"), (F.col("any_pop"), "all")])
    known = clean.select("sample", pop.alias("pop"), F.col("pop").isNull().alias("pop_missing"), pop_source.alias("pop_source"), "site", "elev_m", "plate")
    mean = lambda keys, name: known.groupBy(*keys).agg(F.avg("elev_m").alias(name))
    known = known.join(mean(["site"], "site_elev"), "site", "left").join(mean(["pop"], "pop_elev"), "pop", "left").join(F.broadcast(mean([], "any_elev")), how="left")
    elev, elev_source = _filled(F.col("elev_m"), F.col("elev_m").isNull(), [(F.col("site_elev"), "site"), (F.col("pop_elev"), "pop"), (F.col("any_elev"), "all")])
    return known.select("sample", "pop", "site", elev.alias("elev_m"), "plate", "pop_missing", "pop_source", F.col("elev_m").isNull().alias("elev_missing"), elev_source.alias("elev_source"))


#: a cell as one number while it is shuffled, from the highest bits down: how many of its three values are present, both alleles in
#: order, each allele, the base's letter and the depth; values are raised by one, so that 0 is a null
_PACKED = {"call": 5, "a0": 3, "a1": 3, "base": 7, "depth": 32}
_NO_SITE = -(1 << 63)


def _best_version(genos: DataFrame) -> DataFrame:
    """``snp_id, sample, v``, one row a cell: illegal values as null, and of several versions the one with most present values
    (then the largest). A null site is a site of its own."""
    legal = F.col("a0").between(0, 3) & F.col("a1").between(0, 3)
    values = {
        "call": F.when(legal, F.least("a0", "a1") * 4 + F.greatest("a0", "a1")), "a0": F.when(legal, F.col("a0")), "a1": F.when(legal, F.col("a1")),
        "base": F.when(F.col("base").rlike(f"^[{BASES}]$"), F.ascii("base")), "depth": F.when(F.col("depth") >= 0, F.col("depth")),
    }
    version = sum((values[c].isNotNull().cast("bigint") for c in ("call", "base", "depth")), F.lit(0).cast("bigint"))
    for c, bits in _PACKED.items():
        version = F.shiftleft(version, bits) + F.coalesce(values[c].cast("bigint") + 1, F.lit(0).cast("bigint"))
    return genos.groupBy(F.coalesce("snp_id", F.lit(_NO_SITE)).alias("snp_id"), "sample").agg(F.max(version).alias("v"))


def _unpacked(v: Column) -> dict[str, Column]:
    """The values of a packed cell by name."""
    out, low = {}, 0
    for c, bits in reversed(_PACKED.items()):
        out[c] = (F.nullif(F.shiftright(v, low).bitwiseAND((1 << bits) - 1), F.lit(0).cast("bigint")) - 1).cast("int")
        low += bits
    return out | {"base": F.char(out["base"])}


#: columns of which one may determine another within a site, and alone; the letters name the statistics below
_CODES = {"pop": "p", "call": "c", "base": "b"}


def _site_statistics(laid: DataFrame) -> DataFrame:
    """``snp_id, kind, key, value, support, one``: for each site the most frequent call and base (the smallest of ties) and the
    lower median depth, of all samples (key ``''``) and for each population, call and base. ``kind`` is the letter of the key's
    column and that of the value's; ``one`` says whether all supporting rows agree.

    ``laid`` is laid out by site, so nothing here is shuffled; a site's rows are the samples of the study. (Both counts read
    the same columns without a filter, so that the layout is made once. Cells without a sample support nothing.)"""
    cell = lambda kind, key, value: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), value.cast("int").alias("value"))
    value, own = {"call": F.col("call"), "base": F.ascii("base")}, _unpacked(F.col("v"))
    counted = laid.groupBy("snp_id", "pop", own["call"].alias("call"), own["base"].alias("base")).agg(F.count("sample").alias("n"))
    pairs = [cell(f"s{_CODES[v]}", F.lit(""), value[v]) for v in value] + [cell(f"{_CODES[u]}{_CODES[v]}", F.col(u), value[v]) for v in value for u in _CODES if u != v]
    depths = laid.groupBy("snp_id", "pop", own["depth"].alias("depth")).agg(F.count("sample").alias("n"))
    spread = lambda df, cells: df.select("snp_id", F.explode(F.array(*cells)).alias("x"), "n").select("snp_id", "x.*", "n").where("key is not null and value is not null and n > 0")
    facts = spread(counted, pairs).groupBy("snp_id", "kind", "key", "value").agg(F.sum("n").alias("n"))
    modes = facts.groupBy("snp_id", "kind", "key").agg(F.min(F.struct((-F.col("n")).alias("n"), "value"))["value"].alias("value"), F.sum("n").alias("support"), (F.count(F.lit(1)) == 1).alias("one"))
    by_depth = spread(depths, [cell("sd", F.lit(""), F.col("depth")), cell("pd", F.col("pop"), F.col("depth"))]).groupBy("snp_id", "kind", "key", "value").agg(F.sum("n").alias("n"))
    sorted_ = by_depth.groupBy("snp_id", "kind", "key").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("v"), F.sum("n").alias("support"))  # different depths of a site
    start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(None).cast("int").alias("value"))
    half = lambda s, x: F.struct((s["upto"] + x["n"]).alias("upto"), F.coalesce(s["value"], F.when((s["upto"] + x["n"]) * 2 >= F.col("support"), x["value"])).alias("value"))
    medians = sorted_.select("snp_id", "kind", "key", F.aggregate("v", start, half, lambda s: s["value"]).alias("value"), "support", F.lit(False).alias("one"))
    return modes.unionByName(medians)


def _dependency(together: Sequence, determinant: str, dependent: str) -> tuple[float, dict]:
    """The share of violations and the dictionary of a dependency, from counted rows ``(determinant, dependent, n)``."""
    seen: dict = {}
    for r in together:
        if r[determinant] is not None and r[dependent] is not None:
            own = seen.setdefault(r[determinant], {})
            own[r[dependent]] = own.get(r[dependent], 0) + r["n"]
    supported = {k: v for k, v in seen.items() if sum(v.values()) > 1}
    total = sum(sum(v.values()) for v in supported.values())
    violating = sum(sum(v.values()) for v in supported.values() if len(v) > 1)
    return (violating / total if total else 1.0), {k: next(iter(v)) for k, v in seen.items() if len(v) == 1}


def _site_maps(stats: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """``snp_id, m`` and the numbers of supporting and violating cells of each of ``kinds``. ``m`` has the value of each
    ``kind`` and key and, under ``kind!``, once more if it has no exception."""
    named = lambda mark: F.struct(F.concat("kind", F.lit(mark), "key").alias("k"), F.col("value").alias("v"))
    entries = F.concat(F.collect_list(named("")), F.collect_list(F.when(F.col("one"), named("!"))))
    repeated = F.when(F.col("support") > 1, F.col("support")).otherwise(0)
    counts = [F.sum(F.when(F.col("kind") == k, repeated).otherwise(0)).alias(f"supporting_{k}") for k in kinds]
    counts += [F.sum(F.when((F.col("kind") == k) & ~F.col("one"), repeated).otherwise(0)).alias(f"violating_{k}") for k in kinds]
    return stats.groupBy("snp_id").agg(F.map_from_entries(entries).alias("m"), *counts)  # populations, calls and bases of a site


def fill_genotypes(genos: DataFrame, sites: DataFrame, imap: DataFrame, max_violations: float = 0.02) -> DataFrame:
    """``snp_id, sample, a0, a1, base, depth`` with ``geno_missing,
    geno_source, base_missing, base_source, depth_missing, depth_source``, one
    row for each (``snp_id``, ``sample``).

    Every categorical column (population, genotype, base), alone and with the site, is a candidate determinant of genotype and of base.
    Verified ones fill first; then both are filled by the most frequent value among
    the same site and population, the site, and the locus (bases only of the site and
    population or the site), and at last the first allele. Depth is filled by
    the median of the site and population, of the site, of the sample and
    of all. Repeated rows come out once; where versions of a cell differ, the
    one with most present values is kept.

    Versions of a cell are combined before a first shuffle, then cells are laid out by site once; a site's statistics and cells
    make one row, so nothing else but small tables is shuffled."""
    spark = genos.sparkSession
    people = cut(fill_population_map(imap).groupBy("sample").agg(F.min("pop").alias("pop")))
    place = sites.where("snp_id is not null").groupBy("snp_id").agg(F.min("locus").alias("locus"))
    laid = _best_version(genos).join(people, "sample", "left").repartition(python_tasks(spark), "snp_id")
    cells = laid.groupBy("snp_id").agg(F.collect_list(F.struct("sample", "pop", "v")).alias("cells"))  # the samples of the study
    candidates = [(u, v) for u, v in permutations(_CODES, 2) if v in ("call", "base")]
    kinds = {f"{_CODES[u]}{_CODES[v]}": (u, v) for u, v in candidates}
    blocks = cut(cells.join(_site_maps(_site_statistics(laid), list(kinds)), "snp_id", "left").join(place, "snp_id", "left"))
    # how many supported cells contradict each dependency inside sites, and over all sites together
    inside = blocks.agg(*[(F.sum(f"violating_{k}") / F.sum(f"supporting_{k}")).alias(k) for k in kinds]).first().asDict()
    clean = blocks.select("snp_id", "locus", "m", F.explode("cells").alias("x")).select("snp_id", "locus", "m", "x.sample", "x.pop", *[v.alias(c) for c, v in _unpacked(F.col("x.v")).items()])
    sources: dict[str, list] = {"call": [], "base": []}
    found = lambda kind, key: F.col("m")[F.concat(F.lit(kind), key)]
    as_value = {"call": lambda c: c, "base": lambda c: F.char(c)}
    label = lambda c: "genotype" if c == "call" else c
    verified = lambda share: share is not None and share <= max_violations
    for kind, (u, v) in sorted((k for k in kinds.items() if verified(inside[k[0]])), key=lambda k: inside[k[0]]):
        # only a value without exceptions is an entry of the dictionary
        sources[v].append((as_value[v](found(f"{kind}!", F.col(u).cast("string"))), f"dependency snp_id+{label(u)} -> {label(v)}"))
    together = clean.groupBy("pop", "call", "base").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 13 x 17 x 11 rows of legal values
    for u, v in candidates:
        share, dictionary = _dependency(together, u, v)
        if verified(share) and dictionary:
            sources[v].append((F.create_map(*[F.lit(x) for pair in sorted(dictionary.items()) for x in pair])[F.col(u)], f"dependency {label(u)} -> {label(v)}"))
    for v, c in (("call", "c"), ("base", "b")):
        sources[v] += [(as_value[v](found(f"p{c}", F.col("pop"))), "site and population"), (as_value[v](found(f"s{c}", F.lit(""))), "site")]
    depth_sources = [(found("pd", F.col("pop")), "site and population"), (found("sd", F.lit("")), "site")]
    # what the site tells is decided in its row; only what is still missing asks wider groups
    near = {v: _filled(F.col(v), F.col(v).isNull(), s) for v, s in {**sources, "depth": depth_sources}.items()}
    rows = clean.select("snp_id", "sample", "locus", "a0", "a1", *[F.col(v).isNull().alias(f"{v}_missing") for v in near], *[x.alias(f"{v}_{n}") for v, pair in near.items() for n, x in zip(("near", "source"), pair)])
    rows = rows.join(group_mode(clean, ["locus"], "call", "locus_call"), "locus", "left").join(group_median(clean, ["sample"], "depth", "sample_depth"), "sample", "left")
    rows = rows.join(F.broadcast(group_median(clean, [], "depth", "any_depth")), how="left")  # one row
    bases: dict[str, int] = {}
    for r in together:
        if r["base"] is not None:
            bases[r["base"]] = bases.get(r["base"], 0) + r["n"]
    any_base = F.lit(min(bases, key=lambda b: (-bases[b], b)) if bases else None).cast("string")
    wide = {"call": [(F.col("locus_call"), "locus"), (F.lit(0), "first allele")], "base": [(any_base, "all")], "depth": [(F.col("sample_depth"), "sample"), (F.col("any_depth"), "all")]}
    made = {}
    for v, more in wide.items():
        value, origin = _filled(F.col(f"{v}_near"), F.col(f"{v}_missing"), more)
        made[v] = value, F.when(F.col(f"{v}_source") == "unfilled", origin).otherwise(F.col(f"{v}_source"))
    call, base, depth = made["call"][0], made["base"][0], made["depth"][0]
    return rows.select(
        F.nullif("snp_id", F.lit(_NO_SITE)).alias("snp_id"),
        "sample",
        F.coalesce("a0", F.floor(call / 4)).cast("int").alias("a0"),
        F.coalesce("a1", F.pmod(call, F.lit(4))).cast("int").alias("a1"),
        base.alias("base"),
        depth.cast("int").alias("depth"),
        F.col("call_missing").alias("geno_missing"),
        made["call"][1].alias("geno_source"),
        "base_missing",
        made["base"][1].alias("base_source"),
        "depth_missing",
        made["depth"][1].alias("depth_source"),
    )


def filled_cells(genotypes: DataFrame, population_map: DataFrame) -> DataFrame:
    """``metric, snp_id, sample, value, source``: each cell that was missing and has a value now, with where it came from. A
    cell that nothing could fill (a table without a single known value of its column) is not among them."""
    cell = lambda metric, value, source: F.struct(F.lit(metric).alias("metric"), value.cast("string").alias("value"), F.col(source).alias("source"))
    g = genotypes.select("snp_id", "sample", F.explode(F.array(cell("geno", F.concat_ws("/", "a0", "a1"), "geno_source"), cell("base", F.col("base"), "base_source"), cell("depth", F.col("depth"), "depth_source"))).alias("x"))
    p = population_map.select(F.lit(0).cast("bigint").alias("snp_id"), "sample", F.explode(F.array(cell("pop", F.col("pop"), "pop_source"), cell("elev_m", F.col("elev_m"), "elev_source"))).alias("x"))
    return g.unionByName(p).select("x.metric", "snp_id", "sample", "x.value", "x.source").where("source is not null and source <> 'unfilled' and value is not null")
