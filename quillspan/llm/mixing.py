"""Mixing sources to target weights by hierarchical budgets.

The tree is domain, language, source. A token budget goes down from the root by the children's weights. No child gets more
than its subtree can supply (`max_epochs` times its tokens); what one child cannot use its siblings share by their
weights, and only what a whole subtree cannot use reaches the subtree's own siblings. A leaf with budget b and T tokens
contributes b // T whole epochs and, of the next, the longest prefix of its documents that fits the rest. Each epoch has
its own seeded order, by a hash of the document's id and text.

The tree is a parameter: sources and languages that it does not name are folded into "other", so the leaves that reach the
driver are bounded by the parameter whatever the table. A prefix's end is found by summing tokens per leaf and digit of the
order's hash, four digits of 10 bits, from pre-aggregated sums: no leaf, however hot, is gathered or sorted in one task.

Tokens are runs of [^space, \\t \\n \\v \\f \\r]. A null text has none, null languages and sources count as "other". Wholly repeated
rows share one place in the order and enter together, if all of them fit. Documents without tokens come with the prefix around them.
Input columns called epoch or n_tokens are replaced by the operator's.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch

OTHER = "other"
DIGIT, DIGITS = 10, 4
_LEAF = ("__domain", "__lang", "__source")


@dataclass(frozen=True)
class Tree:
    """Weights: of domains, of languages (within every domain), and each named source's domain and weight. What is not named has the weight of OTHER."""

    domains: dict[str, float]
    languages: dict[str, float]
    sources: dict[str, tuple[str, float]]
    other: float = 1.0
    weights: dict = field(default_factory=dict)

    def weight(self, path: tuple[str, ...]) -> float:
        name = path[-1]
        if len(path) == 1:
            return self.domains.get(name, self.other)
        if len(path) == 2:
            return self.languages.get(name, self.other)
        return self.sources.get(name, (OTHER, self.other))[1]


#: Production parameters for tables whose sources are src0 to src19.
TREE = Tree(
    domains={"web": 0.4, "reference": 0.3, "forum": 0.2, "press": 0.1, OTHER: 0.05},
    languages={"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15, OTHER: 0.05},
    sources={f"src{i}": (("web", "reference", "forum", "press")[i % 4], 1.0) for i in range(20)},
)
FRACTION = 0.8  # of all tokens
MAX_EPOCHS = 2
SEED = 11


def split(amount: int, weights: list[float], limits: list[int]) -> list[int]:
    """amount dealt by weights, none above its limit; whole numbers by largest remainder. amount is at most the limits' sum."""
    given = [0] * len(weights)
    active, left = [i for i, w in enumerate(weights) if limits[i] > 0], amount
    while active and left > 0:
        total = sum(max(weights[i], 1e-12) for i in active)
        full = [i for i in active if left * max(weights[i], 1e-12) / total >= limits[i]]
        if not full:
            exact = {i: left * max(weights[i], 1e-12) / total for i in active}
            for i in active:
                given[i] = int(exact[i])
            spare = left - sum(given[i] for i in active)
            for i in sorted(active, key=lambda i: (int(exact[i]) - exact[i], i)):
                more = min(max(spare, 0), 1, limits[i] - given[i])
                given[i], spare = given[i] + more, spare - more
            break
        for i in full:
            given[i] = limits[i]
            left -= limits[i]
            active.remove(i)
    return given


def budgets(supply: dict[tuple[str, str, str], int], tree: Tree, amount: int, max_epochs: int) -> dict[tuple[str, str, str], int]:
    """Tokens that each leaf is to give."""
    found: dict[tuple[str, str, str], int] = {}

    def deal(path: tuple[str, ...], amount: int) -> None:
        if len(path) == 3:
            found[path] = amount
            return
        children = sorted({leaf[: len(path) + 1] for leaf in supply if leaf[: len(path)] == path})
        limits = [max_epochs * sum(t for leaf, t in supply.items() if leaf[: len(c)] == c) for c in children]
        for child, given in zip(children, split(min(amount, sum(limits)), [tree.weight(c) for c in children], limits), strict=True):
            deal(child, given)

    deal((), amount)
    return found


def _leaf(tree: Tree, lang: Column, source: Column) -> list[Column]:
    known = F.when(source.isin(list(tree.sources)), source).otherwise(F.lit(OTHER)) if tree.sources else F.lit(OTHER)
    domain = F.lit(OTHER)
    for name in sorted({d for d, _ in tree.sources.values()}):
        domain = F.when(source.isin([s for s, (d, _) in tree.sources.items() if d == name]), F.lit(name)).otherwise(domain)
    language = F.when(lang.isin(list(tree.languages)), lang).otherwise(F.lit(OTHER))
    return [domain.alias(_LEAF[0]), language.alias(_LEAF[1]), known.alias(_LEAF[2])]


def n_tokens(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).cast("long")


def mix(df: DataFrame, tree: Tree = TREE, fraction: float = FRACTION, max_epochs: int = MAX_EPOCHS, seed: int = SEED, *, text: str = "text", id_: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """df's chosen rows, once per epoch that they are chosen in, with n_tokens long and epoch int (from 0)."""
    spark = df.sparkSession
    rows = df.select(F.struct(*[c for c in scratch.names(df)]).alias("row"), *_leaf(tree, F.col(lang), F.col(source)), F.col(id_).alias("id"), F.xxhash64(text).alias("h"), n_tokens(F.col(text)).alias("n"))
    light = scratch.keep(rows.drop("row"), "mix-light")
    supply = {(d, g, s): n for d, g, s, n in light.groupBy(*_LEAF).agg(F.sum("n")).collect()}
    given = budgets(supply, tree, int(fraction * sum(supply.values())), max_epochs)
    plan = [(*leaf, *(divmod(given[leaf], t) if t else (0, 0))) for leaf, t in supply.items()]
    schema = ", ".join(f"{c} string" for c in _LEAF) + ", full bigint, rest bigint"
    leaves = F.broadcast(spark.createDataFrame(plan, schema))
    bits = DIGIT * DIGITS
    place = F.pmod(F.xxhash64(F.lit(seed), "full", "id", "h"), F.lit(1 << bits))
    # edge: the order's hash at which each leaf's prefix ends, found digit by digit; rest: tokens still to be given within it.
    edges = spark.createDataFrame([(*p[:4], p[4], 0) for p in plan], schema + ", edge bigint")
    ordered = scratch.keep(light.join(leaves, list(_LEAF)).select(*_LEAF, place.alias("u"), "n"), "mix-order")
    for level in range(1, DIGITS + 1):
        below = bits - DIGIT * level
        inside = ordered.join(F.broadcast(edges), list(_LEAF)).filter(F.shiftright("u", below + DIGIT) == F.col("edge"))
        sums = inside.groupBy(*_LEAF, F.shiftright("u", below).alias("digit")).agg(F.sum("n").alias("n"), F.first("rest").alias("rest"), F.first("full").alias("full"))
        run = W.partitionBy(*_LEAF).orderBy("digit").rowsBetween(W.unboundedPreceding, 0)
        over = sums.withColumn("to", F.sum("n").over(run)).filter(F.col("to") > F.col("rest")).groupBy(*_LEAF).agg(F.min(F.struct("digit", "to", "n", "rest", "full")).alias("x"))
        found = {tuple(r[:3]): r.x for r in over.collect()}
        after = []
        for *leaf, full, rest, _ in map(tuple, edges.collect()):
            x = found.get(tuple(leaf))
            # Without an edge the leaf's whole epoch fits, which happens only where nothing is left to give or nothing there is.
            after.append((*leaf, full, x.rest - (x.to - x.n) if x else rest, x.digit if x else -1))
        edges = spark.createDataFrame(after, schema + ", edge bigint")
    chosen = rows.join(F.broadcast(edges), list(_LEAF)).withColumn("u", place)
    copies = F.col("full") + (F.col("u") < F.col("edge")).cast("long")
    epochs = chosen.filter(copies > 0).select("row", "n", F.explode(F.sequence(F.lit(0), (copies - 1).cast("int"))).alias("e"))
    return epochs.select(*[F.col(f"row.`{c}`") for c in df.columns if c.lower() not in ("n_tokens", "epoch")], F.col("n").alias("n_tokens"), F.col("e").alias("epoch"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "lang", "source", "n_tokens", "epoch")
