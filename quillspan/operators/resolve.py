"""Which differently worded metrics are the same: links between keys, and the decision list over them. A model's answers are a table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text

LEXICAL_SURE, LEXICAL_LEAST, SEMANTIC_LEAST = 95.0, 80.0, 0.70
LEXICAL_NEIGHBOURS, SEMANTIC_NEIGHBOURS = 12, 16
SUBJECT_LIKE_METRIC = 85.0
KEY_BLOCKS = 16
VECTOR_BLOCK = 2000


def lexical_links(facts: DataFrame, least: float = LEXICAL_LEAST, k: int = LEXICAL_NEIGHBOURS) -> DataFrame:
    """(key_a, key_b, score) of each key's nearest others by token-sort ratio, key_a < key_b.

    All distinct keys are compared, block with block. Pairs are scored unless their lengths or the characters that they have in common,
    each counted as often as in both, already put the ratio below least; a common subsequence is no longer than either, so none is lost.
    """
    keys = facts.select(F.col("metric_key").alias("key")).filter("key <> ''").distinct().withColumn("form", text.sorted_words("key"))
    c = lambda i: F.substring("form", i, F.lit(1))
    nth = lambda i: F.length(F.substring("form", F.lit(1), i)) - F.length(F.replace(F.substring("form", F.lit(1), i), c(i)))
    chars = F.when(F.length("form") > 0, F.transform(F.sequence(F.lit(1), F.length("form")), lambda i: F.concat(c(i), nth(i).cast("string")))).otherwise(F.array().cast("array<string>"))
    keys = keys.select("key", F.length("form").alias("n"), chars.alias("chars"), F.pmod(F.xxhash64("key"), F.lit(KEY_BLOCKS)).cast("int").alias("block"))
    others = F.sequence(F.lit(0), F.lit(KEY_BLOCKS - 1))
    meeting = lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j"))
    dealt = keys.select("*", F.explode(F.transform(others, meeting)).alias("cell")).repartition(int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell")
    a, b = (dealt.select("cell", *[F.col(x).alias(f"{x}_{side}") for x in ("key", "n", "chars", "block")]) for side in "ab")
    # The keys of one block meet in its own cell only; those of two blocks in the cell of both.
    once = F.when(F.col("block_a") == F.col("block_b"), F.col("cell.i") == F.col("cell.j")).otherwise(True)
    both = F.col("n_a") + F.col("n_b")
    may = lambda common: (both == 0) | (F.lit(200.0) * common / F.greatest(both, F.lit(1)) >= least)
    near = a.join(b, "cell").filter((F.col("key_a") < F.col("key_b")) & once & may(F.least("n_a", "n_b")))
    near = near.filter(may(F.size(F.array_intersect("chars_a", "chars_b"))))
    scored = near.select("key_a", "key_b", text.token_sort_ratio("key_a", "key_b").alias("score")).filter(F.col("score") >= least)
    return _top(scored, k)


def _top(scored: DataFrame, k: int) -> DataFrame:
    """Pairs among either end's k best."""
    return _merged(scored.select(F.col("key_a").alias("x"), F.col("key_b").alias("y"), "score").union(scored.select("key_b", "key_a", "score")), k)


def _merged(ends: DataFrame, k: int) -> DataFrame:
    best = ends.withColumn("__r", F.row_number().over(W.partitionBy("x").orderBy(F.desc("score"), "y"))).filter(F.col("__r") <= k)
    return best.groupBy(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).agg(F.max("score").alias("score"))


def semantic_links(vectors: DataFrame, least: float = SEMANTIC_LEAST, k: int = SEMANTIC_NEIGHBOURS, block: int = VECTOR_BLOCK) -> DataFrame:
    """(key_a, key_b, score) over (key, vector): cosine of each key's nearest others, key_a < key_b.

    Exact: the distinct keys are dealt into blocks, and each two blocks meet in one task as a product of two matrices of at most some `block` rows.
    A task keeps each key's k best of its block pair, so what is shuffled after it grows with the keys and the blocks, not with the pairs.
    """
    given = vectors.filter("key IS NOT NULL AND vector IS NOT NULL").groupBy("key").agg(F.min("vector").alias("vector"))
    n_blocks = max(1, -(-given.count() // block))
    dealt = given.select("key", F.transform("vector", lambda x: x.cast("double")).alias("vector"), F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int").alias("block"))
    others = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    met = dealt.select("key", "vector", "block", F.explode(F.transform(others, lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j")))).alias("cell")).select("key", "vector", "block", "cell.i", "cell.j")
    kind = dict(given.dtypes)["key"]

    def product(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        keys = np.array(table.column("key").to_pylist(), dtype=object)
        rows = np.array(table.column("vector").to_pylist(), dtype=np.float64)
        size = np.linalg.norm(rows, axis=1, keepdims=True)
        rows = np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)
        of = table.column("block").to_numpy()
        left, right = np.flatnonzero(of == i), np.flatnonzero(of == j)
        score = rows[left] @ rows[right].T
        near = score >= least
        if i == j:
            near &= ~np.eye(len(left), dtype=bool)
        ends, mates, scores = [], [], []
        for a, b, s, ok in ((left, right, score, near), (right, left, score.T, near.T))[: 1 if i == j else 2]:
            for r in np.flatnonzero(ok.any(axis=1)):
                those = np.flatnonzero(ok[r])
                best = sorted(zip((-s[r, those]).tolist(), keys[b[those]].tolist(), strict=True))[:k]
                ends += [keys[a[r]]] * len(best)
                mates += [m for _, m in best]
                scores += [-v for v, _ in best]
        return pa.table({"x": pa.array(ends, table.schema.field("key").type), "y": pa.array(mates, table.schema.field("key").type), "score": pa.array(scores, pa.float64())})

    best = met.groupBy("i", "j").applyInArrow(product, f"x {kind}, y {kind}, score double")
    return _merged(best, k)


def metric_links(facts: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(key_a, key_b, lexical, semantic, score) of the metric keys worth comparing: near by wording or by vector (key, vector). score is the stronger of the two, from 0 to 1."""
    near = lexical_links(facts).withColumnRenamed("score", "lexical")
    if vectors is None:
        links = near.withColumn("semantic", F.lit(None).cast("double"))
    else:
        known = facts.select(F.col("metric_key").alias("key")).distinct()
        by_vector = semantic_links(vectors.join(known, "key", "left_semi")).withColumnRenamed("score", "semantic")
        links = near.join(by_vector, ["key_a", "key_b"], "full")
        links = links.withColumn("lexical", F.coalesce("lexical", text.token_sort_ratio("key_a", "key_b")))
    strength = F.greatest(F.when(F.col("lexical") >= LEXICAL_LEAST, F.col("lexical") / 100).otherwise(0.0), F.coalesce("semantic", F.lit(0.0)))
    return links.select("key_a", "key_b", "lexical", "semantic", strength.alias("score"))


def index_metrics(facts: DataFrame, links: DataFrame) -> DataFrame:
    """One row: unique_metrics, semantic_pairs and lexical_pairs of the metric index."""
    n = facts.select(F.count_distinct("metric_key").alias("unique_metrics"))
    of = links.agg(F.count("semantic").alias("semantic_pairs"), F.count_if(F.col("lexical") >= LEXICAL_LEAST).alias("lexical_pairs"))
    return n.join(F.broadcast(of), F.lit(True))  # one row each


def same_metric(links: DataFrame, adjudications: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """links (key_a, key_b, lexical 0..100, semantic 0..1 or null) with same and source; the first rule that fits holds.

    adjudications: (key_a, key_b, same, source), keys in order, two columns, so no two pairs share an entry. Undecided pairs without one are not
    the same; with a budget, the strongest so many of them are due for a model's answer (unresolved) and the rest are budget_exhausted.
    """
    if adjudications is not None:
        said = adjudications.select("key_a", "key_b", F.col("same").alias("said"), F.coalesce("source", F.lit("cache")).alias("by"))
        links = links.join(said, ["key_a", "key_b"], "left")
    else:
        links = links.withColumns({"said": F.lit(None).cast("boolean"), "by": F.lit(None).cast("string")})
    lexical, semantic = F.col("lexical"), F.coalesce("semantic", F.lit(0.0))
    rules = [(F.col("key_a") == F.col("key_b"), F.lit(True), "exact"), (lexical >= LEXICAL_SURE, F.lit(True), "lexical_high"), ((lexical < LEXICAL_LEAST) & (semantic < SEMANTIC_LEAST), F.lit(False), "blocked")]
    same, source = F.coalesce("said", F.lit(False)), F.when(F.col("said").isNotNull(), F.col("by")).otherwise("lexical")
    for rule, answer, name in reversed(rules):
        same, source = F.when(rule, answer).otherwise(same), F.when(rule, F.lit(name)).otherwise(source)
    decided = links.select("key_a", "key_b", "lexical", "semantic", same.alias("same"), source.alias("source"))
    if budget is None:
        return decided
    strength = F.greatest(F.col("lexical") / 100, F.coalesce("semantic", F.lit(0.0)))
    due = decided.filter("source = 'lexical'").orderBy(F.desc(strength), "key_a", "key_b").limit(budget).select("key_a", "key_b", F.lit(True).alias("due"))
    asked = decided.join(due, ["key_a", "key_b"], "left")
    open_ = F.when(F.col("due"), "unresolved").otherwise("budget_exhausted")
    return asked.withColumn("source", F.when(F.col("source") == "lexical", open_).otherwise(F.col("source"))).drop("due")


def subject_guard(facts: DataFrame) -> DataFrame:
    """facts without a subject dimension where the subject only repeats the metric; scored once per distinct pair."""
    pairs = facts.select("subject_key", "metric_key").filter("subject_key <> ''").distinct()
    echo = pairs.withColumn("echo", text.token_set_ratio("subject_key", "metric_key") >= SUBJECT_LIKE_METRIC).filter("echo")
    marked = facts.join(echo, ["subject_key", "metric_key"], "left")
    return marked.withColumn("dims", F.when(F.coalesce("echo", F.lit(False)), F.map_filter("dims", lambda k, _: k != "subject")).otherwise(F.col("dims"))).drop("echo").select(*facts.columns)
