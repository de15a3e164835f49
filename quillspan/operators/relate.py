"""Facts into relations: blocking, dimension differences, value comparison, learned dimension power, verdicts, confidence and salience.

Facts: id, doc_id, kind, metric, metric_key, subject_key, value, lo, hi, unit, state, dims map<string,string>, confidence.
Everything is a join on the block's key, narrow expressions, and one small aggregate (the power of each dimension).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..sources import shared

BLOCK_CAP = 400
ABSTAIN = 0.60
UNKNOWN_POWER = 0.5
# Dimensions that say where a fact stands and not what it is about; weights of verdicts.
PROVENANCE = ("source", "source_table", "table", "note", "page", "document")
BASE = {"contradicts": 1.0, "needs_review": 0.85, "reconciled": 0.72, "corroborates": 0.55, "related": 0.3}
# Qualifiers that only repeat a unit.
UNIT_ECHO = ("currency", "scale", "unit", "units", "denomination", "magnitude")

_MAP = "map<string,string>"


def merge_qualifiers(defaults: Column, own: Column, canonical_unit: Column) -> Column:
    """A document's qualifiers under the fact's own (nulls dropped), without echoes of a known unit."""
    kept = F.map_filter(F.coalesce(own, F.create_map().cast(_MAP)), lambda _, v: v.isNotNull())
    rest = F.map_filter(F.coalesce(defaults, F.create_map().cast(_MAP)), lambda k, _: ~F.array_contains(F.map_keys(kept), k))
    return F.map_filter(F.map_concat(rest, kept), lambda k, _: canonical_unit.isNull() | ~k.isin(*UNIT_ECHO))


def dimensions(period_key: Column, subject: Column, qualifiers: Column) -> Column:
    """What tells a fact from others of its metric: period, subject, qualifiers; empty ones dropped."""
    lower = F.transform_values(F.transform_keys(F.coalesce(qualifiers, F.create_map().cast(_MAP)), lambda k, _: F.lower(F.trim(k))), lambda _, v: F.lower(F.trim(v)))
    fixed = F.create_map(F.lit("period"), period_key, F.lit("subject"), subject)
    fixed = F.map_filter(fixed, lambda _, v: F.coalesce(v, F.lit("")) != "")
    return F.map_filter(F.map_concat(fixed, F.map_filter(lower, lambda k, _: ~F.array_contains(F.map_keys(fixed), k))), lambda _, v: F.coalesce(v, F.lit("")) != "")


def compare_dimensions(a: Column, b: Column) -> Column:
    """struct(agree, conflict, unspecified) of sorted names."""
    both = F.map_entries(F.map_zip_with(a, b, lambda _, x, y: F.when(x.isNull() | y.isNull(), "u").when(x == y, "a").otherwise("c")))
    named = lambda e, how: F.sort_array(F.transform(F.filter(e, lambda x: x["value"] == how), lambda x: x["key"]))
    return F.get(F.transform(F.array(both), lambda e: F.struct(named(e, "a").alias("agree"), named(e, "c").alias("conflict"), named(e, "u").alias("unspecified"))), F.lit(0))


def first_of_blocks(facts: DataFrame, key: str = "metric_key", cap: int | None = BLOCK_CAP) -> DataFrame:
    """Each key's first `cap` facts by id. Spark cuts every task's part of a key before the exchange, so a key with a third of all facts sends few of them."""
    if cap is None:
        return facts
    return facts.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy("id"))).filter(F.col("__n") <= cap).drop("__n")


def _dealt(facts: DataFrame, key: str) -> DataFrame:
    """By key over as many partitions as the session shuffles to: left to themselves they would be merged by the facts' few bytes, and their pairs cost far more."""
    return facts.repartition(int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def block_pairs(facts: DataFrame, key: str = "metric_key", cap: int | None = BLOCK_CAP) -> DataFrame:
    """(l, r) structs of all pairs within a key, l.id < r.id, among each key's first `cap` facts by id. Without a cap a hot key's join is one that Spark splits."""
    facts = first_of_blocks(facts, key, cap)
    if cap is not None:
        facts = _dealt(facts, key)
    one = facts.select(F.col(key).alias("k"), F.struct("*").alias("l"))
    two = facts.select(F.col(key).alias("k"), F.struct("*").alias("r"))
    return one.join(two, "k").filter("l.id < r.id").select("l", "r")


def linked_pairs(facts: DataFrame, links: DataFrame, cap: int | None = None) -> DataFrame:
    """(l, r, and links' other columns) over links (key_a, key_b, ...) between different keys; with a cap, of each key's first facts by id."""
    facts = first_of_blocks(facts, cap=cap)
    a, b = facts.select(F.col("metric_key").alias("key_a"), F.struct("*").alias("x")), facts.select(F.col("metric_key").alias("key_b"), F.struct("*").alias("y"))
    pairs = links.join(a, "key_a").join(b, "key_b")
    first = F.col("x.id") < F.col("y.id")
    return pairs.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("l"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("r"), *[c for c in links.columns if c not in ("key_a", "key_b")])


_MATCH = "struct<source:string,lexical:double,semantic:double>"


def candidate_pairs(facts: DataFrame, verdicts: DataFrame | None = None, cap: int | None = BLOCK_CAP) -> DataFrame:
    """(l, r, match) of the facts of one metric: one key, or two keys that verdicts (key_a, key_b, lexical, semantic, same, source) call the same. match says how that is known."""
    exact = F.struct(F.lit("exact").alias("source"), F.lit(None).cast("double").alias("lexical"), F.lit(None).cast("double").alias("semantic")).cast(_MATCH)
    within = block_pairs(facts, cap=cap).withColumn("match", exact)
    if verdicts is None:
        return within
    same = verdicts.filter("same AND key_a <> key_b").select("key_a", "key_b", F.struct("source", F.col("lexical").cast("double").alias("lexical"), F.col("semantic").cast("double").alias("semantic")).cast(_MATCH).alias("match"))
    return within.unionByName(linked_pairs(facts, same, cap))


def new_pairs(old: DataFrame, new: DataFrame, key: str = "metric_key") -> DataFrame:
    """(l, r) of the pairs that touch a new fact; pairs of old facts are not generated."""
    old, new = old.withColumn("fresh", F.lit(False)), new.withColumn("fresh", F.lit(True))
    every = old.unionByName(new)
    a = new.select(F.col(key).alias("k"), F.struct("*").alias("x"))
    b = every.select(F.col(key).alias("k"), F.struct("*").alias("y"))
    first = F.col("x.id") < F.col("y.id")
    # A pair of two new facts comes from both sides; it is kept from its smaller one.
    pairs = a.join(b, "k").filter((F.col("x.id") != F.col("y.id")) & ~(F.col("y.fresh") & ~first))
    return pairs.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("l"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("r"))


def evaluate(pairs: DataFrame) -> DataFrame:
    """Comparable pairs with agrees, gap, separation, dims (without provenance among conflicts) and cross_document."""
    f = F.col
    numeric = (f("l.kind") == "numeric") & (f("r.kind") == "numeric")
    family = numbers.unit_family(f("l.unit")) == numbers.unit_family(f("r.unit"))
    overlap = numbers.intervals_overlap(f("l.lo"), f("l.hi"), f("r.lo"), f("r.hi"))
    states = (f("l.kind") == "semantic") & (f("r.kind") == "semantic") & (F.coalesce(f("l.state"), F.lit("")) != "") & (F.coalesce(f("r.state"), F.lit("")) != "")
    agrees = F.when(numeric & family, overlap).when(states, F.lower(F.trim(f("l.state"))) == F.lower(F.trim(f("r.state"))))
    about = lambda names: F.filter(names, lambda x: ~x.isin(*PROVENANCE))
    dims = F.get(F.transform(F.array(compare_dimensions(f("l.dims"), f("r.dims"))), lambda d: F.struct(d["agree"].alias("agree"), about(d["conflict"]).alias("conflict"), about(d["unspecified"]).alias("unspecified"))), F.lit(0))
    if "match" not in pairs.columns:
        pairs = pairs.withColumn("match", F.struct(F.lit("exact").alias("source"), F.lit(None).cast("double").alias("lexical"), F.lit(None).cast("double").alias("semantic")).cast(_MATCH))
    found = pairs.withColumn("agrees", agrees).filter(f("agrees").isNotNull())
    return found.select(
        "*", F.when(numeric, numbers.relative_gap(f("l.value"), f("r.value"))).alias("gap"), F.when(numeric, numbers.separation(f("l.value"), f("l.lo"), f("l.hi"), f("r.value"), f("r.lo"), f("r.hi"))).alias("separation"),
        dims.alias("dims"), (f("l.doc_id") != f("r.doc_id")).alias("cross_document"), text.relation_id(f("l.id"), f("r.id")).alias("id"),
    )


def dimension_stats(evaluated: DataFrame) -> DataFrame:
    """(dim, n_pairs, n_differs, power) over pairs with exactly one conflict; power is smoothed towards one half."""
    one = evaluated.filter(F.size("dims.conflict") == 1).groupBy(F.get("dims.conflict", F.lit(0)).alias("dim"))
    return one.agg(F.count("*").alias("n_pairs"), F.count_if(~F.col("agrees")).alias("n_differs")).withColumn("power", (F.col("n_differs") + 2) / (F.col("n_pairs") + 4))


def _ranked(names: Column, power: Column) -> Column:
    """Names by power, the greatest first; ties in alphabetical order."""
    scored = F.transform(names, lambda d: F.struct((-F.coalesce(F.try_element_at(power, d), F.lit(UNKNOWN_POWER))).alias("p"), d.alias("d")))
    return F.transform(F.array_sort(scored), lambda x: x["d"])


def judge(evaluated: DataFrame, stats: DataFrame) -> DataFrame:
    """evaluated with verdict, explained_by, review_reason, power, confidence and salience.

    stats has one row per dimension that facts name; as one map of that size it travels to every task.
    """
    table = stats.agg(F.map_from_entries(F.collect_list(F.struct("dim", "power"))).alias("__power"), F.map_from_entries(F.collect_list(F.struct("dim", "n_pairs"))).alias("__pairs"))
    e = evaluated.join(F.broadcast(table), F.lit(True))
    e = e.withColumns({"by": _ranked(F.col("dims.conflict"), F.col("__power")), "open": _ranked(F.col("dims.unspecified"), F.col("__power"))})
    power_of = lambda d: F.coalesce(F.try_element_at(F.col("__power"), d), F.lit(UNKNOWN_POWER))
    e = e.withColumn("risky", F.filter("open", lambda d: power_of(d) >= ABSTAIN))
    n_conflict = F.size("dims.conflict")
    verdict = (
        F.when(F.col("agrees") & (n_conflict == 0), "corroborates").when(F.col("agrees"), "related").when((n_conflict == 0) & (F.size("risky") > 0), "needs_review").when(n_conflict == 0, "contradicts").otherwise("reconciled")
    )
    top = F.get("by", F.lit(0))
    e = e.withColumns({"verdict": verdict, "explained_by": F.when(verdict == "reconciled", top), "review_reason": F.when(verdict == "needs_review", F.concat(F.get("risky", F.lit(0)), F.lit("_unknown_on_one_side")))})
    e = e.withColumns({"power": F.when(F.col("explained_by").isNotNull(), power_of(F.col("explained_by"))), "observations": F.when(F.col("explained_by").isNotNull(), F.coalesce(F.try_element_at("__pairs", F.col("explained_by")), F.lit(0)))})
    e = e.withColumn("review_power", F.when(F.col("verdict") == "needs_review", power_of(F.get("risky", F.lit(0)))))
    e = e.withColumn("confidence", confidence())
    return e.withColumn("salience", salience()).drop("__power", "__pairs", "by", "open")


def confidence() -> Column:
    v, n_open, n_conflict = F.col("verdict"), F.size("dims.unspecified"), F.size("dims.conflict")
    c = F.least("l.confidence", "r.confidence") * F.when(F.col("match.source") == "llm", 0.9).when(F.col("match.source").isin("blocked", "unresolved"), 0.6).otherwise(1.0)
    c = F.when((v == "contradicts") & (n_open > 0), c * F.greatest(F.lit(0.45), 1 - 0.18 * n_open)).otherwise(c)
    c = F.when(v == "reconciled", c * (0.5 + 0.5 * F.col("power")) * F.when(n_conflict > 1, 0.85).otherwise(1.0)).otherwise(c)
    c = F.when(v == "needs_review", F.least(F.lit(0.9), c * 0.95)).otherwise(c)
    c = F.when((v == "contradicts") & (F.col("separation") < 1.5), c * 0.8).otherwise(c)
    return F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.05), c)), 3)


def salience() -> Column:
    base = F.lit(0.0)
    for verdict, weight in BASE.items():
        base = F.when(F.col("verdict") == verdict, weight).otherwise(base)
    s = base * (0.45 + 0.55 * F.col("confidence")) * F.when(F.col("cross_document"), 1.5).otherwise(1.0)
    return F.round(s * F.when((F.col("verdict") == "reconciled") & (F.size("dims.conflict") > 1), 0.8).otherwise(1.0), 4)


def explanation() -> Column:
    """Why a relation has its verdict, in sentences made of its own fields.

    As one stage of generated code the sentences are a method that Java no longer compiles (over 8,000 bytes), four times slower. Spark leaves a projection
    with a lambda, as in `others`, out of such stages and cuts its code into small methods.
    """
    dim = F.col("explained_by")
    others = F.filter("dims.conflict", lambda d: d != dim)
    at = lambda side, d: F.try_element_at(F.col(f"{side}.dims"), d)
    named = lambda names: F.array_join(names, ", ")
    metric = F.when(F.col("l.metric") == F.col("r.metric"), F.col("l.metric")).otherwise(F.concat("l.metric", F.lit(" / "), "r.metric"))
    asked = F.when(F.col("match.source") == "llm", " (the same by a model's answer)").otherwise("")
    shown = lambda side: F.concat(numbers.display(F.col(f"{side}.value")), F.lit(" "), F.coalesce(F.col(f"{side}.unit"), F.lit("")), F.lit(" (range "), numbers.display_interval(F.col(f"{side}.lo"), F.col(f"{side}.hi")), F.lit(")"))
    share = F.concat(numbers.display(F.col("gap") * 100), F.lit("%"))
    overlap = F.concat(F.lit("; the ranges overlap, so the gap of "), share, F.lit(" is rounding."))
    apart = F.concat(F.lit("; the ranges are disjoint"), numbers.display_separation(F.col("separation")), F.lit(", so the gap of "), share, F.lit(" is real."))
    sentences = [
        F.concat(F.lit("Both report "), metric, asked, F.lit(".")),
        F.when(F.size("dims.agree") > 0, F.concat(F.lit("They agree on "), named(F.col("dims.agree")), F.lit("."))),
        F.when(F.col("l.kind") == "numeric", F.concat(F.lit("One states "), shown("l"), F.lit(", the other "), shown("r"), F.when(F.col("agrees"), overlap).otherwise(apart))),
        F.when(F.col("l.kind") == "semantic", F.concat(F.lit("One says "), "l.state", F.lit(", the other "), "r.state", F.lit("."))),
        F.when(dim.isNotNull(), F.concat(F.lit("They differ in "), dim, F.lit(" ("), at("l", dim), F.lit(" and "), at("r", dim), F.lit("), which explains the gap."))),
        F.when(dim.isNotNull() & (F.col("observations") >= 5), F.concat(dim, F.lit(" alone comes with a change of value in "), F.format_string("%.0f", F.col("power") * 100), F.lit("% of "), F.col("observations").cast("string"), F.lit(" pairs."))),
        F.when(dim.isNotNull() & (F.col("observations") < 5), F.concat(F.lit("Only "), F.col("observations").cast("string"), F.lit(" pairs tell how far "), dim, F.lit(" moves values."))),
        F.when(dim.isNotNull() & (F.size("dims.conflict") > 1), F.concat(F.lit("They also differ in "), named(others), F.lit("."))),
        F.when((F.col("verdict") == "contradicts") & (F.size("dims.unspecified") == 0), "Nothing recorded tells them apart."),
        F.when((F.col("verdict") == "contradicts") & (F.size("dims.unspecified") > 0), F.concat(F.lit("Nothing recorded tells them apart, though only one gives "), named(F.col("dims.unspecified")), F.lit("."))),
        F.when(F.col("verdict") == "needs_review", F.concat(F.lit("Nothing recorded tells them apart, but only one gives "), F.get("risky", F.lit(0)), F.lit(", which usually moves values, so the case is left for review."))),
        F.when(F.col("verdict") == "related", F.concat(F.lit("The values meet, but "), named(F.col("dims.conflict")), F.lit(" differs: two claims that share a number."))),
    ]
    return F.concat_ws(" ", *sentences)


def _brief(side: str) -> Column:
    f = lambda name: F.col(f"{side}.{name}")
    return F.struct(f("id").alias("id"), f("metric").alias("metric"), f("doc_id").cast("string").alias("doc_id"), f("page").alias("page"), f("value").alias("value"), f("lo").alias("lo"), f("hi").alias("hi"), f("unit").alias("unit"), f("state").alias("state"), f("dims").alias("dims"))


def reasoning() -> Column:
    """A judged pair's whole record: how the metrics were matched, the values, the dimensions, what was learned of them, and both facts."""
    label = F.when(F.col("l.metric") == F.col("r.metric"), F.col("l.metric")).otherwise(F.concat("l.metric", F.lit(" / "), "r.metric"))
    mode = F.when(F.col("l.kind") == "numeric", "interval").otherwise("state")
    values = F.struct(mode.alias("mode"), F.col("agrees").alias("agree"), F.col("gap").alias("relative_gap"), F.col("separation").alias("separation"))
    return F.struct(
        "review_reason", F.col("risky").alias("unspecified_risky"), F.round("review_power", 3).alias("review_power"), F.col("observations").alias("explanatory_observations"), F.col("match").alias("metric_match"), label.alias("metric_label"),
        values.alias("values"), F.col("dims").alias("dimensions"), "explained_by", F.round("power", 3).alias("explanatory_power"), _brief("l").alias("left"), _brief("r").alias("right"),
    )


def relations(facts: DataFrame, verdicts: DataFrame | None = None, cap: int | None = BLOCK_CAP) -> DataFrame:
    """All relations of the facts, within a metric's name and across names that verdicts call the same. Pairs are evaluated once and written; statistics and verdicts read them."""
    found = shared.written(evaluate(candidate_pairs(facts, verdicts, cap)), "evaluated")
    return judge(found, dimension_stats(found))
