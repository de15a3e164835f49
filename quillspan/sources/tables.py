"""Sources and sinks: documents of words, keyed upserts, cached responses, lookups, and the read side over facts and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.relate import BASE

VERDICTS = tuple(BASE)
_LABEL = r"(?i)^\s*(?:page\s*)?([ivxlcdm]{1,7}|\d{1,4})\s*$"
_MARGIN = 0.12


def read_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, sha256, doc_id, corpus, n_bytes, content) of the files below a folder, in order of path; corpus is the parent folder's name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    sha = F.sha2("content", 256)
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return files.select("path", sha.alias("sha256"), F.concat(F.substring(stem, 1, 48), F.lit("-"), F.substring(sha, 1, 8)).alias("doc_id"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("corpus"), F.col("length").alias("n_bytes"), "content")


def place_words(words: Column) -> Column:
    """Words (block, line, word, text) as struct(text, places): a space between words, a new line between lines, and each word's (start, end, block, line, word) in order."""
    ordered = F.array_sort(F.transform(words, lambda w: F.struct(w["block"].alias("block"), w["line"].alias("line"), w["word"].alias("word"), w["text"].alias("text"))))

    def put(o: Column) -> Column:
        before = lambda i: F.get(o, i - 1)
        gap = lambda w, i: F.when(i == 0, "").when((before(i)["block"] == w["block"]) & (before(i)["line"] == w["line"]), " ").otherwise("\n")
        texts = F.transform(o, lambda w, i: F.concat(gap(w, i), w["text"]))
        start = F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<struct<start:int,end:int>>").alias("out"))
        step = lambda s, x: F.struct((s["at"] + x["gap"] + x["n"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["n"]).alias("end")))).alias("out"))
        spans = F.aggregate(F.transform(o, lambda w, i: F.struct(F.length(gap(w, i)).alias("gap"), F.length(w["text"]).alias("n"))), start, step, lambda s: s["out"])
        places = F.zip_with(o, spans, lambda w, p: F.struct(p["start"].alias("start"), p["end"].alias("end"), w["block"].alias("block"), w["line"].alias("line"), w["word"].alias("word")))
        return F.struct(F.array_join(texts, "").alias("text"), places.alias("places"))

    return F.get(F.transform(F.array(ordered), put), F.lit(0))


def page_labels(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, page_label): of short numeric or roman blocks near a page's top or bottom, the one nearest the edge."""
    edge = F.least(F.col("y0"), F.col("height") - F.col("y1"))
    label = F.regexp_extract(F.btrim("text", F.lit(" \t\n\r")), _LABEL, 1)
    fit = blocks.select("doc_id", "page", edge.alias("edge"), label.alias("label")).filter((F.length(F.btrim(blocks["text"], F.lit(" \t\n\r"))) <= 12) & (label != "") & (edge < _MARGIN * blocks["height"]))
    return fit.groupBy("doc_id", "page").agg(F.min(F.struct("edge", "label")).getField("label").alias("page_label"))


def span_boxes(words: Column, start: Column, end: Column) -> Column:
    """One box per line of the words (start, end, x0, y0, x1, y1) that a span touches; a word joins the first line whose first word it overlaps by more than half of the lower height."""
    line = "struct<x0:double,y0:double,x1:double,y1:double,top:double,foot:double>"
    hit = F.filter(words, lambda w: (w["start"] < end) & (w["end"] > start))
    placed = F.array_sort(F.transform(hit, lambda w: F.struct(F.round(w["y0"].cast("double"), 1).alias("row"), *[w[c].cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])))
    boxes = F.transform(placed, lambda w: F.struct(*[w[c].alias(c) for c in ("x0", "y0", "x1", "y1")], w["y0"].alias("top"), w["y1"].alias("foot")))

    def add(lines: Column, w: Column) -> Column:
        beside = lambda b: F.least(b["foot"], w["y1"]) - F.greatest(b["top"], w["y0"]) > 0.5 * F.least(b["foot"] - b["top"], w["y1"] - w["y0"])
        at = F.array_position(F.transform(lines, beside), F.lit(True))
        union = lambda b: F.struct(F.least(b["x0"], w["x0"]).alias("x0"), F.least(b["y0"], w["y0"]).alias("y0"), F.greatest(b["x1"], w["x1"]).alias("x1"), F.greatest(b["y1"], w["y1"]).alias("y1"), b["top"].alias("top"), b["foot"].alias("foot"))
        return F.when(at > 0, F.transform(lines, lambda b, i: F.when(i + 1 == at, union(b)).otherwise(b))).otherwise(F.concat(lines, F.array(w)))

    return F.aggregate(boxes, F.lit([]).cast(f"array<{line}>"), add, lambda lines: F.transform(lines, lambda b: F.struct(*[b[c].alias(c) for c in ("x0", "y0", "x1", "y1")])))


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old with new's rows in place of those with the same keys. Of new rows with one key, the one that sorts last by its other columns holds."""
    order = [F.desc(c) for c in new.columns if c not in keys and not dict(new.dtypes)[c].startswith("map")]
    last = new.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*(order or [F.lit(1)])))).filter("__r = 1").drop("__r")
    return old.join(last.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(last)


def unseen(new: DataFrame, known: DataFrame, key: str = "sha256") -> DataFrame:
    return new.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """(key, data, raw, model, provider, tag) of cached responses: one JSON file each, named by the SHA-1 of its prompt."""
    raw = spark.read.schema("data string, raw string, model string, provider string, tag string").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)
    return raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([0-9a-f]{40})\.json$", 1).alias("key"), "*")


def replay(prompts: DataFrame, cache: DataFrame, strict: bool = True) -> DataFrame:
    """prompts (prompt) with their cached data; with strict, a prompt that is not cached is an error."""
    keyed = prompts.withColumn("key", F.sha1(F.col("prompt").cast("binary"))).join(cache.select("key", "data", "model"), "key", "left")
    missing = F.raise_error(F.concat(F.lit("not cached: "), F.col("key"))).cast("string")
    return keyed.withColumn("data", F.when(F.col("data").isNull(), missing).otherwise(F.col("data"))) if strict else keyed


def json_of(said: Column) -> Column:
    """The JSON in a model's answer, as text: without code fences, else from the outermost brackets, else from the outermost braces; null if there is none."""
    bare = F.trim(F.regexp_replace(said, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    tries = [bare, F.regexp_extract(bare, r"(?s)(\[.*\])", 1), F.regexp_extract(bare, r"(?s)(\{.*\})", 1)]
    return F.coalesce(*[F.when(t.rlike(r"^\s*[\[{]") & F.try_parse_json(t).isNotNull(), t) for t in tries])


# Reads over facts and relations.


def search_facts(facts: DataFrame, q: str | None = None, *, doc_id=None, metric_key: str | None = None, period: str | None = None, limit: int = 100) -> DataFrame:
    """Facts whose metric or whole row contains q (without case), the surest first."""
    if q:
        facts = facts.filter(F.col("metric").ilike(f"%{q}%") | F.to_json(F.struct("*")).ilike(f"%{q}%"))
    for name, wanted in (("doc_id", doc_id), ("metric_key", metric_key)):
        facts = facts if wanted is None else facts.filter(F.col(name) == wanted)
    if period is not None:
        facts = facts.filter(F.try_element_at("dims", F.lit("period")) == period)
    return facts.orderBy(F.desc("confidence"), "id").limit(min(limit, 500))


def list_relations(relations: DataFrame, *, verdict: str | None = None, min_confidence: float = 0.0, cross_document: bool | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    if verdict is not None and verdict not in VERDICTS:
        raise ValueError(f"no such verdict: {verdict}")
    found = relations.filter(F.col("confidence") >= min_confidence)
    found = found if verdict is None else found.filter(F.col("verdict") == verdict)
    found = found if cross_document is None else found.filter(F.col("cross_document") == cross_document)
    return found.orderBy(F.desc("salience"), "id").offset(offset).limit(min(limit, 300))


def fact_relations(relations: DataFrame, fact_ids: DataFrame) -> DataFrame:
    """(fact_id, id) of the relations of some facts (fact_id), from either side: two joins on equality."""
    left = relations.select(F.col("left_id").alias("fact_id"), "id").join(fact_ids, "fact_id", "left_semi")
    right = relations.select(F.col("right_id").alias("fact_id"), "id").join(fact_ids, "fact_id", "left_semi")
    return left.union(right).distinct()


def summary(relations: DataFrame) -> DataFrame:
    """Relations by verdict and in all, with those across documents."""
    return relations.rollup("verdict").agg(F.count("*").alias("n"), F.count_if("cross_document").alias("n_cross"))


def confidence_histogram(relations: DataFrame) -> DataFrame:
    return relations.groupBy((F.floor(F.col("confidence") * 10) / 10).alias("bucket"), "verdict").agg(F.count("*").alias("n"))


def best_examples(relations: DataFrame) -> DataFrame:
    """The best case of each verdict among the 300 of most salience with a confidence of 0.3 or more."""
    pool = relations.filter("confidence >= 0.3").withColumn("__r", F.row_number().over(W.partitionBy("verdict").orderBy(F.desc("salience"), "id"))).filter("__r <= 300")
    quality = (
        F.col("confidence") + F.when(F.col("cross_document"), 0.6).otherwise(0.0) - 0.22 * F.size("dims.unspecified") + 0.05 * F.size("dims.agree") - 0.3 * F.greatest(F.size("dims.conflict") - 1, F.lit(0))
        + F.when(F.map_contains_key("l.dims", F.lit("period")) & F.map_contains_key("r.dims", F.lit("period")), 0.25).otherwise(0.0) + F.when(F.col("l.metric") != F.col("r.metric"), 0.2).otherwise(0.0)
        + F.when((F.coalesce("gap", F.lit(0.0)) > 0.005) & (F.col("verdict") != "corroborates"), 0.15).otherwise(0.0)
    )
    plain = (F.col("verdict") == "reconciled") & (F.col("explained_by") == "period")
    order = W.partitionBy("verdict").orderBy(F.coalesce(plain, F.lit(False)), F.desc("cross_document"), F.desc(F.round(quality, 6)), "id")
    return pool.withColumns({"quality": F.round(quality, 6), "__b": F.row_number().over(order)}).filter("__b = 1").select("verdict", "id", "quality")


def intra_document_conflicts(relations: DataFrame, limit: int = 15) -> DataFrame:
    return relations.filter("verdict = 'contradicts' AND NOT cross_document AND l.kind = 'numeric'").orderBy(F.desc("salience"), "id").limit(limit)


def same_value_two_metrics(facts: DataFrame) -> DataFrame:
    """(doc_id, page, value, metrics) of values that a page gives under several metrics."""
    found = facts.filter("value IS NOT NULL").groupBy("doc_id", "page", F.round("value", 6).alias("value")).agg(F.collect_set("metric").alias("m"))
    return found.filter(F.size("m") > 1).select("doc_id", "page", "value", F.slice(F.array_sort("m"), 1, 5).alias("metrics"))


def lookup(df: DataFrame, **wanted) -> DataFrame:
    """The rows with these values: a fact by id, a page by document and number, a document by hash. Sorted or bucketed tables are pruned by them."""
    for name, value in wanted.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def all_facts(facts: DataFrame, doc_id=None, limit: int | None = None) -> DataFrame:
    """All facts, or a document's; a limit takes the first by id."""
    found = facts if doc_id is None else facts.filter(F.col("doc_id") == F.lit(doc_id))
    return found if limit is None else found.orderBy("id").limit(limit)


def list_documents(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """documents (doc_id, corpus, filename, ...) with n_facts and place, their number in order of corpus (none first) and filename."""
    n = facts.groupBy("doc_id").agg(F.count("*").alias("n_facts"))
    listed = documents.join(n, "doc_id", "left").withColumn("n_facts", F.coalesce("n_facts", F.lit(0)))
    return listed.orderBy(F.asc_nulls_first("corpus"), "filename", "doc_id")


def fact_details(facts: DataFrame, relations: DataFrame, fact_ids: DataFrame, limit: int = 60) -> DataFrame:
    """The facts asked for (fact_id) with relations: the `limit` of most salience, as structs (id, verdict, confidence, salience)."""
    ends = relations.select(F.explode(F.array("left_id", "right_id")).alias("fact_id"), "id", "verdict", "confidence", "salience").join(fact_ids, "fact_id", "left_semi")
    best = ends.withColumn("__r", F.row_number().over(W.partitionBy("fact_id").orderBy(F.desc("salience"), "id"))).filter(F.col("__r") <= limit)
    listed = best.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("__r", "id", "verdict", "confidence", "salience"))).alias("relations"))
    shown = F.transform(F.coalesce("relations", F.array().cast(listed.schema["relations"].dataType)), lambda x: F.struct(x["id"].alias("id"), x["verdict"].alias("verdict"), x["confidence"].alias("confidence"), x["salience"].alias("salience")))
    wanted = facts.join(fact_ids.select(F.col("fact_id").alias("id")).distinct(), "id", "left_semi")
    return wanted.join(listed.withColumnRenamed("fact_id", "id"), "id", "left").withColumn("relations", shown)


def relation_details(relations: DataFrame, facts: DataFrame) -> DataFrame:
    """relations with both their facts as structs left and right (null where a fact is gone)."""
    one = facts.select(F.col("id").alias("left_id"), F.struct("*").alias("left"))
    two = facts.select(F.col("id").alias("right_id"), F.struct("*").alias("right"))
    return relations.join(one, "left_id", "left").join(two, "right_id", "left")


def evidence(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """(fact_id, doc_id, page, page_label, quote, snippet, start, end, boxes, page_text): what is needed to show a fact in its source. Pages may have words with places."""
    words = span_boxes(F.col("words"), F.col("start"), F.col("end")) if "words" in pages.columns else F.array()
    label = F.col("page_label") if "page_label" in pages.columns else F.lit(None).cast("string")
    p = pages.withColumnRenamed("text", "page_text")
    return facts.join(p, ["doc_id", "page"], "left").select(F.col("id").alias("fact_id"), "doc_id", "page", label.alias("page_label"), "quote", "snippet", "start", "end", words.alias("boxes"), F.coalesce("page_text", F.lit("")).alias("page_text"))


def relocated_facts(facts: DataFrame, limit: int = 20) -> DataFrame:
    """(fact_id, metric, claimed_page, actual_page, quote) of facts whose quote stood on another page than the one named."""
    moved = facts.filter("original_page IS NOT NULL").orderBy("id").limit(limit)
    return moved.select(F.col("id").alias("fact_id"), "metric", F.col("original_page").alias("claimed_page"), F.col("page").alias("actual_page"), F.substring("quote", 1, 100).alias("quote"))


def ranked_dimensions(stats: DataFrame, limit: int = 10) -> DataFrame:
    return stats.select("dim", "n_pairs", "n_differs", F.round("power", 3).alias("power")).orderBy(F.desc("power"), "dim").limit(limit)


def corpus_report(documents: DataFrame, extraction: DataFrame, covered: DataFrame) -> DataFrame:
    """(doc_id, pages_seen, pages_sent, n_facts, pass_rate, coverage_ratio) of each document, and of all in a row without doc_id (rates there: null)."""
    each = documents.select("doc_id").join(extraction, "doc_id", "left").join(covered, "doc_id", "left").select("doc_id", "pages_seen", "pages_sent", "n_facts", "pass_rate", "coverage_ratio")
    whole = each.agg(F.lit(None).cast(dict(each.dtypes)["doc_id"]).alias("doc_id"), *[F.sum(c).alias(c) for c in ("pages_seen", "pages_sent", "n_facts")], *[F.lit(None).cast("double").alias(c) for c in ("pass_rate", "coverage_ratio")])
    return each.unionByName(whole)


def write_report(report: DataFrame, folder: str) -> None:
    """A report as JSON lines, for other programs."""
    report.write.mode("overwrite").json(folder)
