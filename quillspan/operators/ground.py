"""Pages into candidate quantities, budgets and batches; proposals into verified facts and reasons of rejection."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers, periods, text
from ..sources import shared, tables
from . import relate, resolve

MIN_PAGE, MIN_QUANTITIES, STATE_BONUS = 120, 2, 6.0
BATCH_PAGES, BATCH_CHARS = 8, 45_000
SNIPPET = 220
MISSED_SHOWN, EXAMPLES = 40, 4
PROFILE_PAGES, PROFILE_CHARS, PROFILE_BUDGET = 4, 3000, 9000
_SPACE = " \t\n\r\x0b\x0c"


def _salience(c: Column) -> tuple[Column, Column]:
    return text.salience(c["before"], c["text"], c["line"], c["number"], c["currency"], c["post"])


def candidates(pages: DataFrame) -> DataFrame:
    """(doc_id, page, start, end, text, number, currency, post, line, salience, reason) of every scanned quantity."""
    found = pages.select("doc_id", "page", F.explode(text.scan_spans("text")).alias("c"))
    level, reason = _salience(F.col("c"))
    return found.select("doc_id", "page", "c.*", level.alias("salience"), reason.alias("reason")).drop("before")


def salient(pages: DataFrame) -> DataFrame:
    return candidates(pages).filter("salience = 'high'")


def _high(spans: Column) -> Column:
    return F.filter(spans, lambda c: _salience(c)[0] == "high")


def page_scores(pages: DataFrame) -> DataFrame:
    """pages with n_salient, state_language, interesting and value, each made within its own row."""
    p = pages.withColumn("__spans", text.scan_spans("text"))
    p = p.withColumns({"n_salient": F.coalesce(F.size(_high(F.col("__spans"))), F.lit(0)).cast("bigint"), "state_language": text.has_state_language(F.col("text"))}).drop("__spans")
    gate = (F.length(F.btrim("text", F.lit(_SPACE))) >= MIN_PAGE) & (F.col("state_language") | (F.col("n_salient") >= MIN_QUANTITIES))
    base = F.col("n_salient") + F.when(F.col("state_language"), STATE_BONUS).otherwise(0.0)
    dense = F.col("n_salient") / F.greatest(F.lit(1.0), F.length("text") / 400.0) > 3
    return p.withColumns({"interesting": F.coalesce(gate, F.lit(False)), "value": base * F.when(dense, 1.25).otherwise(1.0)})


def page_budget(scored: DataFrame, k: int | None) -> DataFrame:
    """The k pages of most value per document (None: all), with place, their number in document order; ties go to the earlier page."""
    if k is not None:
        order = W.partitionBy("doc_id").orderBy(F.desc("value"), "page")
        scored = scored.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= k).drop("__r")
    return scored.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("page")))


def batches(pages: DataFrame, max_pages: int = BATCH_PAGES, max_chars: int = BATCH_CHARS) -> DataFrame:
    """(doc_id, page, batch): pages in order, a new batch when the current one is full.

    Page numbers and lengths are sorted by document and run through once, so a document of any length takes no more memory than one of two pages.
    """
    listed = pages.select("doc_id", F.col("page").cast("bigint").alias("page"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n"))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number, held, chars = object(), 0, 0, 0
        for rows in given:
            numbers_ = []
            for doc, n in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), strict=True):
                if doc != last:
                    last, number, held, chars = doc, 0, 0, 0
                elif held >= max_pages or chars + n > max_chars:
                    number, held, chars = number + 1, 0, 0
                held, chars = held + 1, chars + n
                numbers_.append(number)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(numbers_, pa.int32())], names=["doc_id", "page", "batch"])

    return listed.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "page").mapInArrow(pack, f"doc_id {dict(listed.dtypes)['doc_id']}, page bigint, batch int")


def coverage(pages: DataFrame, quotes: DataFrame) -> DataFrame:
    """pages' (doc_id, page, detected, covered, ratio, missed): salient quantities inside any occurrence of a quote (doc_id, page, quote) of their page.

    A page without salient quantities has the ratio 1. missed: (text, line, start) of the first quantities outside all quotes.
    """
    said = quotes.filter("quote <> ''").groupBy("doc_id", "page").agg(F.collect_set("quote").alias("__quotes"))
    p = pages.select("doc_id", "page", "text").join(said, ["doc_id", "page"], "left")
    p = p.withColumn("__high", F.coalesce(_high(text.scan_spans("text")), F.array()))
    none = F.array().cast("array<string>")

    def inside(c: Column) -> Column:
        # An occurrence holds c if it starts at c's start or before and ends at c's end or after, so it lies in this stretch of text.
        stretch = lambda q: F.substring("text", F.greatest(c["end"] - F.length(q), F.lit(0)) + 1, c["start"] + F.length(q) - F.greatest(c["end"] - F.length(q), F.lit(0)))
        return F.exists(F.coalesce("__quotes", none), lambda q: stretch(q).contains(q))

    marked = p.withColumn("__out", F.filter("__high", lambda c: ~inside(c)))
    shown = F.transform(F.slice("__out", 1, MISSED_SHOWN), lambda c: F.struct(c["text"].alias("text"), F.substring(F.btrim(c["line"], F.lit(_SPACE)), 1, 120).alias("line"), c["start"].alias("start")))
    sized = marked.select("doc_id", "page", F.size("__high").cast("bigint").alias("detected"), (F.size("__high") - F.size("__out")).cast("bigint").alias("covered"), shown.alias("missed"))
    return sized.select("doc_id", "page", "detected", "covered", F.when(F.col("detected") == 0, 1.0).otherwise(F.col("covered") / F.col("detected")).alias("ratio"), "missed")


def coverage_report(pages: DataFrame, quotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the interesting pages: (doc_id, quantities_detected, quantities_in_facts, coverage_ratio), and each document's pages of least coverage with examples."""
    covered = coverage(page_scores(pages).filter("interesting"), quotes)
    total = covered.groupBy("doc_id").agg(F.sum("detected").alias("quantities_detected"), F.sum("covered").alias("quantities_in_facts"))
    total = total.withColumn("coverage_ratio", F.when(F.col("quantities_detected") > 0, F.round(F.col("quantities_in_facts") / F.col("quantities_detected"), 4)))
    return total, worst_pages(covered)


def worst_pages(covered: DataFrame, per_doc: int = 12, limit: int | None = None) -> DataFrame:
    """(doc_id, page, detected, covered, ratio, examples) of pages with 8 quantities or more of which fewer than half are covered: the worst of each document, or the worst of all."""
    thin = covered.filter("detected >= 8 AND ratio < 0.5").select("doc_id", "page", "detected", "covered", F.round("ratio", 3).alias("ratio"), F.transform(F.slice("missed", 1, EXAMPLES), lambda m: m["line"]).alias("examples"))
    order = W.partitionBy("doc_id").orderBy("ratio", F.desc("detected"), "page")
    thin = thin.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= per_doc).drop("__r")
    return thin if limit is None else thin.orderBy("ratio", F.desc("detected"), "doc_id", "page").limit(limit)


def profile_excerpts(pages: DataFrame) -> DataFrame:
    """(doc_id, excerpt): the front matter that a document's profile is asked from, its first pages cut to a length and a common budget."""
    first = pages.withColumn("__r", F.row_number().over(W.partitionBy("doc_id").orderBy("page"))).filter(F.col("__r") <= PROFILE_PAGES)
    cut = first.select("doc_id", "page", F.substring("text", 1, PROFILE_CHARS).alias("t"))
    spent = F.sum(F.length("t")).over(W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, 0))
    kept = cut.withColumn("spent", spent).filter(F.col("spent") <= PROFILE_BUDGET)
    part = F.concat(F.lit("[page "), F.col("page").cast("string"), F.lit("]\n"), F.col("t"))
    listed = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", part.alias("part")))).alias("x"))  # at most PROFILE_PAGES
    return listed.select("doc_id", F.array_join(F.transform("x", lambda x: x["part"]), "\n\n").alias("excerpt"))


def profiles(documents: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, title, publisher, doc_type, primary_entity, published, as_of, default_qualifiers, notes) from a model's JSON answers (doc_id, answer); what is missing or no object falls back to the document's own title."""
    fields = "struct<title:string,publisher:string,doc_type:string,primary_entity:string,published:string,as_of:string,default_qualifiers:map<string,string>,notes:string>"
    a = answers.select("doc_id", F.from_json(tables.json_of(F.col("answer")), fields).alias("a"))
    trimmed = lambda c, other="": F.btrim(F.coalesce(F.nullif(F.col(f"a.{c}"), F.lit("")), F.lit(other) if isinstance(other, str) else other, F.lit("")))
    kept = F.map_filter(F.coalesce("a.default_qualifiers", F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull())
    return documents.select("doc_id", "title").join(a, "doc_id", "left").select(
        "doc_id", trimmed("title", F.col("title")).alias("title"), trimmed("publisher").alias("publisher"), trimmed("doc_type").alias("doc_type"), trimmed("primary_entity").alias("primary_entity"),
        F.col("a.published").alias("published"), F.col("a.as_of").alias("as_of"), kept.alias("default_qualifiers"), trimmed("notes").alias("notes"),
    )


def value_in_quote(value: Column, quote: Column) -> Column:
    """The value's digits stand together among the quote's."""
    digits = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\D", "")
    return digits(quote).contains(digits(value))


def ground(proposals: DataFrame, pages: DataFrame, whole_batch: bool = True) -> DataFrame:
    """proposals (doc_id, batch, page, quote, value_raw, ...) with found_page, start, end, how, relocated, body and reason (null: accepted).

    A quote is looked for on its page, and only if it is not there on the others of its batch, of which the first holds (not with whole_batch=False,
    as when one page is asked at a time). Page texts meet a proposal once, or for such misses once per page of the batch, and are not kept.
    """
    p = pages.select("doc_id", "batch", F.col("page").alias("on"), F.col("text").alias("body"))
    key = F.xxhash64("doc_id", "batch", "page", "quote")
    asked = proposals.withColumn("quote", F.btrim(F.coalesce("quote", F.lit("")), F.lit(_SPACE)))
    named = asked.join(p.withColumnRenamed("on", "page"), ["doc_id", "batch", "page"], "left").withColumn("at", text.find_quote("body", "quote"))
    first = shared.written(named.select(*proposals.columns, F.when(F.col("at.start").isNotNull(), F.struct(F.col("page").alias("on"), F.col("at.start").alias("start"), F.col("at.end").alias("end"), F.col("at.how").alias("how"))).alias("hit"), key.alias("__key")), "grounded")
    if whole_batch:
        lost = first.filter("hit IS NULL AND quote <> ''").select("__key", "doc_id", "batch", "page", "quote").dropDuplicates(["__key", "doc_id", "batch", "page", "quote"])
        tried = lost.join(p, ["doc_id", "batch"]).filter(~F.col("on").eqNullSafe(F.col("page"))).withColumn("at", text.find_quote("body", "quote")).filter("at.start IS NOT NULL")
        found = tried.groupBy("__key", "doc_id", "batch", "page", "quote").agg(F.min(F.struct("on", F.col("at.start").alias("start"), F.col("at.end").alias("end"), F.col("at.how").alias("how"))).alias("other"))
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "batch", "page", "quote")]
        first = first.alias("a").join(found.alias("b"), [F.col("a.__key") == F.col("b.__key"), *same], "left").select("a.*", "b.other")
        first = first.withColumn("hit", F.coalesce("hit", "other")).drop("other")
    bodies = p.select(F.col("doc_id").alias("__doc"), F.col("batch").alias("__batch"), F.col("on").alias("__on"), "body")
    out = first.join(bodies, [F.col("doc_id") == F.col("__doc"), F.col("batch") == F.col("__batch"), F.col("hit.on") == F.col("__on")], "left")
    said = F.substring("body", F.col("hit.start") + 1, F.col("hit.end") - F.col("hit.start"))
    numeric, value = ~F.col("kind").eqNullSafe(F.lit("semantic")), F.btrim(F.coalesce("value_raw", F.lit("")), F.lit(_SPACE))
    reason = (
        F.when(F.col("hit").isNull(), "quote_not_on_page").when(F.btrim(F.coalesce("metric", F.lit("")), F.lit(_SPACE)) == "", "no_metric").when(numeric & (value == ""), "no_value")
        .when(numeric & ~value_in_quote(value, said), "value_not_in_quote").when(numeric & numbers.parse_number(value).isNull(), "unparseable_number")
    )
    return out.select(*proposals.columns, F.col("hit.on").alias("found_page"), F.col("hit.start").alias("start"), F.col("hit.end").alias("end"), F.col("hit.how").alias("how"), (~F.col("hit.on").eqNullSafe(F.col("page"))).alias("moved"), reason.alias("reason"), "body").withColumn(
        "relocated", F.when(F.col("found_page").isNotNull(), F.col("moved"))).drop("moved")


def assemble(grounded: DataFrame, profiles: DataFrame | None = None, compat: bool = False, spans: bool = False) -> DataFrame:
    """Accepted proposals as facts, one per id, the one of most confidence; with spans, start and end on their page as well."""
    g = grounded.filter("reason IS NULL")
    if profiles is not None:
        g = g.join(profiles.select("doc_id", "default_qualifiers", "primary_entity"), "doc_id", "left")
    else:
        g = g.withColumns({"default_qualifiers": F.create_map().cast("map<string,string>"), "primary_entity": F.lit(None).cast("string")})
    g = g.withColumns({"p": numbers.parse_number(F.col("value_raw")), "u": numbers.normalise_unit(F.col("unit_raw"), compat=compat), "t": periods.parse_period(F.col("period_raw"), compat), "kind": F.when(F.col("kind").eqNullSafe(F.lit("semantic")), "semantic").otherwise("numeric")})
    g = g.withColumns({"i": numbers.build_interval(F.col("p"), F.col("u")), "period_key": periods.period_key(F.col("t")), "about": F.coalesce(F.nullif(F.col("subject"), F.lit("")), "primary_entity")})
    numeric = F.col("kind") == "numeric"
    g = g.withColumns({"q": relate.merge_qualifiers(F.col("default_qualifiers"), F.col("qualifiers"), F.when(numeric, F.col("u.canonical"))), "metric_key": text.metric_key(F.col("metric")), "subject_key": text.subject_key(F.col("about"))})
    sure = F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(0.6)) * F.when(F.col("relocated"), 0.9).otherwise(1.0)
    where = text.locator(F.col("doc_id").cast("string"), F.col("found_page"), F.col("start"), F.col("end"))
    facts = g.select(
        text.fact_id(where, F.col("metric"), F.coalesce(F.when(numeric, F.col("i.canonical_value").cast("string")), F.col("state")), F.col("period_key"), F.col("q")).alias("id"), "doc_id", "kind", "metric", "metric_key", "subject_key",
        F.when(numeric, F.col("i.canonical_value")).alias("value"), F.when(numeric, F.col("i.lo")).alias("lo"), F.when(numeric, F.col("i.hi")).alias("hi"), F.when(numeric, F.col("u.canonical")).alias("unit"), F.when(~numeric, F.col("state")).alias("state"),
        relate.dimensions(F.col("period_key"), informative_subject(F.col("subject_key"), F.col("metric_key")), F.col("q")).alias("dims"), sure.alias("confidence"), F.col("found_page").alias("page"), "quote",
        F.substring("body", F.greatest(F.col("start") - SNIPPET, F.lit(0)) + 1, F.col("end") + SNIPPET - F.greatest(F.col("start") - SNIPPET, F.lit(0))).alias("snippet"), F.when(F.col("relocated"), F.col("page")).alias("original_page"), *(["start", "end"] if spans else []),
    )
    return resolve.subject_guard(dedup_facts(facts))


def informative_subject(subject: Column, metric: Column) -> Column:
    """The subject's key unless the metric's name holds it (the similarity test on distinct pairs is `resolve.subject_guard`)."""
    return F.when((subject != "") & ~metric.contains(subject), subject)


def dedup_facts(facts: DataFrame) -> DataFrame:
    order = W.partitionBy("id").orderBy(F.desc("confidence"), "doc_id")
    return facts.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


#: The reasons of a rejection by what they count as.
REASONS = {"quote_not_on_page": ("quote_not_on_page",), "value_not_in_quote": ("value_not_in_quote",), "unparseable": ("no_metric", "no_value", "unparseable_number")}


def rejections(grounded: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, why, quote, metric, value) of the proposals that were not accepted, and one row with why = call_failed per batch without an answer."""
    cut = lambda c, n: F.substring(c, 1, n).alias({"value_raw": "value"}.get(c, c))
    out = grounded.filter("reason IS NOT NULL").select("doc_id", F.col("page").cast("bigint").alias("page"), F.col("reason").alias("why"), cut("quote", 120), cut("metric", 80), cut("value_raw", 40))
    if failed is None:
        return out
    none = F.lit(None).cast("string")
    return out.unionByName(failed.select("doc_id", F.col("page").cast("bigint").alias("page"), F.lit("call_failed").alias("why"), none.alias("quote"), none.alias("metric"), none.alias("value")))


def failed_calls(batched: DataFrame, answered: DataFrame) -> DataFrame:
    """(doc_id, batch, page, pages) of batches (doc_id, page, batch) without an answer (doc_id, batch); page is the first of them."""
    sent = batched.groupBy("doc_id", "batch").agg(F.min("page").alias("page"), F.count("*").alias("pages"))
    return sent.join(answered.select("doc_id", "batch").distinct(), ["doc_id", "batch"], "left_anti").select("doc_id", "batch", "page", "pages")


def rejection_stats(grounded: DataFrame) -> DataFrame:
    """(doc_id, proposed, kept, one column per kind of rejection, pass_rate)."""
    counted = [F.count_if(F.col("reason").isin(*names)).alias(kind) for kind, names in REASONS.items()]
    return grounded.groupBy("doc_id").agg(F.count("*").alias("proposed"), F.count_if(F.col("reason").isNull()).alias("kept"), *counted).withColumn("pass_rate", F.col("kept") / F.col("proposed"))


def extraction_stats(pages: DataFrame, batched: DataFrame, failed: DataFrame, grounded: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per document of pages: pages_seen, pages_sent, pages_failed, the counts of rejection_stats, n_facts after deduplication and pass_rate (1 if nothing was proposed)."""
    seen = pages.groupBy("doc_id").agg(F.count("*").alias("pages_seen"))
    bad = failed.groupBy("doc_id").agg(F.sum("pages").alias("pages_failed"))
    sent = batched.groupBy("doc_id").agg(F.count("*").alias("batched"))
    kept = facts.groupBy("doc_id").agg(F.count("*").alias("n_facts"))
    out = seen.join(sent, "doc_id", "left").join(bad, "doc_id", "left").join(rejection_stats(grounded), "doc_id", "left").join(kept, "doc_id", "left")
    out = out.fillna(0, ["batched", "pages_failed", "proposed", "kept", *REASONS, "n_facts"]).fillna(1.0, ["pass_rate"])
    return out.withColumn("pages_sent", F.col("batched") - F.col("pages_failed")).drop("batched")
