"""Operators whose answers are known without SQL: plain Python, files in a folder, and cases made by hand."""

import hashlib
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspan.functions import numbers, periods, text
from quillspan.operators import ground, relate, resolve
from quillspan.plans import inputs
from quillspan.sources import tables
from quillspan.streaming import incremental

SF = "/root/testdata/sf0.001"


def column(spark, given, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in given], f"s {kind}").select(expr(F.col("s"))).collect()]


def test_compat_restores_the_quirks(spark):
    found = column(spark, ["bps", "hours", "per cent of GDP"], lambda c: numbers.normalise_unit(c, compat=True))
    assert [(r.canonical, r.factor) for r in found] == [("percent", 1.0), ("INR_million", 1e-6), ("percent", 1.0)]
    spans = ["2024-05-17", "2021-24", "as of summary 2024"]
    assert [r and str(r.end) for r in column(spark, spans, lambda c: periods.parse_period(c, compat=True))] == ["2105-03-31", "2024-03-31", "2024-03-31"]
    assert [r and str(r.end) for r in column(spark, spans, periods.parse_period)] == ["2024-12-31", "2021-12-31", "2024-12-31"]


def test_numbers_for_readers(spark):
    given = [81415.38, 12.5, 1.0, 0.00012345, 0.0, float("inf"), None, -1234.4]
    assert column(spark, given, numbers.display, "double") == ["81,415", "12.5", "1", "0.0001234", "0", "unbounded", "?", "-1,234"]
    ends = column(spark, [81415.38, 6.4], lambda c: numbers.display_interval(c - 0.04, c + 0.04), "double")
    assert ends == ["81,415.340–81,415.420", "6.360–6.440"]
    assert column(spark, [2.04, 101.0, None], numbers.display_separation, "double") == [" (2.0 rounding steps of the coarser)", " (far beyond any rounding)", ""]


@pytest.mark.parametrize("given,wanted", [("5 days", "high"), ("FY24", "period_token"), ("x (3)", "footnote_marker"), ("page 12", None), ("17", "standalone_number"), ("of 17 in", "bare_small_integer"), ("h 1,000", "high"), ("Q4 %", "period_token"), ("3 kg", "high"), ("2024 was", "high"), ("rose 7 x", "high"), ("bps 12 bps", "high"), ("fy\n24 a", "bare_small_integer")])
def test_salience(spark, given, wanted):
    d = spark.createDataFrame([("d", 1, given)], "doc_id string, page int, text string")
    assert [r.reason or r.salience for r in ground.candidates(d).collect()] == ([wanted] if wanted else [])


def test_coverage_counts_overlapping_and_empty(spark):
    pages = spark.createDataFrame([("d", 1, "5 kg 5 kg 5 kg and 7.5"), ("d", 2, "nothing here"), ("d", 3, None), ("d", 4, "1,000")], "doc_id string, page int, text string")
    quotes = spark.createDataFrame([("d", 1, "5 kg 5 kg"), ("d", 1, ""), ("d", 4, "1,00"), ("e", 1, "x")], "doc_id string, page int, quote string")
    found = {r.page: (r.detected, r.covered, r.ratio, [m.text for m in r.missed]) for r in ground.coverage(pages, quotes).collect()}
    assert found == {1: (4, 3, 0.75, ["7.5"]), 2: (0, 0, 1.0, []), 3: (0, 0, 1.0, []), 4: (1, 0, 0.0, ["1,000"])}


def test_whole_page_is_scanned_by_the_reference_form(spark):
    """Every quantity by the plain regular expression, over documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.lit("d").alias("doc_id"), F.col("doc_id").alias("page"), "text")
    found = {}
    for r in ground.candidates(docs).collect():
        found.setdefault(r.page, []).append((r.start, r.end, r.text))
    quantity, structure = re.compile(text.QUANTITY, re.I), re.compile(text.STRUCTURE)
    for r in docs.collect():
        wanted = []
        for m in quantity.finditer(r.text or ""):
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            if not structure.search(r.text[r.text.rfind("\n", 0, start) + 1 : start]):
                wanted.append((start, start + len(m[0].strip()), m[0].strip()))
        assert sorted(found.get(r.page, [])) == sorted(wanted)


def test_batches_stream_through_partitions(spark):
    rows = [(d, p, "x" * (p * 37 % 900)) for d in ("a", "b", None) for p in range(200)]
    found = {(r.doc_id, r.page): r.batch for r in ground.batches(spark.createDataFrame(rows, "doc_id string, page int, text string"), 5, 2000).collect()}
    for d in ("a", "b", None):
        number = held = chars = 0
        for p in range(200):
            n = p * 37 % 900
            if held and (held >= 5 or chars + n > 2000):
                number, held, chars = number + 1, 0, 0
            held, chars = held + 1, chars + n
            assert found[d, p] == number


def test_ratios_against_plain_python(spark):
    def lcs(a, b):
        best = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        return best[-1, -1]

    pairs = [("net sales", "sales net"), ("ebitda", "adjusted ebitda"), ("", ""), ("a b c", "c b"), ("real gdp", "real gdp growth"), ("hot rod", "old bolt")]
    d = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.token_sort_ratio("a", "b").alias("sort"), text.token_set_ratio("a", "b").alias("set"))
    for r in d.collect():
        x, y = (" ".join(sorted(s.split())) for s in (r.a, r.b))
        assert r.sort == pytest.approx(200 * lcs(x, y) / (len(x) + len(y)) if x or y else 100)
    assert {r.a: r.set for r in d.collect() if r.a in ("ebitda", "real gdp", "")} == {"ebitda": 100.0, "real gdp": 100.0, "": 0.0}


@pytest.mark.parametrize("block", [3, 1000])
def test_semantic_links_in_blocks(spark, block):
    """Any block size gives the links of all pairs; zero vectors and ties included."""
    rng = np.random.default_rng(5)
    rows = {f"k{i:02d}": rng.normal(size=6) for i in range(40)} | {"zero": np.zeros(6), "twin": np.ones(6), "twin2": np.ones(6) * 3}
    d = spark.createDataFrame([(k, v.tolist()) for k, v in rows.items()], "key string, vector array<double>")
    unit = {k: v / n if (n := np.linalg.norm(v)) else v for k, v in rows.items()}
    score = {(a, b): float(unit[a] @ unit[b]) for a in rows for b in rows if a < b}
    score = {p: s for p, s in score.items() if s >= 0.3}
    best = {x: [y for _, y in sorted((-round(s, 9), b if a == x else a) for (a, b), s in score.items() if x in (a, b))[:4]] for x in rows}
    wanted = {(a, b): pytest.approx(s) for (a, b), s in score.items() if b in best[a] or a in best[b]}
    assert {(r.key_a, r.key_b): r.score for r in resolve.semantic_links(d, 0.3, 4, block).collect()} == wanted


def test_metric_links_give_the_stronger_score(spark):
    facts = spark.createDataFrame([("net sale",), ("sale net",), ("ebitda",), ("profit before tax",)], "metric_key string")
    vectors = spark.createDataFrame([("ebitda", [1.0, 0.1]), ("profit before tax", [1.0, 0.0]), ("unknown", [1.0, 0.0])], "key string, vector array<double>")
    found = {(r.key_a, r.key_b): r for r in resolve.metric_links(facts, vectors).collect()}
    assert set(found) == {("net sale", "sale net"), ("ebitda", "profit before tax")}
    far = found["ebitda", "profit before tax"]
    assert far.lexical < 80 and far.score == pytest.approx(far.semantic) and found["net sale", "sale net"].score == 1.0
    assert resolve.index_metrics(facts, resolve.metric_links(facts, vectors)).first().asDict() == {"unique_metrics": 4, "semantic_pairs": 1, "lexical_pairs": 1}


def test_explanations_are_compiled(spark, tmp_path):
    """Java leaves methods of more than 8,000 bytes to its interpreter; the explanation of judged pairs must make none."""
    inputs.order_relations(spark, SF).write.parquet(str(tmp_path / "judged"))
    e = spark.read.parquet(str(tmp_path / "judged")).select("id", relate.explanation().alias("explanation"))
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(e._jdf.queryExecution().executedPlan())
    assert all(stages.apply(i)._3().maxMethodCodeSize() <= 8000 for i in range(stages.size()))


def test_explanations_of_the_five_verdicts(spark):
    d = entry.queries()["explanations"](spark, SF).groupBy("verdict").agg(F.min("explanation").alias("e"), F.count_if(F.col("explanation").isNull()).alias("none")).collect()
    said = {r.verdict: r.e for r in d}
    assert all(r.none == 0 for r in d) and set(said) == set(tables.VERDICTS)
    assert all(s.startswith("Both report Order value of customer") for s in said.values())
    assert "Nothing recorded tells them apart." in said["contradicts"] and "left for review" in said["needs_review"] and "share a number" in said["related"]
    assert "which explains the gap" in said["reconciled"] and "is rounding" in said["corroborates"]


def test_model_matches_lower_the_confidence(spark):
    rows = [("a", "d1", "net sale", 0.9, 1.0), ("b", "d2", "sale of net", 0.8, 1.0)]
    f = spark.createDataFrame(rows, "id string, doc_id string, metric_key string, confidence double, value double").withColumns({"metric": F.col("metric_key"), "kind": F.lit("numeric"), "lo": F.col("value") - 0.1, "hi": F.col("value") + 0.1, "unit": F.lit("count"), "state": F.lit(None).cast("string"), "dims": F.create_map().cast("map<string,string>"), "page": F.lit(0)})
    for source, sure in (("llm", 0.72), ("lexical_high", 0.8)):
        verdicts = spark.createDataFrame([("net sale", "sale of net", 85.0, None, True, source)], "key_a string, key_b string, lexical double, semantic double, same boolean, source string")
        r = relate.relations(f, verdicts).select("verdict", "confidence", "match.source", "cross_document").collect()
        assert [tuple(x) for x in r] == [("corroborates", sure, source, True)]
        assert [tuple(x) for x in incremental.link_new_facts(f.filter("id = 'a'"), f.filter("id = 'b'"), spark.createDataFrame([], "dim string, n_pairs bigint, n_differs bigint"), verdicts)[0].select("l.id", "r.id").collect()] == [("a", "b")]
    assert relate.relations(f).count() == 0


def test_files_cache_and_reports(spark, tmp_path):
    (tmp_path / "in" / "filings").mkdir(parents=True)
    (tmp_path / "in" / "filings" / "a report.pdf").write_bytes(b"one")
    (tmp_path / "in" / "b.pdf").write_bytes(b"two")
    found = {r.doc_id: (r.corpus, r.n_bytes, bytes(r.content)) for r in tables.read_files(spark, str(tmp_path / "in"), "*.pdf").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()[:8]
    assert {k.rsplit("-", 1)[1] for k in found} == {sha(b"one"), sha(b"two")} and sorted(v[1:] for v in found.values()) == [(3, b"one"), (3, b"two")]
    key = hashlib.sha1(b"ask").hexdigest()
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / f"{key}.json").write_text(json.dumps({"data": '{"same": true}', "raw": "r", "model": "m", "provider": "p", "tag": "t"}))
    cache = tables.read_cache(spark, str(tmp_path / "cache"))
    prompts = spark.createDataFrame([("ask",), ("other",)], "prompt string")
    assert {r.prompt: r.data for r in tables.replay(prompts, cache, strict=False).collect()} == {"ask": '{"same": true}', "other": None}
    with pytest.raises(Exception, match="not cached"):
        tables.replay(prompts, cache).collect()
    tables.write_report(spark.createDataFrame([(1, "x")], "n int, why string"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).collect()[0].asDict() == {"n": 1, "why": "x"}


def test_boxes_join_words_of_a_line(spark):
    words = [(0, 3, 30.0, 10.0, 50.0, 20.0), (4, 7, 5.0, 11.0, 25.0, 21.0), (8, 12, 5.0, 40.0, 30.0, 50.0), (13, 15, 60.0, 12.0, 70.0, 22.0), (20, 25, 0.0, 90.0, 9.0, 99.0)]
    d = spark.createDataFrame([(words,)], "w array<struct<start:int,end:int,x0:double,y0:double,x1:double,y1:double>>")
    boxes = d.select(tables.span_boxes(F.col("w"), F.lit(1), F.lit(15))).first()[0]
    assert [tuple(b) for b in boxes] == [(5.0, 10.0, 70.0, 22.0), (5.0, 40.0, 30.0, 50.0)]


def test_report_has_a_row_for_all(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    extraction = spark.createDataFrame([("a", 5, 4, 3, 0.5), ("b", 2, 2, 1, 1.0)], "doc_id string, pages_seen bigint, pages_sent bigint, n_facts bigint, pass_rate double")
    covered = spark.createDataFrame([("a", 0.25)], "doc_id string, coverage_ratio double")
    assert sorted(map(tuple, tables.corpus_report(docs, extraction, covered).collect()), key=str) == [("a", 5, 4, 3, 0.5, 0.25), ("b", 2, 2, 1, 1.0, None), (None, 7, 6, 4, None, None)]


def test_batch_and_incremental_link_the_same_pairs(spark):
    facts = entry._catalogue().order_facts(spark, SF).filter("k < 12")
    pairs = lambda r: {(x.l.id, x.r.id) for x in r.select("l", "r").collect()}
    old, new = facts.filter("fy < 1998"), facts.filter("fy >= 1998")
    stats = relate.dimension_stats(relate.evaluate(relate.block_pairs(old, cap=None)))
    whole = pairs(incremental.rebuild(facts)[0])
    assert pairs(incremental.rebuild(old)[0]) | pairs(incremental.link_new_facts(old, new, stats)[0]) == whole and whole
