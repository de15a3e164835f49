"""Golden cases of the normalisers and verdicts, and queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspan.functions import numbers, periods, text
from quillspan.operators import relate
from quillspan.sources import tables

SF = "/root/testdata/sf0.001"
FAST = ["number_parse", "unit_normalise", "value_agreement", "period_goldens", "metric_key", "subject_key", "fact_id_dedup", "qualifier_merge", "state_language", "verdict_counts", "doc_fact_counts", "corpus_summary"]


def rows(df_rows):
    return sorted(map(str, df_rows))


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = entry.queries()[name](spark, SF)
    columns = sorted(found.columns)
    wanted = con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert rows([tuple(r) for r in found.select(*columns).collect()]) == rows(wanted)


def fact(id_, doc, raw, unit, period, confidence=0.9, metric="real GDP growth", **q):
    return (id_, doc, metric, raw, unit, period, q, confidence)


def facts(spark, *given):
    d = spark.createDataFrame(list(given), "id string, doc_id string, metric string, raw string, unit_raw string, period_raw string, q map<string,string>, confidence double")
    p, u = numbers.parse_number(F.col("raw")), numbers.normalise_unit(F.col("unit_raw"))
    d = d.select("*", numbers.build_interval(p, u).alias("i"), u.alias("u"), periods.parse_period(F.col("period_raw")).alias("t"))
    return d.select("id", "doc_id", F.lit("numeric").alias("kind"), "metric", text.metric_key(F.col("metric")).alias("metric_key"), F.col("i.canonical_value").alias("value"), F.col("i.lo").alias("lo"), F.col("i.hi").alias("hi"), F.col("u.canonical").alias("unit"), F.lit(None).cast("string").alias("state"), relate.dimensions(periods.period_key(F.col("t")), F.lit(""), F.col("q")).alias("dims"), "confidence")


CASES = [
    (("8,142", "Rs. crore", "FY24", {"scope": "consolidated"}), ("81,415.38", "Rs. million", "FY24", {"scope": "consolidated"}), "corroborates", None),
    (("6.5", "per cent", "FY26", {"basis": "projection"}), ("6.6", "per cent", "FY2025/26", {"basis": "projection"}), "contradicts", None),
    (("6.4", "per cent", "FY25", {"basis": "first_advance_estimate"}), ("6.5", "per cent", "2024-25", {"basis": "provisional_estimate"}), "reconciled", "basis"),
    (("74,540.82", "Rs. million", "FY24", {"scope": "standalone"}), ("81,415.38", "Rs. million", "FY24", {"scope": "consolidated"}), "reconciled", "scope"),
    (("8,142", "Rs. crore", "FY24", {}), ("2,076", "Rs. crore", "Q4 FY24", {}), "reconciled", "period"),
    (("1,266.41", "Rs. million", "FY24", {}), ("1.6", "per cent", "FY24", {}), None, None),
    (("6.5", "per cent", "Q1:2024-25", {}), ("6.5", "per cent", "FY2024/25", {}), "related", None),
    (("6.5", "per cent", "2024-25", {}), ("6.5", "per cent", "FY2024/25", {}), "corroborates", None),
]


@pytest.mark.parametrize("left,right,verdict,by", CASES)
def test_verdict(spark, left, right, verdict, by):
    both = facts(spark, fact("a", "d1", *left[:3], **left[3]), fact("b", "d2", *right[:3], **right[3]))
    none = spark.createDataFrame([], "dim string, n_pairs bigint, power double")
    found = relate.judge(relate.evaluate(relate.block_pairs(both)), none).select("verdict", "explained_by").collect()
    assert [tuple(r) for r in found] == ([] if verdict is None else [(verdict, by)])


def test_review_when_a_telling_dimension_is_missing(spark):
    both = facts(spark, fact("a", "d1", "6.0", "per cent", "FY25"), fact("b", "d2", "7.8", "per cent", None))
    trained = spark.createDataFrame([("period", 15, 17 / 19)], "dim string, n_pairs bigint, power double")
    r = relate.judge(relate.evaluate(relate.block_pairs(both)), trained).first()
    assert (r.verdict, r.review_reason) == ("needs_review", "period_unknown_on_one_side")


def test_relation_id_has_no_direction(spark):
    d = spark.createDataFrame([("x", "y")], "a string, b string")
    r = d.select(text.relation_id(F.col("a"), F.col("b")).alias("p"), text.relation_id(F.col("b"), F.col("a")).alias("q")).first()
    assert r.p == r.q and len(r.p) == 16


def test_unknown_verdict_is_an_error(spark):
    with pytest.raises(ValueError):
        tables.list_relations(spark.range(1), verdict="maybe")


def test_json_is_recovered(spark):
    said = ["```json\n{\"a\": 1}\n```", "so: [1, 2] there", "text {\"b\": 2} end", "none"]
    d = spark.createDataFrame([(s,) for s in said], "s string")
    assert [r[0] for r in d.select(tables.json_of(F.col("s"))).collect()] == ['{"a": 1}', "[1, 2]", '{"b": 2}', None]


def test_quotes_are_found(spark):
    d = spark.createDataFrame([("a  big\nword here", "big word"), ("split wo rd", "word"), ("plain text", "text"), ("plain", "absent")], "t string, q string")
    assert [r[0].how if r[0] else None for r in d.select(text.find_quote("t", "q")).collect()] == ["spaced", "squeezed", "exact", None]
