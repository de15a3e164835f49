"""Facts, pages and proposals made from the tables at hand, and the same facts as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, periods, text
from ..operators import relate, resolve


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def yearly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, fy, cents): each customer's orders per fiscal year, summed in whole cents so that no order of summation shows."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    o = o.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_custkey")  # few bytes, but parsed and paired at length
    fy = F.year("o_orderdate") + F.when(F.month("o_orderdate") >= 4, 1).otherwise(0)
    return o.groupBy(F.col("o_custkey").alias("k"), fy.alias("fy")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))


def written_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sums as four documents write them: to the cent, in thousands (of every eleventh customer misprinted), as a provisional estimate, and without a period."""
    y = yearly_orders(spark, sf_dir)
    tenths = lambda n: F.concat((F.expr(f"({n}) div 10")).cast("string"), F.lit("."), F.expr(f"({n}) % 10").cast("string"))
    said = lambda doc, raw, unit, basis, sure, dated=True: F.struct(F.lit(doc).alias("doc_id"), raw.alias("raw"), F.lit(unit).alias("unit_raw"), F.lit(basis).alias("basis"), F.lit(sure).alias("confidence"), F.lit(dated).alias("dated"))
    cent = F.concat(F.expr("cents div 100").cast("string"), F.lit("."), F.lpad(F.expr("cents % 100").cast("string"), 2, "0"))
    docs = [said("annual", cent, "USD", "final", 0.9), said("deck", tenths("(cents + 5000 + if(k % 11 = 0, 50000, 0)) div 10000"), "USD thousand", "final", 0.8), said("survey", tenths("cents * 98 div 1000000"), "USD thousand", "provisional", 0.7)]
    memo = F.when(F.col("k") % 5 == 0, F.array(said("memo", tenths("cents * 11 div 100000"), "USD thousand", "final", 0.6, False))).otherwise(F.array().cast("array<struct<doc_id:string,raw:string,unit_raw:string,basis:string,confidence:double,dated:boolean>>"))
    return y.select("k", "fy", F.inline(F.concat(F.array(*docs), memo))).withColumn("metric", F.concat(F.lit("Order value of customer "), F.col("k").cast("string")))


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = written_facts(spark, sf_dir)
    w = w.withColumns({"p": numbers.parse_number(F.col("raw")), "u": numbers.normalise_unit(F.col("unit_raw")), "t": periods.parse_period(F.when(F.col("dated"), F.concat(F.lit("FY"), F.col("fy").cast("string"))))})
    w = w.withColumn("i", numbers.build_interval(F.col("p"), F.col("u")))
    return w.select(
        F.concat_ws(":", "doc_id", F.col("k").cast("string"), F.col("fy").cast("string")).alias("id"), "doc_id", F.lit("numeric").alias("kind"), "metric", text.metric_key(F.col("metric")).alias("metric_key"), F.lit("").alias("subject_key"),
        F.col("i.canonical_value").alias("value"), F.col("i.lo").alias("lo"), F.col("i.hi").alias("hi"), F.col("u.canonical").alias("unit"), F.lit(None).cast("string").alias("state"),
        relate.dimensions(periods.period_key(F.col("t")), F.lit(""), F.create_map(F.lit("basis"), F.col("basis"))).alias("dims"), "confidence", F.lit(0).alias("page"), "k", "fy",
    )


FACTS_SQL = """
y AS (SELECT o_custkey AS k, year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END AS fy, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1, 2),
w AS (SELECT k, fy, 'annual' AS doc_id, CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS raw, 'final' AS basis, 0.9::DOUBLE AS confidence, 1e-6::DOUBLE AS factor, 0.01::DOUBLE AS ulp FROM y
  UNION ALL SELECT k, fy, 'deck', CAST(((cents + 5000 + CASE WHEN k % 11 = 0 THEN 50000 ELSE 0 END) // 10000) // 10 AS VARCHAR) || '.' || CAST(((cents + 5000 + CASE WHEN k % 11 = 0 THEN 50000 ELSE 0 END) // 10000) % 10 AS VARCHAR), 'final', 0.8::DOUBLE, 0.001::DOUBLE, 0.1::DOUBLE FROM y
  UNION ALL SELECT k, fy, 'survey', CAST((cents * 98 // 1000000) // 10 AS VARCHAR) || '.' || CAST((cents * 98 // 1000000) % 10 AS VARCHAR), 'provisional', 0.7::DOUBLE, 0.001::DOUBLE, 0.1::DOUBLE FROM y
  UNION ALL SELECT k, fy, 'memo', CAST((cents * 11 // 100000) // 10 AS VARCHAR) || '.' || CAST((cents * 11 // 100000) % 10 AS VARCHAR), 'final', 0.6::DOUBLE, 0.001::DOUBLE, 0.1::DOUBLE FROM y WHERE k % 5 = 0),
f AS (SELECT doc_id || ':' || k || ':' || fy AS id, doc_id, k, fy, raw, 'order customer ' || k AS metric_key, 'Order value of customer ' || k AS metric, basis, confidence, CAST(raw AS DOUBLE) * factor AS value, CAST(raw AS DOUBLE) * factor - ulp * 0.5 * factor AS lo, CAST(raw AS DOUBLE) * factor + ulp * 0.5 * factor AS hi,
             CASE WHEN doc_id <> 'memo' THEN CAST(make_date(fy - 1, 4, 1) AS VARCHAR) || '..' || CAST(make_date(fy, 3, 31) AS VARCHAR) END AS period FROM w)"""

_RELATIONS = """,
e AS (SELECT l.id AS left_id, r.id AS right_id, substr(sha1(least(l.id, r.id) || '|' || greatest(l.id, r.id)), 1, 16) AS id, l.doc_id <> r.doc_id AS cross_document, l.k, least(l.hi, r.hi) - greatest(l.lo, r.lo) > 1e-9 AS agrees,
             abs(l.value - r.value) / greatest(l.hi - l.lo, r.hi - r.lo) AS separation, least(l.confidence, r.confidence) * 1.0::DOUBLE AS c0, l.metric <> r.metric AS renamed, l.basis <> r.basis AS cb, coalesce(l.period <> r.period, false) AS cp, (l.period IS NULL) <> (r.period IS NULL) AS up,
             l.period IS NOT NULL AND r.period IS NOT NULL AS bp, coalesce(l.period = r.period, false) AS ap, abs(l.value - r.value) / greatest(abs(l.value), abs(r.value)) AS gap
      FROM f l JOIN f r ON l.metric_key = r.metric_key AND l.id < r.id),
s AS (SELECT CASE WHEN cb THEN 'basis' ELSE 'period' END AS dim, CAST(count(*) AS BIGINT) AS n_pairs, CAST(count(*) FILTER (NOT agrees) AS BIGINT) AS n_differs FROM e WHERE cb <> cp GROUP BY 1),
t AS (SELECT *, CAST(n_differs + 2 AS DOUBLE) / (n_pairs + 4) AS power FROM s),
g AS (SELECT coalesce((SELECT power FROM t WHERE dim = 'basis'), 0.5) AS pb, coalesce((SELECT power FROM t WHERE dim = 'period'), 0.5) AS pp),
v AS (SELECT e.*, pb, pp, CASE WHEN agrees AND NOT cb AND NOT cp THEN 'corroborates' WHEN agrees THEN 'related' WHEN NOT cb AND NOT cp AND up AND pp >= 0.6 THEN 'needs_review' WHEN NOT cb AND NOT cp THEN 'contradicts' ELSE 'reconciled' END AS verdict FROM e, g),
x AS (SELECT *, CASE WHEN verdict = 'reconciled' THEN CASE WHEN cb AND cp THEN CASE WHEN pb >= pp THEN 'basis' ELSE 'period' END WHEN cb THEN 'basis' ELSE 'period' END END AS explained_by, CASE WHEN verdict = 'needs_review' THEN 'period_unknown_on_one_side' END AS review_reason FROM v),
z AS (SELECT *, CASE explained_by WHEN 'basis' THEN pb WHEN 'period' THEN pp END AS power FROM x),
c AS (SELECT *, round(least(0.99, greatest(0.05, CASE WHEN verdict = 'contradicts' THEN c0 * (CASE WHEN up THEN greatest(0.45, 1 - 0.18::DOUBLE * 1) ELSE 1 END) * (CASE WHEN separation < 1.5 THEN 0.8 ELSE 1 END) WHEN verdict = 'reconciled' THEN c0 * (0.5 + 0.5 * power) * (CASE WHEN cb AND cp THEN 0.85 ELSE 1.0 END)
                                                             WHEN verdict = 'needs_review' THEN least(0.9, c0 * 0.95) ELSE c0 END)), 3) AS confidence FROM z),
rel AS (SELECT *, round(CASE verdict WHEN 'contradicts' THEN 1.0 WHEN 'needs_review' THEN 0.85 WHEN 'reconciled' THEN 0.72 WHEN 'corroborates' THEN 0.55 ELSE 0.3 END::DOUBLE * (0.45 + 0.55 * confidence) * CASE WHEN cross_document THEN 1.5 ELSE 1.0 END * CASE WHEN verdict = 'reconciled' AND cb AND cp THEN 0.8 ELSE 1.0 END, 4) AS salience FROM c)
"""
RELATIONS_SQL = "WITH " + FACTS_SQL + _RELATIONS



# The survey words its metric otherwise; of some customers a model has said that both are one, of some the wording is near enough.
_ASKED = {"lexical_high": "k % 7 = 0", "llm": "k % 3 <> 0"}
CROSS_SQL = (
    "WITH "
    + FACTS_SQL.replace("f AS (SELECT", "f_ AS (SELECT")
    + ", f AS (SELECT * REPLACE (CASE WHEN doc_id = 'survey' THEN 'sale customer ' || k ELSE metric_key END AS metric_key, CASE WHEN doc_id = 'survey' THEN 'Sales of customer ' || k ELSE metric END AS metric) FROM f_)"
    + _RELATIONS.replace("ON l.metric_key = r.metric_key AND l.id < r.id", "ON l.k = r.k AND l.id < r.id AND (l.metric_key = r.metric_key OR l.k % 7 = 0 OR l.k % 3 <> 0)")
    .replace("* 1.0::DOUBLE AS c0", "* CASE WHEN l.metric_key <> r.metric_key AND l.k % 7 <> 0 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS c0")
)


def cross_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = order_facts(spark, sf_dir)
    other = F.col("doc_id") == "survey"
    named = F.when(other, F.concat(F.lit("Sales of customer "), F.col("k").cast("string"))).otherwise(F.col("metric"))
    return f.withColumn("metric", named).withColumn("metric_key", text.metric_key(F.col("metric")))


def cross_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of the two names of each customer's metric: from wording, from a model, or nothing."""
    k = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct()
    n = F.col("k").cast("string")
    links = k.select("k", F.concat(F.lit("order customer "), n).alias("key_a"), F.concat(F.lit("sale customer "), n).alias("key_b"), F.when(F.expr(_ASKED["lexical_high"]), 96.0).otherwise(82.0).alias("lexical"), F.lit(0.8).alias("semantic"))
    said = links.filter("k % 5 <> 4 OR k % 3 <> 0").select("key_a", "key_b", F.expr(_ASKED["llm"]).alias("same"), F.lit("llm").alias("source"))
    return resolve.same_metric(links.drop("k"), said)


def order_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.relations(order_facts(spark, sf_dir))


CLOSING = "\nFY24 results (3)"


def synthetic_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, text): one page per order with a line per item, a document per customer. Both figures of a line are measurements; the last line's are a period and a footnote."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    line = F.concat(F.lit("Item "), F.col("l_linenumber").cast("string"), F.lit(": "), F.col("l_quantity").cast("int").cast("string"), F.lit(" tonnes for Rs. "), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit(" million"))
    pages = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice", line.alias("line")))).alias("x"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    body = F.array_join(F.transform("x", lambda x: x["line"]), "\n")
    state = F.when(F.col("o_orderstatus") == "F", "\nThe chief executive officer resigned.").otherwise("")
    return pages.join(orders, "l_orderkey").select(F.col("o_custkey").alias("doc_id"), F.col("l_orderkey").alias("page"), F.concat(body, state, F.lit(CLOSING)).alias("text"), F.size("x").alias("n_lines"))


PAGES_SQL = """
i AS (SELECT l_orderkey, string_agg('Item ' || l_linenumber || ': ' || CAST(l_quantity AS INTEGER) || ' tonnes for Rs. ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || ' million', chr(10) ORDER BY l_linenumber, l_extendedprice) AS body, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1),
pages_ AS (SELECT o_custkey AS doc_id, l_orderkey AS page, body || CASE WHEN o_orderstatus = 'F' THEN chr(10) || 'The chief executive officer resigned.' ELSE '' END || chr(10) || 'FY24 results (3)' AS text, o_orderstatus = 'F' AS state, n FROM i JOIN orders ON o_orderkey = l_orderkey)"""
