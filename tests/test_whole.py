"""Queries that must lose nothing, against plain Python."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspan.functions import text
from quillspan.operators import resolve

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["cross_block_pairs", "cross_block_sizes", "cross_block_members"])
def test_cross_block_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
    found = entry.queries()[name](spark, SF)
    wanted = con.sql(f"SELECT {', '.join(found.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted))


def test_every_part_is_in_the_linked_pairs(spark):
    """Pairs of classes, joined to the members on both sides, are the linked pairs of parts."""
    parts = [(r.p_partkey, r.p_name, r.p_type, r.p_brand) for r in spark.read.parquet(f"{SF}/part.parquet").collect()]
    linked = {frozenset((a[1], b[1])) for a in parts for b in parts if a[2:] == b[2:] and a[1] != b[1]}
    wanted = Counter(frozenset((a[0], b[0])) for a in parts for b in parts if a[0] < b[0] and frozenset((a[1], b[1])) in linked)
    members = entry.queries()["cross_block_members"](spark, SF).collect()
    assert sorted(r.p_partkey for r in members) == sorted(a[0] for a in parts)
    of: dict = {}
    for r in members:
        of.setdefault(r["class"], []).append(r.p_partkey)
    sizes = entry.queries()["cross_block_sizes"](spark, SF).collect()
    assert all((r.left_parts, r.right_parts) == (len(of[r.left_id]), len(of[r.right_id])) for r in sizes)
    assert Counter(frozenset((x, y)) for r in sizes for x in of[r.left_id] for y in of[r.right_id]) == wanted


def by_brute_force(keys, least, k=12):
    """The links among distinct keys, each compared with each by the same ratio."""
    form = {x: " ".join(sorted(x.split())) for x in keys}
    score = {(a, b): text._ratio(form[a], form[b]) for a in keys for b in keys if a < b}
    score = {p: v for p, v in score.items() if v >= least}
    best = {x: sorted((-v, b if a == x else a) for (a, b), v in score.items() if x in (a, b))[:k] for x in keys}
    return {(a, b): v for (a, b), v in score.items() if (-v, b) in best[a] or (-v, a) in best[b]}


@pytest.mark.parametrize("least", [60.0, 80.0])
def test_lexical_links_equal_brute_force(spark, least):
    """Part names of sf0.01, and keys whose shared characters never stand side by side, whose words change places, or that are all space."""
    names = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_name").distinct().collect()]
    odd = ["a", "b", "ab", "axb", "abcdefgh", "axbxcxdxexfxgxhx", "net sale", "sale  net", "\u00e9t\u00e9 \U0001f642", "\U0001f642 ete", " ", "\t", "0 1", "1 01"]
    for keys in (sorted(set(names)), odd):
        given = spark.createDataFrame([(x,) for x in [*keys, *keys, "", None]], "metric_key string")
        found = {(r.key_a, r.key_b): r.score for r in resolve.lexical_links(given, least).collect()}
        assert found == by_brute_force(keys, least)


def test_lexical_links_query(spark):
    keys = sorted({r[0] for r in spark.read.parquet(f"{SF}/part.parquet").select(text.metric_key(F.col("p_name"))).collect()})
    assert {(r.key_a, r.key_b): r.score for r in entry.queries()["lexical_links"](spark, SF).collect()} == by_brute_force(keys, 60.0)


def joined_rows(node):
    """The most rows that a join of an executed plan gave."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return joined_rows(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return joined_rows(node.plan())
    own = node.metrics().apply("numOutputRows").value() if "Join" in name and node.metrics().contains("numOutputRows") else 0
    return max([own, *[joined_rows(node.children().apply(i)) for i in range(node.children().size())]])


@pytest.mark.parametrize("name", ["cross_block_pairs", "adjudication_budget", "cross_block_sizes", "metric_adjudication"])
def test_copies_of_parts_do_not_meet(spark, tmp_path, name):
    """Fifty copies of every part: the rows of the SQL, and no join that gives more than the pairs of distinct names of a type and brand, or of classes."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT p.* REPLACE (p_partkey + 200 * i AS p_partkey) FROM range(50) r(i), '{SF}/part.parquet' p) TO '{tmp_path}/part.parquet'")
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    found = entry.queries()[name](spark, str(tmp_path))
    rows = sorted(map(str, map(tuple, found.collect())))
    assert rows == sorted(map(str, con.sql(f"SELECT {', '.join(found.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()))
    distinct = con.sql("WITH d AS (SELECT DISTINCT p_name, p_type, p_brand FROM part) SELECT count(*) FROM d a JOIN d b USING (p_type, p_brand)").fetchall()[0][0]
    assert joined_rows(found._jdf.queryExecution().executedPlan()) <= max(distinct, len(rows))


@pytest.mark.parametrize("name", ["adjudication_budget", "cross_block_sizes", "metric_adjudication"])
def test_names_of_many_types_and_brands_meet_once(spark, tmp_path, name):
    """600 names of twelve types and brands each, some of two or one, and nulls: the rows of the SQL, and no join that gives a pair for every type and brand that its names share."""
    con = duckdb.connect()
    many = "SELECT 'part ' || n AS p_name, 'B' || (k % 4) AS p_brand, 'T' || (k // 4) AS p_type FROM range(600) a(n), range(12) b(k)"
    few = "SELECT 'some ' || n, 'B' || (k * n % 5), 'T' || (n % 4) FROM range(40) a(n), range(2) b(k)"
    odd = "VALUES ('lone', 'B9', 'T9'), ('part 1', 'B9', 'T8'), (NULL, 'B1', 'T1'), ('part 2', NULL, 'T7'), ('part 3', NULL, 'T7'), ('', 'B3', 'T0')"
    if "adjudication" in name:  # the others make ids of types
        odd += ", ('part 2', 'B7', NULL), ('part 3', 'B7', NULL), ('lone', 'B7', NULL)"
    con.sql(f"COPY (SELECT row_number() OVER () AS p_partkey, p_name, p_brand, p_type FROM ({many} UNION ALL {few} UNION ALL {odd})) TO '{tmp_path}/part.parquet'")
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    query = entry.oracle_sql()[name]
    n_rows = con.sql(f"SELECT count(*) FROM ({query})").fetchall()[0][0]
    found = entry.queries()[name](spark, str(tmp_path))
    rows = found.collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, con.sql(f"SELECT {', '.join(found.columns)} FROM ({query})").fetchall()))
    assert joined_rows(found._jdf.queryExecution().executedPlan()) <= n_rows


def all_joined_rows(node):
    """The rows that each join of an executed plan gave."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return all_joined_rows(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return all_joined_rows(node.plan())
    own = [node.metrics().apply("numOutputRows").value()] if "Join" in name and node.metrics().contains("numOutputRows") else []
    return own + [n for i in range(node.children().size()) for n in all_joined_rows(node.children().apply(i))]


@pytest.mark.parametrize("name", ["cross_block_sizes", "cross_block_pairs"])
def test_classes_meet_without_pairs_of_names(spark, tmp_path, name):
    """300 names of two types, three of 300 types, ids that two classes share, copies, parts without a brand: the rows of the SQL, and pairs of names are not given by a join and joined again."""
    con = duckdb.connect()
    many = "SELECT 'part ' || n AS p_name, 'B' || (n % 2) AS p_brand, 'T' || k AS p_type FROM range(300) a(n), range(2) b(k), range(2)"
    wide = "SELECT 'wide' || repeat('x', n::INT), 'B7', 'W' || k FROM range(3) a(n), range(300) b(k)"
    odd = "VALUES ('a:b', 'B1', 'c'), ('a', 'B1', 'b:c'), ('a', 'B1', 'b:c'), ('a:b', 'B2', 'S'), ('a', 'B2', 'S'), ('a', 'B2', 'b:S'), ('part 1', NULL, 'T9'), ('part 2', NULL, 'T1'), (NULL, 'B1', 'T1'), ('lone', 'B8', 'T1')"
    con.sql(f"COPY (SELECT row_number() OVER () AS p_partkey, p_name, p_brand, p_type FROM ({many} UNION ALL {wide} UNION ALL {odd})) TO '{tmp_path}/part.parquet'")
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    found = entry.queries()[name](spark, str(tmp_path))
    rows = found.collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, con.sql(f"SELECT {', '.join(found.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()))
    names = con.sql("SELECT count(*) FROM (SELECT DISTINCT a.p_name, b.p_name FROM part a JOIN part b USING (p_type, p_brand) WHERE a.p_name < b.p_name)").fetchall()[0][0]
    assert sum(sorted(all_joined_rows(found._jdf.queryExecution().executedPlan()))[:-1]) < names


def test_only_open_pairs_meet_answers(spark, tmp_path):
    """Names of all lengths: the rows of the SQL, and answers are joined with no pairs that wording decides."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT row_number() OVER () AS p_partkey, repeat('x', (n % 37)::INT) || n AS p_name, 'B' || (n % 3) AS p_brand, 'T' || (k * n % 4) AS p_type FROM range(300) a(n), range(3) b(k)) TO '{tmp_path}/part.parquet'")
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    found = entry.queries()["metric_adjudication"](spark, str(tmp_path))
    rows = found.collect()
    wanted = con.sql(f"SELECT {', '.join(found.columns)} FROM ({entry.oracle_sql()['metric_adjudication']})").fetchall()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, wanted))
    undecided = sum(r[3] in ("llm", "lexical") for r in wanted)
    assert {r[3] for r in wanted} == {"lexical_high", "blocked", "llm", "lexical"}
    assert sum(all_joined_rows(found._jdf.queryExecution().executedPlan())) <= undecided
