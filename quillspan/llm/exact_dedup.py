"""Exact duplicates through a log-structured merge index of digests.

- Memtables: slices of the input, each merged to one entry (digest, smallest id, count) per digest before it is flushed.
- Flush: every slice becomes a run of Parquet files sorted by digest, with Parquet's bloom filters and min/max statistics
  on the digest, so that a lookup of some digests (`lookup`) skips the files and row groups without them.
- Compaction: all runs merge into one; the smallest id and the summed count stay.
- Verification: digests with a count over one are hits. A key filter of fixed size brings only the rows that may be hits
  to a grouping by digest and whole normalised text, that is, byte by byte. What that grouping says holds: texts that
  differ are never merged, whatever their digests.

Texts are equal when identical after each run of [space, \\t \\n \\v \\f \\r] becomes one space; null counts as empty. Of equal texts
the row with the smallest doc_id stays (a null doc_id counts as larger than any other); of wholly repeated rows exactly one stays.
A group's copies are merged before they are shuffled, and the join back to the rows is one that Spark splits when skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

RUNS = 8
_KEY = ("sha", "h2", "len")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _digests(df: DataFrame, text: Column, id_: Column) -> DataFrame:
    """One row (id, sha, h2, len) per row: a SHA-256 and, to tell apart texts that it might not, a second hash and the length."""
    return df.select(id_.alias("id"), normalised(text).alias("norm")).select("id", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), F.xxhash64("norm").alias("h2"), F.octet_length("norm").alias("len"))


def flush(digests: DataFrame, runs: int = RUNS) -> DataFrame:
    """The memtables' sorted runs, written."""
    merged = digests.withColumn("run", F.pmod(F.xxhash64("id"), F.lit(runs)).cast("int")).groupBy("run", *_KEY).agg(F.min("id").alias("id"), F.count("*").alias("n"))
    parts = int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scratch.keep(merged.repartitionByRange(parts, "run", "sha"), "lsm-runs", sort=("run", "sha"), options={"parquet.bloom.filter.enabled#sha": "true", "parquet.bloom.filter.adaptive.enabled": "true"}, by="run")


def compact(runs: DataFrame) -> DataFrame:
    """One entry per digest: the smallest id and the number of rows."""
    return runs.groupBy(*_KEY).agg(F.min("id").alias("id"), F.sum("n").alias("n"))


def lookup(runs: DataFrame, shas: list[str]) -> DataFrame:
    """The entries of some digests; the predicate reaches the runs' bloom filters and statistics."""
    return compact(runs.filter(F.col("sha").isin(shas)))


def verified_groups(df: DataFrame, text: Column, id_: Column, index: DataFrame) -> DataFrame:
    """(sha, h2, len, keep_id, n) of each group of equal texts with two rows or more, and of some single rows; compared as whole texts."""
    hits = scratch.key_filter(scratch.keep(index.filter("n > 1").select("sha"), "lsm-hits"), "sha")
    rows = df.select(id_.alias("id"), normalised(text).alias("norm")).withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256))
    rows = scratch.with_maybe(rows, hits, "hit", "sha").filter("hit")
    groups = rows.groupBy("sha", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))
    return groups.select("sha", F.xxhash64("norm").alias("h2"), F.octet_length("norm").alias("len"), "keep_id", "n")


def decide(df: DataFrame, text: Column, id_: Column) -> tuple[DataFrame, DataFrame]:
    """Each row's (id, sha, h2, len), and the verified groups; both written."""
    digests = scratch.keep(_digests(df, text, id_), "digests")
    index = compact(flush(digests))
    return digests, scratch.keep(verified_groups(df, text, id_, index), "lsm-groups")


def duplicate_report(df: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """One row per row of df: id, keep_id, group_size, kept, sha."""
    digests, groups = decide(df, F.col(text), F.col(id_))
    rows = digests.groupBy("id", *_KEY).agg(F.count("*").alias("copies"))  # a row that is repeated as a whole keeps one place
    found = rows.join(groups, list(_KEY), "left").select(
        "id", "sha", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", "copies").alias("group_size"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    )
    return found.select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "sha")


def drop_duplicates(df: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """df's rows that stay, with df's columns. Only rows whose id may be that of a group's member travel; the others go straight through."""
    digests, groups = decide(df, F.col(text), F.col(id_))
    member = digests.join(groups.filter("n > 1"), list(_KEY)).groupBy("id", *_KEY).agg(F.count("*").alias("copies"), F.first("keep_id").alias("keep_id"))
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    member = scratch.keep(member.filter(~kept | (F.col("copies") > 1)).select("id", *_KEY, kept.alias("once")), "lsm-members")
    rows = df.select(F.struct(*scratch.names(df)).alias("row"), F.col(id_).alias("id"), F.col(text).alias("txt"))
    rows = scratch.with_maybe(rows, scratch.key_filter(member, "id"), "maybe", "id")
    straight = rows.filter(~F.col("maybe")).select("row")
    norm = normalised(F.col("txt"))
    asked = rows.filter("maybe").withColumns({"sha": F.sha2(norm.cast("binary"), 256), "h2": F.xxhash64(norm), "len": F.octet_length(norm)})
    on = asked["id"].eqNullSafe(member["id"])
    for c in _KEY:
        on = on & (asked[c] == member[c])
    joined = asked.join(member, on, "left").select("row", asked["id"], asked["h2"], "once")
    single = joined.filter("once").dropDuplicates(["id", "h2"]).select("row")
    return straight.unionByName(joined.filter("once IS NULL").select("row")).unionByName(single).select("row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicate_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM d
"""
