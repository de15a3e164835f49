"""Sharding by sampled splitters: near-equal bytes in every shard, whatever the keys look like.

1. A sample of keys is drawn, each row with a chance that grows with its size (and, by half, with the mere fact that it
   is a row, so that neither bytes nor rows can pile up in one range). The draw is a hash of the key, so a rerun draws
   the same rows. Its expected size is a parameter and does not depend on the input.
2. The sample's weighted quantiles are the splitters of key ranges, 16 to 256 of a shard, so that a range holds about
   ROWS_PER_RANGE rows however large the table.
3. Rows are range-partitioned; exact bytes and rows per range give every range its offset in the whole.
4. A range that is overfull, or lies across the end of a shard, is subdivided at the row where the running size passes
   the shard's end. The order within a range goes on with a tie column, so one key with a third of all rows is cut as well.

The law that holds is ``bytes``: a shard's size differs from total / n by less than the largest row.

Nulls: a null key sorts as 0 and a null size counts as 0. Repeated rows stay separate rows next to each other. An empty
table gives an empty result. Input columns called shard or slot are replaced by the operator's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch

_LEAST = -(2**63)
_STEP = 64
ROWS_PER_RANGE = 500_000
LEAST_RANGES, MOST_RANGES = 16, 256  # of a shard


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are at or below (k, t): a search in two levels of _STEP."""
    if not splitters:
        return F.lit(0)
    zipped = lambda some: F.arrays_zip(*(F.lit([x[i] for x in some]).cast("array<bigint>").alias(c) for i, c in enumerate("kt")))
    pairs = zipped(splitters)
    coarse = splitters[_STEP - 1 :: _STEP]
    here = F.struct(F.col("k"), F.col("t"))
    below = lambda a: F.size(F.filter(a, lambda x: x <= here))
    if not coarse:
        return below(pairs)
    top = below(zipped(coarse))
    return top * _STEP + below(F.slice(pairs, top * _STEP + 1, _STEP - 1))


def shard_by_size(df: DataFrame, n_shards: int, key: Column, size: Column, tie: Column, *, samples_per_range: int = 32, seed: int = 17) -> DataFrame:
    """df's rows and columns with shard int (0 to n_shards - 1, in key order) and slot long (gapless from 0 in its shard).

    key and tie give longs, size a long of at least 0.
    """
    rows = df.select(F.struct(*scratch.names(df)).alias("row"), F.coalesce(key.cast("long"), F.lit(0)).alias("k"), F.coalesce(tie.cast("long"), F.lit(_LEAST)).alias("t"), F.coalesce(size.cast("long"), F.lit(0)).alias("w"))
    rows = scratch.keep(rows, "shard-rows")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    n_ranges = n_shards * min(MOST_RANGES, max(LEAST_RANGES, n // (n_shards * ROWS_PER_RANGE)))
    share = F.col("w") / F.lit(2.0 * max(total, 1)) + F.lit(0.5 / max(n, 1))
    expected = share * (n_ranges * samples_per_range)
    draw = F.pmod(F.xxhash64("k", "t", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    # Rows alike in key and tie are drawn together, so they are merged before they are gathered: the sample stays near its expected size.
    drawn = rows.filter(draw < expected).groupBy("k", "t").agg(F.max(F.greatest(expected, F.lit(1.0))).alias("c"))
    sample = sorted(map(tuple, drawn.collect()))
    splitters, passed, weight = [], 0.0, sum(c for *_, c in sample)
    for k, t, c in sample:
        if passed >= (len(splitters) + 1) * weight / n_ranges and (not splitters or (k, t) > splitters[-1]):
            splitters.append((k, t))
        passed += c
    ranged = rows.withColumn("r", _range_of(splitters[: n_ranges - 1]))
    held = {r: (b, c) for r, b, c in ranged.groupBy("r").agg(F.sum("w"), F.count("*")).collect()}
    bytes_before, rows_before, b, c = [], [], 0, 0
    for r in range(len(splitters) + 1):
        bytes_before.append(b)
        rows_before.append(c)
        b, c = b + held.get(r, (0, 0))[0], c + held.get(r, (0, 0))[1]
    at = lambda values: F.element_at(F.lit(values).cast("array<bigint>"), F.col("r") + 1)
    order = W.partitionBy("r").orderBy("k", "t", "w")
    ordered = ranged.select("row", "w", (at(bytes_before) + F.sum("w").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("w")).alias("b"), (at(rows_before) + F.row_number().over(order) - 1).alias("g"))
    middle = F.expr(f"CAST((b * 2 + w) * {n_shards} div {2 * max(total, 1)} AS INT)")
    placed = scratch.keep(ordered.select("row", "g", F.least(middle, F.lit(n_shards - 1)).alias("s")), "shard-placed")
    first = dict(map(tuple, placed.groupBy("s").agg(F.min("g")).collect()))
    starts = F.element_at(F.lit([first.get(s, 0) for s in range(n_shards)]).cast("array<bigint>"), F.col("s") + 1)
    own = {"shard", "slot"}
    return placed.select(*[F.col(f"row.`{c}`") for c in df.columns if c.lower() not in own], F.col("s").alias("shard"), (F.col("g") - starts).alias("slot"))


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes, ordered by a digest of the text, so that equal texts lie together."""
    text = F.coalesce("text", F.lit(""))
    digest = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("key")
    )
    placed = shard_by_size(digest, 16, F.col("key"), F.col("size"), F.col("doc_id"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP1_SQL = """
WITH tab AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS n))),
     crc AS (SELECT doc_id, coalesce(text, '') AS text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(coalesce(text, '')))), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS crc
             FROM (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents), tab),
     d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, coalesce(text, '') AS text,
                  crc,
                  CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS k FROM crc),
     o AS (SELECT *, sum(size) OVER w - size AS b, sum(size) OVER () AS total, row_number() OVER (ORDER BY k, doc_id, size) - 1 AS g
           FROM d WINDOW w AS (ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING)),
     s AS (SELECT *, CAST(least(15, (b * 2 + size) * 16 // (2 * total)) AS INTEGER) AS shard FROM o)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard, CAST(g - min(g) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
