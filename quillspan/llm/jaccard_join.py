"""Near duplicates: a Jaccard join on five-word shingles by chosen paths.

Words are lower-cased runs of what is not white space. A text's set holds its five-word shingles (of a text of one to
four words: the words together), as 64-bit hashes. Texts with equal sets form one class; classes are joined:

1. A class is embedded as 128 minhashes, so that two classes agree on a position with a chance of their similarity.
2. A run chooses paths: at every node each position is chosen with chance 1 / (LOOSE * 128), and a set goes on to the
   child named by that position and the minhash there, so similar sets share a path and others part quickly. Nodes
   with BUCKET sets or fewer end. Larger ones are split again and again, until splitting no longer lowers the number of
   pairs below them (their sets are alike, so comparing them is the work there is).
3. Runs are repeated until a pair at the threshold meets with the target recall, however deep its nodes are split
   (`runs_for`, from the chance that a path never dies out).
4. Ended nodes are compared all with all, in tiles of two blocks at most, so that a node of any size is spread over
   tasks; blocks are bounded in sets and in members, so long texts make more of them. A pair is looked at in the
   smallest node that it shares, only there. First the minhashes are compared, then, for the pairs that may reach the
   threshold, the whole sets, exactly.
5. Tasks return, per set, how many it is linked to and the smallest member of its component in the tile: rows grow with
   the sets and not with the pairs. Components are joined by label propagation with pointer jumping, on written tables.

What is found is exact; what is missed is at most the recall's complement per pair at the threshold, and less above it.

Sets and rows are told apart by digests, never by id alone: rows with one id and different texts are different documents,
and a row without an id is linked like any other. class_id is the smallest id of a class, null if none of its rows has one.
A null or empty text has no words, no links and a class of its own. Repeated rows share a class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999  # of pairs at the threshold, in nodes of any depth; in those of the first look it is 0.99999
POSITIONS = 128
#: The similarity at which a path just survives; paths of pairs at the threshold branch by THRESHOLD / LOOSE.
LOOSE = 0.6
#: Pairs whose sketches agree on a smaller share are not compared: the threshold less four standard deviations.
SKETCH = 0.65
FIRST, LEVELS = 2, 2  # positions chosen before the first look at the nodes, and between two looks after it
BUCKET = 64
#: A node is split further only if its pairs agree on a smaller share of minhashes: splitting leaves about (share / LOOSE) ** LEVELS of them.
ALIKE = 0.5
DEEPEST = 40  # positions; what is still large there is compared as it is
BLOCK, BLOCK_MEMBERS = 512, 400_000
WORD_CACHE = 300_000

_rng = np.random.default_rng(20240229)
_ODD = _rng.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _rng.integers(0, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, POSITIONS, dtype=np.uint64)
_POS = _rng.integers(0, 2**63, POSITIONS, dtype=np.uint64)


def runs_for(recall: float, threshold: float = THRESHOLD) -> int:
    """Runs after which a pair at the threshold has met with chance recall, in nodes of any depth."""
    alive = 1.0
    for _ in range(1000):
        alive = 1 - math.exp(-threshold / LOOSE * alive)
    if alive < 1e-6:
        raise ValueError(f"paths of pairs with a similarity of {threshold} die out: it must be above {LOOSE}")
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORD_CACHE:
            self[word] = value
        return value


def shingles(text: str | None, hashes: _Hashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.array([hashes[x] for x in words], dtype=np.uint64)
    n = max(1, len(w) - SHINGLE + 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(w))):
        h += _mix(w[k : k + n] + _ODD[k]) * _ODD[k]
    return np.unique(_mix(h))


def minhashes(s: np.ndarray) -> np.ndarray:
    low = np.full(POSITIONS, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(s), 1024):
        np.minimum(low, (s[i : i + 1024, None] * _MUL + _ADD).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def signatures(df: DataFrame, text: str, id_: str) -> DataFrame:
    """(id, th, key, n, sig) of each row: a hash of the text, the digest of its set, the set's size and the minhashes (null without words); written."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = _Hashes()
        for batch in batches:
            keys, sizes, sigs = [], [], []
            for t in batch.column(2):
                s = shingles(t.as_py(), hashes)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sizes.append(len(s))
                sigs.append(minhashes(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())], names=["id", "th", "key", "n", "sig"])

    return scratch.keep(scratch.map_batches(_rows(df, text, id_), sign, "id bigint, th bigint, key binary, n int, sig binary"), "near-sigs")


def _rows(df: DataFrame, text: str, id_: str) -> DataFrame:
    return df.select(F.col(f"`{id_}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("t"))


def _descend(paths: np.ndarray, owner: np.ndarray, sig: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """The paths that go on from these by so many chosen positions, and the row of sig that each belongs to."""
    chance = np.uint64(int(2**64 / (LOOSE * POSITIONS)))
    for _ in range(levels):
        nodes, place = [], []
        for i in range(0, len(paths), 16_384):
            row, pos = np.nonzero(_mix(paths[i : i + 16_384, None] ^ _POS) < chance)
            nodes.append(row + i)
            place.append(pos)
        if not nodes:
            break
        at, pos = np.concatenate(nodes), np.concatenate(place)
        owner = owner[at]
        paths = _mix(paths[at] * np.uint64(0x9E3779B97F4A7C15) + _POS[pos] + sig[owner, pos].astype(np.uint64))
    return paths, owner


def _paths(rows: DataFrame, roots: int | None, levels: int) -> DataFrame:
    """(path, cid, n, probe) so many positions further on: from `roots` roots (the runs), or from each row's own path. probe: the set's minhash at a position that the path picks."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 2000):
                part = batch.slice(a, 2000)
                sig = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype="<u4").reshape(-1, POSITIONS)
                owner = np.arange(len(part))
                if roots:
                    start = np.tile(_mix(np.arange(1, roots + 1, dtype=np.uint64)), len(part))
                    owner = np.repeat(owner, roots)
                else:
                    start = part.column(3).to_numpy().view(np.uint64)
                paths, owner = _descend(start, owner, sig, levels)
                probe = sig[owner, (_mix(paths) % np.uint64(POSITIONS)).astype(np.int64)].view(np.int32)
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), part.column(0).take(take), part.column(1).take(take), pa.array(probe)], names=["path", "cid", "n", "probe"])

    return scratch.map_batches(rows.select("cid", "n", "sig", *([] if roots else ["path"])), walk, "path bigint, cid bigint, n int, probe int")


def _shared(paths: DataFrame) -> DataFrame:
    """(path, cid, probe, m, s) of the nodes that hold two sets or more; m: how many, s: their members. Only rows of such nodes are joined. Written."""
    paths = scratch.keep(paths, "near-paths")
    counts = scratch.keep(paths.groupBy("path").agg(F.count("*").alias("m"), F.sum("n").alias("s")).filter("m > 1"), "near-nodes", light=True)
    mine = scratch.with_maybe(paths, scratch.key_filter(counts, "path"), "hit", "path").filter("hit")
    return scratch.keep(mine.select("path", "cid", "probe").join(counts, "path"), "near-members", light=True)


def _ended(classes: DataFrame, runs: int) -> DataFrame:
    """(path, cid, m, s) of the nodes in which sets are compared; written."""
    of = ("path", "cid", "m", "s")
    found = _shared(_paths(classes, runs, FIRST))
    ended = found.filter(F.col("m") <= BUCKET).select(*of)
    for depth in range(FIRST, DEEPEST + LEVELS, LEVELS):
        large = found.filter(F.col("m") > BUCKET)
        if large.isEmpty():
            break
        if depth >= DEEPEST:
            ended = ended.unionByName(large.select(*of))
            break
        same = large.groupBy("path", "probe").agg(F.count("*").alias("c")).groupBy("path").agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"))
        alike = scratch.keep(same.filter(F.col("same") >= ALIKE * F.col("m") * (F.col("m") - 1)).select("path"), "near-alike", light=True)
        ended = ended.unionByName(large.join(alike, "path", "left_semi").select(*of))
        rest = scratch.keep(large.join(alike, "path", "left_anti").select("path", "cid"), "near-large", light=True)
        if rest.isEmpty():
            break
        found = _shared(_paths(rest.join(classes.select("cid", "n", "sig"), "cid"), None, LEVELS))
        ended = ended.unionByName(found.filter(F.col("m") <= BUCKET).select(*of))
    return scratch.keep(ended, "near-ended", light=True)


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, of a stream sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(len(batch) - 1, dtype=bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


_TILE = ("path", "a", "b")


def _pairs_by_sketch(rows: DataFrame, parts: int) -> DataFrame:
    """(path, a, b, cid, mates): per tile the sets with a pair that may reach the threshold, and as bits which of the others, in order of cid."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for tile in _groups(batches, _TILE):
            m = len(tile)
            if m < 2:
                continue
            path, a, b = (tile.column(k)[0].as_py() for k in _TILE)
            sketch = np.frombuffer(b"".join(tile.column("sketch").to_pylist()), dtype=np.uint8).reshape(m, POSITIONS)
            near = np.zeros((m, m), dtype=bool)
            for i in range(m - 1):
                near[i, i + 1 :] = (sketch[i + 1 :] == sketch[i]).sum(axis=1) >= SKETCH * POSITIONS
            if a != b:  # pairs within one block belong to that block's own tile
                block = tile.column("block").to_numpy()
                near &= block[:, None] != block
            if not near.any():
                continue
            nodes = tile.column("nodes").combine_chunks()
            flat, ends = nodes.values.to_numpy(), nodes.offsets.to_numpy()
            owner = np.repeat(np.arange(m), np.diff(ends))
            flat = flat[ends[0] : ends[-1]]
            before = flat < path
            if before.any():  # a pair that shares a smaller node is looked at there
                near &= _together(m, owner[before], flat[before]) < 0.5
            near |= near.T
            some = np.flatnonzero(near.any(axis=1))
            bits = np.packbits(near[np.ix_(some, some)], axis=1)
            ids = tile.column("cid").to_numpy()[some]
            out += [(path, a, b, int(i), row.tobytes()) for i, row in zip(ids, bits, strict=True)]
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[*_TILE, "cid", "mates"])

    sorted_ = rows.repartition(parts, *_TILE).sortWithinPartitions(*_TILE, "cid")
    return scratch.map_batches(sorted_, compare, "path bigint, a int, b int, cid bigint, mates binary")


def _shared_counts(sets: list[np.ndarray], near: np.ndarray) -> np.ndarray:
    """How many members the sets of each marked pair share."""
    m = len(sets)
    if near.sum() <= 8 * m:
        count = np.zeros((m, m), dtype=np.float32)
        for i, j in zip(*np.nonzero(np.triu(near)), strict=True):
            count[i, j] = count[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return count
    return _together(m, np.repeat(np.arange(m), [len(s) for s in sets]), np.concatenate(sets))


def _together(m: int, owner: np.ndarray, names: np.ndarray) -> np.ndarray:
    """How many names each two of m owners have both, for names that no owner has twice; some thousand names at a time."""
    _, column, times = np.unique(names, return_inverse=True, return_counts=True)
    twice = times[column] > 1  # what one owner has alone is shared by none
    owner, column = owner[twice], np.unique(column[twice], return_inverse=True)[1]
    count = np.zeros((m, m), dtype=np.float32)
    by_column = np.argsort(column, kind="stable")
    owner, column = owner[by_column], column[by_column]
    for a in range(0, int(column.max(initial=-1)) + 1, 8192):
        i, j = np.searchsorted(column, (a, a + 8192))
        held = np.zeros((m, 8192), dtype=np.float32)
        held[owner[i:j], column[i:j] - a] = 1
        count += held @ held.T
    return count


def _links(rows: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(cid, links, root): per tile and set the documents of the sets that are similar, and the smallest of its component there."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _groups(batches, _TILE):
            m = len(tile)
            ids, copies = tile.column("cid").to_numpy(), tile.column("copies").to_numpy()
            sets = [np.frombuffer(x, dtype="<u8") for x in tile.column("members").to_pylist()]
            mates = np.frombuffer(b"".join(tile.column("mates").to_pylist()), dtype=np.uint8).reshape(m, -1)
            near = np.unpackbits(mates, axis=1, count=m).astype(bool)
            size = np.array([len(s) for s in sets], dtype=np.float64)
            shared = _shared_counts(sets, near)
            linked = near & (shared >= threshold * (size[:, None] + size - shared) - 1e-9)
            some = np.flatnonzero(linked.any(axis=1))
            if not len(some):
                continue
            linked = linked[np.ix_(some, some)]
            root = np.arange(len(some))
            while True:  # ids ascend, so the smallest place is the smallest id
                low = np.minimum(root, np.where(linked, root, len(some)).min(axis=1))
                if (low == root).all():
                    break
                root = low[low]
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(linked @ copies[some].astype(np.int64)), pa.array(ids[some][root])], names=["cid", "links", "root"])

    sorted_ = rows.repartition(parts, *_TILE).sortWithinPartitions(*_TILE, "cid")
    return scratch.map_batches(sorted_, verify, "cid bigint, links bigint, root bigint")


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for the ends of edges (u, v): the smallest id of the component. Tables are written between rounds."""
    both = scratch.keep(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "cc-edges", light=True)
    labels = scratch.keep(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("u"), F.min("v")).alias("label")), "cc-labels", light=True)
    while True:
        heard = both.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, "id").select("id", F.col("label").alias("old"), F.least("label", "heard").alias("near"))
        jumped = nearer.join(labels.select(F.col("id").alias("near"), F.col("label").alias("far")), "near", "left")
        after = scratch.keep(jumped.select("id", F.least("near", "far").alias("label"), (F.least("near", "far") < F.col("old")).alias("moved")), "cc-labels", light=True)
        labels = after.select("id", "label")
        if after.filter("moved").isEmpty():
            return labels


def _classes(signed: DataFrame) -> DataFrame:
    """(key, n, sig, id, copies, best, cid): one row per set; best is the row of it that stays before all others: with an id, the smallest, and of one id by digests. Written."""
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "th"))
    per_set = signed.filter("n > 0").groupBy("key", "n", "sig").agg(F.min("id").alias("id"), F.count("*").alias("copies"), best.alias("best"))
    return scratch.keep(per_set.withColumn("cid", F.monotonically_increasing_id()), "near-classes", light=True)  # read back, so a number stays with its set


def _decided(df: DataFrame, signed: DataFrame, text: str, id_: str, threshold: float, recall: float) -> DataFrame:
    """(key, class_id, n_links, best, alone) per set with words: its class, the links of each of its rows, the class's row that stays, and whether that is its only row."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes = _classes(signed)
    ended = _ended(classes.select("cid", "n", "sig"), runs_for(recall, threshold))
    # Tiles: block i meets block j of the same node in tile (i, j), i <= j.
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("s") / BLOCK_MEMBERS)).cast("int")
    own = ended.select("path", "cid", F.pmod(F.xxhash64("cid"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    tiles = own.select("path", "cid", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    sketch = F.unhex(F.regexp_replace(F.hex("sig"), "(..)......", "$1"))  # the first byte of each minhash
    known = ended.groupBy("cid").agg(F.sort_array(F.collect_set("path")).alias("nodes")).join(classes.select("cid", sketch.alias("sketch")), "cid")
    near = scratch.keep(_pairs_by_sketch(tiles.join(known, "cid"), parts), "near-pairs")
    # Whole sets of those in a pair, each from one of its rows.
    wanted = scratch.keep(near.select("cid").distinct().join(classes.select("cid", "key", "copies", "best.id", "best.th"), "cid"), "near-wanted", light=True)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = _Hashes()
        for batch in batches:
            for a in range(0, len(batch), 500):
                sets = [shingles(t, hashes).tobytes() for t in batch.column(0).slice(a, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["key", "members"])

    texts = scratch.with_maybe(_rows(df, text, id_), scratch.key_filter(wanted, "id", "th"), "hit", "id", "th").filter("hit").select("t")
    sets = scratch.map_batches(texts, members, "key binary, members binary").join(wanted.select("cid", "key", "copies"), "key").dropDuplicates(["cid"])
    links = scratch.keep(_links(near.join(sets.select("cid", "copies", "members"), "cid"), threshold, parts), "near-links")
    label = components(links.filter("cid <> root").select(F.col("cid").alias("u"), F.col("root").alias("v"))).withColumnRenamed("id", "cid")
    whole = label.join(classes.select("cid", "id", "best"), "cid").groupBy("label").agg(F.min("id").alias("first_id"), F.min("best").alias("first"))
    per_class = classes.select("key", "cid", "id", "copies", "best").join(links.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left").join(label, "cid", "left").join(whole, "label", "left")
    linked = F.col("label").isNotNull()
    return per_class.select(
        "key", F.when(linked, F.col("first_id")).otherwise(F.col("id")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("first", "best").alias("best"), (~linked & (F.col("copies") == 1)).alias("alone"))


def near_duplicates(df: DataFrame, text: str = "text", id_: str = "doc_id", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(id, class_id, n_links) of every row.

    class_id is the smallest id of those linked to the row directly or through others; n_links counts the other rows with a
    similarity of threshold or more.
    """
    signed = signatures(df, text, id_)
    per_class = _decided(df, signed, text, id_, threshold, recall)
    by_row = signed.filter("n > 0").select("id", "key").join(per_class, "key").select("id", "class_id", "n_links")
    return by_row.unionByName(signed.filter("n = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_first(df: DataFrame, text: str = "text", id_: str = "doc_id", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """df's rows that are the first of their class, with df's columns: of each class one row, that with the smallest id, and of one id one by digest. Rows without words stay."""
    signed = signatures(df, text, id_)
    per_class = _decided(df, signed, text, id_, threshold, recall).filter("NOT alone").select("key", "best")
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("th") == F.col("best.th")) & (F.col("key") == F.col("best.key"))
    members = signed.filter("n > 0").select("id", "th", "key").join(per_class, "key").groupBy("id", "th").agg(F.max(stays).alias("once"), F.count("*").alias("copies"))
    # Rows that go, and those of which only one may stay; all others pass without a join.
    members = scratch.keep(members.filter("NOT once OR copies > 1").select("id", "th", "once"), "near-result", light=True)
    rows = df.select(F.struct(*scratch.names(df)).alias("row"), F.col(f"`{id_}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("th"))
    marked = scratch.with_maybe(rows, scratch.key_filter(members, "id", "th"), "maybe", "id", "th")
    asked = marked.filter("maybe").alias("a").join(members.alias("m"), F.col("a.id").eqNullSafe(F.col("m.id")) & (F.col("a.th") == F.col("m.th")), "left")
    single = asked.filter("once").select("a.row", "a.id", "a.th").dropDuplicates(["id", "th"]).select("row")
    return marked.filter("NOT maybe").select("row").unionByName(asked.filter("once IS NULL").select("a.row")).unionByName(single).select("row.*")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links")
