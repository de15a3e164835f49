"""Token ids in a binary block format: frequency-ranked ids, byte-aligned, with control bytes apart from data bytes.

Encoding has two passes. The first encodes every text with the tokenizers library, keeps the ids, and counts every id
over all documents (a table no longer than the vocabulary). Ids are then ranked by count, so that the commonest take one byte.
The second pass sorts documents by id and writes blocks: for each rank 1 to 4 data bytes, and for every four ranks one
control byte with four 2-bit lengths (less one). A reader decodes a block with numpy: one table lookup per control byte
gives four lengths, their running sum the places of the data bytes.

Files are Parquet containers of blocks, as Spark's writers are what reaches any store: first_doc, docs, tokens per
document, control, data, and where the block starts within its file. A file's own total is all that is needed to place it.

A null text counts as empty and has the end id alone. Documents with one doc_id stay apart, ordered by their ids' checksum; null ids come first.
Other columns of the input are left out, whatever they are called. A vocabulary of more than 16 bits is an error.

Pre-tokenisation never crosses a space that is followed by a visible character, so a text is the sequence of its
stretches from one such space to the next. Stretches repeat: Arrow tells apart those of a few megabytes of text, each is encoded
once per worker while it is remembered, and the texts' ids are gathered from them with numpy.
A text that holds an added token's string, such as <|endoftext|>, gets that token's id there, as from the library by default.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch

BLOCK_TOKENS = 1 << 18
CACHE_CHARS = 10_000_000  # of stretches that a worker remembers
LONGEST = 64  # a longer stretch is not remembered
TOGETHER = 1000  # stretches in one text for the library
_CUT = re.compile(r" (?=\S)")
_WIDE = r" (?:$|[\s\x0b\x1c-\x1f\x{85}\pZ])"  # a space at which a text is not cut; for Arrow
#: Lengths of the four numbers that a control byte describes.
LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], dtype=np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of numbers below 2**32."""
    ranks = ranks.astype("<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    codes[: len(ranks)] = extra
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], dtype=np.uint8)
    used = np.arange(4, dtype=np.uint8) <= extra[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    out = raw[starts].astype(np.uint32)
    for i in range(1, 4):
        more = np.flatnonzero(lengths > i)
        if not len(more):
            break
        out[more] |= raw[starts[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


class Encoder:
    """Ids of texts by a byte-level tokenizer whose pre-tokens start at spaces; made once per worker."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine's cores already; idle threads of a pool would spin
        from tokenizers import Tokenizer

        self.backend = Tokenizer.from_str(tokenizer)
        self.normalises = self.backend.normalizer is not None
        self.added = [t.content for t in self.backend.get_added_tokens_decoder().values()]
        vocabulary = self.backend.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)  # a byte-level token has one character per byte
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        """Each text's ids as little-endian unsigned 16-bit numbers."""
        plain = ~self._uneven(texts)
        out: list[bytes] = [b""] * len(texts)
        for i in np.flatnonzero(~plain).tolist():
            out[i] = self._one(texts[i].as_py())
        some = texts.filter(pa.array(plain))
        if not len(some):
            return out
        parts = pc.split_pattern(some, " ")
        ends = parts.offsets.to_numpy().astype(np.int64)
        body = np.ones(ends[-1], dtype=bool)
        body[ends[:-1]] = False  # what stands before a text's first space is no stretch
        words = parts.values.filter(pa.array(body)).dictionary_encode()
        heads = list(self._ids(parts.values.filter(pa.array(~body)).to_pylist()))
        table = self._stretches(words.dictionary.to_numpy(zero_copy_only=False).tolist()) + heads
        which = np.empty(len(body), dtype=np.int64)
        which[body] = words.indices.to_numpy()
        which[~body] = np.arange(len(table) - len(heads), len(table))
        ids = np.frombuffer(b"".join(table), dtype="<u2")
        size = np.fromiter(map(len, table), np.int64, len(table)) // 2
        n, first = size[which], (np.cumsum(size) - size)[which]
        stop = np.cumsum(n)
        made = memoryview(ids[np.repeat(first - (stop - n), n) + np.arange(stop[-1])].tobytes())
        at = np.concatenate([[0], stop[ends[1:] - 1]]) * 2
        for i, x, y in zip(np.flatnonzero(plain).tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            out[i] = bytes(made[x:y])
        return out

    def _stretches(self, words: list[str]) -> list[bytes]:
        """The ids of each of these different stretches (with the space before it)."""
        if self.chars > CACHE_CHARS:
            self.known.clear()
            self.chars = 0
        found = list(map(self.known.get, words))
        places = [i for i, raw in enumerate(found) if raw is None]
        if places:
            new = [words[i] for i in places]
            raws = self._learn(pa.array(new, pa.string()))
            for i, raw in zip(places, raws, strict=True):
                found[i] = raw
            self.known.update((s, raw) for s, raw in zip(new, raws, strict=True) if len(s) <= LONGEST)
            self.chars += sum(n for n in map(len, new) if n <= LONGEST)
        return found

    def _learn(self, words: pa.StringArray) -> list[bytes]:
        """Stretches go to the library many at a time, as one text; the bytes that each id stands for say where one ends."""
        groups = pa.ListArray.from_arrays(pa.array([*range(0, len(words), TOGETHER), len(words)], pa.int32()), words)
        raw = b"".join(self._ids([" " + g for g in pc.binary_join(groups, " ").to_pylist()]))
        token_ends = np.cumsum(self.n_bytes[np.frombuffer(raw, dtype="<u2")])
        ends = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)
        at = np.searchsorted(token_ends, ends)
        if at[-1] >= len(token_ends) or not np.array_equal(token_ends[at], ends):
            return list(self._ids([" " + w for w in words.to_pylist()]))  # a token across two stretches: not this kind of tokenizer
        stops = ((at + 1) * 2).tolist()
        return [raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def _uneven(self, texts: pa.StringArray) -> np.ndarray:
        """Whether a text holds a space that no visible character follows, or an added token."""
        found = pc.match_substring_regex(texts, _WIDE).to_numpy(zero_copy_only=False).copy()
        for token in self.added:
            found |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if self.normalises:
            found |= np.fromiter((self._has_added(t.as_py()) for t in texts), bool, len(texts))
        return found

    def _one(self, text: str) -> bytes:
        if self._has_added(text):
            return next(self._ids([text]))
        head, *parts = _CUT.split(text)
        different = list(dict.fromkeys(parts))
        table = dict(zip(different, self._stretches(different), strict=True))
        return next(self._ids([head])) + b"".join(map(table.__getitem__, parts))

    def _has_added(self, text: str) -> bool:
        """Whether an added token stands in the text, which then goes to the library whole, as such a token may reach over a space."""
        if any(a in text for a in self.added):
            return True
        return self.normalises and any(a in self.backend.normalizer.normalize_str(text) for a in self.added)

    def _ids(self, texts: list[str]) -> Iterator[bytes]:
        for i in range(0, len(texts), 1000):
            for e in self.backend.encode_batch_fast(texts[i : i + 1000], add_special_tokens=False):
                yield np.array(e.ids, dtype="<u2").tobytes()


def slices(texts: pa.StringArray, size: int = 4_000_000) -> Iterator[pa.StringArray]:
    """The texts in runs of about so many bytes."""
    start = held = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        held += n
        if held >= size:
            yield texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def encode_ids(df: DataFrame, tokenizer: str, end_id: int, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """(id, ids, crc, counts): the ids as little-endian 16-bit numbers with the end id; written. A task's last row has no document but, in counts, how often each id stands in its documents."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    end = np.array([end_id], dtype="<u2").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = scratch.per_worker("token_file", spec, lambda: Encoder(spec))
        if len(encoder.n_bytes) > 1 << 16 or end_id >= 1 << 16:
            raise ValueError("ids of more than 16 bits")
        counts = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            at = 0
            for texts in slices(pc.fill_null(batch.column(1), "")):
                found = [raw + end for raw in encoder.encode(texts)]
                counts += np.bincount(np.frombuffer(b"".join(found), dtype="<u2"), minlength=1 << 16)
                yield rows_of(batch.column(0).slice(at, len(texts)), found, [zlib.crc32(x) for x in found], [None] * len(found))
                at += len(texts)
        if counts.any():
            yield rows_of(pa.array([None], pa.int64()), [None], [None], [counts.astype("<i8").tobytes()])

    def rows_of(ids: pa.Array, raws: list, crcs: list, counts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(raws, pa.binary()), pa.array(crcs, pa.int64()), pa.array(counts, pa.binary())], names=["id", "ids", "crc", "counts"])

    rows = df.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("text"))
    return scratch.keep(scratch.map_batches(rows, encode, "id bigint, ids binary, crc bigint, counts binary", keeps="token_file"), "token-ids", options={"compression": "zstd"})


def ranking(ids: DataFrame) -> np.ndarray:
    """Ids in order of their count over all documents, the commonest first; as long as the highest id that occurs."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.frombuffer(raw.as_py(), dtype="<i8")
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["token", "n"])

    tasks = ids.filter("counts IS NOT NULL").select("counts")
    counts = scratch.map_batches(tasks, listed, "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    total = dict(map(tuple, counts.collect()))
    return np.array(sorted(range(max(total, default=-1) + 1), key=lambda t: (-total.get(t, 0), t)), dtype=np.uint32)


def write_blocks(ids: DataFrame, by_rank: np.ndarray) -> DataFrame:
    """The token file: blocks in ascending order of id; written, and read back."""
    rank_of = np.zeros(len(by_rank), dtype=np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[int | None] = []
        raws: list[bytes] = []
        held = start = number = file = 0
        first = True

        def block() -> pa.RecordBatch:
            nonlocal held, start, number
            control, data = pack(rank_of[np.frombuffer(b"".join(raws), dtype="<u2")])
            sizes = [len(r) // 2 for r in raws]
            row = pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([number], pa.int64()), pa.array([start], pa.int64()), pa.array([sum(sizes)], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                names=["file", "block", "start", "n", "docs", "sizes", "control", "data"],
            )
            start, number, held = start + sum(sizes), number + 1, 0
            docs.clear()
            raws.clear()
            return row

        for batch in batches:
            if first and len(batch):
                file, first = batch.column(2)[0].as_py(), False
            for d, raw in zip(batch.column(0), batch.column(1), strict=True):
                docs.append(d.as_py())
                raws.append(raw.as_py())
                held += len(raws[-1]) // 2
                if held >= BLOCK_TOKENS:
                    yield block()
        if docs:
            yield block()

    sorted_ = ids.filter("ids IS NOT NULL").repartitionByRange(parts, "id", "crc").sortWithinPartitions("id", "crc").select("id", "ids", F.spark_partition_id().alias("file"))
    schema = "file int, block bigint, start bigint, n bigint, docs array<bigint>, sizes array<bigint>, control binary, data binary"
    return scratch.keep(scratch.map_batches(sorted_, blocks, schema), "token-file", options={"compression": "zstd"})


def read_blocks(file: DataFrame, by_rank: np.ndarray) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a token file; start counts the ids of all documents before it."""
    # One row per file: few enough for one window, and for a broadcast.
    totals = file.groupBy("file").agg(F.sum("n").alias("total"))
    offsets = totals.select("file", (F.sum("total").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, 0)) - F.col("total")).alias("offset"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for offset, start, n, docs, sizes, control, data in zip(*(batch.column(c) for c in ("offset", "start", "n", "docs", "sizes", "control", "data")), strict=True):
                lengths = np.array(sizes.as_py(), dtype=np.int64)
                raw = memoryview(by_rank[unpack(control.as_py(), data.as_py(), n.as_py())].astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                starts = ends - lengths + (offset.as_py() + start.as_py())
                yield pa.RecordBatch.from_arrays([docs.values, pa.array(starts), pa.array(lengths), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return scratch.map_batches(file.join(F.broadcast(offsets), "file"), decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ids = encode_ids(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    by_rank = ranking(ids)
    return read_blocks(write_blocks(ids, by_rank), by_rank)
