"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here by its wire format. From it the tokenizer is rebuilt: the normaliser (a precompiled
character map if the model has one, the dummy prefix, spaces as the metaspace marker), the pieces with their scores
(a Unigram model; for a model trained as BPE the scores are merge ranks, so merges are rebuilt from the pieces), and
byte fallback. Decoding concatenates the bytes of the pieces.

No piece of the models supported here holds the marker after another character (checked when the model is loaded), so
a text's encoding is that of its stretches "markers + non-markers" one after the other. Stretches repeat, so each is
encoded once per worker: new ones go to the library in multithreaded batches, and every new stretch's ids are compared
with SentencePiece's own. Where the two differ SentencePiece's ids are used and the stretch counts as a mismatch. Its cache is
bounded; what falls out is encoded again.

A null text counts as empty and has no ids. Repeated rows are encoded alike. Input columns that share a name with a
result are replaced. Each text is encoded in its own row: nothing is shuffled.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

MARK = "▁"
#: Kinds of pieces and of models in the SentencePiece format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
CACHE_CHARS = 1_500_000  # of stretches that a worker remembers
THREADS = "2"  # of the library, in each worker
JOINT = "\x01"
LONGEST = 64  # a longer stretch is not remembered
#: Maximal stretches: markers, then characters that are none.
_STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """What a SentencePiece model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normaliser = {}, {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = normaliser.get(2, b"")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.remove_extra_spaces = bool(normaliser.get(4, 1))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    def separable(self) -> bool:
        return not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))

    def normalised(self, text: str) -> str:
        if self.charsmap:
            from tokenizers import normalizers

            text = normalizers.Precompiled(self.charsmap).normalize_str(text)
        if self.remove_extra_spaces:
            text = re.sub(" +", " ", text).strip(" ")
        if self.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", MARK)

    def tokenizer(self):
        """A tokenizers.Tokenizer for normalised stretches."""
        from tokenizers import Tokenizer, models

        if self.kind == UNIGRAM:
            usable = [(p, s) for p, s, _ in self.pieces]
            return Tokenizer(models.Unigram(usable, unk_id=self.unknown, byte_fallback=self.byte_fallback))
        vocabulary = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        mergeable = {p: (-s, i) for i, (p, s, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
        merges = []
        for piece, rank in mergeable.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in mergeable and right in mergeable:
                    merges.append((rank, vocabulary[left], vocabulary[right], left, right))
        merges.sort()
        return Tokenizer(models.BPE(vocabulary, [(a, b) for *_, a, b in merges], unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback))

    def piece_bytes(self) -> list[bytes]:
        """The bytes each id stands for; control pieces stand for none."""
        return [bytes([int(p[3:5], 16)]) if kind == BYTE else b" \xe2\x81\x87 " if kind == UNKNOWN else b"" if kind in (CONTROL, UNUSED) else p.replace(MARK, " ").encode() for p, _, kind in self.pieces]


class Codec:
    """Encodes and decodes texts; made once per worker."""

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", THREADS)  # more would spin beside the other tasks of the machine
        import sentencepiece

        self.model = Model(model)
        self.backend = self.model.tokenizer()
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.separable = self.model.separable()
        self.piece_bytes = np.array(self.model.piece_bytes(), dtype=object)
        self.ids: dict[str, bytes] = {}
        self.chars = 0
        self.mismatched: set[str] = set()
        self.prefix = self.model.dummy_prefix  # which SentencePiece adds by itself
        pieces = [p for p, *_ in self.model.pieces]
        spelt = JOINT if JOINT in pieces else f"<0x{ord(JOINT):02X}>"
        usable = self.separable and spelt in pieces and not any(JOINT in p and len(p) > 1 for p in pieces)
        self.joint = pieces.index(spelt) if usable else None

    def _sp(self, normalised: str) -> list[int] | None:
        """SentencePiece's ids of a normalised text; None if no plain text gives it."""
        if self.prefix and not normalised.startswith(MARK):
            return None
        plain = normalised[1:] if self.prefix else normalised
        return self.reference.encode(plain.replace(MARK, " ")) if plain else None

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Stretches are encoded many at a time, joined by a character that no longer piece holds, and cut at its id."""
        learnt: dict[str, bytes] = {}
        alone = [s for s in new if self.joint is None or JOINT in s]
        rest = [s for s in new if JOINT not in s] if alone else new
        groups = [] if self.joint is None else [rest[i : i + 2000] for i in range(0, len(rest), 2000)]
        joined = [JOINT.join(g) for g in groups]
        for group, whole, e in zip(groups, joined, self.backend.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ours = e.ids
            ids = np.array(ours, dtype="<i4")
            cuts = np.flatnonzero(ids == self.joint) * 4
            if self._sp(whole) != ours or len(cuts) != len(group) - 1:
                alone += group
            else:
                raw = ids.tobytes()
                learnt.update(zip(group, [raw[i:j] for i, j in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)], strict=True)], strict=True))
        for s, e in zip(alone, self.backend.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            ids, reference = e.ids, self._sp(s)
            if reference is not None and ids != reference:
                self.mismatched.add(s)
                ids = reference
            learnt[s] = np.array(ids, dtype="<i4").tobytes()
        return learnt

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool]]:
        """(ids, whether they agreed with SentencePiece's without a correction) of each text."""
        if self.chars > CACHE_CHARS:
            self.ids.clear()
            self.mismatched.clear()
            self.chars = 0
        cut = [self._stretches(self.model.normalised(t)) for t in texts]
        new = sorted(set().union(*cut).difference(self.ids))
        learnt = self._learn(new) if new else {}
        self.ids.update(learnt)
        out = [(np.frombuffer(b"".join([self.ids[s] for s in stretches]), dtype="<i4"), not self.mismatched or self.mismatched.isdisjoint(stretches)) for stretches in cut]
        for s in new:
            if len(s) > LONGEST:
                del self.ids[s]
            else:
                self.chars += len(s)
        return out

    def _stretches(self, normalised: str) -> list[str]:
        if not self.separable:
            return [normalised] if normalised else []
        parts = normalised.split(MARK)
        if parts[0] == "" and "" not in parts[1:]:  # the usual text: single spaces, none at the end
            return [MARK + p for p in parts[1:]]
        return _STRETCH.findall(normalised)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(self.piece_bytes[ids]).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def slices(values: list[str], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of values of about so many characters."""
    start = held = 0
    for i, v in enumerate(values):
        held += len(v)
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(values):
        yield start, len(values)


def encode_texts(df: DataFrame, model: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """df without the text, with ids array<int> (if asked for), n_tokens, ids_crc32, round_trip (decoding gives the text back) and parity.

    model is the path of a model file that the driver can read; its bytes travel with the task.
    """
    with open(model, "rb") as f:
        proto = f.read()
    own = (["ids"] if with_ids else []) + ["n_tokens", "ids_crc32", "round_trip", "parity"]
    rest = [c for c in df.columns if c.lower() != text.lower() and c.lower() not in own]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = scratch.per_worker("sentence_piece", proto, lambda: Codec(proto))
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in slices(texts):
                found = codec.encode(texts[a:b])
                arrays = []
                if with_ids:
                    ends = np.cumsum([0] + [len(ids) for ids, _ in found])
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([ids for ids, _ in found]), pa.int32())))
                arrays += [
                    pa.array([len(ids) for ids, _ in found], pa.int64()), pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for ids, _ in found], pa.int64()),
                    pa.array([codec.decode(ids) == t for (ids, _), t in zip(found, texts[a:b], strict=True)], pa.bool_()), pa.array([same for _, same in found], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[1:]] + arrays, names=rest + own)

    kept = df.select(F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in rest])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:]] + ["ids array<int>"] * with_ids + ["n_tokens bigint, ids_crc32 bigint, round_trip boolean, parity boolean"])
    return scratch.map_batches(kept, encode, schema, keeps="sentence_piece")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), model_path(), with_ids=False)
