"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

The vocabulary's byte strings are written as pieces over 256 printable characters, one per byte,
scored by negative rank, with identity normalisation: sentencepiece's merge order is then that of
the ranks. The model is serialised directly from the vocabulary, nothing is trained. Pre-tokens
are encoded once per task and kept in a bounded cache; decoding maps ids back through the model's
own pieces.

Defined cases: a null or empty text gives no ids; strings that look like special tokens are
ordinary text; very long texts are encoded pre-token by pre-token; repeated rows and other
columns pass through, except that the operator's own columns replace columns of their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from codexloom.llm.common import pack, unpack, with_fields

#: Pre-tokens kept per task.
CACHE = 200_000


def byte_chars() -> list[str]:
    """A printable, distinct character for each byte: itself where visible in Latin-1, else from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file in rank order; the ranks must run from 0 without gaps."""
    with open(path, "rb") as f:
        ranks = {int(n): base64.b64decode(piece) for piece, n in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _bytes_field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(pieces: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks; the unknown piece comes last.

    Field numbers are those of sentencepiece's public model format.
    """
    chars = byte_chars()
    out = []
    for rank, piece in enumerate(pieces):
        text = "".join(map(chars.__getitem__, piece)).encode()
        out.append(_bytes_field(1, _bytes_field(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))))
    out.append(_bytes_field(1, _bytes_field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _int_field(3, 2)))
    n = len(pieces)
    none = (1 << 64) - 1  # -1: absent
    trainer = _int_field(3, 2) + _int_field(4, n + 1) + _int_field(40, n) + _int_field(41, none) + _int_field(42, none) + _int_field(43, none)
    normalizer = _bytes_field(1, b"identity") + _int_field(3, 0) + _int_field(4, 0) + _int_field(5, 0)
    return b"".join(out) + _bytes_field(2, trainer) + _bytes_field(3, normalizer)


class Codec:
    """Encodes texts to little-endian 32-bit ids and back, by one model and pattern."""

    def __init__(self, model: bytes, pattern: str, cache: int = CACHE):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        self.chars = {b: c for b, c in enumerate(byte_chars())}
        back = {ord(c): b for b, c in self.chars.items()}
        n = self.model.get_piece_size() - 1
        self.bytes_of = [bytes(map(back.__getitem__, map(ord, self.model.id_to_piece(i)))) for i in range(n)]
        #: a pre-token that is itself in the vocabulary is one id, whether merges reach it or not
        self.whole = {piece: struct.pack("<I", i) for i, piece in enumerate(self.bytes_of)}
        self.size, self.cache = cache, {}

    def _learn(self, tokens: set[str]) -> None:
        if len(self.cache) + len(tokens) > self.size:
            self.cache = {}
        rest = []
        for t in tokens:
            raw = t.encode()
            if (own := self.whole.get(raw)) is not None:
                self.cache[t] = own
            else:
                rest.append((t, "".join(map(self.chars.__getitem__, raw))))
        for (t, _), ids in zip(rest, self.model.encode([x for _, x in rest], num_threads=1)):
            self.cache[t] = np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        tokens = self.find(text)
        try:
            return b"".join(map(self.cache.__getitem__, tokens))
        except KeyError:
            need = set(tokens)
            self._learn({t for t in need if t not in self.cache} if len(self.cache) + len(need) <= self.size else need)
            return b"".join(map(self.cache.__getitem__, tokens))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def bpe_encode(docs: DataFrame, ranks: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids (array) and decoded text.

    ``ranks`` is the vocabulary file's path on the driver; executors get the serialised model, whose
    size is that of the vocabulary.
    """
    held = docs.sparkSession.sparkContext.broadcast(sentencepiece_model(read_ranks(ranks)))
    packed = pack(docs)
    names = packed.columns if with_ids else ["doc_id", "_rest"]
    more = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(held.value, pattern)
        for batch in batches:
            n, ids_sha, dec_sha, ids, decoded = [], [], [], [], []
            for text in batch.column("text"):
                raw = codec.encode(text.as_py() or "")
                back = codec.decode(raw)
                n.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                dec_sha.append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(raw, "<u4").astype(np.int32))
                    decoded.append(back)
            out = {x: batch.column(x) for x in names}
            out |= {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(dec_sha, pa.string())}
            if with_ids:
                out |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    got = packed.mapInArrow(emit, with_fields(packed, names, more))
    outputs = [x.split()[0] for x in more.split(", ")]
    return unpack(got, docs if with_ids else docs.drop("text"), *outputs)


def op10_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe_encode(docs, public_tokenizers.path(vocabulary), public_tokenizers.PATTERN, with_ids=False)
