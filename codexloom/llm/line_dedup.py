"""Line deduplication by sharded minimal perfect hashing.

Every line's key (stripped, A-Z lower-cased) is hashed to 128 bits. Spark counts the documents
that hold a key and keeps its greatest doc_id. All keys of at least two documents are dealt into
shards; per shard one task builds a minimal perfect hash (levels of bit arrays with ranks) that
indexes compact arrays of fingerprints, counts and ids, and only these arrays travel. Documents
probe them: the hash gives the shard and the slot, the fingerprint must agree, and the slot's count
decides whether the line is one of those to drop. A key of a single document is never indexed; its
probe fails on the fingerprint.

The arrays go to the tasks by broadcast while they fit ``broadcast_bytes``. Beyond that the
distinct hashes of each document travel to the shards. Before, a small index of the most frequent
lines (at most ``HOT_PER_TASK`` for each shuffle partition, so of bounded size) answers where the
document is, so a line that a third of all documents hold is sent to no shard.

Defined cases: a null text counts as empty, which is one empty line; rows that repeat a doc_id
count as one document, as do all rows without a doc_id, whose id counts as the least; of rows that
repeat the greatest doc_id all keep their lines; an empty table gives an empty result; other
columns pass through ``drop_repeated_lines``, except that its n_lines and n_dropped replace columns
of these names, and are ignored by the query.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexloom.llm.common import ASCII_LOWER, pack, partitions, stage, unpack, with_fields

MIN_CHARS, MIN_DOCS = 40, 5
BLANKS = b" \t\n\v\f\r"
#: Indexes up to this size are broadcast.
BROADCAST_BYTES = 64 << 20
#: Lines per shuffle partition that are frequent enough to be answered without a shuffle.
HOT_PER_TASK = 64
#: Probes that one shard answers.
PROBES = 1 << 21
NO_ID = -(1 << 63)


def line_keys(lines: list[bytes], min_chars: int) -> list[bytes | None]:
    """The 16-byte hash of each line's key, None for keys of fewer code points."""
    out = []
    for line in lines:
        key = line.strip(BLANKS)
        if len(key) >= min_chars:
            key = key.translate(ASCII_LOWER)
            # continuation bytes do not start a code point
            if key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars:
                out.append(xxhash.xxh3_128_digest(key))
                continue
        out.append(None)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class LineIndex:
    """One shard: a minimal perfect hash over distinct 128-bit hashes (key, print) and the arrays it indexes.

    A hash's slot is the rank of its bit in the first level where it collides with no other. Both
    halves place it, so two lines that share one half still part. The key itself is not kept.
    """

    def __init__(self, keys: np.ndarray, prints: np.ndarray, counts: np.ndarray, ids: np.ndarray, gamma: float = 2.0):
        self.levels, self.before, placed = [], [], 0
        k, p = keys.view(np.uint64), prints.view(np.uint64)
        while len(k):
            if len(self.levels) > 200:
                raise ValueError("hashes are not distinct")
            size = max(64, int(gamma * len(k)))
            at = self._place(k, p, len(self.levels), size)
            hits = np.bincount(at, minlength=size)
            bits = hits == 1
            self.levels.append((size, np.packbits(bits, bitorder="little"), np.cumsum(bits, dtype=np.int64)[63::64].copy()))
            self.before.append(placed)
            placed += int(bits.sum())
            rest = ~bits[at]
            k, p = k[rest], p[rest]
        slots, _ = self._slots(keys, prints)
        self.prints, self.counts, self.ids = np.empty(len(keys), np.int64), np.empty(len(keys), np.uint32), np.empty(len(keys), np.int64)
        self.prints[slots], self.counts[slots], self.ids[slots] = prints, np.minimum(counts, 0xFFFFFFFF), ids

    @staticmethod
    def _place(keys: np.ndarray, prints: np.ndarray, level: int, size: int) -> np.ndarray:
        step = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        return (_mix(keys ^ _mix(prints ^ step)) % np.uint64(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, prints = keys.view(np.uint64), prints.view(np.uint64)
        slots, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        open_ = np.arange(len(keys))
        for level, (size, packed, sums) in enumerate(self.levels):
            if not len(open_):
                break
            at = self._place(keys[open_], prints[open_], level, size)
            hit = (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            done, p = open_[hit], at[hit]
            word = p >> 6
            rank = np.where(word > 0, sums[np.maximum(word - 1, 0)] if len(sums) else 0, 0)
            # bits of the position's own 64-bit word that lie before it
            padded = np.zeros((len(p), 8), np.uint8)
            cells = (word * 8)[:, None] + np.arange(8)
            np.copyto(padded, packed[np.minimum(cells, len(packed) - 1)], where=cells < len(packed))
            own = padded.view("<u8").ravel() & ((np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1))
            slots[done] = self.before[level] + rank + np.bitwise_count(own)
            known[done] = True
            open_ = open_[~hit]
        return slots, known

    def probe(self, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, count, id) of each hash; found only where the slot's fingerprint agrees."""
        if not len(self.prints):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.int64)
        slots, known = self._slots(keys, prints)
        return known & (self.prints[slots] == prints), self.counts[slots], self.ids[slots]


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def _ids(batch: pa.RecordBatch) -> list[int]:
    return [NO_ID if x is None else x for x in batch.column("doc_id").to_pylist()]


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, print, n_docs, max_doc): how many documents hold each line, and the greatest of them."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, owners = [], []
            for doc, text in zip(_ids(batch), _texts(batch)):
                own = {x for x in line_keys(text.split(b"\n"), min_chars) if x is not None}
                hashes += own
                owners += [doc] * len(own)
            both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(owners, pa.int64())], names=["key", "print", "doc"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(emit, "key long, print long, doc long")
    return rows.groupBy("key", "print").agg(F.countDistinct("doc").alias("n_docs"), F.max("doc").alias("max_doc"))


def line_index(repeated: DataFrame, shards: int) -> DataFrame:
    """(shard, index): a serialised ``LineIndex`` of each shard of (key, print, n_docs, max_doc), built once."""

    def build(pdf):
        import pandas as pd

        index = LineIndex(*(np.ascontiguousarray(pdf[name].to_numpy(np.int64)) for name in ("key", "print", "n_docs", "max_doc")))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "index": [pickle.dumps(index, protocol=5)]})

    # a shard holds about the same number of distinct lines, whatever the number of documents
    dealt = repeated.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    return stage(dealt.groupBy("shard").applyInPandas(build, "shard int, index binary"), "line_index")


def _lost(index: dict[int, LineIndex], shards: int, both: np.ndarray, docs: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(found, lost) of (key, print) rows: lost where enough documents hold the line and a greater doc_id does."""
    found, lost = np.zeros(len(both), bool), np.zeros(len(both), bool)
    shard = both[:, 0] % shards
    for s, own in index.items():
        at = np.flatnonzero(shard == s) if shards > 1 else np.arange(len(both))
        if len(at):
            hit, count, last = own.probe(np.ascontiguousarray(both[at, 0]), np.ascontiguousarray(both[at, 1]))
            found[at], lost[at] = hit, hit & (count >= min_docs) & (last > docs[at])
    return found, lost


def _routed(docs: DataFrame, repeated: DataFrame, shards: int, min_chars: int, min_docs: int) -> DataFrame:
    """docs (with _row) and ``_drop``: the hashes of the lines that a document loses, found by sending hashes to the shards."""
    spark, parts = docs.sparkSession, partitions(docs.sparkSession)
    probes = repeated.select(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    # fewer than HOT_PER_TASK * parts lines can be above this count
    often = F.col("n_docs") > probes // (HOT_PER_TASK * parts)
    hot = line_index(repeated.where(often), 1).collect()
    held = spark.sparkContext.broadcast({0: pickle.loads(hot[0]["index"])} if hot else {})

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, owners, rows = [], [], []
            for doc, row, text in zip(_ids(batch), batch.column("_row").to_pylist(), _texts(batch)):
                own = {x for x in line_keys(text.split(b"\n"), min_chars) if x is not None}
                hashes += own
                owners += [doc] * len(own)
                rows += [row] * len(own)
            both, owners, rows = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2), np.array(owners, np.int64), np.array(rows, np.int64)
            found, lost = _lost(held.value, 1, both, owners, min_docs)
            stay = lost | ~found
            yield pa.RecordBatch.from_arrays([pa.array(x[stay]) for x in (both[:, 0], both[:, 1], owners, rows, lost)], names=["key", "print", "doc", "_row", "known"])

    sent = stage(docs.select("_row", "doc_id", "text").mapInArrow(emit, "key long, print long, doc long, _row long, known boolean"), "probes")
    # as many shards as keep both the lines and the probes of one within bounds
    shards = max(shards, -(-sent.where("not known").count() // PROBES))
    cold = line_index(repeated.where(~often), shards)
    asked = sent.where("not known").withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))

    def ask(left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("_row", "key", "print")})
        both = np.ascontiguousarray(left[["key", "print"]].to_numpy(np.int64))
        return left.loc[_lost({0: pickle.loads(right["index"].iloc[0])}, 1, both, left["doc"].to_numpy(np.int64), min_docs)[1], ["_row", "key", "print"]]

    lost = asked.groupBy("shard").cogroup(cold.groupBy("shard")).applyInPandas(ask, "_row long, key long, print long")
    lost = lost.unionByName(sent.where("known").select("_row", "key", "print"))
    lost = lost.groupBy("_row").agg(F.collect_list(F.struct("key", "print")).alias("_drop"))
    return docs.join(lost, "_row", "left")


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                        broadcast_bytes: int = BROADCAST_BYTES, per_shard: int = 1 << 18) -> DataFrame:
    """docs (doc_id, text, ...) with the text reduced to the lines that stay, and n_lines, n_dropped."""
    spark, packed = docs.sparkSession, pack(docs)
    repeated = stage(line_counts(packed, min_chars).where("n_docs > 1"), "repeated_lines")
    shards = max(1, -(-repeated.count() // per_shard))
    held = None
    # about 21 bytes a line, and the exact size before anything is collected
    if shards * per_shard * 21 <= broadcast_bytes * 2:
        index = line_index(repeated, shards)
        if index.select(F.coalesce(F.sum(F.octet_length("index")), F.lit(0))).first()[0] <= broadcast_bytes:
            held = spark.sparkContext.broadcast({r["shard"]: r["index"] for r in index.collect()})
    if held is None:
        packed = stage(packed.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        packed = _routed(packed, repeated, shards, min_chars, min_docs).select("doc_id", "text", "_rest", "_drop")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = {s: pickle.loads(x) for s, x in held.value.items()} if held is not None else {}
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            split = [text.split(b"\n") for text in _texts(batch)]
            keys = [line_keys(lines, min_chars) for lines in split]
            if held is not None:
                both = np.frombuffer(b"".join(k for own in keys for k in own if k is not None), np.int64).reshape(-1, 2)
                owners = np.repeat(np.array(_ids(batch), np.int64), [sum(k is not None for k in own) for own in keys])
                gone, at = _lost(built, shards, both, owners, min_docs)[1].tolist(), 0
            else:
                drops = [{np.array([x["key"], x["print"]], np.int64).tobytes() for x in own or ()} for own in batch.column("_drop").to_pylist()]
            for i, (lines, own) in enumerate(zip(split, keys)):
                stay = []
                for line, key in zip(lines, own):
                    lost = False
                    if key is not None:
                        if held is not None:
                            lost = gone[at]
                            at += 1
                        else:
                            lost = key in drops[i]
                    if not lost:
                        stay.append(line)
                texts.append(b"\n".join(stay))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), batch.column("_rest"),
                                              pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["doc_id", "text", "_rest", "n_lines", "n_dropped"])

    out = packed.mapInArrow(cut, with_fields(packed, ["doc_id", "text", "_rest"], "n_lines long, n_dropped long"))
    return unpack(out, docs, "n_lines", "n_dropped")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_KEY = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, {_KEY} AS key FROM l),
h AS (SELECT key, max(id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT id) >= 5),
m AS (SELECT k.*, h.key IS NOT NULL AND k.id <> h.last_doc AS lost FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
