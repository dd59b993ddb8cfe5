"""Token counts of whole texts by a byte-level BPE tokenizer, huge documents by overlapping chunks.

A document of up to one chunk is counted at once. A longer one is cut into chunks that each reach into
the next one. Tasks encode the chunks apart, with offsets, and neighbours are spliced at a
pre-token boundary that both of them have inside the overlap. Such a boundary is proven: the
splitting pattern reads left to right and never looks back, so from a true boundary on the tokens
depend on the text behind it alone. By induction from the start of the document all boundaries of
the left chunk are true, but for those within the pattern's look-ahead of its end, which are
left out; from a common one on the right chunk is true as well. Where two chunks have no boundary in
common (one pre-token fills the overlap), the left one is widened over the whole next chunk, and
in later rounds over twice as many each time, until all are spliced.

Defined cases: a null or empty text has no bytes and no tokens; strings of added tokens inside a text
are those tokens, as is the library's default; repeated rows are counted one by one; other columns
but text pass through, except that the operator's own columns replace columns of their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codexloom.llm.common import pack, stage, unpack, with_fields

#: Characters of a chunk, and how far it reaches into the next one.
CHUNK, OVERLAP = 16_384, 256
#: Characters of the pieces whose counts a task keeps.
CACHE = 16_000_000
#: Tokens beyond which a document is over the limit.
LIMIT = 512
#: Characters that the splitting pattern may look at behind a pre-token: those of its longest contraction.
LOOK_AHEAD = 3
WIDENINGS = 40

CHUNK_FIELDS = "_row long, _k int, _next int, _size int, _chunk string"


class Encoder:
    """Counts and boundaries by the library, with default treatment of added tokens, no truncation and no padding."""

    def __init__(self, vocabulary: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        known = json.loads(vocabulary)
        split, added = known["pre_tokenizer"] or {}, known["added_tokens"]
        if split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or known["normalizer"]:
            raise ValueError("only byte-level tokenizers that split by their own pattern, without normalisation, are proven")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added):
            raise ValueError("added tokens that take white space along are not proven")
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: a boundary with so many characters behind it cannot move
        self.margin = LOOK_AHEAD + max((len(t["content"]) for t in added), default=0)
        # No pre-token goes from another character on into white space. Rare white space is left inside pieces.
        self.pieces, self.rare = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+").findall, re.compile(r"[^\S \t\n\r]").search
        self.size, self.held, self.cache = cache, 0, {}

    def _encode(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def count(self, text: str) -> int:
        """Tokens of a whole text, by its pieces between white space, each of which is encoded once."""
        if self.rare(text):
            return len(self._encode(text).ids)
        pieces = self.pieces(text)
        try:
            return sum(map(self.cache.__getitem__, pieces))
        except KeyError:
            if self.held + len(text) > self.size:
                self.held, self.cache = 0, {}
            new = [p for p in dict.fromkeys(pieces) if p not in self.cache]
            self.held += sum(map(len, new))
            self.cache.update(zip(new, map(len, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))))
            return sum(map(self.cache.__getitem__, pieces))

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """(character positions at which pre-tokens start, tokens before each, all tokens)."""
        got = self._encode(text)
        words = np.array(got.word_ids, np.int64)
        first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1]))) if len(words) else np.zeros(0, np.int64)
        offsets = got.offsets
        return np.array([offsets[i][0] for i in first], np.int64), first, len(words)


@functools.lru_cache(maxsize=1)
def loaded(vocabulary: str) -> Encoder:
    """One encoder for each worker, with the pieces that it has seen."""
    return Encoder(vocabulary)


def _measured(chunks: DataFrame, held, overlap: int) -> DataFrame:
    """Per chunk: its boundaries in the first ``overlap`` characters, those behind its own end, and all its tokens."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoder, out = loaded(held.value), []
            for size, text in zip(batch.column("_size").to_pylist(), batch.column("_chunk")):
                text = text.as_py()
                at, before, total = encoder.boundaries(text)
                # a chunk that ends before its overlap does ends with the document, where nothing is cut off
                end = len(text) - (encoder.margin if len(text) - size >= overlap else 0)
                head, tail = at <= overlap, (at >= size) & (at <= end)
                out.append((at[head], before[head], at[tail] - size, before[tail], total))
            lists = [pa.array([r[i] for r in out], pa.list_(pa.int32())) for i in range(4)]
            keys = [batch.column(c) for c in ("_row", "_k", "_next")]
            yield pa.RecordBatch.from_arrays(keys + lists + [pa.array([r[4] for r in out], pa.int64())], names=["_row", "_k", "_next", "head", "head_n", "tail", "tail_n", "total"])

    return chunks.select("_row", "_k", "_next", "_size", "_chunk").mapInArrow(
        emit, "_row long, _k int, _next int, head array<int>, head_n array<int>, tail array<int>, tail_n array<int>, total long")


def _pairs(measured: DataFrame) -> DataFrame:
    """(_row, _k, tokens, joined) per chunk: its tokens up to the boundary it shares with the next chunk less those of the next chunk before it; the last
    chunk has all its tokens. Without such a boundary ``joined`` is false."""
    right = measured.select("_row", F.col("_k").alias("_next"), F.col("head").alias("h"), F.col("head_n").alias("hn"))
    both = measured.join(right, ["_row", "_next"], "left").withColumn("at", F.try_element_at(F.array_intersect("tail", "h"), F.lit(1)))
    joined = F.element_at("tail_n", F.array_position("tail", F.col("at")).cast("int")) - F.element_at("hn", F.array_position("h", F.col("at")).cast("int"))
    return both.select("_row", "_k", "_next", F.when(F.col("_next").isNull(), F.col("total")).when(F.col("at").isNotNull(), joined).alias("tokens"),
                       (F.col("_next").isNull() | F.col("at").isNotNull()).alias("joined"))


def _widened(chunks: DataFrame, failed: DataFrame, reach: int) -> DataFrame:
    """Chunks of the failed documents, each failed start and ``reach`` - 1 starts behind it taken out: the chunk before goes on over them."""
    own = chunks.join(failed.select("_row").distinct(), "_row", "left_semi")
    bad = failed.select("_row", F.col("_next").alias("_k"), F.lit(1).alias("_bad"))
    order = Window.partitionBy("_row").orderBy("_k")
    # windows over the chunks of one document, without their texts
    starts = (own.select("_row", "_k").join(bad, ["_row", "_k"], "left").withColumn("_out", F.max("_bad").over(order.rowsBetween(1 - reach, 0)))
              .withColumn("_to", F.max(F.when(F.col("_out").isNull(), F.col("_k"))).over(order)).select("_row", "_k", "_to"))
    core = F.struct("_k", "_size", "_chunk")
    every = own.join(starts, ["_row", "_k"]).groupBy("_row", "_to").agg(F.array_sort(F.collect_list(core)).alias("c"), F.sum("_size").cast("int").alias("_size"), F.max_by("_next", "_k").alias("_next"))
    texts = F.transform("c", lambda x, i: F.when(i == F.size("c") - 1, x["_chunk"]).otherwise(F.substring(x["_chunk"], F.lit(1), x["_size"])))
    return every.select("_row", F.col("_to").alias("_k"), "_next", "_size", F.array_join(texts, "").alias("_chunk"))


def _spliced(chunks: DataFrame, held, overlap: int) -> DataFrame:
    """(_row, tokens) of all chunked documents."""
    done = []
    for n in range(WIDENINGS):
        pairs = stage(_pairs(stage(_measured(chunks, held, overlap), "measured")), "pairs")
        failed = pairs.where(~F.col("joined"))
        done.append(pairs.join(failed.select("_row").distinct(), "_row", "left_anti").groupBy("_row").agg(F.sum("tokens").alias("tokens")))
        if failed.isEmpty():
            break
        chunks = stage(_widened(chunks, failed, 2**n), "widened")
    else:
        raise RuntimeError("chunks did not splice")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs without text, with n_bytes (UTF-8), n_tokens and over_limit.

    ``vocabulary`` is the path of the tokenizer's JSON file on the driver; executors get its contents,
    whose size is that of the vocabulary. ``overlap`` may not exceed ``chunk``.
    """
    if overlap > chunk:
        raise ValueError("the overlap reaches over more than one chunk")
    with open(vocabulary, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    Encoder(held.value)  # refuses unproven tokenizers before any work is done
    packed = pack(docs)
    keep = ["doc_id", "_rest"]

    def rows(batch: pa.RecordBatch, of: list, tokens: list, sizes: list, chunks: list) -> pa.RecordBatch:
        at, fields = pa.array(of, pa.int32()), zip(*chunks) if chunks else [[]] * 5
        names, kinds = [f.split()[0] for f in CHUNK_FIELDS.split(", ")], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in keep] + [pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())] + [pa.array(v, t) for v, t in zip(fields, kinds)],
                                          names=[*keep, "n_bytes", "n_tokens", *names])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = loaded(held.value), TaskContext.get().partitionId() << 33
        none = (None,) * 5
        for batch in batches:
            of, tokens, sizes, cells = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                of.append(i)
                sizes.append(len(text.encode()))
                if len(text) <= chunk:
                    tokens.append(encoder.count(text))
                    cells.append(none)
                    continue
                row += 1
                tokens.append(None)
                cells.append((row, None, None, None, None))
                starts = range(0, len(text), chunk)
                for k, s in enumerate(starts):
                    yield rows(batch, [None], [None], [None], [(row, k, k + 1 if k + 1 < len(starts) else None, min(chunk, len(text) - s), text[s:s + chunk + overlap])])
            yield rows(batch, of, tokens, sizes, cells)

    first = stage(packed.mapInArrow(emit, with_fields(packed, keep, f"n_bytes long, n_tokens long, {CHUNK_FIELDS}")), "counted")
    chunks = first.where("_k is not null").select("_row", "_k", "_next", "_size", "_chunk").repartition("_row", "_k")
    whole = first.where("_k is null").select("doc_id", "_rest", "n_bytes", "n_tokens", "_row")
    huge = whole.where("_row is not null").drop("n_tokens").join(_spliced(chunks, held, overlap).withColumnRenamed("tokens", "n_tokens"), "_row", "left")
    got = whole.where("_row is null").unionByName(huge)
    return unpack(got.withColumn("over_limit", F.col("n_tokens") > limit), docs.drop("text"), "n_bytes", "n_tokens", "over_limit")


def op12_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path(vocabulary))
