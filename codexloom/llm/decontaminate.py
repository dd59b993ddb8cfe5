"""Benchmark decontamination with an FM-index per shard of documents.

Each task turns its documents into shards of word ids, builds an FM-index per shard (suffix order
by prefix doubling, Burrows-Wheeler transform in a wavelet matrix, sampled suffix positions), and
backward-searches all benchmark windows at once. Occurrences are located by walking to the nearest
sampled position and merged into removal spans. Words that no benchmark item has become breaks, as
no window can cross them, and runs shorter than the shortest window are left out of the index.

The benchmark is the query set. It is read in blocks of about ``block`` items and ``block_bytes``
bytes, and items of more than ``PIECE`` words in pieces that overlap by a window, so what the driver
and a task hold of it is bounded; spans of several blocks are merged per document. Every block
searches the documents anew.

Defined cases: null texts and items have no words; an item of fewer words than a window is one
window, one without words none; rows that repeat an item_id are one item with the windows of all of
them; repeated document rows are separate documents; rows without an item_id are one item, that of
the empty id, and are written as an empty string; an empty benchmark hits nothing; other columns pass
through ``remove_leaks`` and are ignored by the query.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexloom.llm.common import pack, stage, unpack, with_fields

WINDOW, BLOCK, SHARD = 10, 20_000, 1 << 21
BLOCK_BYTES, PIECE = 32 << 20, 100_000
#: Words are digits, a-z and everything beyond ASCII, after lower-casing A-Z.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class _Bits:
    """A bit array with ranks."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.sums = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1]

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.sums[at >> 6] + np.bitwise_count(self.words[at >> 6] & below)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of a sequence whose zeros are breaks, each different from every other."""
    n = len(symbols)
    zeros = symbols == 0
    first = np.where(zeros, np.cumsum(zeros) - 1, symbols.astype(np.int64) + int(zeros.sum()))
    order = np.argsort(first, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(first[order]) != 0)))
    sizes = np.diff(np.append(starts, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, sizes)
    open_, h = order[np.repeat(sizes > 1, sizes)], 1
    while len(open_):
        key = rank[open_] * n + rank[open_ + h]
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        outer = np.concatenate(([True], np.diff(key // n) != 0))
        inner = np.concatenate(([True], np.diff(key) != 0))
        at = np.arange(len(open_))
        start_out, start_in = np.maximum.accumulate(np.where(outer, at, 0)), np.maximum.accumulate(np.where(inner, at, 0))
        rank[open_] = key // n + start_in - start_out
        sizes = np.diff(np.append(np.flatnonzero(inner), len(open_)))
        open_ = open_[np.repeat(sizes > 1, sizes)]
        h *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class FMIndex:
    """Backward search and location over a sequence of word ids with zeros as breaks."""

    def __init__(self, symbols: np.ndarray, top: int, every: int = 8):
        order = suffix_order(symbols)
        last = symbols[order - 1].astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top + 1))))
        sampled = (order % every == 0) | (last == 0)
        self.sampled, self.places = _Bits(sampled), order[sampled]
        self.levels = []
        for level in reversed(range(max(1, int(top).bit_length()))):
            bit = (last >> level) & 1 == 1
            self.levels.append((level, _Bits(bit), int(len(bit) - bit.sum())))
            last = np.concatenate((last[~bit], last[bit]))

    def _rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the transform before each position."""
        start = np.zeros_like(at)
        for level, bits, zeros in self.levels:
            one = (symbol >> level) & 1 == 1
            a, b = bits.rank(at), bits.rank(start)
            at, start = np.where(one, zeros + a, at - a), np.where(one, zeros + b, start - b)
        return at - start

    def _step(self, rows: np.ndarray) -> np.ndarray:
        """The row of the suffix one symbol longer."""
        at, start, symbol = rows, np.zeros_like(rows), np.zeros_like(rows)
        for level, bits, zeros in self.levels:
            one = bits.get(at)
            symbol = symbol | one.astype(np.int64) << level
            a, b = bits.rank(at), bits.rank(start)
            at, start = np.where(one, zeros + a, at - a), np.where(one, zeros + b, start - b)
        return self.first[symbol] + at - start

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the phrase, first row, last row + 1) of the phrases (rows of equal length) that occur."""
        which = np.arange(len(phrases))
        lo, hi = self.first[phrases[:, -1]], self.first[phrases[:, -1] + 1]
        for j in range(phrases.shape[1] - 2, -1, -1):
            live = lo < hi
            which, lo, hi = which[live], lo[live], hi[live]
            symbol = phrases[which, j]
            lo, hi = self.first[symbol] + self._rank(symbol, lo), self.first[symbol] + self._rank(symbol, hi)
        live = lo < hi
        return which[live], lo[live], hi[live]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps, open_ = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(open_):
            known = self.sampled.get(rows)
            out[open_[known]] = self.places[self.sampled.rank(rows[known])] + steps
            rows, open_, steps = self._step(rows[~known]), open_[~known], steps + 1
        return out


def windows(items: list[tuple[str, str | None]], size: int = WINDOW) -> dict:
    """The benchmark as word ids: vocabulary, distinct windows by length, and the items of each window."""
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple, set[int]] = {}
    numbers: dict[str, int] = {}
    for name, text in items:
        k = numbers.setdefault(name, len(numbers))
        words = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in (text or "").encode().translate(_WORD_BYTES).split()]
        for i in range(max(1, len(words) - size + 1) if words else 0):
            found.setdefault(tuple(words[i:i + size]), set()).add(k)
    by_length: dict[int, list] = {}
    for w in found:
        by_length.setdefault(len(w), []).append(w)
    groups = []
    for n, own in sorted(by_length.items()):
        counts = np.array([len(found[w]) for w in own])
        groups.append((n, np.array(own, np.int64), np.concatenate(([0], np.cumsum(counts))), np.array([k for w in own for k in sorted(found[w])])))
    return {"vocabulary": vocabulary, "groups": groups, "ids": list(numbers), "least": min(by_length, default=0)}


class _Shard:
    """Documents gathered until they are indexed and searched together."""

    def __init__(self, bench: dict):
        self.bench, self.rows, self.n_words, self.parts, self.size = bench, [], [], [], 0

    def add(self, rows: list, texts: list[bytes]) -> None:
        known = self.bench["vocabulary"]
        for row, text in zip(rows, texts):
            words = text.translate(_WORD_BYTES).split()
            self.rows.append(row)
            self.n_words.append(len(words))
            if not known or len(words) < self.bench["least"]:
                continue
            ids = np.fromiter((known.get(w, 0) for w in words), np.int32, len(words))
            edges = np.flatnonzero(np.diff(np.concatenate(([0], ids != 0, [0])).astype(np.int8)))
            starts, ends = edges[::2], edges[1::2]
            long = ends - starts >= self.bench["least"]
            for a, b in zip(starts[long].tolist(), ends[long].tolist()):
                self.parts.append((len(self.rows) - 1, a, ids[a:b]))
                self.size += b - a + 1

    def results(self) -> Iterator[tuple]:
        """(row, n_words, spans of hit words, items with a window in the document)."""
        spans: dict[int, list] = {}
        items: dict[int, set] = {}
        if self.parts:
            lengths = np.array([len(x[2]) + 1 for x in self.parts])
            begins = np.cumsum(lengths) - lengths
            symbols = np.zeros(int(lengths.sum()), np.int64)
            for at, (_, _, ids) in zip(begins.tolist(), self.parts):
                symbols[at:at + len(ids)] = ids
            docs, offsets = np.array([x[0] for x in self.parts]), np.array([x[1] for x in self.parts])
            index, cover = FMIndex(symbols, len(self.bench["vocabulary"])), np.zeros(len(symbols) + 1, np.int64)
            for n, phrases, at, owners in self.bench["groups"]:
                which, lo, hi = index.search(phrases)
                counts = hi - lo
                rows = np.repeat(lo - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
                places, phrase = index.locate(rows), np.repeat(which, counts)
                np.add.at(cover, places, 1)
                np.add.at(cover, places + n, -1)
                doc = docs[np.searchsorted(begins, places, "right") - 1]
                for d, p in np.unique(np.stack((doc, phrase), 1), axis=0).tolist():
                    items.setdefault(d, set()).update(owners[at[p]:at[p + 1]].tolist())
            hit = np.concatenate(([0], np.cumsum(cover) > 0, [0])).astype(np.int8)
            edges = np.flatnonzero(np.diff(hit))
            part = np.searchsorted(begins, edges[::2], "right") - 1
            for p, a, b in zip(part.tolist(), edges[::2].tolist(), edges[1::2].tolist()):
                shift = int(offsets[p] - begins[p])
                spans.setdefault(int(docs[p]), []).append((a + shift, b + shift))
        for k, (row, n) in enumerate(zip(self.rows, self.n_words)):
            yield row, n, spans.get(k, []), sorted(items.get(k, ()))


SPANS = "n_words long, spans array<struct<start: int, stop: int>>, items array<string>"


def pieces(benchmark: DataFrame, size: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """(item_id as string, text): items of more than ``piece`` words cut into pieces that together have the same windows."""
    words = F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    b = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)), F.lit(piece))
    return b.withColumn("at", F.explode(starts)).select("item_id", F.array_join(F.slice("w", F.col("at"), F.lit(piece + size - 1)), " ").alias("text"))


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", size: int = WINDOW, block: int = BLOCK, shard: int = SHARD,
          block_bytes: int = BLOCK_BYTES, piece: int = PIECE) -> DataFrame:
    """Per document (key): n_words, merged spans of word positions that occur in the benchmark, and the items hit."""
    spark = docs.sparkSession
    bench = pieces(benchmark, size, piece)
    n, n_bytes = bench.select(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if n > block or n_bytes > block_bytes:
        # dealt into blocks by a hash; the number of blocks keeps each near its bounds
        blocks = max(-(-n // block), -(-n_bytes // block_bytes)) * 2
        bench = stage(bench.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "benchmark")
        parts = [bench.where(F.col("_block") == i).drop("_block") for i in range(blocks)]
        docs = stage(docs.select(key, "text").withColumn("_row", F.monotonically_increasing_id()), "numbered")
    else:
        parts = [bench]
    kind = docs.schema[key].dataType.simpleString()

    def search(part: DataFrame, row: str, row_kind: str) -> DataFrame:
        held = spark.sparkContext.broadcast(windows([tuple(r) for r in part.collect()], size))

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench, own, arrow = held.value, _Shard(held.value), None
            names = bench["ids"]

            def flush(own: _Shard) -> pa.RecordBatch:
                got = list(own.results())
                pairs = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
                return pa.RecordBatch.from_arrays([
                    pa.array([x[0] for x in got], arrow), pa.array([x[1] for x in got], pa.int64()),
                    pa.array([[{"start": a, "stop": b} for a, b in x[2]] for x in got], pairs),
                    pa.array([[names[k] for k in x[3]] for x in got], pa.list_(pa.string()))], names=[row, "n_words", "spans", "items"])

            for batch in batches:
                arrow = batch.column(row).type
                rows, texts = batch.column(row).to_pylist(), batch.column("text").cast(pa.binary())
                for at in range(0, len(rows), 256):
                    own.add(rows[at:at + 256], [x.as_py() or b"" for x in texts[at:at + 256]])
                    if own.size >= shard or len(own.rows) >= 200_000:
                        yield flush(own)
                        own = _Shard(bench)
            if own.rows:
                yield flush(own)

        return docs.select(row, F.col("text").cast("string")).mapInArrow(emit, f"`{row}` {row_kind}, {SPANS}")

    if len(parts) == 1:
        return search(parts[0], key, kind)
    found = None
    for part in parts:
        one = search(part, "_row", "bigint")
        found = one if found is None else found.unionByName(one)
    found = found.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
                                      F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    start = "cast(array() as array<struct<start: int, stop: int>>)"
    merged = F.expr(f"""aggregate(spans, {start}, (acc, x) -> case
        when size(acc) > 0 and element_at(acc, -1).stop >= x.start
        then concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start as start, greatest(element_at(acc, -1).stop, x.stop) as stop)))
        else concat(acc, array(x)) end)""")
    return found.withColumn("spans", merged).join(docs.select("_row", key), "_row").select(key, "n_words", "spans", "items")


def cut_words(text: bytes, spans: list) -> bytes:
    """The text without the given spans of word positions; a line break takes each span's place."""
    at, out, places = 0, [], [m.span() for m in _WORD.finditer(text)]
    for s in spans:
        out.append(text[at:places[s["start"]][0]])
        at = places[s["stop"] - 1][1]
    return b"\n".join([*out, text[at:]])


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with the benchmark's words cut out of every text; all rows stay."""
    packed = stage(pack(docs).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = stage(leaks(packed, benchmark, key="_row").where(F.size("spans") > 0).select("_row", "spans"), "spans")
    names = ["doc_id", "text", "_rest"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut_words(t.as_py(), s) for t, s in zip(batch.column("text").cast(pa.binary()), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), batch.column("_rest")], names=names)

    cut = packed.join(found, "_row").mapInArrow(emit, with_fields(packed, names, ""))
    return unpack(packed.join(found.select("_row"), "_row", "left_anti").select(*names).unionByName(cut), docs)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bi),
ns AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM di),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit),
np AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h
       FROM (SELECT DISTINCT doc_id, coalesce(item_id::VARCHAR, '') AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN np ON d.doc_id = np.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
