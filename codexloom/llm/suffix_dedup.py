"""Repeated byte strings across documents, by merging shard Burrows-Wheeler transforms.

A 100-byte string that occurs twice has the same content-chosen anchor (the least hash of its
16-byte grams) wherever it occurs, so occurrences can be dealt out by anchor. Runs of string
starts with one anchor form a segment. Equal segments collapse to their first occurrence, all
others being repeats as a whole: first within every ``_GROUP`` bytes of a task's texts, then across
tasks. A string reaches over half of its bytes beside the anchor on one side at least, so of
segments that differ only those are kept that agree with another in the half next to the anchor.
They are put into shards; each shard's transform is built once, and the shards are merged by
refining their interleave one character at a time. The refinement never sorts suffixes again: it
keeps blocks of equal prefixes, drops blocks of one, and after 100 rounds the blocks left are the
repeated intervals.

An anchor with more than ``WIDE`` such segments (the edges of a passage that very many documents
hold) is not merged in one task: its strings are told apart by their 128-bit hashes, which Spark
groups with partial sums, so no list of them is ever held.

Defined cases: a null text is empty; texts below the length have nothing removed; documents are
ordered by doc_id, null first, and rows that repeat a doc_id by their row; an empty table gives an
empty result; other columns are ignored; a length that is not from 16 to 30,000 is an error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codexloom.llm.common import attach_by_key, bucketed, partitions, stage

LENGTH, GRAM = 100, 16
_BITS = 24
_PIECE = 1 << 20
_BATCH, _SHARD = 1 << 21, 1 << 18
#: Bytes of text whose segments are compared within a task before any of them is sent on.
_GROUP = 16 << 20
#: Differing segments of one anchor that are merged in one task.
WIDE = 1024
_MULT = 0xD6E8FEB86659FD93
_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _POWERS.clear()
        for base in (_MULT, pow(_MULT, -1, 1 << 64)):
            steps = np.full(size, np.uint64(base), np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps, dtype=np.uint64))
    return _POWERS


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def segments(data: np.ndarray, doc: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple:
    """(doc, first, n, anchor, gram, hash, sides) of the segments of joined texts: runs of starts with one anchor.

    ``first`` counts in the joined text; ``hash`` covers the n + length - 1 bytes of the segment.
    ``sides`` has 32 bits each of the hashes of the half strings before and after the anchor, 0 where
    the segment does not reach so far.
    """
    window, half = length - GRAM + 1, (length - GRAM + 1) // 2
    up, down = _powers(len(data) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_TABLE[data] * up[:len(data)], dtype=np.uint64)))
    grams = _mix((sums[GRAM:] - sums[:-GRAM]) * down[:len(data) - GRAM + 1])
    low = np.uint64((1 << _BITS) - 1)
    # the position in the low bits makes the leftmost of equal hashes the least
    least, span = (grams & ~low) | np.arange(len(grams), dtype=np.uint64), 1
    while span * 2 <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if window > span:
        least = np.minimum(least[:len(least) - (window - span)], least[window - span:])
    counts = np.maximum(ends - begins - length + 1, 0)
    starts = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    owner = np.repeat(doc, counts)
    anchor = (least[starts] & low).astype(np.int64)
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))) if len(starts) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    first, n = starts[at], np.diff(np.append(at, len(starts)))
    stop, mid = first + n + length - 1, anchor[at]
    low, high = np.maximum(mid - half, first), np.minimum(mid + GRAM + half, stop)
    left, right = _mix((sums[mid] - sums[low]) * down[low]) | np.uint64(1), _mix((sums[high] - sums[mid + GRAM]) * down[mid + GRAM]) | np.uint64(1)
    top = np.uint64(0xFFFFFFFF)
    sides = np.where(mid - half >= first, left & top, np.uint64(0)) << np.uint64(32) | np.where(mid + GRAM + half <= stop, right & top, np.uint64(0))
    return owner[at], first, n, mid, grams[mid], _mix((sums[stop] - sums[first]) * down[first] + n.astype(np.uint64)), sides


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[bytes], list[tuple[int, int]]]]:
    """Texts joined to pieces of about a megabyte; long texts are cut with an overlap of length - 1."""
    own, at, size = [], [], 0
    for k, t in enumerate(texts):
        for begin in range(0, max(len(t) - length + 1, 0), _PIECE):
            part = t[begin:begin + _PIECE + length - 1]
            if own and size + len(part) > 2 * _PIECE:
                yield own, at
                own, at, size = [], [], 0
            own.append(part)
            at.append((k, begin))
            size += len(part)
    if own:
        yield own, at


def anchored(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, dup, hash, sides, doc, _row, first, n): the segments of all documents, n with the anchor's offset above its low 16 bits.

    Of equal segments in one group of joined texts only the first keeps its anchor as key; the others
    are known to be repeats (dup) and are keyed by their document.
    """
    names = ["key", "dup", "hash", "sides", "doc", "_row", "first", "n"]

    def once(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        gram, digest, sides, doc, row, pos, n = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((pos, row, doc, digest, gram))
        gram, digest = gram[order], digest[order]
        dup = np.concatenate(([False], (gram[1:] == gram[:-1]) & (digest[1:] == digest[:-1])))
        key = np.where(dup, _mix(row[order].astype(np.uint64)), gram)
        # nothing is asked of a known repeat but where it is
        digest, sides = (np.where(dup, np.uint64(0), x) for x in (digest, sides[order]))
        cols = [key.view(np.int64), dup, digest.view(np.int64), sides.view(np.int64), doc[order], row[order], pos[order], n[order]]
        for at in range(0, len(dup), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[at:at + (1 << 16)]) for c in cols], names=names)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column("text").cast(pa.binary())]
            ids, rows = batch.column("doc").to_numpy(), batch.column("_row").to_numpy()
            for own, at in _pieces(texts, length):
                data = np.frombuffer(b"".join(own), np.uint8)
                ends = np.cumsum([len(t) for t in own])
                begins = ends - np.array([len(t) for t in own])
                part, first, n, anchor, gram, digest, sides = segments(data, np.arange(len(own)), begins, ends, length)
                which, shift = np.array(at).T
                pos = (first - begins[part] + shift[part]).astype(np.int64)
                parts.append((gram, digest, sides, ids[which][part], rows[which][part], pos, (n | (anchor - first) << 16).astype(np.int32)))
                size += len(data)
                if size >= _GROUP:
                    yield from once(parts)
                    parts, size = [], 0
        if parts:
            yield from once(parts)

    return docs.select("doc", "_row", "text").mapInArrow(emit, "key long, dup boolean, hash long, sides long, doc long, _row long, first long, n int")


class ShardBWT:
    """The transform of a shard of segments, each closed by a zero: characters, LF mapping, suffix order and depth.

    The depth of a row is how many characters of its segment come before its suffix.
    """

    def __init__(self, parts: list[bytes]):
        text, depth = np.zeros(sum(len(p) + 1 for p in parts), np.uint16), np.zeros(sum(len(p) + 1 for p in parts), np.int32)
        at = 0
        for p in parts:
            text[at:at + len(p)] = np.frombuffer(p, np.uint8)
            text[at:at + len(p)] += 1
            depth[at:at + len(p) + 1] = np.arange(len(p) + 1)
            at += len(p) + 1
        n = len(text)
        # seven characters at once, then prefix doubling over what is still equal
        key = np.zeros(n, np.int64)
        for k in range(7):
            key[:n - k] |= text[k:].astype(np.int64) << (9 * (6 - k))
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([True], np.diff(key[order]) != 0))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n))
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(starts, sizes)
        open_, h = order[np.repeat(sizes > 1, sizes)], 7
        while len(open_):
            ahead = open_ + h
            key = rank[open_] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
            by = np.argsort(key, kind="stable")
            open_, key = open_[by], key[by]
            at = np.arange(len(open_))
            outer, inner = (np.concatenate(([True], np.diff(x) != 0)) for x in (key // (n + 1), key))
            rank[open_] = key // (n + 1) + np.maximum.accumulate(np.where(inner, at, 0)) - np.maximum.accumulate(np.where(outer, at, 0))
            sizes = np.diff(np.append(np.flatnonzero(inner), len(open_)))
            open_ = open_[np.repeat(sizes > 1, sizes)]
            h *= 2
        self.order = np.empty(n, np.int32)
        self.order[rank] = np.arange(n, dtype=np.int32)
        self.depth = depth[self.order]
        self.chars = text[self.order - 1]
        self.lf = rank[self.order - 1].astype(np.int32)


def merge_shards(shards: list[ShardBWT], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, position, block) of all suffixes that share their first ``length`` characters with another.

    The interleave of the shards' rows starts as their concatenation. In each round every row moves
    to the row of its one-longer suffix, stably by that suffix's first character; rows that agree
    in it and came from one block form a block. Blocks of one row can never grow again, and rows that
    are not ``length`` characters deep would run out of their segment, so neither is carried on.
    """
    sizes = np.array([len(s.order) for s in shards])
    base = np.cumsum(sizes) - sizes
    chars = np.concatenate([s.chars for s in shards])
    lf = np.concatenate([s.lf + np.int32(b) for s, b in zip(shards, base)])
    rows = np.flatnonzero(np.concatenate([s.depth >= length for s in shards])).astype(np.int32)
    block = np.zeros(len(rows), np.int32)
    for _ in range(length):
        c = chars[rows]
        by = np.argsort(c, kind="stable")
        rows, block, c = lf[rows[by]], block[by], c[by]
        if not len(rows):
            break
        new = np.concatenate(([True], (np.diff(c) != 0) | (np.diff(block) != 0)))
        starts = np.flatnonzero(new)
        counts = np.diff(np.append(starts, len(rows)))
        many = counts > 1
        keep = np.repeat(many, counts)
        rows, block = rows[keep], np.repeat(np.arange(int(many.sum()), dtype=np.int32), counts[many])
    shard = np.searchsorted(base, rows, "right") - 1
    order = np.concatenate([s.order for s in shards])
    return shard, order[rows], block


def _partnered(own: list[tuple], length: int) -> list[tuple]:
    """The segments (key, doc, row, first, offset, text) that can share a string with another one.

    A string around an anchor has half of its other bytes on one side of it at least, so two
    segments that share one agree in that half next to the anchor.
    """
    half = (length - GRAM + 1) // 2
    sides = []
    for key, _, _, _, a, text in own:
        sides.append(((key, 0, text[a - half:a]) if a >= half else None, (key, 1, text[a + GRAM:a + GRAM + half]) if len(text) >= a + GRAM + half else None))
    counts = Counter(x for pair in sides for x in pair if x)
    return [x for x, (left, right) in zip(own, sides) if (left and counts[left] > 1) or (right and counts[right] > 1)]


def _later_starts(own: list[tuple], length: int) -> list[tuple]:
    """(row, first, n) runs of starts, in segments (key, doc, row, first, offset, text), whose string starts earlier too."""
    own = _partnered(own, length)
    if not own:
        return []
    shards, members, part, size = [], [], [], 0
    for k, x in enumerate(own):
        part.append(k)
        size += len(x[5]) + 1
        if size >= _SHARD or k == len(own) - 1:
            shards.append(ShardBWT([own[i][5] for i in part]))
            members.append(part)
            part, size = [], 0
    shard, pos, block = merge_shards(shards, length)
    if not len(pos):
        return []
    seg = np.empty(len(pos), np.int64)
    offset = np.empty(len(pos), np.int64)
    for s, part in enumerate(members):
        at = np.flatnonzero(shard == s)
        begins = np.cumsum([0] + [len(own[i][5]) + 1 for i in part])
        local = np.searchsorted(begins, pos[at], "right") - 1
        seg[at], offset[at] = np.array(part)[local], pos[at] - begins[local]
    doc, row, first = (np.array([x[i] for x in own], np.int64) for i in (1, 2, 3))
    where = first[seg] + offset
    order = np.lexsort((where, row[seg], doc[seg], block))
    later = np.concatenate(([False], block[order][1:] == block[order][:-1]))
    rows, starts = row[seg][order][later], where[order][later]
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    if not len(rows):
        return []
    new = np.flatnonzero(np.concatenate(([True], (np.diff(rows) != 0) | (np.diff(starts) != 1))))
    return list(zip(rows[new].tolist(), starts[new].tolist(), np.diff(np.append(new, len(rows))).tolist()))


def _merged(parts: DataFrame, length: int) -> DataFrame:
    """(_row, first, n) of later starts among segments (key, doc, _row, first, offset, part) sorted by key in each partition."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, size = None, [], 0

        def out(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], names=["_row", "first", "n"])

        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "_row", "first", "offset", "part"))):
                # only whole anchors are merged together
                if x[0] != key and size >= _BATCH:
                    yield out(_later_starts(own, length))
                    own, size = [], 0
                key = x[0]
                own.append(x)
                size += len(x[5]) + 1
        if own:
            yield out(_later_starts(own, length))

    return parts.mapInArrow(walk, "_row long, first long, n long")


def _segments_of(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """(doc, _row, text, _s): the documents with their segments (key, first, offset, n)."""
    own = open_.groupBy("_row").agg(F.collect_list(F.struct("key", "first", "offset", "n")).alias("_s"))
    return docs.join(own, "_row").select("doc", "_row", "text", "_s")


def _parts(batch: pa.RecordBatch, length: int) -> Iterator[tuple]:
    """(key, doc, row, first, offset, bytes) of each segment."""
    for doc, row, text, own in zip(batch.column("doc").to_pylist(), batch.column("_row").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("_s").to_pylist()):
        text = text.as_py()
        for s in own:
            yield s["key"], doc, row, s["first"], s["offset"], text[s["first"]:s["first"] + s["n"] + length - 1]


def _wide_starts(docs: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """(_row, first, n) of later starts among the segments of anchors that are too wide for one task.

    Of the starts of one string in a batch of documents only the first is held against those of other batches.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, out = {}, []
            for _, doc, row, first, _, part in _parts(batch, length):
                for i in range(len(part) - length + 1):
                    h, at = xxhash.xxh3_128_digest(part[i:i + length]), (doc, row, first + i)
                    if h in least:
                        at, least[h] = max(at, least[h]), min(at, least[h])
                        out.append((None, *at))
                    else:
                        least[h] = at
            out += [(h, *at) for h, at in least.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), *(pa.array([x[i] for x in out], pa.int64()) for i in (1, 2, 3))], names=["h", "doc", "_row", "first"])

    starts = stage(_segments_of(docs, open_).mapInArrow(each, "h binary, doc long, _row long, first long"), "starts")
    one = starts.where("h is not null")
    least = one.groupBy("h").agg(F.min(F.struct("doc", "_row", "first")).alias("at"), F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "at")
    later = attach_by_key(one, least, "h", "_row").where("at is not null and not (at._row = _row and at.first = first)")
    return starts.where("h is null").select("_row", "first").unionByName(later.select("_row", "first")).withColumn("n", F.lit(1).cast("long"))


def repeated_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(_row, first, n): runs of starts whose string starts earlier too; docs (doc, _row, text), bucketed by _row."""
    if not GRAM <= length <= 30_000:
        raise ValueError("length must be from 16 to 30,000")
    parts = partitions(docs.sparkSession)
    rows = anchored(docs, length).repartition(parts, "key")
    rows = rows.withColumn("left", F.shiftrightunsigned("sides", 32)).withColumn("right", F.col("sides").bitwiseAND(0xFFFFFFFF)).drop("sides")
    same = Window.partitionBy("key", "dup", "hash").orderBy("doc", "_row", "first")
    rows = rows.withColumn("again", F.col("dup") | (F.row_number().over(same) > 1))
    # a segment is open if another one agrees with it in the half beside the anchor; all windows lie inside a key
    alike = F.lit(False)
    for side in ("left", "right"):
        rows = rows.withColumn(f"n_{side}", F.count_if(~F.col("again")).over(Window.partitionBy("key", "dup", side)))
        alike = alike | ((F.col(side) != 0) & (F.col(f"n_{side}") > 1))
    rows = rows.withColumn("open", ~F.col("again") & alike)
    rows = rows.withColumn("wide", F.count_if("open").over(Window.partitionBy("key", "dup")) > WIDE)
    known = stage(rows.where("again or open").select("key", "again", "wide", "doc", "_row", "first", "n"), "known")
    known = known.withColumn("offset", F.shiftright("n", 16)).withColumn("n", F.col("n").bitwiseAND(0xFFFF))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.binary()]
        for batch in batches:
            out = list(_parts(batch, length))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kinds[i]) for i in range(6)], names=["key", "doc", "_row", "first", "offset", "part"])

    texts = _segments_of(docs, known.where("not again and not wide")).mapInArrow(cut, "key long, doc long, _row long, first long, offset long, part binary")
    found = _merged(texts.repartition(parts, "key").sortWithinPartitions("key"), length)
    found = known.where("again").select("_row", "first", F.col("n").cast("long").alias("n")).unionByName(found)
    wide = known.where("not again and wide")
    return found if wide.isEmpty() else found.unionByName(_wide_starts(docs, wide, length))


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc, _row, text) as a table bucketed by _row, so that later joins on it do not move the texts again."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return bucketed(d.withColumn("_row", F.monotonically_increasing_id()), "_row")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text bytes, n_bytes, n_removed, n_spans): every document without its later repeats."""
    docs = numbered(docs)
    runs = repeated_runs(docs, length).groupBy("_row").agg(F.collect_list(F.struct("first", "n")).alias("_runs"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_bytes, n_removed, n_spans = [], [], [], []
            for text, own in zip(batch.column("text").cast(pa.binary()), batch.column("_runs").to_pylist()):
                text = text.as_py()
                n_bytes.append(len(text))
                if not own:
                    kept.append(text)
                    n_removed.append(0)
                    n_spans.append(0)
                    continue
                edge = np.zeros(len(text) + 1, np.int64)
                first, n = np.array([x["first"] for x in own]), np.array([x["n"] for x in own])
                np.add.at(edge, first, 1)
                np.add.at(edge, first + n + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
                n_removed.append(int(gone.sum()))
                n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans))],
                                             names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return docs.join(runs, "_row", "left").select("doc_id", "text", "_runs").mapInArrow(drop, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
