"""Alignment of two tokenizers' tokens over the same bytes, very long documents by composed fragments.

Tokenizer A is byte-level BPE (a JSON file) and reads a space and the text, B is sentencepiece and
adds that space itself. Byte offsets at which tokens of both end cut the text into groups; every A
token of a group is linked to every B token of it. Links are graded by the number of documents of
the whole corpus that hold the id pair linked.

No token of A or B goes from a character that is not white space on into a space, which is proven from
the vocabulary of B and the splitting pattern of A. So texts fall into pieces at such places, both
tokenizers can encode pieces apart, and a task encodes each piece once. A document over
``LONG`` characters is cut into byte ranges at whatever characters come; a range's task encodes
the pieces that touch it and keeps the tokens that end in it: an open prefix, closed groups, an
open suffix. Such fragments form a monoid: composition joins a suffix to the next prefix,
which closes a group, and a fragment without a cut is open on both sides. Fragments are
reduced in a tree by Spark tasks, ``FAN`` neighbours a round; closed groups stay where they
arose, as written rows.

Tasks count the id pairs of blocks of documents before anything is shuffled, and the graded pairs come back
to each block as its own small dictionary, so links are never shuffled one by one.

Defined cases: a text that is null or empty, or whose tokens' joined bytes differ from a space and
the text, has no tokens: zeros and an empty digest; strings like special tokens are plain text; repeated rows are documents
of their own; other columns but text pass through, except that the operator's own columns replace
columns of their names; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexloom.llm.bpe import byte_chars
from codexloom.llm.common import pack, stage, unpack, with_fields

#: Characters from which on a document is cut into ranges, and of a range.
LONG = 16_384
#: Fragments that are composed by one task in a round.
FAN = 16
#: Different id pairs of documents, added up, at which a block of documents is closed.
BLOCK = 1 << 19
#: Characters of the pieces that a worker keeps.
CACHE = 5_000_000
#: Documents that a task gives out at a time.
ROWS = 512
#: Characters of documents whose new pieces are aligned together.
TOGETHER = 1 << 16
#: Links of one group beyond which equal ids are counted before pairs are formed.
WIDE = 4096

DIGEST = ("n_a", "n_b", "n_groups", "n_links")
SPACE = "▁"


class Aligned:
    """Groups of a stream of bytes: ids and ends of both tokenizers, and the ends that they share."""

    def __init__(self, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray):
        self.a, self.a_ends, self.b, self.b_ends = a, a_ends, b, b_ends
        # both are in ascending order, without repeats but for tokens of no bytes
        at = np.minimum(np.searchsorted(b_ends, a_ends), max(len(b_ends) - 1, 0))
        self.cuts = a_ends[b_ends[at] == a_ends] if len(b_ends) else a_ends[:0]

    def between(self, low: int, high: int) -> Aligned:
        """The tokens that end behind low and not behind high."""
        i, j = np.searchsorted(self.a_ends, [low, high], "right")
        k, m = np.searchsorted(self.b_ends, [low, high], "right")
        return Aligned(self.a[i:j], self.a_ends[i:j], self.b[k:m], self.b_ends[k:m])


class Pair:
    """Both tokenizers, with the byte strings of their tokens."""

    def __init__(self, a: str, b: bytes, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        back = {c: i for i, c in enumerate(byte_chars())}
        of_a = {i: bytes(map(back.__getitem__, t)) if set(t) <= back.keys() else t.encode() for t, i in self.a.get_vocab().items()}
        self.n_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("pieces that go on into a space are not proven")
        self.bytes_a = [of_a.get(i, b"") for i in range(max(of_a) + 1)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = np.array(list(map(len, self.bytes_a))), np.array(list(map(len, self.bytes_b)))
        self.lone_space = self.b.piece_to_id(SPACE)
        #: a space behind a character that is no white space to either side
        self.safe = re.compile(r"(?<=\S)(?= )")
        self.size = cache
        self._forget()

    def align(self, stream: str) -> Aligned | None:
        """A stream that begins with a space and the places where it can be cut; None where either tokenizer changes its bytes."""
        a = np.array(self.a.encode(stream, add_special_tokens=False).ids, np.int64)
        b = np.array(self.b.encode(stream[1:]) if len(stream) > 1 else [self.lone_space], np.int64)
        raw = stream.encode()
        # bytes of A can only be missing: its characters stand for bytes one by one
        if self.len_a[a].sum() != len(raw) or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != raw:
            return None
        return Aligned(a, np.cumsum(self.len_a[a]), b, np.cumsum(self.len_b[b]))

    def _forget(self) -> None:
        """Of each piece its number; per number its groups' text, and (first code, codes, tokens of A, of B, groups)."""
        self.held, self.known, self.texts, self.wide = 0, {}, [], {}
        self.table, self.codes, self.n_codes = np.zeros((1 << 14, 5), np.int64), np.zeros(1 << 16, np.int64), 0

    def learn(self, pieces: set[str]) -> None:
        """Align what is new of some pieces; those that do not end in white space as one stream."""
        new = pieces.difference(self.known)
        size = sum(map(len, new))
        if self.held + size > self.size and self.known:
            self._forget()
            new, size = pieces, sum(map(len, pieces))
        self.held += size
        whole, tail = [p for p in new if not p[-1].isspace()], [p for p in new if p[-1].isspace()]
        got = self.align("".join(whole)) if whole else None
        if got is not None:
            self._keep(whole, got, np.cumsum([len(p.encode()) for p in whole]))
            whole = []
        for p in whole + tail:
            got = self.align(p)
            if got is None:
                self.known[p] = -1
            else:
                self._keep([p], got, np.array([len(p.encode())]))

    def _keep(self, pieces: list[str], got: Aligned, ends: np.ndarray) -> None:
        groups = digested(got, self.n_b)
        high = np.searchsorted(got.cuts, ends, "right")
        low = np.concatenate(([0], high[:-1]))
        text, at = ";".join(groups.texts), np.concatenate(([0], np.cumsum(np.fromiter(map(len, groups.texts), np.int64, len(groups.texts)) + 1)))
        starts, counts = groups.pair_starts[low], groups.pair_starts[high] - groups.pair_starts[low]
        n, codes = len(self.texts), self.n_codes + len(groups.codes)
        self.table, self.codes = _room(self.table, n, n + len(pieces)), _room(self.codes, self.n_codes, codes)
        self.table[n:n + len(pieces)] = np.stack((starts + self.n_codes, counts, groups.a_starts[high] - groups.a_starts[low], groups.b_starts[high] - groups.b_starts[low], high - low), 1)
        self.codes[self.n_codes:codes] = groups.codes
        self.n_codes = codes
        self.texts += [text[i:j] for i, j in zip(at[low].tolist(), (at[high] - 1).tolist())]
        self.known.update(zip(pieces, range(n, n + len(pieces))))
        if groups.weights.max(initial=0) > 1:
            self.wide.update((n + k, groups.weights[i:i + c].copy()) for k, (i, c) in enumerate(zip(starts.tolist(), counts.tolist())) if groups.weights[i:i + c].max(initial=0) > 1)

    def summary(self, pieces: list[str]) -> Summary | None:
        """What learned pieces amount to together, or None if one of them has no tokens."""
        numbers = list(map(self.known.__getitem__, pieces))
        at = np.array(numbers, np.int64)
        if not len(at):
            return Summary([0, 0, 0, 0], "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        if at.min() < 0:
            return None
        rows = self.table[at]
        starts, counts = rows[:, 0], rows[:, 1]
        ends = np.cumsum(counts)
        codes = self.codes[np.repeat(starts - ends + counts, counts) + np.arange(ends[-1])]
        weights = None
        if self.wide and not self.wide.keys().isdisjoint(numbers):
            weights = np.concatenate([self.wide.get(i, np.ones(n, np.int64)) for i, n in zip(numbers, counts.tolist())])
        found, weights = summed(codes, weights)
        return Summary([*rows[:, 2:].sum(0).tolist(), int(weights.sum())], ";".join(map(self.texts.__getitem__, numbers)), found, weights)

    def documents(self, texts: list[str]) -> Iterator[Summary | None]:
        """The summary of each text, or None without tokens; new pieces of some texts at a time are aligned together."""
        held, size = [], 0
        for i, text in enumerate(texts):
            held.append(self.safe.split(" " + text) if text else None)
            size += len(text)
            if size >= TOGETHER or i == len(texts) - 1:
                self.learn({p for own in held if own for p in own})
                yield from (self.summary(own) if own else None for own in held)
                held, size = [], 0


def _room(a: np.ndarray, used: int, need: int) -> np.ndarray:
    """An array with space for ``need`` rows, at least doubled when it grows."""
    return a if need <= len(a) else np.concatenate((a[:used], np.zeros((max(need, 2 * used) - used, *a.shape[1:]), a.dtype)))


class Summary(NamedTuple):
    """Tokens of A, of B, groups and links; the groups' text; codes of the linked id pairs in order, and each one's number of links."""

    numbers: list[int]
    text: str
    codes: np.ndarray
    weights: np.ndarray


@functools.lru_cache(maxsize=1)
def loaded(a: str, b: bytes) -> Pair:
    """One pair of tokenizers for each worker, with the pieces that it has seen."""
    return Pair(a, b)


def summed(codes: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in order and the sum of each one's weights, 1 each if there are none."""
    if weights is None:
        return np.unique(codes, return_counts=True)
    found, at = np.unique(codes, return_inverse=True)
    out = np.zeros(len(found), np.int64)
    np.add.at(out, at, weights)
    return found, out


def product(a: np.ndarray, b: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes a * n_b + b of the id pairs of one group, and the number of links of each; equal ids are counted first."""
    ia, wa = np.unique(a, return_counts=True)
    ib, wb = np.unique(b, return_counts=True)
    return (ia[:, None] * n_b + ib).ravel(), (wa[:, None] * wb).ravel()


class Groups(NamedTuple):
    """Texts of groups; where each begins among the tokens of A, those of B, and the codes; a code and a number of links for each id pair of each group."""

    texts: list[str]
    a_starts: np.ndarray
    b_starts: np.ndarray
    pair_starts: np.ndarray
    codes: np.ndarray
    weights: np.ndarray


def digested(x: Aligned, n_b: int) -> Groups:
    """All groups of a stream that ends with a cut."""
    a_starts = np.concatenate(([0], np.searchsorted(x.a_ends, x.cuts, "right")))
    b_starts = np.concatenate(([0], np.searchsorted(x.b_ends, x.cuts, "right")))
    na, nb = np.diff(a_starts), np.diff(b_starts)
    a, b = list(map(str, x.a.tolist())), list(map(str, x.b.tolist()))
    spans = list(zip(i := a_starts.tolist(), i[1:], j := b_starts.tolist(), j[1:]))
    texts = [f"{a[s]}|{b[u]}" if t - s == 1 and v - u == 1 else f"{','.join(a[s:t])}|{','.join(b[u:v])}" for s, t, u, v in spans]
    if len(na) and (na * nb).max() > WIDE:
        both = [product(x.a[s:t], x.b[u:v], n_b) for s, t, u, v in spans]
        sizes, codes, weights = [len(c) for c, _ in both], np.concatenate([c for c, _ in both]), np.concatenate([w for _, w in both])
    else:
        # every A token meets the B tokens of its group, one after the other
        group_of_a = np.repeat(np.arange(len(na)), na)
        width = nb[group_of_a]
        ends = np.cumsum(width)
        step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - width, width)
        codes = np.repeat(x.a, width) * n_b + x.b[np.repeat(b_starts[:-1][group_of_a], width) + step]
        sizes, weights = na * nb, np.ones(len(codes), np.int64)
    return Groups(texts, a_starts, b_starts, np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), codes, weights)


def ranges(pair: Pair, text: str, size: int) -> Iterator[tuple[str, int, int]]:
    """(window, skip, take) for each byte range of a long document: the pieces that touch the range, and the
    window's bytes before and up to the end of the range. Ranges end every ``size`` characters, wherever that is, but not inside a piece of over ``size``."""
    stream = " " + text
    cuts = np.array([0, *(m.start() for m in pair.safe.finditer(stream)), len(stream)])
    at = np.arange(size, len(stream), size)
    left, right = cuts[np.searchsorted(cuts, at, "right") - 1], cuts[np.searchsorted(cuts, at, "left")]
    fine = right - left <= size
    ends, low, high = [0, *at[fine].tolist(), len(stream)], [0, *left[fine].tolist()], [*right[fine].tolist(), len(stream)]
    for start, end, i, j in zip(ends, ends[1:], low, high):
        before = len(stream[i:start].encode())
        yield stream[i:j], before, before + len(stream[start:end].encode())


FRAGMENT = "_row long, _k int, kind int, ok boolean, cut boolean, first int, pa array<int>, pb array<int>, sa array<int>, sb array<int>, n_a long, n_b long, n_groups long, n_links long, groups string, codes array<long>, weights array<long>"
FIELDS = [f.split()[0] for f in FRAGMENT.split(", ")]
KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), *[pa.list_(pa.int32())] * 4, *[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
#: kinds of rows: a fragment's open ends, the group that a range's first cut closes, the groups inside a range
OPEN, JOINED, INSIDE = 0, 1, 2


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows) if rows else [[]] * len(KINDS), KINDS)], names=FIELDS)


def _open(row: int, k: int, ok: bool, cut: bool, first: int | None, ends: tuple) -> tuple:
    return (row, k, OPEN, ok, cut, first, *ends, *[None] * 7)


def _whole(x: Aligned, n_b: int) -> Summary:
    groups = digested(x, n_b)
    codes, weights = summed(groups.codes, groups.weights)
    return Summary([len(x.a), len(x.b), len(groups.texts), int(weights.sum())], ";".join(groups.texts), codes, weights)


def _inside(row: int, k: int, parts: list[Summary]) -> list[tuple]:
    """The row of a range's closed groups, if there are any."""
    parts = [p for p in parts if p.numbers[2]]
    if not parts:
        return []
    codes, weights = summed(np.concatenate([p.codes for p in parts]), np.concatenate([p.weights for p in parts]))
    na, nb, groups, links = (sum(n) for n in zip(*(p.numbers for p in parts)))
    return [(row, k, INSIDE, True, None, None, *[None] * 4, na, nb, groups, links, ";".join(p.text for p in parts), codes, weights)]


def _one_group(row: int, k: int, a: list[int], b: list[int], n_b: int) -> tuple:
    text = f"{','.join(map(str, a))}|{','.join(map(str, b))}"
    return (row, k, JOINED, True, None, None, *[None] * 4, len(a), len(b), 1, len(a) * len(b), text, *product(np.array(a, np.int64), np.array(b, np.int64), n_b))


def fragment(pair: Pair, row: int, k: int, window: str, skip: int, take: int) -> list[tuple]:
    """The rows of one range: its open ends, and its closed groups if any. Only the window's first and last piece can reach over the range."""
    failed = [_open(row, k, False, False, None, ([], [], [], []))]
    head, *middle = pair.safe.split(window)
    tail = middle.pop() if middle else None
    x = pair.align(head)
    if tail is None:
        if x is None:
            return failed
        x = x.between(skip, take)
        if not len(x.cuts):
            return [_open(row, k, True, False, None, (x.a, x.b, [], []))]
        first, last = int(x.cuts[0]), int(x.cuts[-1])
        open_, inner, rest = x.between(skip, first), [_whole(x.between(first, last), pair.n_b)], x.between(last, take)
    else:
        pair.learn(set(middle))
        y, between = pair.align(tail), pair.summary(middle)
        if x is None or y is None or between is None:
            return failed
        x, y = x.between(skip, len(head.encode())), y.between(0, take - len(window.encode()) + len(tail.encode()))
        first, last = int(x.cuts[0]), int(y.cuts[-1]) if len(y.cuts) else 0
        open_, inner, rest = x.between(skip, first), [_whole(x.between(first, 1 << 62), pair.n_b), between, _whole(y.between(0, last), pair.n_b)], y.between(last, 1 << 62)
    return [_open(row, k, True, True, k, (open_.a, open_.b, rest.a, rest.b)), *_inside(row, k, inner)]


def compose(parts: list[dict], n_b: int) -> list[tuple]:
    """One fragment of neighbouring ones, given in order, and the groups that close between them."""
    row, ok, cut, first, closed = parts[0]["_row"], all(p["ok"] for p in parts), False, None, []
    pa_, pb, sa, sb = [], [], [], []
    for p in parts:
        if not p["cut"]:
            a, b = (sa, sb) if cut else (pa_, pb)
            a += p["pa"]
            b += p["pb"]
        elif not cut:
            cut, first = True, p["first"]
            pa_, pb, sa, sb = pa_ + p["pa"], pb + p["pb"], list(p["sa"]), list(p["sb"])
        else:
            if ok:
                closed.append(_one_group(row, p["first"], sa + p["pa"], sb + p["pb"], n_b))
            sa, sb = list(p["sa"]), list(p["sb"])
    return [_open(row, parts[0]["_k"], ok, cut, first, (pa_, pb, sa, sb)), *closed]


def _reduced(spark: SparkSession, fragments: DataFrame, n_b: int) -> tuple[DataFrame, DataFrame]:
    """(root fragments, closed groups) of all long documents. Each round leaves one fragment of ``FAN`` neighbours; a group may hold a third of all documents' ranges, but no task gets more than ``FAN``."""
    closed = fragments.where(F.col("kind") != OPEN)
    level = fragments.where(F.col("kind") == OPEN).select(*FIELDS)
    top = fragments.agg(F.max("_k")).first()[0] or 0

    def work(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_batch(compose(sorted(table.to_pylist(), key=lambda r: r["_k"]), n_b))])

    while top:
        top //= FAN
        made = stage(level.groupBy("_row", F.expr(f"_k div {FAN}")).applyInArrow(work, FRAGMENT), "composed")
        closed = closed.unionByName(made.where(F.col("kind") != OPEN))
        level = made.where(F.col("kind") == OPEN).withColumn("_k", F.expr(f"int(_k div {FAN})"))
    return level, closed


def _hashed(closed: DataFrame) -> DataFrame:
    """(_row, groups_sha256): groups in order, streamed through a running digest."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, out = None, None, []
        for batch in batches:
            for row, text in zip(batch.column("_row").to_pylist(), batch.column("groups")):
                if row != now:
                    if sha:
                        out.append((now, sha.hexdigest()))
                    now, sha = row, hashlib.sha256()
                else:
                    sha.update(b";")
                sha.update(text.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([s for _, s in out], pa.string())], names=["_row", "groups_sha256"])
            out = []
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([sha.hexdigest()], pa.string())], names=["_row", "groups_sha256"])

    return closed.select("_row", "_k", "kind", "groups").repartition("_row").sortWithinPartitions("_row", "_k", "kind").select("_row", "groups").mapInArrow(emit, "_row long, groups_sha256 string")


def align_tokens(docs: DataFrame, a: str, b: str, long: int = LONG, block: int = BLOCK) -> DataFrame:
    """docs without text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    ``a`` and ``b`` are the paths of the two vocabularies on the driver; executors get their contents.
    """
    spark = docs.sparkSession
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        held = spark.sparkContext.broadcast((f.read(), g.read()))
    n_b = Pair(*held.value).n_b
    packed = pack(docs)
    keep = ["doc_id", "_rest"]
    fields = [("_what", pa.string()), ("_block", pa.int64()), *((c, pa.int64()) for c in DIGEST), ("groups_sha256", pa.string()), ("codes", pa.binary()), ("weights", pa.binary()),
              ("code", pa.int64()), ("n_docs", pa.int64()), ("_k", pa.int32()), ("_window", pa.string()), ("_skip", pa.int64()), ("_take", pa.int64())]
    ddl = "_what string, _block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, weights binary, code long, n_docs long, _k int, _window string, _skip long, _take long"

    def cells(batch: pa.RecordBatch, of: list, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(of, pa.int32())) for c in keep] + [pa.array([r.get(n) for r in rows], t) for n, t in fields], names=keep + [n for n, _ in fields])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number, row = loaded(*held.value), TaskContext.get().partitionId() << 33, TaskContext.get().partitionId() << 33
        codes, size = [], 0

        def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(codes), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.nulls(len(found), batch.schema.field(c).type) for c in keep] + [pa.array(np.full(len(found), "pair")) if m == "_what" else pa.array(np.full(len(found), number)) if m == "_block"
                                              else pa.array(found) if m == "code" else pa.array(n) if m == "n_docs" else pa.nulls(len(found), t) for m, t in fields], names=keep + [m for m, _ in fields])

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            of, rows = [], []
            for i, (text, got) in enumerate(zip(texts, pair.documents(["" if len(t) > long else t for t in texts]))):
                if len(rows) >= ROWS:
                    yield cells(batch, of, rows)
                    of, rows = [], []
                of.append(i)
                if len(text) > long:
                    row += 1
                    rows.append({"_what": "document", "_k": 0, "_block": row})
                    for k, (window, skip, take) in enumerate(ranges(pair, text, long)):
                        yield cells(batch, [None], [{"_what": "range", "_block": row, "_k": k, "_window": window, "_skip": skip, "_take": take}])
                    continue
                if got is None:
                    rows.append({"_what": "document", **dict.fromkeys(DIGEST, 0), "groups_sha256": ""})
                    continue
                rows.append({"_what": "document", "_block": number, **dict(zip(DIGEST, got.numbers)), "groups_sha256": hashlib.sha256(got.text.encode()).hexdigest(),
                             "codes": got.codes.astype("<i8").tobytes(), "weights": got.weights.astype("<i4").tobytes()})
                codes.append(got.codes)
                size += len(got.codes)
                if size >= block:
                    yield counted(batch)
                    codes, size, number = [], 0, number + 1
            yield cells(batch, of, rows)
        if codes:
            yield counted(batch)

    first = stage(packed.mapInArrow(emit, with_fields(packed, keep, ddl)), "aligned")
    whole, pairs = first.where("_what = 'document'"), first.where("_what = 'pair'").select("_block", "code", "n_docs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                pair = loaded(*held.value)
                yield _batch(fragment(pair, r["_block"], r["_k"], r["_window"], r["_skip"], r["_take"]))

    parts = first.where("_what = 'range'").select("_block", "_k", "_window", "_skip", "_take").repartition("_block", "_k")
    roots, closed = _reduced(spark, stage(parts.mapInArrow(cut, FRAGMENT), "fragments"), n_b)
    # the start of a text is a cut, so a root's prefix is a group; its suffix is empty, as the tokens of both end with the text
    valid = roots.where("ok").select("_row")

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([_one_group(r["_row"], r["first"], r["pa"], r["pb"], n_b) for r in batch.to_pylist()])

    closed = stage(closed.join(valid, "_row", "left_semi").select(*FIELDS).unionByName(roots.where("ok").select(*FIELDS).mapInArrow(begun, FRAGMENT)), "closed")
    linked = closed.select("_row", F.explode(F.arrays_zip("codes", "weights")).alias("x")).groupBy("_row", F.col("x.codes").alias("code")).agg(F.sum("x.weights").alias("w"))
    linked = stage(linked, "linked")
    counts = pairs.select("code", "n_docs").unionByName(linked.select("code", F.lit(1).cast("long").alias("n_docs"))).groupBy("code").agg(F.sum("n_docs").alias("n"))
    counts = stage(counts, "counts")
    # at most one row for each entry of A's vocabulary
    best = counts.groupBy(F.expr(f"code div {n_b}").alias("_a")).agg(F.max("n").alias("most"))
    graded = stage(counts.withColumn("_a", F.expr(f"code div {n_b}")).join(F.broadcast(best), "_a").select("code", "n", (F.col("n") == F.col("most")).alias("top")), "graded")

    def scored(docs_: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("code")
        code, n, top = known.column("code").to_numpy(), known.column("n").to_numpy(), known.column("top").to_numpy()
        sums = []
        for c, w in zip(docs_.column("codes"), docs_.column("weights")):
            at, w = np.searchsorted(code, np.frombuffer(c.as_py(), "<i8")), np.frombuffer(w.as_py(), "<i4").astype(np.int64)
            sums.append((int(w[top[at]].sum()), int((w * n[at]).sum())))
        out = docs_.drop_columns(["_block", "codes", "weights"])
        return out.append_column("n_best", pa.array([s for s, _ in sums], pa.int64())).append_column("count_sum", pa.array([s for _, s in sums], pa.int64()))

    short = whole.where("codes is not null").select(*keep, *DIGEST, "groups_sha256", "_block", "codes", "weights")
    names = [*keep, *DIGEST, "groups_sha256"]
    schema = with_fields(short, names, "n_best long, count_sum long")
    known = pairs.join(graded, "code").select(F.col("_block").alias("_of"), "code", "n", "top")
    done = short.groupBy("_block").cogroup(known.groupBy("_of")).applyInArrow(scored, schema)

    sums = closed.groupBy("_row").agg(*[F.sum(c).alias(c) for c in DIGEST])
    grades = linked.join(graded, "code").groupBy("_row").agg(F.sum(F.when(F.col("top"), F.col("w")).otherwise(0)).alias("n_best"), F.sum(F.col("w") * F.col("n")).alias("count_sum"))
    of_long = sums.join(_hashed(closed), "_row").join(grades, "_row").withColumnRenamed("_row", "_block")
    numbers = [*DIGEST, "n_best", "count_sum"]
    huge = whole.where("_k = 0").select(*keep, "_block").join(of_long, "_block", "left").select(*keep, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    none = whole.where("_block is null").select(*keep, *[F.lit(0).cast("long").alias(c) for c in numbers], F.lit("").alias("groups_sha256"))
    outputs = [*numbers, "groups_sha256"]
    got = done.select(*keep, *outputs).unionByName(huge).unionByName(none)
    return unpack(got, docs.drop("text"), *outputs)


def op13_alignment(spark: SparkSession, sf_dir: str, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align_tokens(docs, public_tokenizers.path(a), public_tokenizers.path(b))
