"""Near-duplicate paragraphs by MinHash banding, removed by components.

A paragraph is a line of at least ``MIN_WORDS`` words. Equal paragraphs (words with A-Z
lower-cased) become one class first. Every class gets a MinHash signature over its 5-word
shingles, cut into bands tuned for high recall: at a similarity of 0.8, ``BANDS`` bands of ``ROWS``
values collide with a probability of 0.998. Buckets of up to ``BUCKET`` classes are settled in one
task each, by exact Jaccard similarity of all members that are not connected yet. In a larger
bucket every class is held against one leader, and all of its classes, linked or not, are dealt into
finer buckets. Buckets whose classes are connected already are done. A finer bucket that is still
large after its own leader is split into blocks, and every two blocks that are not connected already
meet in one task. Links are joined to components, and of each component the first occurrence (smallest
doc_id, then position) is the original, all others are copies. A document loses its runs of copies,
that is copies with nothing but blank lines between them, of ``MIN_RUN`` words or more in all: a
passage goes whether it is one line or wrapped into many. Of shorter runs it loses the paragraphs that stand in
fewer than ``STANDING`` places of the whole corpus, variants counted together; a short line that stands in so many (the name of a licence, a
salutation) is a standing phrase, no passage, and stays.

``drop_passages`` searches what is left for passages inside longer lines or across line ends. A passage is named by minima of its hashes too: of every ``SPREAD``
neighbouring windows of ``WINDOW`` words the least is an anchor, so all equal runs of ``MIN_PASSAGE`` words share
one. An anchor's first place (smallest doc_id, then position) gives the words around it, at most as many as lie before the next anchor, and every other
place of another line is held against them word by word. The words covered so go where they make runs of ``MIN_PASSAGE`` words or more, counted by
different shingles, so that one word said over and over is no passage.

Defined cases: a null text stays null, with no paragraphs; lines of fewer words than a shingle are
never touched and end a run; a run repeated within a document stays once; repeated rows of a doc_id are told apart by
their row and the earlier one keeps; a null doc_id sorts first; an empty table gives an empty
result; other columns pass through ``drop_near_paragraphs``, except that its n_removed replaces a
column of that name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexloom.llm.common import ASCII_LOWER, bucketed, components, n_staged, pack, partitions, stage, stage_only, unpack, with_fields

SHINGLE, SIMILARITY = 5, 0.8
#: From here on a line has a shingle and so a similarity.
MIN_WORDS = SHINGLE
#: Words of neighbouring copies from which on they are removed.
MIN_RUN = 20
#: Places from which on a short copied line counts as a standing phrase.
STANDING = 5
#: Words of an anchor and windows of which one is an anchor; together the words of the shortest passage that is sure to hold one.
WINDOW, SPREAD = 12, 29
MIN_PASSAGE = WINDOW + SPREAD - 1
BANDS, ROWS = 12, 4
#: Larger buckets are split by finer bands, which a pair at 0.8 shares with a probability of 0.999.
BUCKET, FINE_BANDS, FINE_ROWS = 1024, 40, 8
_CHUNK = 1 << 20
_RNG = np.random.default_rng(42)
_A = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def normal(line: bytes, min_words: int = MIN_WORDS) -> bytes | None:
    """The paragraph's words, lower-cased and joined by single blanks; None for too few."""
    if len(line) < 2 * min_words - 1:
        return None
    words = line.translate(ASCII_LOWER).split()
    return b" ".join(words) if len(words) >= min_words else None


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def shingle_hashes(paragraphs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all word shingles in order, where each paragraph's begin)."""
    words, counts = [], []
    for p in paragraphs:
        own = p.split(b" ")
        words += own
        counts.append(len(own))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n, counts = SHINGLE, np.array(counts)
    g = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        g = g * _M1 + h[k:len(h) - n + 1 + k]
    first = np.cumsum(counts) - counts
    # the shingles that would run into the next paragraph go
    last = np.zeros(len(h), bool)
    for k in range(1, n):
        last[(first + counts - k)[counts >= k]] = True
    per = np.maximum(counts - n + 1, 0)
    return _mix(g[~last[:len(g)]]), np.cumsum(per) - per


def band_keys(paragraphs: list[bytes], a: np.ndarray = _A, b: np.ndarray = _B, rows: int = ROWS) -> np.ndarray:
    """A row of band keys per paragraph, of ``rows`` minima each."""
    g, starts = shingle_hashes(paragraphs)
    mins = np.stack([np.minimum.reduceat((g * a + b) >> np.uint64(32), starts) for a, b in zip(a, b)], 1)
    n = mins.shape[1] // rows
    keys = np.zeros((len(paragraphs), n), np.uint64)
    for band in range(n):
        key = np.full(len(paragraphs), band + 1, np.uint64)
        for j in range(rows):
            key = _mix((key ^ mins[:, band * rows + j]) * _M1)
        keys[:, band] = key
    return keys.view(np.int64)


def paragraph_table(docs: DataFrame, min_words: int = MIN_WORDS, with_bands: bool = True) -> DataFrame:
    """(_row, doc_id, pos, h) of every paragraph, and its bands if wanted."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, docs_, texts = batch.column("_row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())
            own, size = [], 0
            for k, (row, doc, text) in enumerate(zip(rows, docs_, texts)):
                for pos, line in enumerate((text.as_py() or b"").split(b"\n")):
                    if (p := normal(line, min_words)) is not None:
                        own.append((row, doc, pos, p))
                        size += len(p)
                if own and (size > _CHUNK or k == len(rows) - 1):
                    yield _batch(own)
                    own, size = [], 0
            if own:
                yield _batch(own)

    def _batch(own: list) -> pa.RecordBatch:
        texts = [x[3] for x in own]
        out = {"_row": pa.array([x[0] for x in own], pa.int64()), "doc_id": pa.array([x[1] for x in own], pa.int64()), "pos": pa.array([x[2] for x in own], pa.int32()),
               "h": pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary())}
        if with_bands:
            out["bands"] = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(own) + 1) * BANDS, BANDS), pa.int32()), pa.array(band_keys(texts).ravel()))
        return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    schema = "_row long, doc_id long, pos int, h binary" + (", bands array<long>" if with_bands else "")
    return docs.select("_row", "doc_id", "text").mapInArrow(emit, schema)


def class_texts(docs: DataFrame, wanted: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(pid, p): the normal text of the wanted (pid, _row, pos)."""
    per_doc = wanted.groupBy("_row").agg(F.collect_list(F.struct("pos", "pid")).alias("want"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pids, texts = [], []
            for text, want in zip(batch.column("text").cast(pa.binary()), batch.column("want").to_pylist()):
                lines = text.as_py().split(b"\n")
                for w in want:
                    pids.append(w["pid"])
                    texts.append(normal(lines[w["pos"]], min_words))
            yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int64()), pa.array(texts, pa.binary())], names=["pid", "p"])

    return docs.select("_row", "text").join(per_doc, "_row").mapInArrow(emit, "pid long, p binary")


def shingles(p: bytes) -> frozenset:
    words = p.split(b" ")
    return frozenset(map(b" ".join, zip(*[words[i:] for i in range(SHINGLE)])))


def similar(x: frozenset, y: frozenset, least: float = SIMILARITY) -> bool:
    """Exact Jaccard similarity of two sets of word shingles, at least ``least``."""
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = len(x & y)
    return both >= least * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(leader, pid) of those pairs whose texts are similar enough."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(shingles(a.as_py()), shingles(b.as_py())) for a, b in zip(batch.column("pa"), batch.column("pb"))]
            yield batch.select(["leader", "pid"]).filter(pa.array(ok, pa.bool_()))

    with_a = pairs.join(texts.select(F.col("pid").alias("leader"), F.col("p").alias("pa")), "leader")
    both = with_a.join(texts.select("pid", F.col("p").alias("pb")), "pid")
    return both.select("leader", "pid", "pa", "pb").mapInArrow(keep, "leader long, pid long")


def _bucket_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(leader, pid) links that connect all similar members of each bucket (key, pid, root) of bounded size.

    Buckets arrive sorted, one after the other. Members are compared unless their root or links of
    the same bucket connect them already.
    """

    def links(own: list[tuple[int, bytes, int]]) -> list[tuple[int, int]]:
        sets, first, out = [shingles(p) for _, p, _ in own], {}, []
        root = [first.setdefault(r, i) for i, (_, _, r) in enumerate(own)]

        def find(i: int) -> int:
            while root[i] != i:
                i = root[i]
            return i

        for i in range(len(own)):
            for j in range(i):
                a, b = find(j), find(i)
                if a != b and similar(sets[i], sets[j]):
                    root[b] = a
                    out.append((own[j][0], own[i][0]))
        return out

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            out = []
            for k, *member in zip(*[batch.column(c).to_pylist() for c in ("key", "pid", "p", "root")]):
                if k != key:
                    out += links(own)
                    key, own = k, []
                own.append(tuple(member))
            yield _pairs(out)
        yield _pairs(links(own))

    def _pairs(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["leader", "pid"])

    n = partitions(members.sparkSession)
    # a text meets its class once and is then copied to the class's buckets
    own = members.groupBy("pid").agg(F.first("root").alias("root"), F.collect_list("key").alias("keys")).join(texts, "pid")
    dealt = own.select(F.explode("keys").alias("key"), "pid", "p", "root").repartition(n, "key").sortWithinPartitions("key", "pid")
    return dealt.mapInArrow(walk, "leader long, pid long")


def _finer(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, pid, root) over new buckets of the classes (pid, root), by bands of fresh and longer signatures."""
    rng = np.random.default_rng(1000)
    a = rng.integers(1, 1 << 63, FINE_BANDS * FINE_ROWS, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, FINE_BANDS * FINE_ROWS, dtype=np.uint64)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                keys = band_keys(part.column("p").to_pylist(), a, b, FINE_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *[pa.array(np.repeat(part.column(c).to_numpy(), FINE_BANDS)) for c in ("pid", "root")]], names=["key", "pid", "root"])

    return rest.join(texts, "pid").select("pid", "root", "p").mapInArrow(emit, "key long, pid long, root long")


def _with_roots(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with root: the component of their pid under the links found, or the pid itself."""
    known = components(found, "leader", "pid").withColumnRenamed("node", "pid")
    return rows.drop("root").join(known, "pid", "left").withColumn("root", F.coalesce("root", "pid"))


def _block_pairs(members: DataFrame, bucket: int) -> DataFrame:
    """(key, pid, root): buckets in which all members of two blocks meet, for all blocks not connected already.

    A block is part of one component (g: its root) or a pool of small ones (g: -1), about half a
    bucket each, so a bucket of one large component and a few others gives few copies.
    """
    half = max(1, bucket // 2)
    groups = stage(members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")), "groups")
    pools = groups.groupBy("key").agg(F.sum(F.when(F.col("c") <= half, F.col("c")).otherwise(0)).alias("pool"), F.countDistinct("root").alias("roots"))
    groups = groups.join(pools.where("roots > 1"), "key")
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.ceil(F.col(n) / half))
    small = F.col("c") <= half
    parts = members.join(groups, ["key", "root"]).select(
        "key", "pid", "root", F.when(small, -1).otherwise(F.col("root")).alias("g"), F.when(small, deal("root", "pool")).otherwise(deal("pid", "c")).alias("b"))
    parts = stage(parts, "parts")
    blocks = stage(parts.groupBy("key", "g", "b").agg(F.count(F.lit(1)).alias("_n")).select("key", "g", "b"), "blocks")
    x, y = (blocks.select("key", F.struct("g", "b").alias(n)) for n in "xy")
    pairs = x.join(y, "key").where("x <= y and (x.g < 0 or x.g <> y.g)")
    each = pairs.select("key", F.xxhash64("key", "x", "y").alias("pair"), F.explode(F.array_distinct(F.array("x", "y"))).alias("z"))
    return parts.join(each.select("key", "z.g", "z.b", "pair"), ["key", "g", "b"]).select(F.col("pair").alias("key"), "pid", "root")


def similar_classes(docs: DataFrame, classes: DataFrame, min_words: int = MIN_WORDS, bucket: int = BUCKET) -> DataFrame:
    """Components (node, root) of classes (pid, _row, pos, bands) under verified similarity.

    Buckets of up to ``bucket`` members are settled whole, one of several with the same members.
    In a larger one all are held against a leader, the member that shares most buckets, and all
    others are dealt into finer buckets. Finer ones that stay large are compared in blocks.
    """
    rows, texts, found = classes.select(F.explode("bands").alias("key"), "pid"), None, None
    for last in (False, True):
        # most keys have one member and go here; both sides are plain shuffles, so a bucket with a large share of the rows is split at run time
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        met = rows.join(sizes, "key")
        met = stage(met if last else met.withColumn("root", F.col("pid")), "met")
        lists = met.where(F.col("n") <= bucket).groupBy("key").agg(
            F.sort_array(F.collect_list(F.struct("pid", "root"))).alias("own"), F.min("root").alias("r"), F.max("root").alias("s"))
        # members of one component have no link to find
        once = lists.where("r < s").groupBy("own").agg(F.min("key").alias("key"))
        small = stage(once.select("key", F.explode("own").alias("m")).select("key", "m.pid", "m.root"), "small")
        large = met.where(F.col("n") > bucket).groupBy("key").agg(
            F.first("n").alias("n"), F.bit_xor(F.xxhash64("pid")).alias("x"), F.min("pid").alias("m"), F.min("root").alias("r"), F.max("root").alias("s"))
        large = stage(large.where("r < s").groupBy("n", "x", "m").agg(F.min("key").alias("key")).select("key"), "large")
        more = not large.isEmpty()
        members = stage(met.join(large, "key").select("key", "n", "pid"), "members") if more else None
        if texts is None:
            ids = small.select("pid").unionByName(members.select("pid")) if more else small.select("pid")
            wanted = classes.select("pid", "_row", "pos").join(ids.distinct(), "pid", "left_semi")
            texts = stage(class_texts(docs, wanted, min_words), "texts")
        links = stage(_bucket_links(small, texts), "links")
        found = links if found is None else found.unionByName(links)
        if not more:
            return components(found, "leader", "pid")
        # a class is in a bounded number of buckets, so they are gathered in its row
        shared = members.groupBy("pid").agg(F.sum("n").alias("w"), F.collect_list("key").alias("keys")).select("pid", "w", F.explode("keys").alias("key"))
        lead = shared.groupBy("key").agg(F.max(F.struct("w", "pid")).alias("l")).select("key", F.col("l.pid").alias("leader"))
        led = stage(members.join(stage(lead, "lead"), "key").where("pid <> leader").select("key", "leader", "pid"), "led")
        found = found.unionByName(stage(_verified(led.select("leader", "pid").distinct(), texts), "linked"))
        if last:
            rest = stage(_with_roots(led.select("key", "pid"), found), "rest")
            return components(found.unionByName(stage(_bucket_links(_block_pairs(rest, bucket), texts), "split")), "leader", "pid")
        # those similar to the leader as well: they can be similar to members that are not
        rest = stage(_with_roots(led.select("pid").distinct(), found), "rest")
        rows = stage(_finer(rest, texts), "finer")


def repeated_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_row, pos, n) of the paragraphs that are copies, n the places of the whole component; docs need a unique _row that follows their order."""
    order = F.struct("doc_id", "_row", "pos")
    classes = paragraph_table(docs, min_words).groupBy("h").agg(F.min(order).alias("at"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    classes = stage(classes.select(F.monotonically_increasing_id().alias("pid"), "h", "at", "n", "bands"), "classes")
    roots = similar_classes(docs, classes.select("pid", "at._row", "at.pos", "bands"), min_words)
    joined = classes.select("pid", "h", "at", "n").join(roots.withColumnRenamed("node", "pid"), "pid", "left")
    joined = stage(joined.select("h", "at", "n", F.coalesce("root", "pid").alias("root")), "joined")
    first = stage(joined.groupBy("root").agg(F.min("at").alias("keep"), F.sum("n").alias("n")).where("n > 1").select("root", "keep", "n"), "first")
    keep = stage(joined.select("h", "root").join(first, "root").select("h", "keep", "n"), "keep")
    # found a second time, without bands, which are most of a paragraph's bytes
    table = paragraph_table(docs, min_words, with_bands=False)
    lost = table.select("_row", "pos", "h").join(keep, "h").where("not (_row = keep._row and pos = keep.pos)")
    return lost.select("_row", "pos", "n")


def long_runs(lines: list[bytes], copies: set[int], min_run: int = MIN_RUN, rare: set[int] = frozenset()) -> set[int]:
    """Those of the copies (positions of lines) that lie in runs of ``min_run`` words or more, and the ``rare`` ones."""
    out, run, words = set(), [], 0
    for i, line in enumerate([*lines, b"."]):
        n = len(line.split())
        if i in copies:
            run.append(i)
            words += n
        elif n:
            out.update(run if words >= min_run else rare.intersection(run))
            run, words = [], 0
    return out


def _sliding(x: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """The least or largest (by ``pick``) of every n neighbours."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x, have = pick(x[:-step], x[step:]), have + step
    return x


def anchors(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, hash) of the anchors in texts of words."""
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for words in texts for w in words), np.uint64, int(counts.sum()))
    if len(h) < MIN_PASSAGE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = np.repeat(np.arange(len(texts)), counts)
    g = np.zeros(len(h) - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        g = g * _M1 + h[k:len(g) + k]
    g = _mix(g)
    least = _sliding(g, SPREAD, np.minimum)
    # windows of two texts choose nothing
    least[own[:len(least)] != own[MIN_PASSAGE - 1:]] = 0
    none = np.zeros(SPREAD - 1, np.uint64)
    at = np.flatnonzero(g == _sliding(np.concatenate([none, least, none]), SPREAD, np.maximum))
    # of the places of one window in a repetition of a few words the first will do
    order = np.lexsort((at, g[at]))
    again = (g[at][order][1:] == g[at][order][:-1]) & (np.diff(at[order]) <= SPREAD) & (np.diff(own[at][order]) == 0)
    at = np.delete(at, order[1:][again])
    return own[at], at - (np.cumsum(counts) - counts)[own[at]], g[at].view(np.int64)


def _cut(batch: pa.RecordBatch, min_run: int = MIN_RUN) -> tuple[list[bytes | None], list[int]]:
    """(the texts without their runs of near-duplicate paragraphs, how many paragraphs went) of rows with _lost and _rare, the positions of their copies."""
    texts, counts = [], []
    for text, own, rare in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("_lost").to_pylist(), batch.column("_rare").to_pylist()):
        lines = text.split(b"\n") if own else []
        gone = long_runs(lines, set(own or ()), min_run, set(rare or ()))
        texts.append(b"\n".join(line for i, line in enumerate(lines) if i not in gone) if gone else text)
        counts.append(len(gone))
    return texts, counts


def anchor_table(docs: DataFrame) -> DataFrame:
    """(key, doc_id, _row, pos, at) of all anchors in what the cut leaves: the line and the word of the text where they begin."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, texts, size = [], [], 0
            for row, doc, text in zip(batch.column("_row").to_pylist(), batch.column("doc_id").to_pylist(), _cut(batch)[0]):
                lines = [line.split() for line in (text or b"").translate(ASCII_LOWER).split(b"\n")]
                if len(words := [w for line in lines for w in line]) >= MIN_PASSAGE:
                    own.append((doc, row, np.cumsum(list(map(len, lines)))))
                    texts.append(words)
                    size += len(words)
                if size > _CHUNK // 4:
                    yield _batch(own, texts)
                    own, texts, size = [], [], 0
            yield _batch(own, texts)

    def _batch(own: list, texts: list) -> pa.RecordBatch:
        text, at, key = anchors(texts)
        doc, row = (pa.array([x[k] for x in own], pa.int64()).take(pa.array(text)) for k in range(2))
        pos = [np.searchsorted(x[2], at[text == k], "right") for k, x in enumerate(own)]
        return pa.RecordBatch.from_arrays([pa.array(key), doc, row, pa.array(np.concatenate([*pos, []]).astype(np.int32)), pa.array(at.astype(np.int32))], names=["key", "doc_id", "_row", "pos", "at"])

    return docs.select("_row", "doc_id", "text", "_lost", "_rare").mapInArrow(emit, "key long, doc_id long, _row long, pos int, at int")


def anchor_words(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(key, left, own, right): the words of the anchors (key, _row, at), and those before and behind them up to where the next anchor must be."""
    per_doc = firsts.groupBy("_row").agg(F.collect_list(F.struct("at", "key")).alias("want"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, want in zip(_cut(batch)[0], batch.column("want").to_pylist()):
                words = text.translate(ASCII_LOWER).split()
                for w in want:
                    a = w["at"]
                    out.append((w["key"], *map(b" ".join, (words[max(0, a - SPREAD):a], words[a:a + WINDOW], words[a + WINDOW:a + WINDOW + SPREAD]))))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["key", "left", "own", "right"])

    return docs.select("_row", "text", "_lost", "_rare").join(per_doc, "_row").mapInArrow(emit, "key long, left binary, own binary, right binary")


def without_passages(text: bytes, found: list[tuple[int, bytes, bytes, bytes]], min_passage: int = MIN_PASSAGE) -> tuple[bytes, int]:
    """(the text without its passages, how many they are), by the anchors (at, left, own, right) found elsewhere."""
    words = text.translate(ASCII_LOWER).split()
    covered = bytearray(len(words))
    for at, left, own, right in found:
        own = own.split(b" ")
        a, z = at, at + len(own)
        if words[a:z] != own:
            continue
        for w in reversed(left.split()):
            if not a or words[a - 1] != w:
                break
            a -= 1
        for w in right.split():
            if z == len(words) or words[z] != w:
                break
            z += 1
        covered[a:z] = b"\1" * (z - a)
    spans, out, n, done = [m.span() for m in _WORD.finditer(text)], [], 0, 0
    for m in re.finditer(b"\1+", bytes(covered)):
        a, z = m.span()
        if len({tuple(words[i:i + SHINGLE]) for i in range(a, z - SHINGLE + 1)}) > min_passage - SHINGLE:
            # blanks behind a passage go with it, those before it if it ends the text
            out.append(text[done:spans[a][0]] if z < len(words) else text[done:spans[a - 1][1] if a else 0])
            done, n = spans[z][0] if z < len(words) else len(text), n + 1
    return b"".join(out) + text[done:], n


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """(_row, _found): the places (at) of anchors that stand in another line before, with the words there; docs are those of ``_with_copies``."""
    since = n_staged()
    table = stage(anchor_table(docs), "anchors")
    place = F.struct("doc_id", "_row", "pos", "at")
    firsts = table.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("f")).where("n > 1")
    firsts = stage(firsts.select("key", "f._row", "f.pos", "f.at"), "firsts")
    later = table.select("key", "_row", "pos", "at").join(firsts.select("key", F.struct("_row", "pos").alias("f")), "key").where("not (_row = f._row and pos = f.pos)")
    later = stage(later.select("key", "_row", "at"), "later")
    words = anchor_words(docs, firsts.select("key", "_row", "at").join(later.select("key").distinct(), "key", "left_semi"))
    return stage_only(later.join(words, "key").groupBy("_row").agg(F.collect_list(F.struct("at", "left", "own", "right")).alias("_found")), since, "found")


def _with_copies(docs: DataFrame, min_words: int, standing: int) -> DataFrame:
    """The packed docs with a _row, and _lost and _rare, the positions of their copies and of those in fewer than ``standing`` places.

    Every later join meets the texts by row, so they are dealt out by it once; what is cut from them is cut again where they are
    read. What the search for copies has staged goes as soon as the positions are written.
    """
    packed = bucketed(pack(docs).withColumn("_row", F.monotonically_increasing_id()), "_row")
    since = n_staged()
    lost = repeated_paragraphs(packed, min_words).groupBy("_row").agg(F.collect_list("pos").alias("_lost"), F.collect_list(F.when(F.col("n") < standing, F.col("pos"))).alias("_rare"))
    return packed.join(stage_only(lost, since, "lost"), "_row", "left").select("_row", "doc_id", "text", "_rest", "_lost", "_rare")


def drop_near_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, min_run: int = MIN_RUN, standing: int = STANDING) -> DataFrame:
    """docs without their runs of near-duplicate paragraphs, with n_removed, the number of paragraphs removed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = _cut(batch, min_run)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), batch.column("_rest"), pa.array(counts, pa.int64())], names=["doc_id", "text", "_rest", "n_removed"])

    found = _with_copies(docs, min_words, standing)
    return unpack(found.mapInArrow(cut, with_fields(found, ["doc_id", "text", "_rest"], "n_removed long")), docs, "n_removed")


def drop_passages(docs: DataFrame, min_passage: int = MIN_PASSAGE) -> DataFrame:
    """``drop_near_paragraphs`` with n_passages, the number of passages in what is left that begin in another line before, and text_without_passages, the text without them too."""

    def cut_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = _cut(batch)
            texts, counts = list(kept), [0] * len(batch)
            for k, found in enumerate(batch.column("_found").to_pylist()):
                if found:
                    texts[k], counts[k] = without_passages(texts[k], [(x["at"], x["left"], x["own"], x["right"]) for x in found], min_passage)
            kept, texts = (pa.array(x, pa.binary()).cast(pa.string()) for x in (kept, texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), kept, batch.column("_rest"), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), texts],
                                             names=["doc_id", "text", "_rest", "n_removed", "n_passages", "text_without_passages"])

    copies = _with_copies(docs, MIN_WORDS, STANDING)
    got = copies.join(repeated_anchors(copies), "_row", "left").select("doc_id", "text", "_rest", "_lost", "_rare", "_found")
    return unpack(got.mapInArrow(cut_passages, with_fields(got, ["doc_id", "text", "_rest"], "n_removed long, n_passages long, text_without_passages string")), docs, "n_removed", "n_passages", "text_without_passages")


def op3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
