"""Quality scoring with a factorisation machine.

Features of a text: hashed words (each bucket's share of the words), structure statistics and
metadata derived from the text (its length). The machine adds all pairwise interactions of the
features through low-rank factors; the sum-of-squares identity turns those into sums over single
features, so scoring is linear in the text. Features come from NumPy over Arrow batches, without a
Python object per word. The model is fitted on at most ``SAMPLE`` labelled documents, chosen by a
hash of doc_id; everything is scored.

Defined cases: null and empty texts have zero words and are scored by the intercept and the
structure statistics; rows labelled null are not learnt from; repeated document rows are scored
each; a document labelled twice counts once, by its smaller label, and of rows that repeat a labelled
doc_id one text is learnt from, chosen by its hash; with no labelled rows, or rows of one class
only, the score is the share of the labels seen so far (0.5 if none); other columns pass through
``score_documents``, except that its score replaces a column of that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexloom.llm.common import pack, unpack, with_fields

#: The most labelled documents that the model is fitted on.
SAMPLE = 4000
THRESHOLD = 0.3
BUCKETS, RANK = 4096, 8
_MULT = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_SPACE, _UP, _LOW, _DIGIT, _SYMBOL, _MARK, _LINE, _HIGH = range(8)
_CLASSES = np.array([
    _LINE if b == 10 else _SPACE if b in b" \t\v\f\r" else _UP if 65 <= b <= 90 else _LOW if 97 <= b <= 122 else _DIGIT if 48 <= b <= 57
    else _MARK if b in b".,;:'\"-()?" else _HIGH if b > 127 else _SYMBOL for b in range(256)], np.uint8)
_LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
N_DENSE = 14


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        inverse = np.uint64(pow(_MULT, -1, 1 << 64))
        out = []
        for base in (np.uint64(_MULT), inverse):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS.clear()
        _POWERS[size] = tuple(out)
    return _POWERS[size]


def word_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, bucket, count) of the texts' hashed words, and a row of structure statistics per text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = ends - np.array([len(t) + 1 for t in texts])
    kinds = _CLASSES[data]
    blank = (kinds == _SPACE) | (kinds == _LINE)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
    first, last = edges[::2], edges[1::2]
    up, down = _powers(len(data))
    sums = np.concatenate(([np.uint64(0)], np.cumsum((_LOWERED[data] + np.uint64(1)) * up[:len(data)], dtype=np.uint64)))
    hashes = (sums[last] - sums[first]) * down[first]
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    bucket = (hashes >> np.uint64(52)).astype(np.int64)
    doc = np.searchsorted(ends, first, "right")
    keys, counts = np.unique(doc * BUCKETS + bucket, return_counts=True)
    per = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[np.concatenate(([0], ends))])
    n_words = np.bincount(doc, minlength=len(texts)).astype(float)
    size, words = np.maximum(ends - starts - 1, 1).astype(float), np.maximum(n_words, 1)
    solid = np.maximum(size - per(kinds == _SPACE), 1)
    same = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1]))) if len(doc) else np.zeros(0, bool)
    capital, symbol_end = kinds[first] == _UP, kinds[np.maximum(last - 1, 0)] == _SYMBOL
    second_up = (last - first > 1) & (kinds[np.minimum(first + 1, len(kinds) - 1)] == _UP)
    alone = (last - first == 1) & ((kinds[first] == _SYMBOL) | (kinds[first] == _MARK))
    share = lambda mask: np.bincount(doc, weights=mask, minlength=len(texts)) / words
    own = keys // BUCKETS
    dense = np.stack([
        np.log1p(n_words), np.log1p(size), np.bincount(doc, weights=last - first, minlength=len(texts)) / words,
        per(kinds == _UP) / solid, per(kinds == _DIGIT) / solid, per(kinds == _SYMBOL) / solid, per(kinds == _MARK) / solid,
        (per(kinds == _LINE) - 1) / words, share(same), share(capital), share(symbol_end), share(second_up), share(alone),
        np.bincount(own, weights=counts.astype(float) ** 2, minlength=len(texts)) / words ** 2], 1)
    return own, keys % BUCKETS, counts, dense


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about a megabyte; a longer text stands alone."""
    own, size = [], 0
    for t in texts:
        if own and size + len(t) > _CHUNK:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t) + 1
    if own:
        yield own


class Machine:
    """A factorisation machine over standardised statistics and the shares of hashed words."""

    def __init__(self, mean, scale, w0, w, v):
        self.mean, self.scale, self.w0, self.w, self.v = mean, scale, w0, w, v

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = []
        wb, vb, wd, vd = self.w[N_DENSE:], self.v[N_DENSE:], self.w[:N_DENSE], self.v[:N_DENSE]
        for own in _chunks(texts):
            doc, bucket, counts, dense = word_features(own)
            n = len(own)
            total = np.maximum(np.bincount(doc, weights=counts, minlength=n), 1)
            x, z = counts / np.sqrt(total[doc]), standardise(dense, self.mean, self.scale)
            one, square = z @ vd, (z ** 2) @ (vd ** 2)
            linear = z @ wd + np.bincount(doc, weights=x * wb[bucket], minlength=n)
            for f in range(self.v.shape[1]):
                part = x * vb[bucket, f]
                one[:, f] += np.bincount(doc, weights=part, minlength=n)
                square[:, f] += np.bincount(doc, weights=part ** 2, minlength=n)
            out.append(self.w0 + linear + 0.5 * (one ** 2 - square).sum(1))
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out) if out else np.zeros(0), -30, 30)))


def standardise(dense: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((dense - mean) / scale, -4, 4)


def fit(words: np.ndarray, dense: np.ndarray, labels: np.ndarray, epochs: int = 60, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Fit on word counts and statistics by Adam on mini-batches of the log loss; deterministic for a given order."""
    rng = np.random.default_rng(seed)
    n_features = N_DENSE + BUCKETS
    if len(set(labels.tolist())) < 2:
        share = float(np.mean(labels)) if len(labels) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Machine(np.zeros(N_DENSE), np.ones(N_DENSE), np.log(share / (1 - share)), np.zeros(n_features), np.zeros((n_features, RANK)))
    words /= np.sqrt(np.maximum(words.sum(1, keepdims=True), 1))
    mean, scale = dense.mean(0), np.maximum(dense.std(0), 1e-6)
    dense = standardise(dense, mean, scale).astype(np.float32)
    y = labels.astype(np.float32)
    w0, w, v = np.float32(0), np.zeros(n_features, np.float32), rng.normal(0, 0.01, (n_features, RANK)).astype(np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, v)]
    step = 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 256)):
            x = np.concatenate((dense[at], words[at]), 1)
            sums = x @ v
            p = 1 / (1 + np.exp(-np.clip(w0 + x @ w + 0.5 * (sums ** 2 - (x ** 2) @ (v ** 2)).sum(1), -30, 30)))
            g = (p - y[at]) / len(at)
            grads = (x.T @ g + decay * w, x.T @ (sums * g[:, None]) - v * ((x ** 2).T @ g)[:, None] + decay * v)
            w0 -= rate * g.sum()
            step += 1
            for param, grad, s in zip((w, v), grads, state):
                s[0] += 0.1 * (grad - s[0])
                s[1] += 0.001 * (grad ** 2 - s[1])
                param -= rate * (s[0] / (1 - 0.9 ** step)) / (np.sqrt(s[1] / (1 - 0.999 ** step)) + 1e-8)
    return Machine(mean, scale, float(w0), w.astype(float), v.astype(float))


def held_out() -> Column:
    """True for the fifth of the documents that labels are never learnt from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on up to ``sample`` labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id is not null and quality is not null")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # the bound on the sample also bounds what is broadcast and, as counts per bucket, collected
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, texts = 0, [x.as_py() for x in batch.column("text").cast(pa.binary())]
            for own in _chunks(texts):
                doc, bucket, counts, dense = word_features(own)
                cuts = np.searchsorted(doc, np.arange(1, len(own)))
                part = batch.slice(base, len(own))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("quality"), pa.array(np.split(bucket.astype(np.int32), cuts), pa.list_(pa.int32())),
                    pa.array(np.split(counts.astype(np.int32), cuts), pa.list_(pa.int32())), pa.array(list(dense), pa.list_(pa.float64()))],
                    names=["doc_id", "quality", "buckets", "counts", "dense"])
                base += len(own)

    # one text per document, however often its row repeats
    text = text.join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = text.mapInArrow(count, "doc_id long, quality int, buckets array<int>, counts array<int>, dense array<double>")
    rows = sorted(rows.collect(), key=lambda r: r["doc_id"])
    words = np.zeros((len(rows), BUCKETS), np.float32)
    for k, r in enumerate(rows):
        words[k, r["buckets"]] = r["counts"]
    dense = np.array([r["dense"] for r in rows], float).reshape(len(rows), N_DENSE)
    return fit(words, dense, np.array([r["quality"] for r in rows], int))


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs with score: the probability that a text is labelled 1."""
    held, packed = docs.sparkSession.sparkContext.broadcast(machine), pack(docs)
    names = [*packed.columns, "score"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = held.value.score([x.as_py() or b"" for x in batch.column("text").cast(pa.binary())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=names)

    return unpack(packed.mapInArrow(emit, with_fields(packed, packed.columns, "score double")), docs, "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
