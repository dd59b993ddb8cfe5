"""k-means: whole groups in one task where they are small, rounds over all tasks where they are not.

Both start from the same seeded rows, take the same steps and choose the same restart, so they give
the same clusters (up to rounding).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexloom.operators.scans import numbered
from codexloom.sources.store import stage

#: Large books whose centres are broadcast together: at most 10 restarts of 10 centres each.
TOGETHER = 128


def n_clusters(n: int) -> int:
    return min(10, max(2, n // 4))


class _Run:
    """The restarts of one book: centres now, those that the last labels came from, and costs."""

    def __init__(self, starts: list[np.ndarray]):
        self.centres, self.used, self.cost = starts, list(starts), [np.inf] * len(starts)
        self.active = [True] * len(starts)

    def step(self, r: int, n: np.ndarray, sums: np.ndarray, squares: float) -> None:
        c = self.centres[r]
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        self.used[r] = c
        done = np.allclose(new, c)
        final = c if done else new
        self.cost[r] = squares - 2 * (sums * final).sum() + (n * (final ** 2).sum(1)).sum()
        self.active[r], self.centres[r] = not done, final

    def best(self) -> np.ndarray:
        at = 0
        for r in range(1, len(self.cost)):
            if self.cost[r] < self.cost[at] - 1e-12:
                at = r
        return self.used[at]


def _matrix(column: pa.Array) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def _labels(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(v @ centres.T - 0.5 * (centres ** 2).sum(1), 1)


def _sums(nodes: DataFrame, runs: dict[str, _Run]) -> list:
    """(book_id, restart, cluster, n, squares, sums) of one assignment to the centres of all active restarts."""
    held = nodes.sparkSession.sparkContext.broadcast({b: {r: c for r, c in enumerate(x.centres) if x.active[r]} for b, x in runs.items() if any(x.active)})
    schema = "book_id string, restart int, cluster int, n long, squares double, sums array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            books, v = np.array(batch.column("book_id").to_pylist()), None
            for book in set(books.tolist()) & held.value.keys():
                v = _matrix(batch.column("embedding")) if v is None else v
                own = v[books == book]
                for r, centres in held.value[book].items():
                    label = _labels(own, centres)
                    hot = np.zeros((len(centres), len(own)))
                    hot[label, np.arange(len(own))] = 1
                    add = hot.sum(1), hot @ own, hot @ (own ** 2).sum(1)
                    total[book, r] = tuple(map(np.add, total[book, r], add)) if (book, r) in total else add
        rows = [(b, r, j, int(n[j]), float(q[j]), s[j]) for (b, r), (n, s, q) in total.items() for j in range(len(n))]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())))],
                                         names=["book_id", "restart", "cluster", "n", "squares", "sums"])

    def merged(t: pa.Table) -> pa.Table:
        # one row per task that met the cluster
        s = np.array(t.column("sums").to_pylist()).sum(0)
        return pa.table({"book_id": t.column("book_id")[:1], "restart": t.column("restart")[:1], "cluster": t.column("cluster")[:1], "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()),
                         "squares": pa.array([sum(t.column("squares").to_pylist())], pa.float64()), "sums": pa.array([s], pa.list_(pa.float64()))})

    return nodes.select("book_id", "embedding").mapInArrow(partial, schema).groupBy("book_id", "restart", "cluster").applyInArrow(merged, schema).collect()


def cluster_by_rounds(nodes: DataFrame, books: list[tuple[str, int]], seed: int = 42, restarts: int = 10, steps: int = 50) -> DataFrame:
    """(book_id, node_id, cluster) for the given books (name, number of nodes), by Spark rounds.

    Every round broadcasts the centres of all restarts, tasks give partial sums, and the driver gets one row per book, restart and
    cluster. Books come in blocks of ``TOGETHER``, so both stay bounded; no task holds more than a batch of vectors.
    """
    out = None
    for at in range(0, len(books), TOGETHER):
        block = dict(books[at:at + TOGETHER])
        own = stage(numbered(nodes.where(F.col("book_id").isin(list(block))).select("book_id", "node_id", "embedding"), ["book_id"], ["node_id"]))
        starts, wanted = {}, []
        for book, n in block.items():
            rng = np.random.default_rng(seed)
            starts[book] = [rng.choice(n, n_clusters(n), replace=False).tolist() for _ in range(restarts)]
            wanted += [(book, i) for i in {i for s in starts[book] for i in s}]
        chosen = own.sparkSession.createDataFrame(wanted, "book_id string, no long")
        rows = {(r["book_id"], r["no"]): np.array(r["embedding"], np.float64) for r in own.join(F.broadcast(chosen), ["book_id", "no"]).collect()}  # 100 a book at most
        unit = {k: v / (np.linalg.norm(v) or 1) for k, v in rows.items()}
        runs = {book: _Run([np.stack([unit[book, i] for i in s]) for s in starts[book]]) for book in block}
        for _ in range(steps):
            if not any(any(x.active) for x in runs.values()):
                break
            found: dict = {}
            for r in _sums(own, runs):
                found.setdefault((r["book_id"], r["restart"]), []).append(r)
            for (book, r), parts in found.items():
                parts.sort(key=lambda x: x["cluster"])
                runs[book].step(r, np.array([x["n"] for x in parts], float), np.array([x["sums"] for x in parts]), sum(x["squares"] for x in parts))
        held = own.sparkSession.sparkContext.broadcast({book: x.best() for book, x in runs.items()})

        def assign(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                books, label = np.array(batch.column("book_id").to_pylist()), np.zeros(len(batch), np.int32)
                v = _matrix(batch.column("embedding")) if len(batch) else None
                for book in set(books.tolist()):
                    label[books == book] = _labels(v[books == book], held.value[book])
                yield pa.RecordBatch.from_arrays([batch.column("book_id"), batch.column("node_id"), pa.array(label)], names=["book_id", "node_id", "cluster"])

        one = own.select("book_id", "node_id", "embedding").mapInArrow(assign, "book_id string, node_id string, cluster int")
        out = one if out is None else out.unionByName(one)
    return out
