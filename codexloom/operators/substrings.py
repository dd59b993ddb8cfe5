"""Exact substring joins by an inverted index over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexloom.sources.store import stage

#: Characters of a gram; a shorter text is a gram of its own length.
GRAM = 8
#: Different grams up to which tasks filter by a sorted array of them (8 bytes each); beyond, grams are filtered by a join.
SHIPPED = 1 << 21

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


class Windows:
    """64-bit hashes of all windows of a text, from sums of characters times powers of an odd number."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.n = len(codes)
        powers = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(self.n, _STEP, np.uint64))))
        self.back = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(self.n, _BACK, np.uint64))))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * powers[:-1])))

    def of(self, width: int) -> np.ndarray:
        """One hash for each start of a window of that many characters."""
        if width > self.n:
            return np.zeros(0, np.int64)
        h = (self.sums[width:] - self.sums[: self.n - width + 1]) * self.back[: self.n - width + 1]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(width)
        return h.view(np.int64)


def hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, hash): the hash of each whole text, as ``Windows`` gives it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [int(w.of(w.n)[0]) if (w := Windows(x.as_py())).n else 0 for x in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.int64())], names=[key, "hash"])

    return df.select(key, F.col(text).alias("_text")).mapInArrow(work, f"{key} {df.schema[key].dataType.simpleString()}, hash long")


def all_windows(df: DataFrame, key: str, text: str, longest: int) -> DataFrame:
    """(key, hash) of every different substring of up to ``longest`` characters; lengths are streamed, so memory is that of one text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(batch.column("_text")):
                w = Windows(x.as_py())
                for width in range(1, min(w.n, longest) + 1):
                    found = np.unique(w.of(width))
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(np.full(len(found), i))), pa.array(found)], names=[key, "hash"])

    return df.select(key, F.col(text).alias("_text")).mapInArrow(work, f"{key} {df.schema[key].dataType.simpleString()}, hash long")


def grams(df: DataFrame, key: str, text: str, widths: list[int], only: np.ndarray | None = None) -> DataFrame:
    """(key, gram): the different grams of each text, of the widths given, of all or of those in the sorted array ``only``."""
    held = df.sparkSession.sparkContext.broadcast(only) if only is not None else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = held.value if held else None
        for batch in batches:
            for i, x in enumerate(batch.column("_text")):
                w = Windows(x.as_py() or "")
                found = np.unique(np.concatenate([w.of(g) for g in widths]))
                if wanted is not None and len(found):
                    at = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
                    found = found[wanted[at] == found]
                if len(found):
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(np.full(len(found), i))), pa.array(found)], names=[key, "gram"])

    return df.select(key, F.col(text).alias("_text")).mapInArrow(work, f"{key} {df.schema[key].dataType.simpleString()}, gram long")


def contained(hay: DataFrame, needles: DataFrame) -> DataFrame:
    """(hay_id, needle_id) of all pairs whose ``needle`` is a substring of ``hay``; hay (hay_id, hay), needles (needle_id, needle).

    Equal needles are searched once. A needle is looked up by the gram of it that the fewest hays hold; it
    has to be in no hay if one of its grams is in none. What is found is compared in full. Null or empty
    needles are found nowhere.
    """
    spark = hay.sparkSession
    texts = needles.where("needle <> ''").groupBy("needle").agg(F.min("needle_id").alias("_rep"))
    sizes = sorted(r[0] for r in texts.select(F.least(F.char_length("needle"), F.lit(GRAM)).alias("g")).distinct().collect())  # GRAM numbers at most
    if not sizes:
        return hay.select("hay_id").limit(0).crossJoin(needles.select("needle_id").limit(0))
    # a needle's own grams: of one width, GRAM or its whole length
    parts = [grams(texts.where((F.char_length("needle") >= GRAM) if g == GRAM else (F.char_length("needle") == g)), "_rep", "needle", [g]) for g in sizes]
    own = parts[0]
    for p in parts[1:]:
        own = own.unionByName(p)
    some = own.select("gram").distinct().limit(SHIPPED + 1).toArrow().column("gram").to_numpy()
    if len(some) <= SHIPPED:
        found = grams(hay, "hay_id", "hay", sizes, np.sort(some))
    else:
        found = grams(hay, "hay_id", "hay", sizes).join(own.select("gram").distinct(), "gram", "left_semi")
    found = stage(found)
    counts = found.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = own.join(counts, "gram", "left").groupBy("_rep").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram")).alias("_g")).where("_g.n > 0").select("_rep", F.col("_g.gram").alias("gram"))
    pairs = found.join(rarest, "gram").select("hay_id", "_rep")
    true = pairs.join(hay.select("hay_id", "hay"), "hay_id").join(texts, "_rep").where(F.contains("hay", "needle")).select("hay_id", "needle")
    return true.join(needles.select("needle", "needle_id"), "needle").select("hay_id", "needle_id")
