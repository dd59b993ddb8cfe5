"""Chunks of sections, their spans over blocks, and the map from blocks to chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codexloom.functions.columns import chunk_id
from codexloom.sources import store

#: Blocks of one book that a window holds at most.
RANGE = 1 << 16
SEPARATORS = ("\n\n", "\n", "。", ".", " ")


def split_points(text: str, size: int, overlap: int, level: int = 0) -> list[tuple[int, int]]:
    """Half-open pieces of at most ``size`` characters, broken at the coarsest separator that helps.

    Neighbouring parts are packed together; a piece begins at most ``overlap`` characters back, at
    a part's start. A part without any finer separator stays whole, even when too long.
    """
    sep = next((s for s in SEPARATORS[level:] if s in text), None)
    if len(text) <= size or sep is None:
        return [(0, len(text))]
    cuts = [0]
    while (at := text.find(sep, cuts[-1] + 1)) > 0:
        cuts.append(at)
    parts = list(zip(cuts, [*cuts[1:], len(text)]))
    out: list[tuple[int, int]] = []
    held: list[tuple[int, int]] = []
    for a, b in parts:
        if b - a > size:
            if held:
                out.append((held[0][0], held[-1][1]))
            out += [(a + x, a + y) for x, y in split_points(text[a:b], size, overlap, SEPARATORS.index(sep) + 1)]
            held = []
            continue
        if held and b - held[0][0] > size:
            out.append((held[0][0], held[-1][1]))
            while held and (held[-1][1] - held[0][0] > overlap or b - held[0][0] > size):
                held.pop(0)
        held.append((a, b))
    if held:
        out.append((held[0][0], held[-1][1]))
    return out


def chunk_blocks(blocks: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    """Chunks (book_id, section_id, window, chunk_ord, chunk_id, start, stop, text) of consecutive blocks of one section.

    A section that another interrupts gives two windows. Each window is one row and is split in an
    Arrow batch; blank windows and blank pieces are skipped and take no number.
    """
    # the block before is found within a range of orders, or as the last of the range before
    b = blocks.withColumn("_r", F.floor(F.col("order_idx") / RANGE))
    ends = b.groupBy("book_id", "_r").agg(F.max_by(F.struct("section_id"), "order_idx").alias("_last"))
    ends = ends.select("book_id", "_r", F.lag("_last").over(Window.partitionBy("book_id").orderBy("_r")).alias("_last"))
    b = b.join(ends, ["book_id", "_r"])
    before = F.coalesce(F.lag(F.struct("section_id")).over(Window.partitionBy("book_id", "_r").orderBy("order_idx")), "_last")
    b = b.withColumn("_new", F.when(before.isNull() | ~before["section_id"].eqNullSafe(F.col("section_id")), F.col("order_idx")))
    w = Window.partitionBy("book_id", "section_id").orderBy("order_idx").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("_win", F.last("_new", ignorenulls=True).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_idx", "text"))), lambda x: x["text"]), "\n")
    wins = b.groupBy("book_id", "section_id", "_win").agg(text.alias("win")).where(F.col("win").rlike(r"\S"))

    @F.pandas_udf("array<struct<start: int, stop: int>>")
    def pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = []
            for t in batch:
                own = []
                for a, z in split_points(t, size, overlap):
                    piece = t[a:z]
                    if piece.strip():
                        a += len(piece) - len(piece.lstrip())
                        own.append({"start": a, "stop": a + len(piece.strip())})
                out.append(own)
            yield pd.Series(out)

    # numbers are summed over narrow rows, so that no window holds a book's text
    p = store.stage(wins.withColumn("_p", pieces("win")))
    before = F.sum("_n").over(Window.partitionBy("book_id").orderBy("_win").rowsBetween(Window.unboundedPreceding, -1))
    numbers = p.select("book_id", "_win", F.size("_p").alias("_n")).select("book_id", "_win", F.coalesce(before, F.lit(0)).alias("_before"))
    p = p.join(numbers, ["book_id", "_win"])
    p = p.select("book_id", "section_id", F.col("_win").alias("window"), "win", "_before", F.posexplode("_p").alias("_i", "_x"))
    p = p.withColumn("chunk_ord", (F.col("_before") + F.col("_i")).cast("long"))
    return p.select("book_id", "section_id", "window", "chunk_ord", chunk_id(F.col("book_id"), F.col("chunk_ord")).alias("chunk_id"),
                    F.col("_x.start").alias("start"), F.col("_x.stop").alias("stop"),
                    F.substring("win", F.col("_x.start") + 1, F.col("_x.stop") - F.col("_x.start")).alias("text"))


def _last_at(starts: Column, position: Column) -> Column:
    """The index of the last of the sorted starts that is not beyond a position, the first if all are: a binary search."""
    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["l"] + s["r"], 1)
        below = F.get(starts, mid) <= position
        return F.when(s["l"] >= s["r"], s).when(below, F.struct((mid + 1).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), mid.alias("r")))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(starts) + F.lit(1))).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("l"), F.size(starts).alias("r")), halve, lambda s: F.greatest(s["l"] - 1, F.lit(0)))


def chunk_spans(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """chunks with block_ids, primary_block_id, lo, hi and first_char: a sorted lookup inside each section.

    Positions count in the section's window; a position on the line break between blocks belongs to
    the earlier one. A section's chunks and its blocks are one row each, which meet once. Short ids of
    sections can be equal; where both frames have a doc_id, it tells them apart.
    """
    keys = ["book_id", "section_id", *["doc_id"] * ("doc_id" in chunks.columns and "doc_id" in blocks.columns)]
    b = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("order_idx", "start_off", "block_id"))).alias("_b"))
    c = chunks.groupBy(*keys).agg(F.collect_list(F.struct(*[n for n in chunks.columns if n not in keys])).alias("_c"))
    j = c.join(b, keys).withColumn("_at", F.transform("_b", lambda x: x["start_off"] - F.get("_b", F.lit(0))["start_off"]))
    at = lambda p: _last_at(F.col("_at"), p)
    found = F.transform("_c", lambda x: F.struct(
        x.alias("c"), at(x["start"]).alias("lo"), at(F.greatest(x["start"], x["stop"] - 1)).alias("hi"), at(F.floor((x["start"] + x["stop"]) / 2)).alias("mid")))
    # what a chunk needs of the blocks is taken before the chunks part, so that no chunk carries all blocks
    block = lambda name, i: F.get("_b", i)[name]
    whole = F.transform("_f", lambda x: F.struct(
        x["c"].alias("c"), F.transform(F.slice("_b", x["lo"] + 1, x["hi"] - x["lo"] + 1), lambda y: y["block_id"]).alias("block_ids"),
        block("order_idx", x["lo"]).alias("lo"), block("order_idx", x["hi"]).alias("hi"), block("block_id", x["mid"]).alias("primary_block_id"),
        F.greatest(x["c"]["start"] - F.get("_at", x["lo"]), F.lit(0)).cast("long").alias("first_char")))
    j = j.withColumn("_f", found).select(*keys, F.explode(whole).alias("_x"))
    own = [n if n in keys else F.col(f"_x.c.{n}").alias(n) for n in chunks.columns]
    return j.select(*own, "_x.block_ids", "_x.lo", "_x.hi", "_x.primary_block_id", "_x.first_char")


def block_to_chunk(spans: DataFrame) -> DataFrame:
    """Each block's first chunk: book_id, block_id, chunk_id, chunk_ord."""
    return (spans.select("book_id", "chunk_id", "chunk_ord", F.explode("block_ids").alias("block_id"))
            .groupBy("book_id", "block_id").agg(F.min_by("chunk_id", "chunk_ord").alias("chunk_id"), F.min("chunk_ord").alias("chunk_ord")))


def block_words(blocks: DataFrame) -> DataFrame:
    """(book_id, block_id, token): the different words of each block id, lower-cased and split at blanks.

    Texts meet by their id, which two blocks of a book can share, and are split then: no word is moved.
    """
    per = blocks.groupBy("book_id", "block_id").agg(F.array_join(F.collect_list("text"), " ").alias("_texts"))
    per = per.withColumn("_words", F.array_distinct(F.split(F.lower("_texts"), " ")))
    return per.select("book_id", "block_id", F.explode("_words").alias("token")).where("token <> ''")
