"""Tables and the corpus views that the registered queries are built on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codexloom.functions.columns import chunk_id
from codexloom.operators.blocks import emit_blocks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch of a UTC timestamp without zone."""
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, doc_id, pos, text: the lines of all documents that are not blank."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return d.where(F.col("text").rlike(r"\S"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit_blocks(lines(spark, sf_dir))


def _numbered(sizes: DataFrame, width: int) -> DataFrame:
    """Sections (book_id, doc_id, len) with n, the pieces of each, and before, those before it in its book: a running sum over sections, one row each and no text."""
    sizes = sizes.withColumn("n", F.ceil(F.col("len") / width))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("book_id").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("before", before)


def _pieces(w: DataFrame, width: int, *more: Column) -> DataFrame:
    """Pieces of numbered sections (book_id, section_id, doc_id, len, n, before, ...)."""
    w = w.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    start = F.col("i") * width
    return w.select("book_id", "section_id", "doc_id", start.alias("start"), F.least(start + width, F.col("len").cast("long")).alias("stop"),
                    *more, (F.col("before") + F.col("i")).cast("long").alias("chunk_ord")).withColumn("chunk_id", chunk_id(F.col("book_id"), F.col("chunk_ord")))


def fixed_chunks(blocks: DataFrame, width: int = 800) -> DataFrame:
    """Chunks of a fixed width over each section's window of text: book_id, section_id, doc_id, start, stop, text, chunk_ord, chunk_id.

    A section is what one document gives: the short ids of two sections of a book can be equal. Its text is one row, which stays where
    its document was gathered; only lengths are ordered by book.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_idx", "text"))), lambda x: x["text"]), "\n")
    w = blocks.groupBy("book_id", "section_id", "doc_id").agg(text.alias("win"))
    sizes = blocks.groupBy("book_id", "doc_id").agg((F.max("end_off") - F.min("start_off")).alias("len"))
    w = w.join(_numbered(sizes, width), ["book_id", "doc_id"])
    return _pieces(w, width, F.substring("win", (F.col("i") * width + 1).cast("int"), F.lit(width)).alias("text"))


def chunk_ranges(blocks: DataFrame, width: int = 800) -> DataFrame:
    """``fixed_chunks`` without their text, from the blocks' offsets alone."""
    return _pieces(_numbered(blocks.groupBy("book_id", "section_id", "doc_id").agg((F.max("end_off") - F.min("start_off")).alias("len")), width), width)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a ledger: session_id, book_id, seq, ts (UTC), kind, value, chunk_key (a value in 0..99)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("session_id"), (F.col("user_id") % 20).alias("book_id"), F.col("event_id").alias("seq"),
                    F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "value",
                    F.get_json_object("props", "$.k").cast("long").alias("chunk_key"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


#: Labels of fixed text that the rotation of labels ends with.
LABELS = ("Chapter iv", "PART II", "第三节", "第一百零八章", "Acknowledgments", "Colophon", "序言", "作者简介", "Table of Contents", "References", "Half Title",
          "Chapter 3: Notes on Method", "CHAPTER I. INTRODUCTION.", "8 Broadway, Hill", "Chapter Twenty-One", "Chapter Five The Start", "I am Here", "Chapter2")


def section_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, doc_id, label: labels of every form in rotation over the documents."""
    n = F.col("doc_id") % 40 + 1
    roman = F.element_at(F.array(*map(F.lit, ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"])), (n % 10 + 1).cast("int"))
    word = F.element_at(F.array(*map(F.lit, ["One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine", "Ten"])), (n % 10 + 1).cast("int"))
    zh = F.element_at(F.array(*map(F.lit, ["一", "二", "三", "四", "五", "六", "七", "八", "九", "十"])), (n % 10 + 1).cast("int"))
    forms = [F.concat(F.lit("Chapter "), n.cast("string")), F.concat(F.lit("Chapter "), roman), F.concat(F.lit("第"), zh, F.lit("章")),
             F.concat(F.lit("Chapter "), word), F.lit("Preface"), F.lit("Appendix A"), F.concat(roman, F.lit(". The Start")), F.concat(n.cast("string"), F.lit(": Again")),
             F.lit("Prologue"), F.lit("Epilogue"), F.concat(F.lit("The House of "), word), F.concat(F.lit("第"), zh, F.lit("十"), zh, F.lit("章")), F.lit("Chapter IIII"), *map(F.lit, LABELS)]
    label = F.element_at(F.array(*forms), (F.col("doc_id") % len(forms) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), "doc_id", label.alias("label"))
