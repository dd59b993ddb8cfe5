"""Tables on shared storage: replacement by book, and cascading removal."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def root(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; a temporary one only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="codexloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Folders that this process has taken, for ``release``.
_TAKEN: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared one."""
    _TAKEN.append(f"{root(spark)}/{uuid.uuid4().hex}")
    return _TAKEN[-1]


def n_taken() -> int:
    """How many folders are taken now."""
    return len(_TAKEN)


def release(spark: SparkSession, since: int = 0) -> None:
    """Drop the folders that were taken after the first ``since``; call it once results have been written, as lazy ones still read from there."""
    while len(_TAKEN) > since:
        fs, path = _fs(spark, _TAKEN.pop())
        fs.delete(path, True)


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Give a folder its final name; false, and nothing happens, where there is one of that name."""
    fs, p = _fs(spark, source)
    _, to = _fs(spark, target)
    return not fs.exists(to) and fs.rename(p, to)


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files at a path."""
    fs, p = _fs(spark, path)
    found = [s for s in (fs.listStatus(p) if fs.getFileStatus(p).isDirectory() else [fs.getFileStatus(p)])]
    about = sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found)
    return hashlib.sha256(repr(about).encode()).hexdigest()[:32]


def stage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write to shared storage and read back."""
    path = path or f"{scratch(df.sparkSession)}/stage"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_books(df: DataFrame, path: str, book_ids: list | None = None) -> None:
    """Replace the partitions of the books in ``df``; books named in ``book_ids`` without rows are emptied.

    Dynamic overwrite touches only partitions that have rows, so emptied books get their partition
    removed through the file system that the path belongs to.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").parquet(path)
    if book_ids:
        filled = {r[0] for r in df.select("book_id").where(F.col("book_id").isin(book_ids)).distinct().collect()}
        jvm = spark._jvm
        for book in set(book_ids) - filled:
            place = jvm.org.apache.hadoop.fs.Path(f"{path}/book_id={book}")
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def missing_books(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """Books that have blocks but no index rows."""
    return blocks.select("book_id").distinct().join(index.select("book_id").distinct(), "book_id", "left_anti")


def purge(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of a table whose owner is not among ``ids`` (one column named as the key)."""
    return table.join(ids, key, "left_anti")


def purge_children(children: DataFrame, parents: DataFrame, ids: DataFrame, parent_key: str, owner: str) -> DataFrame:
    """Rows of a child table whose parent row survives the purge of the parents' owners."""
    gone = parents.join(ids, owner, "left_semi").select(parent_key)
    return children.join(gone, parent_key, "left_anti")


def unlink(notes: DataFrame, ids: DataFrame, key: str, refs: list[str]) -> DataFrame:
    """Notes keep their rows; references to purged owners become null."""
    gone = ids.select(F.col(key), F.lit(True).alias("_gone")).distinct()
    j = notes.join(gone, key, "left")
    return j.select(*[F.when(F.col("_gone"), None).otherwise(F.col(c)).alias(c) if c in refs else F.col(c) for c in notes.columns])


def browse_blocks(blocks: DataFrame, book, section=None, from_off=None, to_off=None, after=None, limit: int = 200) -> DataFrame:
    """Blocks of one book in order; offsets overlap inclusively at both ends; ``after`` is a cursor on order_idx."""
    b = blocks.where(F.col("book_id") == book)
    if section is not None:
        b = b.where(F.col("section_id") == section)
    if from_off is not None:
        b = b.where(F.col("end_off") >= from_off)
    if to_off is not None:
        b = b.where(F.col("start_off") <= to_off)
    if after is not None:
        b = b.where(F.col("order_idx") > after)
    return b.orderBy("order_idx").limit(min(max(limit, 1), 1000))


def export_notes(turns: DataFrame, title: str = "Conversation", cut: int | None = None) -> DataFrame:
    """One text per session (session_id, filename, note): a title line, then the turns with bold roles.

    ``cut`` bounds each message and escapes angle brackets. Sessions without content are skipped.
    """
    body = F.col("content") if cut is None else F.regexp_replace(F.regexp_replace(F.substring("content", 1, cut), "<", "&lt;"), ">", "&gt;")
    line = F.concat(F.lit("**"), F.when(F.col("role") == "user", "You").otherwise("Assistant"), F.lit(":** "), body)
    said = turns.where(F.col("role").isin("user", "assistant") & (F.trim("content") != ""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n\n")
    head = F.concat(F.lit(f"{title} "), F.col("session_id").cast("string"))
    name = F.concat(F.lit("session_"), F.substring(F.lpad(F.col("session_id").cast("string"), 8, "0"), 1, 8), F.lit("_"),
                    F.substring(F.regexp_replace(head, "[^A-Za-z0-9 _-]", ""), 1, 20))
    return said.groupBy("session_id").agg(text.alias("_t")).select("session_id", name.alias("filename"), F.concat(F.lit("# "), head, F.lit("\n\n"), F.col("_t")).alias("note"))


# The statuses that a recommendation may take.
STATUSES = ("suggested", "seen", "added", "dismissed")


def apply_status(recs: DataFrame, transitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recs with their last valid status, ids of transitions without a recommendation)."""
    valid = transitions.where(F.col("status").isin(*STATUSES))
    last = valid.groupBy("id").agg(F.max_by("status", F.struct("ts", "seq")).alias("_last"))
    out = recs.join(last, "id", "left").withColumn("status", F.coalesce("_last", "status")).drop("_last")
    return out, valid.select("id").distinct().join(recs.select("id"), "id", "left_anti")
