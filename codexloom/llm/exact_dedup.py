"""Exact document deduplication over a persistent digest index.

The index is a table bucketed and sorted by digest. A batch of new documents is reduced to one
survivor per digest, checked against the index by a sort-merge anti-join that reads the index
bucket by bucket without shuffling it, and what remains is appended. Everything is DataFrame
operations; texts never leave the scan, only digests are shuffled.

Defined cases: a null text counts as empty; texts are equal when equal after lower-casing A-Z; of
equal texts in one batch the greatest doc_id stays (a null id is the least); a text that the index
already holds keeps the indexed id; repeated rows count as members of their group; an empty batch
appends nothing; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codexloom.llm.common import ascii_lower, partitions, shared_dir, stage, staged, with_salt


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with A-Z lower-cased, as 32 bytes."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


#: The file that describes an index; readers of the data pass over names with an underscore.
ABOUT = "_digest_index.json"


class DigestIndex:
    """A persistent table (digest, keep_id), bucketed and sorted by digest.

    A named table lives in the warehouse, or under ``path``, and stays. Without a name it is one of
    this session in the shared folder, which ``common.release`` drops.

    An index under a path describes itself: a file beside its data holds the number of buckets, so a session whose catalogue does not know the
    table registers it over the files again. A path with files but no description is
    not an index and is refused, since a new table would erase it.
    """

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None, path: str | None = None):
        self.spark = spark
        self.table, self.path = table or f"codexloom_digests_{uuid.uuid4().hex}", path
        if table is None and path is None:
            self.path = f"{shared_dir(spark)}/{self.table}"
            staged(self.path, self.table)
        self.buckets = buckets or partitions(spark)

    def _described(self) -> int | None:
        """Buckets of the index under the path, or None where there is nothing yet."""
        fs, root = FileSystem.from_uri(self.path)
        about = fs.get_file_info(f"{root}/{ABOUT}")
        if about.type == FileType.NotFound:
            if any(f.size for f in fs.get_file_info(FileSelector(root, allow_not_found=True))):
                raise ValueError(f"{self.path} holds files that are no digest index")
            return None
        with fs.open_input_stream(about.path) as f:
            return json.loads(f.read())["buckets"]

    def _describe(self) -> None:
        fs, root = FileSystem.from_uri(self.path)
        fs.create_dir(root)
        with fs.open_output_stream(f"{root}/{ABOUT}") as f:
            f.write(json.dumps({"digest": "sha256", "buckets": self.buckets}).encode())

    def exists(self) -> bool:
        """Whether there is an index; one under a path is registered in this session."""
        if self.spark.catalog.tableExists(self.table):
            return True
        if self.path is None or (buckets := self._described()) is None:
            return False
        self.buckets = buckets
        self.spark.sql(f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'")
        return True

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, digests: DataFrame) -> DataFrame:
        """Append the batch's new digests and return them as (digest, keep_id)."""
        new = digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        if self.exists():
            new = new.hint("merge").join(self.read().select("digest"), "digest", "left_anti")
        elif self.path is not None:
            # written first and with the files in one folder, which a new table keeps
            self.spark.sql(f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
            self._describe()
        new = stage(new.select("digest", "keep_id"), "appended")
        # one file per bucket: the rows arrive at the writer dealt out by the bucket column
        out = new.repartition(self.buckets, "digest").write.mode("append").format("parquet")
        out = out.option("path", self.path) if self.path else out
        out.bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)
        return new

    def resolve(self, digests: DataFrame) -> DataFrame:
        """Per row of ``digests``: the id that stays for its text, and how many rows share the text.

        A digest's rows are counted per salt first, so that a text held by a third of all rows
        never meets in one task.
        """
        rows = with_salt(digests, "doc_id")
        w = Window.partitionBy("digest")
        known = (rows.groupBy("digest", "_salt").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("own"))
                 .hint("merge").join(self.read(), "digest")
                 .select("digest", "_salt", "own", "keep_id", F.sum("n").over(w).alias("group_size")))
        # a text held by one row that is itself the indexed one needs no second shuffle
        known = known.where("group_size > 1 or not (keep_id <=> own)").drop("own")
        return (rows.join(known, ["digest", "_salt"], "left")
                .select("doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"),
                        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "digest"))


def exact_dedup(docs: DataFrame, batches: int = 2, buckets: int | None = None) -> DataFrame:
    """Deduplicate a whole table through a new index: (doc_id, keep_id, group_size, kept, text_sha256).

    The table is appended in batches of descending doc_id, so that the indexed id of a text is
    always its greatest one.
    """
    digests = stage(text_digests(docs), "digests")
    index = DigestIndex(docs.sparkSession, buckets=buckets)
    cuts = digests.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [0.5]).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []), reverse=True) if batches > 1 else []
    doc, hi = F.col("doc_id"), None
    for lo in [*cuts, None]:
        part = digests
        if hi is not None:
            part = part.where((doc < hi) | doc.isNull())
        if lo is not None:
            part = part.where(doc >= lo)
        index.append(part)
        hi = lo
    out = index.resolve(digests)
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
