"""Tables of books that are replaced together: a book's blocks, index and report change in one step or not at all.

New rows are written beside the old ones, under a version of their own. A commit then names the version
of every replaced book; it is one folder that appears by a rename, so readers see all of it or
nothing. A writer that fails before leaves files that no commit names, which ``vacuum`` removes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BookStore:
    """Versioned tables under a path; every table has a column book_id (string)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), jpath

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _commits(self) -> list[str]:
        return [n for n in self._names(f"{self.path}/commits") if n.startswith("seq=")]

    def replace(self, books: DataFrame, **tables: DataFrame) -> str:
        """Replace all rows of the books (book_id) in the given tables by theirs; a book without rows in a table is empty there. Rows of other books are refused.

        Returns the version. Of two writers at once one fails, and its books stay as the other left them.
        """
        version, known = uuid.uuid4().hex, self._commits()
        seq = int(known[-1][4:]) + 1 if known else 0
        ids = books.select(F.col("book_id").cast("string").alias("book_id")).distinct()
        for name, df in tables.items():
            place = f"{self.path}/tables/{name}/version={version}"
            df.withColumn("book_id", F.col("book_id").cast("string")).write.option("compression", "zstd").parquet(place)
            if not self.spark.read.schema(df.schema).parquet(place).select(F.col("book_id").cast("string").alias("book_id")).join(ids, "book_id", "left_anti").isEmpty():
                raise ValueError(f"{name} has rows of books that are not replaced")
        named = F.explode(F.array(*[F.lit(n) for n in tables])).alias("name")
        beside = f"{self.path}/staged/{version}"
        ids.select("book_id", named, F.lit(version).alias("version")).write.parquet(beside)
        self._publish(beside, f"{self.path}/commits/seq={seq:012d}")
        return version

    def _publish(self, beside: str, place: str) -> None:
        fs, source = self._fs(beside)
        _, target = self._fs(place)
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(source, target):
            raise RuntimeError("another writer has committed: replace again")

    def current(self) -> DataFrame:
        """(name, book_id, version): what the last commit of each book and table names."""
        known = self._commits()
        schema = "book_id string, name string, version string"
        if not known:
            return self.spark.createDataFrame([], schema).select("name", "book_id", "version")
        rows = self.spark.read.schema(f"{schema}, seq long").option("basePath", f"{self.path}/commits").parquet(*[f"{self.path}/commits/{n}" for n in known])
        return rows.groupBy("name", "book_id").agg(F.max_by("version", "seq").alias("version"))

    def read(self, name: str, schema) -> DataFrame:
        """The current rows of a table. Commits that come later do not change a frame that has been read."""
        live = self.current().where(F.col("name") == name).select("book_id", "version")
        parts = self._names(f"{self.path}/tables/{name}")
        empty = self.spark.createDataFrame([], schema)
        if not parts:
            return empty
        with_version = empty.withColumn("version", F.lit("")).schema
        rows = self.spark.read.schema(with_version).option("basePath", f"{self.path}/tables/{name}").parquet(*[f"{self.path}/tables/{name}/{p}" for p in parts])
        return rows.join(live, ["book_id", "version"], "left_semi").select(*empty.columns)

    def vacuum(self) -> int:
        """Remove the versions that no commit names any more; returns how many. Run it while nobody writes or reads older frames."""
        live, gone = {(r["name"], r["version"]) for r in self.current().select("name", "version").distinct().collect()}, 0
        for name in self._names(f"{self.path}/tables"):
            for part in self._names(f"{self.path}/tables/{name}"):
                if (name, part.removeprefix("version=")) not in live:
                    fs, p = self._fs(f"{self.path}/tables/{name}/{part}")
                    gone += bool(fs.delete(p, True))
        fs, p = self._fs(f"{self.path}/staged")
        fs.delete(p, True)
        return gone
