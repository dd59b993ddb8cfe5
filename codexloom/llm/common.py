"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: bytes.translate table that lower-cases A-Z only.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share.

    The session's ``spark.checkpoint.dir`` names the place. Where it is unset a temporary folder
    is used, but only for a local master, whose executor is the driver itself.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="codexloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


#: Staged folders and bucketed tables of this process, for ``release``.
_STAGED: list[tuple[str, str]] = []


def staged(path: str, table: str = "") -> str:
    """Note a path, and the table in it, for ``release``."""
    _STAGED.append((path, table))
    return path


def n_staged() -> int:
    """How many folders and tables are staged now."""
    return len(_STAGED)


def release(spark: SparkSession, since: int = 0) -> None:
    """Drop all that the operators have staged, or what came after the first ``since``; call it once their results have been written.

    Results that are still lazy read from what is staged and must not be used afterwards.
    """
    while len(_STAGED) > since:
        path, table = _STAGED.pop()
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        fs, root = FileSystem.from_uri(path)
        if fs.get_file_info(root).type != FileType.NotFound:
            fs.delete_dir(root)


def written(path: str) -> bool:
    """Whether a Spark write to path has been committed."""
    fs, root = FileSystem.from_uri(path)
    return any(f.base_name == "_SUCCESS" for f in fs.get_file_info(FileSelector(root, allow_not_found=True)))


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """The rows as a table in the shared folder, bucketed and sorted by a column, so that joins on it do not move them again."""
    spark, n = df.sparkSession, partitions(df.sparkSession)
    own = f"codexloom_{uuid.uuid4().hex}"
    path = staged(f"{shared_dir(spark)}/{own}", own)
    (df.repartition(n, column).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, column).sortBy(column).saveAsTable(own))
    return spark.table(own)


def pack(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _rest): doc_id as long, text as string, and all other columns inside one struct, where their names clash with nothing."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("doc_id", "text")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.struct(*rest) if rest else F.lit(None).cast("int")).alias("_rest"))


def unpack(packed: DataFrame, docs: DataFrame, *outputs: str) -> DataFrame:
    """The columns of ``docs`` in their order, then ``outputs``, which replace columns of the same name."""
    taken = {x.lower() for x in outputs}
    own = [F.col(c.lower()).alias(c) if c.lower() in ("doc_id", "text") else F.col("_rest").getField(c).alias(c) for c in docs.columns if c.lower() not in taken]
    return packed.select(*own, *outputs)


def with_fields(docs: DataFrame, columns: list[str], more: str) -> StructType:
    """The schema of some of the columns, which may be null in rows that hold something else, followed by the fields of a DDL string."""
    return StructType([StructField(c, docs.schema[c].dataType) for c in columns] + (StructType.fromDDL(more).fields if more else []))


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{staged(shared_dir(df.sparkSession))}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_only(df: DataFrame, since: int, name: str = "stage") -> DataFrame:
    """``stage``, after which all that was staged before it, from the ``since``-th on, goes; nothing but ``df`` may read that."""
    kept = stage(df, name)
    last = _STAGED.pop()
    release(df.sparkSession, since)
    _STAGED.append(last)
    return kept


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_salt(df: DataFrame, member: str) -> DataFrame:
    """Add ``_salt``: the rows of one key fall into as many salts as there are shuffle partitions."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(F.col(member)), F.lit(partitions(df.sparkSession))).cast("int"))


def attach_by_key(rows: DataFrame, per_key: DataFrame, key: str, member: str) -> DataFrame:
    """Left-join one row per key onto many rows per key without sending a key's rows to one task.

    The keys are first reduced to their distinct (key, salt) pairs, at most one per shuffle
    partition. Those meet ``per_key`` on the key, and the rows meet the pairs on (key, salt).
    """
    rows = with_salt(rows, member)
    pairs = rows.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    known = pairs.join(per_key, key)
    return rows.join(known, [key, "_salt"], "left").drop("_salt")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: one row (node, root) per node, root the least node.

    Each round points every node at its least neighbour, follows those pointers twice, and
    contracts the edges to the pointers' targets, so also long chains shrink geometrically. The
    table of pointers of every round is staged; the driver sees one count per round. Loops and
    null ends are ignored; an empty graph gives no rows.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    e = stage(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    for _ in range(rounds):
        if e.isEmpty():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
        p = stage(p, "pointers")
        for _ in range(2):
            up = p.select(F.col("node").alias("root"), F.col("root").alias("up"))
            p = stage(p.join(up, "root").select("node", F.col("up").alias("root")), "pointers")
        maps.append(p)
        pa = p.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        pb = p.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        e = e.join(pa, "a").select("ra", "b").join(pb, "b").where("ra <> rb")
        e = stage(e.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0]
    for p in maps[1:]:
        nxt = p.select(F.col("node").alias("root"), F.col("root").alias("up"))
        out = out.join(nxt, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return stage(out, "components")
