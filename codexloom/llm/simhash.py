"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius (for radius 2: itself and its
64 one-bit flips). Two fingerprints at distance 2 or less share a variant, and all fingerprints
that meet at a variant are within the radius of each other, so a bucket holds at most 65 of them
and one star of verified links per bucket keeps every connection. Links are made between distinct
fingerprints only; documents with equal fingerprints never meet pairwise.

Defined cases: a null or wordless text has fingerprint zero and links like any other; fewer words
than a shingle make one shingle of the whole sequence; repeated rows share their component; a null
doc_id counts as the least and is reported as null only if its component has no other id; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codexloom.llm.common import ASCII_LOWER, attach_by_key, components, partitions, stage

SHINGLE, SEED, RADIUS = 3, 42, 2


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The majority of each bit over the XXH64 hashes of all word shingles, repeats included."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return 0
    runs = [words[i:] for i in range(shingle)] if len(words) >= shingle else [words]
    joined = map(b" ".join, zip(*runs)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at:at + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each text, as a signed long."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(emit, "doc_id long, fp long")


def ball_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints at distance 2 or less; every such pair is at least connected."""
    flips = [F.lit(0).cast("long"), *(F.lit(1).cast("long") * F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64))]
    # the table of fingerprints is small, but each row becomes 65: more tasks than its files would make
    fps = fps.repartition(partitions(fps.sparkSession), "fp")
    variants = fps.select("fp", F.explode(F.array(*flips)).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), "fp")
    # at most 65 fingerprints share a variant, so each window is small and every row crosses once
    least = F.min("fp").over(Window.partitionBy("variant"))
    links = variants.select(least.alias("a"), F.col("fp").alias("b")).where("a <> b")
    return links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id reachable over links between fingerprints."""
    marked = stage(fingerprints(docs), "fingerprints")
    classes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(ball_links(classes.select("fp")))
    grouped = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # a component may hold most classes; the rows of one root are spread before they meet its id
    per_fp = stage(attach_by_key(grouped.select("fp", "root"), least, "root", "fp").select("fp", "component_id"), "labels")
    return attach_by_key(marked, per_fp, "fp", "doc_id").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
