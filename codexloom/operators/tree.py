"""The summary tree: section nodes, clusters, coverage and links."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codexloom.functions.hooks import lead_sentences
from codexloom.operators.clustering import cluster_by_rounds, n_clusters
from codexloom.operators.retrieval import kmeans
from codexloom.sources import store

BODY = ("chapter", "prologue", "epilogue", "appendix")


def section_inputs(chunks: DataFrame, sections: DataFrame, budget: int = 24000) -> DataFrame:
    """(book_id, section_id, n_chunks, kind, printed_number, input): a body section's chunks, cut evenly when beyond the budget."""
    per = chunks.groupBy("book_id", "section_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).alias("_len"), F.array_sort(F.collect_list(F.struct("chunk_ord", "text"))).alias("_c"))
    cut = F.when(F.col("_len") <= budget, F.lit(budget)).otherwise(F.greatest(F.lit(400), F.floor(F.lit(budget) / F.col("n_chunks")))).cast("int")
    text = F.array_join(F.transform("_c", lambda x: F.substring(x["text"], F.lit(1), F.col("_cut"))), "\n\n")
    j = per.withColumn("_cut", cut).join(sections.where(F.col("kind").isin(*BODY)), ["book_id", "section_id"])
    return j.select("book_id", "section_id", "n_chunks", "kind", "printed_number", text.alias("input"))


def section_nodes(inputs: DataFrame) -> DataFrame:
    """Level-1 nodes, with the default summary."""
    return inputs.select("book_id", F.concat(F.lit("raptor_l1_"), "section_id").alias("node_id"), "section_id", F.lit(1).alias("raptor_level"),
                         F.col("n_chunks").alias("cluster_size"), F.coalesce("printed_number", F.lit(0)).alias("chapter"), lead_sentences(F.col("input")).alias("text"))


def cluster_nodes(nodes: DataFrame, seed: int = 42, large: int = 10_000) -> DataFrame:
    """(book_id, node_id, cluster): k-means over a book's unit vectors, K = min(10, max(2, n div 4)); nothing for up to two nodes.

    A book of up to ``large`` nodes is one task's; a larger one is clustered by rounds over all tasks, with the same
    starts and steps (``cluster_by_rounds``). The driver gets one name for each large book.
    """
    nodes = nodes.select("book_id", "node_id", "embedding")
    many = [(r["book_id"], r["n"]) for r in nodes.groupBy("book_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large).collect()]
    if many:
        rounds = cluster_by_rounds(nodes, sorted(many), seed)
        nodes = nodes.join(nodes.sparkSession.createDataFrame(many, "book_id string, n long"), "book_id", "left_anti")

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        if n <= 2:
            return pd.DataFrame({"book_id": [], "node_id": [], "cluster": []}).astype({"book_id": str, "node_id": str, "cluster": "int32"})
        pdf = pdf.sort_values("node_id")
        v = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        labels, _ = kmeans(v / np.where(norm > 0, norm, 1), n_clusters(n), seed)
        return pd.DataFrame({"book_id": pdf["book_id"], "node_id": pdf["node_id"], "cluster": labels.astype("int32")})

    few = nodes.groupBy("book_id").applyInPandas(own, "book_id string, node_id string, cluster int")
    return few.unionByName(rounds) if many else few


def cluster_inputs(members: DataFrame, level: int, cut: int = 600) -> DataFrame:
    """(book_id, node_id, cluster_size, chapter, input) per cluster of members (book_id, cluster, ord, text, chapter).

    The chapter is the most frequent one, the smallest on ties.
    """
    keys = ["book_id", "cluster"]
    mode = members.groupBy(*keys, "chapter").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max_by("chapter", F.struct("n", -F.col("chapter"))).alias("chapter"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.substring("text", 1, cut).alias("t")))), lambda x: x["t"]), "\n\n")
    g = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("cluster_size"), text.alias("input")).join(mode, keys)
    name = F.concat(F.lit(f"raptor_l{level}_c"), F.lpad(F.col("cluster").cast("string"), 3, "0"))
    return g.select("book_id", "cluster", name.alias("node_id"), "cluster_size", "chapter", "input")


def _of_large_books(nodes: DataFrame, enough: int) -> DataFrame:
    """The nodes of the books with more than ``enough`` of them; a book's nodes meet its count by (book, salt), not in one task."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = nodes.withColumn("_salt", F.pmod(F.xxhash64("node_id"), F.lit(n)))
    parts = salted.groupBy("book_id", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    many = parts.groupBy("book_id").agg(F.sum("_n").alias("_n")).where(F.col("_n") > enough)
    return salted.join(parts.join(many.select("book_id"), "book_id", "left_semi").select("book_id", "_salt"), ["book_id", "_salt"], "left_semi").select(*nodes.columns)


def build_tree(nodes: DataFrame, embed, last_level: int = 3, enough: int = 4, chunks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(all nodes, child links): levels above the given level-1 nodes (book_id, node_id, raptor_level, chapter, text).

    Books without such nodes, that is without sections, start from their raw ``chunks`` (of the same columns, level 0): these are clustered to level 1, if there
    are more than ``enough``. Each level clusters the books that still have more than ``enough`` nodes. At most three steps, each
    written to shared storage, so that the embedder's fit does not compute the levels below again.
    """
    level = nodes = store.stage(nodes)
    out, links = nodes, None
    if chunks is not None:
        level = store.stage(chunks.select(*nodes.columns).join(nodes.select("book_id").distinct(), "book_id", "left_anti").unionByName(nodes))
    for k in range(1 if chunks is not None else 2, last_level + 1):
        big = level.where(F.col("raptor_level") == k - 1)
        big = store.stage(_of_large_books(big, enough))
        # the vectors are made once, by all tasks, and not by every pass of the clustering
        labels = store.stage(cluster_nodes(store.stage(embed(big, "text").select("book_id", "node_id", "embedding"))))
        made = cluster_inputs(big.join(labels, ["book_id", "node_id"]).withColumn("ord", F.col("node_id")), k)
        link = labels.select("book_id", F.concat(F.lit(f"raptor_l{k}_c"), F.lpad(F.col("cluster").cast("string"), 3, "0")).alias("node_id"), F.col("node_id").alias("child_id"))
        made = store.stage(made.select("book_id", "node_id", F.lit(k).alias("raptor_level"), "chapter", lead_sentences(F.col("input")).alias("text")))
        out = out.unionByName(made)
        level = made.unionByName(nodes) if k == 1 else made
        links = link if links is None else links.unionByName(link)
    return out, links


def coverage(parents: DataFrame, child_blocks: DataFrame) -> DataFrame:
    """(book_id, node_id, block_id): a node covers what its children (book_id, node_id, child_id) cover (book_id, child_id, block_id).

    Children of one id are one child, so a child's id is one that no other of its book has.
    """
    return parents.join(child_blocks, ["book_id", "child_id"]).select("book_id", "node_id", "block_id").distinct()


def tree_links(children: DataFrame, roots: DataFrame) -> DataFrame:
    """(book_id, node_id, root_id) for every root whose block set contains the child's; null roots mark orphans.

    A containment join by counting: the blocks that both cover must be all of the child's.
    """
    size = children.groupBy("book_id", "node_id").agg(F.count(F.lit(1)).alias("_size"))
    both = children.join(roots.select("book_id", F.col("node_id").alias("root_id"), "block_id"), ["book_id", "block_id"])
    full = both.groupBy("book_id", "node_id", "root_id").agg(F.count(F.lit(1)).alias("_n")).join(size, ["book_id", "node_id"]).where("_n = _size")
    return size.select("book_id", "node_id").join(full.select("book_id", "node_id", "root_id"), ["book_id", "node_id"], "left")


def node_sections(node_blocks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(book_id, node_id, section_ids): the distinct sections under a node, in order."""
    j = node_blocks.join(blocks.select("book_id", "block_id", "section_id", "order_idx"), ["book_id", "block_id"])
    per = j.groupBy("book_id", "node_id", "section_id").agg(F.min("order_idx").alias("_o"))
    return per.groupBy("book_id", "node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "section_id"))), lambda x: x["section_id"]).alias("section_ids"))


def lookup_nodes(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """ids (book_id, raw) with the node they name: trimmed, a bare tail is a chunk id; unknown ones keep null fields."""
    raw = F.trim("raw")
    name = F.when(raw.startswith("raptor_l") | raw.startswith("chk_"), raw).otherwise(F.concat(F.lit("chk_"), raw))
    return ids.withColumn("node_id", name).join(nodes, ["book_id", "node_id"], "left")


def node_records(ids: DataFrame, nodes: DataFrame, coverage: DataFrame, blocks: DataFrame) -> DataFrame:
    """What ids (book_id, raw) name: book_id, raw, node_id, raptor_level, page, section_id, section_ids, n_blocks; blank ids are left out, unknown ones keep nulls.

    nodes (book_id, node_id, raptor_level, page, section_id), coverage (book_id, node_id, block_id) and blocks (book_id, block_id, section_id, order_idx). A raw chunk has its
    page, if that is above zero; chunks and level-1 nodes have a section of their own; a node without one has the sections of the
    blocks that it covers, in their order.
    """
    found = lookup_nodes(ids.where(F.trim("raw") != ""), nodes)
    asked = found.where("raptor_level > 0").select("book_id", "node_id").distinct()
    under = coverage.join(asked, ["book_id", "node_id"], "left_semi")
    sizes = under.groupBy("book_id", "node_id").agg(F.countDistinct("block_id").alias("n_blocks"))
    spans = node_sections(under, blocks).join(sizes, ["book_id", "node_id"])
    j = found.join(spans, ["book_id", "node_id"], "left")
    upper = F.col("section_id").isNull() & (F.col("raptor_level") > 0)
    return j.select("book_id", "raw", "node_id", "raptor_level", F.when((F.col("raptor_level") == 0) & (F.col("page") > 0), F.col("page")).alias("page"), "section_id",
                    F.when(upper, F.coalesce("section_ids", F.array().cast("array<string>"))).alias("section_ids"), F.when(F.col("raptor_level") > 0, F.coalesce("n_blocks", F.lit(0))).alias("n_blocks"))
