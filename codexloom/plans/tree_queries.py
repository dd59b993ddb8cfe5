"""Queries over the summary tree and the text hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexloom.functions import hooks
from codexloom.functions import labels as L
from codexloom.operators import tree as T
from codexloom.plans import corpus_queries as Q
from codexloom.plans import sqlviews as V
from codexloom.plans.base import query
from codexloom.sources import corpus as S
from codexloom.sources import store

col, lit = F.col, F.lit


def _inputs(spark, sf, budget=24000):
    b = S.blocks(spark, sf)
    c = S.fixed_chunks(b)
    secs = S.section_labels(spark, sf).select(col("doc_id"), L.section_kind(col("label")).alias("kind"), L.printed_number(col("label")).alias("printed_number"))
    # every section of blocks has a chunk; here no text is moved
    ids = b.select("book_id", "section_id", "doc_id").distinct()
    return T.section_inputs(c, secs.join(ids, "doc_id").select("book_id", "section_id", "kind", "printed_number"), budget)


_INPUTS = f"""{Q._NUMBERS}, {V.CHUNKS}, per AS (SELECT book_id, section_id, doc_id, count(*) AS n_chunks, sum(length(text)) AS len FROM chunks_x GROUP BY ALL),
inp AS (SELECT p.book_id, p.section_id, p.n_chunks, k.kind, k.printed_number, string_agg(substr(c.text, 1, CASE WHEN len <= 24000 THEN 24000 ELSE greatest(400, 24000 // n_chunks) END::INTEGER), chr(10) || chr(10) ORDER BY c.chunk_ord) AS input
  FROM per p JOIN chunks_x c ON c.book_id = p.book_id AND c.section_id = p.section_id JOIN kinds k ON k.doc_id = p.doc_id WHERE k.kind IN ('chapter', 'prologue', 'epilogue', 'appendix') GROUP BY ALL)"""
_LEAD = r"array_to_string(list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> '')[1:{}], ' ')"


@query(f"WITH {_INPUTS} SELECT book_id, section_id, n_chunks, kind, printed_number, input FROM inp")
def section_inputs(spark, sf):
    return _inputs(spark, sf)


@query(f"WITH {_INPUTS} SELECT book_id, 'raptor_l1_' || section_id AS node_id, section_id, 1 AS raptor_level, n_chunks AS cluster_size, coalesce(printed_number, 0) AS chapter, {_LEAD.format('input', 200)} AS text FROM inp")
def section_nodes(spark, sf):
    return T.section_nodes(_inputs(spark, sf))


def _vector_nodes(spark, sf):
    e = S.table(spark, sf, "embeddings")
    # a book of some hundred nodes, whatever the number of vectors
    return e.select(F.concat(lit("b"), F.floor(col("vec_id") / 200).cast("string")).alias("book_id"), F.format_string("n%06d", "vec_id").alias("node_id"), "embedding")


@query()
def cluster_nodes(spark, sf):
    return T.cluster_nodes(_vector_nodes(spark, sf))


@query("""WITH m AS (SELECT source AS book_id, label AS cluster, vec_id, substr(text, 1, 600) AS t, vec_id % 7 AS chapter FROM embeddings JOIN documents ON vec_id = doc_id),
c AS (SELECT book_id, cluster, chapter, count(*) AS n FROM m GROUP BY ALL), md AS (SELECT book_id, cluster, arg_max(chapter, n * 100 - chapter) AS chapter FROM c GROUP BY ALL),
g AS (SELECT book_id, cluster, count(*) AS cluster_size, string_agg(t, chr(10) || chr(10) ORDER BY vec_id) AS input FROM m GROUP BY ALL)
SELECT g.book_id, g.cluster, 'raptor_l2_c' || lpad(g.cluster::VARCHAR, 3, '0') AS node_id, cluster_size, chapter, input FROM g JOIN md ON g.book_id = md.book_id AND g.cluster = md.cluster""")
def cluster_inputs(spark, sf):
    e = S.table(spark, sf, "embeddings").select("vec_id", col("label").alias("cluster"))
    d = S.table(spark, sf, "documents").select(col("doc_id").alias("vec_id"), col("source").alias("book_id"), "text")
    m = e.join(d, "vec_id").select("book_id", "cluster", col("vec_id").alias("ord"), "text", (col("vec_id") % 7).alias("chapter"))
    return T.cluster_inputs(m, 2)


@query()
def build_tree(spark, sf):
    nodes = T.section_nodes(_inputs(spark, sf)).select("book_id", "node_id", "raptor_level", "chapter", "text")
    out, _ = T.build_tree(nodes, lambda df, text: hooks.embed(df, text, 64))
    return out


@query(f"WITH {V.SPANS} SELECT DISTINCT book_id, 'n' || chunk_ord // 4 AS node_id, unnest(block_ids) AS block_id FROM spans")
def node_coverage(spark, sf):
    # the short ids of two chunks of a book can be equal, their numbers cannot; parents need no spans
    own = Q.spans_of(spark, sf).select("book_id", col("chunk_ord").alias("child_id"), F.explode("block_ids").alias("block_id"))
    parents = S.chunk_ranges(S.blocks(spark, sf)).select("book_id", F.concat(lit("n"), F.floor(col("chunk_ord") / 4).cast("string")).alias("node_id"), col("chunk_ord").alias("child_id"))
    return T.coverage(parents, own)


_ROOTS = f"{V.BLOCKS}, roots AS (SELECT book_id, 'root' || doc_id % 4 AS node_id, block_id, section_id, order_idx FROM blocks_x WHERE doc_id % 4 < 3 AND NOT (doc_id % 8 = 1 AND order_idx % 2 = 0))"


def _roots(spark, sf):
    b = S.blocks(spark, sf)
    return b, b.where("doc_id % 4 < 3 and not (doc_id % 8 = 1 and order_idx % 2 = 0)").select("book_id", F.concat(lit("root"), (col("doc_id") % 4).cast("string")).alias("node_id"), "block_id")


@query(f"""WITH {_ROOTS}, ch AS (SELECT book_id, section_id AS node_id, block_id, count(*) OVER (PARTITION BY book_id, section_id) AS size FROM blocks_x),
f AS (SELECT ch.book_id, ch.node_id, r.node_id AS root_id FROM ch JOIN roots r ON ch.book_id = r.book_id AND ch.block_id = r.block_id GROUP BY ch.book_id, ch.node_id, r.node_id, size HAVING count(*) = size)
SELECT c.book_id, c.node_id, root_id FROM (SELECT DISTINCT book_id, node_id FROM ch) c LEFT JOIN f ON c.book_id = f.book_id AND c.node_id = f.node_id""")
def tree_links(spark, sf):
    b, roots = _roots(spark, sf)
    return T.tree_links(b.select("book_id", col("section_id").alias("node_id"), "block_id"), roots)


@query(f"""WITH {_ROOTS}, p AS (SELECT book_id, node_id, section_id, min(order_idx) AS o FROM roots GROUP BY ALL)
SELECT book_id, node_id, string_agg(section_id, ',' ORDER BY o) AS section_ids FROM p GROUP BY ALL""")
def node_sections(spark, sf):
    b, roots = _roots(spark, sf)
    return T.node_sections(roots, b).withColumn("section_ids", F.array_join("section_ids", ","))


@query(f"""WITH {V.CHUNKS}, n AS (SELECT book_id, chunk_id AS node_id, 0 AS raptor_level, section_id FROM chunks_x UNION ALL SELECT DISTINCT book_id, 'raptor_l1_' || section_id, 1, section_id FROM chunks_x),
i AS (SELECT book_id, CASE chunk_ord % 4 WHEN 0 THEN ' ' || chunk_id || ' ' WHEN 1 THEN substr(chunk_id, 5) WHEN 2 THEN 'raptor_l1_' || section_id ELSE 'nothing' END AS raw FROM chunks_x),
k AS (SELECT book_id, raw, CASE WHEN trim(raw) LIKE 'raptor_l%' OR trim(raw) LIKE 'chk_%' THEN trim(raw) ELSE 'chk_' || trim(raw) END AS node_id FROM i)
SELECT k.book_id, k.raw, k.node_id, raptor_level, section_id FROM k LEFT JOIN n ON k.book_id = n.book_id AND k.node_id = n.node_id""")
def lookup_nodes(spark, sf):
    c = S.chunk_ranges(S.blocks(spark, sf))
    top = F.concat(lit("raptor_l1_"), col("section_id"))
    nodes = c.select("book_id", col("chunk_id").alias("node_id"), lit(0).alias("raptor_level"), "section_id").unionByName(
        c.select("book_id", top.alias("node_id"), lit(1).alias("raptor_level"), "section_id").distinct())
    m = col("chunk_ord") % 4
    raw = F.when(m == 0, F.concat(lit(" "), "chunk_id", lit(" "))).when(m == 1, F.substring("chunk_id", 5, 20)).when(m == 2, top).otherwise("nothing")
    return T.lookup_nodes(c.select("book_id", raw.alias("raw")), nodes)


# pages of a third of the chunks are unknown; level-2 nodes cover six chunks each and have no section of their own
@query(f"""WITH {V.SPANS}, c AS (SELECT book_id, chunk_id, chunk_ord, section_id, block_ids FROM spans),
cov AS (SELECT DISTINCT book_id, 'raptor_l2_c' || chunk_ord // 6 AS node_id, unnest(block_ids) AS block_id FROM c UNION SELECT DISTINCT book_id, 'raptor_l1_' || section_id, unnest(block_ids) FROM c),
n AS (SELECT book_id, chunk_id AS node_id, 0 AS lv, CASE WHEN chunk_ord % 3 > 0 THEN chunk_ord END AS page, section_id FROM c UNION ALL SELECT DISTINCT book_id, 'raptor_l1_' || section_id, 1, 7, section_id FROM c
  UNION ALL SELECT DISTINCT book_id, 'raptor_l2_c' || chunk_ord // 6, 2, NULL::BIGINT, NULL FROM c),
i AS (SELECT book_id, CASE chunk_ord % 5 WHEN 0 THEN ' ' || chunk_id WHEN 1 THEN substr(chunk_id, 5) WHEN 2 THEN 'raptor_l1_' || section_id WHEN 3 THEN 'raptor_l2_c' || chunk_ord // 6 ELSE 'raptor_l9_x' END AS raw FROM c),
k AS (SELECT book_id, raw, CASE WHEN trim(raw) LIKE 'raptor_l%' OR trim(raw) LIKE 'chk_%' THEN trim(raw) ELSE 'chk_' || trim(raw) END AS node_id FROM i),
s AS (SELECT cov.book_id, cov.node_id, b.section_id, min(b.order_idx) AS o FROM cov JOIN blocks_x b ON cov.book_id = b.book_id AND cov.block_id = b.block_id GROUP BY ALL),
g AS (SELECT book_id, node_id, string_agg(section_id, ',' ORDER BY o) AS ids FROM s GROUP BY ALL), z AS (SELECT book_id, node_id, count(*) AS n FROM cov GROUP BY ALL)
SELECT k.book_id, k.raw, k.node_id, n.lv AS raptor_level, CASE WHEN lv = 0 AND page > 0 THEN page END AS page, n.section_id, CASE WHEN lv > 1 THEN ids END AS section_ids, CASE WHEN lv > 0 THEN z.n END AS n_blocks
FROM k LEFT JOIN n ON k.book_id = n.book_id AND k.node_id = n.node_id LEFT JOIN g ON k.book_id = g.book_id AND k.node_id = g.node_id LEFT JOIN z ON k.book_id = z.book_id AND k.node_id = z.node_id""")
def node_records(spark, sf):
    c = store.stage(Q.spans_of(spark, sf).select("book_id", "chunk_id", "chunk_ord", "section_id", "block_ids"))
    one, two = F.concat(lit("raptor_l1_"), "section_id"), F.concat(lit("raptor_l2_c"), F.floor(col("chunk_ord") / 6).cast("string"))
    cover = lambda name: c.select("book_id", name.alias("node_id"), F.explode("block_ids").alias("block_id")).distinct()
    none = lit(None).cast("string")
    nodes = (c.select("book_id", col("chunk_id").alias("node_id"), lit(0).alias("raptor_level"), F.when(col("chunk_ord") % 3 > 0, col("chunk_ord")).cast("long").alias("page"), "section_id")
             .unionByName(c.select("book_id", one.alias("node_id"), lit(1).alias("raptor_level"), lit(7).cast("long").alias("page"), "section_id").distinct())
             .unionByName(c.select("book_id", two.alias("node_id"), lit(2).alias("raptor_level"), lit(None).cast("long").alias("page"), none.alias("section_id")).distinct()))
    m = col("chunk_ord") % 5
    raw = F.when(m == 0, F.concat(lit(" "), "chunk_id")).when(m == 1, F.substring("chunk_id", 5, 20)).when(m == 2, one).when(m == 3, two).otherwise("raptor_l9_x")
    got = T.node_records(c.select("book_id", raw.alias("raw")), nodes, cover(one).unionByName(cover(two)), S.blocks(spark, sf))
    return got.withColumn("section_ids", F.array_join("section_ids", ","))


@query(f"SELECT doc_id, {_LEAD.format('text', 20)} AS lead, NULL::VARCHAR AS lead_error FROM documents")
def map_text_default(spark, sf):
    d = S.table(spark, sf, "documents").select("doc_id", "text")
    return hooks.map_text(d, "text", lambda texts: hooks.lead_words(texts, 20), "lead").drop("text")


class _Flaky:
    """A client whose every call fails once, and for some texts always."""

    def __init__(self):
        self.seen = set()

    def __call__(self, texts):
        if len(texts) > 1:
            raise ConnectionError
        if len(texts[0]) % 7 == 0:
            raise ValueError
        if texts[0] not in self.seen:
            self.seen.add(texts[0])
            raise ConnectionError
        return hooks.lead_words(texts, 3)


@query(f"""SELECT lang, CASE WHEN length(text) % 7 = 0 THEN 'ValueError' END AS error, count(*) AS n, min(CASE WHEN length(text) % 7 = 0 THEN '-' ELSE {_LEAD.format('text', 3)} END) AS least FROM documents GROUP BY ALL""")
def map_text_audit(spark, sf):
    d = S.table(spark, sf, "documents").select("lang", "text")
    got = hooks.map_text(d, "text", None, "lead", "-", client=_Flaky, retries=1)
    return got.groupBy("lang", col("lead_error").alias("error")).agg(F.count(lit(1)).alias("n"), F.min("lead").alias("least"))


@query()
def embed_default(spark, sf):
    return hooks.embed(S.passages(spark, sf), "text").select("query_id", "embedding")
