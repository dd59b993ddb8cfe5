"""Queries over retrieval, evidence and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codexloom.functions import columns as C
from codexloom.functions import labels as L
from codexloom.operators import chunks as K
from codexloom.operators import retrieval as R
from codexloom.plans import corpus_queries as Q
from codexloom.plans import sqlviews as V
from codexloom.plans.base import query
from codexloom.sources import corpus as S

col, lit = F.col, F.lit


def _questions(spark, sf):
    """Every clause of every benchmark passage, with all of its words."""
    clauses = S.passages(spark, sf).select("query_id", F.posexplode(F.split("text", "[.,;:!?]")).alias("i", "c"))
    return clauses.select((col("query_id") * 1000 + col("i")).alias("query_id"), C.tokens(col("c")).alias("tokens"))


def _top(spark, sf, k=8):
    return R.keyword_search(_questions(spark, sf), R.kept_keyword_index(S.blocks(spark, sf), f"{sf}/documents.parquet"), k=k)


@query(f"WITH {V.INDEX} SELECT p.token, df, sum(tf)::BIGINT AS n_tokens, max(tf) AS max_tf FROM postings p JOIN df ON p.token = df.token GROUP BY p.token, df")
def keyword_index(spark, sf):
    p = R.keyword_index(S.blocks(spark, sf)).postings
    return p.groupBy("token").agg(F.count(lit(1)).alias("df"), F.sum("tf").alias("n_tokens"), F.max("tf").alias("max_tf"))


@query(f"WITH {V.SEARCH} SELECT query_id, book_id, block_id, order_idx, round(score, 4) AS score, rank FROM top")
def keyword_search(spark, sf):
    return _top(spark, sf).withColumn("score", F.round("score", 4)).withColumn("rank", col("rank").cast("long"))


@query()
def keyword_snippet(spark, sf):
    b = S.blocks(spark, sf).select("book_id", "block_id", "text")
    hits = _top(spark, sf).join(b, ["book_id", "block_id"]).join(_questions(spark, sf), "query_id")
    return hits.select("query_id", "rank", "block_id", R.snippet(col("text"), col("tokens")).alias("snippet"))


@query(f"""WITH {V.SEARCH}, {V.BLOCK_CHUNK.removeprefix(V.BLOCKS + ",")}, kc AS (SELECT t.query_id, t.book_id, b.chunk_id, min(t.rank) AS r FROM top t JOIN b2c b ON t.book_id = b.book_id AND t.block_id = b.block_id GROUP BY ALL)
SELECT query_id, book_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY r, book_id, chunk_id) AS rank, 'keyword' AS origin FROM kc""")
def keyword_chunks(spark, sf):
    got = R.keyword_chunks(_top(spark, sf), K.block_to_chunk(Q.spans_of(spark, sf)))
    return got.withColumn("rank", col("rank").cast("long"))


def _vectors(spark, sf):
    e = S.table(spark, sf, "embeddings")
    return (e.where("vec_id % 100 = 0").select(col("vec_id").alias("query_id"), col("embedding").alias("vector"), "label"),
            e.select(col("vec_id").alias("node_id"), col("embedding").alias("vector"), "label"))


_SIMS = """sims AS (SELECT q.vec_id AS query_id, d.vec_id AS node_id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS sim, q.label = d.label AS same
  FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0)"""


@query(f"""WITH {_SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, node_id) AS rank FROM sims) SELECT query_id, node_id, sim, rank FROM r WHERE rank <= 3""")
def vector_topk(spark, sf):
    q, d = _vectors(spark, sf)
    return R.vector_topk(q, d).withColumn("rank", col("rank").cast("long"))


@query(f"""WITH {_SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, node_id) AS rank FROM sims WHERE same) SELECT query_id, node_id, sim, rank FROM r WHERE rank <= 6""")
def vector_topk_section(spark, sf):
    q, d = _vectors(spark, sf)
    return R.vector_topk(q, d, k=6, on=["label"]).withColumn("rank", col("rank").cast("long"))


@query()
def vector_topk_ivf(spark, sf):
    q, d = _vectors(spark, sf)
    return R.vector_topk_codes(q, R.vector_codes(d))


@query(f"""WITH {_SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, node_id) AS rank FROM sims), c AS (SELECT * FROM r WHERE rank <= 20),
m AS (SELECT a.query_id, a.node_id AS n1, b.node_id AS n2, round(list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS s
  FROM c a JOIN c b ON a.query_id = b.query_id JOIN embeddings x ON x.vec_id = a.node_id JOIN embeddings y ON y.vec_id = b.node_id),
p1 AS (SELECT query_id, node_id FROM c WHERE rank = 1),
s2 AS (SELECT c.query_id, c.node_id, row_number() OVER (PARTITION BY c.query_id ORDER BY round(0.5 * c.sim - 0.5 * m.s, 6) DESC, c.rank) AS k
  FROM c JOIN p1 ON c.query_id = p1.query_id JOIN m ON m.query_id = c.query_id AND m.n1 = c.node_id AND m.n2 = p1.node_id WHERE c.node_id <> p1.node_id),
p2 AS (SELECT query_id, node_id FROM s2 WHERE k = 1),
s3 AS (SELECT c.query_id, c.node_id, row_number() OVER (PARTITION BY c.query_id ORDER BY round(0.5 * c.sim - 0.5 * greatest(m1.s, m2.s), 6) DESC, c.rank) AS k
  FROM c JOIN p1 ON c.query_id = p1.query_id JOIN p2 ON c.query_id = p2.query_id JOIN m m1 ON m1.query_id = c.query_id AND m1.n1 = c.node_id AND m1.n2 = p1.node_id
  JOIN m m2 ON m2.query_id = c.query_id AND m2.n1 = c.node_id AND m2.n2 = p2.node_id WHERE c.node_id NOT IN (p1.node_id, p2.node_id))
SELECT query_id, node_id, 1 AS rank FROM p1 UNION ALL SELECT query_id, node_id, 2 FROM p2 UNION ALL SELECT query_id, node_id, 3 FROM s3 WHERE k = 1""")
def mmr(spark, sf):
    q, d = _vectors(spark, sf)
    return R.mmr(R.vector_topk(q, d, k=20).join(d.select("node_id", "vector"), "node_id"))


_LEDGER = "ev AS (SELECT user_id, event_id, ts, event_type, value, props, json_extract(props, '$.k')::BIGINT AS k FROM events)"


@query(f"""WITH {_LEDGER}, l AS (SELECT user_id AS query_id, k AS chunk_id, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS h, event_id % 3 AS leg_no, event_id AS r FROM ev),
a AS (SELECT query_id, chunk_id, min([h, leg_no, r]) AS at_, max(h) = 1 AS hy, min(h) = 0 AS mq FROM l GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY at_, chunk_id) AS rank FROM a)
SELECT query_id, chunk_id, rank, CASE WHEN hy AND mq THEN 'both' WHEN hy THEN 'hyde' ELSE 'multi_query' END AS origin FROM w WHERE rank <= 8""")
def multi_query_merge(spark, sf):
    e = S.ledger(spark, sf)
    legs = e.select(col("session_id").alias("query_id"), F.when(col("kind") == "view", "hyde").otherwise("variant").alias("leg"), (col("seq") % 3).alias("leg_no"),
                    col("seq").alias("rank"), col("chunk_key").alias("chunk_id"))
    return R.multi_query_merge(legs).withColumn("rank", col("rank").cast("long"))


def _sections(spark, sf):
    s = S.section_labels(spark, sf)
    return s.select("book_id", col("doc_id").cast("string").alias("section_id"), col("doc_id").alias("order_idx"), "label",
                    L.section_kind(col("label")).alias("kind"), L.printed_number(col("label")).alias("printed_number"))


@query(f"""WITH {Q._NUMBERS}, rq AS (SELECT item_id AS query_id, 'src' || item_id % 20 AS book_id, item_id % 14 - 1 AS n FROM benchmark),
pa AS (SELECT book_id, printed_number::BIGINT AS n, arg_min(doc_id, doc_id)::VARCHAR AS s FROM kinds WHERE kind = 'chapter' AND printed_number IS NOT NULL GROUP BY ALL),
nb AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY doc_id) AS n, doc_id::VARCHAR AS s FROM kinds WHERE kind IN ('chapter', 'prologue', 'epilogue'))
SELECT rq.query_id, rq.book_id, rq.n, CASE WHEN rq.n > 0 THEN coalesce(pa.s, nb.s) END AS section_id
FROM rq LEFT JOIN pa ON rq.book_id = pa.book_id AND rq.n = pa.n LEFT JOIN nb ON rq.book_id = nb.book_id AND rq.n = nb.n""")
def chapter_lookup(spark, sf):
    rq = S.passages(spark, sf).select("query_id", F.concat(lit("src"), (col("query_id") % 20).cast("string")).alias("book_id"), (col("query_id") % 14 - 1).alias("n"))
    return R.chapter_section(rq, _sections(spark, sf))


def _nodes(spark, sf):
    c = S.chunk_ranges(S.blocks(spark, sf)).select("book_id", "section_id", "doc_id", "chunk_id", lit(0).alias("raptor_level"), "chunk_ord")
    top = c.groupBy("book_id", "section_id", "doc_id").agg(F.min("chunk_ord").alias("chunk_ord")).select(
        "book_id", "section_id", "doc_id", F.concat(lit("raptor_l1_"), col("section_id")).alias("chunk_id"), lit(1).alias("raptor_level"), "chunk_ord")
    return c.unionByName(top)


# every hundredth vector asks about its label's chapter; labels from 8 on have no nodes of their own, labels of 5 no summary
@query("""WITH r AS (SELECT vec_id AS query_id, label AS s, embedding AS q, list_transform(embedding, lambda x: -x) AS c FROM embeddings WHERE vec_id % 100 = 0),
raw AS (SELECT query_id, s, 'c' || lpad(vec_id::VARCHAR, 7, '0') AS chunk_id, 0 AS lv, round(list_dot_product(q::DOUBLE[], embedding::DOUBLE[]), 6) AS sim, 'relevance' AS origin FROM r JOIN embeddings ON label = s WHERE s < 8),
tops AS (SELECT query_id, s, 'top' || s AS chunk_id, 1 AS lv, NULL AS sim, 'summary' AS origin FROM r WHERE s < 8 AND s <> 5),
back AS (SELECT query_id, s, 'c' || lpad(vec_id::VARCHAR, 7, '0') AS chunk_id, 0 AS lv, round(list_dot_product(c::DOUBLE[], embedding::DOUBLE[]), 6) AS sim, 'fallback' AS origin FROM r JOIN embeddings ON label = s WHERE s >= 8),
u AS (SELECT * FROM raw UNION ALL SELECT * FROM tops UNION ALL SELECT * FROM back),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY origin <> 'summary', sim DESC, chunk_id) AS rank FROM u)
SELECT query_id, 'b' AS book_id, s AS section_id, chunk_id, lv AS raptor_level, rank, origin FROM k WHERE rank <= CASE WHEN origin = 'fallback' THEN 6 ELSE 8 END""")
def chapter_docs_by_relevance(spark, sf):
    e = S.table(spark, sf, "embeddings").select("vec_id", lit("b").alias("book_id"), col("label").alias("section_id"), F.concat(lit("c"), F.lpad(col("vec_id").cast("string"), 7, "0")).alias("chunk_id"), col("embedding").alias("vector"))
    known = e.where("section_id < 8")
    nodes = known.select("book_id", "section_id", "chunk_id", lit(0).alias("raptor_level")).unionByName(
        known.where("section_id <> 5").select("book_id", "section_id", F.concat(lit("top"), col("section_id").cast("string")).alias("chunk_id"), lit(1).alias("raptor_level")).distinct())
    rq = e.where("vec_id % 100 = 0").select(col("vec_id").alias("query_id"), "book_id", "section_id", "vector", F.transform("vector", lambda x: -x).alias("chapter_vector"))
    return R.chapter_docs_by_relevance(rq, nodes, e).withColumn("rank", col("rank").cast("long"))


@query("""WITH a AS (SELECT doc_id AS query_id, n_chars < 1500 AS refused FROM documents), k AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
j AS (SELECT a.*, k.doc_id IS NULL AS none FROM a LEFT JOIN k ON a.query_id = k.doc_id)
SELECT count(*) AS n_queries, count(*) FILTER (WHERE none) AS n_unanswerable, count(*) FILTER (WHERE refused AND none) / count(*) FILTER (WHERE none) AS refusal_recall,
count(*) FILTER (WHERE refused AND none) / count(*) FILTER (WHERE refused) AS refusal_precision, count(*) FILTER (WHERE refused = none) / count(*) AS correctness FROM j""")
def refusal_metrics(spark, sf):
    answers = S.table(spark, sf, "documents").select(col("doc_id").alias("query_id"), (col("n_chars") < 1500).alias("refused"))
    return R.refusal_metrics(answers, S.table(spark, sf, "labels").where("quality = 1").select(col("doc_id").alias("query_id")))


_STRIDE = "({n} <= {k} OR i IN (SELECT round_even(j * ({n} - 1) / {d}, 0)::BIGINT FROM range({k}) t(j)))"


@query(f"""WITH {V.CHUNKS}, c AS (SELECT book_id, section_id, doc_id, chunk_id, chunk_ord, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY book_id, section_id) AS n
  FROM chunks_x WINDOW w AS (PARTITION BY book_id, section_id ORDER BY chunk_ord)),
s AS (SELECT * FROM c WHERE n <= 7 OR list_contains(list_transform(range(7), lambda j: round_even(j * (n - 1) / 6.0, 0)::BIGINT), i)),
u AS (SELECT doc_id AS query_id, book_id, section_id, chunk_id, 0 AS raptor_level, 1 AS p, chunk_ord FROM s
  UNION ALL SELECT DISTINCT doc_id, book_id, section_id, 'raptor_l1_' || section_id, 1, 0, -1 FROM c)
SELECT query_id, book_id, section_id, chunk_id, raptor_level, row_number() OVER (PARTITION BY query_id ORDER BY p, chunk_ord) AS rank FROM u""")
def chapter_docs(spark, sf):
    nodes = _nodes(spark, sf)
    rq = nodes.where("raptor_level = 1").select(col("doc_id").alias("query_id"), "book_id", "section_id", "doc_id")
    return R.chapter_docs(rq, nodes).withColumn("rank", col("rank").cast("long"))


@query(f"""WITH {V.CHUNKS}, c AS (SELECT book_id, chunk_id, chunk_ord, row_number() OVER (PARTITION BY book_id ORDER BY chunk_ord) - 1 AS i, count(*) OVER (PARTITION BY book_id) AS n FROM chunks_x)
SELECT book_id, chunk_id, chunk_ord FROM c WHERE n <= 8 OR list_contains(list_transform(range(8), lambda j: round_even(j * (n - 1) / 7.0, 0)::BIGINT), i)""")
def stride_sample(spark, sf):
    return R.stride_sample(S.chunk_ranges(S.blocks(spark, sf)), ["book_id"], "chunk_ord", 8).select("book_id", "chunk_id", "chunk_ord")


@query(f"""WITH {V.BLOCK_CHUNK}, s AS (SELECT *, greatest(lo - 1, 0) AS f, hi - lo + 2 AS len FROM spans),
j AS (SELECT s.chunk_ord AS query_id, s.book_id, s.chunk_id, c.chunk_id AS neighbor_id, min(b.order_idx) AS o FROM s
  JOIN blocks_x b ON b.book_id = s.book_id AND b.order_idx BETWEEN s.f AND s.f + s.len JOIN b2c c ON c.book_id = b.book_id AND c.block_id = b.block_id
  WHERE c.chunk_id <> s.chunk_id GROUP BY ALL)
SELECT query_id, book_id, chunk_id, neighbor_id, row_number() OVER (PARTITION BY query_id, book_id, chunk_id ORDER BY o) AS rank FROM j""")
def expand_neighbors(spark, sf):
    spans = Q.spans_of(spark, sf)
    seeds = spans.select(col("chunk_ord").alias("query_id"), "book_id", "chunk_id")
    got = R.expand_neighbors(seeds, spans, S.blocks(spark, sf), K.block_to_chunk(spans))
    return got.withColumn("rank", col("rank").cast("long"))


def _evidence(spark, sf):
    e = S.ledger(spark, sf)
    origin = F.when(col("kind") == "click", "keyword").when(col("kind") == "view", "hyde").otherwise("multi_query")
    return e.select(col("session_id").alias("query_id"), (col("seq") % 4).alias("sub_no"), col("seq").alias("pos"), F.when(col("value") >= 1, col("chunk_key")).alias("chunk_id"),
                    origin.alias("origin"), (col("chunk_key") % 5).alias("section_id"))


_EVIDENCE = f"""{_LEDGER}, evid AS (SELECT user_id AS query_id, event_id % 4 AS sub_no, event_id AS pos, CASE WHEN value >= 1 THEN k END AS chunk_id,
  CASE event_type WHEN 'click' THEN 'keyword' WHEN 'view' THEN 'hyde' ELSE 'multi_query' END AS origin, k % 5 AS section_id FROM ev)"""


@query(f"""WITH {_EVIDENCE}, g AS (SELECT query_id, sub_no, chunk_id, min(pos) AS pos, arg_min(origin, pos) AS o, bool_or(origin = 'keyword') AS kw, count(DISTINCT origin) AS n FROM evid WHERE chunk_id IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY sub_no, pos) AS rn FROM g)
SELECT query_id, sub_no, chunk_id, pos, CASE WHEN n > 1 AND kw THEN 'both' ELSE o END AS origin FROM r WHERE rn = 1
UNION ALL SELECT query_id, sub_no, chunk_id, pos, origin FROM evid WHERE chunk_id IS NULL""")
def merge_evidence(spark, sf):
    return R.merge_evidence(_evidence(spark, sf))


@query(f"""WITH {_EVIDENCE}, a AS (SELECT query_id, sub_no, section_id, pos, row_number() OVER (PARTITION BY query_id, sub_no, section_id ORDER BY pos) AS i,
  min(pos) OVER (PARTITION BY query_id, sub_no, section_id) AS fs, min(pos) OVER (PARTITION BY query_id, sub_no) AS fq FROM evid),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, sub_no ORDER BY i, fs) AS j FROM a)
SELECT query_id, sub_no, section_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY j, fq) AS rank FROM b""")
def balance_evidence(spark, sf):
    return R.balance(_evidence(spark, sf).select("query_id", "sub_no", "section_id", "pos")).withColumn("rank", col("rank").cast("long"))


def _ranked(spark, sf):
    """The session's hits as evidence with levels, pages and labels."""
    e = S.ledger(spark, sf)
    w = Window.partitionBy("session_id").orderBy("seq")
    return e.select("session_id", "book_id", "seq", "kind", "chunk_key", col("chunk_key").alias("chunk_id"), (col("chunk_key") % 3 == 0).cast("int").alias("raptor_level"),
                    (col("chunk_key") % 7).alias("page"), F.when(col("chunk_key") % 4 > 0, F.concat(lit("Section "), (col("chunk_key") % 4).cast("string"))).alias("section_label"),
                    (col("chunk_key") % 9).alias("chapter"), F.concat(lit("text of "), col("seq").cast("string"), lit(" "), F.repeat(col("kind"), 100)).alias("text"),
                    F.row_number().over(w).cast("long").alias("rank"))


_RANKED = f"""{_LEDGER}, rk AS (SELECT user_id AS session_id, user_id % 20 AS book_id, event_id AS seq, event_type AS kind, k AS chunk_id, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS raptor_level, k % 7 AS page,
  CASE WHEN k % 4 > 0 THEN 'Section ' || k % 4 END AS section_label, k % 9 AS chapter, 'text of ' || event_id || ' ' || repeat(event_type, 100) AS text,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM ev)"""


@query(f"WITH {_RANKED} SELECT session_id, rank, chunk_id, raptor_level FROM rk WHERE rank <= 16")
def context_cap(spark, sf):
    return R.context_cap(_ranked(spark, sf)).select("session_id", "rank", "chunk_id", "raptor_level")


@query(f"""WITH {_RANKED}, c AS (SELECT session_id, chunk_id, min(rank) AS rank FROM rk WHERE rank <= 16 AND raptor_level = 0 GROUP BY ALL)
SELECT session_id, chunk_id, rank FROM c WHERE (session_id, chunk_id) NOT IN (SELECT (session_id, chunk_id) FROM rk WHERE rank > 16 AND kind = 'click')""")
def newly_lit(spark, sf):
    r = _ranked(spark, sf)
    return R.newly_lit(R.context_cap(r), r.where("rank > 16 and kind = 'click'")).select("session_id", "chunk_id", "rank")


@query(f"""WITH {_RANKED}, x AS (SELECT *, row_number() OVER (PARTITION BY session_id, chunk_id ORDER BY rank) AS n FROM rk)
SELECT x.session_id AS event_id, x.chunk_id, x.rank, CASE kind WHEN 'click' THEN 'keyword' WHEN 'view' THEN 'alt' ELSE 'unknown' END AS origin,
  x.raptor_level = 0 AND x.chunk_id IN (SELECT chunk_id FROM rk z WHERE z.session_id = x.session_id AND z.rank <= 16) AS is_new_lighting, substr(text, 1, 2000) AS preview_text FROM x WHERE n = 1""")
def event_chunks(spark, sf):
    r = _ranked(spark, sf)
    lit_ = R.context_cap(r).where("raptor_level = 0").select("session_id", "chunk_id")
    e = r.select(col("session_id").alias("event_id"), "session_id", col("seq").alias("pos"), "chunk_id", F.when(col("kind") == "click", "keyword").alias("origin"),
                 F.when(col("kind") == "view", "alt").alias("retrieval_origin"), "text")
    return R.event_chunks(e, lit_).withColumn("rank", col("rank").cast("long"))


@query(f"""WITH {_RANKED} SELECT session_id AS query_id, rank, chunk_id, coalesce(section_label, 'Chapter ' || chapter) || CASE WHEN raptor_level > 0 THEN ' · Summary' WHEN page > 0 THEN ' · Page ' || page ELSE '' END AS label,
substr(text, 1, 400) AS text, CASE WHEN chunk_id % 2 = 0 THEN 'b' || chunk_id END AS primary_block_id FROM rk WHERE rank <= 4""")
def source_refs(spark, sf):
    r = _ranked(spark, sf).withColumnRenamed("session_id", "query_id")
    cites = r.where("chunk_id % 2 = 0").select("book_id", "chunk_id", F.concat(lit("b"), col("chunk_id").cast("string")).alias("primary_block_id")).distinct()
    return R.source_refs(r, cites)


@query(f"""WITH {_RANKED}, p AS (SELECT session_id AS query_id, string_agg('[' || coalesce(section_label, 'Body') || CASE WHEN raptor_level > 0 THEN ' · Summary' WHEN page > 0 THEN ' · Page ' || page ELSE '' END || ']' || chr(10) || text,
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS c FROM rk WHERE rank <= 16 GROUP BY ALL),
q AS (SELECT DISTINCT user_id AS query_id FROM ev UNION SELECT -1) SELECT q.query_id, coalesce(c, '(no passages found)') AS context FROM q LEFT JOIN p ON q.query_id = p.query_id""")
def context_pack(spark, sf):
    r = _ranked(spark, sf).withColumnRenamed("session_id", "query_id").withColumn("section_label", F.coalesce("section_label", lit("Body")))
    qs = r.select("query_id").unionByName(spark.range(1).select(lit(-1).cast("long").alias("query_id"))).distinct()
    return R.context_pack(qs, R.context_cap(r))


@query("""WITH d AS (SELECT d.doc_id AS item, d.doc_id % 50 AS query_id, row_number() OVER (PARTITION BY d.doc_id % 50 ORDER BY n_chars DESC, d.doc_id) AS rank FROM documents d),
rel AS (SELECT doc_id AS item, doc_id % 50 AS query_id FROM labels WHERE quality = 1), n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY ALL),
h AS (SELECT d.query_id, count(*) AS h, min(rank) AS r FROM d JOIN rel ON d.query_id = rel.query_id AND d.item = rel.item WHERE rank <= 8 GROUP BY ALL)
SELECT n.query_id, coalesce(h, 0) / n.n AS recall, coalesce(h, 0) / 8 AS precision, coalesce(1 / r, 0) AS mrr FROM n LEFT JOIN h ON n.query_id = h.query_id""")
def retrieval_metrics(spark, sf):
    w = Window.partitionBy("query_id").orderBy(col("n_chars").desc(), "item")
    d = S.table(spark, sf, "documents").select(col("doc_id").alias("item"), (col("doc_id") % 50).alias("query_id"), "n_chars")
    rel = S.table(spark, sf, "labels").where("quality = 1").select(col("doc_id").alias("item"), (col("doc_id") % 50).alias("query_id"))
    return R.retrieval_metrics(d.withColumn("rank", F.row_number().over(w)), rel)
