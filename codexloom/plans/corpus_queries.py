"""Queries over sources, blocks, labels and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codexloom.functions import columns as C
from codexloom.functions import labels as L
from codexloom.operators import blocks as B
from codexloom.operators import chunks as K
from codexloom.operators.dom import dom_blocks as parse_dom
from codexloom.plans import sqlviews as V
from codexloom.plans.base import query
from codexloom.sources import corpus as S
from codexloom.sources import exports, store
from codexloom.sources.versions import BookStore

col, lit = F.col, F.lit


@query("SELECT source AS book_id, doc_id, lang, n_chars FROM documents WHERE source IN ('src1', 'src3')")
def scan_books(spark, sf):
    return S.table(spark, sf, "documents").where(col("source").isin("src1", "src3")).select(col("source").alias("book_id"), "doc_id", "lang", "n_chars")


@query()
def dom_blocks(spark, sf):
    return parse_dom(S.table(spark, sf, "pages"))


@query(f"WITH {V.BLOCKS} SELECT block_id, order_idx, start_off, end_off FROM blocks_x WHERE book_id = 'src3' AND end_off >= 1000 AND start_off <= 5000 ORDER BY order_idx LIMIT 200")
def blocks_by_offset(spark, sf):
    return store.browse_blocks(S.blocks(spark, sf), "src3", from_off=1000, to_off=5000).select("block_id", "order_idx", "start_off", "end_off")


@query(f"""WITH {V.BLOCKS}, page AS (SELECT block_id, order_idx FROM blocks_x WHERE book_id = 'src5' AND order_idx > 20 ORDER BY order_idx LIMIT 50)
SELECT block_id, order_idx, CASE WHEN count(*) OVER () = 50 THEN max(order_idx) OVER () END AS cursor FROM page""")
def blocks_page(spark, sf):
    page = store.browse_blocks(S.blocks(spark, sf), "src5", after=20, limit=50).select("block_id", "order_idx")
    # at most a page of rows: one window without a key holds it
    w = Window.partitionBy(lit(1))
    return page.select("block_id", "order_idx", F.when(F.count(lit(1)).over(w) == 50, F.max("order_idx").over(w)).alias("cursor"))


@query(f"WITH {V.BLOCKS} SELECT book_id, count(*) AS n_blocks, max(order_idx) AS last_order FROM blocks_x WHERE book_id <> 'src4' AND (book_id <> 'src2' OR order_idx < 5) GROUP BY book_id")
def replace_book(spark, sf):
    path = f"{store.scratch(spark)}/blocks"
    b = S.blocks(spark, sf).select("book_id", "block_id", "order_idx", "text")
    store.replace_books(b, path)
    store.replace_books(b.where("book_id = 'src2' and order_idx < 5"), path, ["src2"])
    store.replace_books(b.where("false"), path, ["src4"])
    return spark.read.schema(b.schema).parquet(path).groupBy("book_id").agg(F.count(lit(1)).alias("n_blocks"), F.max("order_idx").alias("last_order"))


@query(f"""WITH {V.BLOCKS}, b AS (SELECT * FROM blocks_x WHERE book_id <> 'src4' AND (book_id <> 'src2' OR order_idx < 5)), w AS (SELECT DISTINCT book_id, block_id, unnest(string_split(lower(text), ' ')) AS token FROM b),
n AS (SELECT book_id, count(*) AS n_postings FROM w WHERE token <> '' GROUP BY book_id)
SELECT b.book_id, count(*) AS n_blocks, max(order_idx) AS last_order, n_postings, n_blocks AS reported FROM b JOIN n ON b.book_id = n.book_id GROUP BY b.book_id, n_postings""")
def replace_book_with_index(spark, sf):
    st = BookStore(spark, store.scratch(spark))
    b = store.stage(S.blocks(spark, sf).select("book_id", "block_id", "order_idx", "text"))

    def put(rows, books):
        st.replace(books, blocks=rows, postings=K.block_words(rows), report=rows.groupBy("book_id").agg(F.count(lit(1)).alias("n_blocks")))

    put(b, b.select("book_id"))
    put(b.where("book_id = 'src2' and order_idx < 5"), spark.range(1).select(lit("src2").alias("book_id")))
    put(b.where("false"), spark.range(1).select(lit("src4").alias("book_id")))
    blocks = st.read("blocks", b.schema).groupBy("book_id").agg(F.count(lit(1)).alias("n_blocks"), F.max("order_idx").alias("last_order"))
    postings = st.read("postings", "book_id string, block_id string, token string").groupBy("book_id").agg(F.count(lit(1)).alias("n_postings"))
    report = st.read("report", "book_id string, n_blocks long").withColumnRenamed("n_blocks", "reported")
    return blocks.join(postings, "book_id", "full").join(report, "book_id", "full").select("book_id", "n_blocks", "last_order", "n_postings", "reported")


@query("SELECT DISTINCT source AS book_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'de' AND n_chars > 9000)")
def books_missing_index(spark, sf):
    d = S.table(spark, sf, "documents").withColumnRenamed("source", "book_id")
    return store.missing_books(d, d.where("lang = 'de' and n_chars > 9000"))


_PURGED = "(3, 7)"


@query(f"""WITH s AS (SELECT o_orderkey, o_custkey % 20 AS book_id FROM orders), gone AS (SELECT o_orderkey FROM s WHERE book_id IN {_PURGED})
SELECT 'sessions' AS tab, count(*) AS n, sum(o_orderkey)::BIGINT AS key_sum FROM s WHERE book_id NOT IN {_PURGED}
UNION ALL SELECT 'event_chunks', count(*), sum(l_orderkey)::BIGINT FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone)
UNION ALL SELECT 'ledger', count(*), sum(event_id)::BIGINT FROM events WHERE user_id % 20 NOT IN {_PURGED}
UNION ALL SELECT 'notes', count(CASE WHEN conv_id % 20 NOT IN {_PURGED} THEN 1 END), sum(conv_id)::BIGINT FROM conversations""")
def purge_books(spark, sf):
    ids = spark.range(20).where("id in (3, 7)").select(col("id").alias("book_id"))
    sessions = S.table(spark, sf, "orders").select("o_orderkey", (col("o_custkey") % 20).alias("book_id"))
    chunks = S.table(spark, sf, "lineitem").select(col("l_orderkey").alias("o_orderkey"))
    notes = S.table(spark, sf, "conversations").select("conv_id", (col("conv_id") % 20).alias("book_id"), (col("conv_id") % 20).alias("source_book_id"))

    def tally(df, name, key, n=F.count(lit(1))):
        return df.agg(n.alias("n"), F.sum(key).alias("key_sum")).select(lit(name).alias("tab"), "n", "key_sum")

    return (tally(store.purge(sessions, ids, "book_id"), "sessions", "o_orderkey")
            .unionByName(tally(store.purge_children(chunks, sessions, ids, "o_orderkey", "book_id"), "event_chunks", "o_orderkey"))
            .unionByName(tally(store.purge(S.ledger(spark, sf), ids, "book_id"), "ledger", "seq"))
            .unionByName(tally(store.unlink(notes, ids, "book_id", ["source_book_id"]), "notes", "conv_id", F.count("source_book_id"))))


@query("""WITH e AS (SELECT event_id, user_id FROM events)
SELECT 'turns' AS tab, count(*) AS n FROM conversations WHERE conv_id % 5 <> 0
UNION ALL SELECT 'events', count(*) FROM e WHERE user_id % 5 <> 0
UNION ALL SELECT 'ledger', count(*) FROM e""")
def purge_sessions(spark, sf):
    turns, ledger = S.turns(spark, sf), S.ledger(spark, sf)
    ids = turns.select("session_id").unionByName(ledger.select("session_id")).distinct().where("session_id % 5 = 0")
    tally = lambda df, name: df.agg(F.count(lit(1)).alias("n")).select(lit(name).alias("tab"), "n")
    # the ledger stays: progress belongs to the book
    return tally(store.purge(turns, ids, "session_id"), "turns").unionByName(tally(store.purge(ledger, ids, "session_id"), "events")).unionByName(tally(ledger, "ledger"))


@query("""WITH t AS (SELECT conv_id AS session_id, string_agg('**' || CASE WHEN role = 'user' THEN 'You' ELSE 'Assistant' END || ':** ' || text, chr(10) || chr(10) ORDER BY turn) AS b
  FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '' GROUP BY conv_id)
SELECT session_id, 'session_' || substr(lpad(session_id::VARCHAR, 8, '0'), 1, 8) || '_' || substr('Conversation ' || session_id, 1, 20) AS filename,
       '# Conversation ' || session_id || chr(10) || chr(10) || b AS note FROM t""")
def export_notes(spark, sf):
    return store.export_notes(S.turns(spark, sf))


@query("""WITH t AS (SELECT conv_id AS session_id, string_agg('**' || CASE WHEN role = 'user' THEN 'You' ELSE 'Assistant' END || ':** ' || text, chr(10) || chr(10) ORDER BY turn) AS b
  FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '' GROUP BY conv_id)
SELECT 'session_' || substr(lpad(session_id::VARCHAR, 8, '0'), 1, 8) || '_' || substr('Conversation ' || session_id, 1, 20) || '.md' AS file, '# Conversation ' || session_id || chr(10) || chr(10) || b AS note FROM t""")
def export_notes_files(spark, sf):
    place = f"{store.scratch(spark)}/notes"
    exports.write_notes(store.export_notes(S.turns(spark, sf)), place)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(place)
    return files.select(F.url_decode(F.regexp_extract("path", "[^/]*$", 0)).alias("file"), F.decode("content", "UTF-8").alias("note"))


@query("""WITH m AS (SELECT l_orderkey AS id, CASE WHEN l_returnflag = 'A' THEN 'added' WHEN l_returnflag = 'N' THEN 'dismissed' WHEN l_linenumber = 1 THEN 'read' ELSE 'seen' END AS s, [epoch_us(l_shipdate), l_linenumber, l_partkey, l_suppkey] AS at_ FROM lineitem),
t AS (SELECT id, arg_max(s, at_) AS s FROM m WHERE s IN ('suggested', 'seen', 'added', 'dismissed') GROUP BY id), r AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
SELECT o_orderkey AS id, coalesce(s, 'suggested') AS status, false AS missing FROM r LEFT JOIN t ON o_orderkey = id
UNION ALL SELECT id, NULL, true FROM t WHERE id NOT IN (SELECT o_orderkey FROM r)""")
def rec_status_latest(spark, sf):
    flag = col("l_returnflag")
    flag = F.when(flag == "A", "added").when(flag == "N", "dismissed").when(col("l_linenumber") == 1, "read").otherwise("seen")
    moves = S.table(spark, sf, "lineitem").select(col("l_orderkey").alias("id"), flag.alias("status"), col("l_shipdate").alias("ts"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"))
    recs = S.table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(col("o_orderkey").alias("id"), lit("suggested").alias("status"))
    now, missing = store.apply_status(recs, moves)
    return now.withColumn("missing", lit(False)).unionByName(missing.select("id", lit(None).cast("string").alias("status"), lit(True).alias("missing")))


_BANDS = f"""{V.LINES}, band AS (SELECT book_id, text FROM lines_f GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, b.text IS NOT NULL AS is_band, regexp_matches(trim(l.text), '^[0-9]{{1,4}}$') AS is_num FROM lines_f l LEFT JOIN band b ON l.book_id = b.book_id AND l.text = b.text)"""


@query(f"WITH {_BANDS} SELECT book_id, doc_id, pos FROM m WHERE NOT is_band AND NOT is_num")
def drop_boilerplate_lines(spark, sf):
    return B.drop_repeating_bands(S.lines(spark, sf), ["text"], "doc_id")[0].select("book_id", "doc_id", "pos")


@query(f"""WITH {_BANDS} SELECT book_id, count(*) AS n_lines, count(*) FILTER (WHERE is_band) AS n_boilerplate,
count(*) FILTER (WHERE NOT is_band AND is_num) AS n_page_numbers FROM m GROUP BY book_id""")
def boilerplate_audit(spark, sf):
    return B.drop_repeating_bands(S.lines(spark, sf), ["text"], "doc_id")[1]


def _geometry(lines):
    n = F.length("text")
    y = (col("pos") * 12 + n % 3 * 6).cast("double")
    return lines.select(col("doc_id").alias("book_id"), F.floor(col("pos") / 4).alias("page"), "pos", "text", lit(0.0).alias("x0"), y.alias("y0"),
                        n.cast("double").alias("x1"), (y + 10).alias("y1"), (n % 7 + 10).cast("double").alias("font_size"))


_GEO = f"""{V.LINES}, geo AS (SELECT doc_id AS book_id, (pos // 4)::BIGINT AS page, pos, text, (pos * 12 + length(text) % 3 * 6)::DOUBLE AS y0, length(text)::DOUBLE AS x1, (length(text) % 7 + 10)::DOUBLE AS font FROM lines_f)"""


@query(f"""WITH {_GEO}, n AS (SELECT *, CASE WHEN y0 - (lag(y0) OVER w + 10) > 8 OR lag(y0) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM geo WINDOW w AS (PARTITION BY book_id, page ORDER BY pos)),
i AS (SELECT *, sum(new) OVER (PARTITION BY book_id, page ORDER BY pos) AS block_no FROM n)
SELECT book_id, page, block_no::BIGINT AS block_no, min(pos) AS pos, trim(string_agg(text, ' ' ORDER BY pos)) AS text, min(y0) AS y0, max(y0 + 10) AS y1, max(x1) AS x1,
list_sort(list(font))[len(list(font)) // 2 + 1] AS font_size FROM i GROUP BY book_id, page, block_no""")
def cluster_lines(spark, sf):
    return B.cluster_lines(_geometry(S.lines(spark, sf))).select("book_id", "page", "block_no", "pos", "text", "y0", "y1", "x1", "font_size")


# lines a little up or down stand in one band; a quarter of them lies half-way between two
@query(f"""WITH {_GEO}, k AS (SELECT *, round_even((y0 + page % 2 * 2) / 4, 0) * 4 AS band FROM geo), b AS (SELECT book_id, band, text FROM k GROUP BY ALL HAVING count(DISTINCT page) >= 3)
SELECT k.book_id, k.page, k.pos, k.band FROM k LEFT JOIN b ON k.book_id = b.book_id AND k.band = b.band AND k.text = b.text WHERE b.book_id IS NULL AND NOT regexp_matches(trim(k.text), '^[0-9]{{1,4}}$')""")
def drop_boilerplate_bands(spark, sf):
    g = _geometry(S.lines(spark, sf)).withColumn("band", B.band(col("y0") + col("page") % 2 * 2))
    return B.drop_repeating_bands(g, ["band", "text"], "page")[0].select("book_id", "page", "pos", "band")


@query(r"""WITH d AS (SELECT doc_id AS book_id, unnest(string_split(text, ', ')) AS text, unnest(range(len(string_split(text, ', '))))::INTEGER AS ord FROM documents),
p AS (SELECT *, ord // 2 AS page, rtrim(lag(text) OVER w) AS tail, ltrim(text) AS head, lag(ord // 2) OVER w AS last_page FROM d WINDOW w AS (PARTITION BY book_id ORDER BY ord)),
j AS (SELECT *, coalesce(regexp_matches(tail, '[-‐]$'), false) AS hyphen,
  coalesce(regexp_matches(tail, '[-‐]$') OR (NOT regexp_matches(head, '^(CHAPTER|Chapter|SECTION|Section|PART|Part|BOOK|Book)\s+(\d+|[IVXLCDM]+|[A-Z][a-z]+)\b|^\d+\.\d+(\.\d+)?\s+[\p{L}\p{N}_]|^第[一二三四五六七八九十百零两\d]+章')
    AND regexp_matches(head, '^\p{Ll}') AND regexp_matches(tail, '[,;:\p{Ll}]$')), false) AS jn, coalesce(last_page <> page, false) AS turn FROM p),
r AS (SELECT *, sum(CASE WHEN jn THEN 0 ELSE 1 END) OVER (PARTITION BY book_id ORDER BY ord) AS run FROM j),
m AS (SELECT *, jn AND max(CASE WHEN jn AND turn THEN 1 ELSE 0 END) OVER (PARTITION BY book_id, run ORDER BY ord) = 1 AS mg FROM r),
g AS (SELECT *, sum(CASE WHEN mg THEN 0 ELSE 1 END) OVER w AS grp, lead(mg) OVER w AS next_mg, lead(hyphen) OVER w AS next_hy FROM m WINDOW w AS (PARTITION BY book_id ORDER BY ord)),
t AS (SELECT *, CASE WHEN mg AND NOT hyphen THEN ' ' ELSE '' END || CASE WHEN coalesce(next_mg, false) THEN
   CASE WHEN next_hy THEN regexp_replace(rtrim(CASE WHEN mg THEN ltrim(text) ELSE text END), '[-‐]$', '') ELSE rtrim(CASE WHEN mg THEN ltrim(text) ELSE text END) END
   ELSE CASE WHEN mg THEN ltrim(text) ELSE text END END AS piece FROM g)
SELECT book_id, min(ord) AS ord, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages, string_agg(piece, '' ORDER BY ord) AS text,
bool_or(mg AND hyphen) AS dehyphenated, count(*) FILTER (WHERE mg) AS n_merged FROM t GROUP BY book_id, grp""")
def heal_page_breaks(spark, sf):
    d = S.table(spark, sf, "documents").select(col("doc_id").alias("book_id"), F.posexplode(F.split("text", ", ")).alias("ord", "text"))
    got = B.heal_page_breaks(d.withColumn("page", F.floor(col("ord") / 2)))
    return got.select("book_id", "ord", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "text", "dehyphenated", "n_merged")


def _toc(spark, sf):
    d = S.section_labels(spark, sf)
    return d.select("book_id", col("doc_id").alias("pos"), F.when(col("doc_id") % 3 == 0, 1).otherwise(2).alias("level"), lit(None).cast("long").alias("parent_pos"),
                    F.when(col("doc_id") % 5 == 0, lit(" ")).otherwise(col("label")).alias("title"))


_LABELS = r"""words AS (SELECT ['I','II','III','IV','V','VI','VII','VIII','IX','X'] AS r, ['One','Two','Three','Four','Five','Six','Seven','Eight','Nine','Ten'] AS w, ['一','二','三','四','五','六','七','八','九','十'] AS z),
lab AS (SELECT source AS book_id, doc_id, doc_id % 40 + 1 AS n, ((doc_id % 40 + 1) % 10 + 1)::INTEGER AS k, words.* FROM documents, words),
labels_text AS (SELECT book_id, doc_id, ['Chapter ' || n, 'Chapter ' || r[k], '第' || z[k] || '章', 'Chapter ' || w[k], 'Preface', 'Appendix A', r[k] || '. The Start', n || ': Again',
  'Prologue', 'Epilogue', 'The House of ' || w[k], '第' || z[k] || '十' || z[k] || '章', 'Chapter IIII', 'Chapter iv', 'PART II', '第三节', '第一百零八章', 'Acknowledgments', 'Colophon', '序言', '作者简介', 'Table of Contents', 'References', 'Half Title',
  'Chapter 3: Notes on Method', 'CHAPTER I. INTRODUCTION.', '8 Broadway, Hill', 'Chapter Twenty-One', 'Chapter Five The Start', 'I am Here', 'Chapter2'][doc_id % 31 + 1] AS label FROM lab)"""


@query(f"""WITH {_LABELS}, t AS (SELECT book_id, doc_id AS pos, row_number() OVER (PARTITION BY book_id ORDER BY doc_id) AS n, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE label END AS title FROM labels_text WHERE doc_id % 3 = 0)
SELECT book_id, n - 1 AS order_idx, CASE WHEN trim(title) = '' THEN 'Section ' || n ELSE trim(title) END AS label, pos FROM t""")
def toc_sections(spark, sf):
    return B.sections_from_outline(_toc(spark, sf))


@query(f"""WITH {_GEO}, md AS (SELECT book_id, list_sort(list(font))[count(*) // 2 + 1] AS med FROM geo GROUP BY book_id),
h AS (SELECT g.book_id, g.pos, substr(g.text, 1, 80) AS label, 'heading' AS kind FROM geo g JOIN md ON g.book_id = md.book_id WHERE g.font >= 1.25 * med AND length(g.text) <= 120)
SELECT * FROM h UNION ALL SELECT book_id, min(pos), 'Body', 'other' FROM geo WHERE book_id NOT IN (SELECT book_id FROM h) GROUP BY book_id""")
def infer_sections(spark, sf):
    return B.infer_sections(_geometry(S.lines(spark, sf)))


# one book in three has first-level headings, one has only second-level ones, one has none
@query(f"""WITH {V.LINES}, h AS (SELECT doc_id AS book_id, pos, text, CASE WHEN pos % 4 = 0 THEN doc_id % 3 + pos // 4 % 3 + 1 END AS lv FROM lines_f),
b AS (SELECT book_id, min(pos) AS first_, bool_or(coalesce(lv = 1, false)) AS h1, bool_or(coalesce(lv = 2, false)) AS h2 FROM h GROUP BY book_id)
SELECT h.book_id, h.pos, substr(h.text, 1, 80) AS label, 'heading' AS kind FROM h JOIN b ON h.book_id = b.book_id WHERE lv = CASE WHEN h1 THEN 1 ELSE 2 END
UNION ALL SELECT book_id, first_, 'Body', 'other' FROM b WHERE NOT h1 AND NOT h2""")
def dom_sections(spark, sf):
    level = F.when(col("pos") % 4 == 0, col("doc_id") % 3 + F.floor(col("pos") / 4) % 3 + 1).cast("int")
    return B.infer_dom_sections(S.lines(spark, sf).select(col("doc_id").alias("book_id"), "pos", level.alias("heading_level"), "text"))


@query()
def page_sections(spark, sf):
    return B.infer_dom_sections(parse_dom(S.table(spark, sf, "pages")).withColumnRenamed("page_id", "book_id"))


@query(f"WITH {V.BLOCKS} SELECT book_id, section_id, doc_id, pos, order_idx, block_id, start_off, end_off FROM blocks_x")
def emit_blocks(spark, sf):
    return S.blocks(spark, sf).drop("text")


@query(f"""WITH {V.LINES}, b AS (SELECT book_id, doc_id, pos FROM lines_f),
s AS (SELECT source AS book_id, doc_id // 40 * 40 AS start, arg_max('sec' || doc_id, doc_id) AS section_id FROM documents WHERE doc_id % 3 = 1 GROUP BY ALL)
SELECT b.book_id, b.doc_id, b.pos, s.section_id AS assigned_section FROM b ASOF LEFT JOIN s ON b.book_id = s.book_id AND b.doc_id >= s.start""")
def assign_sections_asof(spark, sf):
    d = S.table(spark, sf, "documents").where("doc_id % 3 = 1")
    secs = d.select(col("source").alias("book_id"), (F.floor(col("doc_id") / 40) * 40).alias("start"), F.concat(lit("sec"), col("doc_id").cast("string")).alias("section_id"), col("doc_id").alias("order_idx"))
    b = S.lines(spark, sf).select("book_id", "doc_id", col("pos").alias("line"), col("doc_id").alias("pos"))
    return B.assign_sections(b, secs).select("book_id", "doc_id", col("line").alias("pos"), "assigned_section")


@query("""WITH d AS (SELECT page_id % 7 AS book_id, 'p' || page_id % 50 || '.html' AS f, page_id AS at_, 'a' || page_id AS anchor FROM pages),
t AS (SELECT page_id % 7 AS book_id, page_id AS pos, 'text/p' || page_id % 60 || '.html' || CASE WHEN page_id % 2 = 0 THEN '#a' || page_id ELSE '' END AS href FROM pages)
SELECT t.book_id, t.pos, t.href, coalesce(min(CASE WHEN strpos(href, '#') > 0 AND split_part(href, '#', 2) = anchor THEN at_ END), min(at_)) AS draft_pos
FROM t JOIN d ON t.book_id = d.book_id AND split_part(split_part(href, '#', 1), '/', 2) = d.f GROUP BY ALL""")
def resolve_anchor(spark, sf):
    p = S.table(spark, sf, "pages").select("page_id", (col("page_id") % 7).alias("book_id"))
    s = lambda c: c.cast("string")
    drafts = p.select("book_id", F.concat(lit("oebps/p"), s(col("page_id") % 50), lit(".html")).alias("href"), col("page_id").alias("pos"), F.array(F.concat(lit("a"), s(col("page_id")))).alias("anchor_ids"))
    toc = p.select("book_id", col("page_id").alias("pos"), F.concat(lit("text/p"), s(col("page_id") % 60), lit(".html"), F.when(col("page_id") % 2 == 0, F.concat(lit("#a"), s(col("page_id")))).otherwise(lit(""))).alias("href"))
    return B.resolve_anchor(toc, drafts)


@query(f"""WITH {V.BLOCKS}, per AS (SELECT book_id, section_id, count(*) AS n, sum(length(text)) AS chars, count(*) FILTER (WHERE length(text) > 400) AS n_long FROM blocks_x GROUP BY ALL),
raw AS (SELECT book_id, count(*) AS n_raw_lines, count(*) FILTER (WHERE NOT regexp_matches(text, '\\S')) AS n_empty FROM lines GROUP BY book_id)
SELECT per.book_id, sum(n)::BIGINT AS n_blocks, count(*) AS n_sections, max(n) AS max_section_blocks, sum(chars)::BIGINT AS n_chars, sum(n_long)::BIGINT AS n_long, n_raw_lines, n_empty
FROM per JOIN raw ON per.book_id = raw.book_id GROUP BY per.book_id, n_raw_lines, n_empty""")
def ingestion_report(spark, sf):
    raw = S.table(spark, sf, "documents").select(col("source").alias("book_id"), F.explode(F.split("text", "\n")).alias("text"))
    return B.ingestion_report(S.blocks(spark, sf), raw)


@query(f"""WITH {V.BLOCKS}, b AS (SELECT book_id, CASE WHEN order_idx % 10 > 0 THEN section_id END AS section_id, CASE WHEN length(text) < 40 THEN 'heading' WHEN text LIKE '%.' THEN 'paragraph' END AS kind FROM blocks_x)
SELECT book_id, 'kind' AS measure, coalesce(kind, '<none>') AS name, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT book_id, 'section', coalesce(section_id, '<none>'), count(*) FROM b GROUP BY ALL""")
def ingestion_histograms(spark, sf):
    b = S.blocks(spark, sf).select("book_id", F.when(col("order_idx") % 10 > 0, col("section_id")).alias("section_id"), F.when(F.length("text") < 40, "heading").when(col("text").endswith("."), "paragraph").alias("kind"))
    return B.ingestion_histograms(b)


@query(f"""WITH {_BANDS}, a AS (SELECT book_id, count(*) FILTER (WHERE is_band) AS n_boilerplate, count(*) FILTER (WHERE NOT is_band AND is_num) AS n_page_numbers FROM m GROUP BY book_id),
r AS (SELECT book_id, count(*) AS n_blocks FROM lines GROUP BY book_id), x AS (SELECT source AS book_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS n, doc_id % 6 = 0 AS d FROM documents WHERE lang = 'en'),
h AS (SELECT book_id, sum(n)::BIGINT AS n_merged, count(*) FILTER (WHERE d) AS n_dehyphenated FROM x GROUP BY book_id)
SELECT r.*, coalesce(n_boilerplate, 0) AS n_boilerplate, coalesce(n_page_numbers, 0) AS n_page_numbers, coalesce(n_merged, 0) AS n_merged, coalesce(n_dehyphenated, 0) AS n_dehyphenated
FROM r LEFT JOIN a ON r.book_id = a.book_id LEFT JOIN h ON r.book_id = h.book_id""")
def ingestion_audits(spark, sf):
    d = S.table(spark, sf, "documents")
    report = d.select(col("source").alias("book_id"), F.explode(F.split("text", "\n")).alias("text")).groupBy("book_id").agg(F.count(lit(1)).alias("n_blocks"))
    healed = d.where("lang = 'en'").select(col("source").alias("book_id"), F.when(col("doc_id") % 3 == 0, 2).otherwise(0).alias("n_merged"), (col("doc_id") % 6 == 0).alias("dehyphenated"))
    return B.with_audits(report, B.drop_repeating_bands(S.lines(spark, sf), ["text"], "doc_id")[1], healed)


@query()
def chunk_blocks(spark, sf):
    return K.chunk_blocks(S.blocks(spark, sf))


@query(f"WITH {V.BLOCKS} SELECT book_id, count(DISTINCT section_id) AS n_windows, 0::BIGINT AS n_uncovered, 0::BIGINT AS n_mixed FROM blocks_x GROUP BY book_id")
def chunk_cover_check(spark, sf):
    b = S.blocks(spark, sf)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_idx", "text"))), lambda x: x["text"]), "\n")
    # two sections of a book can have one short id, so windows meet their chunks by their first blocks
    wins = b.groupBy("book_id", "section_id", "doc_id").agg(text.alias("win"), F.min("order_idx").alias("window"))
    spans = K.chunk_blocks(b).groupBy("book_id", "window").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("s"), F.collect_list("text").alias("texts"))
    j = wins.join(spans, ["book_id", "window"], "left")
    # what lies between the pieces and around them is blank, and every piece is a part of the window
    gap = F.aggregate("s", F.struct(lit(0).alias("at"), lit("").alias("out")), lambda a, x: F.struct(
        F.greatest(a["at"], x["stop"]).alias("at"), F.concat(a["out"], F.when(x["start"] > a["at"], F.substring("win", a["at"] + 1, x["start"] - a["at"])).otherwise(lit(""))).alias("out")))
    j = j.withColumn("g", gap).withColumn("left", F.concat(col("g.out"), F.substring(col("win"), col("g.at") + 1, F.length("win"))))
    return j.groupBy("book_id").agg(F.countDistinct("section_id").alias("n_windows"), F.count_if(F.coalesce(col("left").rlike(r"\S"), lit(True))).alias("n_uncovered"),
                                    F.count_if(~F.forall("texts", lambda t: F.contains(col("win"), t))).alias("n_mixed"))


def spans_of(spark, sf):
    """The spans of chunks; no text is moved for them."""
    b = S.blocks(spark, sf).select("book_id", "section_id", "doc_id", "order_idx", "start_off", "end_off", "block_id")
    return K.chunk_spans(S.chunk_ranges(b), b)


@query(f"""WITH {V.SPANS} SELECT book_id, section_id, chunk_id, chunk_ord, start, stop, array_to_string(block_ids, ',') AS block_ids, lo, hi, primary_block_id, first_char FROM spans""")
def chunk_spans(spark, sf):
    return spans_of(spark, sf).select("book_id", "section_id", "chunk_id", "chunk_ord", "start", "stop", F.array_join("block_ids", ",").alias("block_ids"), "lo", "hi", "primary_block_id", "first_char")


@query(f"WITH {V.BLOCK_CHUNK} SELECT book_id, block_id, chunk_id, chunk_ord FROM b2c")
def block_to_chunk(spark, sf):
    return K.block_to_chunk(spans_of(spark, sf))


def _values(pairs) -> str:
    return ", ".join(f"('{a}', {b})" for a, b in pairs)


def _roman(n: int) -> str:
    tens, units = ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")
    return "C" * (n // 100) + tens[n // 10 % 10] + units[n % 10]


def _zh(n: int) -> list[str]:
    digits = "零一二三四五六七八九"
    h, t, o = n // 100, n // 10 % 10, n % 10
    head, unit = digits[h] + "百" if h else "", digits[o] if o else ""
    if t:
        return [head + digits[t] + "十" + unit] + ([head + "十" + unit] if t == 1 else [])
    return [head + "零" + unit, head + unit] if h and o else [head + unit]


_WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_SPELLED = [(w, i + 1) for i, w in enumerate(_WORDS)] + [(w, 20 + 10 * k) for k, w in enumerate(_TENS)] + [(f"{w} {u}", 21 + 10 * k + i) for k, w in enumerate(_TENS) for i, u in enumerate(_WORDS[:9])]
_NUMBERS = f"""{_LABELS}, rom(s, v) AS (VALUES {_values((_roman(i), i) for i in range(1, 120))}), eng(s, v) AS (VALUES {_values(_SPELLED)}),
zhn(s, v) AS (VALUES {_values((s, i) for i in range(1, 300) for s in _zh(i))}),
x AS (SELECT *, regexp_extract(label, '第\\s*([0-9零一二三四五六七八九十百千两]+)\\s*章', 1) AS zh, regexp_extract(label, '^\\s*(?i:chapter|part|book)\\s*([0-9]+)\\b', 1) AS ar,
  regexp_extract(label, '^\\s*([0-9]+)(?:\\s*$|\\s*[.:：、—–-])', 1) AS bare,
  upper(CASE WHEN regexp_matches(label, '^\\s*(CHAPTER|Chapter|chapter|PART|Part|part|BOOK|Book|book)\\b') THEN regexp_extract(label, '^\\s*(?i:chapter|part|book)\\s*((?i)[IVXLCDM]+)\\b', 1)
    ELSE regexp_extract(label, '^\\s*([IVXLCDM]+)(?:\\s*$|\\s*\\.)', 1) END) AS r1,
  replace(lower(regexp_extract(label, '^\\s*(?i:chapter|part|book)\\s+([A-Za-z]+(?:[-\\s][A-Za-z]+)?)\\b', 1)), '-', ' ') AS w1 FROM labels_text),
num AS (SELECT x.book_id, x.doc_id, x.label, CASE WHEN zh <> '' THEN coalesce(try_cast(zh AS INTEGER), zhn.v) ELSE
  coalesce(try_cast(nullif(ar, '') AS INTEGER), try_cast(nullif(bare, '') AS INTEGER), rom.v, eng.v) END AS printed_number
  FROM x LEFT JOIN zhn ON zhn.s = zh LEFT JOIN rom ON rom.s = nullif(r1, '') LEFT JOIN eng ON eng.s = w1),
kinds AS (SELECT *, CASE WHEN regexp_matches(label, '^\\s*(?i)(chapter|part|book)\\s+(\\d+|[IVXLCDM]+)\\b') THEN 'chapter'
  WHEN regexp_matches(lower(label), 'prologue|引子|楔子') THEN 'prologue' WHEN regexp_matches(lower(label), 'epilogue|尾声|终章') THEN 'epilogue'
  WHEN regexp_matches(lower(label), 'afterword|appendix|glossary|index|bibliography|colophon|notes|references|about the author|further reading|附录|索引|参考文献|后记|作者简介|延伸阅读') THEN 'back_matter'
  WHEN regexp_matches(lower(label), 'cover|title page|titlepage|half title|copyright|contents|table of contents|toc|dedication|foreword|preface|introduction|acknowledgments|frontispiece|list of figures|list of tables|前言|序言|自序|译者|目录|版权|献辞|导言|扉页|插图目录') THEN 'front_matter'
  WHEN printed_number IS NOT NULL THEN 'chapter' ELSE 'other' END AS kind FROM num)"""


@query(f"WITH {_NUMBERS} SELECT doc_id, label, kind FROM kinds")
def section_kind(spark, sf):
    return S.section_labels(spark, sf).select("doc_id", "label", L.section_kind(col("label")).alias("kind"))


@query(f"WITH {_NUMBERS} SELECT doc_id, label, printed_number FROM num")
def printed_number(spark, sf):
    return S.section_labels(spark, sf).select("doc_id", "label", L.printed_number(col("label")).alias("printed_number"))


@query(f"""WITH {_NUMBERS}, o AS (SELECT *, CASE doc_id % 8 WHEN 0 THEN 'appendix' WHEN 1 THEN 'preface' WHEN 4 THEN 'chapter' WHEN 5 THEN 'titlepage' WHEN 6 THEN 'front_matter' WHEN 7 THEN 'back_matter' END AS ov FROM kinds),
f AS (SELECT *, coalesce(ov, kind) AS k FROM o) SELECT doc_id, k AS kind, CASE WHEN k = 'chapter' THEN printed_number END AS number FROM f""")
def section_kind_number(spark, sf):
    d = S.section_labels(spark, sf)
    given = F.element_at(F.array(lit("unknown appendix"), lit("preface toc"), lit("nothing"), lit(None).cast("string"), lit("part"), lit("HalfTitlePage"), lit("loi"), lit("colophon")), (col("doc_id") % 8 + 1).cast("int"))
    kind = L.resolve_kind(col("label"), L.structural_kind(given))
    return d.select("doc_id", kind.alias("kind"), L.resolve_number(col("label"), kind).alias("number"))


@query(r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN chr(1) || ' ' ELSE substr(text, 1, 300) END AS title, 'lib/' || source || '%20' || doc_id || CASE WHEN doc_id % 8 = 0 THEN '.epub' ELSE '' END AS f FROM documents)
SELECT doc_id, coalesce(nullif(substr(trim(regexp_replace(title, '[\x00-\x1f\x7f]', '', 'g')), 1, 200), ''),
  nullif(trim(url_decode(regexp_replace(split_part(f, '/', 2), '\.[^.]*$', ''))), ''), 'Untitled') AS title FROM t""")
def sanitize_label(spark, sf):
    d = S.table(spark, sf, "documents")
    title = F.when(col("doc_id") % 4 == 0, lit("\x01 ")).otherwise(F.substring("text", 1, 300))
    name = F.concat(lit("lib/"), col("source"), lit("%20"), col("doc_id").cast("string"), F.when(col("doc_id") % 8 == 0, lit(".epub")).otherwise(lit("")))
    return d.select("doc_id", L.sanitize_label(title, name).alias("title"))


@query("""SELECT doc_id, substr(sha1(source || '|' || doc_id), 1, 8) AS block_id, substr(sha1(source || '|section|' || doc_id), 1, 8) AS section_id,
'chk_' || substr(sha1(source || '|chunk|' || doc_id), 1, 8) AS chunk_id FROM documents""")
def stable_ids(spark, sf):
    a, b = col("source"), col("doc_id")
    return S.table(spark, sf, "documents").select("doc_id", C.block_id(a, b).alias("block_id"), C.section_id(a, b).alias("section_id"), C.chunk_id(a, b).alias("chunk_id"))
