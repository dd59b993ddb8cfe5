"""Queries over facts, quotes and citations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codexloom.operators import attribution as A
from codexloom.operators import chunks as K
from codexloom.plans import corpus_queries as Q
from codexloom.plans import sqlviews as V
from codexloom.plans.base import query
from codexloom.sources import corpus as S

col, lit = F.col, F.lit


def _pick(templates, n):
    return F.element_at(F.array(*map(lit, templates)), (n % len(templates) + 1).cast("int"))


def _sql_pick(templates, n):
    quoted = ", ".join("'" + t.replace("'", "''") + "'" for t in templates)
    return f"([{quoted}])[{n} % {len(templates)} + 1]"


def _answers(spark, sf):
    t = S.turns(spark, sf).where("role = 'assistant'")
    text = F.concat(lit("<fact>"), F.replace("content", lit("\n"), lit("</fact>\n<FACT>")), lit("</fact>"))
    return t.select((col("session_id") * 1000 + col("turn")).alias("key"), text.alias("text"))


_ANSWERS = "ans AS (SELECT conv_id * 1000 + turn AS key, '<fact>' || replace(text, chr(10), '</fact>' || chr(10) || '<FACT>') || '</fact>' AS text FROM conversations WHERE role = 'assistant')"


@query(f"""WITH {_ANSWERS}, f AS (SELECT key, unnest(regexp_extract_all(text, '(?is)<fact>(.*?)</fact>', 1)) AS t, unnest(range(len(regexp_extract_all(text, '(?is)<fact>(.*?)</fact>', 1)))) + 1 AS fact_no FROM ans)
SELECT key, fact_no, 'f' || fact_no AS fact_id, trim(t) AS text FROM f""")
def extract_facts(spark, sf):
    return A.extract_facts(_answers(spark, sf), "key").withColumn("fact_no", col("fact_no").cast("long"))


_MAPPINGS = ['{"mappings": [{"fact": 1, "passages": [2, 1, 2, 3]}, {"fact": 2, "passages": []}]}', "not json", '{"mappings": [{"fact": 1, "passages": [99, true, "2", 3]}, {"fact": 1, "passages": [4, 0, -1]}]}',
             '{"mappings": [{"fact": 2, "passages": [5, 6]}, {"fact": 3, "passages": 7}]}', '{"other": 1}']


@query(f"""WITH {_ANSWERS}, n AS (SELECT key, unnest(range(len(regexp_extract_all(text, '(?is)<fact>(.*?)</fact>', 1)))) + 1 AS fact_no FROM ans),
r AS (SELECT key, {_sql_pick(_MAPPINGS, 'key')} AS resp FROM ans), v AS (SELECT key, resp::JSON AS j FROM r WHERE json_valid(resp)),
e AS (SELECT key, unnest(json_extract(j, '$.mappings')::JSON[]) AS m, unnest(range(len(json_extract(j, '$.mappings')::JSON[]))) AS i FROM v WHERE json_extract(j, '$.mappings') IS NOT NULL),
l AS (SELECT key, (m->>'$.fact')::BIGINT AS fact_no, arg_max(m->'$.passages', i) AS p FROM e WHERE json_type(m->'$.passages') = 'ARRAY' GROUP BY ALL),
x AS (SELECT key, fact_no, unnest(p::JSON[]) AS q, unnest(range(len(p::JSON[]))) AS i FROM l),
o AS (SELECT key, fact_no, (q::VARCHAR)::INTEGER AS q, min(i) AS i FROM x WHERE json_type(q) IN ('UBIGINT', 'BIGINT') AND (q::VARCHAR)::INTEGER BETWEEN 1 AND 5 GROUP BY ALL),
k AS (SELECT key, fact_no, list(q ORDER BY i)[1:2] AS picks FROM o GROUP BY ALL)
SELECT n.key, n.fact_no, coalesce(array_to_string(picks, ','), '') AS picks FROM n LEFT JOIN k ON n.key = k.key AND n.fact_no = k.fact_no""")
def apply_mapping(spark, sf):
    a = _answers(spark, sf)
    facts = A.extract_facts(a, "key").select("key", "fact_no")
    got = A.apply_mapping(facts, a.select("key", lit(5).alias("n"), _pick(_MAPPINGS, col("key")).alias("response")))
    return got.select("key", col("fact_no").cast("long").alias("fact_no"), F.array_join(F.transform("picks", lambda p: p.cast("string")), ",").alias("picks"))


_SQUEEZE = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
_SPANS = (r"list_filter(list_transform(regexp_extract_all({}, '[" + '"' + r"“”]([^" + '"' + r"“”]{{4,}})[" + '"' + r"“”]', 1), lambda q: regexp_replace(" + _SQUEEZE.format("q")
          + r", '^[\s\p{{P}}]+|[\s\p{{P}}]+$', '', 'g')), lambda q: length(q) >= 4)").replace("lower({}", "lower({}")


def _said():
    return F.concat(lit('He said "'), F.col("text"), lit('" and “'), F.translate(F.col("text"), "aeiou", "AEIOU"), lit('” or "ab" or "-- x"'))


_SAID = "'He said \"' || text || '\" and “' || translate(text, 'aeiou', 'AEIOU') || '” or \"ab\" or \"-- x\"'"


@query(f"SELECT item_id AS query_id, array_to_string({_SPANS.format(_SAID)}, '|') AS spans FROM benchmark")
def quote_spans(spark, sf):
    return S.passages(spark, sf).select("query_id", F.array_join(A.quote_spans(_said()), "|").alias("spans"))


@query(rf"""WITH f AS (SELECT item_id AS key, 1 AS fact_no, CASE WHEN item_id % 3 = 0 THEN [] ELSE [array_to_string(string_split({_SQUEEZE.format('text')}, ' ')[2:2], ' ') || ' '] END AS quotes, [2, 5] AS picks FROM benchmark),
p AS (SELECT item_id AS key, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS no, doc_id % 2 AS lv, {_SQUEEZE.format('d.text')} AS t FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id % 40),
h AS (SELECT f.key, f.picks, p.no, p.lv, coalesce(list_position(f.picks, p.no::INTEGER), 0) AS at_ FROM f JOIN p ON f.key = p.key WHERE len(f.quotes) > 0 AND contains(p.t, f.quotes[1])),
g AS (SELECT key, CASE WHEN count(*) FILTER (WHERE at_ > 0) > 0 THEN list(no ORDER BY at_) FILTER (WHERE at_ > 0) ELSE list(no ORDER BY lv, no) END[1:2] AS fin FROM h GROUP BY key)
SELECT f.key, f.fact_no, CASE WHEN len(f.quotes) = 0 THEN array_to_string(f.picks, ',') ELSE coalesce(array_to_string(fin, ','), '') END AS picks FROM f LEFT JOIN g ON f.key = g.key""")
def quote_guard(spark, sf):
    b = S.passages(spark, sf)
    from codexloom.functions.columns import squeeze

    quote = F.concat(F.element_at(F.split(squeeze(col("text")), " "), 2), lit(" "))
    facts = b.select(col("query_id").alias("key"), lit(1).alias("fact_no"), F.when(col("query_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(quote)).alias("quotes"),
                     F.array(lit(2), lit(5)).alias("picks"))
    d = S.table(spark, sf, "documents").select("doc_id", "text", (col("doc_id") % 40).alias("m"))
    w = Window.partitionBy("key").orderBy("doc_id")
    p = b.select(col("query_id").alias("key"), (col("query_id") % 40).alias("m")).join(d, "m").select("key", F.row_number().over(w).alias("passage_no"), (col("doc_id") % 2).alias("raptor_level"), "text")
    got = A.quote_guard(facts, p)
    return got.select("key", "fact_no", F.array_join(F.transform("picks", lambda x: x.cast("string")), ",").alias("picks"))


@query(f"SELECT doc_id, item_id AS query_id FROM documents d, benchmark b WHERE contains({_SQUEEZE.format('d.text')}, {_SQUEEZE.format('b.text')})")
def quote_containment(spark, sf):
    return A.quote_containment(S.table(spark, sf, "documents"), S.passages(spark, sf))


def _turn_events(spark, sf):
    e = S.ledger(spark, sf)
    k = col("chunk_key").cast("string")
    chunk = F.when(col("value") >= 1, F.when(col("chunk_key") % 5 == 0, F.concat(lit("raptor_"), k)).otherwise(F.concat(lit("c"), k)))
    n = F.floor(col("seq") / 3)
    return e.select("session_id", n.alias("event_id"), n.alias("created"), chunk.alias("chunk_id"), col("seq").alias("rank"))


_TURN = "te AS (SELECT user_id AS session_id, event_id // 3 AS event_id, CASE WHEN value >= 1 THEN CASE WHEN k % 5 = 0 THEN 'raptor_' || k ELSE 'c' || k END END AS chunk_id, event_id AS rank FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events))"


@query(f"""WITH {_TURN}, ev AS (SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY event_id DESC) AS n FROM (SELECT DISTINCT session_id, event_id FROM te WHERE chunk_id IS NOT NULL)),
c AS (SELECT te.session_id, chunk_id, min([-n, rank]) AS at_ FROM te JOIN ev ON te.session_id = ev.session_id AND te.event_id = ev.event_id WHERE n <= 3 AND chunk_id IS NOT NULL GROUP BY ALL)
SELECT session_id, coalesce(string_agg(chunk_id, ',' ORDER BY at_) FILTER (WHERE chunk_id NOT LIKE 'raptor_%'), '') AS chunk_ids, coalesce(string_agg(chunk_id, ',' ORDER BY at_) FILTER (WHERE chunk_id LIKE 'raptor_%'), '') AS raptor_ids FROM c GROUP BY session_id""")
def turn_attribution(spark, sf):
    return A.turn_attribution(_turn_events(spark, sf)).select("session_id", F.array_join("chunk_ids", ",").alias("chunk_ids"), F.array_join("raptor_ids", ",").alias("raptor_ids"))


@query(f"""WITH {V.SPANS}, cov AS (SELECT book_id, 'raptor_l1_' || section_id AS node_id, list_sort(list(block_id)) AS c FROM blocks_x GROUP BY ALL),
n AS (SELECT book_id, chunk_id AS node_id, 0 AS lv, text, block_ids AS own, primary_block_id AS p FROM spans UNION ALL SELECT book_id, node_id, 1, 'summary', c, c[1] FROM cov),
i AS (SELECT book_id, chunk_id AS node_id FROM spans UNION ALL SELECT DISTINCT book_id, 'raptor_l1_' || section_id FROM blocks_x UNION ALL SELECT DISTINCT book_id, 'missing' FROM blocks_x)
SELECT i.book_id, i.node_id, CASE WHEN lv > 0 THEN 'raptor' WHEN lv = 0 THEN 'raw' END AS layer, coalesce(len(own), 0) AS n_blocks, p AS primary_block_id, b.section_id, substr(n.text, 1, 280) AS snippet, p IS NOT NULL AS resolved
FROM i LEFT JOIN n ON i.book_id = n.book_id AND i.node_id = n.node_id LEFT JOIN blocks_x b ON b.book_id = i.book_id AND b.block_id = p""")
def resolve_citations(spark, sf):
    b = S.blocks(spark, sf)
    spans = K.chunk_spans(S.fixed_chunks(b), b)
    top = F.concat(lit("raptor_l1_"), "section_id")
    cov = b.select("book_id", top.alias("node_id"), "block_id")
    tops = b.select("book_id", top.alias("node_id")).distinct()
    nodes = spans.select("book_id", col("chunk_id").alias("node_id"), lit(0).alias("raptor_level"), "text", "block_ids", "primary_block_id").unionByName(
        tops.select("book_id", "node_id", lit(1).alias("raptor_level"), lit("summary").alias("text"), lit(None).cast("array<string>").alias("block_ids"), lit(None).cast("string").alias("primary_block_id")))
    ids = spans.select("book_id", col("chunk_id").alias("node_id")).unionByName(tops.select("book_id", "node_id")).unionByName(
        b.select("book_id", lit("missing").alias("node_id")).distinct())
    return A.resolve_citations(ids, nodes, cov, b).withColumn("n_blocks", col("n_blocks").cast("long"))


@query()
def annotate_answers(spark, sf):
    a = _answers(spark, sf)
    facts = A.extract_facts(a, "key").select("key", "fact_no", F.when(col("fact_no") % 3 > 0, F.array(F.concat(lit("chk_"), col("fact_no").cast("string")))).otherwise(F.array().cast("array<string>")).alias("chunk_ids"))
    return A.annotate_answers(a, facts)


@query("SELECT DISTINCT user_id AS session_id, 'c' || json_extract(props, '$.k')::BIGINT AS chunk_id FROM events WHERE event_type <> 'error'")
def cited_ids(spark, sf):
    e = S.ledger(spark, sf)
    k = col("chunk_key").cast("string")
    facts = F.when(col("kind") != "error", F.array(F.struct(lit("f1").alias("fact_id"), F.array(F.concat(lit("c"), k), F.concat(lit("raptor_"), k)).alias("chunk_ids"))))
    return A.cited_ids(e.select("session_id", facts.alias("facts")))


def _repeated():
    return F.when(col("session_id") % 3 == 0, F.concat_ws(" \n", "content", "content")).otherwise(col("content"))


@query()
def clean_answers(spark, sf):
    t = S.turns(spark, sf).where("role = 'assistant'")
    text = F.concat(lit("</fact><fact>"), _repeated(), F.when(col("turn") % 4 == 1, lit("</fact>")).otherwise(lit("")))
    return A.clean_answers(t.select(F.concat_ws("-", "session_id", "turn").alias("key"), text.alias("text")))


@query(r"""WITH t AS (SELECT conv_id AS session_id, turn, CASE WHEN conv_id % 3 = 0 THEN text || ' ' || chr(10) || text ELSE text END AS x FROM conversations),
f AS (SELECT *, regexp_replace(x, '\s+', '', 'g') AS y FROM t)
SELECT session_id, turn, length(x) >= 120 AND length(y) % 2 = 0 AND substr(y, 1, length(y) // 2) = substr(y, length(y) // 2 + 1, length(y) // 2) AS doubled FROM f""")
def doubled_answers(spark, sf):
    return S.turns(spark, sf).select("session_id", "turn", A.doubled(_repeated()).alias("doubled"))


_INTENTS = ['{"kind": "search", "search_query": "who is it", "ambiguous": true, "clarify_question": "Which one?", "clarify_options": ["a", "b", "c", "d", "e"], "clarify_multi": true}',
            '{"kind": "chapter_summary", "chapter_number": 5, "search_query": null}', '{"kind": "chapter_summary", "chapter_number": "x"}', '{"kind": "export_notes"}', '{"kind": "export_notes", "export_format": "pdf"}',
            '{"kind": "overview", "memory_note": "likes whales"}', "broken", '{"kind": "book_overview", "ambiguous": true, "memory_note": " likes whales ", "memory_note_type": "odd"}',
            '{"kind": "smalltalk", "memory_note": "  ", "ambiguous": true, "clarify_question": "Eh?"}', '{"kind": "reading_progress", "memory_note": "is a nurse", "memory_note_type": "fact"}', '{"search_query": ""}']


@query(f"""WITH r AS (SELECT item_id AS key, text AS message, {_sql_pick(_INTENTS, 'item_id')} AS resp FROM benchmark), v AS (SELECT key, message, CASE WHEN json_valid(resp) THEN resp ELSE '{{}}' END::JSON AS j FROM r),
w AS (SELECT key, message, CASE WHEN coalesce(j->>'$.kind', 'search') IN ('chapter_summary', 'search', 'book_overview', 'reading_progress', 'export_notes', 'smalltalk') THEN j ELSE '{{}}'::JSON END AS j FROM v),
k AS (SELECT *, coalesce(j->>'$.kind', 'search') AS kind, nullif(j->>'$.clarify_question', '') AS q, nullif(trim(j->>'$.memory_note'), '') AS note FROM w),
u AS (SELECT *, kind IN ('search', 'book_overview') AND coalesce((j->>'$.ambiguous')::BOOLEAN, false) AND q IS NOT NULL AS ambiguous FROM k)
SELECT key, kind, CASE WHEN json_type(j->'$.chapter_number') = 'UBIGINT' THEN (j->>'$.chapter_number')::INTEGER END AS chapter_number,
CASE WHEN kind IN ('search', 'book_overview') THEN coalesce(nullif(j->>'$.search_query', ''), message) ELSE j->>'$.search_query' END AS search_query,
CASE WHEN kind = 'export_notes' THEN coalesce(nullif(j->>'$.export_format', ''), 'markdown') ELSE j->>'$.export_format' END AS export_format, ambiguous, CASE WHEN ambiguous THEN q END AS clarify_question,
CASE WHEN ambiguous THEN array_to_string((json_extract_string(j, '$.clarify_options[*]'))[1:4], ',') ELSE '' END AS clarify_options, ambiguous AND coalesce((j->>'$.clarify_multi')::BOOLEAN, false) AS clarify_multi, note AS memory_note,
CASE WHEN note IS NOT NULL THEN CASE WHEN j->>'$.memory_note_type' IN ('fact', 'interest') THEN j->>'$.memory_note_type' ELSE 'interest' END END AS memory_note_type FROM u""")
def coerce_intents(spark, sf):
    raw = S.passages(spark, sf).select(col("query_id").alias("key"), col("text").alias("message"), _pick(_INTENTS, col("query_id")).alias("response"))
    return A.coerce_intents(raw).withColumn("clarify_options", F.array_join("clarify_options", ","))


_PLANS = ['{"sub_questions": ["a?", " ", "b?", "c?", "d?", "e?"]}', '{"sub_questions": ["only one"]}', "nonsense", '{"sub_questions": [" x ", "y"]}', "{}"]


@query(f"""WITH r AS (SELECT item_id AS key, text AS message, {_sql_pick(_PLANS, 'item_id')} AS resp FROM benchmark),
v AS (SELECT key, message, CASE WHEN json_valid(resp) THEN (list_filter(list_transform(json_extract_string(resp::JSON, '$.sub_questions[*]'), lambda x: trim(x)), lambda x: x <> ''))[1:4] END AS s FROM r),
w AS (SELECT key, coalesce(len(s) >= 2, false) AS compound, CASE WHEN len(s) >= 2 THEN s ELSE [message] END AS s FROM v)
SELECT key, compound, len(s) * 3 AS est_calls, 8 + 3 * (len(s) - 1) AS est_seconds, unnest(range(len(s))) AS sub_no, unnest(s) AS sub_question FROM w""")
def coerce_plans(spark, sf):
    got = A.coerce_plans(S.passages(spark, sf).select(col("query_id").alias("key"), col("text").alias("message"), _pick(_PLANS, col("query_id")).alias("response")))
    return got.withColumns({c: col(c).cast("long") for c in ("est_calls", "est_seconds", "sub_no")})


@query("""SELECT conv_id * 1000 + turn AS key, CASE WHEN turn % 3 = 0 THEN text || chr(10) || chr(10) || 'Clarification: Which?' || chr(10) || 'Answer: That one' ELSE text END AS resolved FROM conversations WHERE role = 'user'""")
def resolved_question(spark, sf):
    t = S.turns(spark, sf).where("role = 'user'")
    return A.resolved_question(t.select((col("session_id") * 1000 + col("turn")).alias("key"), col("content").alias("message"), lit("Which?").alias("question"),
                                        F.when(col("turn") % 3 == 0, "That one").when(col("turn") % 3 == 1, " ").alias("answer")))
