"""DuckDB text of the corpus views, for the equivalent SQL of the queries."""

LINES = r"""lines AS (
  SELECT source AS book_id, doc_id, unnest(string_split(text, chr(10))) AS text,
         unnest(range(len(string_split(text, chr(10)))))::INTEGER AS pos FROM documents),
lines_f AS (SELECT * FROM lines WHERE regexp_matches(text, '\S'))"""

BLOCKS = LINES + r""",
sec_ord AS (SELECT source AS book_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS so
            FROM (SELECT DISTINCT book_id AS source, doc_id FROM lines_f)),
blocks AS (
  SELECT l.book_id, substr(sha1(l.book_id || '|section|' || so), 1, 8) AS section_id, l.doc_id, l.pos,
         row_number() OVER b - 1 AS order_idx, l.text,
         coalesce(sum(length(l.text) + 1) OVER (PARTITION BY l.book_id ORDER BY l.doc_id, l.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_off
  FROM lines_f l JOIN sec_ord s ON l.book_id = s.book_id AND l.doc_id = s.doc_id WINDOW b AS (PARTITION BY l.book_id ORDER BY l.doc_id, l.pos)),
blocks_x AS (SELECT *, substr(sha1(book_id || '|' || order_idx), 1, 8) AS block_id, start_off + length(text) AS end_off FROM blocks)"""

CHUNKS = BLOCKS + r""",
win AS (SELECT book_id, section_id, doc_id, string_agg(text, chr(10) ORDER BY order_idx) AS win, min(start_off) AS sec_start FROM blocks_x GROUP BY ALL),
pieces AS (SELECT *, unnest(range((length(win) + 799) // 800)) AS i FROM win),
chunks AS (
  SELECT book_id, section_id, doc_id, sec_start, i * 800 AS start, least(i * 800 + 800, length(win)) AS stop, substr(win, i * 800 + 1, 800) AS text,
         row_number() OVER (PARTITION BY book_id ORDER BY doc_id, i) - 1 AS chunk_ord FROM pieces),
chunks_x AS (SELECT *, 'chk_' || substr(sha1(book_id || '|chunk|' || chunk_ord), 1, 8) AS chunk_id FROM chunks)"""

SPANS = CHUNKS + r""",
bw AS (SELECT b.*, b.start_off - w.sec_start AS bs, coalesce(lead(b.start_off - w.sec_start) OVER (PARTITION BY b.book_id, b.section_id ORDER BY b.order_idx), 1000000000) AS nx
       FROM blocks_x b JOIN win w ON b.book_id = w.book_id AND b.section_id = w.section_id),
spans AS (
  SELECT c.book_id, c.section_id, c.doc_id, c.chunk_id, c.chunk_ord, c.start, c.stop, c.text,
         list(bw.block_id ORDER BY bw.order_idx) AS block_ids, min(bw.order_idx) AS lo, max(bw.order_idx) AS hi,
         max(CASE WHEN bw.bs <= (c.start + c.stop) // 2 AND (c.start + c.stop) // 2 < bw.nx THEN bw.block_id END) AS primary_block_id,
         greatest(min(CASE WHEN bw.bs <= c.start AND c.start < bw.nx THEN c.start - bw.bs END), 0) AS first_char
  FROM chunks_x c JOIN bw ON c.book_id = bw.book_id AND c.section_id = bw.section_id
   AND bw.bs <= greatest(c.start, c.stop - 1) AND bw.nx > c.start GROUP BY ALL)"""

BLOCK_CHUNK = SPANS + r""",
b2c AS (SELECT book_id, block_id, arg_min(chunk_id, chunk_ord) AS chunk_id, min(chunk_ord) AS chunk_ord FROM (
  SELECT book_id, chunk_id, chunk_ord, unnest(block_ids) AS block_id FROM spans) GROUP BY ALL)"""

_FOLD = "translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
TOKENS = "regexp_extract_all(" + _FOLD + r", '[\p{{L}}\p{{N}}]+')"

INDEX = BLOCKS + r""",
toks AS (SELECT book_id, block_id, order_idx, unnest({tok}) AS token FROM blocks_x),
postings AS (SELECT token, book_id, block_id, any_value(order_idx) AS order_idx, count(*) AS tf FROM toks GROUP BY token, book_id, block_id),
dl AS (SELECT book_id, block_id, sum(tf) AS dl FROM postings GROUP BY ALL),
stats AS (SELECT (SELECT count(*) FROM blocks_x) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM blocks_x)::DOUBLE AS avgdl),
df AS (SELECT token, count(*) AS df FROM postings GROUP BY token)""".replace("{tok}", TOKENS.format("text"))

#: A query for every clause of each benchmark passage, with all of its words.
SEARCH = INDEX + r""",
clause AS (SELECT item_id, unnest(regexp_split_to_array(text, '[.,;:!?]')) AS c, unnest(range(len(regexp_split_to_array(text, '[.,;:!?]')))) AS i FROM benchmark),
qt AS (SELECT item_id * 1000 + i AS query_id, unnest(list_distinct({tok})) AS token FROM clause),
qn AS (SELECT query_id, count(*) AS n_tokens FROM qt GROUP BY query_id),
hit AS (
  SELECT qt.query_id, p.book_id, p.block_id, p.order_idx, count(*) AS n_hit,
         sum(greatest(ln((s.n - df.df + 0.5) / (df.df + 0.5)), 1e-6) * (p.tf * 2.2) / (p.tf + 1.2 * (1 - 0.75 + 0.75 * dl.dl / s.avgdl))) AS score
  FROM qt JOIN postings p ON qt.token = p.token JOIN df ON df.token = p.token
       JOIN dl ON dl.book_id = p.book_id AND dl.block_id = p.block_id CROSS JOIN stats s GROUP BY ALL),
found AS (
  SELECT h.*, row_number() OVER (PARTITION BY h.query_id ORDER BY round(score, 6) DESC, h.book_id, h.order_idx) AS rank
  FROM hit h JOIN qn ON qn.query_id = h.query_id AND qn.n_tokens = h.n_hit),
top AS (SELECT * FROM found WHERE rank <= 8)""".replace("{tok}", TOKENS.format("c"))
