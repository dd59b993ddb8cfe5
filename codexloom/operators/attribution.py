"""Facts, their passages, quotes and citations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codexloom.functions.columns import squeeze
from codexloom.operators.substrings import contained

FACT = r"(?is)<fact>(.*?)</fact>"


def extract_facts(answers: DataFrame, *keys: str) -> DataFrame:
    """(keys, fact_no, fact_id, text) of the tagged facts of answers (keys, text)."""
    found = F.regexp_extract_all("text", F.lit(FACT), F.lit(1))
    x = answers.select(*keys, F.posexplode(found).alias("_i", "_t"))
    return x.select(*keys, (F.col("_i") + 1).alias("fact_no"), F.concat(F.lit("f"), (F.col("_i") + 1).cast("string")).alias("fact_id"), F.trim("_t").alias("text"))


def apply_mapping(facts: DataFrame, responses: DataFrame, top: int = 2) -> DataFrame:
    """facts (key, fact_no) with picks: at most ``top`` distinct passage numbers in 1..n from responses (key, n, response JSON).

    A response that does not parse, or an entry of the wrong shape, maps nothing; of several entries
    of one fact the last wins; only whole numbers count.
    """
    # as text, an array keeps its raw JSON, so that quoted numbers and booleans can be told apart
    shape = "struct<mappings: array<struct<fact: string, passages: string>>>"
    m = responses.select("key", "n", F.from_json("response", shape).alias("_r")).select("key", "n", F.posexplode("_r.mappings").alias("_i", "_m"))
    whole = lambda c: c.rlike("^-?[0-9]{1,9}$")
    m = m.where(whole(F.col("_m.fact")) & F.col("_m.passages").rlike(r"^\[.*\]$"))
    m = m.groupBy("key", "n", F.col("_m.fact").cast("int").alias("fact_no")).agg(F.max_by("_m.passages", "_i").alias("_p"))
    items = F.transform(F.split(F.regexp_replace("_p", r"^\[|\]$", ""), ","), lambda x: F.trim(x))
    numbers = F.transform(F.filter(items, whole), lambda x: x.cast("int"))
    picks = F.slice(F.array_distinct(F.filter(numbers, lambda x: (x >= 1) & (x <= F.col("n")))), 1, top)
    j = facts.join(m.select("key", "fact_no", picks.alias("_picks")), ["key", "fact_no"], "left")
    return j.select(*facts.columns, F.coalesce("_picks", F.array().cast("array<int>")).alias("picks"))


def quote_spans(text: Column) -> Column:
    """Normal forms of the quoted spans of a text: at least four characters before and after normalising."""
    raw = F.regexp_extract_all(text, F.lit("[\"“”]([^\"“”]{4,})[\"“”]"), F.lit(1))
    clean = F.transform(raw, lambda q: F.regexp_replace(squeeze(q), r"^[\s\p{P}]+|[\s\p{P}]+$", ""))
    return F.filter(clean, lambda q: F.length(q) >= 4)


def quote_guard(facts: DataFrame, passages: DataFrame, top: int = 2) -> DataFrame:
    """facts (key, fact_no, quotes, picks) with final picks, held against passages (key, passage_no, raptor_level, text).

    Facts without quotes keep their picks. Others keep the picks that contain a quote, else take the
    first passages that do, raw ones before summaries.
    """
    quoted, plain = facts.where(F.size("quotes") > 0), facts.where(F.size("quotes") == 0)
    norm = passages.select("key", "passage_no", "raptor_level", squeeze(F.col("text")).alias("_norm"))
    j = quoted.join(norm, "key").where(F.exists("quotes", lambda q: F.contains(F.col("_norm"), q)))
    at = F.array_position("picks", F.col("passage_no"))
    rank = F.struct(F.when(at > 0, at).otherwise(F.lit(0)).alias("at"), (F.col("raptor_level") > 0).alias("s"), F.col("passage_no").alias("no"))
    g = j.groupBy("key", "fact_no").agg(F.array_sort(F.collect_list(rank)).alias("_h"))
    kept = F.filter("_h", lambda x: x["at"] > 0)
    found = F.slice(F.transform(F.when(F.size(kept) > 0, kept).otherwise(F.col("_h")), lambda x: x["no"]), 1, top)
    out = quoted.join(g.select("key", "fact_no", found.alias("_f")), ["key", "fact_no"], "left").withColumn("picks", F.coalesce("_f", F.array().cast("array<int>")))
    return plain.unionByName(out.select(*plain.columns))


def quote_containment(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc_id, query_id) of documents whose normal text contains a quote's, wherever its edges lie; blank quotes are found nowhere.

    Candidates hold the quote's rarest character gram; see ``contained``.
    """
    hay = docs.select(F.col("doc_id").alias("hay_id"), squeeze(F.col("text")).alias("hay"))
    found = contained(hay, quotes.select(F.col("query_id").alias("needle_id"), squeeze(F.col("text")).alias("needle")))
    return found.select(F.col("hay_id").alias("doc_id"), F.col("needle_id").alias("query_id"))


def turn_attribution(events: DataFrame, last: int = 3) -> DataFrame:
    """Per session the union of chunk ids and summary ids over its last events that have chunks, oldest first, in order of first appearance.

    events (session_id, event_id, created, chunk_id, rank): one row per chunk of an event.
    """
    ev = events.where("chunk_id is not null").groupBy("session_id", "event_id", "created").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("session_id").orderBy(F.col("created").desc(), F.col("event_id").desc())
    ev = ev.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last).select("session_id", "event_id", (-F.col("_n")).alias("_age"))
    c = events.where("chunk_id is not null").join(ev, ["session_id", "event_id"]).groupBy("session_id", "chunk_id").agg(F.min(F.struct("_age", "rank")).alias("_at"))
    g = c.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "chunk_id"))), lambda x: x["chunk_id"]).alias("_ids"))
    return g.select("session_id", F.filter("_ids", lambda x: ~x.startswith("raptor_")).alias("chunk_ids"), F.filter("_ids", lambda x: x.startswith("raptor_")).alias("raptor_ids"))


def resolve_citations(ids: DataFrame, nodes: DataFrame, coverage: DataFrame, blocks: DataFrame, cut: int = 280) -> DataFrame:
    """Citation rows for node ids (book_id, node_id): primary block, section, snippet, layer, resolved.

    nodes (book_id, node_id, raptor_level, text, block_ids, primary_block_id). Raw nodes use their own
    blocks, summaries those they cover, the first by id as primary.
    """
    cov = coverage.groupBy("book_id", "node_id").agg(F.array_sort(F.collect_set("block_id")).alias("_cov"))
    j = ids.join(nodes, ["book_id", "node_id"], "left").join(cov, ["book_id", "node_id"], "left")
    own = F.when(F.col("raptor_level") > 0, F.col("_cov")).otherwise(F.col("block_ids"))
    primary = F.when(F.col("raptor_level") > 0, F.get("_cov", F.lit(0))).otherwise(F.coalesce("primary_block_id", F.get("block_ids", F.lit(0))))
    j = j.withColumn("n_blocks", F.coalesce(F.size(own), F.lit(0))).withColumn("n_blocks", F.greatest("n_blocks", F.lit(0))).withColumn("block_id", primary)
    j = j.join(blocks.select("book_id", "block_id", "section_id"), ["book_id", "block_id"], "left")
    return j.select("book_id", "node_id", F.when(F.col("raptor_level") > 0, "raptor").when(F.col("raptor_level") == 0, "raw").alias("layer"), "n_blocks",
                    F.col("block_id").alias("primary_block_id"), "section_id", F.substring("text", 1, cut).alias("snippet"), F.col("block_id").isNotNull().alias("resolved"))


def annotate_answers(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """answers (key, text) with each fact's tag carrying its ids from facts (key, fact_no, chunk_ids); empty lists stay empty."""
    parts = answers.select("key", F.posexplode(F.split("text", r"(?i)<fact>")).alias("i", "part"))
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), '"', "&quot;"), "<", "&lt;")
    j = parts.join(facts.select("key", F.col("fact_no").alias("i"), F.array_join("chunk_ids", ",").alias("_c")), ["key", "i"], "left")
    tag = F.when(F.col("i") == 0, "").otherwise(F.concat(F.lit('<fact id="f'), F.col("i").cast("string"), F.lit('" chunks="'), esc(F.coalesce("_c", F.lit(""))), F.lit('">')))
    return j.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.concat(tag, "part").alias("p")))), lambda x: x["p"]), "").alias("text"))


def cited_ids(events: DataFrame) -> DataFrame:
    """(session_id, chunk_id): distinct raw chunk ids of the facts of events (session_id, facts array of (fact_id, chunk_ids))."""
    f = events.select("session_id", F.explode("facts").alias("_f")).select("session_id", F.explode("_f.chunk_ids").alias("chunk_id"))
    return f.where(~F.col("chunk_id").startswith("raptor_")).distinct()


def doubled(text: Column) -> Column:
    """True where the two halves of a text of at least 120 characters are equal but for blanks."""
    flat = F.regexp_replace(text, r"\s+", "")
    half = F.floor(F.length(flat) / 2).cast("int")
    return (F.length(text) >= 120) & (F.length(flat) % 2 == 0) & (F.substring(flat, F.lit(1), half) == F.substring(flat, half + 1, half))


def clean_answer(text: str | None) -> tuple[str | None, bool, int, int]:
    """(clean text, was doubled, dropped tags, added closers)."""
    if text is None:
        return None, False, 0, 0
    import re

    was = False
    if len(text) >= 120:
        at = text.find(text[:40], int(len(text) * 0.35))
        if 0 < at <= len(text) * 0.65:
            a, b = text[:at], text[at:]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            if n >= max(80, 0.55 * min(len(a), len(b))):
                text, was = a.rstrip(), True
    out, inside, dropped = [], False, 0
    for part in re.split(r"(</?fact>)", text, flags=re.I):
        tag = part.lower()
        if tag == "<fact>":
            if inside:
                dropped += 1
                continue
            inside = True
        elif tag == "</fact>":
            if not inside:
                dropped += 1
                continue
            inside = False
        out.append(part)
    return "".join(out) + "</fact>" * inside, was, dropped, int(inside)


def clean_answers(answers: DataFrame) -> DataFrame:
    """answers (key, text) -> (key, text, was_doubled, dropped_tags, added_closers); the outer span wins."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [clean_answer(t) for t in b["text"]]
            yield pd.DataFrame({"key": b["key"], "text": [x[0] for x in got], "was_doubled": [x[1] for x in got], "dropped_tags": [x[2] for x in got], "added_closers": [x[3] for x in got]})

    return answers.select("key", "text").mapInPandas(emit, "key string, text string, was_doubled boolean, dropped_tags int, added_closers int")


# The kinds of intent and, below, the names of the response's fields.
_KINDS = ("chapter_summary", "search", "book_overview", "reading_progress", "export_notes", "smalltalk")
# Formats that notes are exported in.
_FORMATS = ("pdf", "markdown")


def coerce_intents(raw: DataFrame) -> DataFrame:
    """raw (key, message, response JSON) -> one usable intent per row: key, kind, chapter_number, search_query, export_format,
    ambiguous, clarify_question, clarify_options, clarify_multi, memory_note, memory_note_type.

    A response that is no JSON or names an unknown kind or export format counts as a failed call: a search for the message.
    """
    shape = ("struct<kind: string, chapter_number: int, search_query: string, export_format: string, ambiguous: boolean, clarify_question: string, "
             "clarify_options: array<string>, clarify_multi: boolean, memory_note: string, memory_note_type: string>")
    r = raw.select("key", "message", F.from_json("response", shape).alias("_r"))
    known = F.coalesce("_r.kind", F.lit("search")).isin(*_KINDS) & F.coalesce("_r.export_format", F.lit("pdf")).isin(*_FORMATS)
    field = lambda name: F.when(known, F.col(f"_r.{name}"))
    given = lambda c: F.nullif(c, F.lit(""))
    kind = F.coalesce(field("kind"), F.lit("search"))
    asks = kind.isin("search", "book_overview")
    question = given(field("clarify_question"))
    unclear = asks & F.coalesce(field("ambiguous"), F.lit(False)) & question.isNotNull()
    note = given(F.trim(field("memory_note")))
    options = F.when(unclear, F.slice(F.coalesce(field("clarify_options"), F.array().cast("array<string>")), 1, 4)).otherwise(F.array().cast("array<string>"))
    return r.select(
        "key", kind.alias("kind"), field("chapter_number").alias("chapter_number"),
        F.when(asks, F.coalesce(given(field("search_query")), "message")).otherwise(field("search_query")).alias("search_query"),
        F.when(kind == "export_notes", F.coalesce(given(field("export_format")), F.lit("markdown"))).otherwise(field("export_format")).alias("export_format"),
        unclear.alias("ambiguous"), F.when(unclear, question).alias("clarify_question"), options.alias("clarify_options"),
        (unclear & F.coalesce(field("clarify_multi"), F.lit(False))).alias("clarify_multi"), note.alias("memory_note"),
        F.when(note.isNotNull(), F.when(field("memory_note_type").isin("fact", "interest"), field("memory_note_type")).otherwise("interest")).alias("memory_note_type"))


def coerce_plans(raw: DataFrame, most: int = 4) -> DataFrame:
    """raw (key, message, response JSON) -> one row per sub-question (key, compound, sub_no, sub_question, est_calls, est_seconds)."""
    r = raw.withColumn("_q", F.from_json("response", "struct<sub_questions: array<string>>")["sub_questions"])
    clean = F.slice(F.filter(F.transform("_q", lambda q: F.trim(q)), lambda q: q != ""), 1, most)
    many = F.coalesce(F.size(clean) >= 2, F.lit(False))
    r = r.select("key", many.alias("compound"), F.when(many, clean).otherwise(F.array("message")).alias("_s"))
    n = F.size("_s")
    return r.select("key", "compound", (n * 3).alias("est_calls"), (n * 3 + 5).alias("est_seconds"), F.posexplode("_s").alias("sub_no", "sub_question"))


def resolved_question(turns: DataFrame) -> DataFrame:
    """turns (key, message, question, answer): the message, with the clarification appended when it was answered."""
    said = F.format_string("%s\n\nClarification: %s\nAnswer: %s", "message", "question", "answer")
    return turns.select("key", F.when(F.trim(F.coalesce("answer", F.lit(""))) != "", said).otherwise(F.col("message")).alias("resolved"))
