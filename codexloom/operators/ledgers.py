"""Ledgers, progress, sessions, recommendations, costs and request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codexloom.functions.columns import bround_pct
from codexloom.operators.substrings import all_windows, contained, hashed
from codexloom.sources.store import stage


def record_ledger(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert-or-ignore: the existing rows and the first new row of every key that is not there yet."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return existing.unionByName(first.join(existing.select(*keys), keys, "left_anti"))


def progress(cited: DataFrame, totals: DataFrame, keys: list[str], book: str = "book_id") -> DataFrame:
    """Distinct cited chunks per key in percent of the book's chunks, one decimal, at most 100; keys without citations get zero.

    totals (keys, book, total_chunks): one row per key.
    """
    n = cited.select(*keys, "chunk_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    c = F.coalesce("_c", F.lit(0))
    return totals.join(n, keys, "left").select(*keys, c.alias("n_cited"), F.least(bround_pct(c, F.col("total_chunks")), F.lit(100.0)).alias("percent"))


def chapter_clusters(chunks: DataFrame, lit: DataFrame) -> DataFrame:
    """(book_id, chapter, total, n_lit) of level-0 chunks; lit (book_id, chunk_id)."""
    flag = lit.select("book_id", "chunk_id").distinct().withColumn("_lit", F.lit(True))
    j = chunks.where("raptor_level = 0").join(flag, ["book_id", "chunk_id"], "left")
    return j.groupBy("book_id", "chapter").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("_lit", F.lit(False))).alias("n_lit"))


def chunk_map(chunks: DataFrame, sections: DataFrame, events: DataFrame) -> DataFrame:
    """Each level-0 chunk with its section's place, length, preview and the first event that cites it.

    events (book_id, event_id, created, facts, chunk_ids): a fact's chunks count; an event without the
    facts key (null) counts with its own chunk_ids, an empty list of facts with none.
    """
    by_fact = events.where("facts is not null").select("book_id", "event_id", "created", F.explode(F.flatten(F.transform("facts", lambda f: f["chunk_ids"]))).alias("chunk_id"))
    by_turn = events.where("facts is null").select("book_id", "event_id", "created", F.explode("chunk_ids").alias("chunk_id"))
    cited = by_fact.unionByName(by_turn).where(~F.col("chunk_id").startswith("raptor_"))
    first = cited.groupBy("book_id", "chunk_id").agg(F.min(F.struct("created", "event_id")).alias("_e"))
    j = chunks.where("raptor_level = 0").join(sections.select("book_id", "section_id", F.col("order_idx").alias("_o"), "label"), ["book_id", "section_id"], "left").join(first, ["book_id", "chunk_id"], "left")
    return j.select("book_id", "chunk_id", F.coalesce("label", F.lit("Unsorted")).alias("section_label"), F.coalesce("_o", F.lit((1 << 31) - 1)).cast("long").alias("section_order"), "chunk_ord",
                    F.length("text").cast("long").alias("n_chars"), F.substring("text", 1, 200).alias("preview"), F.col("_e.event_id").alias("lit_by"), F.col("_e").isNotNull().alias("lit"))


def last_event(events: DataFrame) -> DataFrame:
    """(session_id, n_events, last_event_id, last_query, last_new) over events (session_id, event_id, created, query_text, n_new)."""
    return events.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_events"), F.max_by(F.struct("event_id", "query_text", "n_new"), F.struct("created", "event_id")).alias("_l")).select(
        "session_id", "n_events", F.col("_l.event_id").alias("last_event_id"), F.col("_l.query_text").alias("last_query"), F.col("_l.n_new").alias("last_new"))


def session_list(sessions: DataFrame, turns: DataFrame, limit: int = 100) -> DataFrame:
    """The newest used sessions: number of messages, preview of the first user message, totals (0 if null).

    sessions (session_id, start_time, tokens); turns (session_id, turn, role, content).
    """
    said = (F.col("role") == "user") & (F.trim("content") != "")
    t = turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_messages"), F.substring(F.min_by("content", F.when(said, F.col("turn"))), 1, 120).alias("preview"),
                                        F.max(said).alias("_said"))
    j = sessions.join(t, "session_id").withColumn("preview", F.when(F.col("_said"), F.col("preview")).otherwise(""))
    j = j.orderBy(F.col("start_time").desc(), F.col("session_id").desc()).limit(limit)
    return j.select("session_id", "n_messages", "preview", F.coalesce("tokens", F.lit(0)).alias("tokens"))


def recent_questions(turns: DataFrame, n: int = 15) -> DataFrame:
    """The user's last ``n`` questions (session_id, turn, content): newest session first, latest turn first.

    turns carry start_time. The limit comes with the sort, so Spark keeps n rows per task.
    """
    q = turns.where((F.col("role") == "user") & (F.trim(F.coalesce("content", F.lit(""))) != ""))
    return q.orderBy(F.col("start_time").desc(), F.col("session_id").desc(), F.col("turn").desc()).limit(n).select("session_id", "turn", "content")


# Questions that say nothing about a reader's interests, found anywhere in them.
NOISE = (r"(?i)how\s+(much|far)\s+have\s+i\s+read|\bprogress\b|(export|save)\b.{0,20}\b(notes?|pdf|markdown)|summar[iy][sz]e\s+(this|the)\s+book"
         r"|what(?:'s|\s+is)\s+(this|the)\s+book\s+about|^(hi|hello|hey)\b|nice\s+to\s+meet\s+you|(who|what)\s+are\s+you"
         r"|进度|读了多少|导出|保存.{0,6}笔记|介绍.{0,4}这本书|这本书.{0,4}(讲|关于)|你好|你是谁|你叫什么")
CJK = r"[一-鿿]"


def is_interest(text: Column) -> Column:
    """At least ten characters, three words unless Chinese, and no noise."""
    t = F.trim(text)
    words = F.size(F.split(t, r"\s+"))
    return (F.length(t) >= 10) & (t.rlike(CJK) | (words >= 3)) & ~t.rlike(NOISE)


def interests(sources: list[DataFrame]) -> DataFrame:
    """(ord, text): texts of the sources (ord, text) in their priority, trimmed, without blanks and case-insensitive repeats."""
    u = None
    for i, s in enumerate(sources):
        one = s.select(F.lit(i).alias("_s"), F.col("ord").alias("_o"), F.trim("text").alias("text"))
        u = one if u is None else u.unionByName(one)
    g = u.where("text <> ''").groupBy(F.lower("text").alias("_k")).agg(F.min(F.struct("_s", "_o", "text")).alias("_m"))
    return g.select(F.col("_m._s").alias("source"), F.col("_m._o").alias("ord"), F.col("_m.text").alias("text"))


def exclude_titles(picks: DataFrame, owned: DataFrame, seen: DataFrame) -> DataFrame:
    """picks (pos, title) without titles that are owned or were ever recommended, and without repeats; case does not count."""
    known = owned.select(F.lower(F.trim("title")).alias("_k")).unionByName(seen.select(F.lower(F.trim("title")).alias("_k"))).distinct()
    rest = picks.withColumn("_k", F.lower(F.trim("title"))).join(known, "_k", "left_anti")
    return rest.groupBy("_k").agg(F.min(F.struct("pos", "title")).alias("_m")).select("_m.pos", "_m.title")


# Marks of editions that are not the book itself.
KNOCK_OFF = (r"(?i)\b(summary|summaries|study guide|workbook|analysis|key takeaways|conversation starters|sparknotes|cliffs?notes|quicklet|trivia|"
             r"sidekick|instaread|blinkist)\b")


def norm_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "))


def _words(c: Column) -> Column:
    return F.filter(F.array_distinct(F.split(c, r"\s+")), lambda w: F.length(w) > 1)


# What titles and volumes score.
EXACT, INSIDE, WORD, AUTHOR, OFF, DESCRIBED = 10, 5, 2, 3, -8, 0.5


def match_catalog(wanted: DataFrame, volumes: DataFrame) -> DataFrame:
    """Best volume per wanted title (pick_id, volume_id, score): the highest score over all volumes, the least volume_id of equal ones.

    wanted (pick_id, title, author), volumes (volume_id, title, subtitle, publisher, author, description).
    An exact title scores 10, one inside the other 5, else twice the common words; a common word of the author's name 3,
    a knock-off -8, a description 0.5. Volumes without a title are not used; without volumes nothing is returned.

    No pair of a pick and an arbitrary volume is formed. Volumes of one title are first reduced to their best, alone and for
    each word of an author's name, so a title is one candidate however many volumes bear it. A volume
    that shares no word with the pick cannot beat the best of all volumes, nor one that shares one or two words
    the best volume with that word or those two, which are known from one row per word or pair. Volumes with more common words are
    looked up by the two rarest of them, not by one: pairs beyond which even a volume with all words left could not reach the best score so far are left out, and those with the most frequent word. Substrings are joined by
    their hashes (titles inside the pick's) and by rarest grams (the pick's inside titles), where they can still win.
    """
    base = F.when(F.concat_ws(" ", "title", "subtitle", "publisher").rlike(KNOCK_OFF), OFF).otherwise(0) + F.when(F.coalesce(F.trim("description"), F.lit("")) != "", DESCRIBED).otherwise(0.0)
    v = stage(volumes.where(F.trim("title") != "").select("volume_id", norm_title(F.col("title")).alias("b"), _words(norm_title(F.col("author"))).alias("names"), base.cast("double").alias("base")))
    top = F.max(F.struct("base", (-F.col("volume_id")).alias("no"), "b")).alias("top")
    best_of = lambda df, *keys: df.groupBy(*keys).agg(top)
    titles = stage(best_of(v, "b").withColumn("words", _words(F.col("b"))))
    named = stage(best_of(v.select("*", F.explode("names").alias("name")), "b", "name"))
    p = wanted.select("pick_id", F.coalesce(norm_title(F.col("title")), F.lit("")).alias("a"), F.coalesce(_words(norm_title(F.col("author"))), F.array().cast("array<string>")).alias("names"))
    p = stage(p.withColumn("words", _words(F.col("a"))))

    def scored(pairs: DataFrame) -> DataFrame:
        """(pick_id, best): the best of the candidate titles (pick_id, b)."""
        j = pairs.distinct().join(p, "pick_id").join(titles.select("b", F.col("top").alias("alone"), F.col("words").alias("own")), "b")
        inside = (F.col("a") != "") & (F.contains("a", F.col("b")) | F.contains("b", F.col("a")))
        title = F.when((F.col("a") != "") & (F.col("a") == F.col("b")), EXACT).when(inside, INSIDE).otherwise(F.size(F.array_intersect("words", "own")) * WORD)
        j = j.select("pick_id", "b", title.cast("double").alias("title"), "alone", "names")
        total = lambda c, more=0: F.struct((F.col("title") + F.col(f"{c}.base") + more).alias("score"), F.col(f"{c}.no").alias("no"))
        by_name = j.select("pick_id", "b", "title", F.explode("names").alias("name")).join(named, ["b", "name"]).select("pick_id", total("top", AUTHOR).alias("x"))
        return j.select("pick_id", total("alone").alias("x")).unionByName(by_name).groupBy("pick_id").agg(F.max("x").alias("best"))

    asked = stage(p.select("pick_id", "names", F.explode("words").alias("w")))
    wanted_words = asked.select("w").distinct()
    posted = stage(titles.select("b", "top", F.explode("words").alias("w")).join(wanted_words, "w", "left_semi"))
    counts = posted.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    rank = Window.partitionBy("pick_id").orderBy("n", "w")
    ranked = stage(asked.join(counts, "w").select("pick_id", "w", F.row_number().over(rank).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("pick_id")).alias("of")))
    # words of picks and titles in pairs, each pair in the order of the alphabet
    pair = lambda x, y: F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"))
    two_of = lambda c, make: F.flatten(F.transform(c, lambda x, i: F.transform(F.slice(c, i + 2, F.size(c)), lambda y: make(x, y))))
    in_rank = F.array_sort(F.collect_list(F.struct("r", "w")))
    paired = ranked.groupBy("pick_id", "of").agg(in_rank.alias("_w")).select("pick_id", "of", F.explode(two_of(F.col("_w"), lambda x, y: F.struct(
        x["r"].alias("ra"), y["r"].alias("rb"), pair(x["w"], y["w"]).alias("uv")))).alias("_x")).select("pick_id", "of", "_x.*")
    paired = stage(paired.select("pick_id", "of", "ra", "rb", "uv.u", "uv.v"))
    own = posted.groupBy("b").agg(F.first("top").alias("top"), F.sort_array(F.collect_list("w")).alias("_w")).where(F.size("_w") > 1)
    posted_pairs = own.select("b", "top", F.explode(two_of(F.col("_w"), pair)).alias("_x")).select("b", "top", "_x.*")
    posted_pairs = stage(posted_pairs.join(paired.select("u", "v").distinct(), ["u", "v"], "left_semi").select("b", "top", "u", "v"))
    # the best of all, of a name, of a word, of a word and a name, of a pair, of a pair and a name
    x = F.col("top.base").alias("base"), F.col("top.no").alias("no"), F.col("top.b").alias("b")
    b_of = lambda df, *keys: df.groupBy(*keys).agg(F.max(F.struct(*x)).alias("m")).select(*keys, F.col("m.b").alias("b"))
    names = p.select("pick_id", F.explode("names").alias("name"))
    overall = titles.agg(F.max(F.struct(*x)).alias("m")).select(F.col("m.b").alias("b")).where("b is not null")  # one row
    by_word = b_of(posted, "w")
    both = b_of(posted.select("b", "w").join(named, "b").select("w", "name", "top"), "w", "name")
    first = (p.select("pick_id").crossJoin(F.broadcast(overall)).unionByName(p.where("a <> ''").select("pick_id", F.col("a").alias("b")))
             .unionByName(p.where("a <> ''").select("pick_id", F.lit("").alias("b"))).unionByName(names.join(b_of(named, "name"), "name").select("pick_id", "b"))
             .unionByName(asked.join(by_word, "w").select("pick_id", "b")).unionByName(asked.select("pick_id", "w", F.explode("names").alias("name")).join(both, ["w", "name"]).select("pick_id", "b"))
             .unionByName(paired.join(b_of(posted_pairs, "u", "v"), ["u", "v"]).select("pick_id", "b"))
             .unionByName(paired.join(names, "pick_id").join(b_of(posted_pairs.drop("top").join(named, "b"), "u", "v", "name"), ["u", "v", "name"]).select("pick_id", "b")))
    one = stage(scored(first))
    most = AUTHOR + DESCRIBED
    # a volume whose rarest common word is the ra-th has at most of - ra + 1 common words; of three or more the second rarest is not the most frequent
    further = paired.where("ra < of - 1 and rb < of").join(one, "pick_id").where((F.col("of") - F.col("ra") + 1) * WORD + most >= F.col("best.score"))
    open_ = p.where("a <> ''").join(one.where(F.col("best.score") <= INSIDE + most).select("pick_id"), "pick_id", "left_semi")
    longest = titles.agg(F.max(F.char_length("b"))).first()[0] or 0
    within = all_windows(open_, "pick_id", "a", longest).join(hashed(titles.where("b <> ''"), "b", "b"), "hash").select("pick_id", "b")
    around = contained(titles.select(F.col("b").alias("hay_id"), F.col("b").alias("hay")), open_.select(F.col("pick_id").alias("needle_id"), F.col("a").alias("needle"))).select(F.col("needle_id").alias("pick_id"), F.col("hay_id").alias("b"))
    two = scored(further.join(posted_pairs, ["u", "v"]).select("pick_id", "b").unionByName(within).unionByName(around))
    best = one.unionByName(two).groupBy("pick_id").agg(F.max("best").alias("best"))
    return best.select("pick_id", (-F.col("best.no")).alias("volume_id"), "best.score")


def edit_notes(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """Notes (id, text, type) with the last edit (id, seq, text, type) of each applied: trimmed; a blank text deletes nothing and changes nothing, an unknown type keeps the old one.

    Edits of ids that do not exist are ignored.
    """
    last = edits.where(F.trim("text") != "").groupBy("id").agg(F.max_by(F.struct(F.trim("text").alias("t"), F.when(F.col("type").isin("fact", "interest"), F.col("type")).alias("y")), "seq").alias("_e"))
    return notes.join(last, "id", "left").select("id", F.coalesce("_e.t", "text").alias("text"), F.coalesce("_e.y", "type").alias("type"))


def add_notes(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Notes (id, text, type) with new ones added: trimmed, no blanks, exact repeats ignored, the first wins, default type fact."""
    n = new.select("id", F.trim("text").alias("text"), F.when(F.col("type").isin("fact", "interest"), F.col("type")).otherwise("fact").alias("type")).where("text <> ''")
    n = n.groupBy("text").agg(F.min(F.struct("id", "type")).alias("_m")).select("_m.id", "text", "_m.type")
    return existing.select("id", "text", "type").unionByName(n.join(existing.select("text"), "text", "left_anti").select("id", "text", "type"))


def usage_cost(usage: DataFrame, prices: DataFrame, *keys: str) -> DataFrame:
    """Tokens and exact cost per key; usage (keys, model, input_tokens, output_tokens), prices per million in decimals.

    A model without a price costs nothing and is counted as unpriced. Prices are one row per model.
    """
    d = lambda c: F.col(c).cast("decimal(18,0)")
    j = usage.join(prices, "model", "left")
    cost = (d("input_tokens") * F.col("input_per_1m") + d("output_tokens") * F.col("output_per_1m")) / F.lit(1_000_000).cast("decimal(10,0)")
    return j.groupBy(*keys).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
                                F.coalesce(F.sum(cost.cast("decimal(28,12)")), F.lit(0).cast("decimal(28,12)")).alias("cost"), F.count_if(F.col("input_per_1m").isNull()).alias("n_unpriced"))


def read_prices(texts: DataFrame) -> DataFrame:
    """(model, input_per_1m, output_per_1m) of price lists (text), each a JSON object from models to {input_per_1m_tokens, output_per_1m_tokens}.

    An entry that is no object, lacks a price or has one that is no finite decimal is skipped, as is a text that is no object; of repeated models the last by text wins.
    """
    v = texts.select("text", F.try_parse_json("text").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    e = v.select("text", F.explode(F.from_json("text", "map<string, string>")).alias("model", "entry"))
    price = lambda c: F.get_json_object("entry", f"$.{c}_per_1m_tokens").try_cast("decimal(18,9)").alias(f"{c}_per_1m")
    e = e.select("text", "model", price("input"), price("output")).where("input_per_1m is not null and output_per_1m is not null")
    return e.groupBy("model").agg(F.max_by(F.struct("input_per_1m", "output_per_1m"), "text").alias("_p")).select("model", "_p.*")


def history_window(turns: DataFrame, n: int = 20, cut: int | None = None) -> DataFrame:
    """(session_id, n_turns, history): the last ``n`` turns of a session in order, one line each."""
    w = Window.partitionBy("session_id").orderBy(F.col("turn").desc())
    t = turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    body = F.col("content") if cut is None else F.substring("content", 1, cut)
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce(body, F.lit("")))
    return t.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("history"))


def retain_last(df: DataFrame, key: str, order: list[str], n: int = 30) -> DataFrame:
    """The newest ``n`` rows of every key; n <= 0 keeps everything."""
    if n <= 0:
        return df
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def retain_with_dependents(df: DataFrame, key: str, order: list[str], dependents: list[DataFrame], row: list[str], n: int = 30) -> tuple[DataFrame, list[DataFrame]]:
    """(kept rows, kept rows of each dependent table): dependents point to a row by the columns ``row`` and go with it."""
    kept = retain_last(df, key, order, n)
    return kept, [d if n <= 0 else d.join(kept.select(*row).distinct(), row, "left_semi") for d in dependents]


def rec_stats(recs: DataFrame) -> DataFrame:
    """(status, n, add_rate): counts by status, and the share of added ones over all."""
    g = recs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    total = recs.agg((F.count_if(F.col("status") == "added") / F.count(F.lit(1))).alias("add_rate"))
    return g.crossJoin(F.broadcast(total))


def rec_titles(recs: DataFrame) -> DataFrame:
    """(title): the distinct titles ever recommended, in any status, trimmed; blank ones are none."""
    return recs.select(F.trim("title").alias("title")).where("title <> ''").distinct()


def request_pairs(logs: DataFrame) -> DataFrame:
    """Requests from log rows (request_id, phase start or end, ts_us, status, level, client_id): took_ms, status (500 without an end), client.

    A client id counts only with 8 to 64 visible ASCII characters.
    """
    g = logs.groupBy("request_id").agg(F.min(F.when(F.col("phase") == "start", F.col("ts_us"))).alias("_s"), F.max(F.when(F.col("phase") == "end", F.col("ts_us"))).alias("_e"),
                                       F.max(F.when(F.col("phase") == "end", F.col("status"))).alias("_st"), F.max("level").alias("level"), F.max("client_id").alias("_c"))
    return g.select("request_id", F.floor((F.col("_e") - F.col("_s")) / 1000).alias("took_ms"), F.coalesce("_st", F.lit(500)).alias("status"), "level",
                    F.when(F.col("_c").rlike(r"^[\x21-\x7e]{8,64}$"), F.col("_c")).otherwise("new").alias("client_id"))
