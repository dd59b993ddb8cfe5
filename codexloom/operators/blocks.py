"""From lines and page elements to blocks and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codexloom.functions.columns import block_id, section_id
from codexloom.operators.scans import before_ranges, since_reset
from codexloom.sources.store import stage

_BEFORE = (Window.unboundedPreceding, -1)


def band(y: Column, tolerance: float = 4.0) -> Column:
    """The height of a line in steps of a tolerance, halves to even; lines that differ less stand in one band."""
    return F.bround((y / F.lit(tolerance)).cast("decimal(24,6)"), 0).cast("double") * tolerance


def drop_repeating_bands(lines: DataFrame, key: list[str], page: str, min_pages: int = 3) -> tuple[DataFrame, DataFrame]:
    """(kept lines, audit per book).

    A line whose ``key`` stands on at least ``min_pages`` distinct pages of its book is boilerplate;
    of the rest, lines of up to four digits are page numbers. A boilerplate line counts only as such.
    """
    per = lines.groupBy("book_id", *key).agg(F.countDistinct(page).alias("_pages"))
    marked = lines.join(per.where(F.col("_pages") >= min_pages).drop("_pages").withColumn("_band", F.lit(True)), ["book_id", *key], "left")
    band, number = F.coalesce("_band", F.lit(False)), F.trim("text").rlike(r"^[0-9]{1,4}$")
    audit = marked.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(band).alias("n_boilerplate"), F.count_if(~band & number).alias("n_page_numbers"))
    return marked.where(~band & ~number).drop("_band"), audit


def cluster_lines(lines: DataFrame, gap: float = 8.0) -> DataFrame:
    """Blocks of neighbouring lines (book_id, page, pos, text, x0, y0, x1, y1, font_size).

    A block starts on a new page or when a line begins more than ``gap`` below its predecessor's
    end. The font is the upper median.
    """
    w = Window.partitionBy("book_id", "page").orderBy("pos")
    new = F.coalesce((F.col("y0") - F.lag("y1").over(w) > gap).cast("int"), F.lit(1))
    island = lines.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fonts = F.array_sort(F.collect_list("font_size"))
    text = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " "))
    return island.groupBy("book_id", "page", F.col("_island").alias("block_no")).agg(
        F.min("pos").alias("pos"), text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.element_at(fonts, (F.floor(F.size(fonts) / 2) + 1).cast("int")).alias("font_size"))


# Starts of headings; an English one needs a number or a capitalised word after its marker.
HEADING = (r"^(?:CHAPTER|Chapter|SECTION|Section|PART|Part|BOOK|Book)\s+(?:[0-9]+|[IVXLCDM]+|[A-Z][a-z]+)\b"
           r"|^[0-9]+\.[0-9]+(?:\.[0-9]+)?\s+[\p{L}\p{N}_]|^第[一二三四五六七八九十百零两0-9]+章")


def heal_page_breaks(blocks: DataFrame, span: int = 1024) -> DataFrame:
    """Join blocks that a page break cut (book_id, page, ord, text) -> (book_id, ord, pages, text, dehyphenated, n_merged).

    Neighbours are joinable when the first ends in a hyphen, or the second is no heading and
    continues in lower case after a comma, semicolon, colon or lower-case letter. A run of joinable
    blocks merges from its first page change on.

    It is a segmented scan: ``ord`` is cut into ranges of ``span``, windows run inside a range over flags of the texts, and three states are carried from range to range:
    the end of the last block, whether the open run has seen a page change, and the number of groups. The texts are
    moved only to be joined.
    """
    key = ["book_id", "_p"]
    tail, head = F.rtrim("text"), F.ltrim("text")
    b = blocks.select("book_id", "ord", "page", F.floor(F.col("ord") / span).alias("_p"), F.struct("page", tail.rlike("[-‐]$").alias("hyphen"), tail.rlike(r"[,;:\p{Ll}]$").alias("open")).alias("_end"),
                      (~head.rlike(HEADING) & head.rlike(r"^\p{Ll}")).alias("_goes_on"))
    w, so_far = Window.partitionBy(*key).orderBy("ord"), Window.partitionBy(*key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    ends = b.groupBy(*key).agg(F.max_by("_end", "ord").alias("_end"))
    b = b.join(before_ranges(ends, ["book_id"], "_p", _came=F.max_by("_end", "_p")), key).withColumn("_last", F.coalesce(F.lag("_end").over(w), "_came"))
    hyphen = F.coalesce("_last.hyphen", F.lit(False))
    join = hyphen | (F.col("_goes_on") & F.coalesce("_last.open", F.lit(False)))
    turn = F.coalesce(F.col("_last.page") != F.col("page"), F.lit(False))
    b = stage(b.select(*key, "ord", "page", hyphen.alias("_hyphen"), join.alias("_join"), (join & turn).cast("int").alias("_turn")))
    # a block that joins nothing starts a run
    b = b.withColumn("_run", F.sum((~F.col("_join")).cast("int")).over(so_far))
    runs = b.groupBy(*key, "_run").agg(F.max("_turn").alias("_turn")).groupBy(*key).agg((F.max("_run") > 0).alias("_reset"), F.max_by("_turn", "_run").alias("_turn"))
    came = since_reset(runs, ["book_id"], "_p", "_reset", "_turn").withColumnRenamed("_turn", "_seen")
    turned = F.max("_turn").over(Window.partitionBy(*key, "_run").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    b = b.join(came, key).withColumn("_turned", F.greatest(turned, F.when(F.col("_run") == 0, F.col("_seen")))).withColumn("_merge", F.col("_join") & (F.col("_turned") == 1))
    b = stage(b.select(*key, "ord", "page", "_hyphen", "_merge"))
    groups = b.groupBy(*key).agg(F.sum((~F.col("_merge")).cast("int")).alias("_n"))
    b = b.join(before_ranges(groups, ["book_id"], "_p", _before=F.sum("_n")), key)
    b = b.select("book_id", "ord", "page", "_hyphen", "_merge", (F.sum((~F.col("_merge")).cast("int")).over(so_far) + F.coalesce("_before", F.lit(0))).alias("_group"))
    b = b.join(blocks.select("book_id", "ord", "text"), ["book_id", "ord"])
    parts = F.array_sort(F.collect_list(F.struct("ord", "_hyphen", "_merge", "text")))
    text = F.aggregate(parts, F.lit(""), lambda s, x: F.when(~x["_merge"], x["text"]).when(
        x["_hyphen"], F.concat(F.regexp_replace(F.rtrim(s), "[-‐]$", ""), F.ltrim(x["text"]))).otherwise(F.concat(F.rtrim(s), F.lit(" "), F.ltrim(x["text"]))))
    return b.groupBy("book_id", "_group").agg(
        F.min("ord").alias("ord"), F.array_sort(F.collect_set("page")).alias("pages"), text.alias("text"),
        F.max(F.col("_merge") & F.col("_hyphen")).alias("dehyphenated"), F.sum(F.col("_merge").cast("int")).alias("n_merged")).drop("_group")


def sections_from_outline(toc: DataFrame, nested: bool = False) -> DataFrame:
    """Sections (book_id, order_idx, label, pos) from an outline (book_id, pos, level, parent_pos, title).

    Flat outlines keep level 1; a blank title becomes its number. Nested ones keep the top level
    unless it has fewer than three entries, then all, and a bare marker takes its first child's title.
    """
    w = Window.partitionBy("book_id").orderBy("pos")
    if nested:
        tops = F.sum((F.col("level") == 1).cast("int")).over(Window.partitionBy("book_id"))
        child = toc.groupBy("book_id", F.col("parent_pos").alias("pos")).agg(F.min_by("title", "pos").alias("_child"))
        toc = toc.withColumn("_tops", tops).join(child, ["book_id", "pos"], "left")
        bare = F.col("title").rlike(r"^(?i:chapter|part)\s+[0-9IVXLC]+\.?$")
        toc = toc.where((F.col("level") == 1) | (F.col("_tops") < 3)).withColumn(
            "title", F.when(bare & F.col("_child").isNotNull(), F.concat_ws(" ", "title", "_child")).otherwise(F.col("title")))
    else:
        toc = toc.where("level = 1")
    n = F.row_number().over(w)
    label = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("Section "), n.cast("string")))
    return toc.select("book_id", (n - 1).cast("long").alias("order_idx"), label.alias("label"), "pos")


def infer_sections(blocks: DataFrame, ratio: float = 1.25, max_chars: int = 120) -> DataFrame:
    """Sections (book_id, pos, label, kind) of books without an outline, from the blocks' font sizes.

    A block of at least ``ratio`` times the book's upper median font and of bounded length is a
    heading. A book without any gets one section over all of it. The median is taken over counted
    font sizes, so no book's blocks are gathered.
    """
    sizes = blocks.groupBy("book_id", "font_size").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("book_id").orderBy("font_size").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy("book_id"))
    middle = sizes.withColumn("_upto", F.sum("n").over(by)).withColumn("_total", total).where("_upto > floor(_total / 2)").groupBy("book_id").agg(F.min("font_size").alias("median"))
    heads = (blocks.join(middle, "book_id").where((F.col("font_size") >= ratio * F.col("median")) & (F.length("text") <= max_chars))
             .select("book_id", "pos", F.substring("text", 1, 80).alias("label"), F.lit("heading").alias("kind")))
    bare = (blocks.groupBy("book_id").agg(F.min("pos").alias("pos")).join(heads.select("book_id").distinct(), "book_id", "left_anti")
            .select("book_id", "pos", F.lit("Body").alias("label"), F.lit("other").alias("kind")))
    return heads.unionByName(bare)


def infer_dom_sections(blocks: DataFrame) -> DataFrame:
    """Sections (book_id, pos, label, kind) of marked-up books without an outline, from blocks (book_id, pos, heading_level, text).

    Every first-level heading starts one; in books that have none, every second-level heading does. A book with neither is one section "Body".
    """
    levels = blocks.groupBy("book_id").agg(F.min("pos").alias("_first"), F.coalesce(F.bool_or(F.col("heading_level") == 1), F.lit(False)).alias("_h1"), F.coalesce(F.bool_or(F.col("heading_level") == 2), F.lit(False)).alias("_h2"))
    use = F.when(F.col("_h1"), 1).when(F.col("_h2"), 2)
    heads = (blocks.where("heading_level in (1, 2)").join(levels.select("book_id", use.alias("_level")), "book_id").where("heading_level = _level")
             .select("book_id", "pos", F.substring("text", 1, 80).alias("label"), F.lit("heading").alias("kind")))
    bare = levels.where("not _h1 and not _h2").select("book_id", F.col("_first").alias("pos"), F.lit("Body").alias("label"), F.lit("other").alias("kind"))
    return heads.unionByName(bare)


def emit_blocks(drafts: DataFrame) -> DataFrame:
    """Blocks with order, ids and half-open offsets from drafts (book_id, doc_id, pos, text).

    One virtual line break lies between blocks. Running sums go over sections first and then within
    each, so that no window holds a whole book's lines.
    """
    # measured before the joins, so that plans which need offsets alone move no text
    drafts = drafts.withColumn("_size", F.length("text"))
    inside = Window.partitionBy("book_id", "doc_id").orderBy("pos")
    per = drafts.groupBy("book_id", "doc_id").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("_size") + 1).alias("_len"))
    books = Window.partitionBy("book_id").orderBy("doc_id")
    per = per.select("book_id", "doc_id", (F.row_number().over(books) - 1).alias("_ord"),
                     F.coalesce(F.sum("_n").over(books.rowsBetween(*_BEFORE)), F.lit(0)).alias("_first"),
                     F.coalesce(F.sum("_len").over(books.rowsBetween(*_BEFORE)), F.lit(0)).alias("_base"))
    d = drafts.join(per, ["book_id", "doc_id"])
    order = (F.col("_first") + F.row_number().over(inside) - 1).cast("long")
    start = (F.col("_base") + F.coalesce(F.sum(F.col("_size") + 1).over(inside.rowsBetween(*_BEFORE)), F.lit(0))).cast("long")
    d = d.withColumn("order_idx", order).withColumn("start_off", start)
    return d.select("book_id", section_id(F.col("book_id"), F.col("_ord")).alias("section_id"), "doc_id", "pos", "order_idx",
                    block_id(F.col("book_id"), F.col("order_idx")).alias("block_id"), "text", "start_off",
                    (F.col("start_off") + F.col("_size")).cast("long").alias("end_off"))


def assign_sections(blocks: DataFrame, sections: DataFrame, clamp: bool = False, span: int = 1 << 16) -> DataFrame:
    """As-of join: each block (book_id, pos, ...) gets the latest section (book_id, start, section_id) with start <= pos.

    Of several sections with one start the last by order_idx wins. Blocks before the first section
    get none, or the first with ``clamp``. A union and a window over ``span`` positions of a book;
    what a span inherits comes from a window over one row per span. No range join.
    """
    starts = sections.groupBy("book_id", F.col("start").alias("pos")).agg(F.max_by("section_id", "order_idx").alias("_sec"))
    names = blocks.columns
    both = blocks.withColumn("_is", F.lit(1)).unionByName(starts.withColumn("_is", F.lit(0)), allowMissingColumns=True).withColumn("_r", F.floor(F.col("pos") / span))
    book = Window.partitionBy("book_id").orderBy("_r")
    per = both.groupBy("book_id", "_r").agg(F.max_by("_sec", F.when(F.col("_is") == 0, F.col("pos"))).alias("_end"), F.min_by("_sec", F.when(F.col("_is") == 0, F.col("pos"))).alias("_begin"))
    first = F.first("_begin", ignorenulls=True).over(book.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    per = per.select("book_id", "_r", F.last("_end", ignorenulls=True).over(book.rowsBetween(*_BEFORE)).alias("_end"), first.alias("_begin"))
    w = Window.partitionBy("book_id", "_r").orderBy("pos", "_is").rowsBetween(Window.unboundedPreceding, 0)
    sec = F.coalesce(F.last("_sec", ignorenulls=True).over(w), "_end", *(["_begin"] if clamp else []))
    return both.join(per, ["book_id", "_r"]).withColumn("assigned_section", sec).where("_is = 1").select(*names, "assigned_section")


def resolve_anchor(toc: DataFrame, drafts: DataFrame) -> DataFrame:
    """Outline entries (book_id, pos, href) with the position of the draft they point to.

    The fragment's draft wins, else the file's first draft; entries of unknown files are dropped.
    """
    t = toc.withColumn("_file", F.element_at(F.split(F.substring_index("href", "#", 1), "/"), -1)).withColumn(
        "_frag", F.when(F.instr("href", "#") > 0, F.substring_index("href", "#", -1)))
    d = drafts.select("book_id", F.element_at(F.split("href", "/"), -1).alias("_file"), F.col("pos").alias("_at"), "anchor_ids")
    hit = F.min(F.when(F.array_contains("anchor_ids", F.col("_frag")), F.col("_at")))
    return t.join(d, ["book_id", "_file"]).groupBy("book_id", "pos", "href").agg(F.coalesce(hit, F.min("_at")).alias("draft_pos"))


def ingestion_report(blocks: DataFrame, raw: DataFrame) -> DataFrame:
    """Counts per book: raw and kept lines, characters, sections, empty and long blocks, most blocks of a section."""
    per = blocks.groupBy("book_id", F.coalesce("section_id", F.lit("<none>")).alias("sec")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.count_if(F.length("text") > 400).alias("n_long"))
    own = per.groupBy("book_id").agg(F.sum("n").alias("n_blocks"), F.count(F.lit(1)).alias("n_sections"), F.max("n").alias("max_section_blocks"),
                                     F.sum("chars").alias("n_chars"), F.sum("n_long").alias("n_long"))
    lines = raw.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_raw_lines"), F.count_if(~F.col("text").rlike(r"\S")).alias("n_empty"))
    return own.join(lines, "book_id")


def ingestion_histograms(blocks: DataFrame) -> DataFrame:
    """(book_id, measure, name, n): blocks by kind and by section, ``<none>`` for blocks outside of any; blocks (book_id, section_id, kind)."""
    named = F.explode(F.array(F.struct(F.lit("kind").alias("measure"), F.col("kind").alias("name")), F.struct(F.lit("section").alias("measure"), F.col("section_id").cast("string").alias("name"))))
    return blocks.select("book_id", named.alias("x")).groupBy("book_id", "x.measure", F.coalesce("x.name", F.lit("<none>")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def with_audits(report: DataFrame, bands: DataFrame, healed: DataFrame) -> DataFrame:
    """A report per book with its dropped lines (audit of ``drop_repeating_bands``) and joins over page breaks (rows of ``heal_page_breaks``); books without either have none."""
    joins = healed.groupBy("book_id").agg(F.sum("n_merged").alias("n_merged"), F.count_if("dehyphenated").alias("n_dehyphenated"))
    j = report.join(bands.select("book_id", "n_boilerplate", "n_page_numbers"), "book_id", "left").join(joins, "book_id", "left")
    return j.fillna(0, ["n_boilerplate", "n_page_numbers", "n_merged", "n_dehyphenated"])
