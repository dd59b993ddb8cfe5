"""Prefix trie of rebuilt conversations, by composed fingerprints.

A conversation c is rebuilt from a head, the first turns of its base conversation, and its own turns
behind as many. Every turn stands for an affine map over a prime field, drawn from its role and text,
and a run of turns for the product of their maps: a monoid, so the fingerprint of each prefix of a
rebuilt conversation is the product of one of the base's head and one of the own suffix. No
rebuilt text is ever put together; a prefix carries a reference (conversation, place) to the stored turn
that it ends with.

Prefixes with equal depth and fingerprint are one node. Equality does not rest on the
fingerprint: within each group the turns behind its different references are compared in full, as are the
fingerprints of their parents, and a group that is not one sequence stops the job; with another
``seed`` the maps are drawn anew. Products along a conversation are scanned in blocks and carried from
block to block, so a conversation of any length is spread over tasks.

Subtree sums need no walk over levels. The smallest member of a node stands for it, and the nodes that
one conversation stands for are a run of depths down to its end. So a node's leaves and
saved tokens are sums over its members of what each stands for from that depth on.

Defined cases: turns are ordered by (turn, role, text), null turn first; null role or text becomes
empty; rows without conv_id are left out; repeated rows are turns of their own; other columns are
ignored; an empty table gives no node. Conversations exist where they have a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codexloom.llm.common import attach_by_key, partitions, stage

#: The field of the maps x -> m x + t.
PRIME = (1 << 61) - 1
#: Conversations in a family, whose first is the base of all, and how many turns of it a head may have at most, plus one.
FAMILY, HEADS = 5, 9
#: Turns of a conversation that one step of the scan takes.
BLOCK = 256
#: Bytes of joined ids that travel as one row.
PIECE = 1 << 15


def then(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    """The map of a run of turns followed by another."""
    return a[0] * b[0] % PRIME, (a[1] * b[0] + b[1]) % PRIME


def _drawn(seed: str) -> list[Column]:
    """m and t of a turn from the SHA-256 of its role and text; neither is zero."""
    sha = F.sha2(F.concat(F.lit(seed), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    return [(F.pmod(F.conv(F.substring(sha, i, 15), 16, 10).cast("long"), F.lit(PRIME - 1)) + 1).alias(n) for i, n in ((1, "m"), (17, "t"))]


def _turns(conversations: DataFrame, seed: str) -> DataFrame:
    """(conv_id, pos, role, text, bytes, m, t), pos from 1. Sorted ranges are numbered apart, so a long conversation is not one task's."""
    spark = conversations.sparkSession
    c = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = c.repartitionByRange(partitions(spark), "conv_id", F.asc_nulls_first("turn"), "role", F.substring("text", 1, 64))
    order = Window.partitionBy("range", "conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    held = stage(dealt.withColumn("range", F.spark_partition_id()), "ranges")
    numbered = stage(held.select("range", "conv_id", "role", "text", F.octet_length("text").alias("bytes"), *_drawn(seed), F.row_number().over(order).alias("at")), "turns")
    counts = numbered.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    carried = counts.select("conv_id", "range", F.coalesce(before, F.lit(0)).alias("before"))
    return numbered.join(carried, ["conv_id", "range"]).withColumn("pos", F.col("at") + F.col("before")).drop("range", "at", "before")


def _scanned(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, bytes, fm, ft, pm, pt): products of maps up to each turn and up to the one before, from the conversation's start for the first ``HEADS`` - 1 places
    (part 'head') and from behind its own head on (part 'own').

    Tasks multiply inside blocks of turns; the products of whole blocks are then carried on from block to block.
    """
    parts = turns.select("conv_id", "pos", "bytes", "m", "t", _heads("conv_id").alias("h"))
    parts = parts.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("head")).where(F.when(F.col("head"), (F.col("pos") < HEADS) & (F.pmod("conv_id", F.lit(FAMILY)) == 0)).otherwise(F.col("pos") > F.col("h")))
    parts = parts.select("conv_id", "head", "pos", "bytes", "m", "t", F.expr(f"pos div {BLOCK}").alias("block"))
    sorted_ = parts.repartition("conv_id", "head", "block").sortWithinPartitions("conv_id", "head", "block", "pos")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, (1, 0)
        for batch in batches:
            out = []
            for c, head, pos, m, t, block in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "head", "pos", "m", "t", "block"))):
                if (c, head, block) != key:
                    key, now = (c, head, block), (1, 0)
                before, now = now, then(now, (m, t))
                out.append((*now, *before))
            own = [batch.column(x) for x in ("conv_id", "head", "pos", "bytes", "block")]
            yield pa.RecordBatch.from_arrays(own + [pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["conv_id", "head", "pos", "bytes", "block", "fm", "ft", "pm", "pt"])

    fields = "conv_id long, head boolean, pos long, bytes int, block long, fm long, ft long, pm long, pt long"
    local = stage(sorted_.mapInArrow(inside, fields), "products")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, (1, 0)
        for batch in batches:
            out = []
            for c, head, m, t in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "head", "fm", "ft"))):
                if (c, head) != key:
                    key, now = (c, head), (1, 0)
                out.append(now)
                now = then(now, (m, t))
            own = [batch.column(x) for x in ("conv_id", "head", "block")]
            yield pa.RecordBatch.from_arrays(own + [pa.array([r[i] for r in out], pa.int64()) for i in range(2)], names=["conv_id", "head", "block", "cm", "ct"])

    ends = local.groupBy("conv_id", "head", "block").agg(F.max_by(F.struct("fm", "ft"), "pos").alias("x")).select("conv_id", "head", "block", "x.fm", "x.ft")
    carried = ends.repartition("conv_id", "head").sortWithinPartitions("conv_id", "head", "block").mapInArrow(across, "conv_id long, head boolean, block long, cm long, ct long")
    joined = local.join(carried, ["conv_id", "head", "block"])
    return joined.mapInArrow(_composer([("cm", "ct", "fm", "ft"), ("cm", "ct", "pm", "pt")], ["conv_id", "head", "pos", "bytes"]), "conv_id long, head boolean, pos long, bytes int, fm long, ft long, pm long, pt long")


def _composer(products: list[tuple[str, str, str, str]], keep: list[str]):
    """A function for mapInArrow: the columns to keep, then fm, ft, pm, pt as the products of two pairs of columns each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for names in products:
                rows = [then((a, b), (c, d)) for a, b, c, d in zip(*(batch.column(x).to_pylist() for x in names))]
                made += [pa.array([r[i] for r in rows], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in keep] + made, names=[*keep, "fm", "ft", "pm", "pt"])

    return work


def _heads(conv: str) -> Column:
    """Turns that conversation c takes from its base."""
    return F.pmod(F.crc32(F.col(conv).cast("string").cast("binary")), F.lit(HEADS))


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, total, bytes, ref_conv, ref_pos, fm, ft, pm, pt): every prefix of every rebuilt conversation, its last turn's place, its own fingerprint and its parent's."""
    lengths = stage(turns.groupBy("conv_id").agg(F.max("pos").alias("len")), "lengths")
    base = F.col("conv_id") - F.expr(f"conv_id % {FAMILY}")
    plan = lengths.select("conv_id", "len", _heads("conv_id").alias("h"), base.alias("base"))
    plan = plan.join(lengths.select(F.col("conv_id").alias("base"), F.col("len").alias("base_len")), "base", "left")
    plan = plan.withColumn("from_base", F.least("h", F.coalesce("base_len", F.lit(0)))).withColumn("total", F.col("from_base") + F.greatest(F.col("len") - F.col("h"), F.lit(0)))
    plan = stage(plan, "plan")
    scan = stage(_scanned(turns), "scan")
    # a base has fewer than HEADS such rows, and FAMILY conversations at most take them
    head = scan.where("head").select(F.col("conv_id").alias("base"), "pos", "bytes", "fm", "ft", "pm", "pt")
    heads = plan.join(head, "base").where("pos <= from_base")
    first = heads.select("conv_id", F.col("pos").alias("depth"), "total", "bytes", F.col("base").alias("ref_conv"), F.col("pos").alias("ref_pos"), "fm", "ft", "pm", "pt")
    last = heads.where("pos = from_base").select("conv_id", F.col("fm").alias("hm"), F.col("ft").alias("ht"))
    known = plan.join(last, "conv_id", "left").select("conv_id", "h", "from_base", "total", F.coalesce("hm", F.lit(1)).cast("long").alias("hm"), F.coalesce("ht", F.lit(0)).cast("long").alias("ht"))
    own = attach_by_key(scan.where("not head").drop("head"), known, "conv_id", "pos").select(
        "conv_id", (F.col("from_base") + F.col("pos") - F.col("h")).alias("depth"), "total", "bytes", F.col("conv_id").alias("ref_conv"), F.col("pos").alias("ref_pos"), "hm", "ht", "fm", "ft", "pm", "pt")
    keep = ["conv_id", "depth", "total", "bytes", "ref_conv", "ref_pos"]
    rest = own.mapInArrow(_composer([("hm", "ht", "fm", "ft"), ("hm", "ht", "pm", "pt")], keep), "conv_id long, depth long, total long, bytes int, ref_conv long, ref_pos long, fm long, ft long, pm long, pt long")
    root = plan.select("conv_id", F.lit(0).cast("long").alias("depth"), "total", F.lit(0).alias("bytes"), F.lit(None).cast("long").alias("ref_conv"), F.lit(None).cast("long").alias("ref_pos"),
                       *[F.lit(v).cast("long").alias(n) for n, v in (("fm", 1), ("ft", 0), ("pm", None), ("pt", None))])
    return first.unionByName(rest).unionByName(root)


def _verify(prefixes: DataFrame, nodes: DataFrame, turns: DataFrame) -> None:
    """Stop unless every group is one sequence of turns: by induction over depths its prefixes have one parent group and one last turn.

    Turns behind a group's references are compared in full with the turn of its representative; references that many
    members share, as the heads of a family do, are compared once.
    """
    key = ["depth", "fm", "ft"]
    refs = prefixes.where("depth > 0").groupBy(*key, "ref_conv", "ref_pos").agg(F.min("pm").alias("pm"), F.max("pm").alias("pm2"), F.min("pt").alias("pt"), F.max("pt").alias("pt2"))
    chosen = nodes.select("node", *[F.col(k).alias(f"n_{k}") for k in key], F.col("ref.ref_conv").alias("own_conv"), F.col("ref.ref_pos").alias("own_pos"), F.col("parent.pm").alias("own_pm"), F.col("parent.pt").alias("own_pt"))
    node = F.xxhash64(*key)
    members = attach_by_key(refs.withColumn("node", node), chosen, "node", "ref_conv")
    members = stage(members.where("ref_conv <> own_conv or ref_pos <> own_pos or pm <> own_pm or pt <> own_pt or pm <> pm2 or pt <> pt2 or depth <> n_depth or fm <> n_fm or ft <> n_ft or own_conv is null"), "members")
    said = turns.select(F.col("conv_id").alias("ref_conv"), F.col("pos").alias("ref_pos"), "role", "text")
    other = turns.select(F.col("conv_id").alias("own_conv"), F.col("pos").alias("own_pos"), F.col("role").alias("own_role"), F.col("text").alias("own_text"))
    # many members point to one representative turn: it is attached over salts
    with_own = attach_by_key(members.withColumn("own", F.struct("own_conv", "own_pos")).drop("own_conv", "own_pos"), other.withColumn("own", F.struct("own_conv", "own_pos")), "own", "ref_conv")
    bad = with_own.join(said, ["ref_conv", "ref_pos"]).where("not (role = own_role and text = own_text and pm = own_pm and pt = own_pt and pm = pm2 and pt = pt2 and depth = n_depth and fm = n_fm and ft = n_ft)")
    if not bad.isEmpty():
        raise ValueError("two sequences of turns have one fingerprint: use another seed")


def _ends(prefixes: DataFrame) -> DataFrame:
    """(node, ends_sha256): ids of the conversations that end at each node. Ranges of sorted ids are joined to pieces by tasks, and each node's pieces stream through a digest."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, size, held = None, None, 0, []
        for batch in batches:
            out = []
            for node, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
                if node != now or size >= PIECE:
                    if held:
                        out.append((now, first, ",".join(held)))
                    now, first, size, held = node, conv, 0, []
                held.append(str(conv))
                size += len(held[-1]) + 1
            yield table(out)
        if held:
            yield table([(now, first, ",".join(held))])

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["node", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, out = None, None, []
        for batch in batches:
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if node != now:
                    if sha:
                        out.append((now, sha.hexdigest()))
                    now, sha = node, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield digests(out)
            out = []
        if sha:
            yield digests([(now, sha.hexdigest())])

    def digests(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string()))], names=["node", "ends_sha256"])

    n = partitions(prefixes.sparkSession)
    at_end = prefixes.where("depth = total").select(F.xxhash64("depth", "fm", "ft").alias("node"), "conv_id")
    pieces = at_end.repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(joined, "node long, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(hashed, "node long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, seed: str = "") -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and ref_conv, ref_pos, the
    stored turn that the node ends with (null for the root).

    Nodes are named by 64 bits of (depth, fingerprint); ``_verify`` compares names, fingerprints, parents and turns.
    """
    turns = stage(_turns(conversations, seed), "numbered")
    prefixes = stage(_prefixes(turns), "prefixes")
    named = prefixes.withColumn("node", F.xxhash64("depth", "fm", "ft"))
    nodes = named.groupBy("node").agg(F.min("conv_id").alias("smallest"), F.count(F.lit(1)).alias("n_convs"), F.min(F.struct("ref_conv", "ref_pos")).alias("ref"), F.min(F.struct("pm", "pt")).alias("parent"),
                                      *[F.min(c).alias(c) for c in ("depth", "fm", "ft")], F.max("bytes").alias("bytes"))
    nodes = stage(nodes, "nodes")
    _verify(prefixes, nodes, turns)
    up = F.when(F.col("depth") > 0, F.xxhash64(F.col("depth") - 1, F.col("parent.pm"), F.col("parent.pt")))
    nodes = nodes.withColumn("up", up)
    children = nodes.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stage(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "with_children")
    # what each conversation stands for: leaves, and tokens saved, of the nodes whose smallest member it is, from each depth on
    stood = nodes.select(F.col("smallest").alias("conv_id"), "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saves"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    rows = named.select("node", "conv_id", "depth").join(stood, ["conv_id", "depth"], "left").select("node", "conv_id", "depth", F.expr(f"depth div {BLOCK}").alias("block"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("saves", "leaf")])
    rows = stage(rows, "stands")
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("saves").alias("block_saves"), F.sum("leaf").alias("block_leaves"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(c) for c in ("block_saves", "block_leaves")])
    below = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    sums = rows.join(blocks, ["conv_id", "block"]).select("node", (F.sum("saves").over(below) + F.col("block_saves")).alias("saves"), (F.sum("leaf").over(below) + F.col("block_leaves")).alias("leaves"))
    sums = sums.groupBy("node").agg(F.sum("saves").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    names = nodes.select(F.col("node").alias("up"), F.col("smallest").alias("parent_conv_id"))
    got = attach_by_key(nodes, names, "up", "node").join(sums, "node").join(_ends(prefixes), "node", "left")
    return got.select(F.col("smallest").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "ref.ref_conv", "ref.ref_pos")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("ref_conv", "ref_pos")


SQL = r"""
WITH crc AS (
  SELECT conv_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda acc, x: list_reduce([xor(acc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS state
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
turns AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS said FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
plan AS (SELECT t.conv_id, t.said, coalesce(b.said, []) AS base, xor(c.state, 4294967295) % 9 AS h FROM turns t JOIN crc c USING (conv_id) LEFT JOIN turns b ON b.conv_id = t.conv_id - t.conv_id % 5),
rebuilt AS (SELECT conv_id, list_concat(base[1:h], said[h + 1:]) AS said FROM plan),
prefixes AS (SELECT conv_id, len(said) AS total, d AS depth, said[1:d] AS prefix FROM rebuilt, LATERAL (SELECT unnest(range(0, len(said) + 1)) AS d)),
nodes AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE total = depth), '') AS ends FROM prefixes GROUP BY prefix, depth),
linked AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]),
counted AS (SELECT l.*, (SELECT count(*) FROM linked c WHERE c.depth = l.depth + 1 AND c.prefix[1:l.depth] = l.prefix) AS n_children FROM linked l),
up AS (SELECT c.conv_id, c.depth, d AS top, c.prefix[1:d] AS top_prefix, (c.n_children = 0)::BIGINT AS leaf, CASE WHEN c.depth = 0 THEN 0 ELSE (c.n_convs - 1) * strlen(c.prefix[c.depth].text) END AS saved
  FROM counted c, LATERAL (SELECT unnest(range(0, c.depth + 1)) AS d)),
sums AS (SELECT top, top_prefix, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY top, top_prefix)
SELECT c.conv_id, c.depth, c.parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, sha256(c.ends) AS ends_sha256
FROM counted c JOIN sums s ON s.top = c.depth AND s.top_prefix = c.prefix
"""
