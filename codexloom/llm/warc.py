"""WARC archives: writing with payload revisits, and a salvage reader.

Archives are WARC/1.1 files in which every record is a gzip member of its own, so damage to one
record costs that record alone. They are written by a Python data source whose tasks write files
under hidden names that the commit renames, so a lost or repeated task leaves nothing behind that
is read. The reader takes whole files (``binaryFile``) or a DataFrame (path, content) and parses
them in Arrow batches. Plain files, gzip members per record and gzip members of many records are all
understood; a member is held in memory while it is read. Every record is checked (version line,
header fields, length, terminator, payload digest). After a failed check the reader searches for
the next version line or gzip member that parses, recovers from there and logs the bytes between
as a quarantined gap.

Defined cases: a null html gives an empty payload; an empty table gives no records; of equal
payloads the greatest page_id is the response (a null id is the least and is written empty);
repeated rows with the response's id are responses as well; other columns are ignored; a file
without any record gives one gap over all its bytes, an empty file gives nothing. ``op2_warc``
fails if an archive that it has just written shows a gap.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.window import Window

from codexloom.llm.common import shared_dir, staged, with_salt

CRLF = "\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Payloads of fewer bytes are always written whole.
MIN_REVISIT_BYTES = 1000
URN = "urn:codexloom:page:"


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, payload_digest and refers_to (null: a response).

    Digests are grouped per salt first, so a payload that a third of all pages share is spread out.
    """
    html = F.coalesce("html", F.lit(""))
    pages = with_salt(pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("payload_digest")), "page_id")
    w = Window.partitionBy("payload_digest")
    shared = (pages.where(F.col("payload_bytes") >= min_bytes)
              .groupBy("payload_digest", "_salt").agg(F.max("page_id").alias("m"), F.count(F.lit(1)).alias("n"))
              .select("payload_digest", "_salt", F.max("m").over(w).alias("first_id"), F.sum("n").over(w).alias("n"))
              .where("n > 1").drop("n"))
    refers = F.when(F.col("page_id") < F.col("first_id"), F.col("first_id")).when(F.col("page_id").isNull(), F.col("first_id"))
    return (pages.join(shared, ["payload_digest", "_salt"], "left")
            .select("page_id", "url", "html", "payload_bytes", "payload_digest", refers.alias("refers_to")))


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _urn(c: Column) -> Column:
    return F.concat(F.lit(f"<{URN}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))


def records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One WARC record per page as text (record)."""
    p = mark_revisits(pages, min_bytes)
    again = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(HTTP_HEAD), F.when(again, F.lit("")).otherwise(F.col("html")))
    # a field's value may not hold a line break
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        F.when(again, F.lit(f"WARC-Type: revisit{CRLF}")).otherwise(F.lit(f"WARC-Type: response{CRLF}")),
        _field("WARC-Record-ID", _urn(F.col("page_id"))), _field("WARC-Date", F.lit(date)), _field("WARC-Target-URI", uri),
        F.when(again, F.concat(
            _field("WARC-Refers-To", _urn(F.col("refers_to"))),
            _field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _field("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        _field("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF))
    return p.select(F.concat(head, block, F.lit("\r\n\r\n")).alias("record"))


#: Members and compressed bytes of an archive file; how many files are named at a time.
PER_FILE, FILE_BYTES, MOVES = 100_000, 32 << 20, 32


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _MemberWriter(DataSourceArrowWriter):
    """Each record of column ``record`` as a gzip member, in files that end at ``per_file`` members or with the one that reaches ``file_bytes``.

    A reader holds a file whole, so its size is bounded in bytes. Names are given at the end by the driver, some dozens at a time: an attempt of a task that fails or is
    repeated leaves no named file.
    """

    def __init__(self, path: str, per_file: int, file_bytes: int):
        self.path, self.per_file, self.file_bytes = path, per_file, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = FileSystem.from_uri(self.path)
        fs.create_dir(root)
        files, out, n, size = [], None, 0, 0
        for batch in iterator:
            for record in batch.column("record").cast(pa.binary()):
                if out is None or n == self.per_file or size >= self.file_bytes:
                    if out is not None:
                        out.close()
                    name = uuid.uuid4().hex
                    files.append((f"{root}/_{name}.warc.gz", f"{root}/part-{name}.warc.gz"))
                    out, n = fs.open_output_stream(files[-1][0], compression=None), 0
                    size = 0
                c = zlib.compressobj(wbits=31)
                member = c.compress(record.as_py()) + c.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = FileSystem.from_uri(self.path)
        fs.create_dir(root)
        with ThreadPoolExecutor(MOVES) as pool:
            for _ in pool.map(lambda f: fs.move(*f), (f for m in messages if m for f in m.files)):
                pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = FileSystem.from_uri(self.path)
        for m in messages:
            for hidden, _ in m.files if m else ():
                fs.delete_file(hidden)


class WarcSink(DataSource):
    """Sink ``warc_members`` (options path, per_file, file_bytes) for a DataFrame (record)."""

    @classmethod
    def name(cls) -> str:
        return "warc_members"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _MemberWriter(self.options["path"], int(self.options.get("per_file", PER_FILE)), int(self.options.get("file_bytes", FILE_BYTES)))


def write_warc(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, per_file: int = PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Write pages as archives under ``path``, a gzip member per record; see ``_MemberWriter`` for their size."""
    pages.sparkSession.dataSource.register(WarcSink)
    records(pages, min_bytes).write.format("warc_members").option("per_file", per_file).option("file_bytes", file_bytes).mode("append").save(path)


RECORD_SCHEMA = ("path string, kind string, offset long, inner_offset long, length long, record_type string, record_id string, "
                 "target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, note string")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"


def _record(data: bytes, pos: int) -> tuple[int, dict, bytes] | str:
    """(end, fields, block) of the record at pos, or why there is none."""
    if not _VERSION.match(data, pos):
        return "no version line"
    stop = data.find(b"\r\n\r\n", pos)
    if stop < 0:
        return "header not ended"
    fields = {}
    for line in data[pos:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header line"
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit()) or "warc-type" not in fields or "warc-record-id" not in fields:
        return "missing field"
    end = stop + 4 + int(size)
    if data[end:end + 4] != b"\r\n\r\n":
        return "bad length or terminator"
    return end + 4, fields, data[stop + 4:end]


def _payload(fields: dict, block: bytes) -> bytes:
    if fields.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _checked(data: bytes, pos: int) -> tuple[int, dict, bytes, str] | str:
    got = _record(data, pos)
    if isinstance(got, str):
        return got
    end, fields, block = got
    payload = _payload(fields, block)
    digest = hashlib.sha1(payload).hexdigest()
    want = fields.get("warc-payload-digest", "")
    if fields["warc-type"] == "revisit":
        return end, fields, payload, want.removeprefix("sha1:")
    if want.startswith("sha1:") and want[5:].lower() != digest:
        return "payload digest differs"
    return end, fields, payload, digest


def _member(data: bytes, pos: int) -> tuple[int, bytes, bool]:
    """(end, content, whole) of the gzip member at pos; of a broken one as much as can be inflated."""
    inflate, out, at, step = zlib.decompressobj(31), [], pos, 65536
    while at < len(data) and not inflate.eof:
        before = inflate.copy()
        try:
            out.append(inflate.decompress(data[at:at + step]))
            at += step
        except zlib.error:
            # a failing call gives nothing, so it is repeated in smaller steps, at last by bytes of output
            inflate, step = before, step // 256
            if step:
                continue
            rest = data[at:at + 1]
            try:
                while got := inflate.decompress(rest, 1):
                    out.append(got)
                    rest = inflate.unconsumed_tail
            except zlib.error:
                pass
            return pos, b"".join(out), False
    return min(at, len(data)) - len(inflate.unused_data), b"".join(out), inflate.eof


def salvage(data: bytes, zipped: bool = True) -> Iterator[tuple]:
    """Yield ("record", offset, inner, length, fields, payload, digest) and ("gap", offset, inner, length, why)."""
    pos, gap, why = 0, None, ""
    marks = [b"WARC/1.", _MEMBER] if zipped else [b"WARC/1."]
    ahead = dict.fromkeys(marks, -1)
    while pos < len(data):
        found, end = [], pos
        if zipped and data.startswith(_MEMBER, pos):
            stop, content, whole = _member(data, pos)
            inside = list(salvage(content, zipped=False))
            if whole:
                found, end = inside, stop
            else:
                # the readable head of a broken member: its whole records count, the member is a gap
                found, why = [x for x in inside if x[0] == "record"], "broken gzip member"
            found = [(x[0], pos, x[2] or x[1], *x[3:]) for x in found]
        elif data.startswith(b"WARC/", pos):
            got = _checked(data, pos)
            if isinstance(got, str):
                why = got
            else:
                end = got[0]
                found = [("record", pos, 0, end - pos, *got[1:])]
        elif gap is None:
            why = "no record"
        if end > pos and gap is not None:
            yield "gap", gap[0], 0, pos - gap[0], gap[1]
            gap = None
        yield from found
        if end > pos:
            pos = end
            continue
        gap = gap or (pos, why)
        # each mark is looked for again only once it has been passed, so the search stays linear
        for mark, at in ahead.items():
            if at <= pos:
                at = data.find(mark, pos + 1)
                ahead[mark] = at if at >= 0 else len(data)
        pos = min(ahead.values())
    if gap is not None:
        yield "gap", gap[0], 0, len(data) - gap[0], gap[1]


def read_warc(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps (kind) of archives given as (path, content); see RECORD_SCHEMA for the columns."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in RECORD_SCHEMA.split(", ")]
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows = []
                for kind, offset, inner, length, *rest in salvage(content.as_py() or b""):
                    if kind == "gap":
                        rows.append((path.as_py(), kind, offset, inner, length, *[None] * 7, rest[0]))
                        continue
                    fields, payload, digest = rest
                    size = fields.get("x-payload-length", "") if fields["warc-type"] == "revisit" else str(len(payload))
                    rows.append((path.as_py(), kind, offset, inner, length, fields["warc-type"], fields["warc-record-id"].strip("<>"),
                                 fields.get("warc-target-uri"), fields.get("warc-refers-to", "").strip("<>") or None,
                                 int(size) if size.isdigit() else None, digest, payload if with_payload else None, None))
                cols = list(zip(*rows)) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return files.select("path", "content").mapInArrow(parse, RECORD_SCHEMA)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{staged(shared_dir(spark))}/warc"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    got = read_warc(files, with_payload=False)
    torn = F.raise_error(F.concat(F.lit("a gap in an archive just written: "), F.coalesce("path", F.lit("")), F.lit(" "), F.coalesce("note", F.lit(""))))
    got = got.withColumn("record_id", F.when(F.col("kind") == "gap", torn).otherwise(F.col("record_id")))
    number = lambda c: F.substring(c, len(URN) + 1, 40).try_cast("long")  # noqa: E731  # a null page_id is an empty one in the archive
    return got.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                      number(F.col("refers_to")).alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
             CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id > page_id THEN first_id END AS refers_to
FROM q
"""
