"""WARC writing and a splittable WARC reader.

Each record is one gzip member. Writing goes through Spark's own committing text sink, whose line
separator is the zero byte: a member shorter than 16 MB ends in a zero byte (the top byte of its length
field), which is left to the sink to add, and a longer one is followed by an empty member, so the files
are plain .warc.gz data and any store that Spark writes to will do.

Reading deals byte ranges of the files to tasks. A task scans its range for the gzip magic, tries to
inflate the start of every candidate and takes it as a record only if a WARC version line and a whole
header block come out; it owns the records that start inside its range and reads past its end for the last.

Of records with equal payloads, that with the largest page_id is a response, the others are revisits
without a payload. Defined results: null html is an empty payload; equal page_ids with equal payloads
are one response and revisits of it; a null page_id is written as such and is the smallest; very long payloads
are written and read whole; a member that is damaged, or cut off by its file's end, is passed over and the bytes
behind its start are searched for others; an empty table gives no records; columns other than page_id, url and
html are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, parts_for, text_slices

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
RANGE_BYTES = 8 << 20
PROBE_BYTES = 4096


def gzip_member(data: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: list[tuple[str, str]], body: bytes) -> bytes:
    """One WARC record: version, fields, Content-Length, body and the two closing line ends."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(body)))])
    return VERSION + head.encode() + b"\r\n" + body + b"\r\n\r\n"


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = ("page_id", "url", "html", "sha", "size", "keeper", "place")
    for batch in text_slices(batches, "html", rows=2000):
        out = []
        for page, url, html, sha, size, keeper, order in zip(*(batch.column(k).to_pylist() for k in columns), strict=True):
            revisit = order > 1
            digest = base64.b32encode(bytes.fromhex(sha)).decode()
            rid = uuid.uuid5(uuid.NAMESPACE_OID, f"{page}/{order}/{digest}")
            fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{rid}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
            if url is not None:
                fields.append(("WARC-Target-URI", _clean(url)))
            fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size))]
            if page is not None:
                fields.append(("X-Page-ID", str(page)))
            if revisit:
                fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
                if keeper is not None:
                    fields.append(("X-Refers-To-Page-ID", str(keeper)))
            member = gzip_member(record(fields, b"" if revisit else (html or "").encode("utf-8", "surrogatepass")))
            if member[-1]:
                member += gzip_member(b"")
            out.append(member[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_warc(spark: SparkSession, pages: DataFrame, path: str) -> None:
    """Writes one record per row of pages (page_id, url, html) to files below path.

    Payloads go to their records by payload and page_id, so no payload is a hot key; revisits carry none.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = pages.withColumn("sha", F.sha1(F.coalesce("html", F.lit("")))).withColumn("size", F.coalesce(F.octet_length("html"), F.lit(0)).cast("long"))
    # how often the largest page_id of a payload occurs in it: rows that repeat it need numbering, no others
    per = rows.groupBy("sha", "page_id").agg(F.count("*").alias("n"))
    keep = per.groupBy("sha").agg(F.max(F.struct("page_id", "n")).alias("top"), F.sum("n").alias("rows"))
    s = Scratch(spark, "warc-keys")
    keep = s.save(keep.select("sha", F.col("top.page_id").alias("keeper"), F.col("top.n").alias("ties"), "rows"), "keep")
    cols = ["page_id", "url", "html", "sha", "size", "keeper", "place"]
    k = keep.select(F.col("sha").alias("_sha"), "keeper", "ties")
    tops = rows.join(k, (F.col("sha") == F.col("_sha")) & F.col("page_id").eqNullSafe(F.col("keeper"))).drop("_sha")
    members = tops.where("ties = 1").withColumn("place", F.lit(1)).select(cols)
    if not keep.where("ties > 1").isEmpty():
        members = members.unionByName(_numbered(tops.where("ties > 1")).select(cols))
    others = rows.drop("html").join(keep.where("rows > ties").select("sha", "keeper"), "sha").where("not (page_id <=> keeper)")
    members = members.unionByName(others.withColumn("html", F.lit(None).cast("string")).withColumn("place", F.lit(2)).select(cols))
    members = members.mapInArrow(_write, "value binary")
    members.select(F.col("value").cast("string")).write.option("lineSep", "\u0000").option("compression", "none").text(path)


def _numbered(top: DataFrame) -> DataFrame:
    """place 1 for one row of each payload among rows of the keeper's page_id, 2 for its repeats."""
    from pyspark.sql import Window as W

    order = W.partitionBy("sha", "page_id").orderBy(F.col("url").asc_nulls_last())
    return top.withColumn("place", F.least(F.lit(2), F.row_number().over(order)))


def byte_ranges(spark: SparkSession, path: str, span: int = RANGE_BYTES, per_task: int = 16) -> DataFrame:
    """(file, start, end) covering all data files below path, about per_task ranges to a task.

    Files are listed by Spark's own reader, whose metadata columns leave the contents unread; ranges are made by tasks.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("path").alias("file"), "length")
    ranges = files.select("file", "length", F.explode(F.expr(f"sequence(0L, length - 1, {span}L)")).alias("start"))
    ranges = ranges.select("file", "start", F.least("length", F.col("start") + span).alias("end"))
    total = files.agg(F.sum("length")).first()[0] or 0
    return ranges.repartition(parts_for(spark, total // (span * per_task)), "file", "start")


def _probe(window: bytes) -> bool:
    """Does a gzip member that opens with a WARC header block start here?"""
    z = zlib.decompressobj(31)
    try:
        head = z.decompress(window, 65536)
    except zlib.error:
        return False
    return head.startswith(b"WARC/1.") and b"WARC-Type:" in head and (b"\r\n\r\n" in head or not z.eof)


class _Window:
    """Bytes of a file from a moving position on, read in steps."""

    def __init__(self, handle, start: int, step: int = 1 << 20):
        self.f, self.at, self.buf, self.step, self.done = handle, start, b"", step, False
        handle.seek(start)

    def more(self) -> bool:
        got = b"" if self.done else self.f.read(self.step)
        self.done = self.done or not got
        self.buf += got
        return bool(got)

    def cut(self, n: int) -> None:
        self.buf, self.at = self.buf[n:], self.at + n


def members_in(handle, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated bytes) of the WARC records whose members start in [start, end)."""
    w = _Window(handle, start)
    w.more()
    while w.at < end:
        i = w.buf.find(MAGIC)
        if i < 0:
            w.cut(max(0, len(w.buf) - 2))
            if not w.more():
                return
            continue
        w.cut(i)
        if w.at >= end:
            return
        while len(w.buf) < PROBE_BYTES and w.more():
            pass
        if not _probe(w.buf[:PROBE_BYTES]):
            w.cut(1)
            continue
        z, offset, parts = zlib.decompressobj(31), w.at, []
        try:
            while True:
                parts.append(z.decompress(w.buf))
                w.cut(len(w.buf) - len(z.unused_data))
                if z.eof or not w.more():
                    break
            whole = z.eof
        except zlib.error:
            whole = False
        if not whole:  # damaged or cut off by the file's end: what follows is searched again from its second byte on
            w = _Window(handle, offset + 1)
            w.more()
            continue
        yield offset, b"".join(parts)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-case name, body) of an inflated record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
    return fields, rest[: int(fields.get("content-length", len(rest)))]


RECORD_SCHEMA = "file string, offset long, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, body binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs as pafs

    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for file, start, end in zip(*(batch.column(k).to_pylist() for k in ("file", "start", "end")), strict=True):
            store, path = pafs.FileSystem.from_uri(file if "://" in file else file.replace("file:/", "file:///", 1))
            rows, held = [], 0
            with store.open_input_file(path) as handle:
                for offset, raw in members_in(handle, start, end):
                    f, body = parse_record(raw)
                    whole = f.get("warc-type") == "response"
                    digest = _digest(body) if whole else f.get("warc-payload-digest", "").removeprefix("sha1:")
                    if whole and f.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
                        raise ValueError(f"{file} at {offset}: the payload doesn't have the digest in its header")
                    number = lambda k, f=f: int(f[k]) if k in f else None
                    rows.append((file, offset, f.get("warc-type"), number("x-page-id"), f.get("warc-target-uri"), digest, len(body) if whole else number("x-payload-length"), number("x-refers-to-page-id"), body))
                    held += len(body)
                    if held > 4 << 20 or len(rows) >= 2000:
                        yield flush(rows)
                        rows, held = [], 0
            if rows:
                yield flush(rows)


def read_warc(spark: SparkSession, path: str, span: int = RANGE_BYTES) -> DataFrame:
    """A row per record of the archives below path, by byte ranges of span bytes."""
    return byte_ranges(spark, path, span).mapInArrow(_read, RECORD_SCHEMA)


def archived_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back."""
    s = Scratch(spark, "warc")
    write_warc(spark, pages, s.path("archives"))
    got = read_warc(spark, s.path("archives"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "offset")
